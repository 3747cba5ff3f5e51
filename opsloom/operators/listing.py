"""Scans, filters, orderings and pages over job, log and message tables. Every limit has a total order."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.exprs import TERMINAL, before_cursor, in_namespace_read, is_shed

# The columns of a listing, everything but payload and result, so that a columnar scan never reads those.
NARROW = [
    "id", "queue", "task_name", "status", "priority", "created_at", "scheduled_at", "started_at", "completed_at", "retry_count",
    "max_retries", "error", "timeout_ms", "unique_key", "progress", "metadata", "notes", "cancel_requested", "expires_at", "result_ttl_ms", "namespace",
    "has_deps", "debounce_key",
]
LISTED = ["id", "queue", "task_name", "status", "created_at"]


def narrow(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in NARROW if c in df.columns])


def live_and_archived(live: DataFrame, archived: DataFrame) -> DataFrame:
    return live.unionByName(archived, allowMissingColumns=True)


def get_job(live: DataFrame, archived: DataFrame, id_: str, namespace: str | None = None) -> DataFrame:
    """The live row if there is one, else the archived one; a row of another namespace reads as missing."""
    mine = in_namespace_read(namespace)
    a = live.where((F.col("id") == id_) & mine).withColumn("_order", F.lit(0))
    b = archived.where((F.col("id") == id_) & mine).withColumn("_order", F.lit(1))
    return a.unionByName(b, allowMissingColumns=True).orderBy("_order").limit(1).drop("_order")


def job_filter(status=None, queue=None, task=None, metadata_like=None, error_like=None, created_after=None, created_before=None, namespace=None) -> Column:
    """The conjunction of the filters that are given; metadata and error patterns are LIKE patterns, not escaped."""
    keep = in_namespace_read(namespace)
    for column, value in (("status", status), ("queue", queue), ("task_name", task)):
        if value is not None:
            keep &= F.col(column) == value
    if metadata_like is not None:
        keep &= F.col("metadata").like(f"%{metadata_like}%")
    if error_like is not None:
        keep &= F.col("error").like(f"%{error_like}%")
    if created_after is not None:
        keep &= F.col("created_at") >= created_after
    if created_before is not None:
        keep &= F.col("created_at") <= created_before
    return keep


def scan_of(live: DataFrame, archived: DataFrame, status: int | None) -> DataFrame:
    """Terminal statuses are archived, the others live; without a status both tables are read."""
    if status is None:
        return live_and_archived(narrow(live), narrow(archived))
    return narrow(archived if status in TERMINAL else live)


def empty(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def page(df: DataFrame, key: str, limit: int, offset: int = 0, id_col: str = "id", ascending: bool = False) -> DataFrame:
    if limit <= 0:
        return empty(df)
    order = [F.col(key).asc(), F.col(id_col).asc()] if ascending else [F.col(key).desc(), F.col(id_col).desc()]
    return df.orderBy(*order).offset(max(0, offset)).limit(limit)


def page_after(df: DataFrame, key: str, limit: int, cursor: tuple[int, str] | None, id_col: str = "id") -> DataFrame:
    """The page that follows a cursor of key and id, newest first."""
    return page(df.where(before_cursor(key, cursor, id_col)), key, limit, 0, id_col)


def list_jobs(live, archived, limit: int, offset: int = 0, **filters) -> DataFrame:
    return page(scan_of(live, archived, filters.get("status")).where(job_filter(**filters)), "created_at", limit, offset)


def list_jobs_after(live, archived, limit: int, cursor, **filters) -> DataFrame:
    return page_after(scan_of(live, archived, filters.get("status")).where(job_filter(**filters)), "created_at", limit, cursor)


def next_cursor(rows: DataFrame, key: str, limit: int, id_col: str = "id") -> DataFrame:
    """One row: the cursor of a page's last row, null if the page is short."""
    last = F.min(F.struct(F.col(key).alias("k"), F.col(id_col).alias("i")))
    text = F.concat_ws(":", last["k"].cast("string"), last["i"])
    return rows.agg(F.when(F.count(F.lit(1)) >= limit, text).alias("next_cursor"))


def metrics_since(metrics: DataFrame, since: int, task: str | None = None, namespace: str | None = None) -> DataFrame:
    keep = (F.col("recorded_at") >= since) & in_namespace_read(namespace)
    return metrics.where(keep if task is None else keep & (F.col("task_name") == task))


def logs(df: DataFrame, since: int, limit: int, task=None, level=None) -> DataFrame:
    keep = F.col("logged_at") >= since
    for column, value in (("task_name", task), ("level", level)):
        if value is not None:
            keep &= F.col(column) == value
    return page(df.where(keep), "logged_at", limit)


def logs_after(df: DataFrame, job_id: str, after: str | None) -> DataFrame:
    own = df.where(F.col("job_id") == job_id)
    return own if after is None else own.where(F.col("id") > after)


def dead_for_retry(dead: DataFrame, cutoff: int, max_retries: int, queues: list[str], limit: int, namespace=None) -> DataFrame:
    """Dead letters that may be retried by themselves, oldest first: not shed, and of the queues served."""
    keep = (F.col("failed_at") <= cutoff) & (F.col("dlq_retry_count") < max_retries) & F.col("queue").isin(queues) & ~F.col("shed") & in_namespace_read(namespace)
    return page(dead.where(keep), "failed_at", limit, ascending=True)


def stale_running(jobs: DataFrame, now: int) -> DataFrame:
    return jobs.where((F.col("status") == 1) & (F.col("started_at") + F.col("timeout_ms") < now))


def expired_pending(jobs: DataFrame, now: int) -> DataFrame:
    """Pending jobs past their time, as the cancelled rows that they become."""
    gone = jobs.where((F.col("status") == 0) & (F.col("expires_at") < now))
    return gone.withColumn("status", F.lit(5)).withColumn("error", F.lit("expired"))


def live_workers(workers: DataFrame, cutoff: int) -> DataFrame:
    return workers.where(F.col("last_heartbeat") >= cutoff)


def dead_workers(workers: DataFrame, cutoff: int) -> DataFrame:
    return workers.where(F.col("last_heartbeat") < cutoff)


def due_periodic(tasks: DataFrame, now: int) -> DataFrame:
    return tasks.where(F.col("enabled") & (F.col("next_run") <= now))


def active_queues(queues: DataFrame, state: DataFrame) -> DataFrame:
    return queues.join(state.where("paused").select("queue"), "queue", "left_anti")


def active_subscriptions(subscriptions: DataFrame, topic: str) -> DataFrame:
    return subscriptions.where(F.col("active") & (F.col("topic") == topic)).orderBy("created_at", "subscription_name")


def nodes_by_prefix(nodes: DataFrame, run_id: str, prefix: str) -> DataFrame:
    """`_` and `%` of the prefix are wildcards, as in LIKE."""
    return nodes.where((F.col("run_id") == run_id) & F.col("node_name").like(f"{prefix}%"))


def read_log(messages: DataFrame, subscriptions: DataFrame, topic: str, subscription: str, limit: int) -> DataFrame:
    """Messages after a log subscription's cursor, oldest first; none for other subscriptions."""
    sub = subscriptions.where((F.col("topic") == topic) & (F.col("subscription_name") == subscription) & (F.col("mode") == "log"))
    sub = sub.select("topic", F.col("cursor").alias("_cursor"))
    rows = messages.join(F.broadcast(sub), "topic").where(F.col("_cursor").isNull() | (F.col("id") > F.col("_cursor"))).drop("_cursor")
    return page(rows, "id", limit, ascending=True)


def shed_only(dead: DataFrame) -> DataFrame:
    return dead.where(is_shed("error"))
