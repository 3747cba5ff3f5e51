"""Joins and set operations over dependencies, claims, subscriptions and deliveries. AQE picks the algorithms."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.operators.listing import page, page_after


def runs_with_definitions(runs: DataFrame, definitions: DataFrame, name: str | None = None, state: str | None = None) -> DataFrame:
    named = definitions.select(F.col("id").alias("definition_id"), F.col("name").alias("definition_name"))
    if name is not None:
        named = named.where(F.col("definition_name") == name)
    rows = runs.join(named, "definition_id")
    return rows if state is None else rows.where(F.col("state") == state)


def list_runs(runs, definitions, limit: int, name=None, state=None, cursor=None) -> DataFrame:
    return page_after(runs_with_definitions(runs, definitions, name, state), "created_at", limit, cursor)


def available_messages(messages: DataFrame, deliveries: DataFrame, topic: str, subscription: str, now: int, limit: int) -> DataFrame:
    """Messages without a delivery, or with one that is neither acknowledged nor leased any more, oldest first."""
    own = deliveries.where((F.col("topic") == topic) & (F.col("subscription_name") == subscription))
    own = own.select(F.col("message_id").alias("id"), "acked", "lease_expires_at", F.lit(True).alias("_delivered"))
    rows = messages.where(F.col("topic") == topic).join(own, "id", "left")
    free = F.col("_delivered").isNull() | (~F.col("acked") & (F.col("lease_expires_at") <= now))
    return page(rows.where(free).drop("acked", "lease_expires_at", "_delivered"), "id", limit, ascending=True)


def all_statuses(live: DataFrame, archived: DataFrame) -> DataFrame:
    return live.select("id", "status").union(archived.select("id", "status"))


def blocked(edges: DataFrame, live: DataFrame, archived: DataFrame) -> DataFrame:
    """Jobs with a dependency that isn't complete. A parent that is in neither table blocks nothing."""
    open_ = all_statuses(live, archived).where("status <> 2").select(F.col("id").alias("depends_on_job_id"))
    return edges.join(open_, "depends_on_job_id", "left_semi").select("job_id").distinct()


def dispatchable(jobs: DataFrame, edges: DataFrame, live: DataFrame, archived: DataFrame) -> DataFrame:
    return jobs.where("status = 0").join(blocked(edges, live, archived).withColumnRenamed("job_id", "id"), "id", "left_anti")


def validate_dependencies(edges: DataFrame, live: DataFrame, archived: DataFrame, namespace: str | None) -> DataFrame:
    """Each dependency with the reason for its rejection, null if it is valid."""
    parents = live.select("id", "status", "namespace", F.lit(True).alias("_live")).union(archived.select("id", "status", "namespace", F.lit(False).alias("_live")))
    rows = edges.join(parents.withColumnRenamed("id", "depends_on_job_id"), "depends_on_job_id", "left")
    same: Column = F.col("namespace").isNull() if namespace is None else F.col("namespace") == namespace
    reason = (
        F.when(F.col("status").isNull(), "missing")
        .when(~F.coalesce(same, F.lit(False)), "namespace")
        .when(F.col("_live") & F.col("status").isin(4, 5), "dead")
        .when(~F.col("_live") & (F.col("status") != 2), "not complete")
    )
    return rows.select("job_id", "depends_on_job_id", reason.alias("reason"))


def orphaned(claims: DataFrame, live_workers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Running jobs whose claim is of a worker that isn't live; none while no worker is live."""
    some = F.broadcast(live_workers.limit(1).select(F.lit(1).alias("_one")))
    lost = claims.join(live_workers.select("worker_id"), "worker_id", "left_anti").withColumn("_one", F.lit(1)).join(some, "_one", "left_semi")
    return lost.join(jobs.where("status = 1").withColumnRenamed("id", "job_id"), "job_id")


def debounce_targets(jobs: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """The oldest pending job of each key that nobody has claimed."""
    free = jobs.where(F.col(key).isNotNull() & (F.col("status") == 0)).join(claims.select(F.col("job_id").alias("id")), "id", "left_anti")
    rank = F.row_number().over(Window.partitionBy("namespace", key).orderBy("created_at", "id"))
    return free.withColumn("_r", rank).where("_r = 1").drop("_r")


def fan_out(messages: DataFrame, subscriptions: DataFrame, default_priority: int) -> DataFrame:
    """A job for each message and active subscription that isn't a log; settings of the subscription come first."""
    subs = subscriptions.where("active and mode <> 'log'").select("topic", "subscription_name", "task_name", "queue", "priority")
    rows = messages.select(F.col("id").alias("message_id"), "topic", "created_at").join(subs, "topic")
    return rows.withColumn("priority", F.coalesce("priority", F.lit(default_priority)))


def job_links(edges: DataFrame, own: str, other: str, job_id: str) -> DataFrame:
    return edges.where(F.col(own) == job_id).select(F.col(other).alias("id"))


def ready_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending nodes all of whose predecessors are completed; cached or skipped ones don't count as that."""
    open_ = nodes.where("status <> 'completed'").select("run_id", F.col("node_name").alias("src"))
    waiting = edges.join(open_, ["run_id", "src"], "left_semi").select("run_id", F.col("dst").alias("node_name"))
    return nodes.where("status = 'pending'").join(waiting, ["run_id", "node_name"], "left_anti")


def child_runs(runs: DataFrame, parent: str | None = None) -> DataFrame:
    rows = runs.where(F.col("parent_run_id").isNotNull())
    return rows if parent is None else rows.where(F.col("parent_run_id") == parent)


def claims_of(claims: DataFrame, workers: DataFrame) -> DataFrame:
    return claims.join(workers.select("worker_id"), "worker_id", "left_semi")


def reapable_subscriptions(subscriptions: DataFrame, live_workers: DataFrame, now: int, grace: int = 60_000) -> DataFrame:
    """Subscriptions of owners that are gone, once they are older than the grace period."""
    owned = subscriptions.where(F.col("owner_worker_id").isNotNull() & (F.col("created_at") < now - grace))
    return owned.join(live_workers.select(F.col("worker_id").alias("owner_worker_id")), "owner_worker_id", "left_anti")


def ring_points(workers: DataFrame, vnodes: int, worker: str = "worker_id") -> DataFrame:
    """Points of a hash ring: `vnodes` for each worker."""
    spread = workers.select(F.col(worker), F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("_v"))
    return spread.select(F.col(worker), F.xxhash64(F.col(worker), "_v").alias("point"))


def ring_owner(keys: DataFrame, points: DataFrame, key: str, worker: str = "worker_id") -> DataFrame:
    """The owner of each key: the next point clockwise, from the last around to the first.

    Points and keys are put in one order within ranges of the ring; each range also knows the first point after it, so
    that a key never has to meet all points."""
    ranges = min(1 << 16, max(256, keys.count() // 500_000))
    span = F.floor(F.col("at") / F.lit(float(2**64 / ranges))).cast("int")
    marks = points.select(F.col("point").alias("at"), F.col(worker).alias("owner"), F.lit(None).cast(keys.schema[key].dataType).alias(key), F.lit(0).alias("_kind"))
    wanted = keys.select(F.xxhash64(key).alias("at"), F.lit(None).cast("string").alias("owner"), F.col(key), F.lit(1).alias("_kind"))
    # From the end of a range on, since a frame up to the current row is carried along and one behind it made anew for each row.
    own = Window.partitionBy("_range").orderBy(F.col("at").desc(), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marks.unionByName(wanted).withColumn("_range", span).withColumn("_near", F.last("owner", ignorenulls=True).over(own))
    firsts = marks.withColumn("_range", span).groupBy("_range").agg(F.min_by("owner", "at").alias("_first"))
    spans = keys.sparkSession.range(-ranges // 2, ranges // 2).select(F.col("id").cast("int").alias("_range")).join(firsts, "_range", "left")
    after = Window.partitionBy(F.lit(1)).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = spans.select("_range", F.coalesce(F.last("_first", ignorenulls=True).over(after), F.first("_first", ignorenulls=True).over(whole)).alias("_next"))
    return rows.where("_kind = 1").join(F.broadcast(spans), "_range").select(key, F.coalesce("_near", "_next").alias(worker))


def steal_target(workers: DataFrame, own: str, least_surplus: int, alive: Column) -> DataFrame:
    """Of the living peers the one with the fullest buffer, if that holds more than the surplus; ties go to the smallest name."""
    peers = workers.where(alive & (F.col("worker_id") != own) & (F.col("buffered") > least_surplus))
    return peers.orderBy(F.col("buffered").desc(), "worker_id").limit(1)


def purgeable_messages(messages: DataFrame, floors: DataFrame, acked: DataFrame, now: int) -> DataFrame:
    """Messages that are past their time, behind every cursor, or acknowledged by all; each once."""
    expired = messages.where(F.col("expires_at") <= now).select("topic", "id")
    behind = messages.join(floors.where("floor is not null"), "topic").where("id <= floor").select("topic", "id")
    return expired.union(behind).union(acked.select("topic", "id")).distinct()


def compacted(messages: DataFrame, floors: DataFrame, acked: DataFrame, now: int, budget: int) -> DataFrame:
    """The messages that a compaction leaves. It drops `budget` at most: expired ones first, then those that every cursor of
    their topic has passed, then those that every subscription has acknowledged; in order of topic and id within these."""
    expired = messages.where(F.col("expires_at") <= now).select("topic", "id", F.lit(0).alias("_stage"))
    behind = messages.join(floors.where("floor is not null"), "topic").where("id <= floor").select("topic", "id", F.lit(1).alias("_stage"))
    gone = expired.union(behind).union(acked.select("topic", "id", F.lit(2).alias("_stage"))).groupBy("topic", "id").agg(F.min("_stage").alias("_stage"))
    gone = gone.orderBy("_stage", "topic", "id").limit(budget)
    return messages.join(gone.select("topic", "id"), ["topic", "id"], "left_anti")
