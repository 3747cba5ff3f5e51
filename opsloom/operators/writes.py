"""Rows that writers append: jobs with their dependencies, messages, metrics, logs, errors, replays, and durable sleeps.

Each function makes the rows of one sink from a batch of requests; Catalog.append adds them. Ids are made from the request, so
that a batch that is written again after a failure has the same ids."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.operators.joins import validate_dependencies


def made_id(*parts: str | Column) -> Column:
    """32 hex digits of a hash over the parts; null parts count as such."""
    text = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("\\N")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\x1f", *text), 256), 1, 32)


def refused(requests: DataFrame, live: DataFrame, archived: DataFrame, namespace: str | None) -> DataFrame:
    """Ids of requests with a dependency that is missing, of another namespace, dead, cancelled, or over but not complete."""
    edges = requests.select(F.col("id").alias("job_id"), F.explode("depends_on").alias("depends_on_job_id"))
    return validate_dependencies(edges, live, archived, namespace).where("reason is not null").select(F.col("job_id").alias("id")).distinct()


def new_jobs(requests: DataFrame, live: DataFrame, archived: DataFrame, now: int, namespace: str | None) -> DataFrame:
    """The job rows of requests (id, queue, task_name, priority, max_retries, timeout_ms, delay_ms, expires_ms, notes,
    depends_on) that aren't refused. Topic and subscription come from the notes if both are texts there."""
    text = lambda key: F.when(F.col("notes").rlike(rf'"{key}"\s*:\s*"'), F.get_json_object("notes", f"$.{key}"))
    both = text("topic").isNotNull() & text("subscription").isNotNull()
    kept = requests.join(refused(requests, live, archived, namespace), "id", "left_anti")
    return kept.select(
        "id", "queue", "task_name", F.lit(0).alias("status"), "priority", F.lit(now).alias("created_at"), (F.lit(now) + F.coalesce("delay_ms", F.lit(0))).alias("scheduled_at"),
        F.lit(0).alias("retry_count"), "max_retries", "timeout_ms", (F.lit(now) + F.col("expires_ms")).alias("expires_at"), F.lit(namespace).cast("string").alias("namespace"),
        (F.size("depends_on") > 0).alias("has_deps"), F.when(both, text("topic")).alias("topic"), F.when(both, text("subscription")).alias("subscription_name"), "notes",
    )


def new_edges(requests: DataFrame, live: DataFrame, archived: DataFrame, namespace: str | None) -> DataFrame:
    """The dependency rows that go with new_jobs."""
    kept = requests.join(refused(requests, live, archived, namespace), "id", "left_anti")
    rows = kept.select(F.col("id").alias("job_id"), F.explode("depends_on").alias("depends_on_job_id"))
    return rows.select(made_id("job_id", "depends_on_job_id").alias("id"), "job_id", "depends_on_job_id")


def new_messages(requests: DataFrame, topics: DataFrame, now: int) -> DataFrame:
    """Message rows of requests (key, topic, payload); a topic's retention, where it has one, sets when they expire."""
    rows = requests.join(topics.select("topic", "retention_ms"), "topic", "left")
    return rows.select(made_id("topic", "key").alias("id"), "topic", "payload", F.lit(now).alias("created_at"), (F.lit(now) + F.col("retention_ms")).alias("expires_at"))


def new_metrics(done: DataFrame, now: int) -> DataFrame:
    return done.select(
        made_id("job_id", "attempt", F.lit("metric")).alias("id"), "task_name", "job_id", "wall_time_ns", F.coalesce("memory_bytes", F.lit(0).cast("long")).alias("memory_bytes"), "succeeded",
        F.lit(now).alias("recorded_at"), "namespace",
    )


def new_logs(lines: DataFrame, now: int) -> DataFrame:
    return lines.select(made_id("job_id", "seq", "message").alias("id"), "job_id", "task_name", "level", "message", "extra", F.lit(now).alias("logged_at"), "namespace")


def new_errors(errors: DataFrame, jobs: DataFrame, now: int, namespace: str | None) -> DataFrame:
    """Error rows (job_id, attempt, error). With a namespace only errors of its own jobs are written; without, all are."""
    kept = errors if namespace is None else errors.join(jobs.where(F.col("namespace") == namespace).select(F.col("id").alias("job_id")), "job_id", "left_semi")
    return kept.select(made_id("job_id", "attempt").alias("id"), "job_id", "attempt", "error", F.lit(now).alias("failed_at"))


def new_replays(pairs: DataFrame, archived: DataFrame, now: int) -> DataFrame:
    """Replay rows: what the original and its replay ended with. A job that isn't over has neither error nor status."""
    ended = lambda name: archived.select(F.col("id").alias(f"{name}_job_id"), F.col("error").alias(f"{name}_error"))
    rows = pairs.join(ended("original"), "original_job_id", "left").join(ended("replay"), "replay_job_id", "left")
    return rows.select(made_id("original_job_id", "replay_job_id").alias("id"), "original_job_id", "replay_job_id", F.lit(now).alias("replayed_at"), "original_error", "replay_error")


def slept(requests: DataFrame, steps: DataFrame, jobs: DataFrame, max_steps: int) -> DataFrame:
    """What sleep requests (job_id, seq, step_key, wake_at) come to, against the committed steps (job_id, seq, step_key, kind,
    wake_at): a first commit sleeps until its deadline, a replay keeps the first one's, another step in its place or a place
    that isn't the next is `diverged`, too many steps are `limit`, and a job that isn't running has lost its claim. Jobs that
    sleep are due at the deadline."""
    known = steps.select("job_id", "seq", F.col("step_key").alias("_key"), F.col("kind").alias("_kind"), F.col("wake_at").alias("_wake"))
    count = steps.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"))
    running = jobs.where("status = 1").select(F.col("id").alias("job_id"), F.lit(True).alias("_running"))
    rows = requests.join(known, ["job_id", "seq"], "left").join(count, "job_id", "left").join(running, "job_id", "left")
    n, stored = F.coalesce("_n", F.lit(0)), F.col("_key").isNotNull()
    same = (F.col("_key") == F.col("step_key")) & (F.col("_kind") == "sleep") & F.col("_wake").isNotNull()
    verdict = (
        F.when(F.col("_running").isNull(), "claim lost").when(stored & same, "already sleeping").when(stored | (F.col("seq") != n), "diverged").when(n >= max_steps, "limit").otherwise("slept")
    )
    due = F.when(verdict == "already sleeping", F.col("_wake")).when(verdict == "slept", F.col("wake_at"))
    return rows.select("job_id", "seq", verdict.alias("outcome"), due.alias("scheduled_at"))
