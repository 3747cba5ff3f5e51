"""Row updates of a job's life, as projections of a snapshot: retries, dead letters, purges, claims, steps."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.exprs import is_shed
from opsloom.operators.stats import expired_by

RETRIES = "__dlq_retry_count"


def unique_active(jobs: DataFrame, key: str = "unique_key") -> DataFrame:
    """Of the active jobs with one key the first; jobs without a key all stay."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("created_at", "id"))
    keyed = jobs.where(F.col(key).isNotNull() & F.col("status").isin(0, 1)).withColumn("_r", rank).where("_r = 1").drop("_r")
    return keyed.unionByName(jobs.where(F.col(key).isNull()))


def resolved_keys(requests: DataFrame, jobs: DataFrame, key: str = "unique_key") -> DataFrame:
    """For each request with a key the active job that it gets: the one that holds the key, else the first request."""
    held = unique_active(jobs.where(F.col(key).isNotNull()), key).select(key, F.col("id").alias("_held"))
    first = F.first("id").over(Window.partitionBy(key).orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return requests.where(F.col(key).isNotNull()).withColumn("_first", first).join(held, key, "left").select("id", key, F.coalesce("_held", "_first").alias("job_id"))


def compare_and_set(df: DataFrame, column: str, expected, value) -> DataFrame:
    """Null-safe: a missing value can be expected."""
    return df.withColumn(column, F.when(F.col(column).eqNullSafe(F.lit(expected)), F.lit(value)).otherwise(F.col(column)))


def outcome(df: DataFrame, budget: str = "budget_ok", retryable: str = "should_retry") -> DataFrame:
    """What becomes of a finished attempt: completed, cancelled, retried or dead."""
    can = F.col(retryable) & (F.col("retry_count") < F.col("max_retries"))
    verdict = F.when(F.col("succeeded"), "completed").when(F.col("cancel_requested"), "cancelled").when(can & F.col(budget), "retry").otherwise("dead")
    return df.withColumn("outcome", verdict)


def retry_filter(error_class: Column, retry_on: list[str] | None, dont_retry_on: list[str] | None) -> Column:
    """Classes that are excluded aren't retried; with a list of classes to retry, only those are."""
    keep = F.lit(True) if not retry_on else error_class.isin(retry_on)
    return keep if not dont_retry_on else keep & ~error_class.isin(dont_retry_on)


def to_dead_letter(jobs: DataFrame, error: Column, now: int, metadata: Column | None = None) -> DataFrame:
    text = F.col("metadata") if metadata is None else F.coalesce(metadata, F.col("metadata"))
    retries = F.coalesce(F.get_json_object(text, f"$.{RETRIES}").try_cast("int"), F.lit(0))
    return jobs.select(
        F.concat(F.lit("d"), "id").alias("id"), F.col("id").alias("original_job_id"), "queue", "task_name", error.alias("error"), F.lit(now).alias("failed_at"),
        text.alias("metadata"), retries.alias("dlq_retry_count"), is_shed(error).alias("shed"), "result_ttl_ms", "namespace",
    )


def replayed(dead: DataFrame, now: int) -> DataFrame:
    """Fresh pending jobs from dead letters, without key, dependencies or expiry, and with one more retry counted."""
    more = F.col("dlq_retry_count") + 1
    return dead.select(
        F.concat(F.lit("r"), "original_job_id").alias("id"), "queue", "task_name", F.lit(0).alias("status"), F.lit(now).alias("created_at"), F.lit(now).alias("scheduled_at"),
        F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("unique_key"), F.lit(None).cast("bigint").alias("expires_at"),
        F.concat(F.lit('{"' + RETRIES + '":'), more.cast("string"), F.lit("}")).alias("metadata"), "namespace",
    )


def survivors(df: DataFrame, time: str, cutoff: int | None, now: int, ttl: str | None = None) -> DataFrame:
    return df.where(~expired_by(time, cutoff, now, ttl))


def split_archive(jobs: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """Terminal jobs that ended before the cutoff, and the rest."""
    old = F.col("status").isin(2, 3, 4, 5) & F.coalesce(F.col("completed_at") < cutoff, F.lit(False))
    return jobs.where(old), jobs.where(~old)


def cancel_pending(jobs: DataFrame, condition: Column, reason: str) -> DataFrame:
    hit = condition & (F.col("status") == 0)
    return jobs.withColumn("error", F.when(hit, F.lit(reason)).otherwise(F.col("error"))).withColumn("status", F.when(hit, F.lit(5)).otherwise(F.col("status")))


def advance_cursors(subscriptions: DataFrame, acks: DataFrame) -> DataFrame:
    """Cursors only move forward: the greatest of what is there and what was acknowledged."""
    top = acks.groupBy("topic", "subscription_name").agg(F.max("message_id").alias("_ack"))
    rows = subscriptions.join(top, ["topic", "subscription_name"], "left")
    return rows.withColumn("cursor", F.when(F.col("mode") == "log", F.greatest("cursor", "_ack")).otherwise(F.col("cursor"))).drop("_ack")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: what an upsert leaves of an append-only table."""
    payload = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(payload, F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def first_claims(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("job_id").agg(F.min(F.struct("claimed_at", "worker_id")).alias("_f")).select("job_id", F.col("_f.worker_id").alias("worker_id"), F.col("_f.claimed_at").alias("claimed_at"))


def reclaimed(claims: DataFrame, expected: str, new: str) -> DataFrame:
    return claims.withColumn("worker_id", F.when(F.col("worker_id") == expected, F.lit(new)).otherwise(F.col("worker_id")))


def checked_steps(steps: DataFrame, most_step: int, most_job: int, most_steps: int, *then: str) -> DataFrame:
    """Each step's verdict: gapless sequence, keys used once, sizes within the limits of step and job. Steps with one sequence
    number go in the order of the columns `then`."""
    own = Window.partitionBy("job_id").orderBy("seq", *then)
    place = F.row_number().over(own) - 1
    total = F.sum("result_len").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    again = F.row_number().over(Window.partitionBy("job_id", "step_key").orderBy("seq", *then)) > 1
    verdict = (
        F.when(again | (place != F.col("seq")), "diverged").when(F.col("result_len") > most_step, "step too large")
        .when(total > most_job, "job too large").when(place >= most_steps, "too many steps").otherwise("committed")
    )
    return steps.withColumn("verdict", verdict)
