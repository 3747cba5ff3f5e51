"""Registered life-cycle projections."""

from pyspark.sql import functions as F

from opsloom.operators import lifecycle as K
from opsloom.operators import listing as L
from opsloom.operators import stats as A
from opsloom.plans.registry import query
from opsloom.sources.adapters import NOW_EVENTS, NOW_JOBS

OLD = 788918400000
FIRST = "(select *, row_number() over (partition by unique_key order by created_at, id) as r from jobs where unique_key is not null)"


@query("r1_unique_keys", f"select id, unique_key from {FIRST} where r=1")
def unique_keys(c):
    return K.unique_active(c.jobs.where("unique_key is not null")).select("id", "unique_key")


@query("r2_unique_batch", f"select a.id, a.unique_key, coalesce(h.id, f.id) as job_id from (select id, unique_key, created_at from archived_jobs where unique_key is not null) a left join {FIRST} h on h.unique_key=a.unique_key and h.r=1 left join (select id, unique_key, row_number() over (partition by unique_key order by created_at, id) as r from archived_jobs where unique_key is not null) f on f.unique_key=a.unique_key and f.r=1")
def unique_batch(c):
    return K.resolved_keys(c.archived_jobs, c.jobs)


@query(
    "r12_outcomes",
    """select id, case when status=2 then 'completed' when status=5 then 'cancelled' when retry_count < max_retries and id < '000000009000' and priority<>3 then 'retry' else 'dead' end as outcome from archived_jobs""",
)
def outcomes(c):
    rows = c.archived_jobs.select("id", "retry_count", "max_retries", (F.col("status") == 2).alias("succeeded"), (F.col("status") == 5).alias("cancel_requested"), (F.col("priority") != 3).alias("should_retry"), (F.col("id") < "000000009000").alias("budget_ok"))
    return K.outcome(rows).select("id", "outcome")


@query(
    "r13_dead_letter_move",
    f"select concat('d', id) as id, id as original_job_id, coalesce(error, 'unknown') as error, cast({NOW_JOBS} as bigint) as failed_at, cast(0 as int) as dlq_retry_count, coalesce(error, 'unknown') like 'codel:%' or coalesce(error, 'unknown') like 'rate_limit:%' as shed from archived_jobs where status=4",
)
def dead_letter_move(c):
    moved = K.to_dead_letter(c.archived_jobs.where("status = 4"), F.coalesce("error", F.lit("unknown")), NOW_JOBS)
    return moved.select("id", "original_job_id", "error", "failed_at", "dlq_retry_count", "shed")


@query(
    "r14_dead_letter_replay",
    f"""select concat('r', original_job_id) as id, queue, cast(0 as int) as status, cast({NOW_JOBS} as bigint) as created_at, concat('{{"__dlq_retry_count":', cast(dlq_retry_count+1 as varchar), '}}') as metadata from dead_letter""",
)
def dead_letter_replay(c):
    return K.replayed(c.dead_letter, NOW_JOBS).select("id", "queue", "status", "created_at", "metadata")


def ttl(time):
    return f"(result_ttl_ms is null and coalesce({time} < {OLD}, false)) or coalesce({time}+result_ttl_ms < {NOW_JOBS}, false)"


@query("r15_purge_archive", f"select id, completed_at from archived_jobs where not ({ttl('completed_at')})")
def purge_archive(c):
    return K.survivors(c.archived_jobs, "completed_at", OLD, NOW_JOBS, "result_ttl_ms").select("id", "completed_at")


@query("r16_purge_dead", f"select id, failed_at from dead_letter where not ({ttl('failed_at')})")
def purge_dead(c):
    return K.survivors(c.dead_letter, "failed_at", OLD, NOW_JOBS, "result_ttl_ms").select("id", "failed_at")


@query("r17_purge_logs", f"select id, logged_at from task_logs where logged_at >= {NOW_EVENTS - 864000000}")
def purge_logs(c):
    return K.survivors(c.task_logs, "logged_at", NOW_EVENTS - 864_000_000, NOW_EVENTS).select("id", "logged_at")


@query("r19_archive_old", f"select id, status in (2,3,4,5) and coalesce(completed_at < {OLD}, false) as archived from jobs_all")
def archive_old(c):
    old, rest = K.split_archive(c.jobs_all, OLD)
    return old.select("id", F.lit(True).alias("archived")).unionByName(rest.select("id", F.lit(False).alias("archived")))


@query("r20_purge_queue", "select id, case when queue='q1' and status=0 then cast(5 as int) else status end as status, case when queue='q1' and status=0 then 'purged' else error end as error from jobs")
def purge_queue(c):
    return K.cancel_pending(c.jobs, F.col("queue") == "q1", "purged").select("id", "status", "error")


@query(
    "r21_cursor_ack",
    """select s.topic, s.subscription_name, case when s.mode='log' then greatest(s.cursor, a.m) else s.cursor end as cursor from topic_subscriptions s
       left join (select topic, subscription_name, max(message_id) as m from topic_deliveries where acked group by 1, 2) a on a.topic=s.topic and a.subscription_name=s.subscription_name""",
)
def cursor_ack(c):
    return K.advance_cursors(c.topic_subscriptions, c.topic_deliveries.where("acked")).select("topic", "subscription_name", "cursor")


@query(
    "r22_ack_nack",
    """select topic, subscription_name, message_id, case when attempts=2 then true else acked end as acked, case when attempts=3 and not acked then cast(0 as bigint) else lease_expires_at end as lease_expires_at
       from topic_deliveries""",
)
def ack_nack(c):
    acked = F.when(F.col("attempts") == 2, F.lit(True)).otherwise(F.col("acked"))
    lease = F.when((F.col("attempts") == 3) & ~F.col("acked"), F.lit(0).cast("bigint")).otherwise(F.col("lease_expires_at"))
    return c.topic_deliveries.select("topic", "subscription_name", "message_id", acked.alias("acked"), lease.alias("lease_expires_at"))


@query(
    "r24_first_claim",
    "select job_id, worker_id, claimed_at from (select *, row_number() over (partition by job_id order by claimed_at, worker_id) as r from (select job_id, worker_id, claimed_at from execution_claims union all select job_id, concat(worker_id, 'b'), claimed_at-(cast(job_id as bigint)%3-1) from execution_claims)) where r=1",
)
def first_claim(c):
    k = c.execution_claims
    late = k.select("job_id", F.concat("worker_id", F.lit("b")).alias("worker_id"), (F.col("claimed_at") - (F.col("job_id").cast("bigint") % 3 - 1)).alias("claimed_at"))
    return K.first_claims(k.unionByName(late))


@query("r25_reclaim", "select job_id, case when worker_id='w7' then 'w8' else worker_id end as worker_id from execution_claims")
def reclaim(c):
    return K.reclaimed(c.execution_claims, "w7", "w8").select("job_id", "worker_id")


STEPS = "(select job_id, attempt-1+(case when attempt=4 then 1 else 0 end) as seq, case when attempt=3 then error else concat(error, cast(attempt as varchar)) end as step_key, length(error)*attempt as result_len, attempt from job_errors)"


@query(
    "r27_step_commit",
    f"""select job_id, seq, case when again>1 or place<>seq then 'diverged' when result_len>40 then 'step too large' when total>100 then 'job too large' when place>=5 then 'too many steps' else 'committed' end as verdict
        from (select *, row_number() over (partition by job_id order by seq)-1 as place, sum(result_len) over (partition by job_id order by seq rows between unbounded preceding and current row) as total,
          row_number() over (partition by job_id, step_key order by seq) as again from {STEPS})""",
)
def step_commit(c):
    return K.checked_steps(steps(c), 40, 100, 5, "attempt").select("job_id", "seq", "verdict")


def steps(c):
    n = F.col("attempt")
    key = F.when(n == 3, F.col("error")).otherwise(F.concat("error", n.cast("string")))
    return c.job_errors.select("job_id", (n - 1 + F.when(n == 4, 1).otherwise(0)).alias("seq"), key.alias("step_key"), (F.length("error") * n).alias("result_len"), "attempt")


@query("r29_step_position", f"select job_id, seq, row_number() over (partition by job_id order by seq)-1 <> seq or row_number() over (partition by job_id, step_key order by seq) > 1 as diverged from {STEPS}")
def step_position(c):
    return K.checked_steps(steps(c), 1 << 30, 1 << 40, 1 << 30, "attempt").select("job_id", "seq", (F.col("verdict") == "diverged").alias("diverged"))


@query("r32_recovery", f"select id, 'timeout' as reason from jobs where status=1 and started_at+timeout_ms < {NOW_JOBS} union all select k.job_id, 'orphan' from execution_claims k join jobs j on j.id=k.job_id and j.status=1 where k.worker_id not in (select worker_id from workers where last_heartbeat >= {NOW_JOBS - 30000})")
def recovery(c):
    from opsloom.operators.joins import orphaned

    stale = L.stale_running(c.jobs, NOW_JOBS).select("id", F.lit("timeout").alias("reason"))
    lost = orphaned(c.execution_claims, L.live_workers(c.workers, NOW_JOBS - 30_000), c.jobs).select(F.col("job_id").alias("id"), F.lit("orphan").alias("reason"))
    return stale.unionByName(lost)


@query("upsert_latest", "select job_id, message, logged_at from (select job_id, message, logged_at, row_number() over (partition by job_id order by logged_at desc, id desc) as r from task_logs) where r=1")
def upsert_latest(c):
    return K.latest(c.task_logs.select("job_id", "message", "logged_at", "id"), ["job_id"], ["logged_at", "id"]).select("job_id", "message", "logged_at")


@query("d17_retry_filters", "select id, regexp_extract(error, '^([A-Za-z_]+)', 1) in ('ValueError') as should_retry from dead_letter")
def retry_filters(c):
    from opsloom.functions.exprs import exception_class

    return c.dead_letter.select("id", K.retry_filter(exception_class("error"), ["ValueError", "KeyError"], ["KeyError"]).alias("should_retry"))


@query("a19_purge_preview_archive", f"select count(*) filter (where {ttl('completed_at')}) as n from archived_jobs")
def purge_preview(c):
    return A.count_where(c.archived_jobs, A.expired_by("completed_at", OLD, NOW_JOBS, "result_ttl_ms"))
