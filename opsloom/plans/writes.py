"""Registered writers: the rows that a batch of requests appends."""

from pyspark.sql import functions as F

from opsloom.operators import writes as W
from opsloom.plans.registry import query
from opsloom.sources.adapters import NOW_EVENTS, NOW_JOBS

ID = "substr(sha256({}), 1, 32)"
JOIN = lambda *parts: ID.format("concat(" + ", chr(31), ".join(parts) + ")")

# Requests from runs: every third depends on a job or two that may be missing, of another namespace, or not complete.
REQUESTS = """(select concat('n', id) as id, concat('q', cast(cast(id as bigint)%4 as varchar)) as queue, case when cast(id as bigint)%4=1 then null else cast(id as bigint)%7*1000 end as delay_ms,
  case when cast(id as bigint)%5=0 then 60000 end as expires_ms, case cast(id as bigint)%6 when 0 then '{"topic":"t1","subscription":"s2"}' when 1 then '{"topic":"t1"}' when 2 then '{"topic":"t1","subscription":5}' end as notes,
  case when cast(id as bigint)%3=0 then [lpad(cast(cast(id as bigint)*7 as varchar), 12, '0'), lpad(cast(cast(id as bigint)*11 as varchar), 12, '0')] else cast([] as varchar[]) end as deps from workflow_runs)"""
REFUSED = """(select r.id from (select id, unnest(deps) as d from {}) r left join jobs_all p on p.id=r.d
  where p.id is null or p.namespace is distinct from 'ns1' or (p.status not in (0, 1) and p.status<>2))""".replace("{}", REQUESTS)


def requests(c):
    n = F.col("id").cast("long")
    notes = F.when(n % 6 == 0, '{"topic":"t1","subscription":"s2"}').when(n % 6 == 1, '{"topic":"t1"}').when(n % 6 == 2, '{"topic":"t1","subscription":5}')
    deps = F.array(*[F.lpad((n * k).cast("string"), 12, "0") for k in (7, 11)])
    return c.workflow_runs.select(
        F.concat(F.lit("n"), "id").alias("id"), F.concat(F.lit("q"), (n % 4).cast("string")).alias("queue"), F.lit("task_1").alias("task_name"), F.lit(0).alias("priority"), F.lit(3).alias("max_retries"),
        F.lit(300_000).alias("timeout_ms"), F.when(n % 4 != 1, n % 7 * 1000).alias("delay_ms"), F.when(n % 5 == 0, 60_000).alias("expires_ms"), notes.alias("notes"),
        F.when(n % 3 == 0, deps).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )


@query(
    "s7_enqueue",
    f"""select id, queue, {NOW_JOBS} + coalesce(delay_ms, 0) as scheduled_at, {NOW_JOBS} + expires_ms as expires_at, len(deps) > 0 as has_deps, case when notes like '%s2%' then 't1' end as topic,
        case when notes like '%s2%' then 's2' end as subscription_name from {REQUESTS} where id not in {REFUSED}""",
)
def enqueue(c):
    rows = W.new_jobs(requests(c), c.jobs, c.archived_jobs, NOW_JOBS, "ns1")
    return rows.select("id", "queue", "scheduled_at", "expires_at", "has_deps", "topic", "subscription_name")


@query("s7_enqueue_edges", f"select {JOIN('job_id', 'd')} as id, job_id, d as depends_on_job_id from (select id as job_id, unnest(deps) as d from {REQUESTS} where id not in {REFUSED})")
def enqueue_edges(c):
    return W.new_edges(requests(c), c.jobs, c.archived_jobs, "ns1")


@query(
    "s10_publish",
    f"""select {JOIN('topic', 'cast(event_id as varchar)')} as id, topic, payload, {NOW_EVENTS} as created_at, {NOW_EVENTS} + r.retention_ms as expires_at from (
          select event_id, concat('t', cast(user_id%6 as varchar)) as topic, props as payload from events) e
        left join (select concat('t', cast(r_regionkey as varchar)) as topic, case when r_regionkey%2=0 then (r_regionkey+1)*3600000 end as retention_ms from region) r using (topic)""",
)
def publish(c):
    rows = c.events.select(F.col("event_id").alias("key"), F.concat(F.lit("t"), (F.col("user_id") % 6).cast("string")).alias("topic"), F.col("props").alias("payload"))
    topics = c.region.select(F.concat(F.lit("t"), F.col("r_regionkey").cast("string")).alias("topic"), F.when(F.col("r_regionkey") % 2 == 0, (F.col("r_regionkey") + 1) * 3_600_000).alias("retention_ms"))
    return W.new_messages(rows, topics, NOW_EVENTS)


@query(
    "s11_record_metric",
    f"""select {JOIN('id', 'cast(retry_count as varchar)', "'metric'")} as id, task_name, id as job_id, (completed_at-started_at)*1000000 as wall_time_ns, cast(0 as bigint) as memory_bytes, status=2 as succeeded,
        {NOW_JOBS} as recorded_at, namespace from jobs_all where completed_at is not null""",
)
def record_metric(c):
    done = c.archived_jobs.where("completed_at is not null").select(
        "task_name", F.col("id").alias("job_id"), F.col("retry_count").alias("attempt"), ((F.col("completed_at") - F.col("started_at")) * 1_000_000).alias("wall_time_ns"), F.lit(None).cast("long").alias("memory_bytes"),
        (F.col("status") == 2).alias("succeeded"), "namespace",
    )
    return W.new_metrics(done, NOW_JOBS)


@query("s12_write_log", f"select {JOIN('job_id', 'cast(seq as varchar)', 'message')} as id, job_id, task_name, level, message, extra, {NOW_EVENTS} as logged_at from (select id as seq, * from task_logs)")
def write_log(c):
    lines = c.task_logs.withColumn("seq", F.col("id")).withColumn("namespace", F.lit(None).cast("string"))
    return W.new_logs(lines, NOW_EVENTS).drop("namespace")


@query("s13_record_error", f"select {JOIN('job_id', 'cast(attempt as varchar)')} as id, job_id, attempt, error, {NOW_JOBS} as failed_at from job_errors where job_id in (select id from jobs_all where namespace='ns2')")
def record_error(c):
    return W.new_errors(c.job_errors, c.jobs_all, NOW_JOBS, "ns2")


@query(
    "s14_record_replay",
    f"""select {JOIN('o', 'r')} as id, o as original_job_id, r as replay_job_id, {NOW_JOBS} as replayed_at, a.error as original_error, b.error as replay_error
        from (select original_job_id as o, lpad(cast(cast(original_job_id as bigint)+1 as varchar), 12, '0') as r from dead_letter) left join archived_jobs a on a.id=o left join archived_jobs b on b.id=r""",
)
def record_replay(c):
    pairs = c.dead_letter.select("original_job_id", F.lpad((F.col("original_job_id").cast("long") + 1).cast("string"), 12, "0").alias("replay_job_id"))
    return W.new_replays(pairs, c.archived_jobs, NOW_JOBS)


# Committed steps from attempts: the third of a job is a sleep. Requests from jobs: the third or the fourth step, some under another key.
STEPS = "(select job_id, attempt-1 as seq, concat('s', cast(attempt as varchar)) as step_key, case when attempt%3=0 then 'sleep' else 'run' end as kind, case when attempt%3=0 then failed_at end as wake_at from job_errors)"
SLEEPS = f"""(select id as job_id, cast(2+cast(id as bigint)//2%2 as int) as seq, concat('s', cast(3+cast(id as bigint)//2%2 + case when cast(id as bigint)%9=0 then 1 else 0 end as varchar)) as step_key,
  {NOW_JOBS}+cast(id as bigint) as wake_at from jobs_all)"""


@query(
    "r28_durable_sleep",
    f"""select job_id, seq, outcome, case outcome when 'already sleeping' then w when 'slept' then wake_at end as scheduled_at from (
          select q.job_id, q.seq, q.wake_at, s.wake_at as w, case when j.id is null then 'claim lost' when s.step_key=q.step_key and s.kind='sleep' and s.wake_at is not null then 'already sleeping'
            when s.step_key is not null or q.seq<>coalesce(n, 0) then 'diverged' when coalesce(n, 0)>=3 then 'limit' else 'slept' end as outcome
          from {SLEEPS} q left join {STEPS} s on s.job_id=q.job_id and s.seq=q.seq left join (select job_id, count(*) as n from {STEPS} group by 1) k on k.job_id=q.job_id
          left join jobs_all j on j.id=q.job_id and j.status in (0, 1))""",
)
def durable_sleep(c):
    n = F.col("attempt")
    steps = c.job_errors.select("job_id", (n - 1).alias("seq"), F.concat(F.lit("s"), n.cast("string")).alias("step_key"), F.when(n % 3 == 0, "sleep").otherwise("run").alias("kind"), F.when(n % 3 == 0, F.col("failed_at")).alias("wake_at"))
    i = F.col("id").cast("long")
    place = F.expr("cast(id as bigint) div 2 % 2")
    asked = c.jobs_all.select(F.col("id").alias("job_id"), (2 + place).cast("int").alias("seq"), F.concat(F.lit("s"), (3 + place + (i % 9 == 0).cast("int")).cast("string")).alias("step_key"), (F.lit(NOW_JOBS) + i).alias("wake_at"))
    held = c.jobs_all.withColumn("status", F.when(F.col("status").isin(0, 1), 1).otherwise(F.col("status")))
    return W.slept(asked, steps, held, 3)


@query("s5_older_schema", "select o_orderkey, o_orderstatus, cast(null as varchar) as o_note from orders")
def older_schema(c):
    """Files written before a column was added have nulls there; columns that were dropped aren't read."""
    return c.read("orders", "o_orderkey bigint, o_orderstatus string, o_note string")
