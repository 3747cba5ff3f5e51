"""Registered aggregates."""

from pyspark.sql import functions as F

from opsloom.operators import listing as L
from opsloom.operators import stats as A
from opsloom.plans.registry import query
from opsloom.sources.adapters import NOW_EVENTS, NOW_JOBS

START, WIDTH = NOW_EVENTS - 30 * 86_400_000, 6 * 3_600_000
COUNTS = ", ".join(f"count(*) filter (where status={k}) as {n}" for n, k in (("pending", 0), ("running", 1), ("complete", 2), ("failed", 3), ("dead", 4), ("cancelled", 5)))
R2 = "floor(({})*100+0.5)/100"
MS = "wall_time_ns/1000000.0"
AVG = R2.format("cast(sum(wall_time_ns) as double)/count(*)/1000000")


@query("a1_status_counts", f"select {COUNTS} from jobs_all")
def status_counts(c):
    return A.status_counts(L.live_and_archived(c.jobs, c.archived_jobs))


@query("a2_queue_counts", f"select {COUNTS} from jobs_all where queue='q2'")
def queue_counts(c):
    return A.status_counts(L.live_and_archived(c.jobs, c.archived_jobs).where("queue = 'q2'"))


@query("a3_counts_by_queue", f"select queue, {COUNTS} from jobs_all group by queue")
def counts_by_queue(c):
    return A.status_counts(L.live_and_archived(c.jobs, c.archived_jobs), "queue")


@query("a4_counts_by_namespace", f"select namespace, {COUNTS} from jobs_all group by namespace")
def counts_by_namespace(c):
    return A.status_counts(c.jobs_all, "namespace")


@query("a5_running_by_task", "select count(*) as n from jobs where status=1 and task_name='task_3'")
def running_by_task(c):
    return A.count_where(c.jobs, F.expr("status = 1 and task_name = 'task_3'"))


@query("a6_pending_by_queue", "select count(*) as n from jobs where status=0 and queue='q1'")
def pending_by_queue(c):
    return A.count_where(c.jobs, F.expr("status = 0 and queue = 'q1'"))


PICK = "a[1+least(cast(floor(n*{}) as bigint), n-1)]"
BY_TASK = f"""select task_name, n, success, failure, avg_ms, {R2.format('a[1]')} as min_ms, {R2.format('a[n]')} as max_ms,
  {R2.format(PICK.format(0.5))} as p50_ms, {R2.format(PICK.format(0.95))} as p95_ms, {R2.format(PICK.format(0.99))} as p99_ms
  from (select task_name, count(*) as n, count(*) filter (where succeeded) as success, count(*) filter (where not succeeded) as failure, {AVG} as avg_ms,
    list_sort(list(cast(wall_time_ns as double)/1000000)) as a from task_metrics group by task_name)"""


@query("a7_metrics_by_task", BY_TASK)
def metrics_by_task(c):
    return A.metrics_by_task(c.task_metrics)


@query(
    "a8_percentiles",
    f"select job_id, {PICK.format(0.5)} as p50, {PICK.format(0.9)} as p90 from (select job_id, count(*) as n, list_sort(list(wall_time_ns)) as a from task_metrics group by job_id)",
)
def percentiles(c):
    from opsloom.functions.exprs import index_percentiles

    return index_percentiles(c.task_metrics, ["job_id"], "wall_time_ns", {"p50": 0.5, "p90": 0.9})


@query("a9_metrics_of_namespace", BY_TASK.replace("from task_metrics", "from task_metrics where namespace='ns1'"))
def metrics_of_namespace(c):
    return A.metrics_by_task(c.task_metrics.where("namespace = 'ns1'"))


SERIES = f"""select cast(floor((recorded_at-{START})/{WIDTH}.0)*{WIDTH}+{START} as bigint) as bucket, count(*) as n, count(*) filter (where succeeded) as success,
  count(*) filter (where not succeeded) as failure, {AVG} as avg_ms from task_metrics where recorded_at >= {START} group by 1"""


@query("a10_metric_series", SERIES)
def metric_series(c):
    return A.metric_series(c.task_metrics, START, WIDTH)


@query("a11_task_series", SERIES.replace("where recorded_at", "where task_name='view' and recorded_at"))
def task_series(c):
    return A.metric_series(c.task_metrics.where("task_name = 'view'"), START, WIDTH)


BACKLOG = f"""select s.topic, s.subscription_name, coalesce(l.pending, 0) as pending, coalesce(l.running, 0) as running, coalesce(d.dead, 0) as dead, {NOW_JOBS} - l.oldest as oldest_age_ms
  from topic_subscriptions s left join (select queue, task_name, count(*) filter (where status=0) as pending, count(*) filter (where status=1) as running,
    min(case when status=0 then created_at end) as oldest from jobs group by 1, 2) l on l.queue=s.queue and l.task_name=s.task_name
  left join (select queue, task_name, count(*) as dead from dead_letter group by 1, 2) d on d.queue=s.queue and d.task_name=s.task_name"""


@query("a12_topic_backlog", BACKLOG)
def topic_backlog(c):
    return A.topic_backlog(c.jobs, c.dead_letter, c.topic_subscriptions, NOW_JOBS)


@query("j9_backlog_merge", BACKLOG)
def backlog_merge(c):
    return A.topic_backlog(c.jobs, c.dead_letter, c.topic_subscriptions, NOW_JOBS)


@query(
    "a13_log_lag",
    f"""select s.topic, s.subscription_name, count(m.id) as lag, {NOW_EVENTS} - min(m.created_at) as oldest_age_ms from topic_subscriptions s
        left join topic_messages m on m.topic=s.topic and (s.cursor is null or m.id > s.cursor) where s.mode='log' group by 1, 2""",
)
def log_lag(c):
    return A.log_lag(c.topic_messages, c.topic_subscriptions, NOW_EVENTS)


ROLLUP = f"select topic, count(*) as subscriptions, cast(sum(pending+running) as bigint) as in_flight, cast(sum(dead) as bigint) as dead from ({BACKLOG}) group by topic"


@query("a14_topic_rollup", ROLLUP)
def topic_rollup(c):
    return A.topic_rollup(topic_backlog(c))


@query("a15_topic_totals", f"select count(*) as topics, cast(sum(subscriptions) as bigint) as subscriptions, cast(sum(in_flight) as bigint) as in_flight, cast(sum(dead) as bigint) as dead from ({ROLLUP})")
def topic_totals(c):
    return A.grand_totals(A.topic_rollup(topic_backlog(c)))


@query("a16_cursor_floor", "select topic, case when count(cursor)=count(*) then min(cursor) end as floor from topic_subscriptions where mode='log' group by topic")
def cursor_floor(c):
    return A.cursor_floor(c.topic_subscriptions)


ACKED = """select a.topic, a.message_id as id from (select topic, message_id, count(distinct subscription_name) as acks from topic_deliveries where acked group by 1, 2) a
  join (select topic, count(distinct subscription_name) as subs from topic_deliveries group by 1) s on s.topic=a.topic and s.subs=a.acks
  where a.topic not in (select t.topic from topic_subscriptions t where t.mode='log' and not exists (select 1 from topic_deliveries d where d.topic=t.topic and d.subscription_name=t.subscription_name))"""


@query("a17_acked_by_all", ACKED)
def acked_by_all(c):
    return A.acked_by_all(c.topic_deliveries, c.topic_subscriptions)


@query(
    "u3_purgeable_messages",
    f"""select topic, id from topic_messages where expires_at <= {NOW_EVENTS} union
        select m.topic, m.id from topic_messages m join (select topic, case when count(cursor)=count(*) then min(cursor) end as floor from topic_subscriptions where mode='log' group by topic) f
          on f.topic=m.topic and m.id <= f.floor union {ACKED}""",
)
def purgeable_messages(c):
    from opsloom.operators.joins import purgeable_messages as purgeable

    return purgeable(c.topic_messages, A.cursor_floor(c.topic_subscriptions), acked_by_all(c), NOW_EVENTS)


FLOOR = "(select topic, case when count(cursor)=count(*) then min(cursor) end as floor from topic_subscriptions where mode='log' group by topic)"


@query(
    "r23_log_compaction",
    f"""select id, topic, created_at from topic_messages where (topic, id) not in (select (topic, id) from (
          select topic, id, min(stage) as stage from (select topic, id, 0 as stage from topic_messages where expires_at <= {NOW_EVENTS}
            union all select m.topic, m.id, 1 from topic_messages m join {FLOOR} f on f.topic=m.topic and m.id <= f.floor
            union all select topic, id, 2 from ({ACKED})) group by 1, 2 order by stage, topic, id limit 3500))""",
)
def log_compaction(c):
    from opsloom.operators.joins import compacted

    return compacted(c.topic_messages, A.cursor_floor(c.topic_subscriptions), acked_by_all(c), NOW_EVENTS, 3500).select("id", "topic", "created_at")


@query("a18_step_totals", "select job_id, count(*) as steps, coalesce(cast(sum(length(error)) as bigint), 0) as bytes from job_errors group by job_id")
def step_totals(c):
    return c.job_errors.groupBy("job_id").agg(F.count(F.lit(1)).alias("steps"), F.coalesce(F.sum(F.octet_length("error")), F.lit(0)).cast("long").alias("bytes"))


CUTOFFS = {"archived_jobs": 788918400000, "dead_letter": 788918400000, "task_logs": NOW_EVENTS - 10 * 86_400_000, "task_metrics": None, "job_errors": 788918400000}
RETENTION = f"""select 'archived_jobs' as table_name, count(*) filter (where (result_ttl_ms is null and completed_at < 788918400000) or completed_at+result_ttl_ms < {NOW_JOBS}) as n from archived_jobs
  union all select 'dead_letter', count(*) filter (where (result_ttl_ms is null and failed_at < 788918400000) or failed_at+result_ttl_ms < {NOW_JOBS}) from dead_letter
  union all select 'task_logs', count(*) filter (where logged_at < {CUTOFFS['task_logs']}) from task_logs
  union all select 'task_metrics', cast(0 as bigint)
  union all select 'job_errors', count(*) filter (where failed_at < 788918400000) from job_errors"""


@query("a19_retention_preview", RETENTION)
def retention_preview(c):
    return A.retention_counts(c.archived_jobs, c.dead_letter, c.task_logs, c.task_metrics, c.job_errors, CUTOFFS, NOW_JOBS)


@query("a20_retention_total", f"select cast(sum(n) as bigint) as n from ({RETENTION})")
def retention_total(c):
    return retention_preview(c).agg(F.sum("n").alias("n"))


DEAD_REASON = "case when instr(error, ':') > 0 then trim(substr(error, instr(error, ':')+1)) else error end"


@query(
    "a21_dead_groups",
    f"""select task_name, exception, count(*) as n, max(failed_at) as last_failed_at, array_to_string(list_sort(list(distinct queue)), ',') as queues, array_to_string(list_sort(list(distinct reason)), '|') as reasons
       from (select task_name, queue, failed_at, regexp_extract(error, '^([A-Za-z_]+)', 1) as exception, {DEAD_REASON} as reason from dead_letter) group by 1, 2""",
)
def dead_groups(c):
    return A.dead_groups(c.dead_letter)


@query(
    "a23_scaler",
    f"""select cast(sum(pending) as bigint) as pending, floor(sum(running)/500.0*1000+0.5)/1000 as utilization, array_to_string(list_sort(list(concat(queue, '=', cast(pending as varchar)))), ',') as per_queue
       from (select queue, count(*) filter (where status=0) as pending, count(*) filter (where status=1) as running from jobs group by queue)""",
)
def scaler(c):
    return A.scaler_payload(c.jobs, 500)


# Four threads a worker; from no workers to 60, so that every rule decides somewhere.
LOADS = "(select queue, priority, retry_count, cast(count(*) filter (where status=0) as bigint) as pending, cast(count(*) filter (where status=1)*(1+priority) as bigint) as running, cast((priority*retry_count*5) as bigint) as w from jobs group by 1, 2, 3)"


@query(
    "a24_desired_workers",
    f"""select queue, priority, retry_count, case when w>0 and not over and abs(d-w)/w < 0.1 then w else d end as desired from (
          select *, cast(greatest(least(greatest(depth, util, 2, case when over then w+1 else 0 end), 40), 2) as bigint) as d from (
            select *, ceil(pending/8.0) as depth, case when w>0 and running>0 then ceil(w*(cast(running as double)/greatest(1, w*4)/0.8)) else 0 end as util, w>0 and running > greatest(1, w*4) as over from {LOADS}))""",
)
def desired_workers(c):
    load = c.jobs.groupBy("queue", "priority", "retry_count").agg(
        F.count_if(F.col("status") == 0).alias("pending"), (F.count_if(F.col("status") == 1) * (1 + F.col("priority"))).alias("running"), (F.col("priority") * F.col("retry_count") * 5).cast("long").alias("current_workers")
    )
    return A.desired_workers(load, 8, 0.8, 2, 40, threads=4).select("queue", "priority", "retry_count", "desired")


@query("a25_executor_utilization", "select coalesce(cast(sum(greatest(threads-2, 0)) as double)/nullif(sum(threads), 0), 0.0) as utilization from workers")
def executor_utilization(c):
    return A.executor_utilization(c.workers.withColumn("free", F.lit(2)), "threads", "free")


@query(
    "a26_divergent_fingerprints",
    """with f as (select registry_fingerprint, count(*) as n from workers where registry_fingerprint is not null group by 1), m as (select max(n) as top, count(*) as kinds from f)
       select registry_fingerprint, n from f, m where kinds > 1 and (n < top or (select count(*) from f, m where n = top) > 1)""",
)
def divergent_fingerprints(c):
    return A.divergent_fingerprints(c.workers)


@query("a27_cluster_info", "select count(*) as peers, cast(sum(threads) as bigint) as capacity, cast(sum(threads%3) as bigint) as load, cast(sum(threads*2) as bigint) as buffered from workers")
def cluster_info(c):
    return A.cluster_info(c.workers.withColumn("load", F.col("threads") % 3).withColumn("buffered", F.col("threads") * 2))


LIVE = f"(last_heartbeat >= {NOW_JOBS - 30_000})"


@query(
    "a28_prefetch",
    f"""select worker_id, case when peers=0 then b else cast(least(greatest(ceil(cast(b as double)*(cast(b as double)/(cast(total as double)+b))*2.0), 1), b) as bigint) end as prefetch from (
          select worker_id, cast(threads*20 as bigint) as b, (select sum(threads) from workers where {LIVE}) - case when {LIVE} then threads else 0 end as total,
            (select count(*) from workers where {LIVE}) - case when {LIVE} then 1 else 0 end as peers from workers)""",
)
def prefetch(c):
    workers = c.workers.withColumn("buffer", F.col("threads") * 20)
    return A.adaptive_prefetch(workers, F.col("last_heartbeat") >= NOW_JOBS - 30_000).select("worker_id", "prefetch")


DONE = "bool_and(status in ('completed','failed','skipped','cancelled','cache_hit'))"


@query("a29_run_states", f"select run_id, case when {DONE} then case when bool_or(status='failed') then 'failed' else 'completed' end end as final_state from workflow_nodes group by run_id")
def run_states(c):
    return A.final_states(c.workflow_nodes)


@query("a30_fan_out_done", f"select run_id, {DONE} as all_terminal, bool_and(status in ('completed','cache_hit')) as all_succeeded from workflow_nodes group by run_id")
def fan_out_done(c):
    return A.fan_out_done(c.workflow_nodes)


@query(
    "a31_run_context",
    """select run_id, count(*) filter (where status='completed') as success_count, count(*) filter (where status='failed') as failure_count,
       array_to_string(list_sort(list(concat(node_name, '=', status))), ',') as states from workflow_nodes group by run_id""",
)
def run_context(c):
    return A.run_context(c.workflow_nodes)


@query("a32_throughput", f"select cast(sum(n) as bigint) as total, max(n) as peak from ({SERIES})")
def throughput(c):
    return A.throughput(metric_series(c))


@query(
    "a33_strategy_counts",
    f"""select count(*) as total_intercepts, {R2.format('sum(value)')} as total_duration_ms, {R2.format('sum(value)/count(*)')} as avg_duration_ms, max(cast(user_id%9 as bigint)) as max_depth,
        cast(sum(user_id%4) as bigint) as n_pass, count(*) filter (where event_type='click') as n_convert, count(*) filter (where event_type='purchase') as n_proxy, cast(0 as bigint) as n_redirect,
        count(*) filter (where event_type='error') as n_reject from events""",
)
def strategy_counts(c):
    marks = {"convert": "click", "proxy": "purchase", "reject": "error"}
    passes = c.events.select(
        F.col("value").alias("duration_ms"), (F.col("user_id") % 9).alias("depth"), (F.col("user_id") % 4).alias("pass"), F.lit(0).alias("redirect"),
        *[(F.col("event_type") == kind).cast("int").alias(name) for name, kind in marks.items()],
    )
    return A.interception_stats(passes)


KINDS = "case event_type when 'error' then 'error' when 'signup' then 'cleanup_error' when 'purchase' then 'checksum_failure' else 'reconstruction' end"


@query(
    "a34_reconstruction_stats",
    f"""select handler, n as reconstructions, errors, cleanup_errors, checksum_failures, {R2.format('coalesce(total, 0.0)')} as total_ms, {R2.format('coalesce(total/n, 0.0)')} as avg_ms, {R2.format('coalesce(a[n], 0.0)')} as max_ms,
        {R2.format('coalesce(a[1+least(cast(floor(n*0.95) as bigint), n-1)], 0.0)')} as p95_ms from (
          select handler, count(*) filter (where kind='reconstruction') as n, count(*) filter (where kind='error') as errors, count(*) filter (where kind='cleanup_error') as cleanup_errors,
            count(*) filter (where kind='checksum_failure') as checksum_failures, sum(value) filter (where kind='reconstruction') as total, list_sort(list(value) filter (where kind='reconstruction')) as a
          from (select concat('h', cast(user_id%7 as varchar)) as handler, {KINDS} as kind, value from events where user_id%7<>3 or event_type in ('error', 'signup')) group by handler)""",
)
def reconstruction_stats(c):
    rows = c.events.where("user_id % 7 <> 3 or event_type in ('error', 'signup')")
    rows = rows.select(F.concat(F.lit("h"), (F.col("user_id") % 7).cast("string")).alias("handler"), F.expr(KINDS).alias("kind"), F.col("value").alias("duration_ms"))
    return A.reconstruction_stats(rows)
