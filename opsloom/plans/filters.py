"""Registered listings, filters, pages and set operations."""

from pyspark.sql import functions as F

from opsloom.functions import exprs as X
from opsloom.operators import listing as L
from opsloom.plans.registry import query
from opsloom.sources.adapters import NOW_EVENTS, NOW_JOBS

SINCE = NOW_EVENTS - 7 * 86_400_000
CUTOFF = NOW_JOBS - 30_000
CURSOR = (820454400000, "000000009000")
ROW = "id, queue, task_name, status, created_at"
ALL = f"(select {ROW}, namespace, metadata, error from jobs union all select {ROW}, namespace, metadata, error from archived_jobs)"


@query("s2_scan", "select id, queue, status, created_at from jobs_all")
def scan(c):
    return c.jobs_all.select("id", "queue", "status", "created_at")


@query("s6_get_job", f"select {ROW} from {ALL} where id='000000000007'")
def get_job(c):
    return L.get_job(c.jobs, c.archived_jobs, "000000000007").select(L.LISTED)


@query("s8_batch_insert", "select id, queue, cast(0 as int) as status from jobs union all select concat('n', id) as id, queue, cast(0 as int) as status from archived_jobs where status = 4")
def batch_insert(c):
    fresh = c.archived_jobs.where("status = 4").select(F.concat(F.lit("n"), "id").alias("id"), "queue", F.lit(0).alias("status"))
    return c.jobs.select("id", "queue", F.lit(0).alias("status")).unionByName(fresh)


@query(
    "s9_batch_dedup_router",
    """select id, unique_key from (select id, unique_key, row_number() over (partition by unique_key order by created_at, id) as r from jobs where unique_key is not null) where r = 1
       union all select id, unique_key from jobs where unique_key is null""",
)
def batch_dedup(c):
    from opsloom.operators.lifecycle import unique_active

    return unique_active(c.jobs).select("id", "unique_key")


SETTINGS = "(select concat('k', cast(n_nationkey as varchar)) as key, case when n_nationkey % 3 = 0 then null else n_name end as value from nation)"


@query("s15_settings", f"select key, value from {SETTINGS} where value is not null")
def settings(c):
    return c.nation.select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("value")).where("value is not null")


@query("s16_setting_if", f"select key, case when value is not distinct from null then 'new' else value end as value from {SETTINGS}")
def setting_if(c):
    from opsloom.operators.lifecycle import compare_and_set

    rows = c.nation.select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("value"))
    return compare_and_set(rows, "value", None, "new")


@query("f1_list_jobs", f"select {ROW} from {ALL} where queue='q1' and namespace='ns1' order by created_at desc, id desc limit 50 offset 10")
def list_jobs(c):
    return L.list_jobs(c.jobs, c.archived_jobs, 50, 10, queue="q1", namespace="ns1").select(L.LISTED)


@query(
    "f2_list_filtered",
    f"select {ROW} from {ALL} where error like '%order 1%' and metadata like '%cust%' and created_at >= 694224000000 and created_at <= 852076800000 order by created_at desc, id desc limit 100",
)
def list_filtered(c):
    return L.list_jobs(c.jobs, c.archived_jobs, 100, metadata_like="cust", error_like="order 1", created_after=694224000000, created_before=852076800000).select(L.LISTED)


@query("f3_live_scan", f"select {ROW} from jobs where status=1 order by created_at desc, id desc limit 40")
def live_scan(c):
    return L.list_jobs(c.jobs, c.archived_jobs, 40, status=1).select(L.LISTED)


@query("f4_archive_scan", f"select {ROW} from archived_jobs where status=4 order by created_at desc, id desc limit 40")
def archive_scan(c):
    return L.list_jobs(c.jobs, c.archived_jobs, 40, status=4).select(L.LISTED)


@query("f5_namespace_read", f"select {ROW} from jobs where namespace='ns2'")
def namespace_read(c):
    return c.jobs.where(X.in_namespace_read("ns2")).select(L.LISTED)


@query("f6_namespace_dispatch", f"select {ROW} from jobs where namespace is null")
def namespace_dispatch(c):
    return c.jobs.where(X.in_namespace_dispatch(None)).select(L.LISTED)


@query("f7_terminal", f"select {ROW} from jobs_all where status in (2,3,4,5)")
def terminal(c):
    return c.jobs_all.where(X.is_terminal()).select(L.LISTED)


@query(
    "f8_status_decode",
    "select distinct event_type, cast(case event_type when 'error' then 3 when 'purchase' then 2 when 'view' then 0 end as int) as code from events",
)
def status_decode(c):
    name = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "Completed").when(F.col("event_type") == "view", "pending").otherwise("nonsense")
    return c.events.select("event_type", X.status_code(name).cast("int").alias("code")).distinct()


@query("f9_metrics_scan", f"select id, task_name, recorded_at from task_metrics where recorded_at >= {SINCE} and task_name='click' and namespace='ns1'")
def metrics_scan(c):
    return L.metrics_since(c.task_metrics, SINCE, "click", "ns1").select("id", "task_name", "recorded_at")


@query("f10_logs", f"select id, job_id, logged_at from task_logs where logged_at >= {SINCE} and level='error' and task_name='task_3' order by logged_at desc, id desc limit 25")
def logs(c):
    return L.logs(c.task_logs, SINCE, 25, "task_3", "error").select("id", "job_id", "logged_at")


@query("f11_job_logs", "select id, level, logged_at from task_logs where job_id='000000000005'")
def job_logs(c):
    return L.logs_after(c.task_logs, "000000000005", None).orderBy("logged_at", "id").select("id", "level", "logged_at")


@query("f12_log_cursor", "select id, level, logged_at from task_logs where job_id='000000000005' and id > '000000002000'")
def log_cursor(c):
    return L.logs_after(c.task_logs, "000000000005", "000000002000").orderBy("id").select("id", "level", "logged_at")


@query("f13_job_errors", "select id, attempt, error from job_errors where job_id in ('000000000003','000000000033')")
def job_errors(c):
    return c.job_errors.where(F.col("job_id").isin("000000000003", "000000000033")).orderBy("job_id", "attempt").select("id", "attempt", "error")


REPLAYS = "(select concat('r', lpad(cast(l_orderkey as varchar),8,'0')) as original_job_id, l_linenumber as n, l_quantity as q from lineitem)"


@query("f14_replay_history", f"select original_job_id, n, q from {REPLAYS} where original_job_id = 'r00000007'")
def replay_history(c):
    rows = c.lineitem.select(F.concat(F.lit("r"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0")).alias("original_job_id"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"))
    return rows.where("original_job_id = 'r00000007'").orderBy(F.desc("n"))


@query("f15_dead_by_task", "select id, failed_at from dead_letter where task_name='task_2' order by failed_at desc, id desc limit 20 offset 5")
def dead_by_task(c):
    return L.page(c.dead_letter.where("task_name = 'task_2'"), "failed_at", 20, 5).select("id", "failed_at")


@query(
    "f16_dead_for_retry",
    "select id, failed_at from dead_letter where failed_at <= 852076800000 and dlq_retry_count < 3 and queue in ('q0','q1','q2') and not shed order by failed_at, id limit 60",
)
def dead_for_retry(c):
    return L.dead_for_retry(c.dead_letter, 852076800000, 3, ["q0", "q1", "q2"], 60).select("id", "failed_at")


@query("f17_shed", "select id, error from dead_letter where error like 'codel:%' or error like 'rate_limit:%'")
def shed(c):
    return L.shed_only(c.dead_letter).select("id", "error")


PERIODIC = "(select s_suppkey as id, s_suppkey % 4 <> 0 as enabled, 1000 * (s_suppkey % 50) as next_run from supplier)"


@query("f18_due_periodic", f"select id, next_run from {PERIODIC} where enabled and next_run <= 20000")
def due_periodic(c):
    rows = c.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 4 != 0).alias("enabled"), (F.col("s_suppkey") % 50 * 1000).alias("next_run"))
    return L.due_periodic(rows, 20000).select("id", "next_run")


@query("f19_stale_running", f"select id, started_at from jobs where status=1 and started_at + timeout_ms < {NOW_JOBS}")
def stale_running(c):
    return L.stale_running(c.jobs, NOW_JOBS).select("id", "started_at")


@query("f20_expired_pending", f"select id, cast(5 as int) as status, 'expired' as error from jobs where status=0 and expires_at < {NOW_JOBS}")
def expired_pending(c):
    return L.expired_pending(c.jobs, NOW_JOBS).select("id", "status", "error")


@query("f21_live_workers", f"select worker_id from workers where last_heartbeat >= {CUTOFF}")
def live_workers(c):
    return L.live_workers(c.workers, CUTOFF).select("worker_id")


@query("f22_dead_workers", f"select worker_id from workers where last_heartbeat < {CUTOFF}")
def dead_workers(c):
    return L.dead_workers(c.workers, CUTOFF).select("worker_id")


@query("f23_stale_flag", f"select worker_id, last_heartbeat < {CUTOFF} as stale from workers")
def stale_flag(c):
    return c.workers.select("worker_id", (F.col("last_heartbeat") < CUTOFF).alias("stale"))


QUEUE_STATE = "(select distinct queue, queue in ('q1','q3') as paused from jobs)"


def queue_state(c):
    return c.jobs.select("queue", F.col("queue").isin("q1", "q3").alias("paused")).distinct()


@query("f24_paused_queues", f"select queue from {QUEUE_STATE} where paused")
def paused(c):
    return queue_state(c).where("paused").select("queue")


@query("f25_active_queues", f"select queue from {QUEUE_STATE} where not paused")
def active_queues(c):
    return L.active_queues(c.jobs.select("queue").distinct(), queue_state(c))


@query("f26_active_subscriptions", "select subscription_name, created_at from topic_subscriptions where active and topic='t1'")
def active_subscriptions(c):
    return L.active_subscriptions(c.topic_subscriptions, "t1").select("subscription_name", "created_at")


@query("f27_node_prefix", "select run_id, node_name, status from workflow_nodes where run_id='000000000007' and node_name like 'n%'")
def node_prefix(c):
    return L.nodes_by_prefix(c.workflow_nodes, "000000000007", "n").select("run_id", "node_name", "status")


@query("t1_offset_page", f"select {ROW} from {ALL} order by created_at desc, id desc limit 30 offset 70")
def offset_page(c):
    return L.list_jobs(c.jobs, c.archived_jobs, 30, 70).select(L.LISTED)


AFTER = f"(created_at < {CURSOR[0]} or (created_at = {CURSOR[0]} and id < '{CURSOR[1]}'))"


@query("t2_keyset_jobs", f"select {ROW} from {ALL} where {AFTER} order by created_at desc, id desc limit 50")
def keyset_jobs(c):
    return L.list_jobs_after(c.jobs, c.archived_jobs, 50, CURSOR).select(L.LISTED)


@query("t3_keyset_live", f"select {ROW} from jobs where status=0 and {AFTER} order by created_at desc, id desc limit 50")
def keyset_live(c):
    return L.list_jobs_after(c.jobs, c.archived_jobs, 50, CURSOR, status=0).select(L.LISTED)


@query("t4_keyset_archive", f"select {ROW} from archived_jobs where status=2 and {AFTER} order by created_at desc, id desc limit 50")
def keyset_archive(c):
    return L.list_jobs_after(c.jobs, c.archived_jobs, 50, CURSOR, status=2).select(L.LISTED)


@query("t5_keyset_completed", f"select id, completed_at from archived_jobs where completed_at < {CURSOR[0]} or (completed_at = {CURSOR[0]} and id < '{CURSOR[1]}') order by completed_at desc, id desc limit 50")
def keyset_completed(c):
    return L.page_after(c.archived_jobs, "completed_at", 50, CURSOR).select("id", "completed_at")


@query("t6_keyset_dead", f"select id, failed_at from dead_letter where failed_at < {CURSOR[0]} or (failed_at = {CURSOR[0]} and id < 'd9') order by failed_at desc, id desc limit 50")
def keyset_dead(c):
    return L.page_after(c.dead_letter, "failed_at", 50, (CURSOR[0], "d9")).select("id", "failed_at")


@query("t7_cursor_codec", "select id, concat(cast(failed_at as varchar), ':', id) as cursor, failed_at as key, id as back from dead_letter")
def cursor_codec(c):
    rows = c.dead_letter.select("id", X.encode_cursor("failed_at", "id").alias("cursor"))
    return rows.select("id", "cursor", X.decode_cursor("cursor")["key"].alias("key"), X.decode_cursor("cursor")["id"].alias("back"))


@query(
    "t8_next_page",
    """with p as (select id, failed_at from dead_letter order by failed_at desc, id desc limit 40), l as (select failed_at, id from p order by failed_at, id limit 1)
       select case when (select count(*) from p) < 40 then null else concat(cast(l.failed_at as varchar), ':', l.id) end as next_cursor from l""",
)
def next_page(c):
    return L.next_cursor(L.page(c.dead_letter, "failed_at", 40), "failed_at", 40)


@query("t9_list_archived", "select id, completed_at from archived_jobs order by completed_at desc, id desc limit 25 offset 25")
def list_archived(c):
    return L.page(c.archived_jobs, "completed_at", 25, 25).select("id", "completed_at")


@query("t10_list_dead", "select id, failed_at from dead_letter order by failed_at desc, id desc limit 25 offset 25")
def list_dead(c):
    return L.page(c.dead_letter, "failed_at", 25, 25).select("id", "failed_at")


@query(
    "t11_read_log",
    """select m.id, m.created_at from topic_messages m join topic_subscriptions s on s.topic=m.topic
       where s.topic='t2' and s.subscription_name='NATION_2' and s.mode='log' and (s.cursor is null or m.id > s.cursor) order by m.id limit 30""",
)
def read_log(c):
    return L.read_log(c.topic_messages, c.topic_subscriptions, "t2", "NATION_2", 30).select("id", "created_at")


@query("u1_union_all", f"select {ROW} from {ALL}")
def union_all(c):
    return L.live_and_archived(c.jobs, c.archived_jobs).select(L.LISTED)


@query("u2_distinct_pairs", "select distinct topic, subscription_name from topic_deliveries")
def distinct_pairs(c):
    return c.topic_deliveries.select("topic", "subscription_name").distinct()


@query("u4_cursor_only_subscriptions", "select topic, subscription_name from topic_subscriptions where mode='log' except select topic, subscription_name from topic_deliveries where not acked and attempts=3 and message_id < '000000000020'")
def cursor_only(c):
    return c.topic_subscriptions.where("mode = 'log'").select("topic", "subscription_name").join(c.topic_deliveries.where("not acked and attempts = 3 and message_id < '000000000020'"), ["topic", "subscription_name"], "left_anti")


@query("u5_list_topics", "select distinct topic from topic_subscriptions")
def list_topics(c):
    return c.topic_subscriptions.select("topic").distinct().orderBy("topic")
