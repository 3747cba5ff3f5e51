"""Registered joins."""

from pyspark.sql import functions as F

from opsloom.operators import joins as J
from opsloom.operators import listing as L
from opsloom.plans.registry import query
from opsloom.sources.adapters import NOW_EVENTS, NOW_JOBS

CUTOFF = NOW_JOBS - 30_000
RUNS = "select r.id, r.state, r.created_at, d.name as definition_name from workflow_runs r join workflow_definitions d on d.id=r.definition_id"


@query("j1_runs_definitions", f"{RUNS} where d.name='wf_asia' and r.state='failed' order by r.created_at desc, r.id desc limit 40")
def runs_definitions(c):
    return J.list_runs(c.workflow_runs, c.workflow_definitions, 40, "wf_asia", "failed").select("id", "state", "created_at", "definition_name")


@query("j2_runs_keyset", f"{RUNS} where r.created_at < 903000000000 or (r.created_at = 903000000000 and r.id < '000000000500') order by r.created_at desc, r.id desc limit 40")
def runs_keyset(c):
    return J.list_runs(c.workflow_runs, c.workflow_definitions, 40, cursor=(903000000000, "000000000500")).select("id", "state", "created_at", "definition_name")


@query(
    "j3_lease_available",
    f"""select m.id, m.created_at from topic_messages m left join topic_deliveries d on d.message_id=m.id and d.topic=m.topic and d.subscription_name='NATION_16'
        where m.topic='t1' and (d.message_id is null or (not d.acked and d.lease_expires_at <= {NOW_EVENTS})) order by m.id limit 500""",
)
def lease_available(c):
    return J.available_messages(c.topic_messages, c.topic_deliveries, "t1", "NATION_16", NOW_EVENTS, 500).select("id", "created_at")


FREE = "status=0 and id not in (select e.job_id from job_dependencies e join jobs_all p on p.id=e.depends_on_job_id and p.status<>2)"


@query("j4_dispatchable", f"select id, queue from jobs where {FREE}")
def dispatchable(c):
    return J.dispatchable(c.jobs, c.job_dependencies, c.jobs, c.archived_jobs).select("id", "queue")


@query(
    "j5_validate_dependencies",
    """select e.job_id, e.depends_on_job_id, case when p.id is null then 'missing' when p.namespace is distinct from 'ns1' then 'namespace'
         when p.status in (0,1) then null when p.status<>2 then 'not complete' end as reason
       from job_dependencies e left join jobs_all p on p.id=e.depends_on_job_id""",
)
def validate_dependencies(c):
    return J.validate_dependencies(c.job_dependencies, c.jobs, c.archived_jobs, "ns1")


@query("j6_orphans", f"select k.job_id, k.worker_id, j.queue from execution_claims k join jobs j on j.id=k.job_id and j.status=1 where k.worker_id not in (select worker_id from workers where last_heartbeat >= {CUTOFF})")
def orphans(c):
    return J.orphaned(c.execution_claims, L.live_workers(c.workers, CUTOFF), c.jobs).select("job_id", "worker_id", "queue")


@query(
    "j7_debounce_targets",
    """select id, unique_key, namespace from (select *, row_number() over (partition by namespace, unique_key order by created_at, id) as r from jobs
       where unique_key is not null and status=0 and id not in (select job_id from execution_claims)) where r=1""",
)
def debounce_targets(c):
    return J.debounce_targets(c.jobs, c.execution_claims, "unique_key").select("id", "unique_key", "namespace")


@query(
    "j8_fan_out",
    """select m.id as message_id, s.subscription_name, s.task_name, s.queue, coalesce(s.priority, 2) as priority from topic_messages m
       join topic_subscriptions s on s.topic=m.topic and s.active and s.mode<>'log'""",
)
def fan_out(c):
    return J.fan_out(c.topic_messages, c.topic_subscriptions, 2).select("message_id", "subscription_name", "task_name", "queue", "priority")


@query("j10_dependencies_of", "select depends_on_job_id as id from job_dependencies where job_id='000000000007'")
def dependencies_of(c):
    return J.job_links(c.job_dependencies, "job_id", "depends_on_job_id", "000000000007")


@query("j11_dependents_of", "select job_id as id from job_dependencies where depends_on_job_id='000000000007'")
def dependents_of(c):
    return J.job_links(c.job_dependencies, "depends_on_job_id", "job_id", "000000000007")


EDGES = """(select run_id, node_name as src, concat('n', cast(line+1 as varchar)) as dst, line, line+1 as dline from workflow_nodes
  union all select run_id, node_name, concat('n', cast(line+2 as varchar)), line, line+2 from workflow_nodes)"""


def edges(c):
    """n{k} -> n{k+1} and n{k} -> n{k+2}, where both are nodes of the run."""
    n = c.workflow_nodes.select("run_id", F.col("node_name").alias("src"), "line")
    pairs = n.select("run_id", "src", F.explode(F.array(F.col("line") + 1, F.col("line") + 2)).alias("_d"))
    pairs = pairs.select("run_id", "src", F.concat(F.lit("n"), F.col("_d").cast("string")).alias("dst"))
    return pairs.join(c.workflow_nodes.select("run_id", F.col("node_name").alias("dst")), ["run_id", "dst"], "left_semi").select("run_id", "src", "dst")


@query(
    "j12_ready_nodes",
    f"""select n.run_id, n.node_name from workflow_nodes n where n.status='pending' and not exists (select 1 from {EDGES} e join workflow_nodes p on p.run_id=e.run_id and p.node_name=e.src
        where e.run_id=n.run_id and e.dst=n.node_name and p.status<>'completed')""",
)
def ready_nodes(c):
    return J.ready_nodes(c.workflow_nodes, edges(c)).select("run_id", "node_name")


@query("j13_child_runs", "select c.id, c.parent_run_id, p.state as parent_state from workflow_runs c join workflow_runs p on p.id=c.parent_run_id")
def child_runs(c):
    parents = c.workflow_runs.select(F.col("id").alias("parent_run_id"), F.col("state").alias("parent_state"))
    return J.child_runs(c.workflow_runs).select("id", "parent_run_id").join(parents, "parent_run_id").select("id", "parent_run_id", "parent_state")


@query("j14_claims_by_worker", f"select job_id, worker_id from execution_claims where worker_id in (select worker_id from workers where last_heartbeat >= {CUTOFF})")
def claims_by_worker(c):
    return J.claims_of(c.execution_claims, L.live_workers(c.workers, CUTOFF)).select("job_id", "worker_id")


@query(
    "j15_reap_subscriptions",
    f"""select topic, subscription_name from topic_subscriptions where owner_worker_id is not null and created_at < {NOW_JOBS - 60000}
        and owner_worker_id not in (select worker_id from workers where last_heartbeat >= {NOW_JOBS - 10000})""",
)
def reap_subscriptions(c):
    return J.reapable_subscriptions(c.topic_subscriptions, L.live_workers(c.workers, NOW_JOBS - 10_000), NOW_JOBS).select("topic", "subscription_name")


@query("j16_ring_owner")
def ring_owner(c):
    return J.ring_owner(c.jobs.select("id"), J.ring_points(c.workers.select("worker_id"), 64), "id")


@query("j17_steal_target", f"select worker_id, cast(threads*3 as int) as buffered from workers where last_heartbeat >= {CUTOFF} and worker_id <> 'w7' and threads*3 > 10 order by threads*3 desc, worker_id limit 1")
def steal_target(c):
    peers = c.workers.withColumn("buffered", F.col("threads") * 3)
    return J.steal_target(peers, "w7", 10, F.col("last_heartbeat") >= CUTOFF).select("worker_id", "buffered")


FILTERS = "(select n_name as hook, n_nationkey%4<>0 as enabled, case when n_nationkey%3=0 then null else ['error','click'] end as events, case when n_nationkey%2=0 then null else ['k1','k5'] end as tasks from nation)"


@query(
    "f41_webhook_filter",
    f"""select e.event_id, w.hook from (select event_id, event_type, concat('k', cast(user_id%20 as varchar)) as task from events) e
        join {FILTERS} w on w.enabled and (w.events is null or list_contains(w.events, e.event_type)) and (w.tasks is null or list_contains(w.tasks, e.task))""",
)
def webhook_filter(c):
    hooks = c.nation.select(
        F.col("n_name").alias("hook"),
        (F.col("n_nationkey") % 4 != 0).alias("enabled"),
        F.when(F.col("n_nationkey") % 3 != 0, F.array(F.lit("error"), F.lit("click"))).alias("events"),
        F.when(F.col("n_nationkey") % 2 != 0, F.array(F.lit("k1"), F.lit("k5"))).alias("tasks"),
    )
    rows = c.events.select("event_id", "event_type", F.concat(F.lit("k"), (F.col("user_id") % 20).cast("string")).alias("task"))
    # The hooks are the stated side: each event meets those of its type, or those that take every type.
    typed = hooks.where("enabled").select("hook", "tasks", F.explode(F.coalesce("events", F.array(F.lit("*")))).alias("_type"))
    keyed = rows.select("event_id", "task", F.explode(F.array("event_type", F.lit("*"))).alias("_type"))
    met = keyed.join(typed, "_type").where(F.col("tasks").isNull() | F.array_contains("tasks", F.col("task")))
    return met.select("event_id", "hook").distinct()


@query("f40_queue_paused", "select id, queue in ('q1','q3') as paused from jobs")
def queue_paused(c):
    state = c.jobs.select("queue", F.col("queue").isin("q1", "q3").alias("paused")).distinct()
    return c.jobs.join(state, "queue").select("id", "paused")
