"""Registered rankings, dispatch decisions and windows."""

from pyspark.sql import functions as F

from opsloom.operators import dispatch as D
from opsloom.plans.aggregates import SERIES, WIDTH, metric_series
from opsloom.plans.joined import FREE
from opsloom.plans.registry import query
from opsloom.sources.adapters import NOW_JOBS

NOW = NOW_JOBS - 365 * 86_400_000
FIFO, LIFO = "priority desc, scheduled_at, id", "priority desc, scheduled_at desc, id desc"
READY = f"(select * from jobs where {FREE} and scheduled_at <= {NOW} and namespace is null and (expires_at is null or expires_at >= {NOW}))"


def ready(c):
    return D.candidates(c.jobs, c.job_dependencies, c.jobs, c.archived_jobs, NOW, None)


@query("w1_fifo_rank", f"select id, queue, row_number() over (partition by queue order by {FIFO}) as rank from jobs where status=0")
def fifo_rank(c):
    return D.full_rank(c.jobs.where("status = 0")).select("id", "queue", "rank")


@query("w2_lifo_rank", f"select id, queue, row_number() over (partition by queue order by {LIFO}) as rank from jobs where status=0")
def lifo_rank(c):
    return D.full_rank(c.jobs.where("status = 0"), "lifo").select("id", "queue", "rank")


@query("w3_score_rank", "select id, cast(1000-least(greatest(priority,0),999) as double)*10000000000000.0+cast(scheduled_at as double) as score from jobs where status=0")
def score_rank(c):
    return D.score_rank(c.jobs.where("status = 0")).select("id", "score")


PLACE = "case queue when 'q2' then 1 when 'q0' then 2 when 'q3' then 3 end"


@query("w4_budget_fill", f"select id, queue from {READY} where queue in ('q2','q0','q3') order by {PLACE}, {FIFO} limit 200")
def budget_fill(c):
    return D.fill_budget(ready(c), ["q2", "q0", "q3"], 200).select("id", "queue")


@query(
    "w5_concurrency_cap",
    f"""select id, task_name from (select *, row_number() over (partition by task_name order by {FIFO}) as r from {READY}) j
        left join (select task_name as t, count(*) as k from jobs where status=1 group by 1) b on b.t=j.task_name where coalesce(k, 0)+r <= 700""",
)
def concurrency_cap(c):
    return D.within_cap(ready(c), c.jobs, "task_name", 700).select("id", "task_name")


@query(
    "w6_smoothing",
    """select seq, case when d > c then min(case when d > c then d end) over (partition by key order by at_ms range between 1800000 preceding and current row)
         when d < c then max(case when d < c then d end) over (partition by key order by at_ms range between 7200000 preceding and current row) else c end as smoothed
       from (select seq, key, at_ms, sojourn_ms % 12 as d, cast(5 as bigint) as c from submissions)""",
)
def smoothing(c):
    ticks = c.submissions.select("seq", "key", "at_ms", (F.col("sojourn_ms") % 12).alias("desired"), F.lit(5).cast("long").alias("current"))
    return D.smoothed(ticks, "key", "at_ms", "desired", "current", 1_800_000, 7_200_000).select("seq", "smoothed")


@query(
    "w7_trend",
    f"""select bucket, case when was is null then null when was=0 and n=0 then 'flat' when was=0 then 'up' when p=0 then 'flat' when p>0 then 'up' else 'down' end as direction,
        case when was is null then null when was=0 and n=0 then '0%' when was=0 then 'new' when p=0 then '0%' when p>0 then concat('+', cast(p as varchar), '%') else concat(cast(p as varchar), '%') end as label
        from (select *, case when was<>0 then cast(floor(cast(n-was as double)/was*100+0.5) as bigint) end as p from (select bucket, n, lag(n) over (order by bucket) as was from (
          select bucket, case when bucket//{WIDTH}%5=0 then 0 else n end as n from ({SERIES}))))""",
)
def trend(c):
    quiet = F.expr(f"bucket div {WIDTH} % 5 = 0")
    series = metric_series(c).withColumn("n", F.when(quiet, 0).otherwise(F.col("n"))).withColumn("_k", F.lit(1))
    return D.trend(series, "_k", "bucket", "n").select("bucket", "direction", "label")


@query("w8_plan_stages", "select run_id, node_name, cast(floor((row_number() over (partition by run_id order by line)-1)/3.0) as bigint) as stage from workflow_nodes")
def plan_stages(c):
    from opsloom.operators.graph import stages

    return stages(c.workflow_nodes.withColumn("level", F.lit(0)), 3, "line").select("run_id", "node_name", F.col("stage"))


@query("w9_normalized", f"select bucket, n/cast(max(n) over () as double) as share from ({SERIES})")
def normalized(c):
    return D.normalized(metric_series(c).withColumn("_k", F.lit(1)), "_k", "n").select("bucket", "share")


@query("t12_first_hit", f"select id, queue from {READY} where queue in ('q2','q0','q3') order by {PLACE}, {FIFO} limit 1")
def first_hit(c):
    return D.first_hit(ready(c), ["q2", "q0", "q3"]).select("id", "queue")


@query("t13_claim_one", f"select id, queue from {READY} where queue='q1' order by {FIFO} limit 1")
def claim_one(c):
    return D.claim(ready(c), "q1", 1).select("id", "queue")


@query("t14_claim_batch", f"select id, queue from {READY} where queue='q1' order by {LIFO} limit 50")
def claim_batch(c):
    return D.claim(ready(c), "q1", 50, "lifo").select("id", "queue")


@query(
    "t15_affinity_order",
    """select id, row_number() over (order by owned, position) as place from (select id, priority % 2 = 0 as owned, row_number() over (order by id) as position from jobs where queue='q0' and status=0)
       where position <= 60""",
)
def affinity_order(c):
    rows = c.jobs.where("queue = 'q0' and status = 0").withColumn("owned", F.col("priority") % 2 == 0)
    return D.affinity_order(rows, "owned", "id", 60).select("id", "place")


@query(
    "r11_gate",
    """select id, case when not q then case when s then 'shed' else 'defer' end when not b then 'defer' when not t then case when s then 'shed' else 'defer' end else 'pass' end as decision,
       case when not q then 'queue_rate' when not b then 'breaker' when not t then 'task_rate' end as reason
       from (select id, retry_count<>1 as q, priority<>2 as b, timeout_ms>0 and priority<>4 as t, retry_count%2=1 as s from jobs)""",
)
def gate(c):
    rows = c.jobs.select("id", (F.col("retry_count") != 1).alias("queue_rate_ok"), (F.col("priority") != 2).alias("breaker_ok"), (F.col("priority") != 4).alias("task_rate_ok"), (F.col("retry_count") % 2 == 1).alias("shed_on_limit"))
    return D.gate(rows).select("id", "decision", "reason")
