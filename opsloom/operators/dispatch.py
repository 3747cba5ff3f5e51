"""Which jobs a scheduler would hand out: ranks, budgets, caps and gates, as decisions over a snapshot."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.exprs import in_namespace_dispatch, whole
from opsloom.operators.joins import dispatchable
from opsloom.sources.shared import cut


def order_of(kind: str) -> list:
    """FIFO: by priority, then oldest first; LIFO: newest first."""
    if kind == "fifo":
        return [F.col("priority").desc(), F.col("scheduled_at").asc(), F.col("id").asc()]
    return [F.col("priority").desc(), F.col("scheduled_at").desc(), F.col("id").desc()]


def dispatch_rank(jobs: DataFrame, kind: str = "fifo") -> DataFrame:
    return jobs.withColumn("rank", F.row_number().over(Window.partitionBy("queue").orderBy(*order_of(kind))).cast("long"))


def full_rank(jobs: DataFrame, kind: str = "fifo") -> DataFrame:
    """dispatch_rank of all jobs, where a few queues hold them all: rows are dealt to ranges of queue and order, a task ranks
    within its range, and the ranges before it say where a queue's range begins."""
    order = order_of(kind)
    dealt = cut(jobs.repartitionByRange("queue", *order).withColumn("_part", F.spark_partition_id()))
    before = F.sum("_n").over(Window.partitionBy("queue").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = dealt.groupBy("queue", "_part").agg(F.count(F.lit(1)).alias("_n")).select("queue", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("queue", "_part").orderBy(*order))
    return dealt.withColumn("_place", place).join(sizes, ["queue", "_part"]).withColumn("rank", (F.col("_before") + F.col("_place")).cast("long")).drop("_before", "_place", "_part")


def score_rank(jobs: DataFrame) -> DataFrame:
    """The rank as one number, as a sorted-set store keeps it; priorities are clamped to 0..999."""
    priority = F.least(F.greatest(F.col("priority"), F.lit(0)), F.lit(999))
    return jobs.withColumn("score", (F.lit(1000) - priority).cast("double") * F.lit(1e13) + F.col("scheduled_at").cast("double"))


def candidates(jobs: DataFrame, edges, live, archived, now: int, namespace: str | None) -> DataFrame:
    """Pending jobs whose time has come, that haven't expired and wait for nothing."""
    due = jobs.where((F.col("status") == 0) & (F.col("scheduled_at") <= now) & in_namespace_dispatch(namespace))
    fresh = due.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))
    return dispatchable(fresh, edges, live, archived)


def fill_budget(jobs: DataFrame, queues: list[str], most: int, kind: str = "fifo") -> DataFrame:
    """Queues in their order, each taking what the ones before it have left of the budget. Each queue's own first `most`
    jobs are found first, so the last ranking sees no more than that of each queue."""
    place = F.array_position(F.array(*map(F.lit, queues)), F.col("queue"))
    own = dispatch_rank(jobs.where(F.col("queue").isin(queues)), kind).where(F.col("rank") <= most).withColumn("_place", place)
    return own.orderBy("_place", "rank").limit(most).drop("_place", "rank")


def claim(jobs: DataFrame, queue: str, n: int, kind: str = "fifo") -> DataFrame:
    return jobs.where(F.col("queue") == queue).orderBy(*order_of(kind)).limit(n)


def first_hit(jobs: DataFrame, queues: list[str], kind: str = "fifo") -> DataFrame:
    """The first claimable job of the first queue that has one."""
    return fill_budget(jobs, queues, 1, kind)


def within_cap(jobs: DataFrame, running: DataFrame, by: str, cap: int) -> DataFrame:
    """The first jobs of each task or queue that its cap admits beside those that are running."""
    busy = running.where("status = 1").groupBy(by).agg(F.count(F.lit(1)).alias("_running"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order_of("fifo")))
    # No key gets more than its cap, so the ranking keeps no more of a key's rows than that.
    rows = jobs.withColumn("_place", place).where(F.col("_place") <= cap).join(busy, by, "left")
    return rows.where(F.coalesce("_running", F.lit(0)) + F.col("_place") <= cap).drop("_place", "_running")


def affinity_order(jobs: DataFrame, owned: str, position: str, free: int) -> DataFrame:
    """The first `free` jobs, those of other owners first, in their old order otherwise."""
    kept = jobs.orderBy(position).limit(free)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col(owned), position)).cast("long"))


def smoothed(df: DataFrame, key: str, at: str, desired: str, current: str, up_ms: int, down_ms: int) -> DataFrame:
    """The workers that a tick settles on: the least wish for more of the last `up_ms`, where it wishes for more; the greatest
    wish for fewer of the last `down_ms`, where it wishes for fewer; else what there is."""
    more, fewer = F.col(desired) > F.col(current), F.col(desired) < F.col(current)
    own = Window.partitionBy(key).orderBy(at)
    up = F.min(F.when(more, F.col(desired))).over(own.rangeBetween(-up_ms, 0))
    down = F.max(F.when(fewer, F.col(desired))).over(own.rangeBetween(-down_ms, 0))
    return df.withColumn("smoothed", F.when(more, up).when(fewer, down).otherwise(F.col(current)))


def trend(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Change against the row before in whole percent: direction and label; `new`, which is up, where there was nothing. The
    first row has none."""
    was = F.lag(value).over(Window.partitionBy(key).orderBy(at))
    pct = whole((F.col(value) - was) / was * 100)
    direction = F.when(was.isNull() | F.col(value).isNull(), F.lit(None).cast("string"))
    direction = direction.when((was == 0) & (F.col(value) != 0), "up").when((was == 0) | (pct == 0), "flat").when(pct > 0, "up").otherwise("down")
    label = F.when(direction.isNull(), F.lit(None).cast("string")).when(direction == "flat", "0%").when(was == 0, "new")
    label = label.otherwise(F.concat(F.when(pct > 0, "+").otherwise(""), pct.cast("string"), F.lit("%")))
    return df.withColumn("direction", direction).withColumn("label", label)


def normalized(df: DataFrame, key: str, value: str) -> DataFrame:
    most = F.max(value).over(Window.partitionBy(key))
    return df.withColumn("share", F.when(most != 0, F.col(value) / most).otherwise(0.0))


def gate(df: DataFrame) -> DataFrame:
    """Queue rate, breaker, task rate, in this order: the first that refuses decides. A shed key drops, others defer."""
    verdict = (
        F.when(~F.col("queue_rate_ok"), F.when(F.col("shed_on_limit"), "shed").otherwise("defer"))
        .when(~F.col("breaker_ok"), "defer")
        .when(~F.col("task_rate_ok"), F.when(F.col("shed_on_limit"), "shed").otherwise("defer"))
        .otherwise("pass")
    )
    reason = F.when(~F.col("queue_rate_ok"), "queue_rate").when(~F.col("breaker_ok"), "breaker").when(~F.col("task_rate_ok"), "task_rate")
    return df.withColumn("decision", verdict).withColumn("reason", reason)
