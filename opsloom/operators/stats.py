"""Aggregates over jobs, metrics, topics, workers and retention."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.exprs import STATUS, bucket, error_reason, exception_class, index_percentiles, round2

NS_PER_MS = 1_000_000


def status_counts(jobs: DataFrame, *by: str) -> DataFrame:
    """The number of jobs in each of the six statuses; codes that aren't known count nowhere."""
    counts = [F.count_if(F.col("status") == code).alias(name) for name, code in STATUS.items()]
    return jobs.groupBy(*by).agg(*counts)


def count_where(df: DataFrame, condition: Column, name: str = "n") -> DataFrame:
    return df.agg(F.count_if(condition).alias(name))


def metrics_by_task(metrics: DataFrame) -> DataFrame:
    """Count, outcomes, and wall time in ms of each task: mean, index percentiles, extremes."""
    ms = metrics.withColumn("_ms", F.col("wall_time_ns") / NS_PER_MS)
    base = ms.groupBy("task_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("succeeded").alias("success"), F.count_if(~F.col("succeeded")).alias("failure"),
        round2(F.sum("wall_time_ns") / F.count(F.lit(1)) / NS_PER_MS).alias("avg_ms"), round2(F.min("_ms")).alias("min_ms"), round2(F.max("_ms")).alias("max_ms"),
    )
    ranks = index_percentiles(ms, ["task_name"], "_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    return base.join(ranks.select("task_name", *[round2(F.col(c)).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms")]), "task_name")


def metric_series(metrics: DataFrame, start: int, width: int) -> DataFrame:
    """Buckets of metrics, anchored at `start`."""
    return (
        metrics.where(F.col("recorded_at") >= start)
        .groupBy(bucket("recorded_at", start, width).alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.count_if("succeeded").alias("success"), F.count_if(~F.col("succeeded")).alias("failure"),
            round2(F.sum("wall_time_ns") / F.count(F.lit(1)) / NS_PER_MS).alias("avg_ms"),
        )
    )


def topic_backlog(jobs: DataFrame, dead: DataFrame, subscriptions: DataFrame, now: int) -> DataFrame:
    """Pending, running and dead deliveries of each subscription, and the age of the oldest pending one. Deliveries are
    jobs of the subscription's task on its queue."""
    key = ["queue", "task_name"]
    live = jobs.groupBy(*key).agg(
        F.count_if(F.col("status") == 0).alias("pending"), F.count_if(F.col("status") == 1).alias("running"),
        F.min(F.when(F.col("status") == 0, F.col("created_at"))).alias("oldest"),
    )
    gone = dead.groupBy(*key).agg(F.count(F.lit(1)).alias("dead"))
    rows = subscriptions.join(live, key, "left").join(gone, key, "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("pending", "running", "dead")]
    return rows.select("topic", "subscription_name", *zero, (F.lit(now) - F.col("oldest")).alias("oldest_age_ms"))


def log_lag(messages: DataFrame, subscriptions: DataFrame, now: int) -> DataFrame:
    """Messages after each log subscription's cursor, all of them without one, and the age of the oldest.

    A topic's cursors cut its messages into intervals. Each message is counted in its interval, before any shuffle, and a
    subscription sums the intervals behind its cursor: no message meets more than its topic's list of cursors."""
    subs = subscriptions.where("mode = 'log'").select("topic", "subscription_name", "cursor")
    cuts = subs.groupBy("topic").agg(F.array_sort(F.collect_set("cursor")).alias("_cuts"))
    place = F.size(F.filter("_cuts", lambda x: x < F.col("id")))
    counted = messages.select("topic", "id", "created_at").join(cuts, "topic")
    counted = counted.groupBy("topic", place.alias("_place")).agg(F.count(F.lit(1)).alias("_n"), F.min("created_at").alias("_oldest"))
    # A cursor has passed the intervals up to its place in the list; without a cursor none is passed.
    wanted = subs.join(cuts, "topic").withColumn("_from", F.when(F.col("cursor").isNull(), 0).otherwise(F.array_position("_cuts", F.col("cursor"))))
    met = wanted.join(counted, (wanted["topic"] == counted["topic"]) & (F.col("_place") >= F.col("_from")), "left").drop(counted["topic"])
    return met.groupBy("topic", "subscription_name").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("lag"), (F.lit(now) - F.min("_oldest")).alias("oldest_age_ms")
    )


def topic_rollup(backlog: DataFrame) -> DataFrame:
    return backlog.groupBy("topic").agg(
        F.count(F.lit(1)).alias("subscriptions"), F.sum(F.col("pending") + F.col("running")).alias("in_flight"), F.sum("dead").alias("dead")
    )


def grand_totals(topics: DataFrame) -> DataFrame:
    return topics.agg(F.count(F.lit(1)).alias("topics"), F.sum("subscriptions").alias("subscriptions"), F.sum("in_flight").alias("in_flight"), F.sum("dead").alias("dead"))


def cursor_floor(subscriptions: DataFrame) -> DataFrame:
    """The least cursor of a topic's log subscriptions; null while one of them has none."""
    return subscriptions.where("mode = 'log'").groupBy("topic").agg(F.when(F.count("cursor") == F.count(F.lit(1)), F.min("cursor")).alias("floor"))


def acked_by_all(deliveries: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Messages that every subscription with deliveries on the topic has acknowledged. Topics that a cursor of a
    subscription without deliveries reads are left out."""
    subs = deliveries.select("topic", "subscription_name").distinct()
    readers = subscriptions.where("mode = 'log'").join(subs, ["topic", "subscription_name"], "left_anti").select("topic").distinct()
    wanted = subs.groupBy("topic").agg(F.count(F.lit(1)).alias("_subs")).join(readers, "topic", "left_anti")
    acked = deliveries.where("acked").groupBy("topic", "message_id").agg(F.count_distinct("subscription_name").alias("_acks"))
    return acked.join(wanted, "topic").where("_acks = _subs").select("topic", F.col("message_id").alias("id"))


def expired_by(time: str, cutoff: int | None, now: int, ttl: str | None = None) -> Column:
    """Rows without a lifetime of their own expire by the cutoff, others by their lifetime; both bounds are strict."""
    by_cutoff = F.lit(False) if cutoff is None else F.coalesce(F.col(time) < cutoff, F.lit(False))
    if ttl is None:
        return by_cutoff
    return F.when(F.col(ttl).isNull(), by_cutoff).otherwise(F.coalesce(F.col(time) + F.col(ttl) < now, F.lit(False)))


def retention_counts(archived, dead, logs, metrics, errors, cutoffs: dict[str, int | None], now: int) -> DataFrame:
    """How many rows of each table a purge would remove, and their sum."""
    tables = [
        ("archived_jobs", archived, expired_by("completed_at", cutoffs.get("archived_jobs"), now, "result_ttl_ms")),
        ("dead_letter", dead, expired_by("failed_at", cutoffs.get("dead_letter"), now, "result_ttl_ms")),
        ("task_logs", logs, expired_by("logged_at", cutoffs.get("task_logs"), now)),
        ("task_metrics", metrics, expired_by("recorded_at", cutoffs.get("task_metrics"), now)),
        ("job_errors", errors, expired_by("failed_at", cutoffs.get("job_errors"), now)),
    ]
    counts = None
    for name, df, gone in tables:
        one = df.agg(F.count_if(gone).alias("n")).select(F.lit(name).alias("table_name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def dead_groups(dead: DataFrame) -> DataFrame:
    """Dead letters by task and exception class: how many, on which queues, the last, and the reasons. A group's queues and
    its different reasons are lists in its row, as the view that shows them wants; equal reasons count once."""
    rows = dead.select("task_name", exception_class("error").alias("exception"), error_reason("error").alias("reason"), "queue", "failed_at")
    listed = [F.array_join(F.array_sort(F.collect_set(c)), sep).alias(n) for c, sep, n in (("queue", ",", "queues"), ("reason", "|", "reasons"))]
    return rows.groupBy("task_name", "exception").agg(F.count(F.lit(1)).alias("n"), F.max("failed_at").alias("last_failed_at"), *listed)


def scaler_payload(jobs: DataFrame, capacity: int) -> DataFrame:
    by_queue = jobs.groupBy("queue").agg(F.count_if(F.col("status") == 0).alias("pending"), F.count_if(F.col("status") == 1).alias("running"))
    entries = F.array_sort(F.collect_list(F.concat_ws("=", "queue", F.col("pending").cast("string"))))
    used = F.sum("running") / F.lit(float(capacity))
    return by_queue.agg(F.sum("pending").alias("pending"), (F.floor(used * 1000 + 0.5) / 1000).alias("utilization"), F.array_join(entries, ",").alias("per_queue"))


def desired_workers(df: DataFrame, target: int, target_utilization: float, least: int, most: int, tolerance: float = 0.1, threads: int = 1) -> DataFrame:
    """Workers wanted for `pending`, `running` and `current_workers`: by queue depth and by utilization of the workers'
    threads, within bounds. More running than there are threads asks for one more at least; otherwise a change that is less
    than the tolerance is left out."""
    current = F.greatest(F.col("current_workers"), F.lit(0))
    capacity = F.greatest(current * threads, F.lit(1))
    utilization = F.col("running") / capacity
    by_depth = F.ceil(F.col("pending") / F.lit(float(target)))
    by_use = F.when((current > 0) & (utilization > 0), F.ceil(current * (utilization / F.lit(target_utilization)))).otherwise(0)
    over = (current > 0) & (F.col("running") > capacity)
    wanted = F.greatest(by_depth, by_use, F.lit(least), F.when(over, current + 1).otherwise(0))
    wanted = F.greatest(F.least(wanted, F.lit(most)), F.lit(least)).cast("long")
    near = (current > 0) & ~over & (F.abs(wanted - current) / current < tolerance)
    return df.withColumn("desired", F.when(near, current.cast("long")).otherwise(wanted))


def executor_utilization(df: DataFrame, slots: str = "slots", free: str = "free") -> DataFrame:
    used = F.sum(F.greatest(F.col(slots) - F.col(free), F.lit(0)))
    return df.agg(F.coalesce(used / F.nullif(F.sum(slots), F.lit(0)), F.lit(0.0)).alias("utilization"))


def divergent_fingerprints(workers: DataFrame) -> DataFrame:
    """Fingerprints other than the most common one; all of them on a tie, none with fewer than two distinct."""
    counts = workers.where("registry_fingerprint is not null").groupBy("registry_fingerprint").agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n").alias("_top"), F.count(F.lit(1)).alias("_kinds"))  # one row
    ties = counts.join(F.broadcast(top), F.col("n") == F.col("_top"), "left_semi").agg(F.count(F.lit(1)).alias("_at_top"))  # one row
    top = counts.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(ties))
    return top.where((F.col("_kinds") > 1) & ((F.col("n") < F.col("_top")) | (F.col("_at_top") > 1))).select("registry_fingerprint", "n")


def cluster_info(workers: DataFrame, capacity="threads", load="load", buffered="buffered") -> DataFrame:
    return workers.agg(F.count(F.lit(1)).alias("peers"), F.sum(capacity).alias("capacity"), F.sum(load).alias("load"), F.sum(buffered).alias("buffered"))


def adaptive_prefetch(workers: DataFrame, alive: Column, capacity: str = "threads", buffer: str = "buffer") -> DataFrame:
    """How many jobs each worker fetches ahead: twice its share of the capacity of all peers that live and its own buffer,
    one at least and its buffer at most; its whole buffer without a living peer."""
    live = F.when(alive, F.col(capacity)).otherwise(0)
    total = workers.agg(F.sum(live).alias("_all"), F.count_if(alive).alias("_n"))
    rows = workers.crossJoin(F.broadcast(total))  # one row
    peers = F.col("_n") - F.when(alive, 1).otherwise(0)
    own = F.col(buffer).cast("double")
    wanted = F.ceil(own * (own / ((F.col("_all") - live).cast("double") + own)) * 2.0)
    bounded = F.least(F.greatest(wanted, F.lit(1)), F.col(buffer)).cast("long")
    return rows.withColumn("prefetch", F.when(peers == 0, F.col(buffer).cast("long")).otherwise(bounded)).drop("_all", "_n")


# What may be done with an argument.
STRATEGIES = ["pass", "convert", "proxy", "redirect", "reject"]


def interception_stats(passes: DataFrame) -> DataFrame:
    """One row for all passes (duration_ms, depth, and how many arguments met each strategy): totals, mean and greatest depth."""
    n, took = F.count(F.lit(1)), F.coalesce(F.sum("duration_ms"), F.lit(0.0))
    counts = [F.coalesce(F.sum(s), F.lit(0)).cast("long").alias(f"n_{s}") for s in STRATEGIES]
    mean = F.when(n > 0, took / n).otherwise(0.0)
    return passes.agg(n.alias("total_intercepts"), round2(took).alias("total_duration_ms"), round2(mean).alias("avg_duration_ms"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), *counts)


def reconstruction_stats(events: DataFrame) -> DataFrame:
    """For each handler what became of its events (kind, duration_ms): reconstructions with their times, errors, errors of
    cleaning up, and checksums that failed."""
    made = F.col("kind") == "reconstruction"
    took = F.when(made, F.col("duration_ms"))
    n = F.count(took)
    kinds = {"errors": "error", "cleanup_errors": "cleanup_error", "checksum_failures": "checksum_failure"}
    counts = [F.count_if(F.col("kind") == kind).alias(name) for name, kind in kinds.items()]
    total = F.coalesce(F.sum(took), F.lit(0.0))
    base = events.groupBy("handler").agg(
        F.count_if(made).alias("reconstructions"), *counts, round2(total).alias("total_ms"), round2(F.when(n > 0, total / n).otherwise(0.0)).alias("avg_ms"),
        round2(F.coalesce(F.max(took), F.lit(0.0))).alias("max_ms"),
    )
    p95 = index_percentiles(events.where(made), ["handler"], "duration_ms", {"p95_ms": 0.95})
    return base.join(p95, "handler", "left").withColumn("p95_ms", round2(F.coalesce("p95_ms", F.lit(0.0))))


# States of workflow nodes.
NODE_TERMINAL = ["completed", "failed", "skipped", "cancelled", "cache_hit", "compensated", "compensation_failed"]
NODE_FAILED = ["failed"]
NODE_SUCCEEDED = ["completed", "cache_hit"]


def final_states(nodes: DataFrame) -> DataFrame:
    """The state that each run ends in; null while a node isn't terminal."""
    failed = F.bool_or(F.col("status").isin(NODE_FAILED))
    done = F.bool_and(F.col("status").isin(NODE_TERMINAL))
    return nodes.groupBy("run_id").agg(F.when(done, F.when(failed, "failed").otherwise("completed")).alias("final_state"))


def fan_out_done(children: DataFrame, parent: str = "run_id") -> DataFrame:
    return children.groupBy(parent).agg(
        F.bool_and(F.col("status").isin(NODE_TERMINAL)).alias("all_terminal"), F.bool_and(F.col("status").isin(NODE_SUCCEEDED)).alias("all_succeeded")
    )


def run_context(nodes: DataFrame) -> DataFrame:
    states = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "node_name", "status"))), ",")
    return nodes.groupBy("run_id").agg(
        F.count_if(F.col("status") == "completed").alias("success_count"), F.count_if(F.col("status") == "failed").alias("failure_count"), states.alias("states")
    )


def throughput(series: DataFrame) -> DataFrame:
    return series.agg(F.sum("n").alias("total"), F.max("n").alias("peak"))
