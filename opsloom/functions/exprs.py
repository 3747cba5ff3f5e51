"""Column expressions shared by the operators. Times are milliseconds since the epoch; `now` is always a parameter."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.sources.shared import cut

# Job status codes and their names.
STATUS = {"pending": 0, "running": 1, "complete": 2, "failed": 3, "dead": 4, "cancelled": 5}
STATUS_NAMES = STATUS | {"completed": 2}
TERMINAL = (2, 3, 4, 5)
SHED_PREFIXES = ("codel:", "rate_limit:")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round2(x: Column) -> Column:
    """Two decimals, halves away from zero for what isn't negative."""
    return F.floor(x * 100 + 0.5) / 100


def status_code(name: Column) -> Column:
    """The code of a status name; null for unknown names."""
    pairs = [F.lit(v) for kv in STATUS_NAMES.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(name))


def is_terminal(status="status") -> Column:
    return col(status).isin(*TERMINAL)


def in_namespace_read(ns: str | None, column="namespace") -> Column:
    """Reads: no namespace means all rows."""
    return F.lit(True) if ns is None else col(column) == ns


def in_namespace_dispatch(ns: str | None, column="namespace") -> Column:
    """Dispatch: no namespace means rows without one."""
    return col(column).isNull() if ns is None else col(column) == ns


def is_shed(error="error") -> Column:
    """Whether an error says that the job was shed."""
    return F.coalesce(reduce(lambda a, b: a | b, [col(error).startswith(p) for p in SHED_PREFIXES]), F.lit(False))


def before_cursor(key: str, cursor: tuple[int, str] | None, id_col: str = "id") -> Column:
    """Rows after the cursor in an order of key and id that both descend."""
    if cursor is None:
        return F.lit(True)
    at, id_ = cursor
    return (F.col(key) < at) | ((F.col(key) == at) & (F.col(id_col) < id_))


def encode_cursor(key, id_col) -> Column:
    return F.concat_ws(":", col(key).cast("string"), col(id_col))


def decode_cursor(cursor) -> Column:
    """struct<key, id>; null for a negative key, an empty id or another shape."""
    key = F.regexp_extract(col(cursor), r"^(\d+):(.+)$", 1)
    return F.when(key != "", F.struct(key.cast("long").alias("key"), F.regexp_extract(col(cursor), r"^(\d+):(.+)$", 2).alias("id")))


def bucket(at, start: int, width: int) -> Column:
    """The start of the bucket that holds `at`; buckets are anchored at `start`, floor division."""
    return (F.floor((col(at) - start) / width) * width + start).cast("long")


# Seconds by the unit of a rate, and milliseconds by the unit of a duration.
RATE_SECONDS = {"s": 1.0, "sec": 1.0, "second": 1.0, "m": 60.0, "min": 60.0, "minute": 60.0, "h": 3600.0, "hr": 3600.0, "hour": 3600.0}
DURATION_MS = {"ms": 1.0, "s": 1_000.0, "m": 60_000.0, "h": 3_600_000.0, "d": 86_400_000.0}


def of_unit(unit: Column, values: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), unit)


def trimmed(text) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def rate(text) -> Column:
    """struct<max_tokens, refill_rate> of "100/m"; null where it isn't a number, a slash and a unit."""
    parts = F.split(col(text), "/")
    number, unit = trimmed(F.get(parts, 0)), trimmed(F.get(parts, 1))
    n = F.when(number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), number.try_cast("double"))
    seconds = of_unit(unit, RATE_SECONDS)
    return F.when((F.size(parts) == 2) & n.isNotNull() & seconds.isNotNull(), F.struct(n.alias("max_tokens"), (n / seconds).alias("refill_rate")))


def duration_ms(text) -> Column:
    """Milliseconds of "500ms", "2.5s", "5m", "1h" or "1d", units in either case; null unless finite and over 0."""
    pattern = r"(?i)^\s*(\d+(?:\.\d+)?)\s*(ms|s|m|h|d)\s*$"
    n, unit = F.regexp_extract(col(text), pattern, 1), F.regexp_extract(col(text), pattern, 2)
    ms = F.bround(n.try_cast("double") * of_unit(F.lower(unit), DURATION_MS), 0)
    return F.when((n != "") & (ms > 0) & (ms < 2.0**63), ms.try_cast("long"))


def backoff_ms(retry_count, base: int, most: int, custom: list[int] | None = None) -> Column:
    """Exponential backoff up to `most`; a custom list overrides it for the retries that it covers."""
    n = col(retry_count)
    plain = F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.least(n, F.lit(30)).cast("double")), F.lit(float(most))).cast("long")
    if not custom:
        return plain
    return F.coalesce(F.try_element_at(F.array(*[F.lit(int(x)) for x in custom]).cast("array<bigint>"), (n + 1).cast("int")), plain)


def full_jitter(cap, seed: int) -> Column:
    """Uniform on [0, cap]."""
    return F.floor(F.rand(seed) * (col(cap) + 1)).cast("long")


def desync(base, seed: int) -> Column:
    """The base plus up to half of it."""
    return (col(base) + F.floor(F.rand(seed) * (col(base) / 2 + 1))).cast("long")


def idempotency_key(task, payload) -> Column:
    """auto: and the first 32 hex digits of SHA-256 over name, a zero byte and the payload."""
    data = F.concat(F.encode(col(task), "UTF-8"), F.unhex(F.lit("00")), col(payload).cast("binary"))
    return F.concat(F.lit("auto:"), F.substring(F.sha2(data, 256), 1, 32))


def subscriber_key(key, topic, subscription) -> Column:
    """The key salted with topic and subscription; byte lengths keep the parts apart."""
    size = lambda c: F.octet_length(col(c)).cast("string")
    return F.concat(col(key), F.lit("::"), size(topic), F.lit(":"), size(subscription), F.lit(":"), col(topic), col(subscription))


# What errors without a class or without a text are called.
UNKNOWN_EXCEPTION, EMPTY_ERROR = "Error", "(no error captured)"


def structured_error(error) -> Column:
    """struct<errtype, message, traceback> of an error that is an object with a text as its message; null for others. Its
    class is UNKNOWN_EXCEPTION where it has none."""
    e = col(error)
    parsed = F.from_json(e, "errtype string, message string, traceback array<string>")
    typed = e.startswith("{") & e.rlike(r'"message"\s*:\s*"')
    found = F.struct(
        F.coalesce(F.nullif(parsed["errtype"], F.lit("")), F.lit(UNKNOWN_EXCEPTION)).alias("errtype"),
        parsed["message"].alias("message"),
        F.coalesce(parsed["traceback"], F.array().cast("array<string>")).alias("traceback"),
    )
    return F.when(typed & parsed["message"].isNotNull(), found)


def encode_error(errtype, message, traceback) -> Column:
    """The text of a structured error; `traceback` is an array of lines."""
    return F.to_json(F.struct(col(errtype).alias("errtype"), col(message).alias("message"), col(traceback).alias("traceback")))


def last_line(error) -> Column:
    return trimmed(F.element_at(F.split(trimmed(error), "\n"), -1))


def exception_class(error) -> Column:
    """The class of an error: `errtype` of structured errors; of others the dotted name before the end or a colon of the last
    line if it ends in Error, Exception or Warning, else any name before a colon."""
    line = last_line(error)
    named = F.regexp_extract(line, r"^([A-Za-z_][A-Za-z0-9_.]*(?:Error|Exception|Warning))(?::|$)", 1)
    other = F.regexp_extract(line, r"^([A-Za-z_][A-Za-z0-9_.]*)\s*:", 1)
    blank = F.lit("")
    return F.coalesce(structured_error(error)["errtype"], F.nullif(named, blank), F.nullif(other, blank), F.lit(UNKNOWN_EXCEPTION))


def error_reason(error) -> Column:
    """What follows the first colon in an error's last line, else the line; the message of structured errors."""
    line, blank = last_line(error), F.lit("")
    after = trimmed(F.regexp_extract(line, r"^[^:]*:(.+)$", 1))
    structured = structured_error(error)
    plain = F.coalesce(F.nullif(after, blank), F.nullif(line, blank), F.lit(EMPTY_ERROR))
    return F.when(structured.isNotNull(), F.coalesce(F.nullif(structured["message"], blank), F.lit(EMPTY_ERROR))).otherwise(plain)


def closed_set(value, allowed: list[str], name: str) -> Column:
    """The value if it is of the set, else an error."""
    v = col(value)
    return F.when(v.isin(*allowed), v).otherwise(F.raise_error(F.concat(F.lit(f"{name}: unknown value "), F.coalesce(v, F.lit("null")))).cast("string"))


def fixed(x: Column, digits: int) -> Column:
    """The number with so many decimals, by its exact binary value; halves away from zero."""
    tie = x * 2 ** (digits + 1) == F.floor(x * 2 ** (digits + 1))
    up = F.floor(x * 10**digits + 0.5) / 10**digits
    return F.regexp_replace(F.format_number(F.when(tie, up).otherwise(x), digits), ",", "")


def rounded(x: Column, digits: int) -> Column:
    """Rounded by the exact binary value; halves to even."""
    return F.regexp_replace(F.format_number(x, digits), ",", "").cast("double")


def whole(x: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(x + 0.5).cast("long")


# Fixed value: what stands for a time that isn't one.
NO_TIME = "\u2014"


def format_duration(ms) -> Column:
    m = col(ms).cast("double")
    s = m / 1000.0
    minutes = F.floor(s / 60).cast("long")
    return (
        F.when(m.isNull() | F.isnan(m) | (F.abs(m) == float("inf")) | (m < 0), F.lit(NO_TIME))
        .when(m < 1000, F.concat(fixed(m, 0), F.lit("ms")))
        .when(s < 10, F.concat(fixed(s, 2), F.lit("s")))
        .when(s < 60, F.concat(fixed(s, 1), F.lit("s")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m "), whole(s - minutes * 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")))
    )


def format_window(ms) -> Column:
    """A retention window in its largest whole unit, in seconds if none is, one second at least."""
    m = col(ms)

    def unit(n: Column, name: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))

    sized = F.when(m.isNull(), "Kept forever").when(m <= 0, "Purged immediately")
    for size, name in ((86_400_000, "day"), (3_600_000, "hour"), (60_000, "minute")):
        sized = sized.when(m % size == 0, unit((m / size).cast("long"), name))
    return sized.otherwise(unit(F.greatest(F.lit(1).cast("long"), whole(m / 1000.0)), "second"))


def cutoff(now: int, ttl) -> Column:
    """The time before which rows have expired; null for a negative or missing lifetime."""
    return F.when(col(ttl) >= 0, F.lit(now) - col(ttl))


def sojourn(now, scheduled="scheduled_at") -> Column:
    return F.greatest((F.lit(now) if isinstance(now, int) else now) - col(scheduled), F.lit(0).cast("long"))


#: Values by which a key's distinct values are cut into ranges for exact ranks.
SPLITS = 64


def index_percentiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], splits: int = SPLITS) -> DataFrame:
    """For each key the values at index min(floor(n * q), n - 1) of its sorted values.

    Equal values are counted before anything is ordered. A key's distinct values are cut into ranges at approximate
    quantiles; exact counts of the ranges tell which one holds a rank, and only that range is ordered. So a task orders about
    one in `splits` of the hottest key's distinct values, and no group is collected into one row."""
    key = F.struct(*keys).alias("_k")
    counts = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    # Approximate quantiles depend on the order in which rows come: they are found once, for the ranges have to agree.
    cuts = cut(counts.groupBy("_k").agg(F.percentile_approx("_v", [i / splits for i in range(1, splits)], 1000).alias("_cuts"), F.sum("_c").alias("_n")))
    placed = counts.join(cuts, "_k").withColumn("_range", F.size(F.filter("_cuts", lambda x: x < F.col("_v"))))
    own = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("_k", "_range", "_n").agg(F.sum("_c").alias("_in")).withColumn("_before", F.coalesce(F.sum("_in").over(own), F.lit(0)))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("q"), F.least(F.floor(F.col("_n") * F.lit(q)), F.col("_n") - 1).alias("rank")) for name, q in quantiles.items()]))
    hits = ranges.withColumn("_w", wanted).where((F.col("_w.rank") >= F.col("_before")) & (F.col("_w.rank") < F.col("_before") + F.col("_in")))
    rows = placed.select("_k", "_range", "_v", "_c").join(hits.select("_k", "_range", "_before", "_w"), ["_k", "_range"])
    upto = F.sum("_c").over(Window.partitionBy("_k", "_w").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_cum", F.col("_before") + upto).where(F.col("_cum") > F.col("_w.rank"))
    picks = [F.min(F.when(F.col("_w.q") == name, F.col("_v"))).alias(name) for name in quantiles]
    return rows.groupBy("_k").agg(*picks).select("_k.*", *quantiles)


