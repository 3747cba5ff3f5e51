r"""Secret scanning: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Base spans come from three patterns (see `PATTERNS`). Further spans come from runs of 20 or more base64-like characters
that overlap no base span. Each run's encoding is inferred from its characters; then, over the encoding's alphabet of k
symbols and the run's n characters,

* the chi-squared statistic for uniform use of the alphabet, the number of runs above and below the alphabet's middle,
  and the lag-1 serial correlation must all be compatible with random characters, each at the level `ALPHA`;
* the chi-squared statistic is also set against structured text, which repeats symbols `STRUCTURE` times as often as
  random characters do. Its expectation grows with n, so a longer run gives a smaller p-value for the same uniformity.

The p-values against structure of all runs of the corpus go through the Benjamini-Hochberg procedure at the rate
`FALSE_RATE`, on a histogram of their logarithms, whose size is fixed. Runs that pass both become spans of kind `random`.

Everything is DataFrame expressions. Positions are code points, the end exclusive. A null text is scanned as the empty
text and has no spans. A text of any length is scanned whole, in one task; the time grows with the product of its base spans
and candidates. Rows are scanned one by one: ties and repeated rows all count as tests, extra columns are kept whatever their
names, but for one named as the result, which is replaced. An empty table gives an empty table.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import scratch

# The base patterns, in the order of their kinds; the group whose length counts, and the least length.
PATTERNS = {
    "assign": (
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
KINDS = [*PATTERNS, "random"]
#: An equals sign is padding at the end: the value after NAME= is a candidate of its own.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Encodings, the first that fits counts: name, pattern, alphabet, and how much more often structured text repeats symbols.
ENCODINGS = [
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", "0123456789abcdef", 2.5),
    ("hex_upper", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", "0123456789ABCDEF", 2.5),
    ("decimal", r"^[0-9]+$", "0123456789", 1.2),
    ("lower", r"^[a-z]+$", "abcdefghijklmnopqrstuvwxyz", 1.7),
    ("upper", r"^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1.7),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 2.2),
    ("lower_alnum", r"^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789", 2.4),
    ("upper_alnum", r"^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 2.4),
    ("base64", r"^[A-Za-z0-9+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 3.2),
]
#: Critical values of the three compatibility tests, in standard deviations (about 0.001 each).
ALPHA_Z = 3.3
FALSE_RATE = 0.01
#: The histogram of -ln p: bins a unit, and the last bin.
BINS, LAST_BIN = 10, 1000
MASK = "[SECRET]"


def matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Array of struct<start, kind, end> of the pattern's matches whose group has the least length. The text between
    matches comes from split(), the matches themselves from regexp_extract_all(); their lengths add up to positions."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    sized = found if not group else F.regexp_extract_all(text, p, F.lit(group))
    lengths = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(found, F.length).alias("len"),
        F.transform(sized, F.length).alias("size"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        b = a + F.coalesce(x["len"], F.lit(0))
        span = F.array(F.struct(a.alias("start"), F.lit(kind).alias("kind"), b.alias("end")))
        return F.struct(b.alias("at"), F.when(x["size"] >= least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(text.rlike(pattern), F.aggregate(lengths, start, step, lambda acc: acc["out"])).otherwise(none)


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*[matches(text, p, g, n, i) for i, (p, g, n) in enumerate(PATTERNS.values())]))


def tested(text: Column, base: Column) -> Column:
    """Array of struct<start, end, log_p>: the candidates clear of base spans that are compatible with randomness."""
    spans = matches(text, CANDIDATE, 0, 20, len(PATTERNS))
    clear = F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    def statistics(s: Column) -> Column:
        token = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        token = F.regexp_replace(token, "=+$", "")
        encoding = F.coalesce(
            *[F.when(token.rlike(p), F.struct(F.lit(a).alias("alphabet"), F.lit(float(len(a))).alias("k"), F.lit(m).alias("more"))) for _, p, a, m in ENCODINGS]
        )
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), token.alias("token"), encoding.alias("enc"))

    prepared = F.filter(F.transform(clear, statistics), lambda x: x["enc"].isNotNull() & (F.length(x["token"]) >= 16))
    return F.transform(prepared, battery)


def battery(x: Column) -> Column:
    """The three tests of one candidate, and the logarithm of its p-value against structure."""
    token, k, more = x["token"], x["enc"]["k"], x["enc"]["more"]
    n = F.length(token).cast("double")
    chars = F.regexp_extract_all(token, F.lit("."), F.lit(0))
    zero = F.lit(0.0)
    squares = F.aggregate(F.array_distinct(chars), zero, lambda acc, c: acc + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2)))
    chi = k / n * squares - n
    values = F.transform(chars, lambda c: F.call_function("instr", x["enc"]["alphabet"], c).cast("double"))
    mean = F.aggregate(values, zero, lambda acc, v: acc + v) / n
    spread = F.aggregate(values, zero, lambda acc, v: acc + (v - mean) * (v - mean))
    pairs = F.zip_with(F.slice(values, F.lit(1), F.size(values) - 1), F.slice(values, F.lit(2), F.size(values) - 1), lambda a, b: (a - mean) * (b - mean))
    serial = F.aggregate(pairs, zero, lambda acc, v: acc + v) / F.greatest(spread, F.lit(1e-9))
    high = F.transform(values, lambda v: (v > k / 2).cast("double"))
    n1 = F.aggregate(high, zero, lambda acc, v: acc + v)
    changes = F.zip_with(F.slice(high, F.lit(1), F.size(high) - 1), F.slice(high, F.lit(2), F.size(high) - 1), lambda a, b: F.abs(a - b))
    runs = F.aggregate(changes, F.lit(1.0), lambda acc, v: acc + v)
    n2 = n - n1
    expected = 2 * n1 * n2 / n + 1
    variance = F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9))
    z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1))
    z_runs = F.abs(runs - expected) / F.sqrt(variance)
    z_serial = F.abs(serial + 1 / n) * F.sqrt(n)
    compatible = (z_chi <= ALPHA_Z) & (z_runs <= ALPHA_Z) & (z_serial <= ALPHA_Z) & (n1 > 0) & (n2 > 0)
    against = ((k - 1) + (n - 1) * (more - 1) - chi) / F.sqrt(2 * (k - 1) + 4 * (more - 1) * n)
    # The Gaussian tail's bound exp(-z * z / 2) / 2; incompatible candidates count as tests with p = 1.
    log_p = F.when(compatible & (against > 0), F.lit(0.6931) + against * against / 2).otherwise(0.0)
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), log_p.alias("log_p"))


def threshold(tests: DataFrame, log_p: str) -> float:
    """The least -ln p that the Benjamini-Hochberg procedure accepts. The driver sees one row for each bin."""
    bins = tests.groupBy(F.least(F.floor(F.col(log_p) * BINS), F.lit(LAST_BIN)).alias("bin")).count().collect()
    total, above, best = sum(r["count"] for r in bins), 0, float("inf")
    for r in sorted(bins, key=lambda r: -r["bin"]):
        above += r["count"]
        if r["bin"] > 0 and math.exp(-r["bin"] / BINS) <= FALSE_RATE * above / total:
            best = r["bin"] / BINS
    return best


def scan(df: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """`df` with `out_col`, a struct of the arrays `base` and `spans` of struct<start, kind, end>, both by start and
    then kind; `spans` holds all. `kind` indexes KINDS."""
    text, base, tests = (scratch(df, x) for x in ("_text", "_base", "_tests"))
    scanned = (
        df.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
        .withColumn(base, base_spans(F.col(text)))
        .withColumn(tests, F.when(F.col(text).rlike(CANDIDATE), tested(F.col(text), F.col(base))))
    )
    level = threshold(scanned.select(F.explode(tests).alias("t")).select(F.col("t.log_p").alias("log_p")), "log_p")
    passed = F.filter(F.coalesce(F.col(tests), F.array().cast("array<struct<start:int,end:int,log_p:double>>")), lambda t: t["log_p"] >= level)
    more = F.transform(passed, lambda t: F.struct(t["start"].alias("start"), F.lit(len(PATTERNS)).alias("kind"), t["end"].alias("end")))
    spans = F.array_sort(F.concat(F.col(base), more))
    return scanned.withColumn(out_col, F.struct(F.col(base).alias("base"), spans.alias("spans"))).drop(text, base, tests)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each stretch that spans cover replaced by MASK. `spans` are in order and may overlap."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, masked).otherwise(text)
