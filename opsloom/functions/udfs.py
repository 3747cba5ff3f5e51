"""Functions that need Python: cron times, notes, fingerprints, codecs. All are vectorized and take whole batches."""

import gzip
import hashlib
import io
import json
import zlib
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months and days in cron fields, and the fields' ranges.
MONTHS = {n: i + 1 for i, n in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split())}
DAYS = {n: i + 1 for i, n in enumerate("SUN MON TUE WED THU FRI SAT".split())}
RANGES = [(0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (1, 7), (1970, 2100)]


def cron_field(text: str, low: int, high: int, names: dict[str, int]) -> set[int]:
    found: set[int] = set()
    for part in text.upper().split(","):
        span, _, step = part.partition("/")
        if span in ("*", "?"):
            a, b = low, high
        else:
            first, _, last = span.partition("-")
            a = names.get(first) or int(first)
            b = (names.get(last) or int(last)) if last else (high if step else a)
        if not low <= a <= b <= high:
            raise ValueError(f"cron field out of range: {part}")
        found.update(range(a, b + 1, int(step or 1)))
    return found


@lru_cache(256)
def schedule(expression: str) -> tuple[np.ndarray, np.ndarray]:
    """The days since 1970 on which a cron expression fires, and the seconds of such a day."""
    fields = expression.split()
    if len(fields) not in (6, 7):
        raise ValueError("a cron expression has six or seven fields")
    names = [{}, {}, {}, {}, MONTHS, DAYS, {}]
    sec, minute, hour, day, month, weekday, year = (sorted(cron_field(t, *r, n)) for t, r, n in zip([*fields, "*"][:7], RANGES, names, strict=True))
    dates = np.arange(f"{RANGES[6][0]}-01-01", f"{RANGES[6][1] + 1}-01-01", dtype="datetime64[D]")
    months = dates.astype("datetime64[M]")
    days = dates.astype(np.int64)
    fires = np.isin(year_of(days), year) & np.isin(months.astype(np.int64) % 12 + 1, month) & np.isin((dates - months).astype(np.int64) + 1, day)
    fires &= np.isin((days + 4) % 7 + 1, weekday)
    return days[fires], (np.array(hour)[:, None, None] * 3600 + np.array(minute)[:, None] * 60 + np.array(sec)).ravel()


def year_of(days: np.ndarray) -> np.ndarray:
    return days.astype("datetime64[D]").astype("datetime64[Y]").astype(np.int64) + 1970


def next_crons(expression: str, after_ms: np.ndarray, tz: str = "UTC") -> tuple[np.ndarray, np.ndarray]:
    """For each time the next one after it, in milliseconds, and whether there is one within thirty years; six or seven fields:
    second, minute, hour, day, month, weekday (1 is Sunday), year. A local time that the zone leaves out isn't one."""
    days, seconds = schedule(expression)
    zone = None if tz == "UTC" else ZoneInfo(tz)

    def local(t: int) -> int:
        return t + int(datetime.fromtimestamp(t, UTC).astimezone(zone).utcoffset().total_seconds())

    def instant(t: int) -> tuple[int, bool]:
        naive = datetime(1970, 1, 1) + timedelta(seconds=t)
        at = naive.replace(tzinfo=zone).astimezone(UTC)
        return int(at.timestamp()), at.astimezone(zone).replace(tzinfo=None) == naive

    def each(f: Callable, t: np.ndarray) -> np.ndarray:
        distinct, place = np.unique(t, return_inverse=True)
        return np.array([f(int(x)) for x in distinct]).reshape(len(distinct), -1)[place].T

    first = after_ms // 1000 + 1
    t = begin = each(local, first)[0] if zone and len(first) else first
    end = year_of(t // 86400) + 30
    found, ok, open_ = np.zeros(len(t), dtype=np.int64), np.zeros(len(t), dtype=bool), np.arange(len(t))
    while len(open_) and len(days):
        day, second = t // 86400, t % 86400
        at, later = np.searchsorted(days, day), np.searchsorted(seconds, second)
        today = (days[np.minimum(at, len(days) - 1)] == day) & (later < len(seconds))
        at = np.where(today, at, np.searchsorted(days, day, "right"))
        some = at < len(days)
        open_, at, t = open_[some], at[some], days[at[some]] * 86400 + np.where(today, seconds[np.minimum(later, len(seconds) - 1)], seconds[0])[some]
        some = year_of(days[at]) <= end[open_]
        open_, t = open_[some], t[some]
        utc, valid = each(instant, t) if zone and len(t) else (t, np.ones(len(t), dtype=bool))
        own = t == begin[open_]  # of a local time that comes twice, the one that it is
        utc, valid = np.where(own, first[open_], utc), own | valid.astype(bool)
        valid &= utc * 1000 > after_ms[open_]
        found[open_[valid]], ok[open_[valid]] = utc[valid] * 1000, True
        open_, t = open_[~valid], t[~valid] + 1
    return found, ok


def next_cron(expression: str, after_ms: int, tz: str = "UTC") -> int | None:
    found, ok = next_crons(expression, np.array([after_ms]), tz)
    return int(found[0]) if ok[0] else None


def next_cron_col(expression: Column, after: Column, tz: str = "UTC") -> Column:
    """As next_crons(), null where there is none. Each expression of a batch is read once."""

    @F.pandas_udf("bigint")
    def run(e: pd.Series, a: pd.Series) -> pd.Series:
        out = pd.Series(pd.NA, index=a.index, dtype="Int64")
        known = a[a.notna()].astype("int64")
        for text, times in known.groupby(e[a.notna()]):
            found, ok = next_crons(text, times.to_numpy(), tz)
            out[times.index[ok]] = found[ok]
        return out

    return run(expression, after)


def check_notes(text: str | None) -> str | None:
    """Canonical JSON of notes within the limits: 15 fields, keys of 64, values of 500, depth 3, 4096 bytes."""
    if text is None:
        return None
    notes = json.loads(text)

    def depth(x) -> int:
        inner = x.values() if isinstance(x, dict) else x if isinstance(x, list) else None
        return 0 if inner is None else 1 + max(map(depth, inner), default=0)

    if not isinstance(notes, dict) or len(notes) > 15 or depth(notes) > 3:
        return None
    if any(len(k) > 64 or (isinstance(v, str) and len(v) > 500) for k, v in notes.items()):
        return None
    out = json.dumps(notes, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return out if len(out.encode()) <= 4096 else None


def fingerprint(names) -> str | None:
    """FNV-1a over the sorted distinct names, each behind its length in eight bytes."""
    kept = sorted({n for n in names if n is not None}) if names is not None else []
    if not kept:
        return None
    h = 0xCBF29CE484222325
    for name in kept:
        raw = name.encode()
        for byte in len(raw).to_bytes(8, "little") + raw:
            h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def mapped(f: Callable, kind: str, *columns: Column) -> Column:
    """A per-value function over whole batches."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f(v))

    return run(*columns)


def canonical_notes(c: Column) -> Column:
    return mapped(check_notes, "string", c)


def registry_fingerprint(names: Column) -> Column:
    return mapped(fingerprint, "string", names)


def gzip_bytes(c: Column) -> Column:
    return mapped(lambda b: gzip.compress(bytes(b), mtime=0), "binary", c)


def gunzip(b: bytes, most: int) -> bytes | None:
    one = zlib.decompressobj(wbits=31)
    try:
        out = one.decompress(b, most + 1)
        if len(out) > most:
            return None
        if one.eof and not one.unused_data:
            return out
    except zlib.error:
        pass
    # Several members, padding, or what isn't whole: the reader of files knows these, or names the fault.
    out = gzip.GzipFile(fileobj=io.BytesIO(b)).read(most + 1)
    return out if len(out) <= most else None


def gunzip_bytes(c: Column, most: int = 64 << 20) -> Column:
    """Decompressed bytes; null beyond `most`, so that a small blob can't fill a worker."""
    return mapped(lambda b: gunzip(bytes(b), most), "binary", c)


def hmac_hex(c: Column, secret: bytes) -> Column:
    """HMAC-SHA256 in hex digits: two rounds of SHA-256 with the padded key before them."""
    key = (secret if len(secret) <= 64 else hashlib.sha256(secret).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, c.cast("binary")), 256))), 256)


class Registry:
    """Named task functions; each runs as a vectorized function over a column, or over rows of a frame."""

    def __init__(self):
        self.tasks: dict[str, tuple[Callable, str]] = {}

    def task(self, name: str, returns: str):
        def keep(f):
            self.tasks[name] = (f, returns)
            return f

        return keep

    def apply(self, name: str, column: Column) -> Column:
        f, returns = self.tasks[name]
        return mapped(f, returns, column)

    def apply_items(self, df, name: str, id_col: str, item_col: str):
        """Per-item results of a batched task: a failing item is an error row, not a failed batch."""
        f, returns = self.tasks[name]
        kind = df.schema[id_col].dataType.simpleString()

        def run(batches):
            for batch in batches:
                rows = []
                for i, x in zip(batch[id_col], batch[item_col], strict=True):
                    try:
                        rows.append((i, "ok", f(x), None))
                    except Exception as e:  # noqa: BLE001  an item's failure is its result
                        rows.append((i, "error", None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=[id_col, "status", "result", "error"])

        return df.select(id_col, item_col).mapInPandas(run, f"{id_col} {kind}, status string, result {returns}, error string")

    def starmap(self, df, name: str, columns: list[str], out_col: str = "result"):
        """One call for each row, with the columns as its arguments; the row's other columns stay."""
        f, returns = self.tasks[name]

        @F.pandas_udf(returns)
        def run(*values: pd.Series) -> pd.Series:
            return pd.Series([f(*row) for row in zip(*values, strict=True)], index=values[0].index)

        return df.withColumn(out_col, run(*columns))


class Resource:
    """Something that a task function needs and that is dear to make, such as a client or a model: made once in each worker
    process, when it is first asked for, and kept for the process's later tasks."""

    made: dict[str, object] = {}

    def __init__(self, name: str, factory: Callable[[], object]):
        self.name, self.factory = name, factory

    def get(self):
        if self.name not in Resource.made:
            Resource.made[self.name] = self.factory()
        return Resource.made[self.name]

    def apply(self, f: Callable, returns: str, column: Column) -> Column:
        """f(resource, value) of each value."""

        @F.pandas_udf(returns)
        def run(values: pd.Series) -> pd.Series:
            held = self.get()
            return values.map(lambda v: f(held, v))

        return run(column)


def condition(f: Callable[[dict], bool], context: Column) -> Column:
    """Whether a callable condition holds for each run's context, a struct such as operators.graph.contexts makes. A condition
    that fails counts as not met."""

    def holds(ctx) -> bool:
        try:
            return bool(f(ctx))
        except Exception:  # noqa: BLE001  a condition's failure is its answer
            return False

    @F.pandas_udf("boolean")
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([holds(r) for r in rows.to_dict("records")], index=rows.index)

    return run(context)
