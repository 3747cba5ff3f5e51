"""Ordered state machines: token buckets, breakers, load shedding, debouncing and batching.

Each is a step function from (state, row) to (state, output), shared by batch and streaming. In batch the rows of a key
are brought to one partition in order and flow through the step batch by batch, so a task holds one state and one batch,
however many rows the key has. The steps aren't associative: one key's rows are one task's work, and that is the limit of
these operators."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

Step = Callable[[dict | None, dict], tuple[dict | None, list[dict]]]


def ordered_fold(df: DataFrame, key: str, order: list[str], step: Step, schema: str, finish: Callable[[dict], list[dict]] | None = None) -> DataFrame:
    """Folds each key's rows in order. `finish` makes the last outputs of a state when its key ends."""
    columns = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current = None, None
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if row[key] != current:
                    out += finish(state) if finish and state is not None else []
                    state, current = None, row[key]
                state, found = step(state, row)
                out += found
            if out:
                yield pd.DataFrame(out, columns=columns)
        if finish and state is not None and (out := finish(state)):
            yield pd.DataFrame(out, columns=columns)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


@dataclass(frozen=True)
class TokenBucket:
    """Admits a row if a token is there; tokens refill with time up to the maximum."""

    max_tokens: float
    refill_rate: float

    def __call__(self, state, row):
        at = row["at_ms"]
        tokens = self.max_tokens if state is None else min(self.max_tokens, state["tokens"] + max(0, at - state["at"]) / 1000.0 * self.refill_rate)
        ok = tokens >= 1.0
        return {"tokens": tokens - 1.0 if ok else tokens, "at": at}, [{"seq": row["seq"], "key": row["key"], "allowed": ok}]


def token_bucket(df: DataFrame, max_tokens: float, refill_rate: float) -> DataFrame:
    return ordered_fold(df, "key", ["at_ms", "seq"], TokenBucket(max_tokens, refill_rate), "seq bigint, key string, allowed boolean")


@dataclass(frozen=True)
class Breaker:
    """A row is an attempt; if it is allowed, its outcome is recorded at once.

    Closed: a success clears the failures, a failure within `window_ms` of the last one adds to them, and `threshold` of them
    open the breaker. Open: nothing passes until `cooldown_ms` have gone by; the attempt after that passes and half opens it.
    Half open: up to `probes` more pass; it closes when `probes` outcomes have a success rate of `close_rate`, and opens when
    they haven't or can no longer reach it, or when probes were out for a whole cooldown."""

    threshold: int
    window_ms: int
    cooldown_ms: int
    probes: int = 5
    close_rate: float = 0.8

    def __call__(self, state, row):
        s = state or {"mode": "closed", "failures": 0, "last": None, "opened": 0, "half_open_at": 0, "tried": 0, "good": 0, "bad": 0}
        at, failed = row["at_ms"], bool(row["failed"])
        clean = {"tried": 0, "good": 0, "bad": 0}
        allowed = True
        if s["mode"] == "open":
            allowed = at - s["opened"] >= self.cooldown_ms
            if allowed:
                s = s | clean | {"mode": "half_open", "half_open_at": at}
        elif s["mode"] == "half_open":
            allowed = s["tried"] < self.probes
            if allowed:
                s = s | {"tried": s["tried"] + 1}
            elif at - s["half_open_at"] >= self.cooldown_ms:
                s = s | clean | {"mode": "open", "opened": at}
        if allowed:
            s = self.recorded(s, at, failed, clean)
        return s, [{"seq": row["seq"], "key": row["key"], "allowed": allowed, "mode": s["mode"]}]

    def recorded(self, s: dict, at: int, failed: bool, clean: dict) -> dict:
        if s["mode"] == "closed":
            if not failed:
                return s | {"failures": 0}
            n = s["failures"] + 1 if s["last"] is not None and at - s["last"] <= self.window_ms else 1
            return s | {"failures": n, "last": at} | ({"mode": "open", "opened": at} if n >= self.threshold else {})
        s = s | {"good": s["good"] + (not failed), "bad": s["bad"] + failed}
        if failed:
            s = s | {"failures": s["failures"] + 1, "last": at}
        seen = s["good"] + s["bad"]
        best = (s["good"] + self.probes - seen) / self.probes if self.probes > 0 else 0.0
        if not failed and seen >= self.probes and s["good"] / seen >= self.close_rate:
            return s | clean | {"mode": "closed", "failures": 0}
        if seen >= self.probes or (failed and best < self.close_rate):
            return s | clean | {"mode": "open", "opened": at}
        return s


def breaker(df: DataFrame, **config) -> DataFrame:
    return ordered_fold(df, "key", ["at_ms", "seq"], Breaker(**config), "seq bigint, key string, allowed boolean, mode string")


@dataclass(frozen=True)
class CoDel:
    """Sheds once sojourn has stayed at the target or over it for an interval, then ever faster: the next time is interval /
    sqrt(count) from now. The count outlives a recovery: an episode that begins within eight intervals of the time that was
    next goes on at two less."""

    target_ms: int
    interval_ms: int

    def __call__(self, state, row):
        s = state or {"above": 0, "next": 0, "count": 0, "dropping": False}
        at, drop = row["at_ms"], False
        if row["sojourn_ms"] < self.target_ms:
            s = s | {"above": 0, "dropping": False}
        elif s["above"] == 0:
            s = s | {"above": at + self.interval_ms}
        elif at >= s["above"] and (not s["dropping"] or at >= s["next"]):
            again = s["count"] > 2 and at - s["next"] < 8 * self.interval_ms
            n = s["count"] + 1 if s["dropping"] else s["count"] - 2 if again else 1
            drop, s = True, s | {"dropping": True, "count": n, "next": at + max(1, int(self.interval_ms / max(1, n) ** 0.5))}
        return s, [{"seq": row["seq"], "key": row["key"], "shed": drop}]


def codel(df: DataFrame, target_ms: int, interval_ms: int) -> DataFrame:
    return ordered_fold(df, "key", ["at_ms", "seq"], CoDel(target_ms, interval_ms), "seq bigint, key string, shed boolean")


@dataclass(frozen=True)
class Debounce:
    """A burst becomes one row at its deadline: window_ms after the last row, max_wait_ms after the first at most."""

    window_ms: int
    max_wait_ms: int | None = None

    def deadline(self, first: int, at: int) -> int:
        return at + self.window_ms if self.max_wait_ms is None else min(at + self.window_ms, first + self.max_wait_ms)

    def __call__(self, state, row):
        at = row["at_ms"]
        if state is not None and at < state["deadline"]:
            return state | {"deadline": self.deadline(state["first"], at), "n": state["n"] + 1, "last_seq": row["seq"]}, []
        fresh = {"key": row["key"], "first": at, "deadline": self.deadline(at, at), "n": 1, "last_seq": row["seq"]}
        return fresh, self.finish(state) if state is not None else []

    @staticmethod
    def finish(state):
        return [{"key": state["key"], "first_seen": state["first"], "fires_at": state["deadline"], "n": state["n"], "last_seq": state["last_seq"]}]


def debounce(df: DataFrame, window_ms: int, max_wait_ms: int | None = None) -> DataFrame:
    step = Debounce(window_ms, max_wait_ms)
    return ordered_fold(df, "key", ["at_ms", "seq"], step, "key string, first_seen bigint, fires_at bigint, n bigint, last_seq bigint", step.finish)


@dataclass(frozen=True)
class Accumulator:
    """Batches of up to max_size rows, closed max_wait_ms after their first row."""

    max_size: int
    max_wait_ms: int

    def __call__(self, state, row):
        at, out = row["at_ms"], []
        if state is not None and at >= state["first"] + self.max_wait_ms:
            out, state = self.finish(state), None
        state = {"key": row["key"], "first": at, "n": 1, "first_seq": row["seq"]} if state is None else state | {"n": state["n"] + 1}
        if state["n"] >= self.max_size:
            out, state = out + self.close(state, at), None
        return state, out

    @staticmethod
    def close(state, at):
        return [{"key": state["key"], "first_seq": state["first_seq"], "n": state["n"], "flushed_at": at}]

    def finish(self, state):
        return self.close(state, state["first"] + self.max_wait_ms)


def accumulate(df: DataFrame, max_size: int, max_wait_ms: int) -> DataFrame:
    step = Accumulator(max_size, max_wait_ms)
    return ordered_fold(df, "key", ["at_ms", "seq"], step, "key string, first_seq bigint, n bigint, flushed_at bigint", step.finish)
