"""A predicate language compiled to Spark columns.

Predicates have four outcomes: true, false, defer for some seconds, cancel. A predicate compiles to a struct of `action`
(run, skip, defer, cancel) and `seconds`. The text form is calls with keyword arguments, joined by & and |, negated by !,
grouped by parentheses: `business_hours(tz="UTC") & !weekend(tz="UTC") | payload_matches(path="args.0", equals=3)`.
"""

import ast
import os
import re
from collections.abc import Callable
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

REGISTRY: dict[str, Callable[..., Column]] = {}


def register(name: str):
    """Registers a factory of columns under the name that the text form uses."""

    def keep(f):
        REGISTRY[name] = f
        return f

    return keep


def result(action, seconds=None) -> Column:
    a = F.lit(action) if isinstance(action, str) else action
    s = F.lit(None).cast("double") if seconds is None else (seconds if isinstance(seconds, Column) else F.lit(float(seconds))).cast("double")
    return F.struct(a.alias("action"), s.alias("seconds"))


def holds(condition: Column) -> Column:
    """run or skip; null is skip."""
    return result(F.when(condition, "run").otherwise("skip"))


def defer_unless(condition: Column, seconds: Column) -> Column:
    return F.when(condition, result("run")).otherwise(result("defer", seconds))


def all_of(*parts: Column) -> Column:
    """The first part that doesn't run decides."""
    return reduce(lambda rest, p: F.when(p["action"] != "run", p).otherwise(rest), reversed(parts[:-1]), parts[-1])


def any_of(*parts: Column) -> Column:
    """Any that runs wins; else cancel before defer before skip."""
    out = result("skip")
    for action in ("defer", "cancel", "run"):
        out = reduce(lambda rest, p, a=action: F.when(p["action"] == a, p).otherwise(rest), reversed(parts), out)
    return out


def negate(part: Column) -> Column:
    """Swaps run and skip; defer and cancel pass through."""
    return F.when(part["action"] == "run", result("skip")).when(part["action"] == "skip", result("run")).otherwise(part)


def local(at: Column, tz: str) -> Column:
    ZoneInfo(tz)
    return F.from_utc_timestamp(at, tz)


def millis(at: str = "at_ms") -> Column:
    return F.timestamp_millis(F.col(at))


def second_of_day(t: Column) -> Column:
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


@register("weekend")
def weekend(tz: str = "UTC", at: str = "at_ms") -> Column:
    return holds(F.weekday(local(millis(at), tz)) >= 5)


@register("business_hours")
def business_hours(tz: str = "UTC", start: int = 9, end: int = 17, at: str = "at_ms") -> Column:
    """Weekdays from `start` to `end`; otherwise defers to the next day's opening, on Saturday and Sunday to Monday's."""
    t = local(millis(at), tz)
    day, second = F.weekday(t), second_of_day(t)
    open_ = (day < 5) & (second >= start * 3600) & (second < end * 3600)
    days = F.when(day >= 5, 7 - day).when(second < start * 3600, 0).otherwise(1)
    return defer_unless(open_, days * 86400 + start * 3600 - second)


@register("time_window")
def time_window(start: str, end: str, tz: str = "UTC", at: str = "at_ms") -> Column:
    """From HH:MM to before HH:MM, past midnight if the end isn't later; otherwise defers to the next start."""
    a, b = (int(x[:2]) * 3600 + int(x[3:5]) * 60 for x in (start, end))
    second = second_of_day(local(millis(at), tz))
    inside = (second >= a) & (second < b) if a < b else (second >= a) | (second < b)
    return defer_unless(inside, F.pmod(a - second, F.lit(86400)))


@register("after")
def after(target_ms: int, at: str = "at_ms") -> Column:
    return defer_unless(F.col(at) >= target_ms, F.greatest(F.lit(1.0), (F.lit(target_ms) - F.col(at)) / 1000.0))


@register("before")
def before(target_ms: int, at: str = "at_ms") -> Column:
    return holds(F.col(at) < target_ms)


@register("in_timezone")
def in_timezone(tz: str) -> Column:
    ZoneInfo(tz)
    return result("run")


@register("payload_matches")
def payload_matches(path: str, equals, column: str = "payload") -> Column:
    """The value under a dotted path of a JSON column; numbers index lists; a missing path doesn't match."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    text = str(equals).lower() if isinstance(equals, bool) else str(equals)
    return holds(F.coalesce(F.get_json_object(F.col(column), f"${steps}") == text, F.lit(False)))


#: Sources of feature flags by name: from a flag's name to whether it is on.
PROVIDERS: dict[str, Callable[[str], bool]] = {"env": lambda name: os.environ.get(f"FF_{name.upper()}", "").strip().lower() in ("1", "true", "yes", "on")}


@register("feature_flag")
def feature_flag(flag: str, provider: str = "env") -> Column:
    """Whether a flag is on where its provider is asked, which is on the driver when the predicate is compiled."""
    if not flag or provider not in PROVIDERS:
        raise ValueError(f"no flag {flag!r} of a provider {provider!r}")
    return result("run" if PROVIDERS[provider](flag) else "skip")


@register("env_is")
def env_is(name: str, value: str) -> Column:
    """Whether the driver's environment has this value."""
    return result("run" if os.environ.get(name) == value else "skip")


@register("flag_column")
def flag_column(column: str) -> Column:
    return holds(F.col(column))


def parse(text: str) -> Column:
    """Compiles the text form. It borrows the host language's expression grammar, where ! is written as ~; quoted values are
    left as they are."""
    quoted = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')""")
    parts = [p if i % 2 else p.replace("!", "~") for i, p in enumerate(quoted.split(text))]
    return lower(ast.parse("".join(parts).strip(), mode="eval").body)


def lower(node: ast.AST) -> Column:
    match node:
        case ast.BinOp(left=a, op=ast.BitAnd(), right=b):
            return all_of(lower(a), lower(b))
        case ast.BinOp(left=a, op=ast.BitOr(), right=b):
            return any_of(lower(a), lower(b))
        case ast.UnaryOp(op=ast.Invert(), operand=a):
            return negate(lower(a))
        case ast.Call(func=ast.Name(id=name), args=args, keywords=keywords) if name in REGISTRY:
            return REGISTRY[name](*[ast.literal_eval(x) for x in args], **{k.arg: ast.literal_eval(k.value) for k in keywords})
    raise ValueError(f"not a predicate: {ast.unparse(node)}")
