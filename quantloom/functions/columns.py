"""Column helpers: null policy, guarded arithmetic and row-frame windows.

Everything here returns a ``Column`` and stays inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("symbol",)
TIME = ("date",)


class ContractError(ValueError):
    """A table does not satisfy the column or content contract of an operator."""


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing required columns: {missing}")
    return df


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- scalars

def clip(x: str | Column, lo: float | Column | None = None, hi: float | Column | None = None) -> Column:
    """Clip that keeps null (bare ``greatest``/``least`` would replace a null by the bound)."""
    x = col(x)
    out = x
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(float(hi)))
    return F.when(x.isNotNull(), out)


def div(a: str | Column, b: str | Column) -> Column:
    """Division that gives null on a zero divisor (ANSI mode would raise)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def finite(x: str | Column) -> Column:
    """True for a value that is neither null, NaN nor infinite."""
    x = col(x).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def zero_fill(x: str | Column) -> Column:
    """The pre-model policy: null, NaN and infinities become 0."""
    return F.when(finite(x), col(x).cast("double")).otherwise(F.lit(0.0))


def sign(x: str | Column) -> Column:
    return F.signum(col(x))


def logret(x: str | Column, lag: int, over: WindowSpec) -> Column:
    x = col(x)
    return F.log(x) - F.log(F.lag(x, lag).over(over))


def pct_change(x: str | Column, lag: int, over: WindowSpec) -> Column:
    x = col(x)
    return div(x, F.lag(x, lag).over(over)) - 1.0


def mean_of(*columns: str | Column) -> Column:
    """Mean across columns, skipping nulls; null when all are null."""
    cs = [col(c) for c in columns]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0))
    count = sum((c.isNotNull().cast("int") for c in cs), F.lit(0))
    return div(total, count)


def code_map(x: str | Column, table: dict[str, float | str], default: float | str | None = None) -> Column:
    """Map codes through a small literal table."""
    out: Column | None = None
    for key, value in table.items():
        test = col(x) == F.lit(key)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    assert out is not None
    return out.otherwise(F.lit(default))


# ---------------------------------------------------------------- windows

def by(key: Sequence[str] = KEY, time: Sequence[str] = TIME) -> WindowSpec:
    """Rows of one key in time order.

    Used on tables with one row per key and period, so a group is bounded by the calendar.  Tick
    tables have no such bound: they go through :mod:`quantloom.operators.blocks` first.
    """
    return W.partitionBy(*key).orderBy(*time)


def last_rows(n: int, key: Sequence[str] = KEY, time: Sequence[str] = TIME) -> WindowSpec:
    return by(key, time).rowsBetween(-(n - 1), 0)


def prior_rows(n: int, key: Sequence[str] = KEY, time: Sequence[str] = TIME) -> WindowSpec:
    return by(key, time).rowsBetween(-n, -1)


def next_rows(n: int, key: Sequence[str] = KEY, time: Sequence[str] = TIME) -> WindowSpec:
    return by(key, time).rowsBetween(1, n)


def so_far(key: Sequence[str] = KEY, time: Sequence[str] = TIME) -> WindowSpec:
    return by(key, time).rowsBetween(W.unboundedPreceding, 0)


def full(n: int, agg: Column, valid: str | Column, over: WindowSpec, least: int | None = None) -> Column:
    """Full-window rule: ``agg`` only where the frame holds ``least`` (default n) non-null values."""
    return F.when(F.count(col(valid)).over(over) >= (n if least is None else least), agg.over(over))


def roll(fn, x: str | Column, n: int, key: Sequence[str] = KEY, time: Sequence[str] = TIME,
         least: int | None = None) -> Column:
    """Guarded rolling aggregate: ``roll(F.avg, 'close', 20)``."""
    return full(n, fn(col(x)), col(x), last_rows(n, key, time), least)


# ---------------------------------------------------------------- calendar

def next_weekday(d: str | Column) -> Column:
    """The next Monday-to-Friday date (no holiday calendar)."""
    d = col(d)
    dow = F.dayofweek(d)
    return F.date_add(d, F.when(dow == 6, 3).when(dow == 7, 2).otherwise(1))


def month_of(d: str | Column) -> Column:
    return F.date_format(col(d), "yyyy-MM")


def iso_week(d: str | Column) -> tuple[Column, Column]:
    d = col(d)
    return F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d)


def round_to_hour(ts: str | Column) -> Column:
    """Nearest hour; settlements stamped a few milliseconds late fall on the hour they belong to."""
    return F.timestamp_seconds((F.round(F.unix_millis(col(ts)) / 3_600_000.0) * 3600).cast("long"))


def align_to_bar(ts: str | Column, minutes: int | Column, bar_minutes: int = 1, mode: str = "ceil") -> Column:
    """``ts + minutes`` moved to a bar boundary; works on microseconds, so an exact boundary stays."""
    step = F.lit(bar_minutes * 60_000_000)
    micros = F.unix_micros(col(ts)) + (F.lit(minutes) if isinstance(minutes, int) else minutes).cast("long") * F.lit(60_000_000)
    floor = micros - F.pmod(micros, step)
    out = floor if mode == "floor" else F.when(F.pmod(micros, step) == 0, micros).otherwise(floor + step)
    return F.timestamp_micros(out)
