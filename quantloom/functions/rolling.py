"""Rolling moments over windows that are put together from shorter ones.

A sliding row frame is evaluated from scratch for every row, so a 252-row standard deviation costs 252 updates per row.  Here the moments of
short windows are taken once and lagged: 60 rows are three windows of 20 rows side by side, 120 rows two of 60.  Every step is a lag in the one order
of the series, so nothing is sorted again, and the parts (count, sum, mean, centred sums, extremes) merge exactly.  A value leaves the result with
its row, however large it was.

Nulls are skipped.  NaN and infinity behave as in a plain frame at every length: windows that hold them show them, later windows do not.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import by, col, full, last_rows

SHORT_FRAME = 32  # a column whose windows are no longer than this keeps plain frames; results are the same
PIECES = 4  # of one window; more are avoided by a window of a quarter of its rows
_DIRECT = {"sum": F.sum, "avg": F.avg, "std": F.stddev_samp, "var": F.var_samp, "max": F.max, "min": F.min}
_FIELDS = {"sum": ("s",), "avg": ("s",), "std": ("mx", "xx"), "var": ("mx", "xx"), "max": ("hi",), "min": ("lo",)}
_PAIR = ("mx", "my", "xx", "yy", "xy")
Spec = tuple[str, str, int]
Pair = tuple[str, str, Sequence[int], int]


def window_parts(sizes: Iterable[int]) -> dict[int, list[int]]:
    """For each length, in the order of building, the shorter lengths that stand side by side in it; 1 is the row itself."""
    parts: dict[int, list[int]] = {1: []}

    def fewest(n: int) -> list[int]:
        best: list[list[int]] = [[]]
        for k in range(1, n + 1):
            best.append(min(([b, *best[k - b]] for b in parts if b <= k), key=len))
        return sorted(best[n], reverse=True)

    def build(n: int) -> None:
        if n in parts:
            return
        if len(fewest(n)) > PIECES:
            build(-(-n // 4))
        parts[n] = fewest(n)

    for n in sorted(set(sizes)):
        build(n)
    return parts


_EMPTY = {"hi": float("-inf"), "lo": float("inf")}  # of a window without values; all other fields start at 0


def _own(x: Column, y: Column | None, fields: set[str]) -> dict[str, Column]:
    """State of a single row; no field is null, which halves the generated code."""
    values = {"n": F.when(x.isNotNull(), 1.0).otherwise(0.0), "s": x, "mx": x, "xx": x - x, "hi": x, "lo": x}
    if y is not None:
        values |= {"my": y, "yy": y - y, "xy": (x - x) * (y - y)}
    return {f: F.coalesce(values[f], F.lit(_EMPTY.get(f, 0.0))) for f in fields}


def _merged(name: str, n: int, at: dict[str, list[Column]]) -> tuple[dict[str, Column], dict[str, Column]]:
    """Fields of the window of ``n`` rows from those of its parts, and those that need its means first."""
    first, second = {}, {}
    total = lambda es: sum(es[1:], es[0])
    mean = lambda f: F.col(f"_{name}_{f}_{n}")
    count = total(at["n"])
    for f, es in at.items():
        if f in ("n", "s"):
            first[f] = total(es)
        elif f in ("hi", "lo"):
            first[f] = (F.greatest if f == "hi" else F.least)(*es)
        elif f in ("mx", "my"):
            base = es[-1]  # the mean of a part that has values, so equal means stay as they are
            for k, e in list(zip(at["n"], es))[-2::-1]:
                base = F.when(k > 0, e).otherwise(base)
            first[f] = F.when(count > 0, base + total([k * (e - base) for k, e in zip(at["n"], es)]) / F.greatest(count, F.lit(1.0))).otherwise(0.0)
        else:
            u, v = {"xx": ("mx", "mx"), "yy": ("my", "my"), "xy": ("mx", "my")}[f]
            second[f] = total([e + k * (a - mean(u)) * (b - mean(v)) for e, k, a, b in zip(es, at["n"], at[u], at[v])])
    return tuple({f"_{name}_{f}_{n}": e for f, e in d.items()} for d in (first, second))


def _states(df: DataFrame, series: dict[str, tuple[Column, Column | None, set[str], set[int]]], key: Sequence[str], time: Sequence[str]) -> DataFrame:
    """``df`` with ``_<name>_<field>_<rows>`` for the lengths each series asks for and those they are put together from."""
    parts = window_parts(n for *_, sizes in series.values() for n in sizes)
    needed: dict[int, list[str]] = {n: [] for n in parts}
    for name, (_, _, _, sizes) in series.items():
        todo = list(sizes)
        while todo:
            n = todo.pop()
            if name not in needed[n]:
                needed[n].append(name)
                todo += parts[n]
    d = df.withColumns({f"_{c}_{f}_1": e for c, (x, y, fields, _) in series.items() for f, e in _own(x, y, fields).items()})
    w = by(key, time)
    depth = {1: 0}
    for n, pieces in parts.items():
        depth.setdefault(n, 1 + max((depth[b] for b in pieces), default=0))
    for level in range(1, max(depth.values()) + 1):
        lags, first, second = {}, {}, {}
        for n in (n for n in parts if depth[n] == level):
            for c in needed[n]:
                at = {f: [F.col(f"_{c}_{f}_{parts[n][0]}")] for f in series[c][2]}
                for i in range(1, len(parts[n])):
                    for f, es in at.items():
                        lags[f"_{c}_{f}_{n}_{i}"] = F.lag(f"_{c}_{f}_{parts[n][i]}", sum(parts[n][:i]), _EMPTY.get(f, 0.0)).over(w)
                        es.append(F.col(f"_{c}_{f}_{n}_{i}"))
                sums, centred = _merged(c, n, at)
                first |= sums
                second |= centred
        d = d.withColumns(lags).withColumns(first)
        d = d.withColumns(second) if second else d
    return d


def _clean(d: DataFrame, df: DataFrame, added: Sequence[str]) -> DataFrame:
    return d.select(*[F.col(f"`{c}`") for c in df.columns if c not in added], *added)


def rolling(df: DataFrame, specs: dict[str, Spec], key: Sequence[str] = ("symbol",), time: Sequence[str] = ("date",),
            least: int | None = None, pairs: dict[str, Pair] | None = None) -> DataFrame:
    """Add ``name: (sum|avg|std|var|max|min, column, rows)``; null until ``least`` (default rows) non-null values.

    ``pairs`` adds ``prefix: (x, y, sizes, shift)`` as :func:`rolling_pairs` does, in the same steps.
    """
    lengths = {x: {s[2] for s in specs.values() if s[1] == x} for x in {s[1] for s in specs.values()}}
    place = {x: f"c{i}" for i, x in enumerate(sorted(x for x, sizes in lengths.items() if max(sizes) > SHORT_FRAME))}
    series: dict[str, tuple[Column, Column | None, set[str], set[int]]] = {}
    for x, c in place.items():
        series[c] = col(x).cast("double"), None, {"n"}.union(*(_FIELDS[s[0]] for s in specs.values() if s[1] == x)), lengths[x]
    for i, (x, y, sizes, _) in enumerate((pairs or {}).values()):
        both = col(x).isNotNull() & col(y).isNotNull()
        series[f"p{i}"] = F.when(both, col(x).cast("double")), F.when(both, col(y).cast("double")), {"n", *_PAIR}, set(sizes)
    d = _states(df, series, key, time) if series else df
    out: dict[str, Column] = {}
    for name, (fn, x, n) in specs.items():
        if x not in place:
            out[name] = full(n, _DIRECT[fn](col(x)), x, last_rows(n, key, time), least)
            continue
        count, total, xx, hi, lo = (F.col(f"_{place[x]}_{f}_{n}") for f in ("n", "s", "xx", "hi", "lo"))
        # a full window holds n values, whatever it lacks makes it null
        var = xx / float(n - 1) if least is None and n > 1 else F.when(count > 1, xx / F.greatest(count - 1, F.lit(1.0)))
        value = {"sum": total, "avg": total / (float(n) if least is None else F.greatest(count, F.lit(1.0))), "var": var, "std": F.sqrt(var), "max": hi, "min": lo}[fn]
        out[name] = F.when(count >= (n if least is None else max(least, 1)), value)
    late: dict[str, Column] = {}
    for i, (prefix, (_, _, sizes, shift)) in enumerate((pairs or {}).items()):
        for n in sizes:
            count, *moments = (F.col(f"_p{i}_{f}_{n}") for f in ("n", "xy", "xx", "yy"))
            found = {f"{prefix}_n_{n}": count} | {f"{prefix}_{k}_{n}": F.when(count > 1, m / F.greatest(count - 1, F.lit(1.0))) for k, m in zip(("cov", "vx", "vy"), moments)}
            out |= found
            if shift:
                late |= {c: F.lag(c, shift, *([0.0] if c == f"{prefix}_n_{n}" else [])).over(by(key, time)) for c in found}
    d = d.withColumns(out)
    d = d.withColumns(late) if late else d
    return _clean(d, df, list(out)) if series else d


def rolling_pairs(df: DataFrame, x: str, y: str, sizes: Sequence[int], key: Sequence[str] = ("symbol",), time: Sequence[str] = ("date",),
                  shift: int = 0, prefix: str = "_pair") -> DataFrame:
    """Joint rolling moments over rows t-n-shift+1 … t-shift: ``<prefix>_{n|cov|vx|vy}_<rows>`` (rows where both are set)."""
    return rolling(df, {}, key, time, pairs={prefix: (x, y, sizes, shift)})
