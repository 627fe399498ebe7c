"""Rolling principal-component residuals of a sector without a dates × names matrix.

For a window X of n dates (rows centred over the window) the components live in the span of the n
dates, so everything follows from inner products between dates, G = X Xᵀ, which add up over names.
Tasks sum the banded products of their names; each date's small n × n problem gives n coefficients;
a name's residual is then a dot product with its own last n returns.  A name travels as packed (date number,
return) cells; only its own task spreads them over the calendar.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import by, logret
from quantloom.session import spread, stored

NAMES = 256


def residual_z(bars: DataFrame, sectors: DataFrame, window: int = 60, components: int = 3, block_dates: int = 256) -> DataFrame:
    """(symbol, sector, date, residual_z): past-only basis, today's residual over the pooled window residual deviation.

    A missing return is 0, as is the whole row of a name before it lists.
    """
    n, block_dates = window, max(block_dates, window)  # a date reaches back into one block at most
    r = bars.withColumn("_r", F.coalesce(logret("close", 1, by()), F.lit(0.0))).join(sectors.select("symbol", "sector").filter("sector IS NOT NULL"), "symbol")
    dates = r.select("date").distinct().withColumn("_i", F.row_number().over(W.orderBy("date")) - 1)  # calendar-sized
    total = dates.agg(F.count(F.lit(1)).alias("_t"))
    dates = dates.crossJoin(total)  # one-row side
    cells = r.join(F.broadcast(dates), "date").groupBy("symbol", "sector").agg(F.collect_list(F.struct("_i", "_r")).alias("cells"), F.max("_t").alias("t"))  # one row per name, calendar-bounded

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"symbol": pdf["symbol"], "sector": pdf["sector"], "at": [np.asarray(v, dtype=np.int32).tobytes() for v in pdf["at"]],
                                "x": [np.asarray(v, dtype=float).tobytes() for v in pdf["x"]], "t": pdf["t"]})

    kind = dict(bars.dtypes)["symbol"]
    flat = spread(cells, "symbol").select("symbol", "sector", F.col("cells._i").alias("at"), F.col("cells._r").alias("x"), "t")
    arr = stored(flat.mapInPandas(pack, f"symbol {kind}, sector string, at binary, x binary, t long"))

    def dense(row) -> np.ndarray:
        x = np.zeros(row.t)
        x[np.frombuffer(row.at, dtype=np.int32)] = np.frombuffer(row.x)
        return x

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str, tuple[np.ndarray, int]] = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x = dense(row)
                lagged = np.zeros((len(x), n + 1))
                for d in range(min(n + 1, len(x))):
                    lagged[d:, d] = x[:len(x) - d]
                old, count = acc.get(row.sector, (0.0, 0))
                acc[row.sector] = (old + x[:, None] * lagged, count + 1)
        for s, (b, count) in acc.items():
            yield pd.DataFrame({"sector": s, "i": np.arange(len(b)), "names": count, "band": list(b)})

    zero = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda _: F.lit(0.0))
    g = spread(arr.select("sector", "at", "x", "t"), "x").mapInPandas(bands, "sector string, i int, names long, band array<double>")
    g = g.groupBy("sector", "i").agg(F.sum("names").alias("names"), F.collect_list("band").alias("bs"))  # one array per task and date
    g = g.withColumn("band", F.aggregate("bs", zero, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))).drop("bs")
    block = F.floor(F.col("i") / block_dates)
    # the inner products of a date's window reach n dates back
    g = g.withColumn("blk", F.explode(F.array_distinct(F.array(block, F.floor((F.col("i") + n) / block_dates)))))

    def coefficients(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        idx, band, names = pdf["i"].to_numpy(), np.vstack(pdf["band"].to_numpy()), int(pdf["names"].max())
        at = {v: k for k, v in enumerate(idx)}
        lo = int(pdf["blk"].iloc[0]) * block_dates
        out = []
        for t in range(max(lo, n), lo + block_dates):
            if t not in at or t - n not in at:
                continue
            rows = [at[j] for j in range(t - n, t + 1)]
            full = np.zeros((n + 1, n + 1))
            for a in range(n + 1):
                full[a, :a + 1] = band[rows[a], :a + 1][::-1]
            full = full + np.tril(full, -1).T
            gram, cross = full[:n, :n], full[:n, n]
            row_mean = gram.mean(0)
            center = gram - row_mean[None, :] - row_mean[:, None] + gram.mean()
            today = (cross - cross.mean()) - (row_mean - gram.mean())
            lam, u = np.linalg.eigh(center)
            lam, u = lam[::-1][:components], u[:, ::-1][:, :components]
            keep = lam > 1e-12
            c = u[:, keep] @ ((u[:, keep].T @ today) / lam[keep])
            ss = max(np.trace(center) - lam[keep].sum(), 0.0)
            sd = np.sqrt(ss / max(n * names - 1, 1)) or 1.0
            # residual = r_t - mean - Σ c_j (r_j - mean)
            out.append((pdf["sector"].iloc[0], t, c.tolist(), float(sd)))
        return pd.DataFrame(out, columns=["sector", "i", "c", "sd"])

    coef = spread(g, "sector", "blk").groupBy("sector", "blk").applyInPandas(coefficients, "sector string, i int, c array<double>, sd double")
    # a name's own series and its windows, a group of names of one sector beside the coefficients of the sector
    salts = max(1, math.ceil(arr.count() / NAMES))
    names = arr.withColumn("salt", F.pmod(F.xxhash64("symbol"), F.lit(salts)).cast("int"))
    bases = coef.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def residuals(names: pd.DataFrame, bases: pd.DataFrame) -> pd.DataFrame:
        if names.empty or bases.empty:
            return pd.DataFrame({"symbol": names["symbol"][:0], "sector": [], "i": [], "residual_z": []})
        bases = bases.sort_values("i")
        i, c, sd = bases["i"].to_numpy(), np.vstack(bases["c"].to_numpy()), bases["sd"].to_numpy()
        out = np.empty((len(names), len(i)))
        for k, row in enumerate(names.itertuples(index=False)):
            x = dense(row)
            w = np.lib.stride_tricks.sliding_window_view(x, n)[i - n]
            m = w.mean(axis=1)
            out[k] = (x[i] - m - ((w - m[:, None]) * c).sum(axis=1)) / sd
        return pd.DataFrame({"symbol": np.repeat(names["symbol"].to_numpy(), len(i)), "sector": names["sector"].iloc[0], "i": np.tile(i, len(names)), "residual_z": out.ravel()})

    grid = names.groupBy("sector", "salt").cogroup(bases.groupBy("sector", "salt")).applyInPandas(residuals, f"symbol {kind}, sector string, i int, residual_z double")
    return grid.join(F.broadcast(dates.select("date", F.col("_i").alias("i"))), "i").select("symbol", "sector", "date", "residual_z")
