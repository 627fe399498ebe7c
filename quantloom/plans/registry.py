"""Registry of runnable queries: Spark callable, operator ids covered and the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

# Fixed SQL for the shared views, spelled once and substituted by name in the comparison SQL.
VIEWS_SQL = {
    "bars": """bars AS (
  SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
         arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS close,
         sum(l_quantity) AS volume
  FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1, 2)""",
    "ticks": """ticks AS (
  SELECT user_id AS symbol, ts AS event_time, event_id AS trade_id, value AS price,
         CAST(json_extract(props, '$.k') AS DOUBLE) + 1 AS size,
         CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN 1.0 ELSE -1.0 END AS aggressor_sign
  FROM events WHERE value > 0)""",
    "dividends": """dividends AS (
  SELECT symbol, date AS ex_date, close * 0.01 AS dividend_per_share
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars) WHERE rn % 37 = 0)""",
    "sectors": """sectors AS (
  SELECT s_suppkey AS symbol, r_name AS sector, n_name AS industry
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "membership": """membership AS (
  SELECT symbol, date, (symbol % 5 <> 0 OR year(date) % 2 = 0) AS in_index FROM bars WHERE symbol % 7 <> 0)""",
    "exits": """exits AS (
  SELECT symbol, max(date) AS exit_date,
         CASE symbol % 5 WHEN 0 THEN 'merger' WHEN 1 THEN 'bankruptcy' WHEN 2 THEN 'voluntary' WHEN 3 THEN 'acquired' ELSE 'other' END AS exit_reason,
         symbol % 3 = 0 AS terminal_return_known, CASE WHEN symbol % 3 = 0 THEN -0.01 * (symbol % 10) END AS terminal_return_value
  FROM bars WHERE symbol % 4 <> 0 GROUP BY symbol)""",
    "scored": """scored AS (
  SELECT l_suppkey AS symbol, CAST(o_orderdate AS DATE) AS date, l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey AS row_id,
         l_discount - 0.05 AS y, l_tax - 0.04 AS pred, l_quantity / 10.0 AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
}


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    fn: QueryFn
    sql: str | None
    module: str = ""


QUERIES: dict[str, Query] = {}


def tidy(df: DataFrame, digits: int) -> DataFrame:
    """Round the double columns so that both engines print the same digits (sums differ in the last
    bits with the order of addition).  Spelled with floor, so both engines do the same arithmetic.
    Spark's floor gives a long, so values from 2^53 on, infinities and NaN pass without it: none has a fraction."""
    unit = float(10 ** digits)

    def rounded(name: str) -> Column:
        v = F.col(name) * unit + 0.5
        return (F.when(F.abs(v) < 2.0 ** 53, F.floor(v).cast("double")).otherwise(v) / unit).alias(name)

    return df.select(*[rounded(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def query(ids: str, sql: str | None = None, dbl: str = "", digits: int = 6):
    """Register ``fn``; ``@name`` in the SQL is replaced by the shared view of that name."""

    def wrap(fn: QueryFn) -> QueryFn:
        text = sql
        if text is not None:
            for view, body in VIEWS_SQL.items():
                text = text.replace("@" + view, body)
            if dbl:
                cols = ", ".join(f"floor(CAST({c} AS DOUBLE) * {10 ** digits}.0::DOUBLE + 0.5) / {10 ** digits}.0::DOUBLE AS {c}" for c in dbl.split())
                text = f"SELECT * REPLACE ({cols}) FROM ({text.strip()}) AS q"

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir), digits)

        name = fn.__name__
        assert name not in QUERIES, name
        QUERIES[name] = Query(name, tuple(ids.split()), run, text, fn.__module__.rsplit("_", 1)[-1])
        return fn

    return wrap
