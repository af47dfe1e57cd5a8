"""Order texts with every kind of personal data, one per row of orders.

The given documents hold no social security numbers, account numbers, dates or
known places, so these texts are written from the order columns.  The expression
reads the same in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import fixed_values as fv
from ..plans.spread import spread_rows


def _n(expr: str, width: int) -> str:
    return f"lpad(CAST(({expr}) % {10 ** width} AS STRING), {width}, '0')"


K, C = "o_orderkey", "o_custkey"

CITY = "CASE " + " ".join(
    f"WHEN ({K} + {C}) % {len(fv.CITIES) + 3} = {i} THEN '{name.title()}'" for i, (name, _, _) in enumerate(fv.CITIES)
) + f" WHEN ({K} + {C}) % {len(fv.CITIES) + 3} = {len(fv.CITIES)} THEN 'Springfield' ELSE 'NYC' END"

CUSTOMER = f"'Customer#' || {_n(C, 9)}"

TEXT = " || ".join([
    f"'Order ' || CAST({K} AS STRING) || ' for ' || {CUSTOMER} || ' in NATION_' || CAST({C} % 30 AS STRING)",
    f"', DOB ' || CAST(1950 + {C} % 60 AS STRING) || '-' || {_n(f'{K} % 13', 2)} || '-' || {_n(f'{C} % 31', 2)}",
    f"'; SSN ' || {_n(f'{K} * 7', 3)} || '-' || {_n(C, 2)} || '-' || {_n(f'{K} * 13', 4)}",
    f"'; tax id 9' || {_n(C, 2)} || '-7' || CAST({K} % 10 AS STRING) || '-' || {_n(f'{K} * 3', 4)}",
    f"'. Passport A' || {_n(f'{K} * 7919', 8)} || ', driver license B' || {_n(f'{C} * 104729', 7)}",
    f"' account ' || {_n(f'{K} * 15485863', 10)} || ' IBAN GB' || {_n(K, 2)} || 'NWBK' || {_n(f'{C} * 982451653', 14)}",
    f"' DEA AB' || {_n(f'{K} * 1299709', 7)} || ' call (555) ' || {_n(K, 3)} || '-' || {_n(C, 4)}",
    f"' card 4' || {_n(f'{K} * 32452843', 15)} || ' at https://shop.example.com/o/' || CAST({K} AS STRING)",
    f"' mail c' || CAST({C} AS STRING) || '@mail' || CAST({K} % 9 AS STRING) || '.example.org from 10.' || "
    f"CAST({K} % 300 AS STRING) || '.' || CAST({C} % 256 AS STRING) || '.7; seen in ' || {CITY} || ' and ' || "
    f"lower({CITY}) || ', New York City.'",
])

PLANTED_SQL = f"planted AS (SELECT {K} AS order_id, {C} AS customer_id, {TEXT} AS note, {CITY} AS place FROM orders)"


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread_rows(spark.read.parquet(f"{sf_dir}/orders.parquet").select(K, C), K, C)
    return orders.selectExpr(f"{K} AS order_id", f"{C} AS customer_id", f"{TEXT} AS note", f"{CITY} AS place")
