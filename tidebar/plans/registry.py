"""Named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}

DIGITS = 7


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to a fixed number of digits, so float summation order cannot show."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f"`{f.name}`").cast("double"), digits) + F.lit(0.0)).alias(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            cols.append(F.col(f"`{f.name}`").cast("int").alias(f.name))
        elif isinstance(f.dataType, (T.ShortType, T.ByteType, T.IntegerType)):
            cols.append(F.col(f"`{f.name}`").cast("long").alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def query(name: str, sql: str | None = None, ctes: str = "", floats: str = "", ints: str = "") -> Callable[[Plan], Plan]:
    """Register a plan; ``floats`` and ``ints`` list the SQL columns to round or widen."""

    def wrap(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(plan(spark, sf_dir))

        PLANS[name] = run
        if sql is not None:
            swaps = [f"round(cast({c} AS DOUBLE), {DIGITS}) + 0.0 AS {c}" for c in floats.split()]
            swaps += [f"cast({c} AS BIGINT) AS {c}" for c in ints.split()]
            outer = f"SELECT * REPLACE ({', '.join(swaps)}) FROM answer" if swaps else "SELECT * FROM answer"
            head = f"{ctes.strip()}, " if ctes else ""
            ORACLES[name] = f"WITH {head}answer AS ({sql}) {outer}"
        return plan

    return wrap
