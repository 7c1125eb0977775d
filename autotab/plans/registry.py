"""Named queries: each a Spark job over the driver tables plus, where SQL can
express the same result, an independent DuckDB statement for the oracle check.

Double columns listed in ``rnd`` are rounded to ``digits`` on both sides so
last-bit floating differences between engines do not change the hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Plan:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    rnd: tuple[str, ...] = ()
    digits: int = 6
    tags: tuple[str, ...] = field(default_factory=tuple)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        if self.rnd:
            df = df.withColumns({c: F.round(F.col(c).cast("double"), self.digits) for c in self.rnd})
        return df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.rnd:
            return self.sql
        rep = ", ".join(f"round(cast({c} as double), {self.digits}) AS {c}" for c in self.rnd)
        return f"SELECT * REPLACE ({rep}) FROM ({self.sql}) AS _q"


PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None, rnd: tuple[str, ...] = (), digits: int = 6,
         tags: tuple[str, ...] = ()):
    def deco(fn):
        if name in PLANS:
            raise ValueError(f"duplicate plan {name}")
        PLANS[name] = Plan(name, fn, sql, tuple(rnd), digits, tuple(tags))
        return fn
    return deco
