"""Registry of queries: a key, a function of :class:`Tables`, and SQL over named common tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from pitlake.sources import panel, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Common tables in SQL; modules of queries add to those of the panel.
CTE = dict(panel.CTE)


class Tables:
    """The input tables of one run, each built at most once and evaluated by Spark when needed."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return panel.table(self.spark, self.sf_dir, name)

    sums = cached_property(lambda t: panel.day_sums(t.spark, t.sf_dir))
    px = cached_property(lambda t: panel.price_panel(t.sums))
    bm = cached_property(lambda t: panel.benchmark_panel(t.sums))
    sx = cached_property(lambda t: panel.sector_panel(t.sums))
    inst = cached_property(lambda t: panel.instruments(t.spark, t.sf_dir))
    cal = cached_property(lambda t: panel.calendar(t.spark, t.sf_dir))
    ms = cached_property(lambda t: panel.macro_series(t.spark))
    mo = cached_property(lambda t: panel.macro_observations(t.spark, t.sf_dir))
    fu = cached_property(lambda t: panel.fundamentals(t.spark, t.sf_dir))
    ea = cached_property(lambda t: panel.earnings(t.fu))
    tx = cached_property(lambda t: panel.ledger(t.spark, t.sf_dir))
    txo = cached_property(lambda t: panel.ledger(t.spark, t.sf_dir, numbered=False))


def _written(name: str) -> cached_property:
    return cached_property(lambda t: sinks.written(getattr(Tables, name).func(t), name))


class Stored(Tables):
    """The same tables, each written to scratch when first asked for and read from there: for queries that use them often."""

    sums, px, bm, sx, inst, cal, mo, fu, ea = map(_written, ("sums", "px", "bm", "sx", "inst", "cal", "mo", "fu", "ea"))


def with_tables(sql: str, *names: str) -> str:
    """SQL with the named common tables and all that they need in front."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for below in CTE[name][0]:
                add(below)
            order.append(name)

    for n in names:
        add(n)
    own, first = sql.removeprefix("WITH ").removeprefix("RECURSIVE "), "WITH RECURSIVE" if sql.startswith("WITH RECURSIVE") else "WITH"
    return f"{first} {', '.join(f'{n} AS ({CTE[n][1]})' for n in order)}{', ' if own != sql else ' '}{own}" if order else sql


def query(key: str, needs: str = "", sql: str | None = None, stored: bool = False):
    """Register ``f(tables)`` under ``key``; ``needs`` names the common tables of ``sql``, which is None where SQL can't say it.

    With ``stored``, the function gets tables that are written once and read as often as it needs them.
    """

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: f((Stored if stored else Tables)(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[key] = with_tables(sql, *needs.split())
        return f

    return register
