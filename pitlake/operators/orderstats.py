"""Quantiles of a series as they stood at each of many dates, in one pass."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

EPOCH = dt.date(1970, 1, 1)


def quantile(ordered: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Linear between the neighbours of (n - 1) q."""
    at = (len(ordered) - 1) * q
    low, high = np.floor(at).astype(int), np.ceil(at).astype(int)
    between = (high - at) * ordered[low] + (at - low) * ordered[high]
    return np.where(low == high, ordered[low], between)


def as_known(days: np.ndarray, values: np.ndarray, dates: np.ndarray, q: np.ndarray, least: int) -> Iterator[tuple[int, float, list[float] | None]]:
    """Per date with history: (index of the date, latest value, quantiles or None). The days between two dates are sorted
    once and merged into the run of all days before.
    """
    ends, run, done = np.searchsorted(days, dates, side="right"), np.empty(0), 0
    for i, end in enumerate(ends.tolist()):
        if end > done:
            fresh = np.sort(values[done:end])
            run, done = np.insert(run, np.searchsorted(run, fresh), fresh), end
        if end:
            yield i, float(values[end - 1]), quantile(run, q).tolist() if end >= least else None


def running_quantiles(history: DataFrame, dates: list[dt.date], keys: list[str], quantiles: list[float], least: int) -> DataFrame:
    """Per series (``keys`` and ``feature``) and date: ``as_of, value, q``, the latest value until then and exact quantiles.

    ``history`` has ``keys, feature, d, value`` with at most one row per series and day, so a series is as long as the
    calendar; nulls are left out, ``q`` is null with fewer than ``least`` values, and dates before a series have no row.
    The series are dealt by their key and streamed in order; ``dates`` are at most as many as the calendar has.
    """
    names = [*keys, "feature"]
    rows = history.where(F.col("value").isNotNull()).select(*names, F.unix_date("d").alias("day"), F.col("value").cast("double").alias("value"))
    schema = T.StructType([*[f for f in rows.schema if f.name in names], *T._parse_datatype_string("as_of date, value double, q array<double>")])
    out, q = to_arrow_schema(schema), np.array(quantiles)
    marks = np.array([(d - EPOCH).days for d in sorted(dates)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, days, values = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if key is not None:
                found = list(as_known(np.concatenate(days), np.concatenate(values), marks, q, least))
                cols = [[k] * len(found) for k in key] + [[int(marks[i]) for i, _, _ in found], [v for _, v, _ in found], [x for _, _, x in found]]
                arrays = [pa.array(c, pa.int32()).cast(f.type) if f.name == "as_of" else pa.array(c, f.type) for c, f in zip(cols, out, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)

        for b in batches:
            own = [b.column(c).to_pylist() for c in names]
            day, value = b.column("day").to_numpy(zero_copy_only=False), b.column("value").to_numpy(zero_copy_only=False)
            series = list(zip(*own, strict=True))
            cuts = [0, *[i for i in range(1, len(series)) if series[i] != series[i - 1]], len(series)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if series[a] != key:
                    yield from flush()
                    key, days, values = series[a], [], []
                days.append(day[a:z])
                values.append(value[a:z])
        yield from flush()

    return rows.repartition(*names).sortWithinPartitions(*names, "day").mapInArrow(run, schema)
