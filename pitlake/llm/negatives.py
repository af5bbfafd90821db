"""Hard negatives by exact inner products from residue matrices.

Components are scaled and floored to integers. The matrices are multiplied modulo several small primes in float32, each
product exact because residues are small and long vectors are cut; enough primes are taken for the largest score that
the data can have, and Chinese remaindering gives the exact signed scores. Anchors come in groups of bounded bytes, which
are broadcast; for each group the tasks stream all rows in blocks and keep, per anchor, only the best of a window: first
the positives, then, inside each positive's band of scores, the negatives.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pitlake.llm.common import materialize, release, shared_dir

#: Small primes, largest first; their product is over 2**130.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211, 199, 197, 193, 191, 181, 179, 173, 167, 163)
#: Components of a product in float32: 1024 products of residues up to 125 stay under 2**24.
CUT = 1024
#: Scaled components of this size and over take no part: scores must fit 64 bits.
LIMIT = 1 << 31
#: Rows and anchors whose scores are held at a time, and bytes of the anchors of one group.
BLOCK_ROWS, BLOCK_ANCHORS, GROUP_BYTES = 2048, 512, 16 << 20


def primes_for(most: int) -> list[int]:
    """Primes with a product over four times ``most``, so that a score's sign shows in its share of the product."""
    out, product = [], 1
    for p in PRIMES:
        if product > 4 * most:
            break
        out.append(p)
        product *= p
    return out


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Residues nearest zero."""
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def product_mod(a: list[np.ndarray], b: list[np.ndarray], p: int) -> np.ndarray:
    """``a @ b.T`` modulo p from residues that are cut into pieces of at most CUT components."""
    total = np.zeros((a[0].shape[0], b[0].shape[0]), np.int32)
    for x, y in zip(a, b, strict=True):
        total += (x @ y.T).astype(np.int32) % p
    return total % p


def cut_residues(x: np.ndarray, primes: list[int]) -> list[list[np.ndarray]]:
    return [[(r := residues(x, p))[:, at : at + CUT] for at in range(0, max(1, x.shape[1]), CUT)] for p in primes]


def reconstruct(found: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed values from their residues, by mixed radix; the sums wrap modulo 2**64, the values fit."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        value, weight = np.zeros_like(found[i]), 1
        for d, q in zip(digits, primes, strict=False):
            value, weight = (value + d * (weight % p)) % p, weight * q
        digits.append((found[i] - value) * pow(weight, -1, p) % p)
    whole = 1
    for p in primes:
        whole *= p
    total, share, weight = np.zeros(found[0].shape, np.uint64), np.zeros(found[0].shape), 1
    for d, p in zip(digits, primes, strict=True):
        total += d.astype(np.uint64) * np.uint64(weight % (1 << 64))
        share += d * (weight / whole)
        weight *= p
    total[share > 0.5] -= np.uint64(whole % (1 << 64))
    return total.view(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, v`` with scaled integer components of the rows that take part; equal rows once."""
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(~F.isnan(x) & (F.abs(x) * 256 < LIMIT - 1), F.floor(x * 256)).cast("int"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled.alias("v"))
    rows = rows.where("vec_id is not null and label is not null and v is not null").where(F.forall("v", lambda x: x.isNotNull()))
    return rows.distinct()


class Best:
    """The first ``k`` of what each of ``n`` lists was offered: larger scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64)
        self.there = np.zeros((n, 0), dtype=bool)

    def offer(self, at: slice, score: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """``score`` and ``ids`` come in order along each row; of those that fit, the first k are looked at."""
        take = fits & (np.cumsum(fits, axis=1) <= self.k)
        if not take.any():
            return
        width = int(take.sum(axis=1).max())
        if self.score.shape[1] < self.k:
            pad = ((0, 0), (0, self.k - self.score.shape[1]))
            self.score, self.id, self.there = np.pad(self.score, pad), np.pad(self.id, pad), np.pad(self.there, pad)
        row, col = np.nonzero(take)
        place = (np.cumsum(take, axis=1) - 1)[row, col]
        new = [np.zeros((len(score), width), t) for t in (np.int64, np.int64, bool)]
        new[0][row, place], new[1][row, place], new[2][row, place] = score[row, col], np.broadcast_to(ids, score.shape)[row, col], True
        s, i, t = (np.concatenate((old[at], n), axis=1) for old, n in zip((self.score, self.id, self.there), new, strict=True))
        order = np.lexsort((i, ~s, ~t), axis=1)[:, : self.k]  # ~s falls as s grows, without overflow
        self.score[at], self.id[at], self.there[at] = (np.take_along_axis(x, order, axis=1) for x in (s, i, t))


def _scan(rows: DataFrame, anchors: dict[int, dict], primes: list[int], lists: int, k: int, fits: Callable[..., np.ndarray], schema: str) -> DataFrame:
    """The first k rows of each anchor's lists, per task. ``anchors``: by number of components, ``key, id, label, v`` and what ``fits`` reads.

    ``fits(anchors, at, j, score, same_label)`` tells which scores may enter list j.
    """
    out, shared = to_arrow_schema(T._parse_datatype_string(schema)), rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: [Best(len(a["id"]), k) for _ in range(lists)] for d, a in shared.value.items()}
        cut = {d: [cut_residues(a["v"][at : at + BLOCK_ANCHORS], primes) for at in range(0, len(a["id"]), BLOCK_ANCHORS)] for d, a in shared.value.items()}
        for b in batches:
            v, size = b.column("v"), b.column("v").value_lengths().to_numpy(zero_copy_only=False)
            ids, labels = (b.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
            for d in np.unique(size):
                if int(d) not in best:
                    continue
                a, own = shared.value[int(d)], np.flatnonzero(size == d)
                x = v.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(own), int(d))
                for first in range(0, len(own), BLOCK_ROWS):
                    part = own[first : first + BLOCK_ROWS]
                    by_id = np.argsort(ids[part], kind="stable")
                    part, block = part[by_id], cut_residues(x[first : first + BLOCK_ROWS][by_id], primes)
                    for j, mine in enumerate(cut[int(d)]):
                        at = slice(j * BLOCK_ANCHORS, j * BLOCK_ANCHORS + len(mine[0][0]))
                        score = reconstruct([product_mod(m, r, p).astype(np.int64) for m, r, p in zip(mine, block, primes, strict=True)], primes)
                        order = np.argsort(~score, axis=1, kind="stable")
                        score = np.take_along_axis(score, order, axis=1)
                        near, same = ids[part][order], labels[part][order] == a["label"][at, None]
                        other = near != a["id"][at, None]
                        for i in range(lists):
                            best[int(d)][i].offer(at, score, near, other & fits(a, at, i, score, same))
        for d, a in shared.value.items():
            for i, found in enumerate(best[d]):
                row, col = np.nonzero(found.there)
                if len(row):
                    told = {"key": a["key"][row], "list": np.full(len(row), i), "vec_id": found.id[row, col], "score": found.score[row, col]}
                    yield pa.RecordBatch.from_arrays([pa.array(told[f.name], f.type) for f in out], schema=out)
        release()

    return rows.select("vec_id", "label", "v").mapInArrow(run, schema)


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key", "list").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _grouped(rows: list[dict], lists: int = 0) -> dict[int, dict]:
    """Anchors by their number of components, as arrays; with ``lists``, also the bands of scores (none: empty)."""
    out = {}
    for d in sorted({len(r["v"]) for r in rows}):
        own = [r for r in rows if len(r["v"]) == d]
        array = lambda c, own=own: np.array([r[c] for r in own], np.int64)
        out[d] = {"key": array("key"), "id": array("vec_id"), "label": array("label"), "v": np.array([r["v"] for r in own], np.int64).reshape(len(own), d)}
        bands = np.array([[r.get("bands", {}).get(i, (1, 0)) for i in range(lists)] for r in own], np.int64).reshape(len(own), lists, 2)
        out[d] |= {"low": bands[:, :, 0], "high": bands[:, :, 1]}
    return out


def mine(vectors: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of anchors, which ``is_anchor`` picks.

    ``vectors`` has ``vec_id, label, embedding``. A component counts as floor(256 x), a score is an integer inner product.
    An anchor's positives are the first rows of its label, negatives the first of other labels whose score is from ``low``
    to ``high`` percent of the positive's; larger scores first, ties by smaller id. Rows with a null id, label or vector, or
    a component that is null, not finite or 2**31 and over when scaled, take no part. Vectors of different lengths have no
    score. Equal rows count once; different rows of one id are rows of their own, but none is a partner of its own id, and
    each that is an anchor has its lists. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors), "vectors")
    widest = rows.agg(F.max(F.size("v")).alias("d"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.abs(x.cast("long"))))).alias("x")).first()
    schema = "key long, list int, vec_id long, score long"
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if widest["d"] is None:
        return spark.createDataFrame([], result)
    primes = primes_for(max(1, widest["d"] * widest["x"] ** 2))
    anchors = rows.where(is_anchor).withColumn("deal", F.xxhash64("vec_id", "label", "v"))
    per_group = max(1, GROUP_BYTES // (16 * max(1, widest["d"])))
    groups = max(1, -(-anchors.count() // per_group))
    path = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    for g in range(groups):
        own = [r.asDict() | {"key": i} for i, r in enumerate(anchors.where(F.pmod("deal", F.lit(groups)) == g).collect())]  # about per_group rows
        near = _first(_scan(rows, _grouped(own), primes, 1, positives, lambda a, at, i, score, same: same, schema), positives)
        near = materialize(near.select("key", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        for r in near.collect():  # at most ``positives`` rows an anchor
            p = r["positive_score"]
            own[r["key"]].setdefault("bands", {})[r["rank"] - 1] = (-(-low * p // 100), high * p // 100)
        within = lambda a, at, i, score, same: ~same & (score >= a["low"][at, i, None]) & (score <= a["high"][at, i, None])
        hard = _first(_scan(rows, _grouped(own, positives), primes, positives, negatives, within, schema), negatives)
        names = spark.createDataFrame([(r["key"], r["vec_id"]) for r in own], "key long, anchor_id long")
        near = near.withColumn("list", (F.col("rank") - 1).cast("int")).drop("rank")
        hard = hard.join(near, ["key", "list"]).join(F.broadcast(names), "key")
        hard = hard.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        hard.write.mode("append").parquet(path)
    return spark.read.schema(result).parquet(path)
