"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

The rotation is learned on a bounded sample so that signs lose little; several rotations give longer codes. A
code is cut into substrings of 16 bits, each with its own index. A code within Hamming radius r of the query
lies within r // m bits of it in one of the m substrings (pigeonhole), so looking up all substring values that
near retrieves every such code; these are reranked on the original vectors in double precision. The vectors are
dealt into blocks of bounded size, each with its index, and the queries into blocks too.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = 16
#: Vectors that the rotation is learned on at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
#: Vectors and queries of one block.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024
#: First Hamming radius as a share of the bits, and codes that a block must give before it grows no further.
RADIUS, LEAST_CODES = 0.42, 300


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of rows with an id and a vector without null or non-finite components that is not zero."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def learn_rotation(sample: np.ndarray, rotations: int = 2, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and a matrix whose products' signs are the code: iterative quantisation from several starts."""
    mean, d = sample.mean(axis=0), sample.shape[1]
    x, found = sample - mean, []
    for start in range(rotations):
        r = np.linalg.qr(np.random.default_rng(start).normal(size=(d, d)))[0]
        for _ in range(steps):
            u, _, vt = np.linalg.svd(np.sign(x @ r).T @ x)
            r = (u @ vt).T
        found.append(r)
    bits = np.hstack(found)
    return mean, bits[:, : max(WORD, bits.shape[1] // WORD * WORD)]


def codes(x: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Codes as rows of 16-bit substrings."""
    bits = (x - mean) @ rotation > 0
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % WORD)))
    return np.packbits(bits, axis=1).view(np.uint16)


@cache
def flips(radius: int) -> np.ndarray:
    """All 16-bit masks with at most ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for n in range(radius + 1) for c in combinations(range(WORD), n)], dtype=np.uint16)


class MultiIndex:
    def __init__(self, rows: np.ndarray):
        self.rows, self.m = rows, rows.shape[1]
        self.order = [np.argsort(rows[:, j], kind="stable") for j in range(self.m)]
        self.starts = [np.concatenate(([0], np.cumsum(np.bincount(rows[:, j], minlength=1 << WORD)))) for j in range(self.m)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Positions of every code within the Hamming radius."""
        found = np.zeros(len(self.rows), dtype=bool)
        near, more = divmod(radius, self.m)
        for j in range(self.m):
            reach = min(WORD, near if j <= more else near - 1)
            if reach < 0:
                continue
            values = (flips(reach) ^ code[j]).astype(np.int64)
            first = self.starts[j][values]
            count = self.starts[j][values + 1] - first
            first, count = first[count > 0], count[count > 0]
            at = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(count) else []
            found[self.order[j][at]] = True
        cand = np.flatnonzero(found)
        return cand[np.bitwise_count(self.rows[cand] ^ code).sum(axis=1) <= radius]


def search(vectors: DataFrame, is_query: str, k: int = 10, sample_rows: int = SAMPLE_ROWS, radius: float = RADIUS, least_codes: int = LEAST_CODES) -> DataFrame:
    """``query_id, rank, vec_id, score`` (Euclidean distance) of the k nearest found for rows where ``is_query`` holds.

    Candidates are all other ids; ties go to the smaller id, rows that repeat an id count once. A radius that
    yields fewer than ``least_codes`` codes in a block grows until it does or the block has no more, so a query
    with few candidates gets them all. Vectors of another length than most of the sample cannot be compared and take no
    part; null, zero and non-finite ones neither. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    total = rows.count()
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(min(1 << 30, 2 * sample_rows * (1 << 30) // max(1, total))))  # about twice the sample, whatever the table
    sample = drawn.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
    schema = "query_id long, vec_id long, score double"
    if sample.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = int(sample["v"].map(len).mode()[0])
    mean, rotation = learn_rotation(np.stack([v for v in sample["v"] if len(v) == d]))
    rows = rows.where(F.size("v") == d)
    queries = rows.where(is_query)
    blocks, query_blocks = max(1, -(-rows.count() // BLOCK_ROWS)), max(1, -(-queries.count() // BLOCK_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    left = rows.select("vec_id", "v", deal(blocks).alias("block"), every(query_blocks).alias("part"))
    right = queries.select("vec_id", "v", deal(query_blocks).alias("part"), every(blocks).alias("block"))
    shared = spark.sparkContext.broadcast((mean, rotation))

    def cell(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if index.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, x = index["vec_id"].to_numpy(), np.stack(index["v"].to_list())
        q = np.stack(asked["v"].to_list())
        table, wanted = MultiIndex(codes(x, *shared.value)), codes(q, *shared.value)
        out = []
        for qid, vector, code in zip(asked["vec_id"], q, wanted, strict=True):
            own, bits = int((ids == qid).sum()), WORD * table.m
            reach = round(radius * bits)
            while True:
                near = table.within(code, reach)
                if len(near) - own >= least_codes or reach >= bits:
                    break
                reach = min(bits, reach + max(1, bits // 32))
            near = near[ids[near] != qid]
            distance = np.sqrt(((x[near] - vector) ** 2).sum(axis=1))
            best = np.lexsort((ids[near], distance))
            best = best[np.sort(np.unique(ids[near][best], return_index=True)[1])][:k]
            out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[near][best], "score": distance[best]}))
        return pd.concat(out)

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(cell, schema)
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
