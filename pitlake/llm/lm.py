"""Language-model scores from a log-frequency Bloom filter.

One job counts the words and word pairs of the training texts per hash range and writes the filter: a count c is quantised
to 1 + floor(log2 c) levels, and an n-gram enters its range's sub-filter once for each level. A sub-filter is as large as
the levels counted there need, so every n-gram of the corpus enters. Another job reads only the filter: levels are probed
one after the other until one is missing. A filter of bounded bytes is broadcast to the workers; a larger one stays dealt
by ranges, the distinct hashes of a batch of documents go to their range's sub-filter, and the levels found come back.

The exact unigram base needs the exact count of each word. Frequent words, a bounded number, are broadcast; the others of a
document are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pitlake.llm.common import columns, map_batches, materialize, release
from pitlake.llm.hashing import C1, C3, mix, nth, word_hashes, words_of

#: Probes per level, share of bits that may be set, weight of pairs.
PROBES, LOAD, PAIR_WEIGHT = 3, 0.35, 0.2
#: Words with exact counts that are broadcast at most (12 bytes each).
HEAD_WORDS = 500_000
#: Bytes of the filter up to which it is broadcast; each Python worker then holds it once.
FILTER_BYTES = 96 << 20
#: Characters of the texts that are packed into one batch, beside one text that may be longer.
BATCH = 4 << 20
END = np.uint64(0x9D39247E33776D41)


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text closed by END, and the number of tokens of each text."""
    parts, sizes = [], []
    for first in range(0, len(texts), 500):  # words are held for a few texts at a time, their hashes for all
        each = [words_of(t) for t in texts[first : first + 500]]
        n = np.array([len(w) + 1 for w in each], dtype=np.int64)
        out = np.full(int(n.sum()), END, np.uint64)
        inner = np.ones(len(out), dtype=bool)
        inner[np.cumsum(n) - 1] = False
        out[inner] = word_hashes([w for ws in each for w in ws])
        parts.append(out)
        sizes.append(n)
    return (np.concatenate(parts), np.concatenate(sizes)) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; a text begins after an END."""
    return mix(mix(np.concatenate(([END], tokens[:-1])) * C1) + tokens * C3)


def _positions(hashes: np.ndarray, level: int, bits: np.ndarray) -> list[np.ndarray]:
    a = mix(hashes + nth(level))
    step = mix(a ^ C1) | np.uint64(1)
    return [(a + np.uint64(i) * step) % bits for i in range(PROBES)]


def _levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(counts) + 1e-9).astype(np.int64)


def sub_filter(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Packed bits of a sub-filter that admits all of ``counts``: as many as its levels need at the load."""
    levels = _levels(counts)
    bits = 8 * (int(PROBES * levels.sum() / LOAD) // 8 + 8)
    found = np.zeros(bits, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in _positions(hashes[levels >= level], level, np.uint64(bits)):
            found[at.astype(np.int64)] = True
    return np.packbits(found, bitorder="little").tobytes()


def pack(docs: DataFrame) -> DataFrame:
    """Batches of ``docs(doc_id, text, held_out)``: ids, flags and sizes of the texts, and the texts in one compressed value."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b["text"]]
            group = np.cumsum([len(t) for t in texts]) // BATCH
            for g in np.unique(group):
                i, j = np.searchsorted(group, [g, g + 1])
                yield {"doc_id": [b["doc_id"][i:j]], "held_out": [b["held_out"][i:j]], "sizes": [[len(t) for t in texts[i:j]]], "texts": [pa.compress(b"".join(texts[i:j]), "zstd", asbytes=True)]}

    return map_batches(docs, run, "doc_id array<long>, held_out array<boolean>, sizes array<int>, texts binary").withColumn("batch", F.monotonically_increasing_id())


def _unpack(sizes: list[int], packed: bytes) -> list[str]:
    ends = np.cumsum(sizes, dtype=np.int64)
    whole = pa.decompress(packed, int(ends[-1]), "zstd", asbytes=True)
    return [whole[e - n : e].decode("utf-8", "surrogatepass") for e, n in zip(ends, sizes, strict=True)]


def _ranges(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash ranges that sorted ``values`` meet, and where the values of each begin, with the end of the last."""
    edges = np.arange(buckets, dtype=np.uint64) << _shift(buckets)
    at = np.append(np.searchsorted(values, edges), len(values))
    full = np.flatnonzero(np.diff(at))
    return full, np.append(at[full], len(values))


def _shift(buckets: int) -> np.uint64:
    return np.uint64(64 - buckets.bit_length() + 1)


def _batches(batches: Iterator[dict]) -> Iterator[tuple]:
    return ((b["batch"][i], b["held_out"][i], *_tokens(_unpack(b["sizes"][i], b["texts"][i]))) for b in batches for i in range(len(b["batch"])))


def learn(packed: DataFrame, buckets: int) -> DataFrame:
    """``kind`` (0 words, 1 pairs), ``bucket, n, total, bits`` of each hash range of the training texts; for words also
    their ``hashes`` and exact ``counts``, for the base alone.
    """

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        for _, held_out, tokens, n in _batches(batches):
            train = np.repeat(~np.array(held_out, dtype=bool), n)
            for kind, values in ((0, tokens), (1, _pairs(tokens))):
                hashes, counts = np.unique(values[train], return_counts=True)
                full, at = _ranges(hashes, buckets)
                part = lambda x, kind_of, at=at: [x[i:j].astype(kind_of).tobytes() for i, j in zip(at, at[1:], strict=False)]
                yield {"kind": [kind] * len(full), "bucket": full, "hashes": part(hashes, "<u8"), "counts": part(counts, "<u4")}

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hashes = np.frombuffer(b"".join(rows["hashes"]), "<u8")
        counts = np.frombuffer(b"".join(rows["counts"]), "<u4").astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        hashes, counts = hashes[first], np.add.reduceat(counts, first)
        words = (None, None) if key[0] else (hashes.tobytes(), counts.astype("<i8").tobytes())
        return pd.DataFrame({"kind": [key[0]], "bucket": [key[1]], "n": [len(hashes)], "total": [int(counts.sum())], "bits": [sub_filter(hashes, counts)], "hashes": [words[0]], "counts": [words[1]]})

    partial = map_batches(packed, count, "kind int, bucket int, hashes binary, counts binary")
    return partial.groupBy("kind", "bucket").applyInPandas(merge, "kind int, bucket int, n long, total long, bits binary, hashes binary, counts binary")


class LogFrequencyFilter:
    """Sub-filters of one kind, or some of them; ``levels`` is 0 for what isn't there (or rarely, by chance, more)."""

    def __init__(self, parts: Iterable[tuple[int, bytes]], buckets: int):
        parts = sorted(parts)
        self.shift, sizes = _shift(buckets), [len(b) for _, b in parts]
        self.bits, self.start = np.zeros(buckets, np.uint64), np.zeros(buckets, np.int64)
        at = [b for b, _ in parts]
        self.bits[at], self.start[at] = np.array(sizes, np.uint64) * np.uint64(8), np.cumsum([0, *sizes])[:-1]
        self.data = np.frombuffer(b"".join(b for _, b in parts), np.uint8)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        bucket = (hashes >> self.shift).astype(np.int64)
        level, open_ = np.zeros(len(hashes), dtype=np.int64), np.flatnonzero(self.bits[bucket])
        while len(open_):
            b = bucket[open_]
            hit = np.ones(len(open_), dtype=bool)
            for at in _positions(hashes[open_], int(level[open_[0]]) + 1, self.bits[b]):
                hit &= (self.data[self.start[b] + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            open_ = open_[hit]
            level[open_] += 1
        return level


def levels_by_range(packed: DataFrame, learned: DataFrame, buckets: int) -> DataFrame:
    """``batch, kind, bucket, levels``: what a filter that stays dealt has for each batch's n-grams, in order of their hashes."""

    def ask(batches: Iterator[dict]) -> Iterator[dict]:
        for batch, _, tokens, _ in _batches(batches):
            for kind, values in ((0, tokens), (1, _pairs(tokens))):
                hashes = np.unique(values)
                full, at = _ranges(hashes, buckets)
                yield {"kind": [kind] * len(full), "bucket": full, "batch": [batch] * len(full), "hashes": [hashes[i:j].astype("<u8").tobytes() for i, j in zip(at, at[1:], strict=False)]}

    def probe(key: tuple, asked: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        hashes = np.frombuffer(b"".join(asked["hashes"]), "<u8")
        found = LogFrequencyFilter([(key[1], b) for b in part["bits"]], buckets).levels(hashes).astype(np.uint8)
        ends = np.cumsum([len(h) // 8 for h in asked["hashes"]])
        return pd.DataFrame({"batch": asked["batch"], "kind": key[0], "bucket": key[1], "levels": [x.tobytes() for x in np.split(found, ends[:-1])] if len(asked) else []})

    asked = map_batches(packed, ask, "kind int, bucket int, batch long, hashes binary")
    return asked.groupBy("kind", "bucket").cogroup(learned.select("kind", "bucket", "bits").groupBy("kind", "bucket")).applyInPandas(probe, "batch long, kind int, bucket int, levels binary")


def _middle(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for, in units of the smallest that is admitted."""
    return np.where(level > 0, np.exp2(level - 1.0) * np.where(level > 1, 1.4, 1.0), 0.0)


def score(docs: DataFrame, held_out: Column, head_words: int = HEAD_WORDS, pair_weight: float = PAIR_WEIGHT, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs(doc_id, text)``.

    Rows where ``held_out`` is false or null are learned from. A null text is empty and has its end as only token;
    null and repeated ids keep their rows. Without training rows all counts are 0. The filter is broadcast up to
    ``filter_bytes``; scores are the same beyond. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    docs = columns(docs, doc_id="long", text="string").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    packed = materialize(pack(docs), "packed")
    buckets = 1 << max(6, min(20, ((packed.agg(F.sum(F.size("sizes"))).first()[0] or 0) // 4000).bit_length()))
    learned = materialize(learn(packed, buckets), "filter")
    sums = learned.agg(F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("n"), F.sum(F.when(F.col("kind") == 0, F.col("total"))).alias("total"), F.sum(F.length("bits")).alias("bytes")).first()
    distinct, total = sums.n or 0, sums.total or 0

    words = learned.where("kind = 0").select("hashes", "counts")
    least = _head_threshold(words, head_words) if distinct > head_words else 1
    head = [(np.frombuffer(r.hashes, "<u8"), np.frombuffer(r.counts, "<i8")) for r in _packed(words, least).toLocalIterator()]  # at most head_words words
    known, counts = (np.concatenate([h[i] for h in head]) if head else np.empty(0, t) for i, t in ((0, "<u8"), (1, "<i8")))
    order = np.argsort(known)
    shared = spark.sparkContext.broadcast((known[order], counts[order]))
    schema = T._parse_datatype_string("doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>, times array<long>")
    out = to_arrow_schema(schema)

    def measured(b: dict, levels_of: Callable[[int, np.ndarray], np.ndarray]) -> pa.RecordBatch:
        """Scores of one batch; ``levels_of`` gives the filter's levels of sorted distinct hashes of a kind."""
        known, counts = shared.value
        tokens, sizes = _tokens(_unpack(b["sizes"], b["texts"]))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        values, place = np.unique(tokens, return_inverse=True)
        at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
        c = np.where(known[at] == values, counts[at], 0) if len(known) else np.zeros(len(values), dtype=np.int64)
        base = np.bincount(doc, np.log10(c + 1.0)[place], len(sizes))
        n_known = np.bincount(doc, (c > 0)[place], len(sizes)).astype(np.int64)
        rare = np.flatnonzero(c[place] == 0)
        pair_of, n = np.unique(np.stack([doc[rare].astype(np.uint64), tokens[rare]], axis=1), axis=0, return_counts=True) if least > 1 and len(rare) else (np.empty((0, 2), np.uint64), np.empty(0, np.int64))
        ends = np.searchsorted(pair_of[:, 0], np.arange(len(sizes) + 1, dtype=np.uint64))
        as_long = pair_of[:, 1].view(np.int64) if pair_of.flags.f_contiguous else np.ascontiguousarray(pair_of[:, 1]).view(np.int64)

        pairs, pair_place = np.unique(_pairs(tokens), return_inverse=True)
        word_counts, pair_counts = _middle(levels_of(0, values)), _middle(levels_of(1, pairs))
        seen = word_counts[place]
        single = (seen + 1) / (total + distinct + 1)
        before = np.concatenate((word_counts[[np.searchsorted(values, END)]], seen[:-1]))
        follow = np.minimum(1.0, pair_counts[pair_place] / np.maximum(before, 1.0))
        weight = np.where(before > 0, pair_weight, 0.0)
        columns_ = {
            **{k: b[k] for k in ("doc_id", "held_out")}, "n_tokens": sizes, "n_known": n_known, "base": base,
            "score": np.bincount(doc, np.log10(weight * follow + (1 - weight) * single), len(sizes)),
            "rare": [as_long[i:j] for i, j in zip(ends, ends[1:], strict=False)], "times": [n[i:j] for i, j in zip(ends, ends[1:], strict=False)],
        }
        return pa.RecordBatch.from_arrays([pa.array(columns_[f.name], type=f.type) for f in out], schema=out)

    if (sums.bytes or 0) <= filter_bytes:
        parts: tuple[list, list] = ([], [])
        for r in learned.select("kind", "bucket", "bits").toLocalIterator():  # at most filter_bytes
            parts[r.kind].append((r.bucket, bytes(r.bits)))
        filters = spark.sparkContext.broadcast([LogFrequencyFilter(p, buckets) for p in parts])

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(whole.num_rows):
                    yield measured(whole.slice(i, 1).to_pylist()[0], lambda kind, hashes: filters.value[kind].levels(hashes))
            release()

        scored = packed.mapInArrow(near, schema)
    else:

        def far(key: tuple, own: pa.Table, found: pa.Table) -> pa.Table:
            pieces = sorted(zip(*(found[x].to_pylist() for x in ("kind", "bucket", "levels")), strict=True))
            levels = [np.frombuffer(b"".join(x for k, _, x in pieces if k == kind), np.uint8).astype(np.int64) for kind in (0, 1)]
            return pa.Table.from_batches([measured(own.to_pylist()[0], lambda kind, _: levels[kind])])

        found = materialize(levels_by_range(packed, learned, buckets), "levels")
        scored = packed.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(far, schema)
    scored = materialize(scored.withColumn("rid", F.monotonically_increasing_id()), "scored")
    rare = scored.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("rid", F.col("r.rare").alias("hash"), F.col("r.times").alias("times"))
    tail = _words(words, lambda c: c < least)
    added = rare.join(tail, "hash").groupBy("rid").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"))
    out = scored.drop("rare", "times").join(added, "rid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"), "score",
    )


def _words(rows: DataFrame, keep) -> DataFrame:
    """``hash, c`` of the words whose count ``keep`` holds for."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for h, c in zip(b["hashes"], b["counts"], strict=True):
                counts = np.frombuffer(c, "<i8")
                chosen = keep(counts)
                yield {"hash": np.frombuffer(h, "<i8")[chosen], "c": counts[chosen]}

    return map_batches(rows, run, "hash long, c long")


def _packed(rows: DataFrame, least: int) -> DataFrame:
    """The words from a count on, still packed by hash range."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            kept = [(h, c, np.frombuffer(c, "<i8") >= least) for h, c in zip(b["hashes"], b["counts"], strict=True)]
            yield {"hashes": [np.frombuffer(h, "<u8")[k].tobytes() for h, _, k in kept], "counts": [np.frombuffer(c, "<i8")[k].tobytes() for _, c, k in kept]}

    return map_batches(rows, run, "hashes binary, counts binary")


def _head_threshold(rows: DataFrame, most: int, top: int = 100_000) -> int:
    """The smallest count that at most ``most`` words reach (counts from ``top`` on are taken together)."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for c in b["counts"]:
                values, n = np.unique(np.minimum(np.frombuffer(c, "<i8"), top), return_counts=True)
                yield {"c": values, "n": n}

    found = map_batches(rows, run, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("c")).collect()  # at most top rows
    reached, least = 0, top + 1
    for r in found:
        reached += r.n
        if reached > most:
            break
        least = r.c
    return least
