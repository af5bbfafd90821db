"""Lines that many documents repeat, found by range-partitioned hashes and returned as keep bitmaps.

Each long enough line is a row (hash of its key, document, position). The rows are dealt by ranges of hash, document
descending and position, all three, so a line that stands in a third of all documents spreads over as many tasks as it
needs, and each task streams its rows in that order: the first document of a hash keeps its lines, the lines of the
others go once a third document is seen. A hash that runs on from one range into the next is undecided in both; for such
hashes, two a range at most, each task also reports the first three documents it has seen, and a second small step
decides. Texts are not moved: the result is one compressed bitmap per document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pitlake.llm.common import map_batches, materialize, release

SPACE = " \t\n\x0b\x0c\r"
#: Rows that a range aims at.
RANGE_ROWS = 1_000_000
_ROW = ("hi", "lo", "known", "doc", "d1", "d2", "pos")


def _named(docs: DataFrame) -> DataFrame:
    """``doc_id, known, doc, d1, d2, text``: a document is its id, and rows that repeat an id are told apart by their text."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), doc_id.isNotNull().alias("known"), F.coalesce(doc_id, F.lit(0)).alias("doc"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"), text.alias("text"))


def _lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """A row per line whose key is long enough, and one with null hash and the number of lines per document."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            at, pos, keys = [], [], []
            for i, text in enumerate(b["text"]):
                lines = text.split("\n")
                at.append(i)
                pos.append(len(lines))
                keys.append(None)
                for n, line in enumerate(lines):
                    if len(line) >= least_chars and len(line := line.strip(SPACE)) >= least_chars:
                        at.append(i)
                        pos.append(n)
                        keys.append(xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass").lower()))
            head = np.array([k is None for k in keys], dtype=bool)
            hashes = np.frombuffer(b"".join(k or bytes(16) for k in keys), dtype="<i8").reshape(-1, 2)
            out = {c: pa.array(b[c]).take(pa.array(at, pa.int64())) for c in ("known", "doc", "d1", "d2")}
            yield out | {"hi": pa.array(hashes[:, 0], mask=head), "lo": pa.array(hashes[:, 1], mask=head), "pos": pos}

    return map_batches(_named(docs).drop("doc_id"), run, "hi long, lo long, known boolean, doc long, d1 long, d2 long, pos long", rows=200)


class Runs:
    """Streams sorted rows of one range and yields (kind, rows): ``drop`` is decided, ``edge`` is not, ``seen`` tells documents."""

    def __init__(self, least_docs: int):
        self.least, self.last, self.rank, self.any, self.inner = least_docs, None, 0, False, False
        self.pending: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []

    def feed(self, rows: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        differ = lambda names: np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in names])
        before = lambda names, last: last is None or any(rows[c][0] != last[c] for c in names)
        new_key = np.concatenate(([before(("hi", "lo"), self.last)], differ(("hi", "lo"))))
        new_doc = new_key | np.concatenate(([before(("known", "doc"), self.last)], differ(("known", "doc"))))
        starts = np.flatnonzero(new_key[1:]) + 1
        first, last = (int(starts[0]), int(starts[-1])) if len(starts) else (len(rows), len(rows))
        yield from self._open(rows[:first], new_doc[:first], bool(new_key[0]))
        if len(starts) > 1:  # hashes that begin and end in this batch
            of, seen = starts[:-1] - first, np.cumsum(new_doc[first:last])
            size = np.diff(np.append(of, last - first))
            rank = seen - np.repeat(seen[of] - 1, size)
            yield "drop", rows[first:last][(rank > 1) & np.repeat(rank[of + size - 1] >= self.least, size)]
        if len(starts):
            yield from self._open(rows[last:], new_doc[last:], True)
        self.last = rows[-1].copy()

    def _open(self, run: np.ndarray, new_doc: np.ndarray, begins: bool) -> Iterator[tuple[str, np.ndarray]]:
        """Rows of one hash that may go on in the next batch."""
        if begins:
            yield from self.close(ends=False)
            self.inner, self.rank, self.any = self.any, 0, True
        rank = self.rank + np.cumsum(new_doc)
        self.docs.append(run[new_doc & (rank <= self.least)])
        later = run[rank > 1]
        if not self.inner:
            yield "edge", run
        elif rank[-1] >= self.least:
            yield from (("drop", p) for p in [*self.pending, later])
            self.pending = []
        else:
            self.pending.append(later)
        self.rank = int(rank[-1])

    def close(self, ends: bool) -> Iterator[tuple[str, np.ndarray]]:
        """A hash is over, or the range ends: its first hash may have begun before it, its last may go on after it."""
        if ends or not self.inner:
            yield from (("edge", p) for p in self.pending if len(p))
            yield from (("seen", d) for d in self.docs if len(d))
        self.pending, self.docs = [], []


def _streamed(rows: DataFrame, least_docs: int) -> DataFrame:
    schema = "kind string, hi long, lo long, known boolean, doc long, d1 long, d2 long, pos long"
    out = to_arrow_schema(T._parse_datatype_string(schema))
    kinds = np.dtype([(c, "?" if c == "known" else "<i8") for c in _ROW])

    def packed(found: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
        rows = np.concatenate([r for _, r in found])
        kind = pa.array(np.repeat([k for k, _ in found], [len(r) for _, r in found]), pa.string())
        return pa.RecordBatch.from_arrays([kind, *[pa.array(rows[c]) for c in _ROW]], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(least_docs)
        for b in batches:
            if b.num_rows:
                rows = np.empty(b.num_rows, kinds)
                for c in _ROW:
                    rows[c] = b.column(c).to_numpy(zero_copy_only=False)
                found = list(runs.feed(rows))
                if found:
                    yield packed(found)
        found = list(runs.close(ends=True))
        if found:
            yield packed(found)
        release()

    return rows.mapInArrow(run, schema)


def keep_bitmaps(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """``doc_id, d1, d2, n_lines, n_dropped, keep``: which lines each document keeps, as a deflated bitmap, first line first.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of at least ``least_chars``
    code points in at least ``least_docs`` documents stay in the largest id that holds them, with all their lines there,
    and go elsewhere. A null or empty text is one empty line. Rows that repeat an id are one document for counting; each
    different text of it has a row, told by ``d1, d2`` (two hashes of the text), and equal rows share one. Null ids are
    one document, smaller than all others. An empty table gives no rows; columns but ``doc_id`` and ``text`` are not read.
    """
    lines = materialize(_lines(docs, least_chars), "lines")
    rows = lines.where("hi is not null").select(*_ROW)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    order = [F.col("hi"), F.col("lo"), F.desc("known"), F.desc("doc"), F.col("pos"), F.col("d1"), F.col("d2")]
    found = materialize(_streamed(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order), least_docs), "runs")
    # At most two hashes a range, with at most least_docs documents each: bounded by the number of ranges.
    seen = found.where("kind = 'seen'").groupBy("hi", "lo").agg(F.max(F.struct("known", "doc")).alias("first"), F.countDistinct("known", "doc").alias("n"))
    seen = seen.where(F.col("n") >= least_docs)
    edge = found.where("kind = 'edge'").join(F.broadcast(seen), ["hi", "lo"]).where(F.struct("known", "doc") != F.col("first"))
    named = ["known", "doc", "d1", "d2"]
    heads = lines.where("hi is null").select(*named, F.col("pos").alias("n_lines"), F.lit(None).cast("long").alias("pos"))
    gone = [x.select(*named, F.lit(None).cast("long").alias("n_lines"), "pos") for x in (found.where("kind = 'drop'"), edge)]
    whole = heads.union(gone[0]).union(gone[1]).groupBy(*named).agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            keep = []
            for n, gone in zip(b["n_lines"], b["gone"], strict=True):
                bits = np.ones(n, dtype=bool)
                bits[gone] = False
                keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield {"doc_id": [d if k else None for d, k in zip(b["doc"], b["known"], strict=True)], "d1": b["d1"], "d2": b["d2"], "n_lines": b["n_lines"], "n_dropped": list(map(len, b["gone"])), "keep": keep}

    return map_batches(whole, run, "doc_id long, d1 long, d2 long, n_lines long, n_dropped long, keep binary", rows=500)


def bits_of(keep: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n).astype(bool)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped, keep`` for every row of ``docs``; the texts are dealt once and not sorted."""
    same: Column = F.col("t.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("t.d1") == F.col("b.d1")) & (F.col("t.d2") == F.col("b.d2"))
    joined = _named(docs).alias("t").join(bitmaps.alias("b").hint("shuffle_hash"), same, "left")
    return joined.select("t.doc_id", "t.text", "b.n_lines", "b.n_dropped", "b.keep")


def kept_text(text: str, keep: bytes, n_lines: int, n_dropped: int) -> str:
    if not n_dropped:
        return text
    return "\n".join(line for line, stays in zip(text.split("\n"), bits_of(keep, n_lines), strict=True) if stays)


def kept_digests(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` per row of ``docs``; cases as in :func:`keep_bitmaps`."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            kept = map(kept_text, b["text"], b["keep"], b["n_lines"], b["n_dropped"])
            yield {"doc_id": b["doc_id"], "n_lines": b["n_lines"], "n_dropped": b["n_dropped"], "kept_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in kept]}

    return map_batches(with_bitmaps(docs, keep_bitmaps(docs, least_chars, least_docs)), run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string", rows=200)
