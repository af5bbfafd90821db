"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton accepts every run of words of every item. A document's words are streamed through it; at each
word the longest run ending there that some item holds is known, and a run of at least ``window`` words means
that all of its words lie in windows of items. Items shorter than a window count when they occur whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlake.llm.common import TEXT_ROWS, columns, map_batches, map_text, materialize

#: Bytes that separate words become a space, A-Z become lower case; all bytes from 0x80 on belong to words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Words of all items that one automaton may hold (about 0.7 KB each in a worker); a larger benchmark is read in several passes.
AUTOMATON_WORDS = 200_000
#: States looked up for a size that a worker remembers before it starts anew.
LOCI = 200_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences of items; an item is noted at the states of its windows."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for item, words in items if words]
        for _, ids in numbered:
            at = 0
            for c in ids:
                at = self._extend(at, c)
        self.loci: dict[tuple[int, int], int] = {}
        self.holders: dict[tuple[int, int], set] = {}  # by size and the state of the run of that size
        for item, ids in numbered:
            size, state = min(window, len(ids)), 0
            for n, c in enumerate(ids, 1):
                state = self.next[state][c]
                if n >= size:
                    self.holders.setdefault((size, self._locus(state, size)), set()).add(item)
        self.sizes = sorted({size for size, _ in self.holders}, reverse=True)
        self.least = min(self.sizes, default=window)

    def _locus(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of what ``state`` has read."""
        found = self.loci.get((state, size))
        if found is None:
            found = state
            while self.length[self.link[found]] >= size:
                found = self.link[found]
            if len(self.loci) >= LOCI:
                self.loci.clear()
            self.loci[state, size] = found
        return found

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:  # the run is known from an earlier item
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of hit words (start, end), disjoint and in order, and the items that occur."""
        if not self.holders:
            return [], set()
        ids = list(map(self.vocab.get, words))
        gaps = [-1, *[i for i, c in enumerate(ids) if c is None], len(ids)]
        spans: list[tuple[int, int]] = []
        found: set = set()
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for a, b in zip(gaps, gaps[1:], strict=False):
            if b - a - 1 < self.least:
                continue
            state = run = 0
            for i in range(a + 1, b):
                c = ids[i]
                while state and c not in nxt[state]:
                    state = link[state]
                    run = length[state]
                if c in nxt[state]:
                    state, run = nxt[state][c], run + 1
                hit = 0
                for size in self.sizes:
                    if size <= run and (items := self.holders.get((size, self._locus(state, size)))):
                        hit = hit or (run if size == window else size)
                        found |= items
                if hit:
                    start = i - hit + 1
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, found


def parts_of(benchmark: DataFrame, most_words: int = AUTOMATON_WORDS) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items of a benchmark in parts of bounded size, streamed from the cluster one partition at a time."""
    part: list[tuple[int, list[bytes]]] = []
    room = most_words
    for r in columns(benchmark, item_id="long", text="string").toLocalIterator():
        words = words_of(r.text)
        if part and len(words) > room:
            yield part
            part, room = [], most_words
        part.append((r.item_id, words))
        room -= len(words)
    yield part


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_words: int = AUTOMATON_WORDS) -> DataFrame:
    """``doc_id, text, n_words, n_hit, item_ids, spans`` for every row of ``docs(doc_id, text)``.

    ``spans`` are [start, end) word positions that lie in an occurrence of a window of ``window`` words of an
    item, or of a shorter item as a whole. A null text has no words and an item without words no windows; null
    ids stay null and a null item id is no item. Rows of ``docs`` are kept as they are, repeated ones included;
    an empty table gives no rows, an empty benchmark no hits, and other columns are not read.
    """
    found = _scanned(columns(docs, doc_id="long", text="string"), benchmark, window, most_words)
    return found.select("doc_id", "text", "n_words", F.expr("aggregate(spans, 0L, (n, s) -> n + s.b - s.a)").alias("n_hit"), "item_ids", "spans")


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, most_words: int) -> DataFrame:
    """``docs`` (with ``text``) and ``n_words, item_ids, spans``. Each part of the benchmark has a pass of its own, whose
    result is written, so a task and the driver hold one automaton at a time."""
    found = docs.withColumn("spans", F.array().cast("array<struct<a:int,b:int>>")).withColumn("item_ids", F.array().cast("array<long>")).withColumn("n_words", F.lit(0).cast("long"))
    schema, scans = found.schema, 0
    for items in parts_of(benchmark, most_words):
        found = materialize(found, "scanned") if scans else found
        scans += 1
        found = _scan(found, items, window, schema)
    return found


def _scan(docs: DataFrame, items: list[tuple[int, list[bytes]]], window: int, schema: T.StructType) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        automaton = SuffixAutomaton(shared.value, window)
        for b in batches:
            for i, text in enumerate(b["text"]):
                words = words_of(text)
                spans, got = automaton.scan(words)
                b["n_words"][i] = len(words)
                b["item_ids"][i] = sorted({*b["item_ids"][i], *got} - {None})
                b["spans"][i] = [{"a": a, "b": z} for a, z in _merged([*((s["a"], s["b"]) for s in b["spans"][i]), *spans])]
            yield b

    return map_batches(docs, run, schema, TEXT_ROWS)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def items_digest(ids: list[int]) -> str:
    """SHA-256 of ids sorted as strings and joined by commas."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, and without what stands between words of one span."""
    data = text.encode("utf-8", "surrogatepass")
    letters = np.frombuffer(data.translate(WORD_BYTES), dtype=np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], letters.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")


def cleaned(text: str | None, words: int, spans: list[tuple[int, int]], most_share: float) -> str | None | bool:
    """The text without the spans, or False if they are more than ``most_share`` of its words."""
    hit = sum(b - a for a, b in spans)
    return text if not hit else False if hit > most_share * words else without_spans(text, spans)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_share: float = 0.5, most_words: int = AUTOMATON_WORDS) -> DataFrame:
    """``docs`` with hit spans taken out of ``text``; documents of which more than ``most_share`` of the words are hit go.

    All columns of ``docs`` are kept, whatever they are called, and ``n_chars``, where there is one, follows the text.
    Documents without a hit stay as they are, nulls and repeated rows included; an empty benchmark changes nothing.
    """
    parts = parts_of(benchmark, most_words)
    items = next(parts)
    if next(parts, None) is None:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def make() -> Callable[[str | None], str | None | bool]:
            automaton = SuffixAutomaton(shared.value, window)

            def clean(text: str | None) -> str | None | bool:
                words = words_of(text)
                return cleaned(text, len(words), automaton.scan(words)[0], most_share)

            return clean

        return map_text(docs, make)

    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = materialize(_scanned(docs.select(own, F.col("text").cast("string").alias("text")), benchmark, window, most_words), "scanned")

    def cut(b: dict) -> dict:
        new = [cleaned(t, n, [(s["a"], s["b"]) for s in spans], most_share) for t, n, spans in zip(b["text"], b["n_words"], b["spans"], strict=True)]
        keep = [i for i, t in enumerate(new) if t is not False]
        return {"row": [b["row"][i] for i in keep], "new": [new[i] for i in keep]}

    schema = T.StructType([found.schema["row"], T.StructField("new", T.StringType())])
    done = map_batches(found, lambda batches: map(cut, batches), schema, TEXT_ROWS)
    changed = ~F.col("new").eqNullSafe(F.col("row.text"))
    value = {"text": F.col("new"), "n_chars": F.when(changed, F.length("new")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("new")}
    return done.select(*[value.get(f.name, F.col(f"row.`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema])
