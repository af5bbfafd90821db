"""Best-fit packing of tokenised documents into sequences, by linear grouping.

Only lengths matter for a packing, and a length is at most the capacity. So the plan is made from the
histogram of lengths (at most ``capacity`` rows, however many documents there are) and says, for runs of
ranks within a length, which run of sequences they go to and where. The documents themselves are only
numbered within their length and looked up in that plan.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.llm.common import columns, map_batches, materialize

#: Words that a worker keeps with their ids before it starts anew.
CACHE = 400_000
#: Documents that are split into words at a time.
DOCS = 256
#: Fixed value: signs that may close a word of letters (none of them begins a contraction or a special token).
SIGNS = ".,;:!?%*&#$-"
#: Commas and full stops after anything but white space and the Latin letters and digits, which stay such when normalised.
JOINED_SIGNS = re.compile(r"[,.](?<=[^ \n0-9A-Za-zÀ-ÖØ-öø-įıĲ-ɏ][,.]) ")
#: What may change otherwise if the text is put in lower case before it is normalised, or could become a special token.
CASED = re.compile(r"[^\x00-įı-ɏ]|<\|")
#: Pieces that one numbering task should get.
ROWS_PER_TASK = 200_000


def split_words(text: str | None) -> list[str]:
    """Words at spaces and line ends, with closing commas and full stops apart, which merge with other signs only."""
    text = (text or "").replace("\n", " ")
    if not CASED.search(text):
        text = text.lower()
    if not JOINED_SIGNS.search(text):
        text = text.replace(", ", " , ").replace(". ", " . ")
    return text.split(" ")


def is_letters(word: str) -> bool:
    """Whether the word still is all letters when the tokenizer has normalised it."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class WordIds:
    """Ids of white-space separated words as little-endian uint32 bytes; a word's ids don't depend on its neighbours."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.known: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids that end a run of letters
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def encode(self, texts: list[list[str]]) -> Iterator[bytes]:
        """The ids of each text, given as words."""
        self.learn(set().union(*texts))
        at = self.known.__getitem__
        return (b"".join(map(at, words)) for words in texts)

    def learn(self, words: set[str]) -> None:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        parts, letters, rest = {}, set(), set()
        for w in words.difference(known):
            if is_letters(w):
                letters.add(w)
                continue
            head = w.rstrip(SIGNS)
            if len(head) < len(w) and is_letters(head):  # letters, then signs: two parts that don't merge
                tail = w[len(head) :]
                parts[w] = head, tail
                if head not in known:
                    letters.add(head)
                if tail not in known:
                    rest.add(tail)
            else:
                rest.add(w)
        self._learn_letters(list(letters))
        rest = [*rest, *(w for w in letters if w not in known)] if len(letters) else list(rest)
        for w, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()
        for w, (a, b) in parts.items():
            known[w] = known[a] + known[b]

    def _learn_letters(self, words: list[str]) -> None:
        """Words of letters alone in one text, cut where a word ends; any that are cut otherwise are left out."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4") if words else ()
        ends = np.flatnonzero(self.closes[ids]) + 1 if len(ids) else ()
        if len(ends) != len(words):
            half = len(words) // 2
            if half:
                self._learn_letters(words[:half])
                self._learn_letters(words[half:])
            return
        data, at = ids.tobytes() if len(ids) else b"", 0
        for w, end in zip(words, (4 * ends).tolist() if len(ids) else (), strict=True):
            self.known[w] = data[at:end]
            at = end


_words: dict[str, WordIds] = {}


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` for all rows of ``docs(doc_id, text)``.

    A document is its ids and ``end_id``; what is longer than ``capacity`` is cut, the last piece may be shorter.
    A null text is empty (one piece with the end alone); null and repeated ids keep their rows.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _words:
            _words[tokenizer] = WordIds(tokenizer)
        ids = _words[tokenizer]
        end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for first in range(0, len(b["text"]), DOCS):
                split = list(map(split_words, b["text"][first : first + DOCS]))
                for doc_id, encoded in zip(b["doc_id"][first : first + DOCS], ids.encode(split), strict=True):
                    data = encoded + end
                    for piece, at in enumerate(range(0, len(data), width)):
                        part = data[at : at + width]
                        for c, v in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            out[c].append(v)
            yield out

    return map_batches(columns(docs, doc_id="long", text="string"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Place(NamedTuple):
    """Items of one length and ranks [rank, rank + items) go, per_bin to each, to bins from ``bin`` on, at ``offset``."""

    length: int
    rank: int
    items: int
    bin: int
    per_bin: int
    offset: int


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes within the capacity whose value is greatest (an unbounded knapsack)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i in np.argsort(-values / sizes):
        s, v = int(sizes[i]), values[i]
        if v <= 0:
            continue
        for at in range(s, capacity + 1, s):
            to = min(at + s, capacity + 1)
            tried = best[at - s : to - s] + v
            better = tried > best[at:to] + 1e-12
            best[at:to][better] = tried[better]
            last[at:to][better] = i
    found, room = np.zeros(len(sizes), dtype=np.int64), int(np.argmax(best))
    while last[room] >= 0:
        found[last[room]] += 1
        room -= int(sizes[last[room]])
    return found


def configurations(sizes: np.ndarray, demands: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each: the linear program by column generation, rounded down."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(k))
        new = best_configuration(sizes, duals, capacity)
        if duals @ new <= 1 + 1e-4:
            break
        used, step = np.linalg.solve(basis, demands.astype(float)), np.linalg.solve(basis, new.astype(float))
        ratios = np.where(step > 1e-9, np.maximum(used, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratios))] = new
    used = np.linalg.solve(basis, demands.astype(float))
    return [(basis[:, j].astype(np.int64), int(used[j] + 1e-6)) for j in range(k) if used[j] >= 1 - 1e-6]


def plan_packing(histogram: dict[int, int], capacity: int, groups: int = 24, small: float = 1 / 4) -> list[Place]:
    """Where the items of each length go. Work and size depend on the number of different lengths alone.

    1. Lengths over ``small * capacity`` are dealt, longest first, into ``groups`` groups of equal cardinality,
       and count as the longest of their group.
    2. The few sizes that remain are packed by the best configurations.
    3. Actual items take the slots of their group, longest first, which leaves gaps.
    4. What is left over and the small items are put, longest first, where they fit best; new bins come last.
    """
    places: list[Place] = []
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: runs (bin, count)
    has = np.zeros(capacity + 1, dtype=bool)
    bins = 0
    left = {n: [(0, c)] for n, c in histogram.items() if c}  # runs of ranks not placed yet

    def gap(size: int, run: tuple[int, int]) -> None:
        if size and run[1]:
            free[size].append(run)
            has[size] = True

    large = sorted((n for n in left if small * capacity < n), reverse=True)
    total = sum(histogram[n] for n in large)
    if total:
        k = min(groups, total)
        dealt: list[list[list[int]]] = [[] for _ in range(k)]  # per group: [length, rank, count], longest first
        g, room = 0, (total + k - 1) // k
        bounds = [(j + 1) * total // k for j in range(k)]
        seen = 0
        for n in large:
            rank, count = 0, histogram[n]
            while count:
                while seen >= bounds[g]:
                    g += 1
                take = min(count, bounds[g] - seen)
                dealt[g].append([n, rank, take])
                rank, count, seen = rank + take, count - take, seen + take
        dealt = [d for d in dealt if d]
        sizes = np.array([d[0][0] for d in dealt])
        demands = np.array([sum(c for _, _, c in d) for d in dealt])
        merged, where = np.unique(sizes, return_inverse=True)
        need = np.bincount(where, weights=demands).astype(np.int64)
        queue = {int(m): [x for j in np.flatnonzero(where == i) for x in dealt[j]] for i, m in enumerate(merged)}
        for config, times in configurations(merged, need, capacity):
            runs = [(bins, times, 0)]
            bins += times
            for i in np.flatnonzero(config):
                for _ in range(int(config[i])):
                    items, split = queue[int(merged[i])], []
                    for first, count, used in runs:
                        while count and items:
                            n, rank, there = items[0]
                            take = min(count, there)
                            places.append(Place(n, rank, take, first, 1, used))
                            split.append((first, take, used + n))
                            first, count = first + take, count - take
                            items[0][1], items[0][2] = rank + take, there - take
                            if not items[0][2]:
                                items.pop(0)
                        if count:
                            split.append((first, count, used))
                    runs = split
            for first, count, used in runs:
                gap(capacity - used, (first, count))
        for n in large:
            left[n] = []
        for items in queue.values():
            for n, rank, count in items:
                left[n].append((rank, count))
    for n in sorted(left, reverse=True):
        for rank, count in left[n]:
            while count:
                size = n + int(np.argmax(has[n:]))
                if not has[size]:
                    size, per = capacity, capacity // n
                    gap(capacity, (bins, (count + per - 1) // per))
                    bins += (count + per - 1) // per
                first, there = free[size].pop()
                has[size] = bool(free[size])
                per = min(size // n, count)
                take = min(there, count // per)
                places.append(Place(n, rank, take * per, first, per, capacity - size))
                gap(size - per * n, (first, take))
                gap(size, (first + take, there - take))
                rank, count = rank + take * per, count - take * per
    return places


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, groups: int = 24) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row of ``docs``.

    Each sequence is filled from offset 0 without gaps and holds at most ``capacity`` tokens. Null texts are
    empty documents, null and repeated ids are packed like others, an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = materialize(tokenized_pieces(docs, tokenizer, capacity, end_id).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    salts = max(8, pieces.count() // ROWS_PER_TASK)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    counts = materialize(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    by_length: dict[int, list[Place]] = {}
    for p in plan_packing(histogram, capacity, groups):
        by_length.setdefault(p.length, []).append(p)
    plan = spark.sparkContext.broadcast({n: np.array(sorted(ps, key=lambda p: p.rank)) for n, ps in by_length.items()})

    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).select("length", "salt", "before")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")) - 1)
        .join(before, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    )

    def place(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            lengths, ranks = np.array(b["length"], dtype=np.int64), np.array(b.pop("rank"), dtype=np.int64)
            b["sequence_id"], b["offset"] = np.zeros_like(lengths), np.zeros_like(lengths)
            for n in np.unique(lengths):
                at, p = np.flatnonzero(lengths == n), plan.value[int(n)]
                p = p[np.searchsorted(p[:, 1], ranks[at], side="right") - 1]
                nth = ranks[at] - p[:, 1]
                b["sequence_id"][at] = p[:, 3] + nth // p[:, 4]
                b["offset"][at] = p[:, 5] + nth % p[:, 4] * n
            yield b

    return map_batches(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
