"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

In byte-pair encoding a token sequence is an encoding exactly if each adjacent pair of tokens encodes to
itself. So the encoding of a prefix is the encoding of a shorter prefix plus one token, and only one token
that ends there fits the token before it. One pass over the bytes of a pre-token therefore gives the count of
each of its prefixes, in time linear in its length. Between pre-tokens the counts add up, apart from a run of
white space, whose last character belongs to what follows; a *unit* (white space and what follows it) is
hence the piece that is counted once and kept.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import accumulate
from operator import sub

import ahocorasick
import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlake.llm.common import columns, map_batches

WS = r"\p{White_Space}"
#: The contractions and the pre-token pattern of the byte-level vocabulary.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
PRE_TOKEN = regex.compile(rf"{'|'.join(CONTRACTIONS)}| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|{WS}+(?![^{WS}])|{WS}+")
UNIT = regex.compile(rf"(?:{WS}*[^\P{{White_Space}} ])?(?:{'|'.join(CONTRACTIONS)})|{WS}*(?:\p{{L}}+|\p{{N}}+|[^{WS}\p{{L}}\p{{N}}]+)|{WS}+")
LEADING = regex.compile(rf"{WS}*")
#: Units that a worker keeps before it starts anew.
CACHE = 500_000


def byte_characters() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    """Counts for one byte-level vocabulary file; ``special`` strings count as one token each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_characters()
        vocab = spec["model"]["vocab"]
        plain = {t: bytes(chars[c] for c in t) for t in vocab if all(c in chars for c in t)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ids = {b: vocab[t] for t, b in plain.items() if t not in self.special}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.ends = ahocorasick.Automaton()  # all tokens that end at a byte, bytes standing as Latin-1
        for b, i in self.ids.items():
            self.ends.add_word(b.decode("latin-1"), (len(b), i))
        self.ends.make_automaton()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.fits_cache: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.tokens: dict[str, int] = {}
        self.deltas: dict[str, bytes] = {}

    def encode_piece(self, data: bytes) -> list[int]:
        """The merges carried out on a short byte string."""
        ids = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            best = min((self.merges[p] + (i,) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges), default=None)
            if best is None:
                break
            _, new, i = best
            ids[i : i + 2] = [new]
        return ids

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a within one pre-token."""
        got = self.fits_cache.get((a, b))
        if got is None:
            if len(self.fits_cache) > 4 * CACHE:
                self.fits_cache.clear()
            got = self.fits_cache[a, b] = self.encode_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def prefix_counts(self, piece: str) -> list[int]:
        """Token counts of the prefixes of one pre-token, by code points from 0."""
        got = self.pieces.get(piece)
        if got is not None:
            return got
        data = piece.encode("utf-8", "surrogatepass")
        last, count, fits = [-1] * (len(data) + 1), [0] * (len(data) + 1), self.fits_cache
        for at, (size, token) in self.ends.iter(data.decode("latin-1")):
            if last[at + 1] < 0:
                start = at + 1 - size
                ok = not start or fits.get((last[start], token))
                if ok or (ok is None and self.fits(last[start], token)):
                    last[at + 1], count[at + 1] = token, count[start] + 1
        got = [count[e] for e in accumulate((len(c.encode("utf-8", "surrogatepass")) for c in piece), initial=0)] if len(data) > len(piece) else count
        if len(piece) <= 2:
            self.pieces[piece] = got
        return got

    def unit_counts(self, unit: str) -> list[int]:
        """Token counts of the prefixes of a unit, by code points from 0, each as a text that ends there."""
        space = LEADING.match(unit)[0]
        out, rest = list(self.prefix_counts(space)) if space else [0], unit[len(space) :]
        if not rest:
            return out
        if space.endswith(" "):
            base, rest = self.prefix_counts(space[:-1])[-1] if len(space) > 1 else 0, " " + rest
            return out + [base + n for n in self.prefix_counts(rest)[2:]]
        base = (self.prefix_counts(space[:-1])[-1] if len(space) > 1 else 0) + (self.prefix_counts(space[-1])[-1] if space else 0)
        if rest in CONTRACTIONS:
            return out + [base + sum(self.prefix_counts(p)[-1] for p in PRE_TOKEN.findall(rest[:j])) for j in range(1, len(rest) + 1)]
        return out + [base + n for n in self.prefix_counts(rest)[1:]]

    def learn(self, units: list[str]) -> None:
        """Count the units that are not kept yet."""
        if len(self.tokens) > CACHE:
            self.tokens.clear()
            self.deltas.clear()
        for u in units:
            if u not in self.tokens:
                counts = self.unit_counts(u)
                self.tokens[u] = counts[-1]
                self.deltas[u] = array("h", map(sub, counts[1:], counts)).tobytes()

    def text(self, text: str) -> tuple[int, bytes]:
        """Tokens of a whole text, and the changes of the prefix count at each code point."""
        total, parts = 0, []
        at = 0
        for m in self.split_special.finditer(text) if self.split_special else ():
            n, deltas, tail = self._plain(text[at : m.start()])
            total += n
            parts.append(deltas)
            before = total - (self._plain(tail)[0] if tail else 0)
            counts = [total] + [before + self._plain(tail + m[0][:j])[0] for j in range(1, len(m[0]))] + [total + 1]
            parts.append(array("h", map(sub, counts[1:], counts)).tobytes())
            total += 1
            at = m.end()
        n, deltas, _ = self._plain(text[at:])
        return total + n, b"".join([*parts, deltas])

    def _plain(self, text: str) -> tuple[int, bytes, str]:
        units = UNIT.findall(text)
        self.learn(units)
        return sum(map(self.tokens.__getitem__, units)), b"".join(map(self.deltas.__getitem__, units)), units[-1] if units else ""


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, prefix_deltas`` for every row of ``docs(doc_id, text)``.

    ``prefix_deltas`` holds, per code point, the change of the exact token count when the prefix grows by it
    (little-endian int16); :func:`count_at` and :func:`truncate_to_budget` read it without encoding again.
    A null text counts as empty, null or repeated ids keep their rows, an empty table gives none.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        count = counter(tokenizer)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            got = list(map(count.text, texts))
            yield {"doc_id": b["doc_id"], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": [n for n, _ in got], "prefix_deltas": [d for _, d in got]}

    return map_batches(columns(docs, doc_id="long", text="string"), run, "doc_id long, n_bytes long, n_tokens long, prefix_deltas binary")


def count_at(deltas: str | Column, n_chars: str | Column) -> Column:
    """Tokens of the prefix of ``n_chars`` code points; beyond the text, of the whole text."""

    @F.pandas_udf(T.LongType())
    def at(d, n):
        import pandas as pd

        return pd.Series([None if x is None else int(np.frombuffer(x, "<i2")[: max(0, int(k))].sum(dtype=np.int64)) for x, k in zip(d, n, strict=True)], dtype="Int64")

    return at(deltas, n_chars)


def truncate_to_budget(deltas: str | Column, budget: int) -> Column:
    """Code points of the longest prefix that has at most ``budget`` tokens."""

    @F.pandas_udf(T.LongType())
    def cut(d):
        import pandas as pd

        def longest(x):
            counts = np.cumsum(np.frombuffer(x, "<i2"), dtype=np.int64)
            fitting = np.flatnonzero(counts <= budget)
            return int(fitting[-1]) + 1 if len(fitting) else 0

        return pd.Series([None if x is None else longest(x) for x in d], dtype="Int64")

    return cut(deltas)
