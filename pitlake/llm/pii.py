"""Personal data: generators propose overlapping spans, boosted trees score them, calibrated thresholds choose.

Spans that satisfy a strict format (the *base* spans of email, ip, card and phone) always stay; the trees decide
about all others. Labels come from evidence that the trees don't see in that form: of the candidates of all
documents, base spans are positive, and so are renderings of them that no strict format takes (spelled-out
signs, other grouping, no country code), put in their place; numbers that fail a checksum or a range, or that lie in
a base span of another kind, are negative, and so are positive spans with a part changed. A secret is positive where two generators agree (a naming cue, and a
key-like value) and when such a value stands without its cue; values without key-like form are negative. What has no
such evidence has no label.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.llm.boosting import BoostedTrees, coarse
from pitlake.llm.common import TEXT_ROWS, columns, is_small, map_batches, map_text, materialize

KINDS = ("email", "ip", "card", "phone", "secret")
#: Different rows of bins up to which the driver adds them up itself; tasks do so, to the same sums, beyond.
LOCAL_ROWS = 50_000
#: Steps of the scores between 0 and 1, for the thresholds.
LEVELS = 1 << 16
#: Precision that an added span's score must have reached on held-out candidates of its kind.
PRECISION = 0.98

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MAYBE = re.compile(r"[0-9@=:\[(]")
#: High-recall generators, each of which reads a text in linear time.
LOOSE = {
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]++\s{0,2}(?:@|[\[(]\s?at\s?[\])])\s{0,2}[\w-]++(?:(?:\.|\s{0,2}[\[(]\s?dot\s?[\])]\s{0,2})[\w-]++)+", re.I),
    "ip": re.compile(r"(?<![\d.])\d{1,4}+(?:[.,]\d{1,4}){2,5}(?![\d.])"),
    "card": re.compile(r"(?<![\w-])\d(?:[ .-]?\d){11,22}(?![\w-])"),
    "phone": re.compile(r"(?<!\w)(?:\+|\()?\d(?:[ ().-]{0,3}\d){6,15}(?!\w)"),
    "secret": re.compile(r"\b(?:password|passwd|pwd|token|secret|api[_-]?key|key)\s{0,2}[=:]\s{0,2}[\"']?[^\s\"']{6,}+|(?<!\w)(?=[A-Z]*+[0-9])(?=[0-9]*+[A-Z])[A-Z0-9]{16,}+(?!\w)|(?<!\w)(?=[a-f]*+[0-9])(?=[0-9]*+[a-f])[0-9a-f]{16,}+(?!\w)", re.I),
}
CUE_NAME = re.compile(r"(?:password|passwd|pwd|token|secret|api[_-]?key|key)\s{0,2}[=:]\s{0,2}[\"']?", re.I)
CUES = tuple(re.compile(p, re.I) for p in (r"mail|contact|write", r"\bip\b|host|server|addr", r"card|visa|pay|credit", r"tel|phone|call|fax|mobile", r"password|token|secret|key|login", r"version|license|chapter|section|no\."))


class Taken:
    """Intervals that don't overlap, in order: whether another one meets them takes one search."""

    def __init__(self, spans: Iterable[tuple[str, int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start

    def add(self, start: int, end: int) -> None:
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The strict spans of each kind, leftmost and not overlapping within a kind, in order of kind and start."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Proposed spans, which may overlap: the base and what the loose generators find."""
    return list(dict.fromkeys([*base, *((kind, *m.span()) for kind, pattern in LOOSE.items() for m in pattern.finditer(text))]))


def key_like(value: str) -> bool:
    """Long, without spaces, of letters and digits mixed."""
    value = value.strip("\"'.,;")
    return len(value) >= 12 and any(map(str.isdigit, value)) and any(map(str.isalpha, value)) and sum(map(str.isalnum, value)) >= 0.8 * len(value)


def label_of(text: str, span: tuple[str, int, int], base: set[tuple[str, int, int]], taken: Taken) -> bool | None:
    """Whether evidence says that the span is personal data; None without evidence. ``taken`` are the places of the base."""
    kind, start, end = span
    if span in base:
        return True
    if taken.meets(start, end):
        return False
    s = text[start:end]
    runs = re.findall(r"[0-9]+", s)
    if kind == "secret":
        cue = CUE_NAME.match(s)
        value = s[cue.end() :] if cue else s
        return key_like(value) if cue else False if value.isdigit() else None
    if kind == "card":
        return luhn("".join(runs)) and 13 <= sum(map(len, runs)) <= 19
    if kind == "ip":
        return False if len(runs) != 4 or any(len(r.lstrip("0")) > 3 or int(r) > 255 for r in runs) else None
    return False if kind == "phone" and len(runs) == 1 else None


def renderings(kind: str, s: str) -> list[str]:
    """Ways to write a positive span that strict formats don't take."""
    if kind == "email":
        local, _, domain = s.partition("@")
        return [f"{local} [at] {domain.replace('.', ' [dot] ')}", f"{local} (at) {domain}", f"{local}[at]{domain.replace('.', '[dot]')}"]
    if kind == "phone":
        plain = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", s)
        return [plain, re.sub(r"[^0-9]+", "-", plain).strip("-"), re.sub(r"[^0-9]+", ".", plain).strip(".")] if re.search(r"[^0-9]", plain) else []
    if kind == "card":
        digits = re.sub(r"[^0-9]", "", s)
        return [".".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    if kind == "secret" and (cue := CUE_NAME.match(s)):
        return [value for value in (s[cue.end() :].strip("\"'"),) if LOOSE["secret"].fullmatch(value)]
    return []


def spoilt(kind: str, s: str) -> list[str]:
    """Ways to change a positive span into what is like it and isn't personal data."""
    runs = re.findall(r"[0-9]+", s)
    if kind == "ip":
        return [".".join(runs[:3]), ".".join([str(int(runs[0]) + 300), *runs[1:]]), ".".join([*runs, "1"]), ".".join(r.rjust(4, "4") for r in runs)]
    if kind == "card":
        return [s[:-1] + str((int(s[-1]) + 1) % 10)]
    if kind == "phone":
        return ["".join(runs), f"20{runs[-1][:2]}-{runs[-1][:2]}-{runs[-1][-2:]}"]
    return [cue[0] + "waiting"] if kind == "secret" and (cue := CUE_NAME.match(s)) else []


def examples(text: str) -> list[tuple[str, bool, list[float]]]:
    """Kind, label and features of the labelled candidates of a text, and of the positive ones written otherwise or spoilt."""
    base, out = base_spans(text), []
    strict, taken = set(base), Taken(base)
    for span in candidates(text, base):
        y = label_of(text, span, strict, taken)
        if y is None:
            continue
        kind, start, end = span
        out.append((kind, y, span_features(text, kind, start, end)))
        for right, write in ((True, renderings), (False, spoilt)) if y else ():
            for other in write(kind, text[start:end]):
                near = text[max(0, start - 64) : start] + other + text[end : end + 2]
                at = min(64, start)
                out.append((kind, right, span_features(near, kind, at, at + len(other))))
    return out


def span_features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and words near it."""
    s, n = text[start:end], max(1, end - start)
    digits = [c for c in s if c.isdigit()]
    counts, near = Counter(s), text[max(0, start - 32) : start]
    runs = re.findall(r"\d+", s)
    return [
        *(float(kind == k) for k in KINDS), float(n), len(digits) / n, float(len(digits)), sum(map(str.isupper, s)) / n, sum(map(str.isalpha, s)) / n,
        float(sum(not c.isalnum() for c in s)), len(counts) / n, -sum(c / n * math.log2(c / n) for c in counts.values()), float(max(map(len, runs), default=0)), float(len(runs)),
        float(bool(digits) and luhn("".join(d for d in digits if d in "0123456789"))), float(all(len(r) <= 3 and int(r) <= 255 for r in runs)), float(s[:1] == "+"), float("@" in s), float(s.count(".")), float("=" in s or ":" in s), float(s[:4].upper() == "AKIA"),
        float(start > 0 and text[start - 1].isalnum()), float(end < len(text) and text[end].isalnum()), *(float(bool(c.search(near))) for c in CUES), *(float(bool(c.search(s))) for c in CUES[4:5]),
    ]


class Redactor:
    """Fitted trees and the threshold of each kind; without trees only base spans are chosen.

    ``report`` has for each kind the held-out labelled candidates, positive ones, chosen ones and right ones.
    """

    def __init__(self, trees: BoostedTrees | None, thresholds: dict[str, float], report: dict[str, tuple[int, int, int, int]] | None = None):
        self.trees, self.thresholds, self.report = trees, thresholds, report or {}

    def choose(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans, and with them those over their threshold that overlap nothing chosen, best first."""
        if not text or not MAYBE.search(text):
            return [], []
        base = base_spans(text)
        chosen, taken, rest = list(base), Taken(base), candidates(text, base)[len(base) :]
        rest = [c for c in rest if c[0] in self.thresholds and not taken.meets(c[1], c[2])]
        if rest and self.trees:
            scores = self.trees.predict(np.array([span_features(text, *c) for c in rest], dtype=np.float64))
            for s, c in sorted(zip(scores, rest, strict=True), key=lambda x: (-x[0], x[1][1], x[1][2], x[1][0])):
                if s >= self.thresholds[c[0]] and not taken.meets(c[1], c[2]):
                    chosen.append(c)
                    taken.add(c[1], c[2])
        in_order = lambda spans: sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
        return in_order(base), in_order(chosen)


def labelled(docs: DataFrame) -> DataFrame:
    """``kind, y, features, held`` of the different labelled candidates of all documents; a fifth is held out. Written once."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            found = {(k, y, tuple(f)) for t in b["text"] if MAYBE.search(t) for k, y, f in examples(t)}
            yield {"kind": [k for k, _, _ in found], "y": [y for _, y, _ in found], "features": [f for _, _, f in found]}

    told = map_batches(columns(docs, text="string").where("text is not null"), run, "kind string, y boolean, features array<double>").dropDuplicates()
    return materialize(told.withColumn("held", F.pmod(F.shiftright(F.xxhash64("kind", "features"), 8), F.lit(5)) == 0), "examples")


def histograms(told: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per feature its values, cut to nine bits, and how many examples have them: a few thousand at most, whatever the rows."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            found = [np.unique(column, return_counts=True) for column in coarse(np.array(b["features"])).T]
            yield {"feature": np.repeat(range(len(found)), [len(v) for v, _ in found]), "value": np.concatenate([v for v, _ in found]), "n": np.concatenate([n for _, n in found])}

    rows = map_batches(told.select("features"), run, "feature int, value double, n long").groupBy("feature", "value").agg(F.sum("n").alias("n")).collect()
    feature, value, n = np.array([r.feature for r in rows]), np.array([r.value for r in rows]), np.array([r.n for r in rows])
    return [(value[feature == f], n[feature == f]) for f in range(feature.max() + 1)]


def binned(told: DataFrame, trees: BoostedTrees) -> DataFrame:
    """``kind, held, bins, right, wrong``: the different rows of bins, and how many examples of each label lie there."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            y = np.array(b["y"], dtype=np.int64)
            yield {"kind": [KINDS.index(k) for k in b["kind"]], "held": b["held"], "bins": [r.tobytes() for r in trees.binned(np.array(b["features"]))], "right": y, "wrong": 1 - y}

    rows = map_batches(told, run, "kind int, held boolean, bins binary, right long, wrong long")
    return materialize(rows.groupBy("kind", "held", "bins").agg(F.sum("right").alias("right"), F.sum("wrong").alias("wrong")), "bins")


def adder(rows: DataFrame, features: int, local_rows: int) -> Callable[[Callable, int], np.ndarray]:
    """``add(fn, size)``: the sum of the arrays ``fn(kind, bins, right, wrong)`` of ``size`` whole numbers over all ``rows``.

    Up to ``local_rows`` rows are added on the driver; beyond, every task adds its own and Spark adds those.
    """
    arrays = lambda b: (np.array(b["kind"]), np.frombuffer(b"".join(b["bins"]), dtype=np.uint8).reshape(-1, features), np.array(b["right"]), np.array(b["wrong"]))
    if is_small(rows, local_rows):
        found = rows.select("kind", "bins", "right", "wrong").collect()
        own = arrays({c: [r[c] for r in found] for c in ("kind", "bins", "right", "wrong")})
        return lambda fn, size: fn(*own)

    def add(fn: Callable, size: int) -> np.ndarray:
        def run(batches: Iterator[dict]) -> Iterator[dict]:
            total = np.zeros(size, dtype=np.int64)
            for b in batches:
                total += fn(*arrays(b))
            at = np.flatnonzero(total)
            yield {"at": at, "n": total[at]}

        total = np.zeros(size, dtype=np.int64)
        for r in map_batches(rows, run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            total[r.at] = r.n
        return total

    return add


def calibrated(right: np.ndarray, rows: np.ndarray, precision: float) -> float:
    """The threshold from the examples, and the right ones, at each level of the score; infinite if none will do."""
    at = np.flatnonzero(rows)[::-1]
    at = at[at >= LEVELS // 2]
    good = np.flatnonzero(np.cumsum(right[at]) >= precision * np.cumsum(rows[at]))
    if not len(good):
        return math.inf
    below = at[good[-1] + 1] + 1 if good[-1] + 1 < len(at) else LEVELS // 2
    return float(at[good[-1]] + below) / 2 / LEVELS


def fit(docs: DataFrame, precision: float = PRECISION, local_rows: int = LOCAL_ROWS, rounds: int = 40) -> Redactor:
    """Trees and thresholds from the different labelled candidates of all documents.

    Candidates are counted by their bins of the features' quantiles, and trees and thresholds need sums of those alone. A fifth
    is held out to calibrate: the threshold of a kind lies under the lowest score from which on the held-out precision is
    reached, half way to the next. Without such a score, or without candidates of both labels, nothing of the kind is added.
    """
    told = labelled(docs)
    n = {(r.held, r.y): r["count"] for r in told.groupBy("held", "y").count().collect()}
    if len({y for _, y in n}) < 2:
        return Redactor(None, {})
    apart = any(held for held, _ in n) and (False, True) in n and (False, False) in n
    told = told if apart else told.withColumn("held", F.lit(False))
    fitted, right, wrong = told.where("not held"), *(n.get((False, y), 0) + (0 if apart else n.get((True, y), 0)) for y in (True, False))
    trees = BoostedTrees(rounds)
    trees.cut(histograms(fitted))
    rows = binned(told, trees)
    add = adder(rows.where("not held"), len(trees.cuts), local_rows)

    def sums(splits: list[tuple[int, int]]) -> np.ndarray:
        shape = trees.shape(splits)
        return add(lambda _, bins, right, wrong: trees.level(bins, right, wrong, splits).ravel(), math.prod(shape)).reshape(shape)

    trees.fit(right / (right + wrong), sums)
    shape = (2, len(KINDS), LEVELS + 1)

    def levels(kind: np.ndarray, bins: np.ndarray, right: np.ndarray, wrong: np.ndarray) -> np.ndarray:
        at = kind * shape[2] + np.floor(trees.predict_binned(bins) * LEVELS).astype(np.int64)
        return np.concatenate([np.bincount(at, w, shape[1] * shape[2]) for w in (right, right + wrong)]).astype(np.int64)

    check = adder(rows.where("held") if apart else rows, len(trees.cuts), local_rows)(levels, math.prod(shape)).reshape(shape)
    thresholds, report = {}, {}
    for kind, good, every in zip(KINDS, *check, strict=True):
        least = calibrated(good, every, precision)
        if least < math.inf:
            thresholds[kind] = least
        taken = np.arange(LEVELS + 1) >= least * LEVELS
        report[kind] = (int(every.sum()), int(good.sum()), int(every[taken].sum()), int(good[taken].sum()))
    return Redactor(trees, thresholds, report)


def find(docs: DataFrame, redactor: Redactor) -> DataFrame:
    """``doc_id, base, spans`` for every row of ``docs(doc_id, text)``: arrays of (kind, start, end) in code points, in
    order of kind and start.

    Nulls and repeated rows stay; a null or empty text has no spans; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(redactor)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        as_dicts = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for b in batches:
            chosen = list(map(shared.value.choose, b["text"]))
            yield {"doc_id": b["doc_id"], "base": [as_dicts(c[0]) for c in chosen], "spans": [as_dicts(c[1]) for c in chosen]}

    span = "array<struct<kind:string,start:int,end:int>>"
    return map_batches(columns(docs, doc_id="long", text="string"), run, f"doc_id long, base {span}, spans {span}", TEXT_ROWS)


def find_in(docs: DataFrame) -> DataFrame:
    """:func:`find` with trees fitted on ``docs`` itself."""
    return find(docs, fit(docs))


def span_text(spans: list[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def digest(spans: list[dict]) -> str:
    return hashlib.sha256(span_text(spans).encode()).hexdigest()


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span replaced by its kind in brackets; ``n_chars``, where there is one, follows.

    All other columns pass by untouched, whatever they are called; nulls and repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def clean(text: str | None) -> str | None:
        spans, out, at = shared.value.choose(text)[1], [], 0
        for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        return "".join([*out, text[at:]]) if spans else text

    return map_text(docs, lambda: clean)
