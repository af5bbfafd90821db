"""Source divergence, hard negatives and line dedup against brute-force versions, with their edge cases."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pitlake.llm import divergence, line_dedup, negatives

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")


def brute_audit(rows, least_docs, top):
    docs = [(lang or "", source or "", [t.lower() for t in TERM.findall((text or "").encode())]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        holds = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in holds.items() if n >= least_docs)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in own}}
        whole, v = sum(counts.values(), Counter()), len(kept)
        p = lambda c, t, v=v: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in counts.items():
            pairs = [(o, sum(f(p(c, t), p(oc, t)) for t in kept)) for o, oc in counts.items() if o != s]
            terms = [(t.decode(), f(p(c, t), p(whole, t))) for t in kept if c[t] > 0 and p(c, t) > p(whole, t)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def corpus(seed, docs, sources, vocabulary):
    rng = np.random.default_rng(seed)
    say = lambda: " ".join(f"Wort{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}é{'uvwxyz'[i % 6]}" for i in rng.zipf(1.4, int(rng.integers(0, 40))) % vocabulary)
    return [(["en", "de", None, ""][int(rng.integers(0, 4))], None if (s := int(rng.zipf(1.5)) % sources) == 3 else f"s{s}", say()) for _ in range(docs)]


@pytest.mark.parametrize("segment", [2, 512])
def test_audit_equals_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(divergence, "SEGMENT", segment)
    rows = corpus(1, 260, 9, 90) + [("fr", "a", None), ("fr", "b", "x1y2"), ("it", "only", "uno due")] * 3 + [("es", "x", "hola " * 500)] * 12 + [("es", "y", "")]
    docs = spark.createDataFrame([(i, *r, "clash", 1, 2) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n int, p0 int")
    got = sorted(tuple(r) for r in divergence.audit(docs, least_docs=5, top=4).collect())
    assert got == brute_audit(rows, 5, 4)


def test_audit_deals_large_source_tables(spark, monkeypatch):
    rows = corpus(2, 150, 7, 50)
    monkeypatch.setattr(divergence, "BROADCAST_SOURCES", 0)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(tuple(r) for r in divergence.audit(docs, least_docs=3).collect()) == brute_audit(rows, 3, 10)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_tree_shares_paths():
    s, p = np.array([[0, 1, 2], [0, 1, 2], [0, 1, -1]]), np.array([[9, 5, 4], [9, 5, 7], [9, 6, -1]])
    q, size = np.where(s >= 0, 3, -1), np.array([3, 3, 2])
    found = list(divergence.tree_corrections(s, p, q, size, np.zeros(3, int), np.array([True, False, False]), np.array([2, 1, 4])))
    f = lambda a, b: (a - b) ** 2 // (a + b)
    fix = lambda a, b: f(a, b) - f(a, 3) - f(3, b) + f(3, 3)
    sums = defaultdict(int)
    for _, a, b, value in found:
        for x, y, z in zip(a.tolist(), b.tolist(), value.tolist(), strict=True):
            sums[x, y] += z
    assert sums == {(0, 1): 3 * fix(9, 5) + 4 * fix(9, 6), (0, 2): 2 * fix(9, 4) + fix(9, 7), (1, 2): 2 * fix(5, 4) + fix(5, 7)}


def brute_negatives(rows, every, positives=5, negatives_=10):
    usable = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) and abs(float(x) * 256) < 2**31 - 1 for x in v):
            usable[i, label, tuple(int(np.floor(float(x) * 256)) for x in v)] = None
    out = []
    for a, la, va in usable:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, label) for i, label, v in usable if i != a and len(v) == len(va))
        for ps, pid, _ in [x for x in scored if x[2] == la][:positives]:
            fit = [x for x in scored if x[2] != la and 30 * -ps <= 100 * -x[0] <= 90 * -ps]
            out += [(a, pid, n + 1, i, -ps, -s) for n, (s, i, _) in enumerate(fit[:negatives_])]
    return sorted(out)


@pytest.mark.parametrize(("scale", "dim"), [(0.1, 16), (40.0, 3), (100000.0, 24), (1.0, 1)])
def test_negatives_equal_brute_force(spark, scale, dim, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 37)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 5)
    rng = np.random.default_rng(dim)
    rows = [(int(i), int(rng.integers(0, 3)), [float(np.float32(x)) for x in rng.normal(size=dim) * scale + scale / 3]) for i in range(240)]
    rows += [(i + 300, 1, rows[0][2]) for i in range(30)] + rows[10:14] + [(20, 2, rows[3][2]), (400, None, rows[0][2]), (None, 1, rows[0][2]), (410, 1, None), (420, 1, []), (430, 1, []), (440, 0, [])]
    rows += [(450, 1, [None] * dim), (460, 1, [float("nan")] * dim), (470, 1, [float("inf")] * dim), (480, 1, [1e30] * dim), (490, 1, [0.0] * dim), (500, 1, [2.0] * (dim + 1)), (510, 0, [1.5] * (dim + 1)), (520, 1, [1.0] * (dim + 1))]
    vectors = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, label int, embedding array<double>, v string, score int")
    got = sorted(tuple(r) for r in negatives.mine(vectors, "vec_id % 10 = 0").collect())
    assert got == brute_negatives(rows, 10) and got
    monkeypatch.setattr(negatives, "GROUP_BYTES", 16 * dim * 8)  # several groups of anchors
    assert sorted(tuple(r) for r in negatives.mine(vectors, "vec_id % 10 = 0").collect()) == got


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.mine(empty, "vec_id % 10 = 0").count() == 0
    one = spark.createDataFrame([(3, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.mine(one, "vec_id % 10 = 0").count() == 0


def test_residues_give_exact_scores():
    rng = np.random.default_rng(0)
    for most, d in ((2**31 - 2, 2), (1000, 3000), (1, 1), (2**20, 64)):
        a, b = (rng.integers(-most, most + 1, (7, d)) for _ in range(2))
        a[0], b[0], b[1] = most, most, -most
        primes = negatives.primes_for(d * most**2)
        x, y = negatives.cut_residues(a, primes), negatives.cut_residues(b, primes)
        got = negatives.reconstruct([negatives.product_mod(i, j, p).astype(np.int64) for i, j, p in zip(x, y, primes, strict=True)], primes)
        want = [[sum(int(i) * int(j) for i, j in zip(u, v, strict=True)) for v in b] for u in a]
        assert (got.astype(object) == np.array([[(w + 2**63) % 2**64 - 2**63 for w in r] for r in want], dtype=object)).all()


def brute_lines(rows, least_chars=20, least_docs=3):
    key = lambda line: re.sub(r"[A-Z]+", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    where = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                where[key(line)].add((d is not None, d or 0))
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        stays = [len(w := where.get(key(x), ())) < least_docs or (d is not None, d or 0) == max(w) for x in lines]
        out.append((d, len(lines), stays.count(False), hashlib.sha256("\n".join(x for x, s in zip(lines, stays, strict=True) if s).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranges", [1, 3, 23])
def test_line_dedup_equals_brute_force(spark, monkeypatch, ranges):
    rng = np.random.default_rng(ranges)
    pool = [f"{'Ä' * (i % 3)}line number {i} of the pool {'x' * (i % 5)}" for i in range(60)] + ["short", "", "   ", "a line of exactly 20c", "\t A Line OF exactly 20C\r"]
    pick = lambda: "\n".join(pool[min(i, 64)] + " " * int(rng.integers(0, 2)) for i in rng.zipf(1.3, int(rng.integers(1, 30))))
    rows = [(i, pick()) for i in range(150)] + [(None, pick()), (None, pool[1]), (7, pick()), (9, None), (10, ""), (11, "\n\n")]
    rows += [(200 + i, "the one line that a third of all has\nthe one line that a third of all has") for i in range(120)] + [(5, rows[5][1])] * 40 + [(999, "\n".join(pool * 300))]
    monkeypatch.setattr(line_dedup, "RANGE_ROWS", max(1, 26000 // ranges))
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, keep string, pos int")
        got = sorted((tuple(r) for r in line_dedup.kept_digests(docs).collect()), key=repr)
        assert got == brute_lines(rows)
        assert line_dedup.kept_digests(docs.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_runs_stream_in_any_batches():
    rng = np.random.default_rng(5)
    kinds = np.dtype([(c, "?" if c == "known" else "<i8") for c in line_dedup._ROW])
    rows = np.zeros(600, kinds)
    rows["hi"], rows["doc"], rows["known"], rows["pos"] = rng.zipf(1.5, 600) % 40, rng.integers(0, 9, 600), True, np.arange(600)
    rows = rows[np.lexsort((rows["pos"], -rows["doc"], rows["hi"]))]
    want = set()
    for h in set(rows["hi"].tolist()):
        own = rows[rows["hi"] == h]
        if len(set(own["doc"].tolist())) >= 3:
            want |= set(own["pos"][own["doc"] < own["doc"].max()].tolist())
    for step in (1, 2, 7, 50, 600):
        for cut in (0, 150, 431):  # where the first range ends
            found = []
            for part in (rows[:cut], rows[cut:]):
                runs = line_dedup.Runs(3)
                for at in range(0, len(part), step):
                    found += list(runs.feed(part[at : at + step]))
                found += list(runs.close(ends=True))
            drop = {int(p) for kind, r in found if kind == "drop" for p in r["pos"]}
            docs = defaultdict(set)
            for kind, r in found:
                if kind == "seen":
                    docs[int(r["hi"][0])] |= set(r["doc"].tolist())
            drop |= {int(x["pos"]) for kind, r in found if kind == "edge" for x in r if len(docs[int(x["hi"])]) >= 3 and x["doc"] < max(docs[int(x["hi"])])}
            assert drop == want


def test_bitmaps_give_the_kept_lines(spark):
    line = "a line that stands in several documents"
    docs = spark.createDataFrame([(1, f"one\n{line}\ntwo"), (2, line), (3, f"{line}\nthree")], "doc_id long, text string")
    joined = {r["doc_id"]: r for r in line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect()}
    kept = {i: line_dedup.kept_text(r["text"], r["keep"], r["n_lines"], r["n_dropped"]) for i, r in joined.items()}
    assert kept == {1: "one\ntwo", 2: "", 3: f"{line}\nthree"}
