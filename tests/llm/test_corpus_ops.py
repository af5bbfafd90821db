"""Operators over whole corpora against brute-force versions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pitlake.llm import ann, common, hashing, jaccard_join, lm, queries

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split((text or "").encode().lower()) if w]


def brute_components(rows, n, num, den):
    sets = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if (w := words(t)) else set() for _, t in rows]
    label = list(range(len(rows)))
    link = np.zeros(len(rows), dtype=int)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                link[i] += 1
                link[j] += 1
                label[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return [(d, len(sets[i]), min((x for x in least[root(i)] if x is not None), default=None), int(link[i])) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, n, num):
    rng = np.random.default_rng(num)
    say = lambda k: list(rng.choice([f"w{i}" for i in range(400)], k))
    texts = []
    for size in (4, 8, 9, 12, 20, 30, 60, 61, 120, 200):
        base = say(size)
        for _ in range(14):
            w = list(base)
            for at in rng.integers(0, size, int(rng.integers(0, 2 + size // 25))):
                w[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(w[: size - int(rng.integers(0, 2 + size // 30))]))
    hot = say(50)
    texts += [" ".join(say(10) + hot + say(10)) for _ in range(40)] + ["", " \n", None, "one", "ONE", "one two", "one\ttwo", "a  b c"]
    rows = [(None if i in (3, 150) else i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, "other text of id seven here")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, sig string, cid int")
    got = [tuple(r) for r in jaccard_join.jaccard_components(docs, n, num, 100).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute_components(rows, n, num, 100), key=key)


def test_jaccard_large_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for at in rng.integers(0, 150, int(rng.integers(0, 7))):
            w[at] = f"x{i}_{at}"
        rows.append((i, " ".join(w)))
    got = {tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == set(brute_components(rows, 3, 90, 100))
    assert jaccard_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registered_join_on_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {tuple(r) for r in queries.op3_ngram_jaccard_join(spark, SF).collect()}
    assert got == set(brute_components(rows, 3, 90, 100))


def test_connected_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 301), (301, 300)]
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    parts = defaultdict(set)
    for r in got:
        parts[r.label].add(r.node)
    assert sorted(map(sorted, parts.values())) == [list(range(41)), list(range(100, 140)), [200], [300, 301]]


def test_neighbours_recall_and_ties(spark):
    got = queries.op6_multi_index_hashing(spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in ids.tolist() if i % 100 == 0}
    right = 0
    for q, near in found.items():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        right += len({ids[i] for i in order} & {v for _, v, _ in near})
        assert [n for n, _, _ in near] == list(range(1, 11))
        assert all(abs(s - d[ids == v][0]) < 1e-12 for _, v, s in near)
    assert right / (10 * len(found)) >= 0.9


def test_neighbours_leave_out_unusable_vectors(spark):
    v = lambda *x: [float(i) for i in x] + [1.0] * 14
    rows = [(0, v(1, 2)), (1, v(1, 2)), (2, v(1, 3)), (2, v(1, 3)), (3, None), (4, [0.0] * 16), (5, v(float("nan"), 1)), (6, [None] + [1.0] * 15), (None, v(1, 2)), (7, v(float("inf"), 1)), (8, [1.0])]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id long, embedding array<float>, v int")
    got = ann.search(df, "vec_id % 100 = 0", k=10).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 0.0), (0, 2, 2, 1.0)]
    assert ann.search(df.limit(0), "vec_id % 100 = 0").count() == 0


def test_multi_index_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 1 << 16, (500, 4)).astype(np.uint16)
    index = ann.MultiIndex(rows)
    for radius in (0, 3, 9, 22, 64):
        near = np.flatnonzero(np.bitwise_count(rows ^ rows[7]).sum(axis=1) <= radius)
        assert index.within(rows[7], radius).tolist() == near.tolist()


@pytest.mark.parametrize("head", [10**6, 50])
def test_scores_base_equals_brute_force(spark, head):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(10**6 + 1, None), (10**6 + 2, "")], "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in rows if not held(d) for w in [*words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    got = lm.score(docs, queries.crc_fold(7) == 2, head_words=head).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        tokens = [*words(texts[r.doc_id]), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens), rel=1e-9)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_scores_equal_quantised_counts(spark):
    """Broadcast or dealt by range, the filter gives the levels of exact counts, but for rare false hits."""
    rng = np.random.default_rng(1)
    train = [" ".join(f"w{i}" for i in rng.zipf(1.3, 60) % 500) for _ in range(300)]
    unseen = [" ".join(f"w{i}" for i in rng.permutation(700)[:40]) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(train), *((1000 + i, t) for i, t in enumerate([*train[:40], *unseen, None, ""]))], "doc_id long, text string")
    got, dealt = ({r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") >= 1000, filter_bytes=most).collect()} for most in (1 << 30, 0))
    assert got == dealt
    singles, pairs = Counter(), Counter()
    for t in train:
        tokens = [*words(t), None]
        singles.update(tokens)
        pairs.update(zip([None, *tokens], tokens, strict=False))
    level = lambda c: (lambda n: 2.0**n * (1.4 if n else 1.0))(math.floor(math.log2(c))) if c else 0.0
    whole, exact, off = sum(singles.values()) + len(singles) + 1, 0, []
    for i, t in enumerate([*train[:40], *unseen, None, ""]):
        tokens = [*words(t), None]
        p = [(0.2 * min(1, level(pairs[a, b]) / max(1, level(singles[a]))) + 0.8 * (level(singles[b]) + 1) / whole) if singles[a] else (level(singles[b]) + 1) / whole for a, b in zip([None, *tokens], tokens, strict=False)]
        off.append(abs(got[1000 + i] - sum(map(math.log10, p))) / len(tokens))
        exact += off[-1] < 1e-9
    assert exact > 0.1 * len(off) and np.median(off) < 0.02 and max(off) < 0.4, (exact, np.median(off), max(off))  # a false hit moves one token
    assert all(lm.score(docs.limit(0), F.lit(False), filter_bytes=most).count() == 0 for most in (1 << 30, 0))


def test_filter_holds_quantised_counts():
    rng = np.random.default_rng(0)
    hashes = np.unique(rng.integers(0, 1 << 64, 6000, dtype=np.uint64))
    counts = rng.integers(1, 5000, len(hashes))
    shift = lm._shift(8)
    parts = [(b, lm.sub_filter(hashes[own], counts[own])) for b in (0, 1, 2, 4, 5, 6, 7) if (own := (hashes >> shift) == b).any()]
    read = lm.LogFrequencyFilter(parts, 8)
    there = (hashes >> shift) != 3
    levels = read.levels(hashes)
    assert (levels[there] >= lm._levels(counts[there])).all() and (levels[~there] == 0).all()  # none is missed, none without its range
    assert (levels[there] == lm._levels(counts[there])).mean() > 0.9
    assert (read.levels(hashing.mix(hashes + np.uint64(1))) > 0).mean() < 0.1


def test_pipeline_stages(spark):
    docs = common.read_table(spark, LARGER, "documents")
    kept = docs
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.materialize(stage(spark, kept, LARGER), "test_stage")
        assert kept.columns == docs.columns
        counts.append(kept.count())
    assert counts[0] >= counts[1] > counts[2] >= counts[3] == counts[4] > 0.5 * counts[0]
    toxic = {r.doc_id for r in common.read_table(spark, LARGER, "labels").where("toxic = 1").collect()}
    clean = {r.doc_id for r in common.read_table(spark, LARGER, "labels").where("toxic = 0").collect()}
    passed = {r.doc_id for r in corpus_pipeline.toxicity_filter(spark, docs, LARGER).select("doc_id").collect()}
    assert len(toxic & passed) < 0.4 * len(toxic)  # few labels at this size
    assert len(clean & passed) > 0.98 * len(clean)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, LARGER)
    assert packed.select("doc_id").distinct().count() == counts[-1]
    assert corpus_pipeline.run(spark, LARGER).count() == packed.count()


def test_near_duplicate_stage_with_odd_rows(spark):
    rows = [(1, "a b c d e f g", 1), (2, "a b c d e f g", 1), (3, None, 0), (None, "x y z", 0), (None, None, 0), (4, "", 0), (4, "", 0)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars int"), SF).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (0, "x y z"), (1, "a b c d e f g"), (3, ""), (4, "")]
