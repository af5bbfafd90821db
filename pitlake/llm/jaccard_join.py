"""Exact n-gram Jaccard join of documents by a token-group matrix.

1. A document becomes the sorted hashes of its distinct word n-grams; documents with equal sets are one class.
2. A class is probed by its rarest n-grams. Linked sets of n n-grams share at least T = ceil(n * num / den), so of the
   first n - T + k n-grams in any order that all sets keep to, at least k are shared. The order puts frequent n-grams
   last, by a sketch of counts over all documents; how good the sketch is decides the work, never the result.
3. Groups: classes of about one size that share probes stand together, in blocks of bounded size.
4. The matrix: rows are n-grams, columns are groups before they are cut into blocks, and an entry says that the
   group's union holds the n-gram among its probes. A query can link into a column only if the union holds k of its
   probes, so its overlap is bounded before any set has moved; only sets of such pairs are sent, once each.
5. In a block the whole union bounds the overlap of each query again; opened blocks give exact intersections.
   Links give components by contraction.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.llm.common import columns, connected_components, join_bounded, map_batches, materialize
from pitlake.llm.hashing import C1, mix, word_hashes, words_of

#: Classes and n-grams that a block aims at, and queries that meet it in one task.
GROUP_CLASSES, GROUP_NGRAMS, TASK_QUERIES = 512, 400_000, 512
#: Counters of the sketch (one byte each when sent to the tasks), and the ranges in which they are summed.
SKETCH_BITS, RANGE_BITS = 22, 6
#: Doublings of its count from which an n-gram's rows are dealt to several tasks.
HOT = 11
#: Document ids (8 bytes each) up to which they are broadcast to pick their documents; a shuffle join follows beyond.
BROADCAST_IDS = 2_000_000
#: The same for rows of four short columns.
BROADCAST_ROWS = 500_000


def ngram_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; fewer words than n are one n-gram, no words none."""
    out = []
    for first in range(0, len(texts), 200):  # few texts at a time: their words are hashed and joined together
        each = [words_of(t) for t in texts[first : first + 200]]
        hashes = word_hashes(list(chain.from_iterable(each)))
        whole, at = _joined(hashes, words), 0
        for n in map(len, each):
            if n >= words:
                grams = np.sort(whole[at : at + n - words + 1])
                distinct = np.ones(len(grams), dtype=bool)
                np.not_equal(grams[1:], grams[:-1], out=distinct[1:])
                out.append(grams[distinct])
            else:
                out.append(_joined(hashes[at : at + n], n) if n else np.empty(0, np.uint64))
            at += n
    return out


def _joined(hashes: np.ndarray, size: int) -> np.ndarray:
    out = np.full(max(0, len(hashes) - size + 1), size, np.uint64)
    for i in range(size):
        out = mix(out * C1 + hashes[i : len(out) + i])
    return out


@cache
def levels(num: int, den: int) -> tuple[list[int], list[int]]:
    """First set size of each level, and the probes that sets of the level share at least if they link.

    Linked sets are of one level or of two that follow each other.
    """
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(starts[-1] * den // num + 1)
    return starts, [max(1, min(2 + s // 32, -(-s * num // den))) for s in starts]


def level_of(size: int, num: int, den: int) -> int:
    return bisect_right(levels(num, den)[0], size) - 1


def probes(grams: np.ndarray, heat: np.ndarray, num: int, den: int) -> np.ndarray:
    """Positions of the n-grams that a set is probed by; none if only an equal set can link."""
    n = len(grams)
    if not n or n * (den - num) < num:
        return np.empty(0, np.int64)
    count = n - -(-n * num // den) + levels(num, den)[1][level_of(n, num, den)]
    return np.argsort(heat, kind="stable")[:count]


def links(members: list[np.ndarray], queries: list[np.ndarray] | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (member, query) of linked sets, or (i < j) within the members: bound by the union, then exact."""

    def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    def qualifying(sets: list[np.ndarray], union: np.ndarray, least: int) -> np.ndarray:
        grams, owner = flat(sets)
        sizes = np.array([len(s) for s in sets])
        at = np.minimum(np.searchsorted(union, grams), len(union) - 1)
        overlap = np.bincount(owner[union[at] == grams], minlength=len(sets))
        return np.flatnonzero(overlap * den >= np.maximum(sizes, least) * num)

    none = np.empty(0, np.int64)
    union, counts = np.unique(np.concatenate(members), return_counts=True)
    if queries is None:
        shared = union[counts > 1]
        keep_m = keep_q = qualifying(members, shared, 0) if len(shared) else none
    else:
        keep_q = qualifying(queries, union, min(map(len, members)))
        keep_m = qualifying(members, np.unique(np.concatenate([queries[i] for i in keep_q])), min(len(queries[i]) for i in keep_q)) if len(keep_q) else none
    if not len(keep_m) or not len(keep_q) or (queries is None and len(keep_m) < 2):
        return none, none
    left, right = [members[i] for i in keep_m], [(members if queries is None else queries)[i] for i in keep_q]
    (gm, om), (gq, oq) = flat(left), flat(right)
    common = np.intersect1d(gm, gq) if queries is not None else np.unique(gm)
    overlap = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, len(common), 4096):
        part = common[at : at + 4096]
        x, y = (_rows(part, g, o, n) for g, o, n in ((gm, om, len(left)), (gq, oq, len(right))))
        overlap += x @ y.T
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None]
    inter = overlap.astype(np.int64)
    i, j = np.nonzero(inter * den >= (sizes - inter) * num)
    i, j = keep_m[i], keep_q[j]
    return (i[i < j], j[i < j]) if queries is None else (i, j)


def _rows(part: np.ndarray, grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, len(part)), dtype=np.float32)
    at = np.minimum(np.searchsorted(part, grams), len(part) - 1)
    hit = part[at] == grams
    out[owner[hit], at[hit]] = 1
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while len(i):
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root[i] == root[j]).all():
            break
    return root


def _examine(batches: Iterator[dict], num: int, den: int) -> Iterator[dict]:
    """Rows sorted by block, chunk and side (members first) -> linked classes with one that they are connected to."""

    def done(chunk: int, members: dict, queries: dict) -> dict | None:
        if not members or len(members) + len(queries) < 2:
            return None
        own, others = ([np.frombuffer(g, np.uint64) for _, g in s.values()] for s in (members, queries))
        found = [links(own, None, num, den)] if not chunk and len(own) > 1 else []
        at = 0
        while at < len(others):  # a bounded number of n-grams at a time
            to, grams = at, 0
            while to < len(others) and to < at + GROUP_CLASSES and (to == at or grams + len(others[to]) <= GROUP_NGRAMS):
                grams += len(others[to])
                to += 1
            i, j = links(own, others[at:to], num, den)
            found.append((i, j + len(own) + at))
            at = to
        if not found:
            return None
        i, j = (np.concatenate([f[x] for f in found]) for x in (0, 1))
        cids = [*members, *queries]
        weights = np.array([s for s, _ in [*members.values(), *queries.values()]])
        count = np.bincount(i, weights[j], len(cids)) + np.bincount(j, weights[i], len(cids))
        root, linked = _roots(len(cids), i, j), np.flatnonzero(count)
        return {"cid": [cids[x] for x in linked], "root": [cids[root[x]] for x in linked], "links": count[linked].astype(np.int64)}

    key: tuple | None = None
    sides: tuple[dict, dict] = ({}, {})
    for b in batches:
        for k, side, cid, size, grams in zip(zip(b["block"], b["chunk"], strict=True), b["side"], b["cid"], b["size"], b["grams"], strict=True):
            if k != key:
                if key and (out := done(key[1], *sides)):
                    yield out
                key, sides = k, ({}, {})
            sides[side][cid] = (size, grams)
    if key and (out := done(key[1], *sides)):
        yield out


def _summed_heat(sketches: DataFrame) -> np.ndarray:
    """Heat of each counter: doublings of its count over what chance would give (2**SKETCH_BITS bytes)."""
    size = 1 << SKETCH_BITS - RANGE_BITS

    def total(batches: Iterator[dict]) -> Iterator[dict]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for r, c in zip(b["range"], b["counts"], strict=True):
                own = sums.setdefault(r, np.zeros(size, np.int64))
                own += np.frombuffer(pa.decompress(c, 2 * size, "zstd", asbytes=True), "<u2")
        for r, own in sums.items():
            mean = own.mean()
            heat = np.log2(np.maximum(1, own - mean - 3 * mean**0.5)).astype(np.uint8)
            yield {"range": [r], "heat": [heat.tobytes()]}

    found = map_batches(sketches.select("range", "counts").repartition("range"), total, "range int, heat binary", 64).collect()  # 2**RANGE_BITS rows, whatever the corpus
    heat = np.zeros((1 << RANGE_BITS, size), np.uint8)
    for r in found:
        heat[r.range] = np.frombuffer(r.heat, np.uint8)
    return heat.reshape(-1)


def _keys(sets: list[np.ndarray]) -> tuple[list[bytes], list[int]]:
    keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
    return keys, [int.from_bytes(k[:8], "little", signed=True) for k in keys]


def _block(home: str, level: str, part: str) -> Column:
    return F.xxhash64(home, level, part)


def classified(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, n_shingles, key`` of ``docs(doc_id, text)``, and classes ``key, first_doc, size, label, links``.

    Classes have one label exactly if links connect them; ``links`` counts the linked rows of other classes.
    """
    shift = np.uint64(64 - SKETCH_BITS)

    def read(batches: Iterator[dict]) -> Iterator[dict]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            sets = ngram_sets(b["text"], words)
            keys, short = _keys(sets)
            at, times = np.unique(np.concatenate(sets) >> shift, return_counts=True)
            sketch[at.astype(np.int64)] += times.astype(np.uint32)
            none = [None] * len(sets)
            yield {"doc_id": b["doc_id"], "n_shingles": list(map(len, sets)), "key": keys, "short": short, "level": [level_of(len(s), num, den) for s in sets], "range": none, "counts": none}
        parts = np.minimum(sketch, 65535).astype("<u2").reshape(1 << RANGE_BITS, -1)
        for r in np.flatnonzero(parts.any(axis=1)):
            yield {"doc_id": [None], "n_shingles": [None], "key": [None], "short": [None], "level": [None], "range": [r], "counts": [pa.compress(parts[r].tobytes(), "zstd", asbytes=True)]}

    done = materialize(map_batches(docs, read, "doc_id long, n_shingles long, key binary, short long, level int, range int, counts binary").withColumn("rid", F.monotonically_increasing_id()), "sets")
    rows = done.where("range is null")
    heat = docs.sparkSession.sparkContext.broadcast(_summed_heat(done.where("range is not null")))
    classes = rows.where("n_shingles > 0").groupBy("key").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("first_doc"), F.count("*").alias("size"), F.min("n_shingles").alias("n"), F.min("short").alias("short"), F.min("level").alias("level"))
    classes = materialize(classes, "classes")

    def probe(batches: Iterator[dict]) -> Iterator[dict]:
        seen: set[int] = set()  # a task gives the probes of a set once, however many copies it has
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("short", "level", "token", "heat")}
            for grams in ngram_sets(b["text"], words):
                short = _keys([grams])[1][0]
                if short in seen:
                    continue
                seen.add(short)
                hot = heat.value[(grams >> shift).astype(np.int64)]
                at = probes(grams, hot, num, den)
                for c, v in zip(out, (np.full(len(at), short), np.full(len(at), level_of(len(grams), num, den)), grams[at].view(np.int64), hot[at]), strict=True):
                    out[c].append(v)
            yield {c: np.concatenate(v) if v else [] for c, v in out.items()}

    # Units are (short key, level): if two classes share one by chance, both are candidates, and the sets decide.
    salts = lambda c: F.when(F.col(c) > HOT, F.expr(f"shiftleft(1L, {c} - {HOT})")).otherwise(F.lit(1))
    # Both sides of the join below read all columns of ``told``, so that they are one exchange.
    told = map_batches(docs, probe, "short long, level int, token long, heat int").withColumn("salt", F.pmod(F.xxhash64("short"), salts("heat"))).repartition("token", "salt")
    shared = told.groupBy("token", "salt").agg(F.min("short").alias("first"), F.max("short").alias("last"), F.max("heat").alias("h"), F.max("level").alias("l")).where(((F.col("first") < F.col("last")) | (F.col("h") > HOT)) & (F.col("l") >= 0)).select("token", "salt", "first")
    met = told.join(shared, ["token", "salt"]).dropDuplicates(["token", "salt", "short", "level"])
    met = materialize(met.select("token", "salt", "heat", "short", "level", "first"), "shared_probes")

    needed = F.array(*[F.lit(k) for k in levels(num, den)[1]])
    homes = met.groupBy("short", "level").agg(F.min("first").alias("home"), F.count("*").alias("held")).where(F.col("held") >= F.element_at(needed, F.greatest(F.lit(1), F.col("level")))).drop("held")
    members = materialize(homes.join(classes, ["short", "level"]), "members")
    spread = members.groupBy("home", "level").agg(F.ceil(F.greatest(F.count("*") / GROUP_CLASSES, F.sum("n") / GROUP_NGRAMS)).alias("blocks"))
    spread = materialize(spread, "columns")
    placed = members.join(spread, ["home", "level"]).withColumn("part", F.pmod(F.xxhash64("cid"), "blocks")).withColumn("block", _block("home", "level", "part"))
    placed = materialize(placed.select("cid", "short", "level", "home", "part", "block", "size", "key", F.col("first_doc").alias("doc_id")), "placed")

    # The matrix bounds the overlap of a unit with each column; the pair is looked at from the larger home.
    entries = materialize(met.join(placed.select("short", "level", "home").distinct(), ["short", "level"]).select("token", "salt", "heat", "short", "level", "home"), "matrix")
    union = entries.groupBy("token", F.col("home").alias("to_home"), F.col("level").alias("to_level")).agg(F.max("heat").alias("heat"))
    union = union.select("token", "to_home", "to_level", F.explode(F.sequence(F.lit(0).cast("long"), salts("heat") - 1)).alias("salt"))
    near = (F.col("to_home") < F.col("home")) & (F.abs(F.col("to_level") - F.col("level")) <= 1)
    bound = F.least(F.element_at(needed, F.col("level") + 1), F.element_at(needed, F.col("to_level") + 1))
    meets = entries.join(union, ["token", "salt"]).where(near).groupBy("short", "level", "to_home", "to_level").agg(F.count("*").alias("held")).where(F.col("held") >= bound)
    to = spread.select(F.col("home").alias("to_home"), F.col("level").alias("to_level"), F.col("blocks").alias("to_blocks"))
    across = placed.select("short", "level", "cid").join(meets, ["short", "level"]).join(to, ["to_home", "to_level"]).select("cid", "to_home", "to_level", F.explode(F.sequence(F.lit(0).cast("long"), F.col("to_blocks") - 1)).alias("to_part"))
    beside = placed.select("cid", "level", "part", F.col("home").alias("to_home")).join(to, "to_home").where((F.col("to_level") == F.col("level") + 1) | ((F.col("to_level") == F.col("level")) & (F.col("part") > 0)))
    last = F.when(F.col("to_level") == F.col("level"), F.col("part")).otherwise(F.col("to_blocks")) - 1
    beside = beside.select("cid", "to_home", "to_level", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("to_part"))
    queries = materialize(across.union(beside).select("cid", _block("to_home", "to_level", "to_part").alias("block")), "queries")
    asked = queries.groupBy("block").agg(F.ceil(F.count("*") / TASK_QUERIES).alias("chunks"))
    several = placed.groupBy("block").agg(F.count("*").alias("n")).join(asked, "block", "left").where("n > 1 or chunks > 0").select("block", F.coalesce("chunks", F.lit(1)).alias("chunks"))
    several = materialize(several, "blocks")
    own = placed.join(several, "block").select("cid", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"))
    others = queries.join(several, "block").select("cid", "block", F.pmod(F.xxhash64("cid"), "chunks").alias("chunk"), F.lit(1).alias("side"))
    sent = materialize(own.union(others), "sent")

    wanted = materialize(placed.join(sent.select("cid").distinct(), "cid", "left_semi").select("cid", "key", "size", "doc_id"), "wanted")
    ids = wanted.where("doc_id is not null").select("doc_id").distinct()
    texts = join_bounded(docs, ids, ["doc_id"], "left_semi", BROADCAST_IDS).union(docs.where("doc_id is null").select("doc_id", "text"))

    def again(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            data = [s.tobytes() for s in ngram_sets(b["text"], words)]
            yield {"key": list(map(xxhash.xxh3_128_digest, data)), "grams": data}

    sets = materialize(join_bounded(map_batches(texts, again, "key binary, grams binary", 500), wanted.select("key", "cid", "size"), ["key"], "inner", BROADCAST_ROWS).select("cid", "size", "grams"), "opened_sets")
    laid = join_bounded(sets, sent, ["cid"], "inner", BROADCAST_ROWS).select("block", "chunk", "side", "cid", "size", "grams").repartition("block", "chunk").sortWithinPartitions("block", "chunk", "side")
    linked = materialize(map_batches(laid, lambda b: _examine(b, num, den), "cid long, root long, links long", 500), "links")

    labels = connected_components(linked.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").join(counts, "cid", "left")
    named = named.select("key", "first_doc", "size", F.coalesce("label", "cid").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    return rows.select("doc_id", "n_shingles", "key"), materialize(named, "named")


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row of ``docs(doc_id, text)``.

    Rows link when ``den * |A & B| >= num * |A | B|`` for their n-gram sets (words parted by ASCII white space,
    A-Z in lower case). ``component_id`` is the smallest doc_id that links reach, its own included;
    ``n_links`` counts linked rows. Texts that are null, empty or blank have no set: they are linked to nothing.
    Rows with a null id take part and only never name a component. Repeated rows are copies of each other.
    An empty table gives no rows; other columns of ``docs`` are not read.
    """
    rows, classes = classified(columns(docs, doc_id="long", text="string"), words, num, den)
    smallest = classes.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    by_key = classes.join(smallest, "label").select("key", "component_id", (F.col("size") - 1 + F.col("links")).alias("n_links"))
    out = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("key")).alias("key")).join(by_key, "key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def representatives(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for a component of :func:`jaccard_components`.

    That is the row with the smallest id; of rows that repeat its id and its set, the one with the smallest text.
    A component without ids keeps one row. Texts without a word are linked to nothing: they stay, but of rows that
    repeat an id without a word, one stays. An empty table gives no rows, whatever its other columns are called.
    """
    rows, classes = classified(columns(docs, doc_id="long", text="string"), words, num, den)
    best = classes.groupBy("label").agg(F.min(F.struct(F.col("first_doc").isNull(), "first_doc", "key")).alias("best")).select("best.key", "best.first_doc")
    blank = rows.where("n_shingles = 0").select("key", F.col("doc_id").alias("first_doc")).distinct()
    kept = materialize(best.union(blank), "kept")
    repeated = materialize(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated_ids")
    single = kept.where("first_doc is not null").join(repeated.withColumnRenamed("doc_id", "first_doc"), "first_doc", "left_anti").select("first_doc")

    own = [F.col(f"`{c}`") for c in docs.columns]
    at = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*own).alias("row"))
    ids = lambda df, c: df.select(F.col(c).alias("id"))
    plain = join_bounded(at, ids(single, "first_doc"), ["id"], "left_semi", BROADCAST_IDS).select("row.*")

    @F.pandas_udf("binary")
    def key_of(texts: pd.Series) -> pd.Series:
        return pd.Series(_keys(ngram_sets(texts.tolist(), words))[0])

    odd = join_bounded(at, ids(repeated, "doc_id"), ["id"], "left_semi", BROADCAST_IDS).union(at.where("id is null"))
    odd = odd.select("id", "row", key_of(F.col("row.text").cast("string")).alias("key"))
    unnamed_blank = F.col("id").isNull() & (F.col("key") == F.lit(_keys(ngram_sets([None], words))[0][0]))
    of_kept = odd.where(~unnamed_blank).join(kept.withColumnRenamed("key", "kept_key"), (F.col("key") == F.col("kept_key")) & F.col("id").eqNullSafe(F.col("first_doc")), "left_semi")
    first = of_kept.withColumn("nth", F.row_number().over(Window.partitionBy("id", "key").orderBy("row.text"))).where("nth = 1")
    return plain.union(first.select("row.*")).union(odd.where(unnamed_blank).select("row.*"))
