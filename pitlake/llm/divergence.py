"""How far the sources of a language differ in their words, by a frequent-pattern tree of term rows.

A term's probability in a source is p = 1 + floor(1e9 (count + 2) / (N + 2 V)), so all of a source's terms that it does
not use share one value p0. The divergence of two sources is the sum of f(p, q) = floor((p - q)^2 / (p + q)) over the V
kept terms of the language. It is put together from three exact parts:

1. V f(p0, q0), as if neither source used any term;
2. for each value p that a source has, times the terms that have it, f(p, q0) - f(p0, q0);
3. for terms that both use, the correction f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

The third needs the rows of terms. A row is the list of (source, p) of the sources that use the term, sources with more
terms first. Equal rows count once with their multiplicity; the others are dealt by ranges of sorted rows, so rows that
begin alike meet in one task and share their path in the tree there. A node gives one correction for each ancestor, times
the terms that run through it. A row of many sources is dealt as segments of nodes, each with the path above it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pitlake.llm.common import is_small, join_bounded, map_batches, materialize, release

#: Fixed values of the measure: scale of probabilities and pseudo-count of a term.
SCALE, PSEUDO = 1_000_000_000, 2
#: Every byte that belongs to a term, in lower case; all others part terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Terms that a task counts before it passes them on.
HELD = 400_000
#: Nodes of a row that one segment adds, and cells of rows that a task lays out at a time.
SEGMENT, CELLS = 512, 1 << 20
#: Sources up to which their table is broadcast (about 60 bytes each), and parts in which it is dealt beyond that.
BROADCAST_SOURCES, SALTS = 200_000, 32


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents that hold the term; several rows of a key add up."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        seen: dict[tuple, Counter] = defaultdict(Counter)
        holds: dict[tuple, Counter] = defaultdict(Counter)

        def flush() -> Iterator[dict]:
            for (lang, source), n in seen.items():
                terms, size = list(n), len(n)
                yield {"lang": [lang] * size, "source": [source] * size, "term": terms, "n": list(n.values()), "docs": list(map(holds[lang, source].__getitem__, terms))}
            seen.clear()
            holds.clear()

        for b in batches:
            for key, text in zip(zip(b["lang"], b["source"], strict=True), b["text"], strict=True):
                terms = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
                seen[key].update(terms)
                holds[key].update(set(terms))
            if sum(map(len, seen.values())) > HELD:
                yield from flush()
        yield from flush()

    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return map_batches(text, run, "lang string, source string, term string, n long, docs long", rows=200)


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """``lang, source, term, n, lang_n`` of terms in at least ``least_docs`` documents of their language."""
    per_source = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    over = Window.partitionBy("lang", "term")
    return per_source.select("lang", "source", "term", "n", F.sum("n").over(over).alias("lang_n"), F.sum("docs").over(over).alias("lang_docs")).where(F.col("lang_docs") >= least_docs).drop("lang_docs")


def p_of(count: Column, total: Column, terms: Column) -> Column:
    whole = lambda c: c.cast("decimal(20,0)")
    return 1 + F.call_function("div", whole(F.lit(SCALE)) * whole(count + PSEUDO), whole(total + PSEUDO * terms))


def f_of(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _on_lang(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on the language; a large ``right`` is dealt with the rows of ``left`` so that no language needs one task."""
    if is_small(right, BROADCAST_SOURCES):
        return left.join(F.broadcast(right), "lang")
    dealt = left.withColumn("salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lang", "salt"]).drop("salt")


def tree_corrections(s: np.ndarray, p: np.ndarray, p0: np.ndarray, size: np.ndarray, start: np.ndarray, fresh: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Per depth of the tree of sorted rows: (row, ancestor's source, source, correction) summed over nodes of equal ends.

    ``s, p, p0`` are rows padded with -1 to one width, of ``size`` items each; ``fresh`` marks rows that begin a tree
    of their own, ``times`` are the terms of a row, and nodes before ``start`` belong to another segment.
    """
    shared = np.zeros(len(s), np.int64)
    if len(s) > 1:
        same = (s[1:] == s[:-1]) & (p[1:] == p[:-1]) & (s[1:] >= 0)
        shared[1:] = np.where(fresh[1:], 0, np.logical_and.accumulate(same, axis=1).sum(axis=1))
    tree = np.cumsum(fresh)
    f = lambda a, b: (a - b) ** 2 // (a + b)
    for depth in range(1, s.shape[1]):
        heads = np.flatnonzero(shared <= depth)
        through = np.add.reduceat(times, heads)
        own = (size[heads] > depth) & (start[heads] <= depth)
        at, through = heads[own], through[own]
        if not len(at):
            continue
        pa_, qa, pb, qb = p[at, :depth], p0[at, :depth], p[at, depth, None], p0[at, depth, None]
        value = through[:, None] * (f(pa_, pb) - f(pa_, qb) - f(qa, pb) + f(qa, qb))
        ends = np.stack([np.broadcast_to(tree[at, None], value.shape).ravel(), s[at, :depth].ravel(), np.broadcast_to(s[at, depth, None], value.shape).ravel()])
        order = np.lexsort(ends[::-1])
        ends, value = ends[:, order], value.ravel()[order]
        first = np.flatnonzero(np.concatenate(([True], (ends[:, 1:] != ends[:, :-1]).any(axis=0))))
        yield np.searchsorted(tree, ends[0, first]), ends[1, first], ends[2, first], np.add.reduceat(value, first)


def _trees(rows: DataFrame) -> DataFrame:
    """Pair corrections ``lang, a, b, value`` of sorted rows ``lang, start, items, times``."""
    schema = "lang string, a int, b int, value long"
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("items").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < b.num_rows:
                rows = max(1, CELLS // max(1, int(sizes[at : at + CELLS].max())))
                part, size = b.slice(at, rows), sizes[at : at + rows]
                at += rows
                flat, inside = part.column("items").flatten(), np.arange(size.max()) < size[:, None]

                def laid(name: str, flat: pa.Array = flat, inside: np.ndarray = inside) -> np.ndarray:
                    m = np.full(inside.shape, -1, np.int64)
                    m[inside] = flat.field(name).to_numpy(zero_copy_only=False)
                    return m

                langs, start = part.column("lang").to_pylist(), part.column("start").to_numpy(zero_copy_only=False)
                fresh = np.array([i == 0 or langs[i] != langs[i - 1] or start[i] != start[i - 1] for i in range(len(langs))])
                times = part.column("times").to_numpy(zero_copy_only=False)
                for row, a, c, value in tree_corrections(laid("s"), laid("p"), laid("p0"), size, start, fresh, times):
                    yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in row], pa.string()), pa.array(a, pa.int32()), pa.array(c, pa.int32()), pa.array(value, pa.int64())], schema=out)
        release()

    return rows.mapInArrow(run, schema)


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source of a language is from the others, and by which terms.

    Part ``pair`` ranks all other sources of the language by the divergence from the source; part ``term`` ranks the
    ``top`` terms that the source uses more than its language does, by their share of the divergence from it. Null text,
    lang and source are empty strings. A language without kept terms has pairs of value 0 and no terms; a language of
    one source has no pairs. Ids are not read: repeated rows are documents of their own. An empty table gives no rows.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    kept = materialize(kept_terms(term_counts(docs), least_docs), "terms")
    used = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("used"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.countDistinct("term").alias("v"))
    found = docs.select(name("lang"), name("source")).distinct().join(used, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "used", "lang_total", "v"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("used"), "source"))
    p0 = F.when(F.col("v") > 0, p_of(F.lit(0), F.col("total"), F.col("v"))).otherwise(1)
    sources = materialize(found.withColumns({"s": number, "p0": p0}), "sources")

    held = join_bounded(kept, sources, ["lang", "source"], "inner", BROADCAST_SOURCES).withColumn("p", p_of(F.col("n"), F.col("total"), F.col("v")))
    q = p_of(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    terms = held.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), f_of(F.col("p"), F.col("q")).alias("value"))

    other = sources.select("lang", F.col("s").alias("b"), F.col("p0").alias("q0"))
    ends = lambda: (F.least("s", "b").alias("a"), F.greatest("s", "b").alias("b"))
    unused = f_of(F.col("p0"), F.col("q0"))
    base = _on_lang(sources.select("lang", "s", "p0", "v"), other).where("s < b").select("lang", *ends(), (F.col("v") * unused).alias("value"))
    values = held.groupBy("lang", "s", "p", "p0").agg(F.count("*").alias("times"))
    one = _on_lang(values, other).where("s <> b").select("lang", *ends(), (F.col("times") * (f_of(F.col("p"), F.col("q0")) - unused)).alias("value"))
    items = F.array_sort(F.collect_list(F.struct("s", "p", "p0")))
    rows = held.groupBy("lang", "term").agg(items.alias("items")).where(F.size("items") > 1)
    rows = rows.select("lang", "items", F.explode(F.sequence(F.lit(0), F.size("items") - 1, F.lit(SEGMENT))).alias("start"))
    rows = rows.select("lang", "start", F.slice("items", F.lit(1), F.col("start") + SEGMENT).alias("items")).groupBy("lang", "start", "items").agg(F.count("*").alias("times"))
    rows = materialize(rows, "rows")
    both = _trees(rows.repartitionByRange("lang", "start", "items").sortWithinPartitions("lang", "start", "items"))
    sums = base.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    each = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    named = lambda c, to: sources.select("lang", F.col("s").alias(c), F.col("source").alias(to))
    each = join_bounded(join_bounded(each, named("a", "source"), ["lang", "a"], "inner", BROADCAST_SOURCES), named("b", "item"), ["lang", "b"], "inner", BROADCAST_SOURCES)
    pairs = each.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
