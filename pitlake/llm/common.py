"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_own_dirs: dict[str, str] = {}
#: Rows of a batch for functions that give whole texts back.
TEXT_ROWS = 1000
#: Rows of an Arrow batch, the same for every operator: two batches of texts a task are all that stands outside the heap.
ARROW_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session may leave the setting out; it then gets a temporary folder of its own.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-pitlake-")
    return _own_dirs[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast: whatever else the table carries cannot clash with an operator's own names."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])


def _small_batches(df: DataFrame) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df


def release() -> None:
    """Give memory that a task no longer uses back: the worker process lives on and serves other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library: then it stays with the process
        pass


def map_batches(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str | T.StructType, rows: int = 2000) -> DataFrame:
    """``mapInArrow`` over column dictionaries: ``fn`` gets and yields ``{column: list or array}``.

    ``rows`` bounds the rows that are Python objects at a time; whole batches stay in Arrow's memory.
    """
    out = to_arrow_schema(schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(b.slice(at, rows).to_pydict() for b in batches for at in range(0, b.num_rows, rows)):
            arrays = [pa.array(cols[f.name], type=f.type) for f in out]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)
        release()

    return _small_batches(df).mapInArrow(run, schema)


def map_text(docs: DataFrame, make: Callable[[], Callable[[str | None], str | None | bool]], rows: int = 500) -> DataFrame:
    """``docs`` with ``text`` rewritten: ``make()``, called once a task, gives a function of a text that returns the new
    text, or False if the row goes. All other columns pass by untouched, whatever they are called, but ``n_chars``,
    where there is one, follows a text that changed.
    """
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            for first in range(0, whole.num_rows, rows):
                b = whole.slice(first, rows)
                old = b.column(at).to_pylist()
                new = [fn(t) for t in old]
                if any(x is not y for x, y in zip(old, new, strict=True)):
                    keep = [x is not False for x in new]
                    arrays, old, new = [c.filter(pa.array(keep)) for c in b.columns], [x for x, k in zip(old, keep, strict=True) if k], [x for x in new if x is not False]
                    arrays[at] = pa.array(new, type=arrays[at].type)
                    if chars is not None:
                        changed = pa.array([x is not y for x, y in zip(old, new, strict=True)])
                        arrays[chars] = pc.if_else(changed, pc.utf8_length(arrays[at]).cast(arrays[chars].type), arrays[chars])
                    b = pa.RecordBatch.from_arrays(arrays, schema=b.schema)
                if b.num_rows:
                    yield b
        release()

    return _small_batches(docs).mapInArrow(run, docs.schema)


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def join_bounded(big: DataFrame, small: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """Join that broadcasts ``small`` only when it is checked to have at most ``rows`` rows, and shuffles otherwise."""
    return big.join(F.broadcast(small) if is_small(small, rows) else small, on, how)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``: nodes have one label exactly if a path joins them.

    Randomised contraction: in each round every node moves to the neighbour (or itself) with the smallest
    salted hash and the edges are rewritten, which takes a constant share of the nodes away in expectation.
    A round is two joins and two aggregations with partial sums, so a node of huge degree needs no task of
    its own. The label is one node of the component. Rows with equal or null ends only name their node.
    """
    edges = edges.select(F.col("a").alias("a"), F.col("b").alias("b"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).where("node is not null").distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("label")), name)
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    turn = 0
    while not edges.isEmpty():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("to"))
        both = edges.select("a", "b").union(edges.select("b", "a"))
        moves = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(rank("b")), F.min(rank("a"))).getField("to").alias("to"))
        moves = materialize(moves, name)
        at = lambda c: moves.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        moved = edges.join(at("a"), "a").join(at("b"), "b").where("a_to <> b_to")
        edges = materialize(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), name)
        labels = materialize(labels.join(moves.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), name)
    return labels
