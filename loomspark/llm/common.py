"""Helpers that the operators share: reading tables, Arrow row functions, shared folders, graph components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A prefix that no input column is expected to carry; inner columns bear it, so clashing names do no harm.
P = "__ls_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share, as ``spark.checkpoint.dir`` names it. Where that is unset, one of our own on a single
    machine, as in tests, and an error on a cluster, whose machines could not read it."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ls-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; Spark's cleaner removes it in the end."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession) -> str:
    """A folder of our own in the shared one, not made yet; it is deleted with the saved tables."""
    path = f"{shared_folder(spark)}/ls-{uuid.uuid4().hex}"
    _SAVED.append(path)
    return path


def saved(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, later scans prune columns."""
    path = new_folder(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders named by :func:`new_folder` that are still there, in the order of writing.
_SAVED: list[str] = []


def saved_so_far() -> int:
    return len(_SAVED)


def forget_saved(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Delete the tables written since a mark, but for the last ``but`` of them. What reads them must be done."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _SAVED[since : len(_SAVED) - but]
    del _SAVED[since : len(_SAVED) - but]
    for path in gone:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


@atexit.register
def _forget_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if _SAVED and spark is not None and spark.sparkContext._jsc is not None:
        try:
            forget_saved(spark)
        except Exception:  # the session may be gone already; its folder is then the cluster's to clean
            pass


#: A side of a join is broadcast only if it is a saved table of at most so many bytes in its files and so many rows.
BROADCAST_BYTES = 12 << 20
BROADCAST_ROWS = 400_000


def few(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a saved table for broadcast if its files and its count are small; else leave the choice, and the shuffle, to Spark."""
    files = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if files <= size and df.count() <= rows else df


#: A key with more than one in so many of a table's rows is hot; there are fewer hot keys than this.
HOT_SHARE = 1_000

_SLICE = 250

#: Rows in an Arrow batch, at most: documents are long, and a task holds some batches on either side of its pipe.
ARROW_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Ask a session for small Arrow batches, if it asks for none so small itself. The registered queries and the pipeline
    do so; operators leave the session's settings alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


_FORGET: dict[str, Callable[[], None]] = {}


def only(owner: str, forget: Callable[[], None]) -> None:
    """Called in a Python worker by an operator with a memory of words: the memories of other operators are emptied, so a
    worker that outlives a stage holds one of them at a time."""
    _FORGET[owner] = forget
    for other in [o for o in _FORGET if o != owner]:
        _FORGET.pop(other)()


def _give_back() -> None:
    """Hand memory that a task has freed back to the machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def map_rows(
    df: DataFrame,
    inputs: list[str],
    fn: Callable[[list[list]], Iterator[tuple] | list[tuple]],
    out: str | T.StructType,
    keep: list[str] | None = None,
) -> DataFrame:
    """Run ``fn`` over Arrow batches of the ``inputs`` columns.

    ``fn`` gets one Python list per input column and yields one tuple per row, in the row order of the batch.
    The result holds the ``keep`` columns untouched (all columns by default) followed by the fields of ``out``.
    A kept column named like one of ``out`` gives way to the computed one.
    """
    out = T._parse_datatype_string(out) if isinstance(out, str) else out
    keep = [c for c in (df.columns if keep is None else keep) if c not in out.names]
    kept = [f"{P}k{i}" for i in range(len(keep))]
    more = [c for c in dict.fromkeys(inputs) if c not in keep]  # a column that is kept anyway is sent once
    names = [f"{P}i{i}" for i in range(len(more))]
    at = [[*keep, *more].index(c) for c in inputs]
    sent = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)], *[F.col(f"`{c}`").alias(n) for c, n in zip(more, names)])
    types = [to_arrow_type(f.dataType) for f in out.fields]
    n_kept = len(kept)

    def run(batches):
        # Small slices: a batch's texts are never all held as Python objects.
        for whole in batches:
            for start in range(0, max(1, whole.num_rows), _SLICE):
                batch = whole.slice(start, _SLICE)
                rows = list(fn([batch.column(i).to_pylist() for i in at])) if batch.num_rows else []
                columns = list(zip(*rows)) if rows else [[] for _ in types]
                made = [pa.array(c, type=t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n_kept)] + made, names=[*kept, *out.names])
        _give_back()

    schema = T.StructType([T.StructField(k, df.schema[c].dataType) for c, k in zip(keep, kept)] + out.fields)
    done = sent.mapInArrow(run, schema)
    return done.select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], *out.names)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an edge table by alternating large-star and small-star rounds.

    Returns ``(node, root)`` for every node that has an edge; ``root`` is the least node of its component.
    Edges stay distributed; each round is checkpointed, so a lost executor costs one round at most.
    Nulls and loops are left out. A hub is never gathered: both stars are one minimum by node, which combines
    before the shuffle, and a join against it that adaptive execution may split.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = checkpointed(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        # Large star: each node hands every larger neighbour to the least node of its neighbourhood.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each node hands its smaller neighbours, and itself, to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = large.join(low, large.u == low.n)
        e = checkpointed(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()
        )
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
