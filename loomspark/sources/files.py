"""Raw files: listing, codec detection, inventory rows. Bytes are decoded in Arrow batches, since no expression of the
engine tries one codec after another."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as X
from ..functions.lexicon import Lexicon

#: Files of an Arrow batch that are decoded at one time; books are long.
SLICE = 8
#: Tasks of a listing, at most: else each folder up to the ten thousandth has a task of its own.
LISTING = 256
CODECS = ("utf-8", "utf-8-sig", "gb18030", "gbk", "big5")


def is_junk(name: Column) -> Column:
    """SRC-02: hidden files, resource forks, thumbnails."""
    return name.startswith(".") | (name == "Thumbs.db")


def discover(spark: SparkSession, folder: str, pattern: str = "*.txt", limit: int | None = None) -> DataFrame:
    """SRC-01, SRC-09: ``(path, relative_path, file_name, size, content)`` of all text files under a folder."""
    tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    given = spark.conf.get(tasks)
    spark.conf.set(tasks, str(min(int(given), LISTING)))
    try:  # files are listed here, and not when rows are asked for
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    finally:
        spark.conf.set(tasks, given)
    name = F.element_at(F.split("path", "/"), -1)
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    at = F.instr("path", root)
    relative = F.when(at > 0, F.substring("path", at + len(root), F.length("path"))).otherwise(F.col("path"))
    rows = raw.withColumn("file_name", name).where(~is_junk(F.col("file_name")))
    rows = rows.select("path", relative.alias("relative_path"), "file_name", F.col("length").alias("size"), "content")
    return rows.orderBy("relative_path").limit(limit) if limit else rows


#: A statistical guess of a codec counts from this confidence on.
CONFIDENCE = 0.5


def guessed(raw: bytes) -> tuple[str | None, float]:
    """SRC-03, SRC-05: a codec by statistics with its confidence, where a detector is installed."""
    try:
        import chardet
    except ImportError:
        return None, 0.0
    found = chardet.detect(raw)
    return found.get("encoding"), float(found.get("confidence") or 0.0)


def decode(raw: bytes, codecs: tuple[str, ...] = CODECS, tolerance: int = 64, guess: Callable[[bytes], tuple[str | None, float]] = guessed) -> tuple[str | None, str | None, int, str | None]:
    """SRC-03 to SRC-06: ``(text, codec, replacements, error)``.

    Codecs are tried strictly in order, then the one that statistics tell with confidence; then each with replacements,
    of which the fewest win, the first codec among equals; so many replacements are borne as ``tolerance``, or one in
    100,000 characters.
    """
    for c in codecs:
        try:
            return raw.decode(c), c, 0, None
        except (UnicodeDecodeError, LookupError):
            continue
    codec, sure = guess(raw)
    if codec and sure >= CONFIDENCE:
        try:
            return raw.decode(codec), codec, 0, None
        except (UnicodeDecodeError, LookupError):
            pass
    loose = [(t.count("�"), i, t, c) for i, c in enumerate(codecs) for t in [raw.decode(c, errors="replace")]]
    n, _, text, c = min(loose, key=lambda x: x[:2])
    if n <= max(tolerance, len(text) // 100_000):
        return text, c, n, None
    return None, codec, n, f"codec {codec!r} told with confidence {sure:.3f} only" if codec and sure < CONFIDENCE else "no codec fits"


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """SRC-03, SRC-06, SRC-08: text, codec, replacements and error beside the other columns. A row never fails the job."""
    keep = [c for c in files.columns if c != content]
    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep) + ", text string, detected_encoding string, decode_replacement_chars long, error_message string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, at in ((w, i) for w in batches for i in range(0, max(1, w.num_rows), SLICE)):
            b = whole.slice(at, SLICE)
            out = [decode(bytes(x)) if x is not None else (None, None, 0, "no content") for x in b.column(len(keep)).to_pylist()]
            text, codec, n, error = map(list, zip(*out)) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(text, pa.string()), pa.array(codec, pa.string()), pa.array(n, pa.int64()), pa.array(error, pa.string())], names=[*keep, "text", "detected_encoding", "decode_replacement_chars", "error_message"])

    return files.select(*keep, content).mapInArrow(run, schema)


def inventory(files: DataFrame, lex: Lexicon | None = None, sample: bool = False) -> DataFrame:
    """SRC-07 to SRC-11: one row per file. Unreadable files stay, with a status and a reason."""
    lex = lex or Lexicon()
    d = decoded(files)
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return d.select(
        H.novel_id(X.posix_path("relative_path")).alias("novel_id"), "file_name", stem.alias("file_stem"), "relative_path", F.col("path").alias("absolute_path"),
        F.col("size").alias("file_size_bytes"), F.round(F.col("size") / (1024 * 1024), 4).alias("file_size_mb"), "detected_encoding",
        F.when(F.col("text").isNotNull(), "ok").otherwise("failed").alias("read_status"), "error_message", X.title_from_stem(stem).alias("title_guess"),
        X.author_of(stem).alias("author_guess"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("char_count"),
        F.coalesce(X.chapter_count("text", lex), F.lit(0)).alias("estimated_chapter_count"), F.when(F.col("text").isNotNull(), H.content_fingerprint("text")).alias("content_sha256"),
        "decode_replacement_chars", F.when(F.lit(sample), X.sample_text("text")).alias("sample_text"), F.current_timestamp().alias("created_at"),
    )


def texts(inventory_rows: DataFrame, files: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """SRC-12 to SRC-14: texts of readable files, of the given ids only."""
    rows = inventory_rows.where("read_status = 'ok'").select("novel_id", F.col("absolute_path").alias("path"))
    if ids is not None:
        rows = rows.join(ids.select("novel_id").distinct(), "novel_id", "left_semi")
    return decoded(files.join(rows, "path")).select("novel_id", "text")


def read_jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = (), missing_ok: bool = True) -> DataFrame:
    """SRC-24, SRC-26, SRC-28, SRC-33, STR-20: JSON lines; broken or blank lines are skipped, and a missing file is empty.

    A row without a required field is an error that names the field.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if missing_ok and not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    for c in required:
        if not rows.where(F.col(c).isNull()).isEmpty():
            raise ValueError(f"a row lacks {c}")
    return rows


def append_jsonl(rows: DataFrame, path: str) -> None:
    """SRC-25, STR-02, STR-04, STR-06, STR-21: records are added as new files of a folder."""
    rows.write.mode("append").json(path)


def task_records(parts: list[DataFrame], key: str = "task_id") -> DataFrame:
    """SRC-27: a later file's record takes the place of an earlier one's."""
    rows = None
    for i, p in enumerate(parts):
        p = p.withColumn("__file", F.lit(i))
        rows = p if rows is None else rows.unionByName(p, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (key, "__file")]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "__file").alias("r"))
    return best.select(key, *[f"r.{c}" for c in rest])


def manual_judgements(spark: SparkSession, path: str) -> DataFrame:
    """SRC-30, SRC-32, SRC-35: judged CSV files of a folder; bad labels are nought, blank notes empty. Quotes are doubled in
    them, cells may hold line ends, and a byte order mark is no part of a name."""
    from ..functions import jsons as J
    from .sinks import read_csv
    from .tables import require

    rows = read_csv(spark, path)
    require(rows, ["query_id", "novel_id", "relevance_label"])
    out = rows.withColumn("relevance_label", J.clamp_label("relevance_label"))
    if "constraint_violation" in rows.columns:
        out = out.withColumn("constraint_violation", J.coerce_bool("constraint_violation"))
    return out.fillna("")
