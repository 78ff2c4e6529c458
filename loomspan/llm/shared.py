"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[DataFrame, str]] = []
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4_000_000
#: Spark deletes the shuffle files of a saved table once it is saved.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="loomspan-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, name: str, *replaced: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there and lost executors cost no recomputation.

    Shuffle files of its making go when it is saved, as do the tables of written() that it replaces.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomspan-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    if not _WRITTEN:
        atexit.register(drop_written)
    _WRITTEN.append((found, path))
    release(*replaced)
    return found


def release(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more; of other data frames nothing is deleted."""
    for at in [i for i, (held, _) in enumerate(_WRITTEN) if any(held is t for t in tables)][::-1]:
        _delete(*_WRITTEN.pop(at))


def drop_written() -> None:
    """Delete the tables that written() has made; results that still read them must have been saved before."""
    while _WRITTEN:
        try:
            _delete(*_WRITTEN.pop())
        except Exception:  # the session may have ended; the folder is the cluster's scratch space
            return


def _delete(table: DataFrame, path: str) -> None:
    spark = table.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches hold BATCH_BYTES at most from here on (one row at least), so that long texts don't fill workers; a smaller limit stays."""
    limit = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_LIMIT))
    if not 0 < limit <= BATCH_BYTES:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pieces(batch: pa.RecordBatch, column: str, most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch with about `most` characters of text each, one row at least; no row is left out."""
    sizes = [len(x) if x is not None else 0 for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow whose per-task state is built once by make(); its result turns a slice of rows into output rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in pieces(batch, column):
                if (out := step(part)) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def frequent(counts: DataFrame, n_col: str, key_col: str, most: int) -> DataFrame:
    """The `most` rows of the greatest counts (of equals the least keys), of a saved table; a quantile cuts the rest off first, so that no task sends more than its share."""
    size = counts.count()
    if size > 2 * most:
        cut = counts.agg(F.percentile_approx(n_col, 1 - 1.2 * most / size, 20_000).alias("cut")).first().cut
        counts = counts.filter(F.col(n_col) >= cut)
    return counts.orderBy(F.desc(n_col), key_col).limit(most)


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[list, list[str]], list[bool]]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Filter whole rows of docs where they lie, all columns as they are: make() builds a task's test of (ids, texts)."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at_id, at_text = names.index(id_col), names.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for batch in batches:
            for part in pieces(batch, text_col):
                texts = [t or "" for t in part.column(at_text).to_pylist()]
                yield part.filter(pa.array(test(part.column(at_id).to_pylist(), texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def doc_columns(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text under fixed names, whatever else the table carries; a null text is empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
