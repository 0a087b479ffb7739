"""Helpers shared by the training-data operators: shared tables, Arrow batches, word rules."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Rows and bytes of an Arrow batch that are held as Python objects at one time; a longer row is held alone.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20


#: Bytes of an Arrow batch between Spark and a worker, or one longer row; Spark's own bound is 10,000 rows of any length.
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on this machine alone (tests) is a temporary folder set
    and used; on a cluster each executor would write to its own disk, so there it is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="sightline-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


#: Removes a query's shuffle files when the query ends, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation. The shuffle files of
    the query are no longer needed then, and go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sightline-tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def release(table: DataFrame) -> None:
    """Delete a table that ``stored`` has written and that no later query reads."""
    jvm = table.sparkSession._jvm
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` in batches of at most BATCH_BYTES, which a task holds in the JVM and in its worker.

    The bound is the session's, as Spark reads it when the query runs; one that the session names stays.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_BYTES, None) is None:
        conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def _small_table(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """``rows`` as a local table: an RDD of Python rows would start a second set of workers on the executors."""
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c) for c in columns], names=schema.names), schema)


def merged(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: sorted and merged at every size, never broadcast through the driver."""
    return side.hint("merge")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names for intermediate results: ``names`` with underscores before them until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"_{name}".lower() in taken:
            name = f"_{name}"
        out.append(f"_{name}")
    return out


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string")) % F.lit(modulus)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Short runs of rows, so that few texts, and few bytes of them, are Python objects at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        upto, start = np.cumsum(total), 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            end = max(start + 1, min(start + rows, int(np.searchsorted(upto, before + size, side="right"))))
            yield batch.slice(start, end - start)
            start = end


def words_of(text: str | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of a text with A-Z lower-cased, as UTF-8.

    ``bytes.lower`` changes A-Z alone and ``bytes.split`` parts at those six bytes alone.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: Draws are whole numbers below this.
_SPAN = 1 << 31


def _draw() -> Column:
    return F.pmod(F.xxhash64("_id"), F.lit(_SPAN))


def _limit(wanted: int, n: int) -> int:
    """Below which draws about ``wanted`` of n rows lie, and some more: the draw is by chance, and long rows may not fit."""
    return min(_SPAN, int(_SPAN * (1.2 * wanted + 20) / max(n, 1)) + 1)


def _thinned(df: DataFrame, group_col: str, per_group: int) -> DataFrame:
    """Rows (_id, ``group_col``, ...) whose draw lies below their group's limit: a bounded number of ids of each group."""
    spark = df.sparkSession
    limits = [(r[0], _limit(per_group, r[1])) for r in df.groupBy(group_col).count().collect()]
    table = _small_table(spark, limits, StructType([StructField(group_col, df.schema[group_col].dataType), StructField("_limit", LongType())]))
    return df.withColumn("_draw", _draw()).join(F.broadcast(table), group_col).where("_draw < _limit").drop("_draw", "_limit")


def _taken(some: DataFrame, per_group: int, group_bytes: int) -> list[tuple]:
    """(id, group, text) of the first rows by draw of each group of ``some`` (_id, _group, _text), a bounded table.

    Repeated rows of an id are one (its least group and text), before anything is collected. Texts
    are whole: a row that would go beyond the bytes is left out.
    """
    sizes = some.groupBy("_id", "_group").agg(F.min(F.octet_length("_text")).alias("size"))
    rows = sizes.groupBy("_id").agg(F.min(F.struct("_group", "size")).alias("least")).select("_id", "least.*", _draw().alias("_draw")).collect()
    rows.sort(key=lambda r: (r["_draw"], r["_id"]))
    used: dict = {}
    chosen = []
    for r in rows:
        n, size = used.get(r["_group"], (0, 0))
        if n < per_group and size + r["size"] <= group_bytes:
            used[r["_group"]] = (n + 1, size + r["size"])
            chosen.append((r["_id"], r["_group"]))
    if not chosen:
        return []
    ids = _small_table(some.sparkSession, chosen, StructType([StructField("_id", LongType()), StructField("_group", some.schema["_group"].dataType)]))
    texts = some.join(F.broadcast(ids), ["_id", "_group"]).groupBy("_id").agg(F.min(F.struct(F.octet_length("_text").alias("size"), "_text"))["_text"].alias("_text"))
    found = {r["_id"]: r["_text"] for r in texts.collect()}
    return [(i, g, found[i]) for i, g in chosen if i in found]


def stable_sample(df: DataFrame, id_col: str, group_col: str, text_col: str, per_group: int, group_bytes: int) -> list[tuple]:
    """(id, group, whole text) of at most ``per_group`` rows and ``group_bytes`` bytes of each group, as driver rows in a stable order.

    Rows are drawn by a hash of their id. Null ids, groups and texts are left out.
    """
    live = df.where(F.col(id_col).isNotNull() & F.col(group_col).isNotNull() & F.col(text_col).isNotNull())
    live = live.select(F.col(id_col).cast("long").alias("_id"), F.col(group_col).alias("_group"), F.col(text_col).alias("_text"))
    return _taken(_thinned(live, "_group", per_group), per_group, group_bytes)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, class_bytes: int,
                    id_col: str = "doc_id", text_col: str = "text", fold: tuple[int, int] | None = None) -> list[tuple[str, int]]:
    """(whole text, label) of at most ``per_class`` rows and ``class_bytes`` bytes of each class, in a stable order.

    ``fold`` = (modulus, held out remainder) of the id's crc32. Rows without text, label or id are
    left out; of contradicting labels of one id the larger counts.
    """
    part = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    if fold:
        part = part.where(crc_mod(F.col(id_col), fold[0]) != fold[1])
        texts = texts.where(crc_mod(F.col("_id"), fold[0]) != fold[1])
    part = part.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_group"))
    some = texts.join(F.broadcast(_thinned(part, "_group", per_class)), "_id")
    return [(t, y) for _, y, t in _taken(some, per_class, class_bytes)]
