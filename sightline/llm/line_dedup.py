r"""Reversible line deduplication: sharded cuckoo filters backed by exact reference counts.

A line's key is the \n-split line with ``[\x20\x09-\x0D]`` stripped and A-Z lower-cased; keys of at least
MIN_CHARS code points are counted. The exact side is two tables: *postings* (which document holds
which key) and *reference counts* (per key: documents, largest document id). Keys held by at least
MIN_DOCS documents are *repeated*; they lose all their lines except in the document of the largest id.
Repeated keys are also kept in cuckoo filters, one per shard of the key space; probing postings against
the filters of their shards leaves few rows for the exact join. Because a cuckoo filter forgets
keys as well as it learns them, and because the postings know every holder, documents can be added
and deleted at any time; lines dropped because of a document that is gone come back.

Scale: counts are combined before the shuffle, so a line held by any share of the documents costs
one row per task. A probe is dealt by (shard, salt of the document), each with its own copy of one
filter of bounded size, and streamed: neither a frequent line nor a shard is gathered in memory.

Keys are 128-bit hashes (two longs). Defined results: a null or empty text is one empty line; rows are
documents: two rows of one id count as two, and both keep the line if that id is the largest; a null
id is the smallest id; empty tables give empty tables; other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import mapped, slices, stored, unused
from .cuckoo import MAX_LOAD, CuckooFilter

MIN_CHARS = 20
MIN_DOCS = 3
#: Keys in the filter of one shard, about: 0.7 MB of filter.
SHARD_KEYS = 200_000
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: str, min_chars: int = MIN_CHARS) -> tuple[int, int] | None:
    """128-bit key of a line as two signed longs; None if the line is too short to count."""
    bare = line.strip(SPACE)
    if len(bare) < min_chars:
        return None
    raw = xxhash.xxh3_128_digest(bare.encode("utf-8", "surrogatepass").lower())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def postings_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, k1, k2): the distinct keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            at: list[int] = []
            keys: list[tuple[int, int]] = []
            for i, text in enumerate(part.column(1).to_pylist()):
                own = {k for line in set((text or "").split("\n")) if (k := line_key(line, min_chars))}
                keys += own
                at += [i] * len(own)
            k = np.array(keys, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(k[:, 0]), pa.array(k[:, 1])], names=["doc_id", "k1", "k2"])

    return mapped(docs.select(F.col(id_col).cast("long"), text_col), run, "doc_id long, k1 long, k2 long")


def counts_of(postings: DataFrame) -> DataFrame:
    """(k1, k2, n_docs, last_id) of every key."""
    return postings.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_id"))


@dataclass
class LineIndex:
    """Stored tables of the exact side, and the filters of the repeated keys."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame  # (shard int, filter binary)
    n_shards: int
    min_docs: int = MIN_DOCS

    def repeated(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs)


def _shard(n: int):
    """Shard of a key: by bits that the filters don't use for their buckets."""
    return F.pmod(F.shiftrightunsigned(F.col("k2"), 20), F.lit(n)).cast("int")


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
    postings = stored(postings_of(docs, id_col, text_col, min_chars), "line-postings")
    counts = stored(counts_of(postings), "line-counts")
    return _with_filters(postings, counts, min_docs)


def _with_filters(postings: DataFrame, counts: DataFrame, min_docs: int) -> LineIndex:
    repeated = counts.where(F.col("n_docs") >= min_docs)
    n_shards = max(1, -(-repeated.count() // SHARD_KEYS))
    empty = postings.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"), F.lit(None).cast("binary").alias("filter"))
    added = repeated.select(_shard(n_shards).alias("shard"), "k1", "k2", F.lit(True).alias("adds"))
    return LineIndex(postings, counts, stored(apply_changes(empty, added), "line-filters"), n_shards, min_docs)


def apply_changes(filters: DataFrame, changes: DataFrame) -> DataFrame:
    """Filters (shard, filter) after ``changes`` (shard, k1, k2, adds): removals first, then additions.

    A shard's filter and changes meet in one sorted stream; its changes are bounded as its keys are.
    """
    both = filters.select("shard", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "filter").unionByName(
        changes.select("shard", F.when(F.col("adds"), 2).otherwise(1).alias("kind"), "k1", "k2", F.lit(None).cast("binary").alias("filter"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, raw, gone, new = None, None, [], []

        def done() -> pa.RecordBatch:
            removed, added = (np.concatenate(x) if x else np.zeros((0, 2), np.int64) for x in (gone, new))
            held = CuckooFilter.from_bytes(raw) if raw else CuckooFilter(max(len(added), 1024))
            held.delete(removed[:, 0], removed[:, 1])
            held.insert(added[:, 0], added[:, 1])
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([held.to_bytes()], pa.binary())], names=["shard", "filter"])

        for batch in batches:
            s, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], 1)
            for start, end in _runs(s):
                if s[start] != shard:
                    if shard is not None:
                        yield done()
                    shard, raw, gone, new = int(s[start]), None, [], []
                if kind[start] == 0:
                    raw = batch.column(4)[int(start)].as_py()
                k = kind[start:end]
                gone.append(keys[start:end][k == 1])
                new.append(keys[start:end][k == 2])
        if shard is not None:
            yield done()

    return mapped(both.repartition("shard").sortWithinPartitions("shard", "kind"), run, "shard int, filter binary")


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of runs of equal values."""
    if not len(values):
        return []
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def probe(index: LineIndex, postings: DataFrame) -> DataFrame:
    """Postings that their shard's filter holds: all of repeated keys, and few others."""
    spark = postings.sparkSession
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // index.n_shards))
    rows = postings.select(_shard(index.n_shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "doc_id", "k1", "k2", F.lit(None).cast("binary").alias("filter"))
    copies = index.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), *(F.lit(None).cast("long").alias(c) for c in ("doc_id", "k1", "k2")), "filter")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: CuckooFilter | None = None
        for batch in batches:
            kind = batch.column(2).to_numpy()
            for start, end in _runs(np.cumsum(kind == 0)):
                if kind[start] == 0:
                    held = CuckooFilter.from_bytes(batch.column(6)[int(start)].as_py())
                    start += 1
                part = batch.slice(start, end - start).select([3, 4, 5])
                if part.num_rows and held is not None:
                    yield part.filter(pa.array(held.contains(part.column(1).to_numpy(), part.column(2).to_numpy())))

    dealt = rows.unionByName(copies).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return mapped(dealt, run, "doc_id long, k1 long, k2 long")


def dropped_keys(index: LineIndex) -> DataFrame:
    """(doc_id, keys): for each document that loses lines, the keys it loses (no more than its lines)."""
    exact = index.repeated().select("k1", "k2", "last_id")
    found = probe(index, index.postings).join(exact, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("last_id")))
    return found.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("keys"))


def insert(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> LineIndex:
    """The index with more documents; only filters of shards with newly repeated keys change."""
    new = stored(postings_of(docs, id_col, text_col, min_chars), "line-postings")
    both = index.counts.unionByName(counts_of(new))
    counts = stored(both.groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id")), "line-counts")
    return _changed(index, index.postings.unionByName(new), counts)


def delete(index: LineIndex, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
    """The index without the documents of ``ids``; counts of their keys are taken anew from the postings."""
    gone = ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    kept = stored(index.postings.join(gone, "doc_id", "left_anti"), "line-postings")
    touched = index.postings.join(gone, "doc_id", "left_semi").select("k1", "k2").distinct()
    again = counts_of(kept.join(touched, ["k1", "k2"], "left_semi"))
    counts = stored(index.counts.join(touched, ["k1", "k2"], "left_anti").unionByName(again), "line-counts")
    return _changed(index, kept, counts)


def _changed(index: LineIndex, postings: DataFrame, counts: DataFrame) -> LineIndex:
    """New tables with the filters brought up to date by the difference of the repeated keys.

    An index that has outgrown its shards by a factor of two is sharded anew.
    """
    now = counts.where(F.col("n_docs") >= index.min_docs).select("k1", "k2")
    if now.count() > 2 * SHARD_KEYS * index.n_shards:
        return _with_filters(postings, counts, index.min_docs)
    old = index.repeated().select("k1", "k2")
    shard = _shard(index.n_shards).alias("shard")
    changes = now.join(old, ["k1", "k2"], "left_anti").withColumn("adds", F.lit(True)).unionByName(old.join(now, ["k1", "k2"], "left_anti").withColumn("adds", F.lit(False)))
    # A filter that its keys have outgrown is built anew from all of them.
    sizes = now.groupBy(shard).agg(F.count("*").alias("keys"))
    full = F.coalesce(F.col("keys") > F.lit(MAX_LOAD) * F.octet_length("filter") / 2, F.lit(False))  # two bytes a slot
    state = stored(index.filters.join(sizes, "shard", "left").select("shard", F.when(~full, F.col("filter")).alias("filter"), full.alias("full")), "line-shards")
    outgrown = state.where("full").select("shard")
    part = changes.select(shard, "k1", "k2", "adds").join(outgrown, "shard", "left_anti").unionByName(now.select(shard, "k1", "k2", F.lit(True).alias("adds")).join(outgrown, "shard", "left_semi"))
    filters = stored(apply_changes(state.select("shard", "filter"), part), "line-filters")
    return LineIndex(postings, counts, filters, index.n_shards, index.min_docs)


def rewrite(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the text replaced by what is left of it, and n_lines and n_dropped added (in place of columns of these names)."""
    docs = docs.select(*(c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")))
    lost_id, lost_keys = unused(docs, "lost_id", "lost_keys")
    lost = dropped_keys(index).select(F.col("doc_id").alias(lost_id), F.col("keys").alias(lost_keys))
    joined = docs.join(lost, F.col(id_col).cast("long").eqNullSafe(F.col(lost_id)), "left").select(*docs.columns, lost_keys)
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, lost in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                keep = lines
                if lost:
                    keys = {(x["k1"], x["k2"]) for x in lost}
                    keep = [x for x in lines if line_key(x, min_chars) not in keys]
                    text = "\n".join(keep)
                texts.append(text)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(keep))
            arrays = [part.column(i) if i != at else pa.array(texts, pa.string()) for i in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=schema.fieldNames())

    return mapped(joined, run, schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Build the index of ``docs`` and rewrite them by it."""
    return rewrite(docs, build(docs, id_col, text_col, min_chars, min_docs), id_col, text_col, min_chars)
