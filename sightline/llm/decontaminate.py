r"""Benchmark decontamination with DataFrame functions only.

Words are runs of letters and digits of the lower-cased text. Each five-word shingle of a document that
also occurs in a benchmark item places a window: as long as the item, where the item would have to
lie. (A window that shares no shingle with an item has similarity 0 to it, so no other window can
match.) Windows and items get 64-bit SimHash fingerprints; these are cut into RADIUS + 1 blocks, and
window and item meet where a block is equal, which by the pigeonhole principle holds for all
fingerprints within RADIUS bits. Candidates within the radius are verified by the exact weighted
shingle similarity sum(min) / sum(max), a shingle weighing as many characters as it has, times its
occurrences.

Scale: the items' shingles are broadcast up to a checked number of rows, and shuffled beyond it; what
follows is in proportion to the windows found, not to the corpus. Texts of documents with windows
are fetched by one join on the id (a broadcast of the windows up to a checked number, a shuffle
beyond), and each is split once for all its windows.

What the index can do here: at a similarity of 0.8 fingerprints of 64 bits differ in some 10 bits, at times in
more than 15, so the radius that loses nothing leaves blocks of two bits. Such blocks alone would pair
each window with each item; a window is therefore looked up among the blocks of the item that placed
it, and the blocks are a guarantee rather than a saving.

Defined results: null texts and texts or items of fewer than five words match nothing; a null id is not
reported; rows of a repeated id are one document, its best window counts; ties go to the earlier
window; an empty benchmark or corpus gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, unused

WIDTH = 5
SIMILARITY = 0.8
#: Fingerprints within so many bits are candidates; (RADIUS + 1) must divide 64.
RADIUS = 31
#: Item shingles up to which they are broadcast (24 bytes each).
BROADCAST_ROWS = 2_000_000
#: Windows up to which the texts of their documents are looked up by a broadcast (some 24 bytes each).
BROADCAST_WINDOWS = 500_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty string can stand at either end."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def shingles(of: Column) -> Column:
    """Hashes of the five-word shingles at each position of a word array."""
    last = F.size(of) - F.lit(WIDTH)
    every = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(of, i + k) for k in range(WIDTH))))
    return F.when(last >= 0, every).otherwise(F.array().cast("array<bigint>"))


def weights(of: Column) -> Column:
    """Characters of the shingle at each position."""
    last = F.size(of) - F.lit(WIDTH)
    every = F.transform(F.sequence(F.lit(0), last), lambda i: sum((F.length(F.get(of, i + k)) for k in range(1, WIDTH)), F.length(F.get(of, i))))
    return F.when(last >= 0, every).otherwise(F.array().cast("array<int>"))


def fingerprints(masses: DataFrame, keys: list[str]) -> DataFrame:
    """64-bit SimHash of each group of (h, mass) rows: the sign of the weighted votes on every bit, ties set."""
    votes = [F.sum(F.when(F.getbit("h", F.lit(b)) == 1, F.col("mass")).otherwise(-F.col("mass"))).alias(f"b{b}") for b in range(64)]
    value = F.lit(0).cast("long")
    for b in range(64):
        value = value.bitwiseOR(F.shiftleft((F.col(f"b{b}") >= 0).cast("long"), b))
    return masses.groupBy(*keys).agg(*votes).select(*keys, value.alias("print"))


def _blocks(print_: Column) -> Column:
    """(number, value) of each block of a fingerprint."""
    bits = 64 // (RADIUS + 1)
    return F.explode(F.array(*(F.struct(F.lit(k).alias("block"), (F.shiftrightunsigned(print_, k * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))).alias("value")) for k in range(RADIUS + 1)))).alias("b")


def _masses(rows: DataFrame, keys: list[str], words_col: str) -> DataFrame:
    """(keys, h, mass): each distinct shingle of a row's words and its characters over all occurrences."""
    zipped = F.arrays_zip(shingles(F.col(words_col)).alias("h"), weights(F.col(words_col)).alias("w"))
    return rows.select(*keys, F.explode(zipped).alias("z")).groupBy(*keys, F.col("z.h").alias("h")).agg(F.sum("z.w").alias("mass"))


def item_table(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, item_words): the items that are long enough, without empty words at their ends."""
    part = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    own = F.filter(words(F.col(text_col)), lambda w: w != "")
    return part.select(F.col(id_col).alias("item_id"), own.alias("item_words")).where(F.size("item_words") >= WIDTH)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance, similarity) of every document and item found in it."""
    items = item_table(benchmark, item_id_col, item_text_col)
    placed = items.select("item_id", F.size("item_words").alias("n_words"), F.posexplode(shingles(F.col("item_words"))).alias("at", "h"))
    if placed.count() <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    # An outer generator: for an inner one Spark infers a filter that would split every text twice. The
    # word array stays a local variable of the generated loop; no copy of it leaves the loop.
    own = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("doc_words"))
    placed_words = own.select("doc_id", "doc_words", F.posexplode_outer("doc_words").alias("pos", "first"))
    hashed = placed_words.where(F.col("pos") <= F.size("doc_words") - WIDTH).select("doc_id", "pos", F.xxhash64("first", *(F.get("doc_words", F.col("pos") + k) for k in range(1, WIDTH))).alias("h"))
    hits = hashed.join(placed, "h")
    windows = stored(hits.select("doc_id", "item_id", "n_words", (F.col("pos") - F.col("at")).alias("start_word")).distinct(), "places")

    # Each text is split once, for all of its windows; only texts of documents with windows travel.
    few = windows.count() <= BROADCAST_WINDOWS
    of_doc = windows.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "n_words", "start_word")).alias("places"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    cut = lambda w: F.slice("doc_words", F.greatest(w["start_word"], F.lit(0)) + 1, w["n_words"] + F.least(w["start_word"], F.lit(0)))
    keys = ["doc_id", "item_id", "start_word", "n_words", "key"]
    held = texts.join(F.broadcast(of_doc) if few else of_doc, "doc_id").select("doc_id", "places", words(F.col("_text")).alias("doc_words"))
    found = held.select("doc_id", F.explode(F.transform("places", lambda w: F.struct(w["item_id"].alias("item_id"), w["n_words"].alias("n_words"), w["start_word"].alias("start_word"), cut(w).alias("window")))).alias("w"))
    found = found.select("doc_id", "w.item_id", "w.start_word", "w.n_words", "w.window")
    found = found.withColumn("key", F.xxhash64("doc_id", "start_word", "window"))
    of_window = stored(_masses(found, keys, "window"), "windows")
    of_item = stored(_masses(items, ["item_id"], "item_words"), "items")

    met = (
        fingerprints(of_window, keys).select("*", _blocks(F.col("print"))).select(*keys, "print", "b.*")
        .join(fingerprints(of_item, ["item_id"]).select("item_id", F.col("print").alias("item_print"), _blocks(F.col("print"))).select("item_id", "item_print", "b.*"), ["item_id", "block", "value"])
        .withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))))
        .where(F.col("distance") <= RADIUS).select(*keys, "distance").distinct()
    )
    of_item = of_item.withColumnRenamed("mass", "item_mass")
    of_window = of_window.join(met, keys)
    keys.append("distance")
    total = of_item.groupBy("item_id").agg(F.sum("item_mass").alias("item_total"))
    both = of_window.join(of_item, ["item_id", "h"], "left").groupBy(*keys).agg(F.sum("mass").alias("total"), F.sum(F.least("mass", F.coalesce("item_mass", F.lit(0)))).alias("shared"))
    similarity = F.col("shared") / (F.col("total") + F.col("item_total") - F.col("shared"))
    good = both.join(total, "item_id").withColumn("similarity", similarity).where(F.col("similarity") >= SIMILARITY)
    best = F.max_by(F.struct("start_word", "n_words", "distance", "similarity"), F.struct(F.col("similarity"), -F.col("start_word"))).alias("best")
    return good.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents in which an item was found."""
    (name,) = unused(docs, "bad")
    bad = leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col(id_col).cast("long") == F.col(name), "left_anti")
