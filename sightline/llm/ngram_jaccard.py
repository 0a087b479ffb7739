r"""N-gram Jaccard join: parity sketches, pigeonhole keys within size bands, exact verification.

Documents are sets of word shingles; equal sets are one *class*. Classes whose sketches agree in a
block (see ``parity_sketch``) are candidates; a candidate pair is a link if its exact Jaccard
similarity reaches p/q. The operators return classes, their links' components, and pairs of classes.

No pair of rows of one bucket is written out. A bucket first tests its least own class against each
other member (a star): pairs that sizes and bit sketches rule out are never verified, the rest in two rounds,
of which the second takes only pairs still apart. Components of those links make most members of a group
of near copies one. In buckets that still hold several components the rest is compared tile against
tile: members and their whole bit sketches meet in tasks of bounded size, and only pairs of different
components whose sketch distance the bound allows leave the task, to be verified. So every pair that
can be a link and that could still change a component is verified, whatever the size of its bucket.

``join`` therefore has the links that make the components. ``all_links`` verifies every candidate pair of
classes instead, whatever its component, and so has every link and the number of links of each
document; in a group of k near copies of different texts these are k^2 / 2 by nature.

To verify, a pair's second text travels to the first: each first class has its text once for HEAD_PAIRS
pairs, so a class with very many partners is spread over many tasks.

Set ids, shingles and keys are 64-bit hashes: two different sets share an id with probability 2^-64.

Defined results: words are ``[^\x20\x09-\x0D]+`` with A-Z lower-cased; a text with fewer words than a
shingle is one shingle; null or blank texts are empty sets, linked with nothing, and are their own
component; rows are documents, and repeated rows of one id fall into one component if their sets
do; a null id comes out with its set's component but is never a component's id (null if no other id
is there), and its text counts as any other; empty tables give empty tables; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import mapped, merged, release, slices, stored, unused, words_of
from .components import components
from .parity_sketch import bands, mix, set_id, shingle_set

#: Bits of a sketch, a power of two: as many as the set has shingles, within these bounds. A sketch of
#: fewer bits than shingles rules little out. Tiles compare sketches folded to TILE_BITS.
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 16
TILE_BITS = 1 << 9
#: Members of a tile.
TILE = 512
#: Pairs of one first class that meet a copy of its text.
HEAD_PAIRS = 64
#: Ids up to which the texts of some classes are looked up by a broadcast (some 20 bytes each); beyond it both sides are shuffled.
BROADCAST_IDS = 500_000
#: Pairs of key and class that a task packs at a time: 4 MB, some six times that while they are sorted.
PACK_KEYS = 1 << 18


@dataclass
class JaccardJoin:
    """What the join of a table has found. ``documents``: one row per document; ``links``: tested pairs of classes."""

    signatures: DataFrame  # doc_id, n, node
    links: DataFrame  # a, b: similar classes, each pair that was verified and holds
    labels: DataFrame  # node, label: components of classes with a link


def signatures(docs: DataFrame, width: int, p: int, q: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, node, sketch): size, set id (null if empty) and bit sketch of each document.

    A task gives sketches for the first document of a class alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set()
        for part in slices(batches):
            n, node, sketch = [], [], []
            for text in part.column(1).to_pylist():
                s = shingle_set(words_of(text), width)
                n.append(len(s))
                i = set_id(s) if len(s) else None
                node.append(i)
                new = i is not None and i not in known
                sketch.append(_sketch(s) if new else None)
                known.add(i)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.binary())], names=["doc_id", "n", "node", "sketch"])

    return mapped(docs.select(F.col(id_col).cast("long"), text_col), run, "doc_id long, n long, node long, sketch binary")


def _packed_keys(docs: DataFrame, width: int, p: int, q: int, buckets: int, text_col: str = "text") -> DataFrame:
    """(bucket, keys, nodes): band keys with the set ids they stand for, packed by key range.

    A task packs up to PACK_KEYS pairs at a time, and gives the keys of a class once. Packed, a pair
    is 16 bytes in the shuffle; as a row of its own it would be about 24.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how, known, keys, nodes, held = bands(p, q), set(), [], [], 0

        def pack() -> pa.RecordBatch:
            k, v = np.concatenate(keys), np.repeat(np.array([x for x, _ in nodes], np.int64), [c for _, c in nodes])
            at = (((k.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(at, kind="stable")
            at, k, v = at[order], k[order], v[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            cuts = pa.array(np.append(first, len(at)).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(at[first]), pa.ListArray.from_arrays(cuts, pa.array(k)), pa.ListArray.from_arrays(cuts, pa.array(v))], names=["bucket", "keys", "nodes"])

        for part in slices(batches):
            for text in part.column(0).to_pylist():
                s = shingle_set(words_of(text), width)
                i = set_id(s) if len(s) else None
                if i is None or i in known:
                    continue
                known.add(i)
                mine = how.keys(s).view(np.int64)
                if len(mine):
                    keys.append(mine)
                    nodes.append((i, len(mine)))
                    held += len(mine)
                if held >= PACK_KEYS:
                    yield pack()
                    keys, nodes, held = [], [], 0
        if held:
            yield pack()

    return mapped(docs.select(text_col), run, "bucket int, keys array<long>, nodes array<long>")


def _members(packed: DataFrame) -> DataFrame:
    """(key, node, head, own): the classes of each key that an own class shares with others, and the least own one.

    One shuffle by key range; a task then sorts its pairs (spilling if need be) and streams them, so
    it holds one batch whatever the size of a key's group. Own classes come first, by the key's last bit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the open run: last key and node, its head, whether that is own, its members so far
        for batch in batches:
            if not batch.num_rows:
                continue
            k, v = (batch.column(c).to_numpy() for c in (0, 1))
            if before:
                k, v = np.append(before[0], k), np.append(before[1], v)
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
            k, v = k[new], v[new]
            group = k >> 1
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            length = np.diff(np.append(first, len(k)))
            size, head, own = length.copy(), v[first], (k[first] & 1) == 0
            if before:
                size[0] += before[4] - 1
                head[0], own[0] = before[2], before[3]
            give = np.repeat((size > 1) & own, length)
            if before and before[4] > 1:
                give[0] = False  # given with the batch before
            heads = np.repeat(head, length)
            before = (k[-1], v[-1], heads[-1], bool(own[-1]), int(size[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(k[give] & ~1), pa.array(v[give]), pa.array(heads[give]), pa.array((k[give] & 1) == 0)], names=["key", "node", "head", "own"])

    pairs = packed.repartition("bucket").select(F.inline(F.arrays_zip("keys", "nodes")).alias("key", "node"))
    return mapped(pairs.sortWithinPartitions("key", "node"), run, "key long, node long, head long, own boolean")


def _sketch(hashes: np.ndarray) -> bytes | None:
    """Parity bits of a set; only sets that can have partners need one."""
    if not len(hashes):
        return None
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (len(hashes) - 1).bit_length()))
    at = mix(hashes) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(sketch: bytes, bits: int = TILE_BITS) -> bytes:
    """The parity sketch of ``bits`` bits: exclusive or of halves, so distances never grow."""
    x = np.frombuffer(sketch, np.uint8)
    while len(x) * 8 > bits:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def _distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Hamming distance of each pair of sketches, the longer one folded to the shorter."""
    out = np.zeros(len(left), np.int64)
    groups: dict[int, list[int]] = {}
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        groups.setdefault(min(len(x), len(y)), []).append(i)
    for size, rows in groups.items():
        for at in range(0, len(rows), 1024):
            some = rows[at : at + 1024]
            x, y = (np.frombuffer(b"".join(v[i] if len(v[i]) == size else _folded(v[i], 8 * size) for i in some), np.uint64).reshape(len(some), -1) for v in (left, right))
            out[some] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return out


@dataclass
class _Texts:
    """Where the texts of classes are found: by a document's id, or among the documents without id."""

    docs: DataFrame  # first_id, text
    first_ids: DataFrame  # node, first_id
    width: int

    def ids(self, nodes: DataFrame) -> DataFrame:
        """(node, first_id) of ``nodes``, stored."""
        return stored(nodes.join(merged(self.first_ids), "node", "left"), "ids")

    def of(self, ids: DataFrame) -> DataFrame:
        """(node, text) of classes. An id of several rows gives several texts; readers take the one of the class."""
        width = self.width

        def of_null_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = set()
            for part in slices(batches):
                rows = [(set_id(s), t) for t in part.column(0).to_pylist() if len(s := shingle_set(words_of(t), width))]
                rows = [r for r in dict(rows).items() if r[0] not in known]
                known.update(i for i, _ in rows)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], names=["node", "text"])

        with_id, without = ids.where("first_id is not null"), ids.where("first_id is null").select("node")
        if ids.count() <= BROADCAST_IDS:
            with_id, without = F.broadcast(with_id), F.broadcast(without)
        found = self.docs.where("first_id is not null").join(with_id, "first_id").select("node", "text")
        return found.unionByName(mapped(self.docs.where("first_id is null").select("text"), of_null_ids, "node long, text string").join(without, "node"))


def verified(pairs: DataFrame, texts: _Texts, p: int, q: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose exact similarity reaches p/q, stored."""
    width = texts.width
    ids = texts.ids(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    need = stored(texts.of(ids), "texts")
    release(ids)
    heads = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(HEAD_PAIRS)).cast("int").alias("salts"))
    first = heads.withColumnRenamed("a", "node").join(merged(need), "node").select(F.col("node").alias("a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "node", "text")
    second = pairs.join(merged(heads), "a").select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("b").alias("node")).join(merged(need), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how, at, mine = bands(p, q), None, None
        for part in slices(batches):
            good = []
            for a, salt, kind, node, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if at != (a, salt):
                    at, mine = (a, salt), None
                s = shingle_set(words_of(text), width)
                own = len(s) > 0 and set_id(s) == node
                if kind == 0 and own:
                    mine = s
                good.append(kind == 1 and own and mine is not None and how.similar(mine, s))
            yield part.select([0, 3]).rename_columns(["a", "b"]).filter(pa.array(good, pa.bool_()))

    met = first.unionByName(second.select(*first.columns)).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    links = stored(mapped(met, run, "a long, b long").distinct(), "links")
    release(need)
    return links


def _tile_pairs(members: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs (a, b) of different components within a bucket, one of them own, that size and sketch bounds allow.

    ``members``: key, node, own, label, n, sketch, size (of the bucket). A bucket of up to TILE members is one
    tile; a larger one is dealt to tiles by the node's hash, and each pair of tiles is a group of its own.
    Folded sketches are compared first; what they allow meets the whole sketches in the same task.
    """
    tiles = F.ceil(F.col("size") / F.lit(TILE)).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    dealt = (
        members.withColumn("tiles", tiles).withColumn("mine", mine).select("key", "node", "label", "n", "sketch", "own", "mine", others)
        .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "label", "n", "own", "sketch")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how, group, rows = bands(p, q), None, []

        def pairs() -> pa.RecordBatch:
            mine, node, label, n, own = (np.concatenate([r[k] for r in rows]) for k in range(5))
            sketch = [x for r in rows for x in r[5]]
            bits = np.frombuffer(b"".join(map(_folded, sketch)), np.uint64).reshape(len(sketch), -1)
            out: set[tuple[int, int]] = set()
            for i in range(len(node)):
                # within one tile each pair once; between two tiles first against second
                if group[1] == group[2]:
                    rest = np.arange(i + 1, len(node))
                elif mine[i] == group[1]:
                    rest = np.flatnonzero(mine == group[2])
                else:
                    continue
                limit = (n[rest] + n[i]) * (how.q - how.p) // (how.q + how.p)
                near = (label[rest] != label[i]) & (own[rest] | own[i]) & (np.minimum(n[rest], n[i]) * how.q >= np.maximum(n[rest], n[i]) * how.p)
                rest, limit = rest[near], limit[near]
                near = np.bitwise_count(bits[rest] ^ bits[i]).sum(1) <= limit
                rest, limit = rest[near], limit[near]
                rest = rest[_distances([sketch[i]] * len(rest), [sketch[j] for j in rest]) <= limit]
                out.update((min(x, int(node[i])), max(x, int(node[i]))) for x in node[rest].tolist())
            got = np.array(sorted(out), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

        for batch in batches:
            key, i, j, mine, node, label, n = (batch.column(c).to_numpy() for c in range(7))
            own, sketch = batch.column(7).to_numpy(zero_copy_only=False), batch.column(8).to_pylist()
            change = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            cuts = [0, *change.tolist(), len(key)] if len(key) else [0]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                now = (key[s], i[s], j[s])
                if group is not None and now != group:
                    yield pairs()
                    rows = []
                group = now
                rows.append((mine[s:e], node[s:e], label[s:e], n[s:e], own[s:e], sketch[s:e]))
        if rows:
            yield pairs()

    return mapped(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), run, "a long, b long").distinct()


def _within_bound(pairs: DataFrame, facts: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs (a, b) whose sizes and bit sketches do not rule out a similarity of p/q."""
    left, right = (facts.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x, y = part.column(2).to_numpy(), part.column(4).to_numpy()
            near = _distances(*(part.column(c).to_pylist() for c in (3, 5))) <= (x + y) * (q - p) // (q + p)
            near &= np.minimum(x, y) * q >= np.maximum(x, y) * p
            yield part.select([0, 1]).filter(pa.array(near))

    met = pairs.join(merged(left), "a").join(merged(right), "b").select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b")
    return mapped(met, run, "a long, b long")


def _extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Component labels once more links are known, in place of those before."""
    more = stored(components(labels.select(F.col("label").alias("a"), F.col("node").alias("b")).unionByName(links)), "labels")
    release(labels)
    return more


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components."""
    for x in ("a", "b"):
        pairs = pairs.join(merged(labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))), x, "left")
    return pairs.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def _found(docs: DataFrame, width: int, p: int, q: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, _Texts]:
    """Stored tables: documents (doc_id, n, node), classes with size and sketches, members of shared keys; and the texts."""
    signed = stored(signatures(docs, width, p, q, id_col, text_col), "signatures")
    every = stored(signed.select("doc_id", "n", "node"), "documents")
    facts = stored(signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("sketch", True).alias("sketch")), "classes")
    release(signed)
    # Most keys stand for one class alone: they meet in one shuffle, and none is stored.
    spread = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = stored(_members(_packed_keys(docs, width, p, q, spread, text_col)), "members")
    return every, facts, members, _Texts(docs.select(F.col(id_col).cast("long").alias("first_id"), F.col(text_col).alias("text")), facts.select("node", "first_id"), width)


def join(docs: DataFrame, width: int = 3, p: int = 9, q: int = 10, id_col: str = "doc_id", text_col: str = "text") -> JaccardJoin:
    """The components of ``docs`` by links of Jaccard similarity of at least p/q, and the links that make them."""
    every, facts, members, texts = _found(docs, width, p, q, id_col, text_col)
    star = stored(_within_bound(members.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), facts, p, q), "star")

    # First one head for each class, then the heads that are still in other components.
    first = star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = verified(first, texts, p, q)
    labels = stored(components(links), "labels")
    second = stored(_apart(star.join(merged(first), ["a", "b"], "left_anti"), labels), "star-rest")
    if second.limit(1).count():
        found = verified(second, texts, p, q)
        links, labels = links.unionByName(found), _extended(labels, found)

    # What the stars leave: buckets of several components, the pairs of which are not all tested.
    label = labels.select("node", "label")
    marked = members.join(merged(label), "node", "left").select("key", "node", "own", F.coalesce("label", "node").alias("label"))
    open_keys = marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo < hi and size > 2").select("key", "size")
    rest = marked.join(merged(open_keys), "key").join(merged(facts), "node").select("key", "node", "own", "label", "n", "sketch", "size")
    more = stored(_tile_pairs(rest, p, q).join(merged(star), ["a", "b"], "left_anti"), "rest")
    if more.limit(1).count():
        found = verified(more, texts, p, q)
        links, labels = links.unionByName(found), _extended(labels, found)
    for table in (facts, members, star, second, more):
        release(table)
    return JaccardJoin(every, links, labels)


def all_links(docs: DataFrame, width: int = 3, p: int = 9, q: int = 10, id_col: str = "doc_id", text_col: str = "text") -> JaccardJoin:
    """As ``join``, with every link between classes: each candidate pair is verified, none is left to the components."""
    every, facts, members, texts = _found(docs, width, p, q, id_col, text_col)
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    every_pair = members.withColumn("label", F.col("node")).join(merged(sizes), "key").join(merged(facts), "node").select("key", "node", "own", "label", "n", "sketch", "size")
    pairs = stored(_tile_pairs(every_pair, p, q), "pairs")
    links = verified(pairs, texts, p, q)
    for table in (facts, members, pairs):
        release(table)
    return JaccardJoin(every, links, stored(components(links), "labels"))


def link_counts(found: JaccardJoin) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document of ``all_links``; documents of equal sets are linked."""
    sizes = found.signatures.where("node is not null").groupBy("node").agg(F.count("*").alias("docs"))
    ends = found.links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")
    others = ends.join(merged(sizes.withColumnRenamed("node", "other")), "other").groupBy("node").agg(F.sum("docs").alias("linked"))
    counts = sizes.join(merged(others), "node", "left").select("node", (F.col("docs") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return document_components(found).join(merged(counts), "node", "left").select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def document_components(found: JaccardJoin) -> DataFrame:
    """(doc_id, n_shingles, node, label, component_id) of every document; the id is the least of its component."""
    live = found.signatures.where("node is not null")
    classes = live.groupBy("node").agg(F.min("doc_id").alias("first_id")).join(merged(found.labels), "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("label"))
    ids = classes.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_node = classes.join(merged(ids), "label").select("node", "label", "component_id")
    linked = live.join(merged(of_node), "node").select("doc_id", F.col("n").alias("n_shingles"), "node", "label", "component_id")
    empty = found.signatures.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), "node", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(empty)


def near_duplicates(docs: DataFrame, width: int = 5, p: int = 4, q: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``: a row of its least id.

    Rows without words stay. Rows of a repeated or null id are told apart by their sets: of a component
    whose least id has several rows, or that has no id, the row of the least text stays.
    """
    found = join(docs, width, p, q, id_col, text_col)
    parts = stored(document_components(found), "components")
    for table in (found.signatures, found.links, found.labels):
        release(table)
    live = parts.where("node is not null")
    an_id, flag, node, component, label, row = unused(docs, "id", "several", "node", "component", "label", "row")
    # Ids whose rows an id alone cannot tell apart; all others stay or go by their id.
    several = parts.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias(an_id), F.lit(True).alias(flag))
    gone = live.where("component_id < doc_id").select(F.col("doc_id").alias(an_id)).distinct().join(merged(several), an_id, "left_anti").withColumn(flag, F.lit(False))
    marks = stored(gone.unionByName(several), "marks")
    marked = docs.join(marks, F.col(id_col).cast("long") == F.col(an_id), "left")
    single = marked.where(F.col(flag).isNull() & F.col(id_col).isNotNull()).select(*docs.columns)

    at = docs.columns.index(text_col)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingle_set(words_of(t), width) for t in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())], names=[*part.schema.names, node])

    odd = marked.where(F.col(flag)).select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
    odd = mapped(odd, nodes, StructType([*docs.schema.fields, StructField(node, LongType())]))
    of_node = live.select(F.col("node").alias(node), F.col("component_id").alias(component), F.col("label").alias(label)).distinct()
    first = odd.where(F.col(node).isNotNull()).join(of_node, node).where(F.col(component).isNull() | (F.col(id_col).cast("long") == F.col(component)))
    first = first.groupBy(label).agg(F.min_by(F.struct(*docs.columns), F.col(text_col)).alias(row)).select(f"{row}.*")
    return single.unionByName(first).unionByName(odd.where(F.col(node).isNull()).select(*docs.columns))
