"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often in a corpus.

Tokenizer A is a byte-level BPE file of the ``tokenizers`` library, B a ``sentencepiece`` model that adds a space
of its own; both see a space and the text. The ends of each side's tokens are the set bits of a packed bitset
over the bytes of a run of documents. Their AND holds the shared cuts, ranks (running popcounts) turn cuts
into token ranges, and ranks at a token's first and last byte give the tokens of the other side that it meets:
the links. A document's end is a cut of both sides, so one bitset serves many documents.

The document frequency of a linked id pair counts rows; pairs are counted once a document before the shuffle.
The table of pairs is at most as large as the two vocabularies allow. It is broadcast where its counted size is
below BROADCAST_PAIRS; beyond that the same join is shuffled.

Defined results: a null or empty text, and one whose tokens of B do not spell a space and the text (a
character that B cannot give back; A holds every byte), has no tokens: zeros, and '' as digest. Repeated rows and repeated or null ids
each give their own row and count as documents of their own; other columns are not read. An empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBPE
from .common import merged, slices, stored, unused

#: Pairs up to which the table of counts is broadcast; some 40 bytes each.
BROADCAST_PAIRS = 2_000_000
#: Bytes of texts that are aligned at one time.
SLICE_BYTES = 1 << 20


def byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: a printable Latin-1 byte is itself, the others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevelFile(ByteBPE):
    """The BPE of a ``tokenizers`` file, run by rank: ids there follow the order of merges, so the lowest id is the first merge."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        symbols, special = byte_of_symbol(), {t["content"] for t in made["added_tokens"]}
        vocab = {token: i for token, i in made["model"]["vocab"].items() if token not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in made["model"]["merges"]]
        ids = [vocab["".join(m)] for m in merges]
        if not all(c in vocab for c in symbols):
            raise ValueError(f"{path}: a vocabulary without some byte")
        if made["normalizer"] or made["pre_tokenizer"]["type"] != "ByteLevel" or made["pre_tokenizer"]["add_prefix_space"] or any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
            raise ValueError(f"{path}: not a byte-level BPE whose ids follow its merges")
        ranks = {bytes(symbols[c] for c in token): i for token, i in vocab.items()}
        self.build(ranks, pattern)
        self.spelling = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.spelling[i] = token


class PieceFile:
    """A sentencepiece model; pieces spell UTF-8 with U+2581 for a space, ``<0xHH>`` a byte."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.spelling = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class EndBits:
    """A packed bitset of token ends over ``size`` bytes (bit e: a token ends before byte e), with ranks and selects."""

    def __init__(self, words: np.ndarray):
        self.words = words
        counts = np.bitwise_count(words)
        self.before = np.cumsum(counts, dtype=np.int64) - counts

    @staticmethod
    def of(ends: np.ndarray, size: int) -> EndBits:
        bits = np.zeros((size // 64 + 1) * 64, np.uint8)
        bits[ends] = 1
        return EndBits(np.packbits(bits, bitorder="little").view(np.uint64))

    def __and__(self, other: EndBits) -> EndBits:
        return EndBits(self.words & other.words)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set at or below each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
        return self.before[word] + np.bitwise_count(self.words[word] & upto)

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Alignment:
    """The shared cuts and links of two token sequences over the same bytes, given the tokens' lengths."""

    def __init__(self, a_len: np.ndarray, b_len: np.ndarray):
        a_ends, b_ends = np.cumsum(a_len), np.cumsum(b_len)
        size = int(a_ends[-1])
        a, b = EndBits.of(a_ends, size), EndBits.of(b_ends, size)
        self.both = a & b
        self.cuts = self.both.select()
        self.a_cuts, self.b_cuts = a.rank(self.cuts), b.rank(self.cuts)
        self.first = b.rank(a_ends - a_len)
        self.n_links = b.rank(a_ends - 1) - self.first + 1

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(place in A, place in B) of each pair of tokens that share a byte."""
        upto = np.cumsum(self.n_links)
        shift = np.repeat(self.first - (upto - self.n_links), self.n_links)
        return np.repeat(np.arange(len(self.first)), self.n_links), np.arange(len(shift)) + shift

    def merged_order(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens of A and of B in the sequence of groups, each group's A tokens before its B tokens."""
        na, nb = np.diff(self.a_cuts, prepend=0), np.diff(self.b_cuts, prepend=0)
        a_at = np.arange(na.sum()) + np.repeat(self.b_cuts - nb, na)
        return a_at, np.arange(nb.sum()) + np.repeat(self.a_cuts, nb)


class Aligner:
    def __init__(self, a_path: str, b_path: str, pattern: str):
        self.a, self.b = ByteLevelFile(a_path, pattern), PieceFile(b_path)
        self.a_len, self.b_len = (np.array([len(t) for t in side.spelling]) for side in (self.a, self.b))
        # A token and what follows it in a group's text: another of its side, or the end of its side.
        self.words = [b"%d," % i for i in range(len(self.a_len))] + [b"%d|" % i for i in range(len(self.a_len))]
        self.words += [b"%d," % i for i in range(len(self.b_len))] + [b"%d;" % i for i in range(len(self.b_len))]

    def tokens(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides for each text; none where a side does not spell the text."""
        there = [t for t in texts if t]
        found = iter(self.b.encode_all(there)) if there else iter(())
        out = []
        for text in texts:
            a, b = ([], []) if not text else (self.a.encode(" " + text), next(found))
            # A is made of all 256 bytes and drops none, so it spells every text; B may not.
            out.append((a, b) if text and b"".join(map(self.b.spelling.__getitem__, b)) == b" " + text.encode() else ([], []))
        return out

    def align(self, texts: list[str | None]) -> dict[str, list | np.ndarray | pa.Array]:
        """Columns of a run of documents."""
        ids = self.tokens(texts)
        n_a, n_b = (np.array([len(pair[side]) for pair in ids], np.int64) for side in (0, 1))
        out = {"n_a": n_a, "n_b": n_b, "n_groups": np.zeros(len(ids), np.int64), "n_links": np.zeros(len(ids), np.int64), "groups_sha256": [""] * len(ids)}
        live = np.flatnonzero(n_a)
        if not len(live):
            none = pa.array([], pa.int32())
            return out | {"pairs": _pair_lists(np.zeros(len(ids) + 1, np.int64), none, none, none)}
        a, b = (np.concatenate([np.array(ids[i][side], np.int64) for i in live]) for side in (0, 1))
        got = Alignment(self.a_len[a], self.b_len[b])
        a_upto, b_upto = np.cumsum(n_a[live]), np.cumsum(n_b[live])
        doc_of_a = np.repeat(live, n_a[live])
        out["n_links"] = np.bincount(doc_of_a, got.n_links, len(ids)).astype(np.int64)
        group_upto = np.searchsorted(got.a_cuts, a_upto, side="right")
        out["n_groups"][live] = np.diff(group_upto, prepend=0)

        # Texts of the groups: each token's word by its side and whether it ends its side of the group.
        codes = np.empty(len(a) + len(b), np.int64)
        a_at, b_at = got.merged_order()
        a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_last[got.a_cuts - 1] = len(self.a_len)
        b_last[got.b_cuts - 1] = len(self.b_len)
        codes[a_at], codes[b_at] = a + a_last, 2 * len(self.a_len) + b + b_last
        upto = 0
        for i, end in zip(live, a_upto + b_upto, strict=True):
            text = b"".join(map(self.words.__getitem__, codes[upto:end].tolist()))
            out["groups_sha256"][i] = hashlib.sha256(text[:-1]).hexdigest()
            upto = end

        # Each linked id pair once a document, with how often it is linked there.
        at_a, at_b = got.links()
        keys = (doc_of_a[at_a] * len(self.a_len) + a[at_a]) * len(self.b_len) + b[at_b]
        keys.sort()
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        times = np.diff(heads, append=len(keys))
        rest, b_id = np.divmod(keys[heads], len(self.b_len))
        doc, a_id = np.divmod(rest, len(self.a_len))
        offsets = np.searchsorted(doc, np.arange(len(ids) + 1))
        return out | {"pairs": _pair_lists(offsets, *(pa.array(x, pa.int32()) for x in (a_id, b_id, times)))}


def _pair_lists(offsets: np.ndarray, a: pa.Array, b: pa.Array, times: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([a, b, times], ["a", "b", "times"]))


@lru_cache(maxsize=2)
def load(a_path: str, b_path: str, pattern: str) -> Aligner:
    """One pair of tokenizers per Python worker."""
    return Aligner(a_path, b_path, pattern)


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs) of every whole text.

    ``pairs`` are the distinct linked id pairs of a document and how often each is linked. ``groups_sha256`` digests
    ``a1,a2|b1;a3|b2,b3``: the ids of each group. Narrow: no shuffle.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a:int,b:int,times:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(a_path, b_path, pattern)
        for part in slices(batches, size=SLICE_BYTES):
            cols = aligner.align(part.column(1).to_pylist())
            arrays = {id_col: part.column(0)} | {c: pa.array(cols[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}
            yield pa.RecordBatch.from_pydict(arrays | {"groups_sha256": pa.array(cols["groups_sha256"], pa.string()), "pairs": cols["pairs"]})

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n_docs, best): in how many documents each id pair is linked, and whether that is the most of its A id."""
    counts = stored(aligned.select(F.inline("pairs")).groupBy("a", "b").agg(F.count("*").alias("n_docs")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n_docs").alias("_most"))  # a row for each id of A's vocabulary at most
    return counts.join(F.broadcast(most), "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("_most")).alias("best"))


def align_corpus(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``align`` without its pairs, but with n_best (links whose pair is in as many documents as any of its A id) and count_sum (documents of the pair, summed over links)."""
    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    aligned = align(given, a_path, b_path, pattern, "_id", "_text")
    row, n, best = unused(aligned, "row", "n", "best")
    aligned = stored(aligned.withColumn(row, F.monotonically_increasing_id()), "aligned")
    weights = pair_counts(aligned)
    few = weights.count() <= broadcast_pairs
    linked = aligned.select(row, F.inline("pairs")).join(F.broadcast(weights) if few else merged(weights), ["a", "b"])
    sums = linked.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times").cast("long")).otherwise(0)).alias(best), F.sum(F.col("times") * F.col("n_docs")).alias(n))
    out = merged(aligned.drop("pairs")).join(sums, row, "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce(best, zero).alias("n_best"), F.coalesce(n, zero).alias("count_sum"), "groups_sha256")
