"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are first cut at *safe boundaries*: places where every match of the pre-splitting
pattern must end, so that the pieces encode to the same ids as the whole. No match of the pattern
holds a white-space character directly after a character that is not one, hence a cut before a
space or line feed that follows a letter, digit or ASCII punctuation is safe. Runs of white space
too long for the backtracking matcher are taken out whole and encoded as the pieces they are.

Defined results: a null text counts as empty (no ids, no bytes); empty texts have no ids; repeated
rows and repeated or null ids each give their own row; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import mapped, slices

#: Characters of a text up to which it is encoded in one call.
CHUNK_CHARS = 1 << 16
#: White-space runs of this length or more never reach the backtracking matcher.
LONG_RUN = 1 << 12

_CUT = regex.compile(r"(?<=[A-Za-z0-9.,;:!?\p{L}])(?=[ \n])")
_RUN = regex.compile(r"\p{White_Space}{%d,}" % LONG_RUN)


class ByteBPE:
    """A tiktoken encoding over a local rank file, safe for texts of any length."""

    def __init__(self, rank_path: str, pattern: str):
        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.build(ranks, pattern)

    def build(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text; special tokens are ordinary text."""
        if not text:
            return []
        if len(text) <= CHUNK_CHARS:
            return self._plain(text)
        ids: list[int] = []
        start = 0
        while start < len(text):
            end = self._boundary(text, start)
            ids += self._plain(text[start:end])
            start = end
        return ids

    @staticmethod
    def _boundary(text: str, start: int) -> int:
        """The first safe boundary at least CHUNK_CHARS after ``start``, else the end."""
        if len(text) - start <= CHUNK_CHARS:
            return len(text)
        found = _CUT.search(text, start + CHUNK_CHARS)
        return found.start() if found else len(text)

    def _plain(self, text: str) -> list[int]:
        if len(text) < LONG_RUN or not (run := _RUN.search(text)):
            return self.encoding.encode_ordinary(text)
        # A run ends a match before it (nothing but white space follows non-white space). The pattern
        # takes the whole run at the end of the text; else all but its last character, which a space
        # joins to what follows and which otherwise is a piece of its own.
        ids: list[int] = []
        start = 0
        while run:
            ids += self.encoding.encode_ordinary(text[start : run.start()])
            cut = run.end() if run.end() == len(text) else run.end() - 1
            ids += self.encoding._core_bpe.encode_single_piece(text[run.start() : cut].encode())
            start, run = cut, _RUN.search(text, cut)
        return ids + self.encoding.encode_ordinary(text[start:])

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The raw bytes of the ids, which need not be valid UTF-8 for a part of a text."""
        return self.encoding.decode_bytes(ids)


@lru_cache(maxsize=4)
def load(rank_path: str, pattern: str) -> ByteBPE:
    """One encoder per Python worker and rank file."""
    return ByteBPE(rank_path, pattern)


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     keep_ids: bool = True, keep_bytes: bool = False) -> DataFrame:
    """(id, n_tokens, ids?, decoded?, ids_sha256, decoded_sha256) of every whole text.

    ``ids`` are the token ids, ``decoded`` the raw bytes that they decode to. ``rank_path`` is a file
    that every executor has. Narrow: no shuffle, and one encoded text in memory at a time.
    """
    id_type = docs.schema[id_col].dataType
    fields = [f"n_tokens long", *["ids array<int>"] * keep_ids, *["decoded binary"] * keep_bytes, "ids_sha256 string", "decoded_sha256 string"]
    schema = f"`{id_col}` {id_type.simpleString()}, " + ", ".join(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rank_path, pattern)
        for part in slices(batches):
            cols: dict[str, list] = {"n_tokens": [], "ids": [], "decoded": [], "ids_sha256": [], "decoded_sha256": []}
            for text in part.column(1).to_pylist():
                ids = bpe.encode(text)
                raw = bpe.decode_bytes(ids)
                cols["n_tokens"].append(len(ids))
                if keep_ids:
                    cols["ids"].append(ids)
                if keep_bytes:
                    cols["decoded"].append(raw)
                cols["ids_sha256"].append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                cols["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
            arrays = {id_col: part.column(0), "n_tokens": pa.array(cols["n_tokens"], pa.int64())}
            if keep_ids:
                arrays["ids"] = pa.array(cols["ids"], pa.list_(pa.int32()))
            if keep_bytes:
                arrays["decoded"] = pa.array(cols["decoded"], pa.binary())
            arrays |= {k: pa.array(cols[k], pa.string()) for k in ("ids_sha256", "decoded_sha256")}
            yield pa.RecordBatch.from_pydict(arrays)

    return mapped(docs.select(id_col, text_col), run, schema)
