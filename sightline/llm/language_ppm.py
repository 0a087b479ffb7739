"""Language identification by prediction by partial matching (PPM) over bytes.

For every language a variable-order byte context tree is counted on a bounded, documented sample of
labelled rows. Its statistics are then frozen: P(s | c) = n(c, s) / (n(c) + q(c)) for a byte s seen
after context c, and an escape of probability q(c) / (n(c) + q(c)) to the next shorter context for any
other (method C; q = number of distinct bytes seen), down to 1/256 below the empty context. The code
length of a whole text under each language's tree is the score; the shortest code wins.

Because the statistics are frozen, the code lengths of all stored (context, byte) strings under *all*
languages are tabulated once. A text is then scored by hash lookups over whole NumPy arrays: a byte
whose longest string is stored takes its row; otherwise it adds the escapes of its context and
tries the next shorter one. The result equals walking the trees byte by byte (tests compare them).

Defined results: a null text, or one without any letter, is ``und`` with score 0; ties go to the first
language in sorted order; without labelled rows every text is ``und``; repeated rows and null ids each
give their own row; other columns of the input are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import mapped, slices, stable_sample

#: Longest context in bytes.
ORDER = 4
#: Labelled rows per language that the trees are counted on, whole ones, and their bytes together at most.
SAMPLE_ROWS = 250
SAMPLE_BYTES = 500_000
#: A text whose best code is longer than this (bits per byte) is in none of the languages.
REJECT_BITS = 7.5
UNDETERMINED = "und"
#: Bytes scored at a time, which bounds the arrays; longer texts are scored in overlapping parts.
BLOCK = 1 << 17
_MULT = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Table:
    """Open-addressing hash table from 64-bit keys to rows of float32."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.at = np.full(1 << bits, _NONE), np.zeros(1 << bits, np.int32)
        self.rows = rows
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):  # each round places the first comer of every free slot
            free = self.keys[slot] == _NONE
            first = np.unique(slot[free], return_index=True)[1]
            placed = np.flatnonzero(free)[first]
            self.keys[slot[placed]], self.at[slot[placed]] = keys[todo[placed]], todo[placed]
            left = np.ones(len(todo), bool)
            left[placed] = False
            todo, slot = todo[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where a key is not stored."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.at[slot], np.int32(-1))
        todo = np.flatnonzero((there != keys) & (there != _NONE))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            there, want = self.keys[slot], keys[todo]
            hit = there == want
            out[todo[hit]] = self.at[slot[hit]]
            more = ~hit & (there != _NONE)
            todo, slot = todo[more], slot[more]
        return out


@dataclass
class PPMModel:
    """Frozen statistics of all languages, ready for array lookups."""

    languages: list[str]
    order: int
    strings: list[_Table]  # by context length k: k+1 bytes -> bits under each language
    escapes: list[_Table]  # by context length k: k bytes -> escape bits under each language

    def code_lengths(self, raw: bytes) -> np.ndarray:
        """Bits of a whole text under each language."""
        total = np.zeros(len(self.languages))
        for start in range(0, len(raw), BLOCK):
            lead = min(self.order, start)
            total += self._bits(np.frombuffer(raw[start - lead : start + BLOCK], np.uint8), [lead], [0])[0]
        return total

    def _bits(self, data: np.ndarray, leads: list[int], starts: list[int]) -> np.ndarray:
        """Bits of each text of ``data``; text i starts at starts[i], its first leads[i] bytes are context only."""
        n, d = len(data), self.order
        first = np.zeros(n, bool)
        first[starts] = True
        begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        depth = np.minimum(np.arange(n) - begin, d)  # bytes of context that a position has
        wide = data.astype(np.uint64)
        code = [wide]  # code[k]: the k+1 bytes up to and with each position
        for k in range(1, d + 1):
            prev = np.zeros(n, np.uint64)
            prev[1:] = code[k - 1][:-1]
            code.append((prev << np.uint64(8)) | wide)
        total = np.zeros((len(starts), len(self.languages)))
        bounds = np.asarray(starts)

        def add(at: np.ndarray, rows: np.ndarray) -> None:
            """Add each row to the text that its position (ascending) lies in."""
            if len(at):
                cut = np.searchsorted(at, bounds)
                full = np.flatnonzero(np.diff(cut, append=len(at)))
                total[full] += np.add.reduceat(rows, cut[full], axis=0, dtype=np.float64)

        todo = np.arange(n)
        for s, lead in zip(starts, leads, strict=True):
            if lead:
                todo = todo[(todo < s) | (todo >= s + lead)]
        for k in range(d, -1, -1):
            deep = depth[todo] >= k
            here = todo[deep]
            mask = (np.uint64(1) << np.uint64(8 * (k + 1))) - np.uint64(1)
            string = code[k][here]
            at = self.strings[k].find(string)
            hit = at >= 0
            add(here[hit], self.strings[k].rows.take(at[hit], axis=0))
            miss = here[~hit]
            if k and len(miss):
                ctx = self.escapes[k].find((string[~hit] & mask) >> np.uint64(8))
                known = ctx >= 0
                add(miss[known], self.escapes[k].rows.take(ctx[known], axis=0))
            elif len(miss):
                add(miss, np.repeat(self.escapes[0].rows[:1] + np.float32(8), len(miss), axis=0))
            deep[deep] = hit
            todo = todo[~deep]
        return total

    def many(self, raws: list[bytes]) -> np.ndarray:
        """Bits of many texts under each language; short texts share one array."""
        out = np.zeros((len(raws), len(self.languages)))
        group: list[int] = []
        size = 0
        for i, raw in enumerate([*raws, None]):
            if group and (raw is None or size + len(raw) > BLOCK):
                starts = np.cumsum([0, *(len(raws[j]) for j in group[:-1])]).tolist()
                out[group] = self._bits(np.frombuffer(b"".join(raws[j] for j in group), np.uint8), [0] * len(group), starts)
                group, size = [], 0
            if raw is None:
                break
            if len(raw) > BLOCK:
                out[i] = self.code_lengths(raw)
            elif raw:
                group.append(i)
                size += len(raw)
        return out


def _strings(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of k+1 bytes within the texts, as numbers, and their counts."""
    parts = []
    for raw in texts:
        data = np.frombuffer(raw, np.uint8).astype(np.uint64)
        if len(data) > k:
            code = np.zeros(len(data) - k, np.uint64)
            for i in range(k + 1):
                code = (code << np.uint64(8)) | data[i : len(data) - k + i]
            parts.append(code)
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def build_model(samples: dict[str, list[bytes]], order: int = ORDER) -> PPMModel:
    """Count the trees of every language and tabulate code lengths and escapes, context length by length."""
    languages = sorted(samples)
    tables, escapes = [], []
    below, below_rows = None, None
    for k in range(order + 1):
        counted = [_strings(samples[x], k) for x in languages]
        every = np.unique(np.concatenate([np.zeros(0, np.uint64), *(s for s, _ in counted)]))
        contexts = np.unique(every >> np.uint64(8)) if k else np.zeros(1, np.uint64)
        of = np.searchsorted(contexts, every >> np.uint64(8)) if k else np.zeros(len(every), np.int64)
        # A string's suffix was counted wherever the string was, so it is among the shorter strings.
        suffix = every & np.uint64((1 << 8 * k) - 1)
        lower = below_rows[np.searchsorted(below, suffix)] if k else np.full((len(every), len(languages)), 8, np.float32)
        rows, esc = np.empty((len(every), len(languages)), np.float32), np.zeros((len(contexts), len(languages)), np.float32)
        for j, (strings, n) in enumerate(counted):
            at = np.searchsorted(every, strings)
            total = np.bincount(of[at], weights=n, minlength=len(contexts))
            kinds = np.bincount(of[at], minlength=len(contexts))
            seen = kinds > 0
            esc[seen, j] = np.log2((total[seen] + kinds[seen]) / kinds[seen])
            rows[:, j] = lower[:, j] + esc[of, j]
            rows[at, j] = np.log2((total + kinds)[of[at]] / n)
        tables.append(_Table(every, rows))
        escapes.append(_Table(contexts, esc))
        below, below_rows = every, rows
    return PPMModel(languages, order, tables, escapes)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          rows: int = SAMPLE_ROWS, total_bytes: int = SAMPLE_BYTES, order: int = ORDER) -> PPMModel:
    """Fit on a stable sample of at most ``rows`` whole rows and ``total_bytes`` bytes of each language.

    Both bounds concern the fit alone; scoring always reads whole texts.
    """
    samples: dict[str, list[bytes]] = defaultdict(list)
    for _, lang, text in stable_sample(labelled, id_col, lang_col, text_col, rows, total_bytes):
        samples[lang].append(text.encode("utf-8", "surrogatepass"))
    return build_model(dict(samples), order)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def identify(model: PPMModel, texts: list[str | None]) -> list[tuple[str, float, float]]:
    """(language, score, bits per byte of the best code) of each whole text."""
    live = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
    out = [(UNDETERMINED, 0.0, 0.0)] * len(texts)
    raws = [texts[i].encode("utf-8", "surrogatepass") for i in live]
    for i, raw, bits in zip(live, raws, model.many(raws), strict=True):
        best = int(np.argmin(bits))
        # The posterior of equally likely languages, for the evidence of at most 64 bytes: that of a
        # whole text is 1 to the last digit whatever the text.
        gap = (bits - bits[best]) / len(raw) * min(len(raw), 64)
        out[i] = (model.languages[best], float(1 / np.exp2(-gap).sum()), float(bits[best] / len(raw)))
    return out


def predict(docs: DataFrame, model: PPMModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_bits added (in place of columns of these names); narrow, texts stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's size
    new = StructType.fromDDL("lang_pred string, lang_score double, lang_bits double").fields
    docs = docs.select(*(c for c in docs.columns if c.lower() not in {f.name for f in new}))
    at = docs.columns.index(text_col)
    out_schema = StructType([*docs.schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = shared.value
        for part in slices(batches):
            said = identify(frozen, part.column(at).to_pylist())
            more = [pa.array([x[0] for x in said], pa.string()), *(pa.array([x[i] for x in said], pa.float64()) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "lang_pred", "lang_score", "lang_bits"])

    return mapped(docs, run, out_schema)
