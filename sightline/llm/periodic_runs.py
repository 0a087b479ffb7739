"""Periodic runs of words, found with suffix automata, and texts with the repeats taken out.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), of at least ``exponent`` * q
and ``min_length`` words, that no neighbour extends. The states of a suffix automaton are sets of substrings with the
same end positions; along its suffix links those sets only grow. They are merged from the longest states to
the shortest, the smaller into the larger, and each position that enters a set looks at its neighbours there: a
distance d that fits into the state's length seeds a repeat of period d, whose left end the state's length
gives exactly (the two places agree over that length and no further). A seed is extended to the right, once.

Most words are not near any repeat, so automata are built only over spans that can hold a run. In a run of
period q every word but the first q has an equal one at most q before it. So for each power of two, a run with q
from there to the next has ``exponent`` - 1 times as many consecutive words with an equal one so near; stretches
without are left out. This loses no run, whatever its length.

Defined results: null and empty texts, and those without words, have no words, no runs and an empty collapsed text. Words
are ``[^\\x20\\x09-\\x0D]+`` and compared as they are. Repeated rows and repeated or null ids each give their own
row; other columns are not read. An empty table gives an empty table. Runs come by start, then period.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

MIN_LENGTH, EXPONENT = 6, 4


class EndPositions:
    """An ordered set of positions in short sorted blocks, which tells the neighbours of what enters it."""

    BLOCK = 1024
    __slots__ = ("blocks", "lasts", "size")

    def __init__(self, first: int | None = None):
        self.blocks: list[list[int]] = [] if first is None else [[first]]
        self.lasts: list[int] = [] if first is None else [first]
        self.size = len(self.lasts)

    def __iter__(self) -> Iterator[int]:
        return chain.from_iterable(self.blocks)

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Put ``x``, which is not there yet, in its place; the next smaller and the next larger position."""
        self.size += 1
        if not self.blocks:
            self.blocks, self.lasts = [[x]], [x]
            return None, None
        b = min(bisect_left(self.lasts, x), len(self.blocks) - 1)
        block = self.blocks[b]
        at = bisect_left(block, x)
        before = block[at - 1] if at else self.lasts[b - 1] if b else None
        after = block[at] if at < len(block) else None  # beyond the last block there is none
        insort(block, x)
        self.lasts[b] = block[-1]
        if len(block) > self.BLOCK:
            half = len(block) // 2
            self.blocks[b : b + 1] = [block[:half], block[half:]]
            self.lasts[b : b + 1] = [block[half - 1], block[-1]]
        return before, after


def suffix_automaton(words: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, length of the longest substring, own end position or -1 for a clone) of each state; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, own = [-1], [0], [-1]
    last = 0
    for at, word in enumerate(words):
        now = len(step)
        step.append({})
        link.append(0)
        length.append(at + 1)
        own.append(at)
        p = last
        while p != -1 and word not in step[p]:
            step[p][word] = now
            p = link[p]
        if p != -1:
            q = step[p][word]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                clone = len(step)
                step.append(step[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                own.append(-1)
                while p != -1 and step[p].get(word) == q:
                    step[p][word] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return link, length, own


def seeds(words: Sequence[int], exponent: int) -> dict[tuple[int, int], int]:
    """{(period, start): end}: stretches in which words a period apart are equal, from their true starts to an end seen.

    Periods that a state's length holds ``exponent`` - 1 times: the last two places of a run are such.
    """
    link, length, own = suffix_automaton(words)
    ends: list[EndPositions | None] = [EndPositions(p if p >= 0 else None) for p in own]
    found: dict[tuple[int, int], int] = {}

    def seen(first: int, second: int, size: int) -> None:
        period = second - first
        if period * (exponent - 1) <= size:
            key = (period, first - size + 1)
            if found.get(key, 0) <= second:
                found[key] = second + 1

    for state in np.argsort(-np.array(length), kind="stable")[:-1].tolist():
        above = link[state]
        if not above:
            ends[state] = None
            continue
        small, large = ends[state], ends[above]
        ends[state] = None
        if small.size > large.size:
            small, large = large, small
        last = None  # neighbours out of the same set have met in a longer state
        for x in small:
            before, after = large.add(x)
            if before is not None and before != last:
                seen(before, x, length[above])
            last = x
            if after is not None:
                seen(x, after, length[above])
        ends[above] = large
    return found


def is_primitive(words: Sequence[int], start: int, period: int) -> bool:
    """No divisor of the period is a period of those words."""
    root = words[start : start + period]
    return not any(period % p == 0 and root[p:] == root[: period - p] for p in range(1, period // 2 + 1))


def runs_of(words: list[int], min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence."""
    out = []
    for (period, start), end in seeds(words, exponent).items():
        while end < len(words) and words[end] == words[end - period]:
            end += 1
        if end - start >= max(min_length, exponent * period) and is_primitive(words, start, period):
            out.append((start, end - start, period))
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def spans_with_runs(ids: np.ndarray, doc_starts: np.ndarray, min_length: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of disjoint spans that hold every run of the documents laid end to end; no span leaves its document.

    ``ids`` are the words, numbered from 0; ``doc_starts`` the first word of each document, ascending.
    """
    n = len(ids)
    doc = np.repeat(np.arange(len(doc_starts)), np.diff(doc_starts, append=n))
    bits = max(1, int(n).bit_length())
    keys = ((doc * (int(ids.max()) + 1) + ids) << bits) + np.arange(n)
    keys.sort()
    places, same = keys & ((1 << bits) - 1), (keys[1:] >> bits) == (keys[:-1] >> bits)
    back = np.full(n, np.iinfo(np.int64).max)
    back[places[1:][same]] = (places[1:] - places[:-1])[same]  # how far back the same word is
    starts, ends, low = [], [], 1
    while low * (exponent - 1) <= n:
        high = 2 * low - 1
        edges = np.flatnonzero(np.diff((back <= high).astype(np.int8), prepend=0, append=0))
        a, b = edges[::2], edges[1::2]
        long = b - a >= max((exponent - 1) * low, min_length - high)
        a, b = a[long], b[long]
        starts.append(np.maximum(a - high, doc_starts[doc[a]]))
        ends.append(b)
        low *= 2
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
    order = np.argsort(a, kind="stable")
    a, upto = a[order], np.maximum.accumulate(b[order])
    # Spans that touch within a document are one; those of different documents never share a word.
    fresh = np.concatenate([[True], a[1:] >= upto[:-1]]) if len(a) else np.zeros(0, bool)
    return a[fresh], upto[np.concatenate([fresh[1:], [True]])] if len(a) else a


def collapse(texts: list[str | None], min_length: int, exponent: int) -> list[tuple[int, list[tuple[int, int, int]], str]]:
    """(words, runs, text without the repeats of any run) of each text."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    split = [(t or "").encode().split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if sizes.sum():
        ids = np.fromiter(chain.from_iterable(map(number.__getitem__, w) for w in split), np.int64, int(sizes.sum()))
        live = np.flatnonzero(sizes)
        doc_starts = (np.cumsum(sizes) - sizes)[live]
        for a, b in zip(*(x.tolist() for x in spans_with_runs(ids, doc_starts, min_length, exponent)), strict=True):
            at = int(np.searchsorted(doc_starts, a, side="right")) - 1
            shift = a - int(doc_starts[at])
            found[live[at]] += [(start + shift, length, q) for start, length, q in runs_of(ids[a:b].tolist(), min_length, exponent)]
    out = []
    for words, runs in zip(split, found, strict=True):
        kept = words
        if runs:
            drop = np.zeros(len(words), bool)
            for start, length, q in runs:
                drop[start + q : start + length] = True
            kept = [words[i] for i in np.flatnonzero(~drop)]
        out.append((len(words), runs, b" ".join(kept).decode()))
    return out


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """(id, n_words, runs array<struct<start, length, period>>, collapsed) of every whole text. Narrow: no shuffle."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            done = collapse(part.column(1).to_pylist(), min_length, exponent)
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in d[1]] for d in done]
            yield pa.RecordBatch.from_pydict({
                id_col: part.column(0), "n_words": pa.array([d[0] for d in done], pa.int64()),
                "runs": pa.array(runs, run_type), "collapsed": pa.array([d[2] for d in done], pa.string()),
            })

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period; of equal ones the first by start, then period."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.reduce(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of ``find_runs``."""
    best = found.select(id_col, "runs", "collapsed", strongest(F.col("runs")).alias("best"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return best.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of which each tenth, by h = crc32(id), repeats itself from a word on: word i >= a is word a + (i - a) % p.

    With g = floor(h / 10) and n words: a = g % n, p = 1 + floor((n - a) / (3 + g % 8)). Other texts stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    words = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = h % 10 == 0
    cut = docs.select(id_col, text_col, F.floor(h / 10).alias("_g"), F.when(chosen, words).alias("_w"))
    sized = cut.withColumn("_n", F.size("_w"))
    a = (F.col("_g") % F.col("_n")).cast("int")
    placed = sized.withColumn("_a", F.when(F.col("_n") > 0, a)).withColumn("_p", F.when(F.col("_n") > 0, (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")))
    tail = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")))
    made = F.array_join(F.slice(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), F.lit(1), F.col("_n")), " ")
    return placed.select(id_col, F.when(F.col("_n") > 0, made).otherwise(F.col(text_col)).alias(text_col))
