r"""Host-level quality rules with an empirical beta prior.

Every document gets rule counts; documents that fail any rule (base, symbols, word length, repeated
lines) are summed by host; each host's failure rate is shrunk towards the corpus by a beta prior whose
two parameters are fitted to the host rates by moments; hosts whose shrunk rate exceeds a limit, set
relative to the prior's mean, are condemned, and that verdict is joined back. By itself a document
is dropped for the base rule alone.

Words are ``[^\x20\x09-\x0D]+``. Defined results: a null text has no words and fails the base rule; a
null host is a host of its own; repeated rows count and come out once each; without any document
there are no hosts and no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

#: The characters counted as symbols, and the words of white space.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: A host goes if the odds of its shrunk failure rate are above so many times those of the prior's mean.
HOST_ODDS = 4.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rules that count for the host alone: symbols of the visible characters, repeated of the non-blank
#: lines, visible characters per word.
MAX_SYMBOL_PERCENT = 1
MAX_DUP_LINE_PERCENT = 30
WORD_LENGTHS = (3, 10)


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    return _counts(text)[:5]


def _counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """``text_counts`` and n_lines, the lines that are not blank."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more in the text, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    k = len(numbers)
    if k < 2_000_000:
        windows = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:  # three numbers no longer fit one
        pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * k + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, host_failed)."""
    id_type, host_type = (docs.schema[c].dataType.simpleString() for c in (id_col, host_col))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    schema = f"`{id_col}` {id_type}, host {host_type}, " + ", ".join(f"{n} long" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts = list(zip(*map(_counts, part.column(2).to_pylist()), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in counts)], names=[id_col, "host", *names])

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    symbols = 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")
    lines = 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines")
    lengths = (F.col("word_chars") < WORD_LENGTHS[0] * F.col("n_words")) | (F.col("word_chars") > WORD_LENGTHS[1] * F.col("n_words"))
    counts = docs.select(id_col, host_col, text_col).mapInArrow(run, schema).withColumn("base_failed", failed)
    return counts.withColumn("host_failed", F.col("base_failed") | symbols | lines | lengths)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Alpha and beta by the method of moments from (n, failed) of every host.

    The driver gets one row of sums. The between-host variance is what is left of the weighted
    variance of the rates after the binomial part; if nothing is left, the prior is strong.
    """
    n, k = F.col("n").cast("double"), F.col("failed").cast("double")
    s = hosts.agg(F.sum(n), F.sum(k), F.sum(k * k / n), F.sum(n * n), F.count("*")).first()
    if not s[0]:
        return 1.0, 1.0
    total, mean, hosts_n = s[0], s[1] / s[0], s[4]
    within = mean * (1 - mean)
    spread = s[2] - total * mean * mean  # weighted sum of squares between hosts
    room = total - s[3] / total
    between = max(0.0, (spread - (hosts_n - 1) * within) / room) if room > 0 else 0.0
    strength = min(1e6, max(2.0, within / between - 1)) if between > 0 else 1e6
    if within == 0:
        strength = 2.0
    return max(mean * strength, 1e-3), max((1 - mean) * strength, 1e-3)


def host_verdicts(counts: DataFrame, limit: float | None = None) -> DataFrame:
    """(host, n, failed, shrunk_rate, host_ok): sums are combined before the shuffle, so that a host
    with any share of the rows costs one row per task. ``limit``: by default the rate whose odds are
    HOST_ODDS times those of the fitted prior's mean."""
    hosts = counts.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("host_failed").cast("long")).alias("failed"))
    alpha, beta = beta_prior(hosts)
    if limit is None:
        limit = HOST_ODDS * alpha / (HOST_ODDS * alpha + beta)
    rate = (F.col("failed") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
    return hosts.withColumn("shrunk_rate", rate).withColumn("host_ok", F.col("shrunk_rate") <= F.lit(limit))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float | None = None) -> DataFrame:
    """Counts, base verdict, the host's shrunk rate and ``kept`` for every row of ``docs``.

    The counts (without texts) are stored in the shared folder, so texts are read once. The join with
    the hosts is left to Spark: few hosts are broadcast below its own size limit, and otherwise a
    host with many rows is split as a skewed partition.
    """
    counts = stored(document_counts(docs, id_col, text_col, host_col), "rules")
    hosts = host_verdicts(counts, limit).select(F.col("host").alias("_host"), "shrunk_rate", "host_ok")
    joined = counts.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("host_ok"), F.lit(True)))
