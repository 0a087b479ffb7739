"""A session's coverage as one plan: events and symbols in, ledger, report and compactions out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import operators as O
from ..functions import UNSEEN, percent
from ..sources.sessions import ORDER, chunks

_RESET = "kind in ('compacted', 'cleared')"


@dataclass
class Coverage:
    """The tables that a report is made of; ``ledger`` and ``agent_ledger`` are of the last epoch."""

    files: DataFrame
    symbols: DataFrame
    events: DataFrame  # with epoch
    marks: DataFrame  # of all epochs
    ledger: DataFrame  # id, depth, content_hash, agent_id, estimated_tokens
    agent_ledger: DataFrame  # id, agent_id, depth
    compactions: DataFrame  # sequence, ts, summary, meta, tool_calls_before, files_before, seen_before, seen_percent
    agents: DataFrame  # session_id, agent_id, first_ord, label


def fold(files: DataFrame, symbols: DataFrame, events: DataFrame) -> Coverage:
    """Coverage of one session (``events`` as ``sources.sessions.events`` gives them, without boundaries).

    Every compaction and every clear empties the ledger; what it held is the compaction's snapshot. A
    path filter concerns files and symbols alone, not the calls that are counted. Events come with their epochs out of
    a scan that has written them once, so logs are parsed once, whatever number of tables read them.
    """
    reset = F.expr(_RESET)
    timed = events if "epoch" in events.columns else O.with_epochs(events, reset, ["session_id"], ORDER, chunks())
    calls = timed.where("kind = 'tool_call'")
    marked = O.marks(calls, symbols, ORDER)
    resets = timed.where(reset).groupBy("session_id").agg(F.count("*").alias("resets"))
    # Calls of earlier epochs go before they are spread over the symbols that they touch.
    last = O.marks(calls.join(resets, "session_id", "left").where(F.col("epoch") == F.coalesce("resets", F.lit(0))).drop("resets"), symbols, ORDER)
    entries = O.ledger(last, ["id"], ["event_ord", "sym_ord"], ["content_hash", "agent_id", "estimated_tokens"])
    agents = calls.groupBy("session_id", "agent_id").agg(F.min(F.struct(*ORDER)).alias("first_ord"), F.min_by("label", F.struct(*ORDER)).alias("label"))
    return Coverage(files, symbols, timed, marked, entries, O.agent_ledger(last, ["id"]), compactions(timed, marked, symbols), agents)


def compactions(timed: DataFrame, marked: DataFrame, symbols: DataFrame) -> DataFrame:
    """The compactions since the last clear, each with the state that it ended: calls, files in path order, symbols seen."""
    by = ["session_id", "epoch"]
    calls = timed.where("kind = 'tool_call'").groupBy(*by).agg(F.count("*").alias("tool_calls_before"), F.collect_set("file_path").alias("paths"))
    seen = marked.where(F.col("read_depth") > UNSEEN).groupBy(*by).agg(F.count_distinct("id").alias("seen_before"))
    total = symbols.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))  # one row
    numbered = O.numbered_compactions(timed, ["session_id"], ORDER)
    out = numbered.withColumn("one", F.lit(1)).join(calls, by, "left").join(seen, by, "left").join(F.broadcast(total), "one")
    files = O.sorted_paths(F.col("paths"))
    seen_before = F.coalesce("seen_before", F.lit(0))
    return out.select(
        "session_id", "sequence", "ts", "summary", "meta", F.coalesce("tool_calls_before", F.lit(0)).alias("tool_calls_before"), F.coalesce(files, F.array().cast("array<string>")).alias("files_before"),
        seen_before.alias("seen_before"), percent(seen_before, F.col("total")).alias("seen_percent"),
    )


def report(c: Coverage, agent: str | None = None) -> DataFrame:
    """One row per file, least read first; of one agent if given (its full id)."""
    depths = c.agent_ledger.where(F.col("agent_id") == agent) if agent is not None else c.ledger
    return O.report_order(O.coverage_report(c.files, c.symbols, depths.select("id", "depth")))


def module_coverage(rows: DataFrame, needed: float = 60.0) -> DataFrame:
    """(module, seen_percent, full_percent, enough): the report summed by folder."""
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    sums = rows.groupBy(folder.alias("module")).agg(F.sum("total_symbols").alias("total"), F.sum("seen_count").alias("seen"), F.sum("full_count").alias("full"))
    seen: Column = percent(F.col("seen"), F.col("total"))
    return sums.select("module", seen.alias("seen_percent"), percent(F.col("full"), F.col("total")).alias("full_percent"), (seen >= needed).alias("enough"))


def folder_coverage(rows: DataFrame) -> DataFrame:
    """(folder, files, total_symbols, seen_count, full_count, percents) of every folder with all below it; ``''`` is the whole project.

    ``rows`` are a report's: file_path and its counts. A file counts in each folder above it, and one aggregate, combined
    before its shuffle, serves all levels.
    """
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    sums = rows.select(F.explode(above).alias("folder"), "total_symbols", "seen_count", "full_count").groupBy("folder").agg(
        F.count("*").alias("files"), *(F.sum(c).alias(c) for c in ("total_symbols", "seen_count", "full_count")))
    return sums.withColumn("seen_percent", percent(F.col("seen_count"), F.col("total_symbols"))).withColumn("full_percent", percent(F.col("full_count"), F.col("total_symbols")))
