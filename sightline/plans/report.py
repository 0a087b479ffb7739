"""Reports of a session's coverage: as text, as JSON, and the run that makes them; symbol trees and event logs as text."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import operators as O
from ..functions import path_parts
from ..sources import code, lspcache, sessions
from ..sources.scan import write_lines
from ..tables import kept
from . import coverage, toolmap
from .filters import PathFilter

SCHEMA_VERSION = 2
#: The layout of the text report.
LEAST_PATH_WIDTH, NUMBERS_WIDTH, COMPACTION_WIDTH, FILES_SHOWN, LINE_WIDTH = 40, 45, 63, 10, 80
#: Depths as an event log names them, by code.
DEPTH_NAMES = ("Unseen", "NameOnly", "Overview", "Signature", "FullBody", "Stale")
_LOG = logging.getLogger(__name__)


@dataclass
class Report:
    """What a formatter gets: rows of ``coverage.report`` in their order, and of ``coverage.compactions``."""

    files: list[Any]
    compactions: list[Any] = field(default_factory=list)
    session_id: str | None = None
    agent_id: str | None = None
    filter: str | None = None

    def totals(self) -> tuple[int, int, int, float, float]:
        """Symbols, seen, full, and both shares in percent."""
        total, seen, full = (sum(f[c] for f in self.files) for c in ("total_symbols", "seen_count", "full_count"))
        return total, seen, full, seen / total * 100.0 if total else 0.0, full / total * 100.0 if total else 0.0


class Formatter(Protocol):
    def format(self, report: Report) -> str: ...


class TextFormatter:
    def __init__(self, least_path_width: int = LEAST_PATH_WIDTH):
        self.least_path_width = least_path_width

    def format(self, report: Report) -> str:
        agent = f", agent: {report.agent_id}" if report.agent_id is not None else ""
        width = max([len(f["file_path"].encode()) for f in report.files] + [self.least_path_width, 5])
        rule = "─" * (width + NUMBERS_WIDTH)
        row = lambda name, total, seen, full, seen_pct, full_pct: f"{name:<{width}} {total:>8} {seen:>7} {full:>7} {seen_pct:>6.0f}% {full_pct:>6.0f}%"
        out = [f"Coverage Report (session: {report.session_id or 'none'}{agent})"]
        out += [f"Filter: {report.filter}"] if report.filter is not None else []
        out += [rule, f"{'File':<{width}} {'Symbols':>8} {'Seen':>7} {'Full':>7} {'Seen%':>7} {'Full%':>7}", rule]
        out += [row(*(f[c] for c in ("file_path", "total_symbols", "seen_count", "full_count", "seen_percent", "full_percent"))) for f in report.files]
        out += [rule, row("TOTAL", *report.totals())]
        if report.compactions:
            out += ["", f"Context Compactions ({len(report.compactions)})", "─" * COMPACTION_WIDTH]
            for c in report.compactions:
                out += [*_compaction(c), ""]
        return "\n".join(out) + "\n"


def _compaction(c: Any) -> list[str]:
    out = [f"#{c['sequence']}  {c['ts']}  {c['tool_calls_before']} calls · {c['seen_percent']:.1f}% seen"]
    if m := c["meta"]:
        delta = 100.0 * (m["post_tokens"] - m["pre_tokens"]) / m["pre_tokens"] if m["pre_tokens"] > 0 else 0.0
        out.append(f"    Tokens: {m['pre_tokens']} → {m['post_tokens']} ({delta:+.1f}%) · trigger: {m['trigger']} · {m['duration_ms'] / 1000:.1f}s")
    files = c["files_before"]
    out += [f"    Files ({len(files)}):", *(f"      {f}" for f in files[:FILES_SHOWN])]
    if len(files) > FILES_SHOWN:
        out.append(f"      ... ({len(files) - FILES_SHOWN} more)")
    return out + summary_lines(c["summary"])


def summary_lines(summary: str, first: str = "    Summary: ", rest: str = "      ", width: int = LINE_WIDTH) -> list[str]:
    """A summary's words in lines of at most ``width`` bytes under a hanging indent."""
    out, line, lead = [], "", first
    for word in summary.split():
        if line and len(f"{lead}{line} {word}".encode()) > width:
            out.append(lead + line)
            line, lead = word, rest
        else:
            line = f"{line} {word}" if line else word
    return [*out, lead + line] if line or not out else out


class JsonFormatter:
    """One line of JSON; a filter and metadata are left out where there are none."""

    def format(self, report: Report) -> str:
        total, seen, full, seen_pct, full_pct = report.totals()
        out: dict[str, Any] = {"schema_version": SCHEMA_VERSION, "session_id": report.session_id, "agent_id": report.agent_id}
        if report.filter is not None:
            out["filter"] = report.filter
        out["totals"] = {"symbols": total, "seen": seen, "full": full, "seen_percent": seen_pct, "full_percent": full_pct}
        out["files"] = [{"path": f["file_path"], **{c: f[c] for c in ("total_symbols", "seen_count", "full_count", "seen_percent", "full_percent")}} for f in report.files]
        out["compactions"] = []
        for c in report.compactions:
            before = {"tool_calls": c["tool_calls_before"], "files_accessed": list(c["files_before"]), "symbols_seen": c["seen_before"], "seen_percent": c["seen_percent"]}
            row = {"sequence": c["sequence"], "timestamp": c["ts"], "summary": c["summary"], "state_before": before}
            if m := c["meta"]:
                row["metadata"] = {k: m[k] for k in ("trigger", "pre_tokens", "post_tokens", "duration_ms")}
            out["compactions"].append(row)
        return json.dumps(out, ensure_ascii=False, separators=(",", ":")) + "\n"


def collected(c: coverage.Coverage, session: str | None = None, agent: str | None = None, path_filter: PathFilter | None = None) -> Report:
    """The report's rows on the driver: one for each file, which is what a report shows."""
    return Report(coverage.report(c, agent).collect(), c.compactions.orderBy("sequence").collect(), session, agent, path_filter.display() if path_filter else None)


def run(
    spark: SparkSession, project: str, log_dir: str | None = None, session: str | None = None, agent: str | None = None, path_filter: PathFilter | None = None,
    formatter: Formatter | None = None, tools_config: str | None = None, from_cache: bool = False, registry: code.Registry | None = None, event_log_dir: str | None = None,
    source: sessions.SessionSource = sessions,
) -> str:
    """The coverage report of a project's session: the newest if none is named, of one agent by a prefix of its id.

    Without a session all counts are zero. Warnings go to the log, not into the report.
    """
    if path_filter:
        path_filter.validate(project)
    stanzas, warnings = toolmap.resolve(tools_config)
    for w in warnings:
        _LOG.warning("tool mapping: %s", w.text)
    root = os.path.realpath(project)
    keep = path_filter.matches if path_filter else None
    files, symbols = lspcache.scan(spark, root, keep) if from_cache else code.scan(spark, root, keep, registry)
    log_dir = log_dir or source.log_dir(project)
    session = session or (source.latest_session(log_dir) if log_dir else None)
    logs = source.session_files(log_dir, session) if log_dir and session else []
    events = source.events(spark, logs, root, session or "", stanzas)
    c = coverage.fold(files, symbols, events)
    if agent is not None:
        agent = resolved_agent(c.agents, agent)
    if event_log_dir and session:
        write_event_log(events, event_log_dir)
    out = (formatter or TextFormatter()).format(collected(c, session, agent, path_filter))
    return out


def resolved_agent(agents: DataFrame, prefix: str) -> str:
    """The agent that a prefix names; none or several are worth a warning."""
    found = O.resolve_agent(agents, prefix).first()
    if found.candidates != 1:
        _LOG.warning("%s match prefix %r, taking %r", f"{found.candidates} agents" if found.candidates else "no agents", prefix, found.resolved)
    return found.resolved


# --- trees and event logs -------------------------------------------------------------------------------


def tree_lines(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_path, ord, line): the symbol tree of a project as text, in the order of ``file_path`` components and ``ord``.

    A sort over all tasks reads its rows twice, for the bounds and for the sort: the lines are written once, and texts parsed once.
    """
    heads = files.select("file_path", F.lit(-1).alias("ord"), F.concat(F.lit("  "), "file_path", F.lit(" ("), F.col("total_lines").cast("string"), F.lit(" lines)")).alias("line"))
    text = F.concat(
        F.repeat(F.lit(" "), F.lit(4) + F.col("level") * 2), F.col("label"), F.lit(" "), F.col("name"), F.lit(" [L"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"),
        F.lit("] (~"), F.col("estimated_tokens").cast("string"), F.lit(" tokens)"),
    )
    return kept(heads.unionByName(symbols.select("file_path", "ord", text.alias("line"))), "lines").orderBy(path_parts(F.col("file_path")), "ord")


def dump(root: str, files: DataFrame, symbols: DataFrame, path_filter: PathFilter | None = None) -> str:
    """The symbol tree as the driver prints it."""
    totals = O.project_totals(files, symbols).first()
    head = [f"Project: {root} ({totals.total_files} files, {totals.total_symbols} symbols)", *([f"Filter: {path_filter.display()}"] if path_filter else []), ""]
    return "\n".join([*head, *(r.line for r in tree_lines(files, symbols).toLocalIterator())]) + "\n"


def event_log(events: DataFrame) -> DataFrame:
    """``events`` (tool calls) with ``line``: each call as a line of an event log, its path as the log had it."""
    names = F.array(*map(F.lit, DEPTH_NAMES))
    lines = F.concat(F.lit("L"), F.col("target_start").cast("string"), F.lit("-"), F.col("target_end").cast("string"))
    target = F.coalesce("target_symbol", lines, F.lit("-"))
    text = F.concat(
        F.lit("["), "ts", F.lit("] agent="), "agent_id", F.lit(" tool="), "tool_name", F.lit(" depth="), F.element_at(names, F.col("read_depth") + 1), F.lit(" path="), F.coalesce("raw_path", F.lit("-")),
        F.lit(" target="), target, F.lit(' desc="'), "description", F.lit('"'),
    )
    return events.where("kind = 'tool_call'").withColumn("line", text)


def write_event_log(events: DataFrame, folder: str) -> None:
    """The event log of each session in its order: one file ``<session>.log`` below ``folder``, written by executors, all or none."""
    os.makedirs(folder, exist_ok=True)
    write_lines(event_log(events), "session_id", "line", sessions.ORDER, os.path.abspath(folder))


__all__ = ["Formatter", "JsonFormatter", "Report", "Row", "TextFormatter", "collected", "dump", "event_log", "resolved_agent", "run", "summary_lines", "tree_lines", "write_event_log"]
