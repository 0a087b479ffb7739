"""Session logs: discovery on the driver, parsing as a plan.

A log is JSON by line. Lines are read in splits, so a log of any size is spread over tasks; the order of
events is (file_rank, block, line_no, block_pos): the file's place, the split's first byte, the line
within it, the content block of the line.
"""

from __future__ import annotations

import json
import os
import re
from pathlib import Path
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import first_bytes, remap, under_root
from ..operators.scans import chunk_scan
from ..plans.toolmap import DEFAULTS, Fields, Mapper, Stanza, columns, typed
from . import records

CLEAR = "<command-name>/clear</command-name>"
ORDER = ["file_rank", "block", "line_no", "block_pos"]
LINES = "file_rank int, stem string, block long, line_no long, raw string"
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")


class SessionSource(Protocol):
    """What a kind of session log has to bring for a report; this module is one."""

    def log_dir(self, project: str) -> str | None: ...

    def latest_session(self, folder: str) -> str | None: ...

    def session_files(self, folder: str, session: str) -> list[str]: ...

    def events(self, spark: SparkSession, files: list[str], root: str, session: str, stanzas: list[Stanza]) -> DataFrame: ...


# --- discovery ------------------------------------------------------------------------------------------


def slugs(project: str) -> tuple[str, str]:
    """Names of a project's log folder: with slashes and dots as hyphens, or (older) slashes alone."""
    path = os.path.realpath(project)
    return re.sub(r"[/.]", "-", path), path.replace("/", "-")


def log_dir(project: str, home: str | None = None) -> str | None:
    """The folder of a project's session logs, if there is one."""
    home = home or os.environ.get("HOME")
    if not home or not os.path.exists(project):
        return None
    places = [os.path.join(home, ".claude", "projects", s) for s in slugs(project)]
    return next((p for p in places if os.path.isdir(p)), None)


def is_uuid(stem: str) -> bool:
    return bool(_UUID.fullmatch(stem))


def latest_session(folder: str) -> str | None:
    """The newest non-empty ``<uuid>.jsonl``."""
    found = [p for p in Path(folder).glob("*.jsonl") if is_uuid(p.stem) and p.stat().st_size]
    return max(found, key=lambda p: (p.stat().st_mtime, p.stem)).stem if found else None


def _belongs(path: Path, session: str) -> bool:
    """Whether the first of a log's three first lines that names a session names this one."""
    with path.open(errors="replace") as lines:
        for line, _ in zip(lines, range(3), strict=False):
            try:
                named = json.loads(line)
            except ValueError:
                continue
            if isinstance(named, dict) and isinstance(named.get("sessionId"), str):
                return named["sessionId"] == session
    return False


def session_files(folder: str, session: str) -> list[str]:
    """Subagents' files in path order, then flat ones that name the session, the main file last."""
    top = Path(folder)
    ok = lambda p: not p.name.startswith("agent-acompact-")
    own = sorted(p for p in (top / session / "subagents").glob("agent-*.jsonl") if ok(p))
    flat = sorted(p for p in top.glob("agent-*.jsonl") if ok(p) and _belongs(p, session))
    main = top / f"{session}.jsonl"
    return [str(p) for p in (*own, *flat, *([main] if main.exists() else []))]


def first_field(path: str, key: str) -> str | None:
    """The first string that a record of a log has under ``key`` (``slug``, ``cwd``)."""
    with open(path, errors="replace") as lines:
        for line in lines:
            try:
                value = json.loads(line)
            except ValueError:
                continue
            if isinstance(value, dict) and isinstance(value.get(key), str):
                return value[key]
    return None


def default_label(stem: str) -> str:
    return stem.removeprefix("agent-")


# --- lines ----------------------------------------------------------------------------------------------


def read_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """The lines of log files, in the columns of ``LINES``; the files' order is their rank."""
    if not files:
        return spark.createDataFrame([], LINES)
    ranks = spark.createDataFrame([(os.path.abspath(f), i, Path(f).stem) for i, f in enumerate(files)], "log_file string, file_rank int, stem string")
    raw = spark.read.option("lineSep", "\n").text([os.path.abspath(f) for f in files]).select(
        F.regexp_replace("_metadata.file_path", "^file:(//)?", "").alias("log_file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("raw"),
    )
    # The list of files is the driver's own, so its size is known to be small.
    return raw.join(F.broadcast(ranks), "log_file").select("file_rank", "stem", "block", "line_no", "raw")


def first_lines(lines: DataFrame) -> DataFrame:
    """(file_rank, label, cwd) of every log: what its first line says of the agent and its folder."""
    first = lines.groupBy("file_rank", "stem").agg(F.min_by("raw", F.struct("block", "line_no")).alias("raw"))
    v = F.try_parse_json("raw")
    text = typed(v, "$.message.content")
    line = F.regexp_extract(text, r"^([^\n]*?)\r?(?:\n|$)", 1)
    short = F.when(F.octet_length(line) <= 50, line).otherwise(F.concat(first_bytes(line, 47), F.lit("...")))
    label = F.when(F.length(text) > 0, short).otherwise(F.regexp_replace("stem", "^agent-", ""))
    return first.select("file_rank", F.coalesce(label, F.regexp_replace("stem", "^agent-", "")).alias("label"), typed(v, "$.cwd").alias("cwd"))


def parse_lines(lines: DataFrame, root: str, session: str | Column, stanzas: list[Stanza] | tuple[Stanza, ...] = DEFAULTS, mapper: Mapper = columns) -> DataFrame:
    """All events of log lines (the columns of ``LINES``; others, as the label and cwd of a log, are kept if there).

    Lines that are no JSON, and records of other kinds, give no event. A summary's flag goes before a
    clear command in the same record, and a summary that is no text is an empty one. ``mapper`` makes of a
    tool's name and the fields of its input what ``toolmap.columns`` makes of them by the stanzas.
    """
    known = lines.columns
    label = F.col("label") if "label" in known else F.regexp_replace("stem", "^agent-", "")
    cwd = F.col("cwd") if "cwd" in known else F.lit(None).cast("string")
    own = [label.alias("label"), cwd.alias("cwd"), "stem", *ORDER[:3], (F.lit(session) if isinstance(session, str) else session).alias("session_id")]
    inputs = Fields()
    mapping = mapper(F.col("tool_name"), inputs, list(stanzas))
    read = records.events(lines.select(*own, "raw"), inputs)
    kind, trigger = F.col("_type"), F.col("_trigger")
    boundary = (kind == "system") & (F.col("_subtype") == "compact_boundary") & trigger.isNotNull()
    summary = (kind == "user") & F.coalesce("_flag", F.lit(False))
    clear = (kind == "user") & F.contains(F.col("_text"), F.lit(CLEAR))
    number = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    meta = F.struct(trigger.alias("trigger"), number("_pre").alias("pre_tokens"), number("_post").alias("post_tokens"), number("_took").alias("duration_ms"))
    agent = F.coalesce(F.when(F.col("_named"), F.col("_agent")).otherwise(F.col("_session")), F.col("stem"))
    what = F.when(F.col("tool_name").isNotNull(), "tool_call").when(boundary, "boundary").when(summary, "compacted").when(clear, "cleared")
    found = read.withColumn("kind", what).where("kind is not null")
    # A generator of one row: what reads a field of the mapping later reads a value, not the mapping once more.
    one = F.inline(F.array(F.when(F.col("kind") == "tool_call", mapping))).alias("own_path", "read_depth", "description", "target_symbol", "target_start", "target_end")
    mapped = found.select(
        "session_id", *ORDER[:3], F.coalesce("block_pos", F.lit(0)).alias("block_pos"), "kind", F.when(F.col("kind") == "tool_call", agent).otherwise(F.col("stem")).alias("agent_id"), "tool_name",
        F.coalesce("_ts", F.lit("")).alias("ts"), "label", "cwd", F.when(summary, F.coalesce("_text", F.lit(""))).alias("summary"), F.when(boundary, meta).alias("meta"), one,
    )
    own_path = F.col("own_path")
    mapped = mapped.withColumn("raw_path", F.when(F.col("cwd").isNotNull() & (F.col("cwd") != root), remap(own_path, F.col("cwd"), F.lit(root))).otherwise(own_path))
    return mapped.select(
        "session_id", *ORDER, "kind", "agent_id", "tool_name", "raw_path", under_root(F.col("raw_path"), F.lit(root)).alias("file_path"),
        "read_depth", "description", "ts", "target_symbol", "target_start", "target_end", "label", "summary", "meta",
    )


def events(spark: SparkSession, files: list[str], root: str, session: str, stanzas: list[Stanza] | tuple[Stanza, ...] = DEFAULTS, mapper: Mapper = columns) -> DataFrame:
    """All events of a session's log files in their total order ``ORDER``; each summary has its boundary's metadata.

    Paths of a worktree (the folder that a log's first line names, if it is not ``root``) are those of ``root``.
    """
    lines = read_lines(spark, files)
    found = parse_lines(lines.join(F.broadcast(first_lines(lines)), "file_rank"), root, session, stanzas, mapper)
    return with_metadata(found)


#: Lines of a log that are scanned in one piece.
CHUNK_LINES = 8192


def chunks() -> dict[str, Column]:
    """Pieces of a session that follow ORDER: a file, a split of it, a run of its lines."""
    return {"file": F.col("file_rank"), "block": F.col("block"), "lines": F.floor(F.col("line_no") / CHUNK_LINES)}


def with_metadata(found: DataFrame, session: str = "session_id") -> DataFrame:
    """Events without boundaries, with ``epoch`` (the resets of their session before them); each summary has the metadata of
    the boundary that announced it in its file.

    One scan in chunks (``operators.scans``), so a session of any length is spread over tasks. A boundary announces the
    summary that comes next: the last of both kinds before a summary decides, if it is of the same file.
    """
    mark = F.when(F.col("kind").isin("boundary", "compacted"), F.struct(F.col("file_rank").alias("file"), (F.col("kind") == "boundary").alias("opens"), F.col("meta").alias("meta")))
    scanned = chunk_scan(found, [session], chunks(), ORDER, {"epoch": F.col("kind").isin("compacted", "cleared")}, {"_mark": mark})
    announced = F.when(F.col("_mark.opens") & (F.col("_mark.file") == F.col("file_rank")), F.col("_mark.meta"))
    return scanned.withColumn("meta", F.when(F.col("kind") == "compacted", announced)).where("kind <> 'boundary'").drop("_mark")
