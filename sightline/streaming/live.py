"""The live ledger: one streaming query whose keyed state, in Spark's own state store, is what every session has read.

Rows of two kinds come in, by session: events, and the symbols of files that are new or have changed. A session's
state is its clock (epoch, calls, compactions), the boundaries that wait for a summary, the symbols of each file that it
could read, an entry for each symbol it has read, its feed and its compactions. A batch reads and writes the
entries of the symbols it touches and no others, so its work does not grow with what came before; after a reset,
entries of earlier epochs count as absent and are overwritten when their symbol is next read.

An entry is folded in the true order of its reads and changes. Reading deepens an agent's depth, never
lessens it; the entry's depth is the deepest of its agents', and its hash, agent and tokens are those of
the read that last deepened it. A source change whose hash differs from the hash at reading makes the
entry and all its agents stale, which later reads do not undo, but for agents that come anew. In batches
without a change this is the batch ledger exactly.
"""

from __future__ import annotations

import re
import uuid
from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..functions import STALE
from ..sources.sessions import ORDER, parse_lines
from .tail import FileWatch

#: What is kept of a symbol.
SYMBOL = "ord int, subtree_end int, id string, name string, label string, line_start long, line_end long, content_hash string, estimated_tokens long"
ENTRY = "epoch long, depth int, content_hash string, agent_id string, estimated_tokens long, agents map<string,int>"
META = "trigger string, pre_tokens long, post_tokens long, duration_ms long"
#: The symbols of one file, for the sessions that can read it. ``change`` below 0 counts before a batch's events, others after them.
PROJECT = f"session_id string, change long, file_path string, symbols array<struct<{SYMBOL}>>"
#: One row a session and batch: what its panel shows.
PANEL = "session_id string, epoch long, calls long, compactions long, seen long, depths map<int,long>, last string"
FEED, FEED_DROP = 200, 100
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


Symbol = namedtuple("Symbol", [c.split()[0] for c in SYMBOL.split(", ")])


def _symbols(found: list) -> list[Symbol]:
    """Symbols out of rows, which come as dicts, and out of the state, as tuples."""
    return [Symbol(**s) if isinstance(s, dict) else Symbol(*s) for s in found]


def fold_entry(entry: dict[str, Any], steps: list[dict[str, Any]]) -> dict[str, Any]:
    """An entry after ``steps`` in their order: reads (agent, depth, hash, tokens) and changes (hash)."""
    agents, out = dict(entry["agents"]), dict(entry)
    for s in steps:
        if s["agent"] is None:
            if out["depth"] > 0 and out["content_hash"] != s["hash"]:
                out["depth"], agents = STALE, dict.fromkeys(agents, STALE)
            continue
        agents[s["agent"]] = max(agents.get(s["agent"], 0), s["depth"])
        deepest = max(agents.values())
        if deepest == STALE or deepest > out["depth"]:
            out |= {"depth": deepest, "content_hash": s["hash"], "agent_id": s["agent"], "estimated_tokens": s["tokens"]}
    return out | {"agents": agents}


def bare(path: str) -> str:
    return "/".join(re.sub("^([a-z]+ )+", "", part) for part in path.split("/"))


def touched(symbols: list[Symbol], target: str | None, start: int | None, end: int | None) -> list[Symbol]:
    """The symbols of a file that a call touches, as ``operators.touched`` has it: all, those named and below them, those that overlap."""
    if target is None and start is None:
        return list(symbols)
    roots = []
    if target is not None:
        short = bare(target)
        fits = lambda path, t: path == t or path.endswith(f"/{t}")
        for s in symbols:
            path = s.id.rsplit("::", 1)[-1]
            if fits(path, target) or s.name == target or fits(bare(path), short) or bare(s.name) == short:
                roots.append((s.ord, s.subtree_end))
    lined = lambda s: start is not None and s.line_start < end and start < s.line_end
    return [s for s in symbols if lined(s) or any(a <= s.ord <= b for a, b in roots)]


class LedgerProcessor(StatefulProcessor):
    """The state of one session and what a batch makes of it; a row of PANEL comes out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "epoch long, calls long, compactions long, last string")
        self.depths = handle.getMapState("depths", "depth int", "n long")
        self.waiting = handle.getMapState("waiting", "log string", META)
        self.files = handle.getMapState("files", "file_path string", f"symbols array<struct<{SYMBOL}>>")
        self.entries = handle.getMapState("entries", "id string", ENTRY)
        self.feed = handle.getListState("feed", "ts string, agent_id string, tool_name string, description string")
        self.past = handle.getListState("past", f"sequence long, ts string, summary string, meta struct<{META}>, tool_calls_before long, seen_before long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        events, early, late = [], [], []
        for r in rows:
            (events if r.kind is not None else early if r.change < 0 else late).append(r)
        epoch, calls, compactions, last = self.clock.get() if self.clock.exists() else (0, 0, 0, "")
        self.histogram = {d[0]: n[0] for d, n in self.depths.iterator()}
        self.cache: dict[str, list[Symbol]] = {}
        feed = list(self.feed.get()) if events and self.feed.exists() else []
        for r in sorted(early, key=lambda r: r.change):
            self.source(r, epoch)
        for e in sorted(events, key=lambda e: tuple(getattr(e, c) for c in ORDER)):
            last = e.ts or last
            if e.kind == "boundary":  # its agent is its log, as that of a summary
                self.waiting.updateValue((e.agent_id,), tuple(e.meta.values() if isinstance(e.meta, dict) else e.meta))
            elif e.kind == "tool_call":
                calls += 1
                self.read(e, epoch)
                if e.read_depth:
                    feed.append((e.ts, e.agent_id, e.tool_name, e.description))
                    feed = feed[FEED_DROP:] if len(feed) > FEED else feed
            else:
                if e.kind == "compacted":
                    meta = tuple(self.waiting.getValue((e.agent_id,))) if self.waiting.containsKey((e.agent_id,)) else None
                    self.waiting.removeKey((e.agent_id,))
                    compactions += 1
                    self.past.appendValue((compactions, e.ts, e.summary, meta, calls, self.seen()))
                else:
                    compactions, feed = 0, []
                    self.past.clear()
                epoch, calls, self.histogram = epoch + 1, 0, {}
        for r in sorted(late, key=lambda r: r.change):
            self.source(r, epoch)
        self.clock.update((epoch, calls, compactions, last))
        self.depths.clear()
        for depth, n in self.histogram.items():
            self.depths.updateValue((depth,), (n,))
        if events:
            self.feed.clear()
            if feed:
                self.feed.put([tuple(f) for f in feed])
        yield Row(session_id=key[0], epoch=epoch, calls=calls, compactions=compactions, seen=self.seen(), depths={d: n for d, n in self.histogram.items() if n}, last=last)

    def close(self) -> None:
        pass

    def seen(self) -> int:
        return sum(n for d, n in self.histogram.items() if d > 0)

    def symbols(self, path: str) -> list[Symbol]:
        if path not in self.cache:
            self.cache[path] = _symbols(self.files.getValue((path,))[0]) if self.files.containsKey((path,)) else []
        return self.cache[path]

    def read(self, e: Row, epoch: int) -> None:
        if e.file_path is None:
            return
        for s in touched(self.symbols(e.file_path), e.target_symbol, e.target_start, e.target_end):
            self.fold(s.id, epoch, {"agent": e.agent_id, "depth": e.read_depth, "hash": s.content_hash, "tokens": s.estimated_tokens})

    def source(self, r: Row, epoch: int) -> None:
        """New symbols of a file; those of one id are told apart by their label and their turn among those of both."""
        def turns(symbols: list[Symbol]) -> dict[tuple, str]:
            seen: dict[tuple, int] = {}
            out = {}
            for s in sorted(symbols, key=lambda s: s.ord):
                seen[s.id, s.label] = turn = seen.get((s.id, s.label), 0) + 1
                out[s.id, s.label, turn] = s.content_hash
            return out

        own = _symbols(r.symbols)
        old, new = turns(self.symbols(r.file_path)), turns(own)
        for at, content in new.items():
            if at in old and old[at] != content:
                self.fold(at[0], epoch, {"agent": None, "hash": content})
        self.cache[r.file_path] = own
        self.files.updateValue((r.file_path,), ([tuple(s) for s in own],))

    def fold(self, symbol: str, epoch: int, step: dict[str, Any]) -> None:
        known = self.entries.getValue((symbol,)) if self.entries.containsKey((symbol,)) else None
        if known is not None and known[0] == epoch:
            entry = dict(zip(("depth", "content_hash", "agent_id", "estimated_tokens", "agents"), known[1:], strict=True))
        elif step["agent"] is None:
            return
        else:
            entry = {"depth": 0, "content_hash": None, "agent_id": None, "estimated_tokens": 0, "agents": {}}
        before = entry["depth"] if entry["agents"] else None
        out = fold_entry(entry, [step])
        if before is not None:
            self.histogram[before] -= 1
        self.histogram[out["depth"]] = self.histogram.get(out["depth"], 0) + 1
        self.entries.updateValue((symbol,), (epoch, out["depth"], out["content_hash"], out["agent_id"], out["estimated_tokens"], out["agents"]))


def live(events: DataFrame, project: DataFrame) -> DataFrame:
    """The stream of panels (PANEL) of a stream of events (``sources.sessions.parse_lines``) and one of sources (PROJECT).

    Start it with ``start``, which sees to the state store.
    """
    own = ["session_id", *ORDER, "kind", "agent_id", "tool_name", "file_path", "read_depth", "description", "ts", "target_symbol", "target_start", "target_end", "summary", "meta"]
    rows = events.select(*own).unionByName(project, allowMissingColumns=True)
    return rows.groupBy("session_id").transformWithState(LedgerProcessor(), PANEL, "Update", "None")


def start(panels: DataFrame, checkpoint: str, show: Callable[[DataFrame, int], None] | None = None, interval: str = "250 milliseconds") -> Any:
    """The running query of ``live``; ``show`` gets the panels of each batch, all of which it has to read. Its state lies below ``checkpoint``, a shared folder."""
    panels.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    read = show or (lambda batch, number: batch.write.format("noop").mode("overwrite").save())
    writer: DataStreamWriter = panels.writeStream.outputMode("update").foreachBatch(read)
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


class LiveState:
    """What the state store of a query holds, read as tables after any batch."""

    def __init__(self, spark: SparkSession, checkpoint: str):
        self.spark, self.checkpoint = spark, checkpoint

    def _var(self, name: str) -> DataFrame:
        return self.spark.read.format("statestore").option("stateVarName", name).load(self.checkpoint)

    def clock(self) -> DataFrame:
        """(session_id, epoch, calls, compactions, last)"""
        return self._var("clock").select(F.col("key.session_id").alias("session_id"), "value.*")

    def ledger(self) -> DataFrame:
        """Entries since the last reset of their session: session_id, id, depth, content_hash, agent_id, estimated_tokens, agents."""
        entries = self._var("entries").select(F.col("key.session_id").alias("session_id"), F.col("user_map_key.id").alias("id"), "user_map_value.*")
        return entries.join(self.clock().select("session_id", F.col("epoch").alias("_now")), "session_id").where(F.col("epoch") == F.col("_now")).drop("_now", "epoch")

    def agent_ledger(self) -> DataFrame:
        return self.ledger().select("session_id", "id", F.explode("agents").alias("agent_id", "depth"))

    def feed(self) -> DataFrame:
        return self._var("feed").select(F.col("key.session_id").alias("session_id"), "list_element.*")

    def compactions(self) -> DataFrame:
        return self._var("past").select(F.col("key.session_id").alias("session_id"), "list_element.*")


# --- sources ----------------------------------------------------------------------------------------------


def write_sources(symbols: DataFrame, files: DataFrame, sessions: list[str], change: int, folder: str) -> None:
    """Put the symbols of whole files, for each of ``sessions``, where ``source_stream`` finds them; ``files`` names all of them, also those without a symbol."""
    names = [c.split()[0] for c in SYMBOL.split(", ")]
    listed = symbols.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("symbols"))
    rows = files.select("file_path").distinct().join(listed, "file_path", "left").withColumn("symbols", F.coalesce("symbols", F.array().cast(f"array<struct<{SYMBOL.replace(' ', ':').replace(',:', ',')}>>")))
    rows = rows.select(F.explode(F.array(*map(F.lit, sessions))).alias("session_id"), F.lit(change).cast("long").alias("change"), "file_path", "symbols")
    rows.write.mode("append").parquet(f"{folder}/change={change:+d}-{uuid.uuid4().hex[:8]}")


def source_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(PROJECT).option("recursiveFileLookup", "true").parquet(folder)


def poll_sources(watch: FileWatch, paths: list[str], scan: Callable[[list[str]], tuple[DataFrame, DataFrame]], sessions: list[str], change: int, folder: str) -> bool:
    """Write what changed of ``paths`` since the last look; whether anything did.

    ``scan`` gives (files, symbols) of the changed paths: ``code.files`` and ``code.symbols`` of their sources, or, for
    language-server caches, a whole ``lspcache.scan``. Files that are gone stay in the ledger's project.
    """
    changed = watch.changed(paths)
    if changed:
        files, symbols = scan(changed)
        write_sources(symbols, files, sessions, change, folder)
    return bool(changed)


def events_of(lines: DataFrame, root: str, session: Any, stanzas: list | tuple | None = None) -> DataFrame:
    """The events of a stream of lines (``tail.read_stream``), with their boundaries."""
    from ..plans.toolmap import DEFAULTS

    return parse_lines(lines, root, session, stanzas or DEFAULTS)
