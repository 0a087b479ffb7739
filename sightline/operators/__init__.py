"""Relational operators of the coverage engine, from marks to reports. All are DataFrame to DataFrame."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import FULL_BODY, UNSEEN, file_status, path_parts, percent, strip_keywords
from ..tables import kept
from .ranges import range_join, stab_join, suffix_join
from .scans import chunk_scan

#: Calls whose symbols one task marks (``agent_marks``).
CALLS_A_TASK = 50_000

# --- matching ---------------------------------------------------------------------------------------


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open ranges share a line; strict on both sides, so an empty range meets only what spans it."""
    return (a_start < b_end) & (b_start < a_end)


def name_matches(name_path: Column, name: Column, target: Column) -> Column:
    """A target names a symbol: by its whole name path, a ``/`` suffix of it, or its name, keywords aside."""
    one = lambda path, t: (path == t) | F.endswith(path, F.concat(F.lit("/"), t))
    bare = strip_keywords(target)
    return one(name_path, target) | (name == target) | one(strip_keywords(name_path), bare) | (strip_keywords(name) == bare)


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, right_start: str, right_end: str, bin_width: int) -> DataFrame:
    """Pairs of rows with equal ``keys`` and overlapping ranges, by bins of about a range's length.

    A row is dealt to every bin that it touches, and a pair is kept in the bin of its later start alone. So
    rows of one key meet only where they are near, not all with all. Columns must differ but for the keys.
    """
    def dealt(df: DataFrame, a: str, b: str) -> DataFrame:
        first, last = F.floor(F.col(a) / bin_width), F.floor((F.greatest(F.col(a) + 1, F.col(b)) - 1) / bin_width)
        return df.withColumn("_bin", F.explode(F.sequence(first, last)))

    met = dealt(left, start, end).join(dealt(right, right_start, right_end), [*keys, "_bin"])
    once = F.col("_bin") == F.floor(F.greatest(start, right_start) / bin_width)
    return met.where(once & overlaps(F.col(start), F.col(end), F.col(right_start), F.col(right_end))).drop("_bin")


def touched(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """The symbols that each distinct (file_path, target_symbol, target_start, target_end) touches, each once.

    Without a target the whole file; a symbol target touches the symbols it names and what they contain; a line
    target those that overlap it. Names meet by an index of suffixes, lines and subtrees by dyadic nodes.
    """
    fields = ["ord", "subtree_end", "id", "name", "line_start", "line_end", "content_hash", "estimated_tokens"]
    tree, target = symbols.select("file_path", *fields), ["target_symbol", "target_start", "target_end"]
    plain = asked.where("target_symbol is null and target_start is null").join(tree, "file_path")
    wanted = asked.where("target_symbol is not null").select("file_path", "target_symbol").distinct()
    path = F.substring_index("id", "::", -1)
    roots = suffix_join(wanted, tree.select("file_path", "ord", "subtree_end", "id", "name"), ["file_path"], "target_symbol", path, F.col("name"))
    spans = roots.select("file_path", "target_symbol", F.col("ord").alias("_from"), (F.col("subtree_end") + 1).alias("_to"))
    named = stab_join(tree, spans, ["file_path"], "ord", "_from", "_to").drop("_from", "_to").dropDuplicates(["file_path", "target_symbol", "ord"])
    named = asked.where("target_symbol is not null").join(named, ["file_path", "target_symbol"])
    lined = range_join(asked.where("target_start is not null"), tree, ["file_path"], "target_start", "target_end", "line_start", "line_end")
    order = ["file_path", *target, *fields]
    return plain.select(*order).unionByName(named.select(*order).unionByName(lined.select(*order)).dropDuplicates(["file_path", *target, "ord"]))


def marks(events: DataFrame, symbols: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per (tool call, symbol) that the call touches.

    ``events``: session_id, the columns of ``order`` (given back as event_ord; ``ord`` by default), epoch, agent_id,
    file_path, read_depth, target_symbol, target_start, target_end. ``symbols``: file_path, ord, subtree_end, id,
    name, line_start, line_end, content_hash, estimated_tokens. Calls repeat themselves, so what is touched is found for each
    distinct target once (``touched``), and calls meet it by an equality; no symbol is tested against a call.
    """
    given = [F.col(c) for c in order or ["ord"]]
    by = ["file_path", "target_symbol", "target_start", "target_end"]
    e = events.where("file_path is not null").select("session_id", (given[0] if len(given) == 1 else F.struct(*given)).alias("event_ord"), "epoch", "agent_id", "read_depth", *by)
    hits = touched(e.select(*by).distinct(), symbols)
    found = e.alias("e").join(hits.alias("h"), [F.col(f"e.{c}").eqNullSafe(F.col(f"h.{c}")) for c in by])
    return found.select(*(f"e.{c}" for c in ("session_id", "event_ord", "epoch", "agent_id", "read_depth", "file_path")), F.col("h.ord").alias("sym_ord"), "h.id", "h.content_hash", "h.estimated_tokens")


# --- epochs and ledger --------------------------------------------------------------------------------


def with_epochs(events: DataFrame, is_reset: Column, partition: list[str], order: list[str], chunk: dict[str, Column] | None = None) -> DataFrame:
    """``epoch``: how many resets came strictly before each event of its session.

    With ``chunk``, columns that follow the order, a session is scanned in pieces, whatever its length (``scans.chunk_scan``);
    without, its events are one window and stream through one task.
    """
    if chunk:
        return chunk_scan(events, partition, chunk, order, {"epoch": is_reset})
    before = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn("epoch", F.coalesce(F.sum(is_reset.cast("long")).over(before), F.lit(0)))


def last_epoch(events: DataFrame, is_reset: Column, partition: list[str]) -> DataFrame:
    """Events after the last reset of their session."""
    total = events.groupBy(*partition).agg(F.sum(is_reset.cast("long")).alias("_resets"))
    return events.join(total, partition).where((F.col("epoch") == F.col("_resets")) & ~is_reset).drop("_resets")


def after_last(events: DataFrame, is_reset: Column, partition: list[str], order: list[str]) -> DataFrame:
    """Events after the last reset of their group, all of a group without one: one aggregate, no epochs."""
    place = F.struct(*order)
    ends = events.where(is_reset).groupBy(*(F.col(c).alias(f"_by_{c}") for c in partition)).agg(F.max(place).alias("_end"))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in partition]
    return events.where(~is_reset).join(ends.hint("merge"), same, "left").where(F.col("_end").isNull() | (place > F.col("_end"))).select(*events.columns)


def ledger(marked: DataFrame, keys: list[str], order: list[str], attributes: list[str], depth: str = "read_depth", agents: str | None = None) -> DataFrame:
    """Deepest reading of each key, with the attributes of the first event that reached it; ``agents``: all that touched it (``agents_of``), too."""
    first = F.min_by(F.struct(*attributes), F.struct((-F.col(depth)).alias("_d"), *order)).alias("_first")
    all_of = [F.array_sort(F.collect_set(agents)).alias("agents")] if agents else []
    return marked.groupBy(*keys).agg(F.max(depth).alias("depth"), first, *all_of).select(*keys, "depth", "_first.*", *(["agents"] if agents else []))


def agent_ledger(marked: DataFrame, keys: list[str], agent: str = "agent_id", depth: str = "read_depth") -> DataFrame:
    """Deepest reading of each key by each agent."""
    return marked.groupBy(*keys, agent).agg(F.max(depth).alias("depth"))


def agent_marks(calls: DataFrame, symbols: DataFrame, per_task: int = CALLS_A_TASK) -> DataFrame:
    """(session_id, agent_id, id, depth), dealt by session and id: what each agent's calls touch, the order of calls left out.

    Equal calls are one before they are spread over symbols, and tasks are as many as calls need, so what a task holds
    does not grow with the log. ``calls``: session_id, agent_id, file_path, read_depth and the targets, counted once.
    """
    parts = max(int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions")), calls.count() // per_task + 1)
    marked = marks(calls.withColumn("epoch", F.lit(0)).repartition(parts), symbols, ["read_depth"])
    return marked.select("session_id", "agent_id", "id", "read_depth").repartition(parts, "session_id", "id")


def distinct_calls(events: DataFrame) -> DataFrame:
    """The calls of each agent that differ, each with its deepest reading; calls without a file too."""
    by = ["session_id", "agent_id", "file_path", "target_symbol", "target_start", "target_end"]
    return kept(events.where("kind = 'tool_call'").groupBy(*by).agg(F.max("read_depth").alias("read_depth")), "calls")


def agent_depths(marked: DataFrame, keys: list[str], agent_id: str, agent: str = "agent_id", depth: str = "read_depth") -> DataFrame:
    """Each key that any agent touched, with how deep one agent has read it; what only others touched is unseen to it."""
    own = F.max(F.when(F.col(agent) == agent_id, F.col(depth)))
    return marked.groupBy(*keys).agg(F.coalesce(own, F.lit(UNSEEN)).alias("depth"))


def depth_histogram(ledger_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return ledger_rows.groupBy(*(by or []), "depth").agg(F.count("*").alias("n"))


def agents_of(marked: DataFrame, keys: list[str], agent: str = "agent_id") -> DataFrame:
    """The agents that touched each key, in their order."""
    return marked.groupBy(*keys).agg(F.array_sort(F.collect_set(agent)).alias("agents"))


def agent_histogram(ledger_agents: DataFrame, ledger_rows: DataFrame, key: str, agent: str, agent_id: str, session: Sequence[str] = ()) -> DataFrame:
    """(depth, n) for one agent; keys that only others touched are unseen to it."""
    own = ledger_agents.where(F.col(agent) == agent_id).select(*session, key, F.col("depth").alias("_own"))
    both = ledger_rows.select(*session, key).join(own, [*session, key], "left")
    return both.groupBy(*session, F.coalesce("_own", F.lit(UNSEEN)).alias("depth")).agg(F.count("*").alias("n"))


def max_depth_by_file(symbols: DataFrame, depths: DataFrame, key: str = "id", by: str = "file_path") -> DataFrame:
    """The deepest reading of anything in each file."""
    d = depths.select(key, F.col("depth").alias("_depth"))
    return symbols.join(d, key, "left").groupBy(by).agg(F.max(F.coalesce("_depth", F.lit(UNSEEN))).alias("depth"))


def subtree_totals(symbols: DataFrame, by: str = "file_path") -> DataFrame:
    """Each symbol with the number of symbols and the tokens of its subtree, itself included.

    By running sums: a subtree is the rows from ``ord`` to ``subtree_end``, so one lookup gives its sum. (The
    tokens of a parent cover its children's text already; sum the roots for a file's tokens.)
    """
    upto = F.sum("estimated_tokens").over(W.partitionBy(by).orderBy("ord"))
    sums = symbols.withColumn("_upto", upto)
    ends = sums.select(by, F.col("ord").alias("subtree_end"), F.col("_upto").alias("_end"))
    # Symbols are made of texts, whose size says little of their number: no side is taken for small.
    out = sums.join(ends.hint("merge"), [by, "subtree_end"])
    tokens = (F.col("_end") - F.col("_upto") + F.col("estimated_tokens")).alias("total_tokens")
    return out.select(*symbols.columns, (F.col("subtree_end") - F.col("ord") + 1).cast("long").alias("total_symbols"), tokens)


def project_totals(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(total_files, total_symbols, root_tokens) of a project."""
    zero = F.lit(0).cast("long")
    of_symbols = symbols.select(zero.alias("f"), F.lit(1).alias("s"), F.when(F.col("level") == 0, F.col("estimated_tokens")).otherwise(zero).alias("t"))
    both = files.select(F.lit(1).cast("long").alias("f"), F.lit(0).alias("s"), zero.alias("t")).unionByName(of_symbols)
    total = lambda c, name: F.coalesce(F.sum(c), zero).alias(name)
    return both.agg(total("f", "total_files"), total("s", "total_symbols"), total("t", "root_tokens"))


def roll_up_hashes(symbols: DataFrame, by: str = "file_path", hash_col: str = "content_hash") -> DataFrame:
    """``symbols`` with ``merkle_hash``: a leaf's is its own hash, a parent's that of its own and its children's in order.

    One shuffle, and one pass over a task's symbols, each file's from the last to the first: below a symbol lie those after it up to
    ``subtree_end``, so its children are what is on top of a stack when its turn comes. Files of a task are sorted and stream
    through, so many small ones cost no more than a large one, and of a file only the open siblings are held.
    """
    rest = symbols.drop("merkle_hash")
    at = [rest.columns.index(c) for c in (by, "level", hash_col)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file: object = ()  # of no row
        stack: list[tuple[int, str | None]] = []
        for batch in batches:
            out: list[str | None] = []
            for path, level, own in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                if path != file:
                    file, stack = path, []
                below = []
                while stack and stack[-1][0] > level:
                    below.append(stack.pop()[1])
                out.append(own if not below else None if own is None or None in below else hashlib.sha256("".join((own, *below)).encode()).hexdigest())
                if level > 0:  # a root is below nothing
                    stack.append((level, out[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "merkle_hash"])

    dealt = rest.repartition(by).sortWithinPartitions(F.col(by), F.col("ord").desc())
    return dealt.mapInArrow(fold, StructType([*rest.schema.fields, StructField("merkle_hash", StringType())]))


def root_hashes(rolled: DataFrame, by: str = "file_path") -> DataFrame:
    """(file, root_hash) of ``roll_up_hashes``: one hash for all that a file holds, in order."""
    tops = F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("ord", "merkle_hash"))))
    return rolled.groupBy(by).agg(F.sha2(F.array_join(F.transform(tops, lambda t: t["merkle_hash"]), ""), 256).alias("root_hash"))


def merkle_stale(old: DataFrame, new: DataFrame, old_roots: DataFrame, new_roots: DataFrame, keys: list[str], by: str = "file_path", hash_col: str = "content_hash") -> DataFrame:
    """``stale`` of two rolled-up projects, from their roots down: symbols are read of files alone whose root hashes differ.

    ``old_roots`` and ``new_roots`` are a row a file, kept beside the symbols. A project that hardly changed costs the roots and
    the changed files; files that only one side has have no keys in common.
    """
    differ = old_roots.select(by, F.col("root_hash").alias("_old")).join(new_roots.hint("merge"), by).where(F.col("_old") != F.col("root_hash")).select(by)
    differ = differ.hint("merge")
    return stale(old.join(differ, by, "left_semi"), new.join(differ, by, "left_semi"), keys, hash_col)


def stale(old: DataFrame, new: DataFrame, keys: list[str], hash_col: str = "content_hash") -> DataFrame:
    """Keys whose content changed."""
    a = old.select(*keys, F.col(hash_col).alias("old_hash"))
    return a.join(new.select(*keys, F.col(hash_col).alias("new_hash")).hint("merge"), keys).where(F.col("old_hash") != F.col("new_hash"))


# --- reports ------------------------------------------------------------------------------------------


def coverage_counts(symbols: DataFrame, depths: DataFrame, key: str = "id", by: str = "file_path") -> DataFrame:
    """(file, total_symbols, seen_count, full_count): rows are counted, so symbols of one id count each."""
    d = depths.select(F.col(key), F.col("depth").alias("_depth"))
    depth = F.coalesce("_depth", F.lit(UNSEEN))
    return symbols.join(d, key, "left").groupBy(by).agg(F.count("*").alias("total_symbols"), F.count_if(depth > UNSEEN).alias("seen_count"), F.count_if(depth == FULL_BODY).alias("full_count"))


def coverage_report(files: DataFrame, symbols: DataFrame, depths: DataFrame, key: str = "id", by: str = "file_path") -> DataFrame:
    """Every file with its counts, percentages and status; files without symbols have zeros."""
    counts = files.select(by).join(coverage_counts(symbols, depths, key, by), by, "left").na.fill(0, ["total_symbols", "seen_count", "full_count"])
    total, seen, full = F.col("total_symbols"), F.col("seen_count"), F.col("full_count")
    return counts.withColumn("seen_percent", percent(seen, total)).withColumn("full_percent", percent(full, total)).withColumn("status", file_status(total, seen, full))


def report_order(report: DataFrame, by: str = "file_path") -> DataFrame:
    """Least read files first, then in path order."""
    return report.orderBy("full_percent", path_parts(F.col(by)))


def report_totals(report: DataFrame) -> DataFrame:
    sums = report.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_symbols", "seen_count", "full_count")))
    return sums.withColumn("seen_percent", percent(F.col("seen_count"), F.col("total_symbols"))).withColumn("full_percent", percent(F.col("full_count"), F.col("total_symbols")))


def sorted_paths(paths: Column) -> Column:
    """An array of paths in the order of their components."""
    return F.transform(F.array_sort(F.transform(paths, path_parts)), lambda p: F.array_join(p, "/"))


def snapshots(events: DataFrame, is_reset: Column, partition: list[str], order: list[str], file_col: str, depth_col: str) -> DataFrame:
    """State before each reset: calls, files touched, distinct keys seen since the reset before it."""
    calls = events.where(~is_reset).groupBy(*partition, "epoch").agg(
        F.count("*").alias("tool_calls_before"), sorted_paths(F.collect_set(file_col)).alias("files_before"),
        F.count_distinct(F.when(F.col(depth_col) > UNSEEN, F.col(file_col))).alias("seen_before"),
    )
    ends = events.where(is_reset).select(*partition, "epoch", *order)
    out = ends.join(calls, [*partition, "epoch"], "left")
    return out.withColumn("tool_calls_before", F.coalesce("tool_calls_before", F.lit(0))).withColumn("files_before", F.coalesce("files_before", F.array().cast("array<string>"))).withColumn("seen_before", F.coalesce("seen_before", F.lit(0)))


def pair_metadata(rows: DataFrame, is_boundary: Column, is_summary: Column, value: Column, partition: list[str], order: list[str]) -> DataFrame:
    """Summaries with the metadata of the last boundary since the summary before; each is used once."""
    w = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    segment = F.coalesce(F.sum(is_summary.cast("long")).over(w), F.lit(0))
    seg = W.partitionBy(*partition, "_segment").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("_segment", segment).withColumn("metadata", F.last(F.when(is_boundary, value), ignorenulls=True).over(seg)).where(is_summary).drop("_segment")


# --- views --------------------------------------------------------------------------------------------


def ring_buffer(rows: DataFrame, partition: list[str], order: list[Column], limit: int = 200, drop: int = 100) -> DataFrame:
    """What an append-only buffer still holds that drops its first ``drop`` rows when it exceeds ``limit``.

    A buffer holds at most ``limit`` last rows. Every task keeps its last ones of each group before anything is
    shuffled (the rank's limit goes below the exchange), and counts are summed likewise.
    """
    rank = F.row_number().over(W.partitionBy(*partition).orderBy(*(c.desc() for c in order)))
    last = rows.withColumn("_back", rank).where(F.col("_back") <= limit)
    sizes = rows.groupBy(*(F.col(c).alias(f"_by_{c}") for c in partition)).agg(F.count("*").alias("_n"))
    n = F.col("_n")
    kept = F.when(n <= limit, n).otherwise((limit - drop + 1) + (n - limit - 1) % drop)
    joined = last.join(sizes, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in partition])
    return joined.where(F.col("_back") <= kept).select(*rows.columns)


def activity(events: DataFrame, partition: list[str], order: list[str], limit: int = 200, drop: int = 100) -> DataFrame:
    """What the feed of each session holds: calls that read something, since the last clear; compactions keep it."""
    place = F.struct(*order)
    cleared = events.where("kind = 'cleared'").groupBy(*partition).agg(F.max(place).alias("_cleared"))
    calls = events.where(F.expr("kind = 'tool_call'") & (F.col("read_depth") != UNSEEN)).join(cleared, partition, "left")
    kept = calls.where(F.col("_cleared").isNull() | (place > F.col("_cleared"))).drop("_cleared")
    return ring_buffer(kept, partition, [F.col(c) for c in order], limit, drop)


def first_seen(events: DataFrame, agent: str, order: Column) -> DataFrame:
    """Agents with the order of their first event."""
    return events.groupBy(agent).agg(F.min(order).alias("first_ord"))


def resolve_agent(agents: DataFrame, prefix: str, agent: str = "agent_id", order: str = "first_ord") -> DataFrame:
    """(resolved, candidates): the first-seen agent whose id starts with ``prefix``, the prefix itself if none does, and how many do."""
    found = agents.where(F.startswith(F.col(agent), F.lit(prefix)))
    return found.agg(F.coalesce(F.min_by(agent, order), F.lit(prefix)).alias("resolved"), F.count("*").alias("candidates"))


def agent_tree(agents: DataFrame, agent: str = "agent_id", order: str = "first_ord", session: str = "session_id") -> DataFrame:
    """(agent, parent, depth): the first agent of a session is its root, and later ids with ``agent-`` hang below it."""
    # Agents of one session only: the list is as short as the session has agents.
    root = F.first(F.col(agent)).over(W.partitionBy(session).orderBy(order))
    parent = F.when(F.startswith(F.col(agent), F.lit("agent-")) & (root != F.col(agent)), root)
    return agents.withColumn("parent_id", parent).withColumn("depth", F.when(F.col("parent_id").isNull(), 0).otherwise(1))


def agent_children(agents: DataFrame, agent: str = "agent_id", session: Sequence[str] = ()) -> DataFrame:
    """(agent, children): the agents directly below each agent that has any, of each session where one is named."""
    return agents.where("parent_id is not null").groupBy(*session, F.col("parent_id").alias(agent)).agg(F.array_sort(F.collect_list(F.col(agent))).alias("children"))


def agents_in_order(agents: DataFrame, agent: str = "agent_id", order: str = "first_ord", session: str = "session_id", levels: int = 1000) -> DataFrame:
    """Agents depth first below the root, with ``path`` and ``indent``; those whose parent is unknown follow, each with its own, by first sight.

    One recursive query walks all sessions level by level from rows that are written once. More than ``levels``
    levels are an error; agents that are each other's parents hang below no root and are left out. The walk's
    number of rows is not bounded, so the session's limit of rows in a recursion is taken away. Agents grow with the
    logs, so every join is a merge: a broadcast would send all of them through the driver once a level.
    """
    spark = agents.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    rows = kept(agents.select(F.col(session).alias("s"), F.col(agent).alias("a"), F.col("parent_id").alias("p"), F.col(order).cast("long").alias("o")), "agents")
    root = rows.groupBy("s").agg(F.min(F.when(F.col("p").isNull(), F.struct("o", "a")))["a"].alias("root"))
    orphan = rows.select("s", "p").join(rows.select("s", F.col("a").alias("p")).hint("merge"), ["s", "p"], "left_anti").where("p is not null").distinct().withColumn("lost", F.lit(True))
    known = rows.join(root.hint("merge"), "s").join(orphan.hint("merge"), ["s", "p"], "left")
    tops = kept(known.where("p is null or lost").select("s", "a", F.when(F.col("a") == F.col("root"), 0).otherwise(1).alias("orphan"), "o"), "tops")
    walk = spark.sql(
        f"""WITH RECURSIVE walk(s, a, path) MAX RECURSION LEVEL {int(levels)} AS (
         SELECT s, a, array(struct(orphan, o AS ord, a AS agent)) FROM {{tops}}
         UNION ALL SELECT /*+ MERGE(c) */ c.s, c.a, concat(w.path, array(struct(0 AS orphan, c.o AS ord, c.a AS agent))) FROM walk AS w JOIN {{rows}} AS c ON c.s = w.s AND c.p = w.a)
        SELECT * FROM walk""", tops=tops, rows=rows)
    return agents.select(session, agent, order).join(walk.select(F.col("s").alias(session), F.col("a").alias(agent), "path").hint("merge"), [session, agent]).withColumn("indent", F.size("path") - 1)


def tree_prefixes(rows: DataFrame, session: str = "session_id", order: str = "path") -> DataFrame:
    """``prefix`` of each row of an indented list in depth-first order: bars where an outer level goes on, a corner at a last sibling.

    A level goes on while the session has a later row of it, so the last row of each level and the last child of
    each parent say it all: two aggregates, no list of what follows a row.
    """
    parent = F.slice(F.col(order), F.lit(1), F.size(order) - 1)
    ends = rows.groupBy(session, "indent").agg(F.max(order).alias("_end")).groupBy(session).agg(F.map_from_entries(F.collect_list(F.struct("indent", "_end"))).alias("_ends"))
    last = rows.groupBy(session, parent.alias("_parent")).agg(F.max(order).alias("_last"))
    joined = rows.withColumn("_parent", parent).join(ends.hint("merge"), session).join(last.hint("merge"), [session, "_parent"])
    levels = F.when(F.col("indent") > 0, F.sequence(F.lit(0), F.col("indent") - 1)).otherwise(F.array().cast("array<int>"))
    bars = F.transform(levels, lambda i: F.when(F.col("_ends")[i] > F.col(order), F.lit("│ ")).otherwise(F.lit("  ")))
    corner = F.when(F.col("_last") > F.col(order), F.lit("├─ ")).otherwise(F.lit("└─ "))
    return joined.withColumn("prefix", F.concat(F.array_join(bars, ""), corner)).drop("_ends", "_last", "_parent")


def agent_coverage(agents: DataFrame, ledger_agents: DataFrame, total: int, agent: str = "agent_id", session: Sequence[str] = ()) -> DataFrame:
    """``agents`` with the symbols that each has seen and their share of ``total``, in whole percent."""
    seen = ledger_agents.where(F.col("depth") > UNSEEN).groupBy(*session, agent).agg(F.count("*").alias("seen"))
    out = agents.join(seen, [*session, agent], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    return out.withColumn("seen_percent", percent(F.col("seen"), F.lit(total)).cast("int"))


def stats_panel(depths: DataFrame, total: Column) -> DataFrame:
    """One row: symbols seen, whole percent seen, rows of each depth, and how many of ``total`` are unseen (never below 0)."""
    at = lambda code: F.count_if(F.col("depth") == code)
    sums = depths.agg(F.count_if(F.col("depth") > UNSEEN).alias("seen"), at(4).alias("full_body"), at(3).alias("signature"), at(2).alias("overview"), at(1).alias("name"), at(5).alias("stale"))
    return sums.withColumn("percent", percent(F.col("seen"), total).cast("int")).withColumn("unseen", F.greatest(total - F.col("seen"), F.lit(0)))


def _feed(calls: DataFrame, compactions: DataFrame, agent: str | None) -> DataFrame:
    a = calls.where(F.col("agent_id") == agent) if agent is not None else calls
    return a.withColumn("src", F.lit(0)).unionByName(compactions.withColumn("src", F.lit(1)), allowMissingColumns=True)


def merged_feed(calls: DataFrame, compactions: DataFrame, agent: str | None = None) -> DataFrame:
    """Tool calls (of one agent if given) and all compactions, stable by time stamp text."""
    return _feed(calls, compactions, agent).orderBy("ts", "src", "ord")


def feed_positions(calls: DataFrame, compactions: DataFrame, partition: list[str], agent: str | None = None) -> DataFrame:
    """The same rows with ``pos``, their place in their session's feed."""
    return _feed(calls, compactions, agent).withColumn("pos", F.row_number().over(W.partitionBy(*partition).orderBy("ts", "src", "ord")))


def files_after(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``after`` that ``before`` lacks."""
    return after.select(*keys).distinct().join(before.select(*keys).distinct(), keys, "left_anti")


def search(rows: DataFrame, name: str, pos: str, query: str, cursor: int) -> DataFrame:
    """The next row after ``cursor`` whose name holds ``query``, whatever the case, wrapping around."""
    hit = rows.where(F.contains(F.lower(F.col(name)), F.lit(query.lower())))
    return hit.orderBy(F.col(pos) <= cursor, pos).limit(1)


def visible_rows(symbols: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Symbols none of whose ancestors is collapsed (file_path, ord), in file and tree order."""
    shut = collapsed.join(symbols.select("file_path", "ord", "subtree_end"), ["file_path", "ord"]) if "subtree_end" not in collapsed.columns else collapsed
    c = shut.select("file_path", F.col("ord").alias("c_ord"), F.col("subtree_end").alias("c_end"))
    ranges = c.groupBy("file_path").agg(F.collect_list(F.struct("c_ord", "c_end")).alias("_shut"))
    hidden = F.exists("_shut", lambda r: (F.col("ord") > r["c_ord"]) & (F.col("ord") <= r["c_end"]))
    rest = symbols.join(ranges, "file_path", "left").where(~F.coalesce(hidden, F.lit(False))).drop("_shut")
    return rest.orderBy(path_parts(F.col("file_path")), "ord")


def tree_rows(files: DataFrame, symbols: DataFrame, depths: DataFrame, collapsed_files: DataFrame, collapsed_ids: DataFrame, by_status: bool = False, key: str = "id") -> DataFrame:
    """Rows of the tree view in their order: files, and below those not collapsed their visible symbols.

    ``files``: file_path, total_lines. ``depths``: key, depth (of all agents, or of one). Collapsed symbols are
    named by id, so all symbols of an id close together. A file that is read at all shows as read by name.
    """
    report = coverage_report(files, symbols, depths, key).join(files.select("file_path", "total_lines"), "file_path")
    shut = collapsed_files.select("file_path").distinct().withColumn("_shut", F.lit(True))
    heads = report.join(shut, "file_path", "left").select(
        "file_path", "status", F.lit(-1).alias("ord"), F.lit(0).alias("depth"), F.col("file_path").alias("name"), F.lit("").alias("label"), F.col("_shut").isNull().alias("is_expanded"),
        (F.col("total_symbols") > 0).alias("has_children"), F.concat(F.col("total_lines").cast("string"), F.lit(" lines")).alias("line_range"), F.lit(0).cast("long").alias("token_count"),
        F.when(F.col("status") == 3, UNSEEN).otherwise(1).alias("read_depth"), "seen_count", "total_symbols",
    )
    closed = collapsed_ids.select(key).distinct().withColumn("_closed", F.lit(True))
    known = symbols.join(closed, key, "left").join(depths.select(key, F.col("depth").alias("_depth")), key, "left")
    open_ = visible_rows(known, known.where("_closed").select("file_path", "ord", "subtree_end"))
    open_ = open_.join(heads.where("is_expanded").select("file_path", "status"), "file_path").select(
        "file_path", "status", "ord", (F.col("level") + 1).alias("depth"), "name", "label", F.col("_closed").isNull().alias("is_expanded"), (F.col("subtree_end") > F.col("ord")).alias("has_children"),
        F.concat(F.lit("L"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")).alias("line_range"), F.col("estimated_tokens").alias("token_count"),
        F.coalesce("_depth", F.lit(UNSEEN)).alias("read_depth"), F.lit(0).cast("long").alias("seen_count"), F.lit(0).cast("long").alias("total_symbols"),
    )
    place = [F.col("status")] * by_status + [path_parts(F.col("file_path")), F.col("ord")]
    return heads.unionByName(open_).orderBy(*place)


def compaction_overlay(files_before: DataFrame, current: DataFrame, shown: int = 20) -> DataFrame:
    """(side, file_path, depth): the first files of a snapshot with their depth now, and the files read since that it lacks.

    ``files_before``: file_path. ``current``: file_path, depth (``max_depth_by_file``). ``shown`` of each side, in path order.
    """
    now = current.select("file_path", F.col("depth"))
    before = files_before.select("file_path").distinct().join(now, "file_path", "left").select(F.lit("before").alias("side"), "file_path", F.coalesce("depth", F.lit(UNSEEN)).alias("depth"))
    after = now.where(F.col("depth") > UNSEEN).join(files_before.select("file_path"), "file_path", "left_anti").select(F.lit("after").alias("side"), "file_path", "depth")
    first = lambda df: df.orderBy(path_parts(F.col("file_path"))).limit(shown)
    return first(before).unionByName(first(after))


def numbered_compactions(events: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """Compactions after the last clear of each session, numbered from 1."""
    place = F.struct(*order)
    cleared = events.where("kind = 'cleared'").groupBy(*partition).agg(F.max(place).alias("_cleared"))
    kept = events.where("kind = 'compacted'").join(cleared, partition, "left").where(F.col("_cleared").isNull() | (place > F.col("_cleared"))).drop("_cleared")
    return kept.withColumn("sequence", F.row_number().over(W.partitionBy(*partition).orderBy(*order)))


def path_ranks(rows: DataFrame, path: str, tie: str, sample: int = 1000) -> DataFrame:
    """``rows`` with ``pos``, their place from 1 in the order of path components (then ``tie``), without one task for all.

    Rows are dealt to buckets between bounds drawn from at most ``sample`` paths, chosen by hash: a row's
    bucket follows from its path alone, so any task that is run again deals alike. Ranks within a bucket
    follow the rows of the buckets before.
    """
    key = F.array_join(path_parts(F.col(path)), "\x00")
    chosen = rows.select(key.alias("_key")).distinct().orderBy(F.xxhash64("_key")).limit(sample)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = sorted((r[0] for r in chosen.where("_key is not null").collect()), key=lambda k: k.encode("utf-8", "surrogatepass"))
    bounds = drawn[:: max(1, len(drawn) // parts)][1:]
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("_key"))) if bounds else F.lit(0)
    keyed = rows.withColumn("_key", key).withColumn("_bucket", F.when(F.col("_key").isNull(), -1).otherwise(bucket))
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = keyed.withColumn("_rank", F.row_number().over(W.partitionBy("_bucket").orderBy("_key", tie)))
    return ranked.join(before, "_bucket").withColumn("pos", F.col("_rank") + F.col("_base")).drop("_key", "_bucket", "_base", "_rank")
