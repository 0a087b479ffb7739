"""The live ledger: the tail of growing logs, folding in parts, and staleness, against a plain sequential fold."""

import json
import random

from pyspark.sql import functions as F

from sightline import operators as O
from sightline.plans import coverage
from sightline.sources import code, sessions
from sightline.streaming import live, tail

SID = "01234567-89ab-cdef-0123-456789abcdef"
SOURCES = {"a.rs": "struct P;\nimpl P {\n    fn x() {}\n    fn y() {}\n}\n", "b.py": "def f(): pass\ndef g(): pass\n"}


def tool(name, agent="main", **inputs):
    return {"type": "assistant", "agentId": agent, "timestamp": "t", "message": {"content": [{"type": "tool_use", "name": name, "input": inputs}]}}


def scanned(spark, sources):
    return code.symbols(spark.createDataFrame(list(sources.items()), "file_path string, source string"))


def parsed(spark, records, start=0):
    lines = spark.createDataFrame([(0, "main", 0, start + i, json.dumps(r)) for i, r in enumerate(records)], sessions.LINES)
    return sessions.with_metadata(sessions.parse_lines(lines, "/p", "s"))


def plain(rows):
    return {r.id: (r.depth, r.agent_id, r.content_hash, r.estimated_tokens) for r in rows}


RESET = {"type": "user", "isCompactSummary": True, "message": {"content": "x"}}


def random_records(n, seed):
    rng, out = random.Random(seed), []
    for _ in range(n):
        agent = rng.choice(["main", "agent-1", "agent-2"])
        out.append(rng.choice([
            tool("Read", agent, file_path="/p/a.rs"), tool("Grep", agent, pattern="q", path="a.rs"), tool("Read", agent, file_path="/p/b.py", offset=1, limit=1), tool("mcp__serena__find_symbol", agent, relative_path="a.rs", name_path_pattern="P/x"),
            tool("Glob", agent, pattern="q", path="b.py"), RESET if rng.random() < 0.3 else tool("Odd", agent),
        ]))
    return out


def staged(spark, tmp_path, sources=SOURCES, names=("s",)):
    """A project's sources as a stream, and a folder of lines as another, one file a batch."""
    symbols = scanned(spark, sources)
    live.write_sources(symbols, symbols, list(names), -1, f"file://{tmp_path}/sources")
    (tmp_path / "lines").mkdir()
    return symbols


def put(tmp_path, number, records, start=0, session="s"):
    path = tmp_path / "lines" / f"{number:04d}.json"
    path.write_text("".join(json.dumps({"session": session, "file_rank": 0, "stem": "main", "block": 0, "line_no": start + i, "raw": json.dumps(r)}) + "\n" for i, r in enumerate(records)))


def started(spark, tmp_path, show=None):
    lines = spark.readStream.schema(f"session string, {sessions.LINES}").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/lines")
    events = live.events_of(lines, "/p", F.col("session"))
    return live.start(live.live(events, live.source_stream(spark, f"file://{tmp_path}/sources")), f"file://{tmp_path}/query", show, "0 seconds")


def run_all(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert query.exception() is None


BOUNDARY = {"type": "system", "subtype": "compact_boundary", "compactMetadata": {"trigger": "auto", "preTokens": 7}}


def test_random_cuts_and_a_restart_give_the_ledger_of_the_whole(spark, tmp_path):
    """Two sessions, cut anywhere, with boundaries and their summaries in different batches, and the query stopped between."""
    names = ("s", "t")
    symbols = staged(spark, tmp_path, names=names)
    records = {n: random_records(60, 3 + i) for i, n in enumerate(names)}
    for n in names:
        records[n][20:22] = [BOUNDARY, RESET]
        records[n][44] = tool("Read", "agent-1", file_path="/p/a.rs")
    cuts, number = [0, 7, 21, 30, 60], 0
    for a, b in zip(cuts, cuts[1:]):
        for n in names:
            put(tmp_path, number, records[n][a:b], a, n)
            number += 1
        if a == 7:
            run_all(started(spark, tmp_path))
    panels = []
    run_all(started(spark, tmp_path, lambda df, n: panels.extend(df.collect())))
    state = live.LiveState(spark, f"file://{tmp_path}/query")
    for n in names:
        lines = spark.createDataFrame([(0, "main", 0, i, json.dumps(r)) for i, r in enumerate(records[n])], sessions.LINES)
        whole = coverage.fold(symbols.select("file_path").distinct(), symbols, sessions.with_metadata(sessions.parse_lines(lines, "/p", n)))
        own = state.ledger().where(F.col("session_id") == n)
        assert plain(own.collect()) == plain(whole.ledger.collect()) != {}
        assert {(r.id, r.agent_id, r.depth) for r in state.agent_ledger().where(F.col("session_id") == n).collect()} == {(r.id, r.agent_id, r.depth) for r in whole.agent_ledger.collect()}
        past = state.compactions().where(F.col("session_id") == n).orderBy("sequence").collect()
        want = whole.compactions.orderBy("sequence").collect()
        assert [(r.sequence, r.ts, r.tool_calls_before, r.seen_before, r.meta and r.meta.pre_tokens) for r in past] == [(r.sequence, r.ts, r.tool_calls_before, r.seen_before, r.meta and r.meta.pre_tokens) for r in want]
        assert any(r.meta for r in past)
        panel = [p for p in panels if p.session_id == n][-1]
        depths = [r.depth for r in whole.ledger.collect()]
        assert panel.seen == sum(d > 0 for d in depths) and panel.depths == {d: depths.count(d) for d in depths}
        feed = O.activity(sessions.with_metadata(sessions.parse_lines(lines, "/p", n)), ["session_id"], sessions.ORDER).count()
        assert state.feed().where(F.col("session_id") == n).count() == feed


def test_changed_sources_make_what_was_read_stale(spark, tmp_path):
    staged(spark, tmp_path)
    read = lambda path, agent="main": tool("Read", agent, file_path=f"/p/{path}")
    query, folder = started(spark, tmp_path), f"file://{tmp_path}/sources"
    state = live.LiveState(spark, f"file://{tmp_path}/query")

    def change(n, sources):
        symbols = scanned(spark, sources)
        live.write_sources(symbols, spark.createDataFrame([(p,) for p in sources], "file_path string"), ["s"], n, folder)
        query.processAllAvailable()

    got = lambda: {r.id: (r.depth, r.agents) for r in state.ledger().collect()}
    try:
        put(tmp_path, 0, [read("b.py"), tool("Grep", "agent-1", pattern="q", path="b.py")])
        query.processAllAvailable()
        change(0, {"b.py": "def f(): return 1\ndef g():\n    pass\n", "c.py": "def new(): pass\n"})
        assert got() == {"b.py::f": (5, {"main": 5, "agent-1": 5}), "b.py::g": (4, {"main": 4, "agent-1": 2})}  # white space alone is no change
        put(tmp_path, 1, [read("b.py"), read("b.py", "agent-9"), read("c.py")], 10)
        query.processAllAvailable()
        assert got()["b.py::f"] == (5, {"main": 5, "agent-1": 5, "agent-9": 4}) and got()["c.py::new"] == (4, {"main": 4})
        change(1, {"c.py": "\n"})
        put(tmp_path, 2, [RESET, read("b.py"), read("c.py")], 20)
        query.processAllAvailable()
        assert got() == {"b.py::f": (4, {"main": 4}), "b.py::g": (4, {"main": 4})}
    finally:
        query.stop()


def test_a_call_touches_what_the_batch_plan_says(spark):
    """The fold's own matching against the joins."""
    symbols = scanned(spark, {"a.rs": SOURCES["a.rs"] + "mod m { fn x() {} struct Q { a: u8 } }\n"})
    rows = symbols.orderBy("ord").collect()
    asked = [(None, None, None), ("x", None, None), ("P/x", None, None), ("impl P", None, None), ("m/x", None, None), ("P", None, None), ("zz", None, None), (None, 2, 4), (None, 3, 3), ("Q", 1, 2), (None, 0, 99)]
    df = spark.createDataFrame([("a.rs", *t) for t in asked], "file_path string, target_symbol string, target_start long, target_end long")
    want = {}
    for r in O.touched(df, symbols).collect():
        want.setdefault((r.target_symbol, r.target_start, r.target_end), set()).add(r.ord)
    assert {t: {s.ord for s in live.touched(rows, *t)} for t in asked if live.touched(rows, *t)} == want


def test_entries_equal_a_sequential_fold():
    """The fold of one entry against agents kept one by one."""
    rng = random.Random(7)
    for _ in range(200):
        steps = [{"agent": rng.choice(["a", "b"]), "depth": rng.randrange(5), "hash": rng.choice("xy"), "tokens": rng.randrange(9)} if rng.random() < 0.8 else {"agent": None, "depth": None, "hash": rng.choice("xyz"), "tokens": None} for _ in range(8)]
        start = {"depth": 0, "content_hash": None, "agent_id": None, "estimated_tokens": 0, "agents": {}}
        cut = rng.randrange(9)
        got = live.fold_entry(live.fold_entry(start, steps[:cut]), steps[cut:])
        depths, depth, attributes = {}, 0, (None, None, 0)
        for s in steps:
            if s["agent"] is None:
                if depth and attributes[0] != s["hash"]:
                    depth, depths = 5, {a: 5 for a in depths}
                continue
            if s["depth"] > depths.setdefault(s["agent"], 0):
                depths[s["agent"]] = s["depth"]
            if 5 in depths.values() or max(depths.values()) > depth:
                depth, attributes = max(depths.values()), (s["hash"], s["agent"], s["tokens"])
        assert (got["depth"], got["agents"], (got["content_hash"], got["agent_id"], got["estimated_tokens"])) == (depth, depths, attributes)


def test_tail_reads_whole_lines_and_new_logs(tmp_path):
    main = tmp_path / f"{SID}.jsonl"
    main.write_text('{"type":"user","cwd":"/w","message":{"content":"Task one"}}\n{"half":')

    def between(reader, start, end):
        return sorted(row for part in reader.partitions(start, end) for row in reader.read(part))

    reader = tail._Reader(str(tmp_path), SID, "earliest", 1 << 20)
    first = reader.initialOffset()
    offset = reader.latestOffset()
    assert [r[1:2] + r[3:] for r in between(reader, first, offset)] == [(SID, 0, '{"type":"user","cwd":"/w","message":{"content":"Task one"}}', "Task one", "/w")]
    (tmp_path / SID / "subagents").mkdir(parents=True)
    (tmp_path / SID / "subagents" / "agent-x.jsonl").write_text('{"a":"é"}\n')
    with main.open("a") as f:
        f.write("1}\n\n")
    after = reader.latestOffset()
    rows = between(reader, offset, after)
    assert [(r[0], r[1], r[4]) for r in rows] == [(0, SID, '{"half":1}'), (0, SID, ""), (1, "agent-x", '{"a":"é"}')]
    assert between(reader, after, reader.latestOffset()) == []
    assert between(tail._Reader(str(tmp_path), SID, "earliest", 1 << 20), offset, after) == rows  # after a restart
    latest = tail._Reader(str(tmp_path), SID, "latest", 1 << 20)
    assert between(latest, latest.initialOffset(), latest.latestOffset()) == []
    whole = between(reader, first, after)
    for size in (1, 3, 8, 64):  # lines longer and shorter than a range
        small = tail._Reader(str(tmp_path), SID, "earliest", size)
        assert between(small, first, after) == whole
    long = tmp_path / "long"
    long.write_bytes(b"x" * 200_000 + b"\n" + b"y" * 300_000)
    assert tail.last_line_end(str(long), 0) == 200_001 and tail.last_line_end(str(long), 200_001) == 200_001


def test_watches(tmp_path):
    import os

    other = "11111111-2222-3333-4444-555555555555"
    (tmp_path / f"{SID}.jsonl").write_text("{}")
    watch = tail.SessionWatch(str(tmp_path))
    assert watch.session == SID and watch.switched() is None
    (tmp_path / f"{other}.jsonl").write_text("{}")
    os.utime(tmp_path / f"{other}.jsonl", (2e9, 2e9))
    assert watch.switched() == other and watch.switched() is None
    f = str(tmp_path / f"{SID}.jsonl")
    files = tail.FileWatch([f])
    assert files.changed([f]) == []
    (tmp_path / f"{SID}.jsonl").write_text("{}{}")
    assert files.changed([f, str(tmp_path / "gone")]) == [f] and files.changed([f]) == []


def test_stream_of_a_growing_session(spark, tmp_path):
    """A log that grows by halves of lines gives the ledger of the whole log."""
    logs = tmp_path / "logs"
    logs.mkdir()
    records = [tool("Read", file_path="/p/a.rs"), tool("Read", file_path="/p/b.py"), BOUNDARY, RESET, tool("Read", file_path="/p/b.py", offset=1, limit=1), tool("Read", "agent-1", file_path="/p/b.py")]
    text = "".join(json.dumps(r) + "\n" for r in records)
    main = logs / f"{SID}.jsonl"
    symbols = scanned(spark, SOURCES)
    live.write_sources(symbols, symbols, [SID], -1, f"file://{tmp_path}/sources")
    events = live.events_of(tail.read_stream(spark, str(logs), SID), "/p", SID)
    main.write_text("")
    query = live.start(live.live(events, live.source_stream(spark, f"file://{tmp_path}/sources")), f"file://{tmp_path}/query", interval="0 seconds")
    try:
        for a in range(0, len(text), 200):
            with main.open("a") as f:
                f.write(text[a : a + 200])
            query.processAllAvailable()
    finally:
        query.stop()
    whole = coverage.fold(symbols.select("file_path").distinct(), symbols, sessions.events(spark, [str(main)], "/p", SID))
    state = live.LiveState(spark, f"file://{tmp_path}/query")
    assert plain(state.ledger().collect()) == plain(whole.ledger.collect()) != {}
    assert [r.meta.pre_tokens for r in state.compactions().collect()] == [7]


def test_follow_switches_to_the_next_session(spark, tmp_path):
    import os
    import time

    from sightline.streaming.follow import follow

    other = "11111111-2222-3333-4444-555555555555"
    project, logs = tmp_path / "p", tmp_path / "logs"
    project.mkdir()
    logs.mkdir()
    for path, text in SOURCES.items():
        (project / path).write_text(text)
    first = json.dumps(tool("Read", file_path=f"{project}/b.py")) + "\n"
    (logs / f"{SID}.jsonl").write_text(first)
    os.utime(logs / f"{SID}.jsonl", (1e9, 1e9))
    seen, began = [], time.time()
    steps = [
        (lambda: (project / "b.py").write_text("def f(): return 2\ndef g(): pass\n"), {4: 2}),
        (lambda: (logs / f"{other}.jsonl").write_text(json.dumps(tool("Grep", pattern="q", path="a.rs")) + "\n"), {5: 1, 4: 1}),
    ]

    def show(panel, session, state):
        seen.append((session, panel["depths"]))
        if steps and session == SID and panel["depths"] == steps[0][1]:
            steps.pop(0)[0]()

    follow(spark, str(project), str(logs), f"file://{tmp_path}/state", show=show, interval="0 seconds", stop=lambda: (other, {2: 3}) in seen or time.time() - began > 150)
    assert (SID, {4: 2}) in seen and (SID, {4: 1, 5: 1}) in seen and (other, {2: 3}) in seen
