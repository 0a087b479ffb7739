"""Reports of a session from end to end, and symbols from caches."""

import json
import pickle

import pytest

from sightline.plans import coverage, report
from sightline.plans.filters import PathFilter
from sightline.sources import code, lspcache, sessions

SID = "01234567-89ab-cdef-0123-456789abcdef"


def read(path, agent=None, **more):
    record = {"type": "assistant", "sessionId": "main", "timestamp": "t", "message": {"content": [{"type": "tool_use", "name": "Read", "input": {"file_path": path, **more}}]}}
    return record | ({"agentId": agent} if agent else {})


def find(path, name, body):
    return {"type": "assistant", "sessionId": "main", "timestamp": "t", "message": {"content": [{"type": "tool_use", "name": "mcp__serena__find_symbol", "input": {"relative_path": path, "name_path_pattern": name, "include_body": body}}]}}


@pytest.fixture
def project(tmp_path):
    root, logs = tmp_path / "p", tmp_path / "logs"
    for path, text in {"src/a.rs": "struct P;\nimpl P {\n    fn x() {}\n    fn y() {}\n}\n", "src/b.py": "def f(): pass\ndef g(): pass\n", "src-c.ts": "function h() {}\n", "src/none.py": "x = 1\n"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    logs.mkdir()

    def log(*records, name=SID):
        (logs / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records))
        return report_of

    def report_of(spark, **more):
        return report.run(spark, str(root), str(logs), formatter=report.JsonFormatter(), **more)

    return root, logs, log


def rows(text):
    return {f["path"]: (f["total_symbols"], f["seen_count"], f["full_count"]) for f in json.loads(text)["files"]}


def test_a_read_covers_its_file(spark, project):
    root, logs, log = project
    out = json.loads(log(read(f"{root}/src/b.py"), read("/elsewhere/src/a.rs"))(spark))
    assert list(out) == ["schema_version", "session_id", "agent_id", "totals", "files", "compactions"] and out["schema_version"] == 2 and out["session_id"] == SID and out["agent_id"] is None
    assert [f["path"] for f in out["files"]] == ["src/a.rs", "src/none.py", "src-c.ts", "src/b.py"] and out["totals"] == {"symbols": 7, "seen": 2, "full": 2, "seen_percent": 2 / 7 * 100, "full_percent": 2 / 7 * 100}


def test_targets_and_depths(spark, project):
    root, _, log = project
    report_of = log(find("src/a.rs", "P/x", False), find("src/b.py", "f", True), find("src/b.py", "f", False), read(f"{root}/src/b.py", offset=1, limit=2))
    assert rows(report_of(spark)) == {"src/a.rs": (4, 1, 0), "src/b.py": (2, 2, 2), "src/none.py": (0, 0, 0), "src-c.ts": (1, 0, 0)}  # of the lines 1 to 2, a symbol of one line meets them only inside


def test_compactions_and_clears_empty_the_ledger(spark, project):
    root, _, log = project
    boundary = {"type": "system", "subtype": "compact_boundary", "compactMetadata": {"trigger": "auto", "preTokens": 1000, "postTokens": 250, "durationMs": 1550}}
    summary = {"type": "user", "isCompactSummary": True, "timestamp": "T", "message": {"content": "What was done. " + "word " * 30}}
    report_of = log(read(f"{root}/src/b.py"), read("/out/x.py"), boundary, summary, read(f"{root}/src-c.ts"))
    out = json.loads(report_of(spark))
    assert rows(report_of(spark))["src/b.py"] == (2, 0, 0) and rows(report_of(spark))["src-c.ts"] == (1, 1, 1)
    (c,) = out["compactions"]
    assert c["state_before"] == {"tool_calls": 2, "files_accessed": ["/out/x.py", "src/b.py"], "symbols_seen": 2, "seen_percent": 2 / 7 * 100} and c["metadata"] == {"trigger": "auto", "pre_tokens": 1000, "post_tokens": 250, "duration_ms": 1550}
    text = report.run(spark, str(root), str(project[1]))
    assert "Context Compactions (1)\n" + "─" * 63 + "\n#1  T  2 calls · 28.6% seen\n    Tokens: 1000 → 250 (-75.0%) · trigger: auto · 1.6s\n    Files (2):\n      /out/x.py\n      src/b.py\n    Summary: What was done. word" in text
    assert all(len(x.encode()) <= 85 for x in text.splitlines() if "word" in x)
    clear = {"type": "user", "message": {"content": sessions.CLEAR}}
    out = json.loads(log(read(f"{root}/src/b.py"), summary, clear, summary, read(f"{root}/src/a.rs"))(spark))
    assert [(x["sequence"], x["state_before"]["tool_calls"]) for x in out["compactions"]] == [(1, 0)] and "metadata" not in out["compactions"][0]


def test_agents_filters_and_empty_sessions(spark, project, caplog):
    root, logs, log = project
    log(read(f"{root}/src/b.py"))
    (logs / SID / "subagents").mkdir(parents=True)
    (logs / SID / "subagents" / "agent-one.jsonl").write_text(json.dumps(read(f"{root}/src-c.ts", agent="agent-one")))
    (logs / SID / "subagents" / "agent-other.jsonl").write_text(json.dumps(read(f"{root}/src/a.rs", agent="agent-other")))
    run = lambda **more: report.run(spark, str(root), str(logs), formatter=report.JsonFormatter(), **more)
    seen = lambda text: {p for p, (_, s, _) in rows(text).items() if s}
    assert seen(run()) == {"src/b.py", "src-c.ts", "src/a.rs"} and seen(run(agent="main")) == {"src/b.py"}
    out = run(agent="agent-o")
    assert json.loads(out)["agent_id"] == "agent-one" and seen(out) == {"src-c.ts"} and "2 agents match prefix" in caplog.text
    assert json.loads(run(agent="zzz"))["agent_id"] == "zzz" and seen(run(agent="zzz")) == set()
    out = json.loads(run(path_filter=PathFilter.literal("src")))
    assert out["filter"] == "src" and {f["path"] for f in out["files"]} == {"src/a.rs", "src/b.py", "src/none.py"}
    with pytest.raises(ValueError):
        run(path_filter=PathFilter.literal("missing"))
    text = report.run(spark, str(root), str(root / "src"), agent=None, path_filter=PathFilter.regex("py$"))
    assert text.startswith("Coverage Report (session: none)\nFilter: re:py$\n" + "─" * 85 + "\nFile" + " " * 38 + "Symbols    Seen    Full   Seen%   Full%\n")
    assert text.splitlines()[-1] == "TOTAL" + " " * 35 + f" {2:>8} {0:>7} {0:>7} {0:>6}% {0:>6}%"


def test_half_percents_and_wide_paths():
    f = lambda p, t, s: {"file_path": p, "total_symbols": t, "seen_count": s, "full_count": s, "seen_percent": s / t * 100, "full_percent": s / t * 100}
    lines = report.TextFormatter().format(report.Report([f("a", 8, 1), f("é" * 25, 200, 125)], session_id="s", agent_id="x")).splitlines()
    assert lines[0] == "Coverage Report (session: s, agent: x)" and lines[1] == "─" * 95 and lines[4].endswith("    12%     12%") and lines[5].endswith("    62%     62%") and len(lines[5]) == 50 + 41
    assert report.summary_lines("") == ["    Summary: "] and report.summary_lines("x" * 90) == ["    Summary: " + "x" * 90]


def test_dump_and_event_log(spark, project, tmp_path):
    root, logs, log = project
    log(read(f"{root}/src/b.py", offset=1, limit=2), find("src/a.rs", "P", True), {"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "Odd"}]}})
    files, symbols = code.scan(spark, str(root))
    text = report.dump("/p", files, symbols, PathFilter.literal("src"))
    assert text.startswith("Project: /p (4 files, 7 symbols)\nFilter: src\n\n  src/a.rs (5 lines)\n    struct P [L1-1] (~4 tokens)\n    impl P [L2-5] (~16 tokens)\n      fn x [L3-3] (~6 tokens)\n") and text.endswith("  src-c.ts (1 lines)\n    function h [L1-1] (~7 tokens)\n")
    report.run(spark, str(root), str(logs), event_log_dir=str(tmp_path / "events"))
    got = (tmp_path / "events" / f"{SID}.log").read_text().splitlines()  # one file a session
    assert got == [
        f'[t] agent=main tool=Read depth=FullBody path={root}/src/b.py target=L1-3 desc="Read src/b.py"', '[t] agent=main tool=mcp__serena__find_symbol depth=FullBody path=src/a.rs target=P desc="Symbol P"',
        f'[] agent={SID} tool=Odd depth=Unseen path=- target=- desc="Odd (untracked)"',
    ]
    assert {r.module: (r.seen_percent, r.enough) for r in coverage.module_coverage(coverage.report(coverage.fold(files, symbols, sessions.events(spark, sessions.session_files(str(logs), SID), str(root), SID)))).collect()}[""] == (0.0, False)


class Documents:
    """A class that a cache's pickle names."""

    def __init__(self, roots):
        self.root_symbols = roots


class Evil:
    def __reduce__(self):
        import os

        return os.system, ("touch /tmp/never-run",)


def symbol(name, first, last, kind=12, children=()):
    return {"name": name, "kind": kind, "range": {"start": {"line": first, "character": 2}, "end": {"line": last, "character": 3}}, "children": list(children)}


def test_language_server_caches(spark, tmp_path):
    cache = tmp_path / ".serena" / "cache"
    (cache / "rust").mkdir(parents=True)
    (cache / "python").mkdir()
    raw = {"__cache_version": (1, 1), "obj": {"src/a.rs": ("h", [symbol("A", 0, 9, 23, [symbol("m", 2, 3, 6), {"kind": 6}]), {"name": 5}, {"name": "bare"}]), "short": ("h",)}}
    (cache / "rust" / "raw_document_symbols.pkl").write_bytes(pickle.dumps(raw))
    (cache / "rust" / "document_symbols.pkl").write_bytes(b"never read")
    (cache / "python" / "document_symbols.pkl").write_bytes(pickle.dumps({"obj": {"b.py": ("h", Documents([symbol("f", 4, 4, 99)])), "c.py": ("h", [symbol("g", 0, 1)])}}))
    files, symbols = lspcache.scan(spark, str(tmp_path))
    assert {r.file_path: r.total_lines for r in files.collect()} == {"src/a.rs": 10, "b.py": 5, "c.py": 2}
    got = {r.id: (r.category, r.label, r.byte_start, r.byte_end, r.line_start, r.line_end, r.estimated_tokens, r.level) for r in symbols.collect()}
    assert got == {
        "src/a.rs::A": ("type", "struct", 2, 363, 1, 10, 150, 0), "src/a.rs::A/m": ("function", "method", 82, 123, 3, 4, 30, 1), "src/a.rs::bare": ("function", "function", 0, 0, 1, 1, 15, 0),
        "b.py::f": ("unknown", "unknown", 162, 163, 5, 5, 15, 0), "c.py::g": ("function", "function", 2, 43, 1, 2, 30, 0),
    }
    assert lspcache.scan(spark, str(tmp_path), lambda p: p.endswith(".py"))[0].count() == 2
    assert lspcache.load(pickle.dumps({"obj": Evil()})) == {"obj": {}} and not (tmp_path.parents[-1] / "tmp" / "never-run").exists()
    (cache / "python" / "document_symbols.pkl").write_bytes(pickle.dumps({"no": 1}))
    with pytest.raises(Exception, match="obj"):
        lspcache.scan(spark, str(tmp_path))[1].collect()
    with pytest.raises(FileNotFoundError):
        lspcache.scan(spark, str(tmp_path / "none"))


def test_command_line(spark, project, capsys, tmp_path):
    from sightline.__main__ import arguments, main

    root, logs, log = project
    log(read(f"{root}/src/b.py"))
    main(["--project", str(root), "--log-dir", str(logs), "--coverage", "--format", "json", "--filter", "/src/"], spark)
    out = json.loads(capsys.readouterr().out)
    assert out["filter"] == "src" and out["totals"]["seen"] == 2
    main(["-p", str(root), "--dump", "--filter-regex", "py$"], spark)
    assert capsys.readouterr().out.startswith(f"Project: {root} (2 files, 2 symbols)\nFilter: re:py$\n\n  src/b.py (2 lines)\n    def f [L1-1]")
    for bad in (["--coverage"], ["-p", "x"], ["-p", "x", "--dump", "--coverage"], ["-p", "x", "--dump", "--filter", "a", "--filter-regex", "b"]):
        with pytest.raises(SystemExit):
            arguments(bad)
