"""Session logs and tool mapping."""

import json

import pytest

from sightline.plans import toolmap as M
from sightline.sources import sessions as S


def call(name, **inputs):
    return {"type": "assistant", "sessionId": "s1", "timestamp": "t", "message": {"content": [{"type": "text"}, {"type": "tool_use", "name": name, "input": inputs}]}}


SID = "01234567-89ab-cdef-0123-456789abcdef"


def write(path, records, tail=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in records) + tail)


def test_events_of_a_session(spark, tmp_path):
    records = [
        call("Read", file_path="/p/src/a.rs", offset=10, limit=15), call("Bash", command="cat x"), call("Read", file_path=5), call("Odd"),
        call("mcp__serena__find_symbol", relative_path="b.rs", name_path_pattern="Foo/x", include_body=True), call("mcp__serena__find_symbol", relative_path="b.rs", name_path_pattern="F", include_body="true"),
        {"type": "system", "subtype": "compact_boundary", "compactMetadata": {"trigger": "manual", "preTokens": 9}},
        {"type": "user", "isCompactSummary": True, "timestamp": "t2", "message": {"content": "Sum " + S.CLEAR}},
        {"type": "user", "message": {"content": S.CLEAR}}, {"type": "user", "message": {"content": "hello"}}, {"type": "user", "isCompactSummary": True, "message": {"content": [1]}},
    ]
    write(tmp_path / f"{SID}.jsonl", records, '{"broken":\n')
    write(tmp_path / "agent-1.jsonl", [{**call("Grep", pattern="q", path="src"), "sessionId": SID, "agentId": "agent-1"}])
    write(tmp_path / "agent-2.jsonl", [{"x": 1}, {"sessionId": "other"}, {"sessionId": SID}])  # the first session named is another
    write(tmp_path / SID / "subagents" / "agent-3.jsonl", [{**call("Glob", pattern="*"), "agentId": None}])
    (tmp_path / "agent-acompact-1.jsonl").write_text("{}")
    (tmp_path / "11111111-2222-3333-4444-555555555555.jsonl").write_text("")
    assert S.latest_session(str(tmp_path)) == SID
    files = S.session_files(str(tmp_path), SID)
    assert [f.rsplit("/", 1)[1] for f in files] == ["agent-3.jsonl", "agent-1.jsonl", f"{SID}.jsonl"]
    rows = S.events(spark, files, "/p", SID).orderBy(*S.ORDER).collect()
    got = [(r.kind, r.agent_id, r.file_path, r.read_depth, r.description) for r in rows]
    assert got == [
        ("tool_call", "agent-3", None, 1, "Glob *"), ("tool_call", "agent-1", "src", 2, 'Search "q"'), ("tool_call", "s1", "src/a.rs", 4, "Read src/a.rs"), ("tool_call", "s1", None, 4, "Bash cat x"),
        ("tool_call", "s1", None, 0, "Read (untracked)"), ("tool_call", "s1", None, 0, "Odd (untracked)"), ("tool_call", "s1", "b.rs", 4, "Symbol Foo/x"), ("tool_call", "s1", "b.rs", 3, "Symbol F"),
        ("compacted", SID, None, None, None), ("cleared", SID, None, None, None), ("compacted", SID, None, None, None),
    ]
    assert (rows[2].target_start, rows[2].target_end, rows[6].target_symbol) == (10, 25, "Foo/x")
    assert rows[8].meta.pre_tokens == 9 and rows[8].meta.post_tokens == 0 and rows[8].summary == "Sum " + S.CLEAR and (rows[10].meta, rows[10].summary) == (None, "")


def test_each_boundary_belongs_to_the_next_summary_of_its_file(spark, tmp_path):
    b = lambda n: {"type": "system", "subtype": "compact_boundary", "compactMetadata": {"trigger": "t", "preTokens": n, "durationMs": -1}}
    s = {"type": "user", "isCompactSummary": True, "message": {"content": "x"}}
    write(tmp_path / "a.jsonl", [b(1), b(2), s, s, b(3), {"type": "system", "subtype": "compact_boundary", "compactMetadata": {"preTokens": 8}}, s, b(4)])
    write(tmp_path / "b.jsonl", [s])
    rows = S.events(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")], "/p", "s").orderBy(*S.ORDER).collect()
    assert [r.meta and (r.meta.pre_tokens, r.meta.duration_ms) for r in rows] == [(2, 0), None, (3, 0), None]


def test_labels_and_worktrees(spark, tmp_path):
    first = lambda text, cwd=None: {"type": "user", "cwd": cwd, "message": {"content": text}}
    write(tmp_path / "agent-a.jsonl", [first("Do this\nand that", "/work/tree"), call("Read", file_path="/work/tree/src/a.rs"), call("Read", file_path="/work/treetop/b.rs"), call("Read", file_path="/p/c.rs")])
    write(tmp_path / "agent-b.jsonl", [first("é" * 40, "/p"), call("Read", file_path="/p/d.rs")])
    write(tmp_path / "c.jsonl", [{**first([1]), "cwd": 5, "slug": 1}, {"slug": "a-slug"}, call("Read", file_path="./e.rs")])
    (tmp_path / "d.jsonl").write_text("\n" + json.dumps(call("Read", file_path="f.rs")))
    files = [str(tmp_path / f) for f in ("agent-a.jsonl", "agent-b.jsonl", "c.jsonl", "d.jsonl")]
    rows = S.events(spark, files, "/p", "s").orderBy(*S.ORDER).collect()
    assert [(r.label, r.file_path) for r in rows] == [("Do this", "src/a.rs"), ("Do this", "/work/treetop/b.rs"), ("Do this", "c.rs"), ("é" * 23 + "...", "d.rs"), ("c", "./e.rs"), ("d", "f.rs")]
    assert S.first_field(files[2], "slug") == "a-slug" and S.first_field(files[0], "cwd") == "/work/tree" and S.first_field(files[3], "cwd") is None
    assert S.events(spark, [], "/p", "s").count() == 0


def test_log_folder_of_a_project(tmp_path):
    project = tmp_path / "my.app"
    project.mkdir()
    assert S.log_dir(str(project), str(tmp_path)) is None and S.log_dir(str(tmp_path / "none"), str(tmp_path)) is None
    old, new = (tmp_path / ".claude" / "projects" / s for s in reversed(S.slugs(str(project))))
    old.mkdir(parents=True)
    assert S.log_dir(str(project), str(tmp_path)) == str(old) and old.name.endswith("-my.app")
    new.mkdir()
    assert S.log_dir(str(project), str(tmp_path)) == str(new) and new.name.endswith("-my-app")


def mapped(spark, stanzas, *calls):
    from pyspark.sql import functions as F

    from sightline.sources import records

    inputs = M.Fields()
    mapping = M.columns(F.col("tool_name"), inputs, stanzas)
    block = lambda n, x: {"type": "assistant", "message": {"content": [{"type": "tool_use", "name": n, "input": x}]}}
    rows = records.events(spark.createDataFrame([(i, json.dumps(block(n, x))) for i, (n, x) in enumerate(calls)], "i int, raw string"), inputs)
    return [r.m for r in rows.select("i", mapping.alias("m")).orderBy("i").collect()]


def test_every_builtin_stanza(spark):
    p, r = {"file_path": "/a/b/c.rs"}, {"relative_path": "x/y.py"}
    cases = [
        ("Read", p, "/a/b/c.rs", 4, "Read b/c.rs"), ("mcp__plugin_serena_serena__read_file", r, "x/y.py", 4, "Read ?"), ("Edit", p, "/a/b/c.rs", 4, "Edit b/c.rs"), ("mcp__acp__Write", p, "/a/b/c.rs", 4, "Write b/c.rs"),
        ("Glob", {"pattern": "*.x", "path": "q"}, "q", 1, "Glob *.x"), ("mcp__serena__find_file", {"file_mask": "m"}, None, 1, "Glob m"), ("mcp__serena__list_dir", r, "x/y.py", 1, "Glob x/y.py"), ("Grep", {"pattern": "a|b"}, None, 2, 'Search "a|b"'),
        ("mcp__serena__search_for_pattern", {"substring_pattern": "s"}, None, 2, 'Search "s"'), ("mcp__serena__get_symbols_overview", r, "x/y.py", 2, "Overview x/y.py"),
        ("mcp__serena__find_symbol", {**r, "name_path_pattern": "A/b", "include_body": False}, "x/y.py", 3, "Symbol A/b"), ("mcp__serena__find_symbol", {"name_path_pattern": "A"}, None, 0, "mcp__serena__find_symbol (untracked)"),
        ("mcp__serena__find_referencing_symbols", {**r, "name_path": "N"}, "x/y.py", 2, "FindRefs N"), ("mcp__serena__replace_symbol_body", {**r, "name_path": "N"}, "x/y.py", 4, "ReplaceSymbol N"),
        ("mcp__serena__insert_after_symbol", {**r, "name_path": "N"}, "x/y.py", 4, "InsertAfter N"), ("mcp__plugin_serena_serena__insert_before_symbol", {**r, "name_path": "N"}, "x/y.py", 4, "InsertBefore N"), ("mcp__serena__rename_symbol", {**r, "name_path": "N"}, "x/y.py", 4, "Rename N"),
        ("NotebookEdit", {"notebook_path": "/n/a.ipynb"}, "/n/a.ipynb", 4, "NotebookEdit n/a.ipynb"), ("TodoWrite", {"todos": [{"content": "do it"}]}, None, 1, "TodoWrite do it"), ("TodoWrite", {"todos": []}, None, 1, "TodoWrite ?"),
        ("Agent", {"description": "d"}, None, 0, "Agent: d"), ("ToolSearch", {"query": "q"}, None, 0, "ToolSearch q"), ("Skill", {"skill": "s"}, None, 1, "Skill s"), ("SendMessage", {"to": "t"}, None, 0, "SendMessage t"), ("TaskList", {}, None, 0, "TaskList"),
        ("AskUserQuestion", {"question": "q"}, None, 0, "AskUserQuestion"), ("WebFetch", {"url": "u"}, None, 0, "Web u"), ("WebSearch", {"query": "w"}, None, 0, "Web w"), ("Nothing", {"file_path": "x"}, None, 0, "Nothing (untracked)"),
        ("Bash", {"command": "x" * 300}, None, 1, "Bash " + "x" * 200 + "…"), ("Bash", {"description": "only"}, None, 1, "Bash only"), ("Bash", {}, None, 1, "Bash ?"),
    ]
    depth = {"cat": 4, "bat": 4, "less": 4, "more": 4, "head": 3, "tail": 3, "grep": 2, "rg": 2, "awk": 2, "sed": 2, "ugrep": 2, "bfs": 1, "git": 0, "ls": 1}
    cases += [("Bash", {"command": f"{c} f"}, None, d, f"Bash {c} f") for c, d in depth.items()]
    got = mapped(spark, list(M.DEFAULTS), *((n, x) for n, x, *_ in cases))
    assert [(m.file_path, m.read_depth, m.description) for m in got] == [c[2:] for c in cases] and len(M.DEFAULTS) == 22


def test_line_targets_are_whole_numbers(spark):
    line = lambda a, b: ("Read", {"file_path": "f", "offset": a, "limit": b})
    got = mapped(spark, list(M.DEFAULTS), line(10, 15), line(0, 0), line(-1, 5), line(1.5, 5), line("1", 5), line(2**32 + 3, 4), line(2**63 + 7, 2**64 - 1), line(None, 1), ("Read", {"file_path": "f", "offset": 1}))
    assert [(m.target_start, m.target_end) for m in got] == [(10, 25), (0, 0), (None, None), (None, None), (None, None), (3, 7), (7, 6), (None, None), (None, None)]


def stanza(names, **more):
    lines = [f"{k} = {json.dumps(v)}" for k, v in {"path_keys": [], "description": "D", **more}.items() if not isinstance(v, dict)]
    tables = [f"{k} = {{ " + ", ".join(f"{a} = {json.dumps(b)}" for a, b in v.items()) + " }" for k, v in more.items() if isinstance(v, dict)]
    return "\n".join(["[[tool]]", f"names = {json.dumps(names)}", *lines, *tables, ""])


FULL = {"type": "fixed", "value": "FullBody"}


def test_mapping_merge(spark):
    merge = lambda *t: M.merge(M.DEFAULTS, M.parse("version = 1\n" + "".join(t)))
    merged, warnings = merge(stanza(["Read", "Mine"], extends="Read", description="R"), stanza(["Mine"], path_keys=["p"], description="M {p|short}", depth=FULL, path_required=False))
    first = next(s for s in merged if "Read" in s.names)
    assert first.path_keys == ("file_path", "relative_path") and first.line_keys == ("offset", "limit") and first.description == "R" and first.depth == FULL
    assert [w.kind for w in warnings] == ["duplicate"] and not any("mcp__acp__Read" in s.names for s in merged)
    got = mapped(spark, merged, ("Mine", {"p": "a/b/c", "file_path": "z"}), ("Read", {"file_path": "z"}))  # both stanzas list the name, the later one has it
    assert [(m.file_path, m.description) for m in got] == [("a/b/c", "M b/c"), ("z", "R")]
    merged, warnings = merge(stanza(["Read"]), stanza([], depth=FULL), stanza(["X"], extends="Unknown"), stanza(["Y"], extends="Unknown", depth=FULL))
    assert [w.kind for w in warnings] == ["missing_depth", "empty_names", "missing_depth"] and {s.names for s in merged} == {s.names for s in M.DEFAULTS} | {("Y",)}


def test_templates_and_patterns(spark):
    spec = {"type": "pattern_match", "key": "command", "default": "NameOnly"}
    text = "version = 1\n" + stanza(["T"], path_required=False, description="{a} {a|short} {9} {} {b|x} {a|short|cmd} {open {a} {", depth=FULL) + stanza(["P"], path_required=False, pattern_keys=["x.y"])
    text += 'depth = { type = "pattern_match", key = "command", default = "NameOnly", patterns = [ { prefix = "a", match_type = "exact", depth = "Unseen" }, { prefix = "b", match_type = "contains", depth = "FullBody" }, { prefix = "c", depth = "Overview" } ] }\n'
    stanzas = M.parse(text)
    got = mapped(spark, stanzas, ("T", {"a": "x/y/z"}), *(("P", {"command": c}) for c in ("a", "ab", "ca", "z")), ("P", {"command": 5, "x.y": "k"}))
    assert got[0].description == "x/y/z y/z {9} {} {b|x} {a|short|cmd} {open x/y/z {" and [m.read_depth for m in got[1:]] == [0, 4, 2, 1, 1] and spec["key"] == "command"


def test_mapping_files(tmp_path):
    good, bad = tmp_path / "good.toml", tmp_path / "bad.toml"
    good.write_text("version = 1\n" + stanza(["Mine"], depth=FULL))
    for text in ("version = 1\n[[tool", "[[tool]]", "version = 1\n[[tool]]\nnames = ['x']", "version = 1\n" + stanza(["x"], depth={"type": "fixed", "value": "Most"}), "version = 1\n" + stanza(["x"], depth={"type": "odd"})):
        bad.write_text(text)
        assert M.load(str(bad))[0] is None and M.load(str(bad))[1][0].kind == "parse"
    bad.write_text("version = 2")
    assert M.load(str(bad))[1][0].kind == "version" and M.load(str(tmp_path / "none"))[1][0].kind == "parse"
    home, cwd = tmp_path / "home", tmp_path / "cwd"
    none = M.resolve(str(tmp_path / "none"), str(cwd), str(home))
    assert none == (list(M.DEFAULTS), [])
    (home / M.USER_CONFIG).parent.mkdir(parents=True)
    (home / M.USER_CONFIG).write_text(bad.read_text())
    assert [w.kind for w in M.resolve(None, str(cwd), str(home))[1]] == ["version"]
    (cwd / M.LOCAL_CONFIG).parent.mkdir(parents=True)
    (cwd / M.LOCAL_CONFIG).write_text(good.read_text())
    assert len(M.resolve(None, str(cwd), str(home))[0]) == 23 and len(M.resolve(str(bad), str(cwd), str(home))[0]) == 22
    assert M.find_config(str(tmp_path / "none"), str(cwd), str(home)) == str(cwd / M.LOCAL_CONFIG)


def test_path_filters(tmp_path):
    from sightline.plans.filters import PathFilter

    (tmp_path / "src" / "parser").mkdir(parents=True)
    f = PathFilter.choose("/src//parser/", None)
    f.validate(str(tmp_path))
    assert f.matches("src/parser/rust.rs") and not f.matches("src/parser_extra.rs") and not f.matches("src") and f.display() == "src/parser" and PathFilter.literal("/").matches("x")
    assert PathFilter.regex(r"^src/.*\.rs$").matches("src\\a.rs") and PathFilter.regex("x").display() == "re:x" and PathFilter.choose(None, None) is None
    PathFilter.regex("nothing").validate(str(tmp_path))
    for bad in (lambda: PathFilter.choose("a", "b"), lambda: PathFilter.regex("("), lambda: PathFilter.regex("(?=a)"), lambda: PathFilter.literal("none").validate(str(tmp_path))):
        with pytest.raises(ValueError):
            bad()
