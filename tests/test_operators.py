"""Coverage operators on small frames, and every registered query against its SQL."""

import duckdb
import pytest

from sightline import catalog, functions as X, operators as O

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted([tuple(round(float(v), 6) if isinstance(v, (int, float)) else str(v) for v in r) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    got = catalog.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert plain(got.select(*cols).collect()) == plain(want)


def test_entry_point(spark):
    import __spark_entry__ as E

    assert set(catalog.queries()) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_scalars(spark):
    from pyspark.sql import functions as F

    for text, n in (("fn foo() {}", 6), ("calculate_result", 4), ("x", 1), ("", 0), (" \n\t ", 0)):
        assert one(spark, X.estimate_tokens(F.lit(text))) == n
    assert one(spark, X.normalize_source(F.lit("  a \n\t b  "))) == "a b"
    assert one(spark, X.short_path(F.lit("/a/b/c.rs///"))) == "b/c.rs"
    assert one(spark, X.strip_keywords(F.lit("impl Foo/pub fn bar"))) == "Foo/bar"
    assert one(spark, X.under_root(F.lit("/p/src/a.rs"), F.lit("/p"))) == "src/a.rs" and one(spark, X.under_root(F.lit("./a"), F.lit("/p"))) == "./a"
    assert one(spark, X.remap(F.lit("/w/x/a"), F.lit("/w/x"), F.lit("/p"))) == "/p/a" and one(spark, X.remap(F.lit("/w/xy"), F.lit("/w/x"), F.lit("/p"))) == "/w/xy"
    assert one(spark, X.truncate_command(F.lit("é" * 150))) == "é" * 100 + "…" and one(spark, X.truncate_command(F.lit("a" * 200))) == "a" * 200
    assert one(spark, X.percent(F.lit(1), F.lit(0))) == 0 and one(spark, X.compact_number(F.lit(1234))) == "1.2k"
    with pytest.raises(ValueError):
        X.regex_filter(F.lit("a"), "(?=x)")


def test_every_document_is_cut_by_bytes(spark):
    def cut(text):
        if text is None or len(text.encode()) <= 200:
            return text
        at = kept = 0
        for c in text:  # characters that start within the limit
            if at >= 200:
                break
            at, kept = at + len(c.encode()), kept + 1
        return text[:kept] + "…"

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.cut for r in catalog.queries()["command_truncation"](spark, SF).collect()}
    assert got == {i: cut(t) for i, t in texts.items()} and any(t and not t.isascii() and len(t) > 200 for t in texts.values())


def test_numbers_round_by_their_binary_value(spark):
    from pyspark.sql import functions as F

    show = lambda n: f"{n / 1e6:.1f}M" if n >= 1_000_000 else f"{n / 1e3:.1f}k" if n >= 1000 else str(n)
    for r in spark.range(999, 1_100_000, 51).union(spark.range(1_050_000, 99_000_000, 50_000)).select("id", X.compact_number(F.col("id")).alias("x")).collect():
        assert r.x == show(r.id)
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 0.5, 1.5, 2.5, 12.5, 0.049999999999999996, 1e-17, 1e-300, 99.95, 99.949999999999, 1 / 3, -0.04, -0.05, -2.5, 123456.75, 5e-324, 0.95, 0.9500000000000001]
    cols = [X.fixed(F.col("v"), 0).alias("a"), X.fixed(F.col("v"), 1).alias("b"), X.fixed(F.col("v"), 1, signed=True).alias("c")]
    for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", *cols).collect():
        assert (r.a, r.b, r.c) == (f"{r.v:.0f}", f"{r.v:.1f}", f"{r.v:+.1f}"), r
    assert one(spark, X.percent_band(F.lit(20.5))) == "0-20" and one(spark, X.percent_band(F.lit(80.99))) == "51-80"
    assert one(spark, X.wrapped(F.lit("  a bb  " + "c" * 30 + " é"), 20)) == ["a bb", "c" * 30, "é"] and one(spark, X.wrapped(F.lit(" "), 40)) == [""]
    assert one(spark, X.first_bytes(F.lit("é" * 30), 47)) == "é" * 23 and one(spark, X.first_bytes(F.lit("a" * 30), 47)) == "a" * 30 and one(spark, X.under_root(F.lit("/p"), F.lit("/p"))) == ""
    assert one(spark, X.literal_filter(F.lit("/src//./parser/x.rs"), "src/parser/")) and not one(spark, X.literal_filter(F.lit("src/parser_extra.rs"), "src/parser"))


SYMBOLS = "file_path string, ord int, subtree_end int, id string, name string, name_path string, line_start long, line_end long, content_hash string, estimated_tokens long"
EVENTS = "session_id string, ord int, epoch long, agent_id string, file_path string, read_depth int, target_symbol string, target_start long, target_end long"


def test_marks(spark):
    syms = spark.createDataFrame([("f", 0, 2, "f::Foo", "Foo", "Foo", 1, 10, "h", 1), ("f", 1, 1, "f::Foo/a", "a", "Foo/a", 2, 4, "h", 1), ("f", 2, 2, "f::Foo/b", "b", "Foo/b", 5, 9, "h", 1), ("f", 3, 3, "f::c", "c", "c", 12, 20, "h", 1)], SYMBOLS)
    calls = [("s", 1, 0, "x", "f", 4, None, None, None), ("s", 2, 0, "x", "f", 4, "Foo", None, None), ("s", 3, 0, "x", "f", 4, "impl Foo/a", None, None), ("s", 4, 0, "x", "f", 4, None, 10, 13), ("s", 5, 0, "x", "g", 4, None, None, None), ("s", 6, 0, "x", None, 4, None, None, None)]
    got = {}
    for r in O.marks(spark.createDataFrame(calls, EVENTS), syms).collect():
        got.setdefault(r.event_ord, set()).add(r.id)
    assert got == {1: {"f::Foo", "f::Foo/a", "f::Foo/b", "f::c"}, 2: {"f::Foo", "f::Foo/a", "f::Foo/b"}, 3: {"f::Foo/a"}, 4: {"f::c"}}
    both = spark.createDataFrame([("s", 1, 0, "x", "f", 4, "a", 5, 6), ("s", 2, 0, "x", "f", 4, "Zed", 12, 13)], EVENTS)  # a name and lines: either will do
    assert sorted((r.event_ord, r.id) for r in O.marks(both, syms).collect()) == [(1, "f::Foo"), (1, "f::Foo/a"), (1, "f::Foo/b"), (2, "f::c")]


def test_report_counts_rows_and_keeps_empty_files(spark):
    files = spark.createDataFrame([("a/b",), ("a-b",), ("e",)], "file_path string")
    syms = spark.createDataFrame([("a/b", "x"), ("a/b", "x"), ("a-b", "y")], "file_path string, id string")
    depths = spark.createDataFrame([("x", 5)], "id string, depth int")  # stale counts as seen
    rows = O.report_order(O.coverage_report(files, syms, depths)).collect()
    assert [(r.file_path, r.total_symbols, r.seen_count, r.full_count) for r in rows] == [("a/b", 2, 2, 0), ("a-b", 1, 0, 0), ("e", 0, 0, 0)]
    assert O.report_totals(O.coverage_report(files, syms, depths)).first().seen_count == 2


def test_interval_join_gives_each_pair_once(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.randrange(3), a, a + rng.randrange(0, 25)) for a in (rng.randrange(100) for _ in range(120))]
    left = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, k long, s long, e long")
    right = left.selectExpr("i as j", "k", "s as ts", "e as te")
    want = sorted((i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if a[0] == b[0] and a[1] < b[2] and b[1] < a[2])
    for width in (1, 7, 1000):
        assert sorted((r.i, r.j) for r in O.interval_join(left, right, ["k"], "s", "e", "ts", "te", width).collect()) == want


def test_agent_views(spark):
    agents = spark.createDataFrame([("s", "main", 1), ("s", "agent-a", 2), ("s", "other", 3), ("s", "agent-b", 4), ("t", "agent-x", 1), ("t", "agent-y", 2)], "session_id string, agent_id string, first_ord long")
    tree = O.agent_tree(agents)
    assert {(r.session_id, r.agent_id): r.parent_id for r in tree.collect()} == {("s", "main"): None, ("s", "agent-a"): "main", ("s", "other"): None, ("s", "agent-b"): "main", ("t", "agent-x"): None, ("t", "agent-y"): "agent-x"}
    rows = O.tree_prefixes(O.agents_in_order(tree)).where("session_id = 's'").orderBy("path").collect()
    assert [(r.agent_id, r.indent, r.prefix) for r in rows] == [("main", 0, "├─ "), ("agent-a", 1, "│ ├─ "), ("agent-b", 1, "│ └─ "), ("other", 0, "└─ ")]
    assert {r.agent_id: r.children for r in O.agent_children(tree).collect()} == {"main": ["agent-a", "agent-b"], "agent-x": ["agent-y"]}
    deep = spark.createDataFrame([("s", "r", None, 1), ("s", "c", "r", 2), ("s", "d", "c", 3), ("s", "lost", "gone", 4), ("s", "below", "lost", 5)], "session_id string, agent_id string, parent_id string, first_ord long")
    assert [(r.agent_id, r.indent) for r in O.agents_in_order(deep).orderBy("path").collect()] == [("r", 0), ("c", 1), ("d", 2), ("lost", 0), ("below", 1)]
    drawn = {r.agent_id: r.prefix for r in O.tree_prefixes(O.agents_in_order(deep)).collect()}
    assert drawn == {"r": "├─ ", "c": "│ └─ ", "d": "│ │ └─ ", "lost": "└─ ", "below": "  └─ "}
    circle = spark.createDataFrame([("s", "a", "b", 1), ("s", "b", "a", 2), ("s", "r", None, 3)], deep.schema)
    assert [(r.agent_id, r.prefix) for r in O.tree_prefixes(O.agents_in_order(circle)).collect()] == [("r", "└─ ")]
    assert O.tree_prefixes(O.agents_in_order(deep.limit(0))).collect() == []
    chain = spark.createDataFrame([("s", str(i), str(i - 1) if i else None, i) for i in range(9)], deep.schema)
    assert sorted(r.indent for r in O.agents_in_order(chain).collect()) == list(range(9))
    with pytest.raises(Exception, match="(?i)recursion"):
        O.agents_in_order(chain, levels=4).collect()
    ledger = spark.createDataFrame([("a", "main", 4), ("b", "main", 0), ("a", "agent-a", 1)], "id string, agent_id string, depth int")
    assert {r.agent_id: (r.seen, r.seen_percent) for r in O.agent_coverage(agents.where("session_id = 's'"), ledger, 3).collect()} == {"main": (1, 33), "agent-a": (1, 33), "other": (0, 0), "agent-b": (0, 0)}
    entries = spark.createDataFrame([("a", 4), ("b", 0)], "id string, depth int")
    assert {r.depth: r.n for r in O.agent_histogram(ledger, entries, "id", "agent_id", "agent-a").collect()} == {1: 1, 0: 1}


def test_search_and_path_ranks(spark):
    rows = spark.createDataFrame([(0, "Alpha"), (1, "beta"), (2, "ALPHABET"), (3, None)], "pos int, name string")
    assert O.search(rows, "name", "pos", "alpha", 0).first().pos == 2 and O.search(rows, "name", "pos", "alpha", 2).first().pos == 0
    paths = ["a/b", "a-b", "a", "b/c", None, "a/b", "é/x", "a/b/c"]
    got = O.path_ranks(spark.createDataFrame(list(enumerate(paths)), "i int, p string"), "p", "i", sample=3).orderBy("pos").collect()
    assert [r.i for r in got] == [4, 2, 0, 5, 7, 1, 3, 6] and [r.pos for r in got] == list(range(1, 9))
