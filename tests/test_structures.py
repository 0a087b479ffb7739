"""Scans in chunks, dyadic ranges, suffixes, tree hashes and buffers against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sightline import operators as O
from sightline.operators import ranges, scans
from sightline.plans import coverage
from sightline.sources import sessions


@pytest.mark.parametrize("chunk", [1, 3, 50])
def test_scan_in_chunks_equals_a_fold(spark, chunk):
    rng = random.Random(chunk)
    rows = [(rng.choice("ab"), i, rng.random() < 0.3, rng.choice([None, None, i]), "kept") for i in range(90)]
    df = spark.createDataFrame(rows, "s string, i long, hit boolean, v long, epoch string").repartition(3)
    got = scans.chunk_scan(df, ["s"], {"run": F.floor(F.col("i") / chunk)}, ["i"], {"n": F.col("hit")}, {"last": F.col("v")})
    assert got.columns == ["s", "i", "hit", "v", "epoch", "n", "last"]
    state, want = {}, []
    for s, i, hit, v, x in rows:
        n, last = state.get(s, (0, None))
        want.append((s, i, hit, v, x, n, last))
        state[s] = (n + hit, v if v is not None else last)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert scans.chunk_scan(df.limit(0), ["s"], {"run": F.col("i")}, ["i"], {"n": F.col("hit")}).collect() == []


def test_boundaries_announce_across_chunks(spark, monkeypatch):
    """Epochs and metadata of two files, cut after every second line, against a fold."""
    monkeypatch.setattr(sessions, "CHUNK_LINES", 2)
    rng, rows, want = random.Random(5), [], {}
    for file in (0, 1):
        for line in range(60):
            rows.append(("s", file, 0, line, 0, rng.choice(["tool_call", "tool_call", "boundary", "compacted", "cleared"]), f"{file}-{line}"))
    df = spark.createDataFrame(rows, "session_id string, file_rank int, block long, line_no long, block_pos int, kind string, name string").withColumn("meta", F.when(F.col("kind") == "boundary", F.struct(F.col("name").alias("of"))))
    epoch, opened = 0, {}
    for _, file, _, line, _, kind, name in rows:
        want[name] = (epoch, opened.pop(file, None) if kind == "compacted" else None)
        if kind == "boundary":
            opened[file] = name
        epoch += kind in ("compacted", "cleared")
    got = {r.name: (r.epoch, r.meta.of if r.meta else None) for r in sessions.with_metadata(df).collect()}
    assert got == {n: v for n, v in want.items() if n in got} and len(got) == sum(r[5] != "boundary" for r in rows)


def test_dyadic_nodes_tile_a_range(spark):
    rng = random.Random(3)
    rows = [(a, a + rng.randrange(0, 70)) for a in (rng.randrange(0, 200) for _ in range(150))] + [(0, 64), (5, 5), (9, 3), (0, 1 << 12)]
    for r in spark.createDataFrame(rows, "a long, b long").select("a", "b", ranges.range_nodes(F.col("a"), F.col("b"), 5).alias("n")).collect():
        covered = sorted(x for n in r.n for x in range(n["index"] << n.level, (n["index"] + 1) << n.level))
        assert covered == list(range(r.a, r.b)), (r.a, r.b)
        assert len(r.n) <= 10 + (r.b - r.a) // 32


@pytest.mark.parametrize("levels", [3, 24])
def test_range_join_gives_each_pair_once(spark, levels):
    rng = random.Random(2)
    rows = [(rng.randrange(3), a, a + rng.choice([0, 1, 2, 30, 90])) for a in (rng.randrange(100) for _ in range(150))]
    left = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, k long, s long, e long")
    right = left.selectExpr("i as j", "k", "s as ts", "e as te")
    want = sorted((i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if a[0] == b[0] and a[1] < b[2] and b[1] < a[2])
    assert sorted((r.i, r.j) for r in ranges.range_join(left, right, ["k"], "s", "e", "ts", "te", levels).collect()) == want


def test_a_long_range_is_few_rows(spark):
    """Half a million symbols, one of them around all others, and a target: no row for each line."""
    symbols = spark.range(500_000).selectExpr("1 as k", "id * 10 as s", "if(id = 0, 5000000, id * 10 + 8) as t")
    assert symbols.where("s = 0").select(F.size(ranges.range_nodes(F.col("s"), F.col("t"))).alias("n")).first().n < 50
    target = spark.createDataFrame([(1, 4_000_001, 4_000_024)], "k int, a long, b long")
    got = ranges.range_join(target, symbols, ["k"], "a", "b", "s", "t").collect()
    assert sorted(r.s for r in got) == [0, 4_000_000, 4_000_010, 4_000_020]


def test_suffix_join_equals_the_test_of_every_pair(spark):
    paths = ["Foo", "impl Foo/pub fn bar", "a/b/c", "a//c", "c", "pub fn c", "x/impl Foo", "a/", ""]
    targets = [*paths, "b/c", "/c", "bar", "fn bar", "Foo/bar", "b", "fn b/c", "impl x/Foo"]
    names = [p.split("/")[-1] for p in paths]
    s = spark.createDataFrame([("f", i, p, n) for i, (p, n) in enumerate(zip(paths, names, strict=True))], "file_path string, ord int, path string, name string")
    t = spark.createDataFrame([("f", x) for x in targets] + [("g", "c")], "file_path string, target string").distinct()
    want = s.join(t, "file_path").where(O.name_matches(F.col("path"), F.col("name"), F.col("target"))).select("target", "ord")
    got = ranges.suffix_join(t, s, ["file_path"], "target", F.col("path"), F.col("name")).select("target", "ord")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_hashes_roll_up_in_one_pass(spark):
    """Random trees, against a recursion; the roots differ exactly where a symbol has changed."""
    rng, rows = random.Random(9), []
    for f in range(12):
        def grow(level, parent, rows_of):
            at = len(rows_of)
            rows_of.append([f"f{f}", at, at, parent, level, f"{f}-{at}", hashlib.sha256(f"{f}-{at}".encode()).hexdigest()])
            for _ in range(rng.randrange(4) if level < 4 else 0):
                grow(level + 1, at, rows_of)
            rows_of[at][2] = len(rows_of) - 1
        own = []
        for _ in range(rng.randrange(1, 4)):
            grow(0, None, own)
        rows += own
    df = spark.createDataFrame([tuple(r) for r in rows], "file_path string, ord int, subtree_end int, parent_ord int, level int, id string, content_hash string")
    by = {(r[0], r[1]): r for r in rows}

    def rolled(file, at):
        below = [r[1] for r in rows if r[0] == file and r[3] == at]
        own = by[file, at][6]
        return hashlib.sha256((own + "".join(rolled(file, b) for b in below)).encode()).hexdigest() if below else own

    old = O.roll_up_hashes(df)
    assert {(r.file_path, r.ord): r.merkle_hash for r in old.collect()} == {k: rolled(*k) for k in by}
    new = O.roll_up_hashes(df.withColumn("content_hash", F.when(F.col("id").isin("3-0", "5-1"), F.lit("changed")).otherwise(F.col("content_hash"))))
    a, b = O.root_hashes(old), O.root_hashes(new)
    changed = {i for i in ("3-0", "5-1") if any(r[5] == i for r in rows)}
    assert {r.id for r in O.merkle_stale(old, new, a, b, ["file_path", "id"]).collect()} == changed != set()
    differ = a.join(b.withColumnRenamed("root_hash", "now"), "file_path").where("root_hash <> now")
    assert {r.file_path for r in differ.collect()} == {f"f{i.split('-')[0]}" for i in changed}


def test_last_rows_are_chosen_before_the_shuffle(spark):
    rows = spark.range(5000).selectExpr("id % 3 as s", "id")
    buffer = O.ring_buffer(rows, ["s"], [F.col("id")], 20, 10)
    plan = buffer._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    held = {}
    for r in rows.orderBy("id").collect():
        held.setdefault(r.s, []).append(r.id)
        if len(held[r.s]) > 20:
            held[r.s] = held[r.s][10:]
    assert sorted((r.s, r.id) for r in buffer.collect()) == sorted((s, i) for s, ids in held.items() for i in ids)


def test_folders_sum_all_below_them(spark):
    rows = [("a/b/x.rs", 4, 2, 1), ("a/b/y.rs", 2, 2, 2), ("a/z.rs", 1, 0, 0), ("top.rs", 3, 3, 3)]
    got = coverage.folder_coverage(spark.createDataFrame(rows, "file_path string, total_symbols long, seen_count long, full_count long")).collect()
    assert {r.folder: (r.files, r.total_symbols, r.seen_count, r.full_count) for r in got} == {"": (4, 10, 7, 6), "a": (3, 7, 4, 3), "a/b": (2, 6, 4, 3)}


def test_multiplied_sides_are_never_broadcast(spark):
    """Rows multiply by nodes and suffixes, so small estimates of a side say nothing; levels that no range has are left out."""
    rows = [(1, i, i + i % 7) for i in range(40)]
    left = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, k long, s long, e long")
    right = left.selectExpr("i as j", "k", "s as ts", "e as te")
    assert ranges.levels_of(left, "s", "e") == 2 and ranges.levels_of(left.limit(0), "s", "e") == 1
    found = ranges.range_join(left, right, ["k"], "s", "e", "ts", "te", None)
    want = sorted((i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if a[1] < b[2] and b[1] < a[2])
    assert sorted((r.i, r.j) for r in found.collect()) == want
    symbols = spark.createDataFrame([("f", 0, "a/b", "b")], "file_path string, ord int, path string, name string")
    named = ranges.suffix_join(spark.createDataFrame([("f", "b")], "file_path string, target string"), symbols, ["file_path"], "target", F.col("path"), F.col("name"))
    for df in (found, named):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_files_of_a_task_are_rolled_up_in_one_pass(spark):
    """Three thousand files are one sorted stream, cut anywhere by batches, and totals join without a broadcast side."""
    from sightline.catalog_sessions import sources
    from sightline.sources import code

    s = spark.range(3000).selectExpr("concat('f', id) as file_path", "explode(array(0, 1, 2)) as ord", "id").selectExpr(
        "file_path", "ord", "if(ord = 1, 2, ord) as subtree_end", "if(ord = 2, 1, 0) as level", "sha2(concat(id, '-', ord), 256) as content_hash", "id + ord as estimated_tokens")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rolled = O.roll_up_hashes(s)
        totals = O.subtree_totals(rolled)
        plan = totals._jdf.queryExecution().executedPlan().toString()
        got = {(r.file_path, r.ord): (r.merkle_hash, r.total_symbols, r.total_tokens) for r in totals.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert "FlatMapGroupsInArrow" not in plan and "Broadcast" not in plan
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for i in range(3000):
        a, b, c = (sha(f"{i}-{k}") for k in range(3))
        want |= {(f"f{i}", 0): (a, 1, i), (f"f{i}", 1): (sha(b + c), 2, 2 * i + 3), (f"f{i}", 2): (c, 1, i + 2)}
    assert got == want
    assert sources(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert O.roll_up_hashes(code.symbols(sources(spark, "/root/testdata/sf0.001"))).columns.count("merkle_hash") == 1


def test_tree_lines_are_written_before_they_are_sorted(spark):
    """The bounds of the sort and the sort read stored lines; the texts are parsed once."""
    from sightline.plans import report
    from sightline.sources import code

    parsed = spark.sparkContext.accumulator(0)

    class Counting:
        EXTENSIONS = ("rs",)

        @staticmethod
        def extract(source):
            parsed.add(1)
            return []

    texts = spark.createDataFrame([(f"f{i}.rs", "x\n") for i in range(20)], "file_path string, source string").repartition(4)
    registry = code.Registry([Counting])
    lines = report.tree_lines(code.files(texts, registry), code.symbols(texts, registry)).collect()
    assert len(lines) == 20 and parsed.value == 20


def test_no_agent_is_broadcast(spark):
    rows = spark.range(300).selectExpr("id div 30 as session_id", "id as agent_id", "id as first_ord", "if(id % 30 = 0, null, if(id % 11 = 0, -1, id - 1)) as parent_id")
    walked = O.agents_in_order(rows)
    drawn = O.tree_prefixes(walked)
    assert drawn.count() == 300
    assert "Broadcast" not in drawn._jdf.queryExecution().executedPlan().toString()


def test_agents_marks_are_dealt_by_their_number(spark):
    """Equal calls are one before they meet symbols, and more calls are more tasks."""
    symbols = spark.createDataFrame([("f", i, i, f"f::s{i}", f"s{i}", i * 2 + 1, i * 2 + 2, "h", 1) for i in range(3)], "file_path string, ord int, subtree_end int, id string, name string, line_start long, line_end long, content_hash string, estimated_tokens long")
    rows = [("tool_call", f"u{i % 4}", f"a{i % 2}", "f" if i % 5 else None, i % 3 + 1, None, None, None) for i in range(120)] + [("cleared", "u0", "a0", None, None, None, None, None)]
    calls = O.distinct_calls(spark.createDataFrame(rows, "kind string, session_id string, agent_id string, file_path string, read_depth int, target_symbol string, target_start long, target_end long"))
    assert calls.count() == 8
    marked = O.agent_marks(calls, symbols, per_task=1)
    assert marked.rdd.getNumPartitions() == 9
    assert sorted(map(tuple, marked.collect())) == sorted((f"u{u}", f"a{u % 2}", f"f::s{s}", 3) for u in range(4) for s in range(3))
    depths = O.agent_depths(marked, ["session_id", "id"], "a1")
    assert {(r.session_id, r.depth) for r in depths.collect()} == {("u0", 0), ("u1", 3), ("u2", 0), ("u3", 3)}


def test_events_after_the_last_reset(spark):
    rows = [("u", i, i in (2, 5)) for i in range(9)] + [("v", i, False) for i in range(3)] + [(None, i, i == 1) for i in range(3)] + [("w", 0, True)]
    got = O.after_last(spark.createDataFrame(rows, "s string, i long, reset boolean"), F.col("reset"), ["s"], ["i"])
    assert sorted((str(r.s), r.i) for r in got.collect()) == [("None", 2), ("u", 6), ("u", 7), ("u", 8), ("v", 0), ("v", 1), ("v", 2)]
