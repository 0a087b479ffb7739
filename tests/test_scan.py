"""Source trees as a data source, symbols as a table function, ordered files of lines."""

import os

import pytest
from pyspark.sql import functions as F

from sightline.sources import code, scan


def tree(top):
    for path, text in {"a.py": "x = 1\n", "src/m/b.rs": "fn f() {}\n", "src/c.py": "", "src/skip/d.py": "y = 2\n", "notes.txt": "n", ".hidden/e.py": "z = 3\n", "lib/é.ts": "const q = 1;\n", "libs/f.py": "w = 1\n"}.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(text)
    (top / ".ignore").write_text("skip/\n")
    (top / "src" / ".ignore").write_text("!c.py\n")


def test_a_tree_is_scanned_as_the_walk_finds_it(spark, tmp_path):
    tree(tmp_path)
    got = scan.read_tree(spark, str(tmp_path)).collect()
    assert sorted(r.file_path for r in got) == sorted(code.project_files(str(tmp_path))) == ["a.py", "lib/é.ts", "libs/f.py", "src/c.py", "src/m/b.rs"]
    assert {r.file_path: r.source for r in got}["src/c.py"] == ""
    assert scan.read_tree(spark, str(tmp_path / "lib")).count() == 1


def test_filters_reach_the_scan(spark, tmp_path):
    tree(tmp_path)
    found = scan.read_tree(spark, str(tmp_path))
    cases = [
        (F.startswith("file_path", F.lit("src/")), ["src/c.py", "src/m/b.rs"]), (F.endswith("file_path", F.lit(".py")), ["a.py", "libs/f.py", "src/c.py"]),
        (F.startswith("file_path", F.lit("lib")) & F.endswith("file_path", F.lit("y")), ["libs/f.py"]), (F.col("file_path") == "src/m/b.rs", ["src/m/b.rs"]), (F.col("file_path").isin("a.py", "none"), ["a.py"]),
        (F.col("source").contains("1") & F.startswith("file_path", F.lit("l")), ["lib/é.ts", "libs/f.py"]),
    ]
    for test, want in cases:
        assert sorted(r.file_path for r in found.where(test).collect()) == want
    plan = found.where(cases[0][0])._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]  # nothing is left to filter after the scan
    reader = scan._TreeReader(str(tmp_path))
    from pyspark.sql.datasource import StringStartsWith

    assert list(reader.pushFilters([StringStartsWith(("file_path",), "src/m"), StringStartsWith(("source",), "x")])) == [StringStartsWith(("source",), "x")]
    assert [p.path for p in reader.partitions()] == ["", "src"]


def test_symbols_by_a_table_function(spark):
    scan.register_functions(spark)
    texts = spark.createDataFrame([("a.rs", "struct P;\nfn f() {}\n"), ("b.py", None), (None, "x = 1"), ("c.txt", "x"), ("d.py", "def g(): pass\n")], "file_path string, source string")
    whole = spark.sql("SELECT c.* FROM {t} AS t, LATERAL code_symbols(t.file_path, t.source) AS c", t=texts)
    want = code.symbols(texts)
    assert whole.columns == want.columns and sorted(map(str, whole.collect())) == sorted(map(str, want.collect())) != []
    some = spark.sql("SELECT t.file_path AS f, c.* FROM {t} AS t, LATERAL code_symbols(t.file_path, t.source, 'name', 'line_end') AS c", t=texts)
    assert sorted(map(tuple, some.collect())) == [("a.rs", "P", 1), ("a.rs", "f", 2), ("d.py", "g", 1)]
    with pytest.raises(Exception, match="symbols have no"):
        spark.sql("SELECT * FROM code_symbols('a.rs', 'fn f() {}', 'colour')").collect()


def test_ordered_lines_are_written_whole_or_not_at_all(spark, tmp_path):
    rows = [(f"s{i % 7}", i, f"line {i} é") for i in range(500)]
    df = spark.createDataFrame(rows, "session string, at long, line string").repartition(5)
    scan.write_lines(df, "session", "line", ["at"], str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == [f"s{i}.log" for i in range(7)]
    for i in range(7):
        assert (tmp_path / f"s{i}.log").read_text().splitlines() == [x for s, _, x in rows if s == f"s{i}"]
    failing = df.withColumn("line", F.when(F.col("at") == 499, F.raise_error(F.lit("stop")).cast("string")).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="stop"):
        scan.write_lines(failing, "session", "line", ["at"], str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == [f"s{i}.log" for i in range(7)] and "new" not in (tmp_path / "s0.log").read_text()
    scan.write_lines(df.where("at < 3"), "session", "line", ["at"], str(tmp_path))
    assert (tmp_path / "s0.log").read_text() == "line 0 é\n" and len((tmp_path / "s5.log").read_text().splitlines()) == len([1 for r in rows if r[0] == "s5"])


def test_a_task_reports_its_files_in_a_list_beside_them(tmp_path):
    """A commit message is of one size, whatever the number of files that a task has written."""
    import pickle

    from pyspark.sql import Row

    (tmp_path / "d").mkdir()
    writer, sizes = scan._LineWriter(str(tmp_path), ".log"), []
    messages = []
    for n, start in ((1, 0), (300, 1)):
        messages.append(writer.write(iter([Row(name=f"d/s{i}", line=f"line {i}") for i in range(start, start + n)])))
        sizes.append(len(pickle.dumps(messages[-1])))
    assert sizes[0] == sizes[1] and os.listdir(tmp_path / "d") == []
    writer.commit([*messages, None])
    assert len(os.listdir(tmp_path / "d")) == 301 and os.listdir(tmp_path) == ["d"]
    assert (tmp_path / "d" / "s300.log").read_text() == "line 300\n"
