"""Registered queries on scans, range and suffix joins, tree hashes and folders, on tables that grow with the data."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import operators as O
from .catalog import query, table
from .catalog_sessions import _LOG, _SOURCES, log_events, log_lines, project, sources
from .operators import ranges, scans
from .plans import coverage
from .sources import code, scan, sessions
from .tables import kept, shared_folder

# --- scans ----------------------------------------------------------------------------------------------


@query("""SELECT event_id, coalesce(sum((event_type = 'error')::INT) OVER w, 0)::BIGINT AS epoch, last_value(CASE WHEN event_type = 'purchase' THEN user_id END IGNORE NULLS) OVER w AS last_buyer
 FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def scan_one_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one session: the resets before each, and who bought last before it, without a task for all of them."""
    e = table(spark, sf_dir, "events").select(F.lit("all").alias("session"), "event_id", "event_type", "user_id")
    kinds = F.col("event_type")
    out = scans.chunk_scan(e, ["session"], {"run": F.floor(F.col("event_id") / 1000)}, ["event_id"], {"epoch": kinds == "error"}, {"last_buyer": F.when(kinds == "purchase", F.col("user_id"))})
    return out.select("event_id", "epoch", "last_buyer")


_WHOLE = _LOG + """, resets AS (SELECT coalesce(max(event_id) FILTER (kind <> 'boundary'), -1) AS upto FROM others)
"""


@query(_WHOLE + """SELECT id, max(d)::INT AS depth, arg_min(agent, row(-d, event_id)) AS agent_id FROM marks, resets WHERE event_id > upto GROUP BY id""")
def session_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all events, as one session, have read since its last reset; its epochs come from a scan in chunks."""
    c = coverage.fold(*project(spark), sessions.with_metadata(log_events(spark, sf_dir, one_session=True)))
    return c.ledger.select("id", "depth", "agent_id")


# --- ranges and names -----------------------------------------------------------------------------------


@query("""WITH r AS (SELECT o_custkey % 40 AS file, o_orderkey AS s, o_orderkey + floor(o_totalprice / 500)::BIGINT AS t FROM orders),
q AS (SELECT user_id % 40 AS file, event_id * 5 AS a, event_id * 5 + CAST(json_extract(props, '$.k') AS BIGINT) AS b FROM events)
SELECT file, count(*) AS pairs, sum(s)::BIGINT AS starts, sum(a)::BIGINT AS asked FROM r JOIN q USING (file) WHERE s < b AND a < t GROUP BY file""")
def dyadic_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as symbols of up to a thousand lines, events as line targets; some targets are empty ranges."""
    symbols = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("file"), F.col("o_orderkey").alias("s"), (F.col("o_orderkey") + F.floor(F.col("o_totalprice") / 500)).cast("long").alias("t"))
    k = F.get_json_object("props", "$.k").cast("long")
    asked = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("file"), (F.col("event_id") * 5).alias("a"), (F.col("event_id") * 5 + k).alias("b"))
    return ranges.range_join(asked, symbols, ["file"], "a", "b", "s", "t", levels=None).groupBy("file").agg(F.count("*").alias("pairs"), F.sum("s").alias("starts"), F.sum("a").alias("asked"))


_NAMES = """WITH s AS (SELECT p_size AS file, p_partkey AS ord, replace(p_name, ' ', '/') || '/' || p_brand AS path, 'pub fn ' || p_brand AS name FROM part),
t AS (SELECT DISTINCT p_size AS file, unnest([p_brand, split_part(p_name, ' ', -1) || '/' || p_brand, 'fn ' || p_brand, p_name, 'x' || p_brand, 'mod ' || split_part(p_name, ' ', -1) || '/' || p_brand]) AS target FROM part WHERE p_partkey % 3 = 0),
b AS (SELECT *, array_to_string(list_transform(string_split(path, '/'), lambda x: regexp_replace(x, '^([a-z]+ )+', '')), '/') AS bare_path, regexp_replace(name, '^([a-z]+ )+', '') AS bare_name FROM s),
u AS (SELECT *, array_to_string(list_transform(string_split(target, '/'), lambda x: regexp_replace(x, '^([a-z]+ )+', '')), '/') AS bare FROM t)
SELECT file, target, count(*) AS named, sum(ord)::BIGINT AS ords FROM u JOIN b USING (file) WHERE path = target OR ends_with(path, '/' || target) OR name = target OR bare_path = bare OR ends_with(bare_path, '/' || bare) OR bare_name = bare
GROUP BY file, target"""


@query(_NAMES)
def suffix_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols below the words of their names; targets are last parts of such paths, with and without keywords."""
    p = table(spark, sf_dir, "part")
    last = F.substring_index("p_name", " ", -1)
    pair = F.concat(last, F.lit("/"), F.col("p_brand"))
    asked = p.where(F.col("p_partkey") % 3 == 0).select(F.col("p_size").alias("file"), F.explode(F.array(F.col("p_brand"), pair, F.concat(F.lit("fn "), F.col("p_brand")), F.col("p_name"), F.concat(F.lit("x"), F.col("p_brand")), F.concat(F.lit("mod "), pair))).alias("target")).distinct()
    symbols = p.select(F.col("p_size").alias("file"), F.col("p_partkey").alias("ord"), F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/"), F.col("p_brand")).alias("path"), F.concat(F.lit("pub fn "), F.col("p_brand")).alias("name"))
    found = ranges.suffix_join(asked, symbols, ["file"], "target", F.col("path"), F.col("name"))
    return found.groupBy("file", "target").agg(F.count("*").alias("named"), F.sum("ord").alias("ords"))


# --- trees and folders ----------------------------------------------------------------------------------


@query(_SOURCES + "SELECT path || '::' || np AS id FROM y WHERE regexp_extract(path, 'p/([0-9]+)', 1)::BIGINT % 7 = 0 AND ord = 0")
def merkle_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first symbol of every seventh source file has changed; only files whose root hashes differ are compared."""
    old = kept(O.roll_up_hashes(code.symbols(sources(spark, sf_dir))), "rolled")
    changed = (F.regexp_extract("file_path", "p/([0-9]+)", 1).cast("long") % 7 == 0) & (F.col("ord") == 0)
    new = kept(O.roll_up_hashes(old.withColumn("content_hash", F.when(changed, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")))), "rolled")
    return O.merkle_stale(old, new, O.root_hashes(old), O.root_hashes(new), ["file_path", "ord", "id"]).select("id")


@query("""WITH c AS (SELECT o_orderpriority AS a, year(o_orderdate)::VARCHAR AS b, o_orderkey, count(l_orderkey) AS t, count(*) FILTER (l_returnflag IN ('R', 'A')) AS s, count(*) FILTER (l_returnflag = 'R') AS f FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)
SELECT coalesce(a || coalesce('/' || b, ''), '') AS folder, count(*) AS files, sum(t)::BIGINT AS total_symbols, sum(s)::BIGINT AS seen_count, sum(f)::BIGINT AS full_count,
 round(sum(s) / sum(t) * 100e0, 9) AS seen_percent, round(sum(f) / sum(t) * 100e0, 9) AS full_percent FROM c GROUP BY ROLLUP (a, b)""")
def folder_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of every folder and of the whole: orders are files below their priority and year, their lines the symbols."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("total_symbols"), F.count_if(F.col("l_returnflag").isin("R", "A")).alias("seen_count"), F.count_if(F.col("l_returnflag") == "R").alias("full_count"))
    o = table(spark, sf_dir, "orders")
    path = F.concat_ws("/", "o_orderpriority", F.year("o_orderdate").cast("string"), F.col("o_orderkey").cast("string"))
    rows = o.join(lines, o.o_orderkey == lines.l_orderkey, "left").na.fill(0, ["total_symbols", "seen_count", "full_count"]).withColumn("file_path", path)
    out = coverage.folder_coverage(rows)
    return out.withColumn("seen_percent", F.round("seen_percent", 9)).withColumn("full_percent", F.round("full_percent", 9))


# --- agents -------------------------------------------------------------------------------------------

#: Customers are agents, forty a session: a heap below each first one, seven levels deep; every eleventh's parent is gone.
_AGENTS = """WITH RECURSIVE a AS (SELECT floor(c_custkey / 40)::BIGINT AS session_id, c_custkey % 40 AS q, c_custkey AS agent_id, (c_custkey % 40 * 7) % 40 AS o,
  CASE WHEN c_custkey % 40 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN -1 ELSE c_custkey - c_custkey % 40 + (c_custkey % 40) // 2 END AS p FROM customer),
r AS (SELECT session_id, arg_min(agent_id, o) FILTER (p IS NULL) AS root FROM a GROUP BY session_id),
w AS (SELECT a.session_id, agent_id, [[CASE WHEN agent_id = root THEN 0 ELSE 1 END, o, agent_id]] AS path FROM a JOIN r USING (session_id) WHERE p IS NULL OR (a.session_id, p) NOT IN (SELECT (session_id, agent_id) FROM a)
  UNION ALL SELECT a.session_id, a.agent_id, list_append(w.path, [0, a.o, a.agent_id]) FROM w JOIN a ON a.session_id = w.session_id AND a.p = w.agent_id),
n AS (SELECT *, len(path) - 1 AS indent, row_number() OVER (PARTITION BY session_id ORDER BY path) AS place FROM w)
"""


def _agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("long")
    q = k % 40
    parent = F.when(q == 0, F.lit(None).cast("long")).when(k % 11 == 0, F.lit(-1).cast("long")).otherwise(k - q + F.floor(q / 2))
    return table(spark, sf_dir, "customer").select(F.floor(k / 40).alias("session_id"), k.alias("agent_id"), ((q * 7) % 40).alias("first_ord"), parent.alias("parent_id"))


@query(_AGENTS + """, f AS (SELECT n.session_id, n.agent_id, n.indent, n.place, coalesce(list(x.indent ORDER BY x.place) FILTER (x.place IS NOT NULL), []) AS later
 FROM n LEFT JOIN n x ON x.session_id = n.session_id AND x.place > n.place GROUP BY ALL)
SELECT session_id, agent_id, indent::INT AS indent, place, array_to_string(list_transform(range(indent), lambda i: CASE WHEN list_contains(later, i) THEN '│ ' ELSE '  ' END), '')
 || CASE WHEN list_filter(later, lambda i: i <= indent)[1] = indent THEN '├─ ' ELSE '└─ ' END AS prefix FROM f""")
def agent_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents of many levels, each session's depth first and with its branches drawn; some have lost their parent."""
    rows = O.tree_prefixes(O.agents_in_order(_agents(spark, sf_dir)))
    place = F.row_number().over(W.partitionBy("session_id").orderBy("path")).cast("long")
    return rows.select("session_id", "agent_id", "indent", place.alias("place"), "prefix")


@query(_AGENTS + """SELECT p AS agent_id, session_id, string_agg(agent_id, ',' ORDER BY agent_id) AS children FROM a WHERE p IS NOT NULL GROUP BY p, session_id""")
def agent_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agents directly below each, by session; of a lost parent too."""
    return O.agent_children(_agents(spark, sf_dir), session=["session_id"]).select("agent_id", "session_id", F.array_join("children", ",").alias("children"))


@query(_LOG + """, own AS (SELECT session, agent, id, max(d) AS d FROM marks GROUP BY ALL)
SELECT a.session AS session_id, a.agent AS agent_id, count(*) FILTER (own.d > 0) AS seen, floor(count(*) FILTER (own.d > 0) / 560 * 100e0)::INT AS seen_percent
FROM (SELECT DISTINCT session, agent FROM calls) a LEFT JOIN own ON own.session = a.session AND own.agent = a.agent GROUP BY a.session, a.agent""")
def agent_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the project each agent of each session has read over all epochs."""
    calls = O.distinct_calls(log_events(spark, sf_dir))
    own = O.agent_ledger(O.agent_marks(calls, project(spark)[1]), ["session_id", "id"])
    return O.agent_coverage(calls.select("session_id", "agent_id").distinct(), own, 560, session=["session_id"]).select("session_id", "agent_id", "seen", "seen_percent")


@query(_LOG + """, led AS (SELECT DISTINCT session, id FROM marks), own AS (SELECT session, id, max(d) AS d FROM marks WHERE agent = 'agent-7' GROUP BY ALL)
SELECT led.session AS session_id, coalesce(d, 0)::INT AS depth, count(*) AS n FROM led LEFT JOIN own ON own.session = led.session AND own.id = led.id GROUP BY 1, 2""")
def agent_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep one agent has read what its session has touched."""
    marked = O.agent_marks(O.distinct_calls(log_events(spark, sf_dir)), project(spark)[1])
    return O.depth_histogram(O.agent_depths(marked, ["session_id", "id"], "agent-7"), ["session_id"])


# --- data sources -----------------------------------------------------------------------------------------


def _fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, as a path that tasks open themselves."""
    folder = f"{shared_folder(spark).removeprefix('file://')}/sightline-files/{name}-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


@query(_SOURCES + "SELECT path AS file_path, np AS name_path, a::BIGINT AS line_start, h AS content_hash FROM y")
def symbols_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of all source texts by a table function, in SQL."""
    scan.register_functions(spark)
    return spark.sql("SELECT s.file_path, c.name_path, c.line_start, c.content_hash FROM {s} AS s, LATERAL code_symbols(s.file_path, s.source, 'name_path', 'line_start', 'content_hash') AS c", s=sources(spark, sf_dir))


@query(_SOURCES + "SELECT 'd' || (k::BIGINT % 10) || '/' || regexp_extract(path, '[^/]*$') AS file_path, count(*) AS symbols FROM p JOIN y USING (path) WHERE k::BIGINT % 10 = 3 AND turn = 1 GROUP BY 1")
def scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources written as a tree of files and scanned: of one folder, the files of one extension; both filters reach the scan."""
    folder = _fresh_folder(spark, "tree")
    text = sources(spark, sf_dir)
    place = F.concat(F.lit("d"), (F.regexp_extract("file_path", "([0-9]+)", 1).cast("long") % 10).cast("string"), F.lit("/"), F.substring_index("file_path", "/", -1))
    for d in range(10):
        os.makedirs(f"{folder}/d{d}")
    scan.write_lines(text.select(place.alias("path"), F.rtrim("source", F.lit("\n")).alias("source"), F.lit(0).alias("at")), "path", "source", ["at"], folder, "")
    found = scan.read_tree(spark, folder).where(F.startswith("file_path", F.lit("d3/")) & F.endswith("file_path", F.lit(".rs")))
    return code.symbols(found).groupBy("file_path").agg(F.count("*").alias("symbols"))


@query(_LOG + "SELECT label, kind, path AS file_path, count(*) AS n FROM (SELECT stem[7:] AS label, 'tool_call' AS kind, CASE WHEN tool = 'Read' THEN '/w/' || path ELSE path END AS path FROM calls UNION ALL SELECT stem[7:], kind, NULL FROM others) GROUP BY ALL")
def read_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs of all agents written as files, one each in order, and read back: their lines, labels and events."""
    folder = _fresh_folder(spark, "logs")
    scan.write_lines(log_lines(spark, sf_dir), "stem", "raw", ["line_no"], folder, ".jsonl")
    lines = sessions.read_lines(spark, [f"{folder}/{f}" for f in sorted(os.listdir(folder))])
    found = sessions.parse_lines(lines.join(F.broadcast(sessions.first_lines(lines)), "file_rank"), "/p", "s")
    return found.groupBy("label", "kind", "file_path").agg(F.count("*").alias("n"))
