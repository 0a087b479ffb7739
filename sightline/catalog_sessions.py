"""Registered queries on session logs and source texts: the tables are written out as logs and sources, and read back.

Every event becomes a line of a session log: its type a tool and its input, an ``error`` a boundary, a
summary, a clear command or a broken line. Every part becomes a source file in one of three languages. So
the parsers run on as many texts as the tables have rows, and the SQL says what must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as X
from . import operators as O
from .catalog import query, table
from .plans import coverage, report
from .sources import code, sessions
from .sources.sessions import ORDER
from .tables import kept

#: A project of FILES files, each with ROOTS types of three methods.
FILES, ROOTS = 20, 7


def _json(*parts: object) -> F.Column:  # type: ignore[name-defined]
    return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as log lines, with session, label and cwd."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    k, n = F.col("k").cast("string"), F.col("event_id").cast("string")
    session = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    file = F.concat(F.lit("src/f"), (F.col("k") % FILES).cast("string"), F.lit(".rs"))
    message = lambda *blocks: _json('{"type":"assistant","sessionId":"', session, '","timestamp":"', n, '","message":{"content":[', *blocks, "]}}")
    tool = lambda name, *inputs: ('{"type":"tool_use","name":"' + name + '","input":{', *inputs, "}}")
    call = (
        F.when(F.col("event_type") == "view", message('{"type":"text","text":"look"},', *tool("Glob", '"pattern":"*.rs","path":"/p/', file, '"')))
        .when(F.col("event_type") == "click", _json('{"agentId":"agent-7",', F.substr(message(*tool("Grep", '"pattern":"k', k, '","path":"/p/', file, '"')), F.lit(2))))
        .when(F.col("event_type") == "signup", message(*tool("mcp__serena__find_symbol", '"relative_path":"', file, '","name_path_pattern":"S', (F.col("k") % ROOTS).cast("string"), '","include_body":', (F.col("event_id") % 2 == 0).cast("string")), ",", *tool("Mystery", '"x":1')))
        .when(F.col("event_type") == "purchase", message(*tool("Read", '"file_path":"/w/', file, '","offset":', (F.col("k") % 30).cast("string"), ',"limit":10')))
    )
    turn = F.col("event_id") % 4
    other = (
        F.when(turn == 0, _json('{"type":"system","subtype":"compact_boundary","compactMetadata":{"trigger":"auto","preTokens":', n, "}}"))
        .when(turn == 1, _json('{"type":"user","isCompactSummary":true,"timestamp":"', n, '","message":{"content":["', sessions.CLEAR, '"]}}'))
        .when(turn == 2, _json('{"type":"user","message":{"content":"go ', sessions.CLEAR, '"}}'))
        .otherwise(F.lit('{"type":"user","message":'))
    )
    stem = F.concat(F.lit("agent-"), (F.col("user_id") % 3).cast("string"))
    return e.select(
        F.lit(0).alias("file_rank"), stem.alias("stem"), F.lit(0).cast("long").alias("block"), F.col("event_id").alias("line_no"), F.coalesce(call, other).alias("raw"),
        F.regexp_replace(stem, "^agent-", "").alias("label"), F.lit("/w").alias("cwd"), session.alias("session"),
    )


def log_events(spark: SparkSession, sf_dir: str, one_session: bool = False) -> DataFrame:
    lines = log_lines(spark, sf_dir)
    return sessions.parse_lines(lines, "/p", F.lit("s") if one_session else F.col("session"))


def project(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(files, symbols) of the project that the events read."""
    i = F.col("id")
    file, root, part = F.floor(i / (ROOTS * 4)).cast("int"), (F.floor(i / 4) % ROOTS).cast("int"), (i % 4).cast("int")
    s = spark.range(FILES * ROOTS * 4).select(file.alias("f"), root.alias("r"), part.alias("j"))
    path = F.concat(F.lit("src/f"), F.col("f").cast("string"), F.lit(".rs"))
    own = F.concat(F.lit("m"), (F.col("j") - 1).cast("string"))
    top = F.concat(F.lit("S"), F.col("r").cast("string"))
    names = F.when(F.col("j") == 0, top).otherwise(X.name_path(top, own))
    ordinal = F.col("r") * 4 + F.col("j")
    symbols = s.select(
        path.alias("file_path"), ordinal.alias("ord"), F.when(F.col("j") == 0, ordinal + 3).otherwise(ordinal).alias("subtree_end"), F.when(F.col("j") > 0, F.col("r") * 4).alias("parent_ord"),
        (F.col("j") > 0).cast("int").alias("level"), X.symbol_id(path, names).alias("id"), F.when(F.col("j") == 0, top).otherwise(own).alias("name"), names.alias("name_path"),
        F.when(F.col("j") == 0, "struct").otherwise("fn").alias("label"),
        F.when(F.col("j") == 0, 1 + F.col("r") * 8).otherwise(F.col("r") * 8 + F.col("j") * 2).cast("long").alias("line_start"),
        F.when(F.col("j") == 0, 8 + F.col("r") * 8).otherwise(1 + F.col("r") * 8 + F.col("j") * 2).cast("long").alias("line_end"),
        F.sha2(X.symbol_id(path, names), 256).alias("content_hash"), (ordinal + 1).cast("long").alias("estimated_tokens"),
    )
    files = symbols.select("file_path").distinct().withColumn("total_lines", F.lit(ROOTS * 8).cast("long"))
    return files, symbols


_LOG = """WITH e AS (SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'u' || user_id AS session, 'agent-' || (user_id % 3) AS stem FROM events),
calls AS (
  SELECT session, event_id, 1 AS pos, session AS agent, 'Glob' AS tool, 'src/f' || (k % 20) || '.rs' AS path, 1 AS d, 'Glob *.rs' AS descr, NULL AS target, NULL::BIGINT AS a, NULL::BIGINT AS b, stem FROM e WHERE event_type = 'view'
  UNION ALL SELECT session, event_id, 0, 'agent-7', 'Grep', 'src/f' || (k % 20) || '.rs', 2, 'Search "k' || k || '"', NULL, NULL, NULL, stem FROM e WHERE event_type = 'click'
  UNION ALL SELECT session, event_id, 0, session, 'mcp__serena__find_symbol', 'src/f' || (k % 20) || '.rs', CASE WHEN event_id % 2 = 0 THEN 4 ELSE 3 END, 'Symbol S' || (k % 7), 'S' || (k % 7), NULL, NULL, stem FROM e WHERE event_type = 'signup'
  UNION ALL SELECT session, event_id, 1, session, 'Mystery', NULL, 0, 'Mystery (untracked)', NULL, NULL, NULL, stem FROM e WHERE event_type = 'signup'
  UNION ALL SELECT session, event_id, 0, session, 'Read', 'src/f' || (k % 20) || '.rs', 4, 'Read src/f' || (k % 20) || '.rs', NULL, k % 30, k % 30 + 10, stem FROM e WHERE event_type = 'purchase'),
others AS (SELECT session, event_id, stem, CASE event_id % 4 WHEN 0 THEN 'boundary' WHEN 1 THEN 'compacted' ELSE 'cleared' END AS kind FROM e WHERE event_type = 'error' AND event_id % 4 < 3),
syms AS (SELECT f, r, j, 'src/f' || f || '.rs' AS path, r * 4 + j AS ord, 'src/f' || f || '.rs::S' || r || CASE WHEN j > 0 THEN '/m' || (j - 1) ELSE '' END AS id,
  CASE j WHEN 0 THEN 1 + r * 8 ELSE r * 8 + j * 2 END AS s, CASE j WHEN 0 THEN 8 + r * 8 ELSE 1 + r * 8 + j * 2 END AS t FROM range(20) a(f), range(7) b(r), range(4) c(j)),
marks AS (SELECT c.session, c.event_id, c.agent, c.d, y.path, y.ord, y.id FROM calls c JOIN syms y ON c.path = y.path
  AND CASE c.tool WHEN 'Read' THEN y.s < c.b AND c.a < y.t WHEN 'mcp__serena__find_symbol' THEN 'S' || y.r = c.target ELSE true END)
"""


@query(_LOG + """SELECT event_id AS line_no, pos AS block_pos, 'tool_call' AS kind, agent AS agent_id, tool AS tool_name, path AS file_path, d AS read_depth, descr AS description, target AS target_symbol, a AS target_start, b AS target_end,
 stem[7:] AS label, NULL AS summary, NULL::BIGINT AS pre_tokens FROM calls
 UNION ALL SELECT event_id, 0, kind, stem, NULL, NULL, NULL, NULL, NULL, NULL, NULL, stem[7:], CASE WHEN kind = 'compacted' THEN '' END, CASE WHEN kind = 'boundary' THEN event_id END FROM others""")
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each log line says."""
    e = log_events(spark, sf_dir)
    return e.select("line_no", "block_pos", "kind", "agent_id", "tool_name", "file_path", "read_depth", "description", "target_symbol", "target_start", "target_end", "label", "summary", F.col("meta.pre_tokens").alias("pre_tokens"))


@query(_LOG + """SELECT event_id AS line_no, '[' || event_id || '] agent=' || agent || ' tool=' || tool || ' depth=' || CASE d WHEN 0 THEN 'Unseen' WHEN 1 THEN 'NameOnly' WHEN 2 THEN 'Overview' WHEN 3 THEN 'Signature' ELSE 'FullBody' END
 || ' path=' || CASE WHEN path IS NULL THEN '-' WHEN tool = 'mcp__serena__find_symbol' THEN path ELSE '/p/' || path END || ' target=' || coalesce(target, 'L' || a || '-' || b, '-') || ' desc="' || descr || '"' AS line FROM calls""")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.event_log(log_events(spark, sf_dir)).select("line_no", "line")


@query(_LOG + "SELECT event_id AS line_no, count(*) AS n, sum(ord)::BIGINT AS ords FROM marks GROUP BY event_id")
def log_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many symbols each call touches, and which."""
    e = log_events(spark, sf_dir).where("kind = 'tool_call'").withColumn("epoch", F.lit(0))
    m = O.marks(e, project(spark)[1], ORDER)
    return m.groupBy(F.col("event_ord.line_no").alias("line_no")).agg(F.count("*").alias("n"), F.sum("sym_ord").alias("ords"))


_EPOCHS = _LOG + """, timed AS (SELECT session, event_id, 0 AS is_reset FROM calls UNION SELECT session, event_id, 1 FROM others WHERE kind <> 'boundary'),
ep AS (SELECT session, event_id, is_reset, coalesce(sum(is_reset) OVER (PARTITION BY session ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS epoch FROM timed),
total AS (SELECT session, sum(is_reset)::BIGINT AS resets FROM ep GROUP BY session)
"""


@query(_EPOCHS + """SELECT m.session AS session_id, id, max(d)::INT AS depth, arg_min(agent, row(-d, m.event_id)) AS agent_id, string_agg(DISTINCT agent, ',' ORDER BY agent) AS agents
 FROM marks m JOIN ep ON m.session = ep.session AND m.event_id = ep.event_id JOIN total ON m.session = total.session AND epoch = resets GROUP BY m.session, id""")
def log_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each session has read since its last reset, by which agent first so deep, and by whom at all."""
    needed = ["session_id", *ORDER, "kind", "agent_id", "file_path", "read_depth", "target_symbol", "target_start", "target_end"]
    events = kept(log_events(spark, sf_dir).where("kind <> 'boundary'").select(*needed), "events")
    calls = O.after_last(events, F.col("kind") != "tool_call", ["session_id"], ORDER).withColumn("epoch", F.lit(0))
    last = O.marks(calls, project(spark)[1], ORDER)
    entries = O.ledger(last, ["session_id", "id"], ["event_ord", "sym_ord"], ["agent_id"], agents="agent_id")
    return entries.select("session_id", "id", "depth", "agent_id", F.array_join("agents", ",").alias("agents"))


@query(_EPOCHS + """, cleared AS (SELECT session, max(event_id) AS upto FROM others WHERE kind = 'cleared' GROUP BY session),
kept AS (SELECT o.session, o.event_id, row_number() OVER (PARTITION BY o.session ORDER BY o.event_id) AS sequence FROM others o LEFT JOIN cleared c ON o.session = c.session WHERE kind = 'compacted' AND o.event_id > coalesce(upto, -1)),
n AS (SELECT c.session, epoch, count(*) AS calls, string_agg(DISTINCT path, ',' ORDER BY path) AS files FROM calls c JOIN ep ON c.session = ep.session AND c.event_id = ep.event_id GROUP BY c.session, epoch),
seen AS (SELECT m.session, epoch, count(DISTINCT id) AS seen FROM marks m JOIN ep ON m.session = ep.session AND m.event_id = ep.event_id WHERE d > 0 GROUP BY m.session, epoch),
seg AS (SELECT *, coalesce(sum((kind = 'compacted')::INT) OVER (PARTITION BY session ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM others WHERE kind <> 'cleared'),
meta AS (SELECT session, event_id, kind, last_value(CASE WHEN kind = 'boundary' THEN event_id END IGNORE NULLS) OVER (PARTITION BY session, s ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pre FROM seg)
SELECT k.session AS session_id, sequence::INT AS sequence, k.event_id::VARCHAR AS ts, coalesce(calls, 0) AS tool_calls_before, coalesce(files, '') AS files_before, coalesce(seen, 0) AS seen_before,
 coalesce(seen, 0) / 560 * 100e0 AS seen_percent, pre AS pre_tokens
FROM kept k JOIN ep ON k.session = ep.session AND k.event_id = ep.event_id LEFT JOIN n ON n.session = k.session AND n.epoch = ep.epoch LEFT JOIN seen ON seen.session = k.session AND seen.epoch = ep.epoch
LEFT JOIN meta ON meta.session = k.session AND meta.event_id = k.event_id""")
def log_compactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's compactions since its last clear, with the state that they ended and the boundary's metadata."""
    e = sessions.with_metadata(log_events(spark, sf_dir))
    c = coverage.fold(*project(spark), e).compactions
    return c.select("session_id", "sequence", "ts", "tool_calls_before", F.array_join("files_before", ",").alias("files_before"), "seen_before", "seen_percent", F.col("meta.pre_tokens").alias("pre_tokens"))


_ONE = """, resets AS (SELECT coalesce(max(event_id) FILTER (kind <> 'boundary'), -1) AS upto FROM others),
led AS (SELECT id, max(d)::INT AS depth FROM marks, resets WHERE event_id > upto GROUP BY id),
rep AS (SELECT y.path, count(*) AS total, count(*) FILTER (coalesce(depth, 0) > 0) AS seen, count(*) FILTER (depth = 4) AS full_n FROM syms y LEFT JOIN led ON y.id = led.id GROUP BY y.path)
"""


@query(_LOG + _ONE + r""", body AS (SELECT 4 + row_number() OVER (ORDER BY full_n / total, string_split(path, '/')) AS line_no, printf('%-40s %8d %7d %7d %6.0f%% %6.0f%%', path, total, seen, full_n, seen / total * 100e0, full_n / total * 100e0) AS line FROM rep)
SELECT line_no, line FROM body UNION ALL SELECT 1, 'Coverage Report (session: s)' UNION ALL SELECT unnest([2, 4, 25]), repeat('─', 85)
UNION ALL SELECT 3, printf('%-40s %8s %7s %7s %7s %7s', 'File', 'Symbols', 'Seen', 'Full', 'Seen%', 'Full%')
UNION ALL SELECT 26, printf('%-40s %8d %7d %7d %6.0f%% %6.0f%%', 'TOTAL', sum(total)::BIGINT, sum(seen)::BIGINT, sum(full_n)::BIGINT, sum(seen) / sum(total) * 100e0, sum(full_n) / sum(total) * 100e0) FROM rep""")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text report of all events as one session, line by line (without the section on compactions)."""
    e = sessions.with_metadata(log_events(spark, sf_dir, one_session=True))
    c = coverage.fold(*project(spark), e)
    text = report.TextFormatter().format(report.Report(coverage.report(c).collect(), session_id="s"))
    return spark.createDataFrame([(i, x) for i, x in enumerate(text.splitlines(), 1)], "line_no long, line string")


@query(_LOG + _ONE + """, st AS (SELECT path, total, seen, CASE WHEN seen = 0 THEN 3 WHEN full_n = total THEN 2 WHEN seen = total THEN 1 ELSE 0 END AS status FROM rep),
f AS (SELECT DISTINCT f, path FROM syms)
SELECT st.path AS file_path, -1 AS ord, 0 AS depth, st.path AS name, f % 5 <> 0 AS is_expanded, '56 lines' AS line_range, CASE WHEN status = 3 THEN 0 ELSE 1 END AS read_depth, seen AS seen_count, total AS total_symbols FROM st JOIN f USING (path)
UNION ALL SELECT y.path, y.ord::INT, CASE WHEN j = 0 THEN 1 ELSE 2 END, CASE WHEN j = 0 THEN 'S' || r ELSE 'm' || (j - 1) END, NOT (j = 0 AND r = 2), 'L' || s || '-' || t, coalesce(depth, 0), 0, 0
 FROM syms y LEFT JOIN led ON y.id = led.id WHERE f % 5 <> 0 AND NOT (r = 2 AND j > 0)""")
def tree_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the tree view where every fifth file and every third type is collapsed."""
    files, symbols = project(spark)
    c = coverage.fold(files, symbols, sessions.with_metadata(log_events(spark, sf_dir, one_session=True)))
    fifth = files.where(F.regexp_extract("file_path", "f([0-9]+)", 1).cast("int") % 5 == 0)
    third = symbols.where("name = 'S2'").select("id")
    rows = O.tree_rows(files, symbols, c.ledger.select("id", "depth"), fifth, third, by_status=True)
    return rows.select("file_path", "ord", "depth", "name", "is_expanded", "line_range", "read_depth", "seen_count", "total_symbols")


@query(_LOG + _ONE + """, per AS (SELECT path, coalesce(max(depth), 0) AS depth FROM syms LEFT JOIN led USING (id) GROUP BY path),
bef AS (SELECT DISTINCT path FROM calls, resets WHERE event_id <= upto AND path IS NOT NULL AND tool = 'Grep')
SELECT * FROM (SELECT 'before' AS side, path AS file_path, depth FROM bef JOIN per USING (path) ORDER BY string_split(path, '/') LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'after', path, depth FROM per ANTI JOIN bef USING (path) WHERE depth > 0 ORDER BY string_split(path, '/') LIMIT 20)""")
def compaction_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that were searched before the last reset with their depth now, and other files read since; twenty of each are shown."""
    files, symbols = project(spark)
    c = coverage.fold(files, symbols, sessions.with_metadata(log_events(spark, sf_dir, one_session=True)))
    last = c.events.where("kind <> 'tool_call'").agg(F.coalesce(F.max("line_no"), F.lit(-1)).alias("at"))
    before = c.events.where("tool_name = 'Grep'").join(F.broadcast(last), F.col("line_no") <= F.col("at")).select("file_path").distinct()
    return O.compaction_overlay(before, O.max_depth_by_file(symbols, c.ledger))


@query(_LOG + """, a AS (SELECT session, agent, min(row(event_id, pos)) AS first FROM calls GROUP BY session, agent),
o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY first) AS place, count(*) OVER (PARTITION BY session) AS n, arg_min(agent, first) OVER (PARTITION BY session) AS root FROM a)
SELECT session AS session_id, agent AS agent_id, CASE WHEN agent <> root AND starts_with(agent, 'agent-') THEN 1 ELSE 0 END AS indent,
 CASE WHEN agent <> root AND starts_with(agent, 'agent-') THEN '  └─ ' WHEN place = 1 AND n = 2 AND starts_with(agent, 'agent-') THEN '├─ ' ELSE '└─ ' END AS prefix FROM o""")
def agent_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agents of each session as an indented list with its branches drawn."""
    calls = log_events(spark, sf_dir).where("kind = 'tool_call'")
    seen = calls.groupBy("session_id", "agent_id").agg(F.min(F.struct("line_no", "block_pos"))["line_no"].alias("first_ord"))
    return O.tree_prefixes(O.agents_in_order(O.agent_tree(seen))).select("session_id", "agent_id", "indent", "prefix")


@query(_LOG + """, cleared AS (SELECT session, max(event_id) AS upto FROM others WHERE kind = 'cleared' GROUP BY session),
fed AS (SELECT c.session, event_id, pos, count(*) OVER (PARTITION BY c.session) AS n, row_number() OVER (PARTITION BY c.session ORDER BY event_id, pos) AS r FROM calls c LEFT JOIN cleared USING (session) WHERE d <> 0 AND event_id > coalesce(upto, -1))
SELECT session AS session_id, event_id AS line_no FROM fed WHERE r > n - CASE WHEN n <= 20 THEN n ELSE 11 + (n - 21) % 10 END""")
def activity_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls that each session's feed still holds; of 20 and 10 in place of 200 and 100, so that feeds overflow."""
    e = log_events(spark, sf_dir)
    return O.activity(e, ["session_id"], ORDER, 20, 10).select("session_id", "line_no")


@query(_LOG + _ONE + """SELECT count(*) FILTER (depth > 0) AS seen, count(*) FILTER (depth = 4) AS full_body, count(*) FILTER (depth = 3) AS signature, count(*) FILTER (depth = 2) AS overview, count(*) FILTER (depth = 1) AS name,
 0::BIGINT AS stale, (count(*) FILTER (depth > 0) / 560 * 100e0 - 0.5)::INT AS percent, 560 - count(*) FILTER (depth > 0) AS unseen FROM led""".replace("(count(*) FILTER (depth > 0) / 560 * 100e0 - 0.5)::INT", "floor(count(*) FILTER (depth > 0) / 560 * 100e0)::INT"))
def stats_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, symbols = project(spark)
    c = coverage.fold(files, symbols, sessions.with_metadata(log_events(spark, sf_dir, one_session=True)))
    return O.stats_panel(c.ledger, F.lit(FILES * ROOTS * 4))


# --- source texts ---------------------------------------------------------------------------------------


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file for every part, in Python, Rust or TypeScript by turns.

    A part is a few bytes as stored and a file to parse, so a few splits of the table hold very many files: they are dealt anew.
    """
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    turn = F.col("p_partkey") % 3
    python = _json("X", k, ": int = ", n, "\n\n@d\nclass C", k, ":\n    def m(self):\n        return ", n, "  # é\n")
    rust = _json("pub struct S", k, " { a: u8 }\nimpl Tr for S", k, " {\n    fn n() -> u8 { ", n, " }\n    fn sig();\n}\n")
    typescript = _json("export const f", k, " = () => ", n, ";\nclass D", k, " {\n  p: string;\n  get q(): number { return ", n, "; }\n}\n")
    path = _json("p/", k, F.when(turn == 0, ".py").when(turn == 1, ".rs").otherwise(".ts"))
    return p.select(path.alias("file_path"), F.when(turn == 0, python).when(turn == 1, rust).otherwise(typescript).alias("source"))


_SOURCES = r"""WITH p AS (SELECT p_partkey % 3 AS turn, p_partkey::VARCHAR AS k, p_size::VARCHAR AS n, 'p/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' ELSE '.ts' END AS path FROM part),
nl AS (SELECT chr(10) AS c),
s AS (SELECT path, unnest(CASE turn
 WHEN 0 THEN [{'ord': 0, 'e': 0, 'np': 'X' || k, 'label': 'var', 'cat': 'variable', 'a': 1, 'b': 1, 't': 'X' || k || ': int = ' || n}, {'ord': 1, 'e': 2, 'np': 'C' || k, 'label': 'class', 'cat': 'type', 'a': 3, 'b': 6, 't': '@d' || c || 'class C' || k || ':' || c || '    def m(self):' || c || '        return ' || n},
   {'ord': 2, 'e': 2, 'np': 'C' || k || '/m', 'label': 'def', 'cat': 'function', 'a': 5, 'b': 6, 't': 'def m(self):' || c || '        return ' || n}]
 WHEN 1 THEN [{'ord': 0, 'e': 0, 'np': 'S' || k, 'label': 'struct', 'cat': 'type', 'a': 1, 'b': 1, 't': 'pub struct S' || k || ' { a: u8 }'}, {'ord': 1, 'e': 2, 'np': 'Tr for S' || k, 'label': 'impl', 'cat': 'impl', 'a': 2, 'b': 5, 't': 'impl Tr for S' || k || ' {' || c || '    fn n() -> u8 { ' || n || ' }' || c || '    fn sig();' || c || '}'},
   {'ord': 2, 'e': 2, 'np': 'Tr for S' || k || '/n', 'label': 'fn', 'cat': 'function', 'a': 3, 'b': 3, 't': 'fn n() -> u8 { ' || n || ' }'}]
 ELSE [{'ord': 0, 'e': 0, 'np': 'f' || k, 'label': 'function', 'cat': 'function', 'a': 1, 'b': 1, 't': 'const f' || k || ' = () => ' || n || ';'}, {'ord': 1, 'e': 3, 'np': 'D' || k, 'label': 'class', 'cat': 'type', 'a': 2, 'b': 5, 't': 'class D' || k || ' {' || c || '  p: string;' || c || '  get q(): number { return ' || n || '; }' || c || '}'},
   {'ord': 2, 'e': 2, 'np': 'D' || k || '/p', 'label': 'property', 'cat': 'variable', 'a': 3, 'b': 3, 't': 'p: string'}, {'ord': 3, 'e': 3, 'np': 'D' || k || '/q', 'label': 'get', 'cat': 'function', 'a': 4, 'b': 4, 't': 'get q(): number { return ' || n || '; }'}] END) AS x FROM p, nl),
y AS (SELECT path, x.*, sha256(trim(regexp_replace(x.t, '\s+', ' ', 'g'))) AS h, (list_sum(list_transform(regexp_extract_all(x.t, '[\p{L}\p{N}_]+'), lambda w: ceil(length(w) / 4.0)::BIGINT)) + length(regexp_replace(x.t, '[\p{L}\p{N}_]|\s', '', 'g')))::BIGINT AS tokens FROM s)
"""


@query(_SOURCES + """SELECT path AS file_path, ord, e AS subtree_end, path || '::' || np AS id, label, cat AS category, a::BIGINT AS line_start, b::BIGINT AS line_end, strlen(t) AS bytes, h AS content_hash, tokens AS estimated_tokens FROM y""")
def source_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of all source files."""
    s = code.symbols(sources(spark, sf_dir))
    return s.select("file_path", "ord", "subtree_end", "id", "label", "category", "line_start", "line_end", (F.col("byte_end") - F.col("byte_start")).alias("bytes"), "content_hash", "estimated_tokens")


@query(_SOURCES + """, m AS (SELECT path, ord, h AS own, (SELECT string_agg(h, '' ORDER BY ord) FROM y c WHERE c.path = y.path AND y.ord = 1 AND c.ord > 1) AS below, e, tokens,
 (SELECT sum(tokens) FROM y c WHERE c.path = y.path AND c.ord BETWEEN y.ord AND y.e)::BIGINT AS total_tokens FROM y)
SELECT path AS file_path, ord, (e - ord + 1)::BIGINT AS total_symbols, total_tokens, CASE WHEN below IS NULL THEN own ELSE sha256(own || below) END AS merkle_hash FROM m""")
def tree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols, tokens and rolled-up hash of every subtree, from the table of symbols alone."""
    s = code.symbols(sources(spark, sf_dir))
    return O.subtree_totals(O.roll_up_hashes(s)).select("file_path", "ord", "total_symbols", "total_tokens", "merkle_hash")


@query(_SOURCES + """SELECT path AS file_path, ord, repeat(' ', CASE WHEN ord > 1 THEN 6 ELSE 4 END) || label || ' ' || regexp_extract(np, '[^/]*$') || ' [L' || a || '-' || b || '] (~' || tokens || ' tokens)' AS line FROM y
 UNION ALL SELECT path, -1, '  ' || path || ' (' || CASE turn WHEN 0 THEN 6 ELSE 5 END || ' lines)' FROM p""")
def tree_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol tree as text."""
    src = sources(spark, sf_dir)
    return report.tree_lines(code.files(src), code.symbols(src))


@query(_SOURCES + "SELECT count(DISTINCT path) AS total_files, count(*) AS total_symbols, sum(tokens) FILTER (ord < 2)::BIGINT AS root_tokens FROM y")
def project_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = sources(spark, sf_dir)
    return O.project_totals(code.files(src), code.symbols(src))


@query("""WITH c AS (SELECT o_orderpriority AS module, o_orderkey, count(l_orderkey) AS t, count(*) FILTER (l_returnflag IN ('R', 'A')) AS s, count(*) FILTER (l_returnflag = 'R') AS f FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT module, round(sum(s) / sum(t) * 100e0, 9) AS seen_percent, round(sum(f) / sum(t) * 100e0, 9) AS full_percent, sum(s) / sum(t) * 100e0 >= 60 AS enough FROM c GROUP BY module""")
def module_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage summed by folder: orders are files, their priority the folder, their lines the symbols."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag"))
    o = table(spark, sf_dir, "orders")
    counts = o.join(lines, o.o_orderkey == lines.l_orderkey, "left").groupBy("o_orderpriority", "o_orderkey").agg(F.count("l_orderkey").alias("total_symbols"), F.count_if(F.col("flag").isin("R", "A")).alias("seen_count"), F.count_if(F.col("flag") == "R").alias("full_count"))
    rows = counts.withColumn("file_path", F.concat("o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string")))
    out = coverage.module_coverage(rows)
    return out.withColumn("seen_percent", F.round("seen_percent", 9)).withColumn("full_percent", F.round("full_percent", 9))
