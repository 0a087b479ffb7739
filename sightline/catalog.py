"""Registered queries: every operator on an analogous relation of the driver's tables, with its SQL.

In ``events`` a user stands for an agent, ``props.k`` for a symbol, the event type for a tool, and an
``error`` for a reset; orders stand for files and their lines for symbols.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import functions as X
from . import operators as O

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import catalog_sessions, catalog_structures  # noqa: F401  (register their queries)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: _SQL[name] for name in queries() if name in _SQL}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as tool calls: user_id, sym, d (depth), is_reset, ts, event_id."""
    e = table(spark, sf_dir, "events")
    d = F.when(F.col("event_type") == "purchase", 4).when(F.col("event_type") == "signup", 3).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 1).otherwise(0)
    return e.select("event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("sym"), d.alias("d"), (F.col("event_type") == "error").alias("is_reset"))


_CALLS = """WITH calls AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS sym,
  CASE event_type WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS d, event_type = 'error' AS is_reset FROM events),
ep AS (SELECT *, coalesce(sum(is_reset::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS epoch FROM calls)
"""


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.with_epochs(calls(spark, sf_dir), F.col("is_reset"), ["user_id"], ["ts", "event_id"])


# --- scalar functions -----------------------------------------------------------------------------------


@query(r"""SELECT doc_id, (list_sum(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: CAST(ceil(length(w) / 4.0) AS BIGINT)))
 + length(regexp_replace(text, '[\p{L}\p{N}_]|\s', '', 'g')))::BIGINT AS tokens FROM documents""")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT page_id, array_to_string(list_slice(string_split(rtrim(url, '/'), '/'), -2, -1), '/') AS short FROM pages")
def short_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.short_path(F.col("url")).alias("short"))


@query(r"SELECT p_partkey, regexp_replace(p_name, '^([a-z]+ )+', '') AS bare FROM part")
def strip_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.strip_keywords(F.col("p_name")).alias("bare"))


@query("""SELECT doc_id, CASE WHEN strlen(text) <= 200 THEN text
 ELSE left(text, list_sum(list_transform(range(1, 201), lambda i: CASE WHEN i <= length(text) AND strlen(left(text, i - 1)) < 200 THEN 1 ELSE 0 END))::BIGINT) || '…' END AS cut FROM documents""")
def command_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate_command(F.col("text")).alias("cut"))


@query("""SELECT doc_id, left(text, list_sum(list_transform(range(1, 48), lambda i: CASE WHEN i <= length(text) AND strlen(left(text, i)) <= 47 THEN 1 ELSE 0 END))::BIGINT) AS label,
 left(source, 12) AS short_source, (length(text) - length(replace(text, chr(10), '')) + (text <> '' AND NOT ends_with(text, chr(10)))::INT)::BIGINT AS total_lines,
 CASE WHEN coalesce(lang, '') = '' THEN source ELSE lang || '/' || source END AS name_path, doc_id || '::' || source AS symbol_id FROM documents""")
def scalar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels cut by bytes, short ids, lines of a text, name paths and symbol ids."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.first_bytes(F.col("text"), 47).alias("label"), X.short_id(F.col("source")).alias("short_source"), X.total_lines(F.col("text")).cast("long").alias("total_lines"),
        X.name_path(F.col("lang"), F.col("source")).alias("name_path"), X.symbol_id(F.col("doc_id").cast("string"), F.col("source")).alias("symbol_id"),
    )


@query(r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM conversations)
SELECT conv_id, turn, CASE WHEN len(words) = 0 THEN '' ELSE list_reduce(words, lambda acc, w: CASE WHEN strlen(regexp_extract(acc, '[^\n]*$')) + 1 + strlen(w) > 40 THEN acc || chr(10) || w ELSE acc || ' ' || w END) END AS lines FROM w""")
def word_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.wrapped(F.col("text"), 40), "\n").alias("lines"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey > 0 THEN 100e0 * (o_orderkey - o_custkey) / o_custkey ELSE 0 END AS delta, o_orderkey / 1000e0 AS seconds FROM orders""")
def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how many percent one count differs from another, and milliseconds in seconds."""
    return table(spark, sf_dir, "orders").select("o_orderkey", X.token_delta(F.col("o_custkey"), F.col("o_orderkey")).alias("delta"), X.seconds(F.col("o_orderkey")).alias("seconds"))


@query("SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def json_typed_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("props")
    k = F.try_variant_get(v, "$.k", "variant")
    typed = F.when(F.schema_of_variant(k) == "BIGINT", F.try_variant_get(v, "$.k", "bigint"))
    return table(spark, sf_dir, "events").select("event_id", typed.alias("k"))


@query("""WITH o AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS n, o_totalprice % 100 AS pct FROM orders)
SELECT o_orderkey, CASE WHEN n >= 1000000 THEN format('{:.1f}M', n / 1e6) WHEN n >= 1000 THEN format('{:.1f}k', n / 1e3) ELSE n::VARCHAR END AS shown,
 CASE WHEN floor(pct) <= 20 THEN '0-20' WHEN floor(pct) <= 50 THEN '21-50' WHEN floor(pct) <= 80 THEN '51-80' ELSE '81-100' END AS band,
 format('{:.0f}', pct) AS whole, format('{:.1f}', pct) AS tenths, format('{:+.1f}', pct - 50) AS signed,
 CASE WHEN pct = 0 THEN 'unread' WHEN pct >= 80 THEN 'proceed' WHEN pct >= 50 THEN 'adequate' ELSE 'read' END AS decision FROM o""")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pct = F.col("o_totalprice") % 100
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", X.compact_number(F.floor("o_totalprice").cast("long")).alias("shown"), X.percent_band(pct).alias("band"), X.fixed(pct, 0).alias("whole"), X.fixed(pct, 1).alias("tenths"),
        X.fixed(pct - 50, 1, signed=True).alias("signed"), X.decision(pct).alias("decision"),
    )


# --- filters --------------------------------------------------------------------------------------------


@query("SELECT page_id, list_slice(list_filter(string_split(url, '/'), lambda x: x NOT IN ('', '.', '..')), 1, 1) = ['https:'] AS secure FROM pages WHERE list_contains(list_slice(list_filter(string_split(url, '/'), lambda x: x NOT IN ('', '.', '..')), 3, 3), 'de')")
def path_filter_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    below_host = F.regexp_replace("url", "^[a-z]+://[^/]+/?", "")
    return p.where(X.literal_filter(below_host, "/de/")).select("page_id", X.literal_filter(F.col("url"), "https:").alias("secure"))


@query(r"SELECT page_id FROM pages WHERE regexp_matches(url, '/(en|de)/[0-9]+')")
def path_filter_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(X.regex_filter(F.col("url"), "/(en|de)/[0-9]+")).select("page_id")


@query("SELECT coalesce(arg_min(c_name, c_custkey), 'Customer#00000001') AS resolved, count(*) AS candidates FROM customer WHERE starts_with(c_name, 'Customer#00000001') UNION ALL SELECT 'nobody', 0")
def prefix_agent_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix of several names, and one of none."""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("agent_id"), F.col("c_custkey").alias("first_ord"))
    return O.resolve_agent(c, "Customer#00000001").unionByName(O.resolve_agent(c, "nobody"))


# --- joins ----------------------------------------------------------------------------------------------


@query("""SELECT count(*) AS pairs, count(DISTINCT a.event_id) AS lefts FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id
 AND a.event_id < b.event_id + 40 AND b.event_id < a.event_id + 40""")
def line_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("s"), (F.col("event_id") + 40).alias("e"))
    b = e.select("user_id", F.col("s").alias("ts"), F.col("e").alias("te"))
    hit = O.interval_join(e, b, ["user_id"], "s", "e", "ts", "te", 40).where(F.col("s") < F.col("ts"))
    return hit.agg(F.count("*").alias("pairs"), F.count_distinct("s").alias("lefts"))


@query("""SELECT p_partkey FROM part WHERE replace(p_name, ' ', '/') = 'widget' OR ends_with(replace(p_name, ' ', '/'), '/widget') OR p_name = 'widget'
 OR regexp_replace(p_name, '^([a-z]+ )+', '') = 'widget'""")
def name_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.where(O.name_matches(F.replace("p_name", F.lit(" "), F.lit("/")), F.col("p_name"), F.lit("widget"))).select("p_partkey")


@query("SELECT a.doc_id // 2 AS sym FROM documents a JOIN documents b ON a.doc_id % 2 = 0 AND b.doc_id = a.doc_id + 1 WHERE sha256(a.text) <> sha256(b.text)")
def stale_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") / 2).cast("long").alias("sym"), (F.col("doc_id") % 2).alias("side"), F.sha2("text", 256).alias("content_hash"))
    return O.stale(d.where("side = 0"), d.where("side = 1"), ["sym"]).select("sym")


@query(_CALLS + """, lastep AS (SELECT user_id, sum(is_reset::INT) AS r FROM calls GROUP BY user_id),
a AS (SELECT DISTINCT ep.user_id, sym FROM ep JOIN lastep USING (user_id) WHERE NOT is_reset AND epoch = r),
b AS (SELECT DISTINCT ep.user_id, sym FROM ep JOIN lastep USING (user_id) WHERE NOT is_reset AND epoch < r)
SELECT user_id, sym FROM a ANTI JOIN b USING (user_id, sym)""")
def files_after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _epochs(spark, sf_dir)
    last = O.last_epoch(e, F.col("is_reset"), ["user_id"])
    resets = e.groupBy("user_id").agg(F.sum(F.col("is_reset").cast("long")).alias("r"))
    before = e.join(resets, "user_id").where("not is_reset and epoch < r")
    return O.files_after(before, last, ["user_id", "sym"])


# --- aggregates -----------------------------------------------------------------------------------------


@query(_CALLS + "SELECT sym, max(d)::INT AS depth, count(DISTINCT user_id) AS agents FROM calls GROUP BY sym")
def ledger_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).groupBy("sym").agg(F.max("d").alias("depth"), F.count_distinct("user_id").alias("agents"))


@query(_CALLS + "SELECT sym, max(d)::INT AS depth, arg_min(user_id, row(-d, ts, event_id)) AS user_id, arg_min(event_id, row(-d, ts, event_id)) AS event_id FROM calls GROUP BY sym")
def ledger_first_at_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.ledger(calls(spark, sf_dir), ["sym"], ["ts", "event_id"], ["user_id", "event_id"], "d")


@query(_CALLS + "SELECT user_id, epoch, count(*) AS calls FROM ep WHERE NOT is_reset GROUP BY user_id, epoch")
def epoch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _epochs(spark, sf_dir).where("not is_reset").groupBy("user_id", "epoch").agg(F.count("*").alias("calls"))


@query(_CALLS + ", r AS (SELECT user_id, sum(is_reset::INT) AS r FROM calls GROUP BY user_id) SELECT user_id, sym, max(d)::INT AS depth FROM ep JOIN r USING (user_id) WHERE epoch = r AND NOT is_reset GROUP BY user_id, sym")
def ledger_last_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.last_epoch(_epochs(spark, sf_dir), F.col("is_reset"), ["user_id"]).groupBy("user_id", "sym").agg(F.max("d").alias("depth"))


@query(_CALLS + """, c AS (SELECT user_id, epoch, count(*) AS calls, count(DISTINCT sym) AS syms, string_agg(DISTINCT sym::VARCHAR, ',' ORDER BY sym::VARCHAR) AS files FROM ep WHERE NOT is_reset GROUP BY user_id, epoch),
t AS (SELECT user_id, count(DISTINCT sym) AS total FROM calls WHERE NOT is_reset GROUP BY user_id)
SELECT e.user_id, e.epoch, e.event_id, coalesce(c.calls, 0) AS calls, coalesce(c.syms, 0) AS syms, coalesce(c.files, '') AS files, round(CASE WHEN coalesce(t.total, 0) = 0 THEN 0 ELSE coalesce(c.syms, 0) / t.total * 100.0 END, 6) AS pct
FROM ep e LEFT JOIN c ON e.user_id = c.user_id AND e.epoch = c.epoch LEFT JOIN t ON e.user_id = t.user_id WHERE e.is_reset""")
def compaction_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _epochs(spark, sf_dir)
    snap = O.snapshots(e.withColumn("file", F.col("sym").cast("string")), F.col("is_reset"), ["user_id"], ["event_id"], "file", "d")
    total = e.where("not is_reset").groupBy("user_id").agg(F.count_distinct("sym").alias("total"))
    syms = F.size("files_before").cast("long")
    return snap.join(total, "user_id", "left").select("user_id", "epoch", "event_id", F.col("tool_calls_before").alias("calls"), syms.alias("syms"), F.array_join("files_before", ",").alias("files"), F.round(X.percent(syms, F.coalesce("total", F.lit(0))), 6).alias("pct"))


@query("""WITH s AS (SELECT *, coalesce(sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM conversations),
m AS (SELECT *, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id, seg ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS metadata FROM s)
SELECT conv_id, turn, metadata::INT AS metadata FROM m WHERE role = 'assistant'""")
def meta_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return O.pair_metadata(c, F.col("role") == "user", F.col("role") == "assistant", F.length("text"), ["conv_id"], ["turn"]).select("conv_id", "turn", "metadata")


@query(_CALLS + "SELECT sym, user_id, max(d)::INT AS depth FROM calls GROUP BY sym, user_id")
def agent_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.agent_ledger(calls(spark, sf_dir), ["sym"], "user_id", "d")


@query(_CALLS + "SELECT user_id, count(DISTINCT CASE WHEN d > 0 THEN sym END) AS seen FROM calls GROUP BY user_id")
def agent_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = O.agent_ledger(calls(spark, sf_dir), ["sym"], "user_id", "d")
    return per.groupBy("user_id").agg(F.count_if(F.col("depth") > 0).alias("seen"))


@query(_CALLS + ", l AS (SELECT user_id, sym, max(d)::INT AS depth FROM calls GROUP BY user_id, sym) SELECT depth, CASE depth WHEN 0 THEN 'unseen' WHEN 1 THEN 'name' WHEN 2 THEN 'overview' WHEN 3 THEN 'signature' WHEN 4 THEN 'full' END AS label, count(*) AS n FROM l GROUP BY depth")
def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = O.depth_histogram(O.agent_ledger(calls(spark, sf_dir), ["sym"], "user_id", "d"))
    return h.select("depth", X.depth_label(F.col("depth")).alias("label"), "n")


def _order_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_path"))
    lines = table(spark, sf_dir, "lineitem")
    key = F.struct("l_orderkey", "l_linenumber")
    symbols = lines.select(F.col("l_orderkey").alias("file_path"), key.alias("id"))
    depth = F.when(F.col("l_returnflag") == "R", 4).when(F.col("l_returnflag") == "A", 2).otherwise(0)
    ledger = lines.groupBy(key.alias("id")).agg(F.max(depth).alias("depth"))
    return files, symbols, ledger


_COVERAGE = """WITH led AS (SELECT l_orderkey, l_linenumber, max(CASE l_returnflag WHEN 'R' THEN 4 WHEN 'A' THEN 2 ELSE 0 END) AS d FROM lineitem GROUP BY 1, 2),
c AS (SELECT l_orderkey, count(*) AS t, count(*) FILTER (d > 0) AS s, count(*) FILTER (d = 4) AS f FROM lineitem JOIN led USING (l_orderkey, l_linenumber) GROUP BY l_orderkey),
rep AS (SELECT o_orderkey AS file_path, coalesce(t, 0) AS total_symbols, coalesce(s, 0) AS seen_count, coalesce(f, 0) AS full_count FROM orders LEFT JOIN c ON o_orderkey = l_orderkey)
"""


@query(_COVERAGE + """SELECT file_path, total_symbols, seen_count, full_count, CASE WHEN total_symbols = 0 THEN 0 ELSE seen_count / total_symbols * 100.0 END AS seen_percent,
 CASE WHEN total_symbols = 0 THEN 0 ELSE full_count / total_symbols * 100.0 END AS full_percent,
 CASE WHEN total_symbols = 0 OR seen_count = 0 THEN 3 WHEN full_count = total_symbols THEN 2 WHEN seen_count = total_symbols THEN 1 ELSE 0 END AS status FROM rep""")
def coverage_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.coverage_report(*_order_tables(spark, sf_dir))


@query(_COVERAGE + "SELECT sum(total_symbols)::BIGINT AS total_symbols, sum(seen_count)::BIGINT AS seen_count, sum(full_count)::BIGINT AS full_count, round(sum(seen_count) / sum(total_symbols) * 100.0, 9) AS seen_percent, round(sum(full_count) / sum(total_symbols) * 100.0, 9) AS full_percent FROM rep")
def coverage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = O.report_totals(O.coverage_report(*_order_tables(spark, sf_dir)))
    return t.withColumn("seen_percent", F.round("seen_percent", 9)).withColumn("full_percent", F.round("full_percent", 9))


@query(_COVERAGE + "SELECT CASE WHEN total_symbols = 0 OR seen_count = 0 THEN 3 WHEN full_count = total_symbols THEN 2 WHEN seen_count = total_symbols THEN 1 ELSE 0 END AS status, count(*) AS files FROM rep GROUP BY 1")
def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.coverage_report(*_order_tables(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("files"))


# --- windows and views ----------------------------------------------------------------------------------


@query("""WITH n AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
SELECT user_id, event_id FROM n WHERE r > n - CASE WHEN n <= 20 THEN n ELSE 11 + (n - 21) % 10 END""")
def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return O.ring_buffer(e, ["user_id"], [F.col("ts"), F.col("event_id")], 20, 10).select("user_id", "event_id")


@query("SELECT user_id, min(event_id) AS first_ord FROM events GROUP BY user_id")
def agent_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_seen(table(spark, sf_dir, "events"), "user_id", F.col("event_id"))


@query("SELECT page_id, row_number() OVER (ORDER BY string_split(url, '/'), page_id) AS pos FROM pages")
def component_path_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global rank without a single task for all rows."""
    return O.path_ranks(table(spark, sf_dir, "pages").select("page_id", "url"), "url", "page_id").select("page_id", "pos")


@query("""WITH f AS (SELECT user_id AS who, 'call' AS kind, event_id AS ord, strftime(ts, '%Y-%m-%d %H') AS ts, 0 AS src FROM events WHERE event_type <> 'error'
 UNION ALL SELECT user_id, 'compaction', event_id, strftime(ts, '%Y-%m-%d %H'), 1 FROM events WHERE event_type = 'error')
SELECT who, kind, ord, row_number() OVER (PARTITION BY who ORDER BY ts, src, ord) AS pos FROM f""")
def feed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every call and compaction in its session's feed; time stamps to the hour, so that many tie."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("who"), F.col("event_id").alias("ord"), F.date_format("ts", "yyyy-MM-dd HH").alias("ts"), "event_type", F.lit("x").alias("agent_id"))
    calls_, compactions = e.where("event_type <> 'error'").withColumn("kind", F.lit("call")), e.where("event_type = 'error'").withColumn("kind", F.lit("compaction"))
    return O.feed_positions(calls_, compactions, ["who"]).select("who", "kind", "ord", F.col("pos").cast("long").alias("pos"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'widget') ORDER BY p_partkey <= 100, p_partkey LIMIT 1")
def search_wraparound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row is the feature: the next hit after the cursor."""
    return O.search(table(spark, sf_dir, "part"), "p_name", "p_partkey", "WIDGET", 100).select("p_partkey")
