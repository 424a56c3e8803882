"""Queries of readers, version diffs, streaming delivery, generations and the rest of the knowledge plane."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.operators import versions
from quillspark.plans.binding import Family
from quillspark.sources import readers
from quillspark.streaming import delivery
from quillspark.tables import table

_F = Family()
QUERIES, ORACLES = _F.queries, _F.oracles


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Documents as text items, events as CSV items, pages as HTML items."""
    text = table(spark, d, "documents").select(F.col("doc_id").alias("item"), F.lit("text").alias("format"), F.lit("utf-8").alias("charset"), F.encode("text", "utf-8").alias("raw"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("item"), F.lit("csv").alias("format"), F.lit("utf-8").alias("charset"), F.encode(F.concat_ws(",", F.col("event_id").cast("string"), "event_type", F.lit("")), "utf-8").alias("raw"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("item"), F.lit("html").alias("format"), F.lit("utf-8").alias("charset"), F.encode("html", "utf-8").alias("raw"))
    return text.union(rows).union(pages)


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"
_F.frame("src01_read_leaf", lambda spark, d: readers.extract_units(_items(spark, d).where("format <> 'html'")).where("text is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("units")),
         f"SELECT 'Line' AS kind, count(*) AS units FROM ({_LINES}) x WHERE line <> '' UNION ALL SELECT 'Cell', 2 * count(*) FROM events")
_F.frame("src04_html_reader", lambda spark, d: readers.extract_units(_items(spark, d).where("format = 'html'")).select("item", "state", "reason", "ordinal", "kind", "locator", F.sha2("text", 256).alias("digest")))
_F.frame("src12_resolve_locators", lambda spark, d: readers.resolve_locators(readers.extract_units(_items(spark, d).where("format = 'text'")).where("text is not null"), table(spark, d, "documents").where("split(text, '\n')[0] <> ''").select(F.col("doc_id").alias("item"), F.lit('{"line":0}').alias("locator"), F.col("doc_id").alias("position"))).select("item", "position", F.sha2("text", 256).alias("digest")),
         "SELECT doc_id AS item, doc_id AS position, sha256(string_split(text, chr(10))[1]) AS digest FROM documents WHERE string_split(text, chr(10))[1] <> ''")
_F.same("src24_vector_stage", "SELECT label AS segment, count(*) AS vectors, min(size(embedding)) AS dimension FROM embeddings GROUP BY label", "SELECT label AS segment, count(*) AS vectors, CAST(min(len(embedding)) AS INT) AS dimension FROM embeddings GROUP BY label")


def _json_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("base"), F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k").cast("int")).alias("k"), F.when(F.col("event_id") % 3 == 0, F.lit(1)).alias("a/b"))).alias("target"))


_F.frame("jsn04_json_diff", lambda spark, d: versions.json_diff(_json_pairs(spark, d)),
         "SELECT event_id AS id, '/k' AS pointer, props ->> '$.k' AS base, NULL::VARCHAR AS target FROM events WHERE event_id % 2 <> 0 UNION ALL SELECT event_id, '/a~1b', NULL, '1' FROM events WHERE event_id % 3 = 0")
_F.frame("dif10_metadata_diff", lambda spark, d: versions.json_diff(_json_pairs(spark, d)).groupBy("pointer").agg(F.count(F.lit(1)).alias("n")),
         "SELECT '/k' AS pointer, count(*) AS n FROM events WHERE event_id % 2 <> 0 UNION ALL SELECT '/a~1b', count(*) FROM events WHERE event_id % 3 = 0")
_F.frame("jsn05_canonical_json", lambda spark, d: versions.canonical_json(table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit('{"z": 1, "a": '), "props", F.lit("}")).alias("j")), "j"), "SELECT event_id AS id, '{\"a\":{\"k\":' || (props ->> '$.k') || '},\"z\":1}' AS canonical, true AS valid FROM events")
_F.frame("jsn06_parse_unique", lambda spark, d: versions.canonical_json(table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, F.lit('{"a":1,"a":2}')).otherwise(F.col("props")).alias("j")), "j").select("id", "valid"), "SELECT event_id AS id, event_id % 3 <> 0 AS valid FROM events")


def _tables(spark: SparkSession, d: str) -> DataFrame:
    """One table a nation: all its customers, with one name changed in the target, or a row more."""
    c = table(spark, d, "customer")
    row = lambda name: F.concat_ws(",", F.lpad("c_custkey", 6, "0"), name, "c_mktsegment")
    first = F.min("c_custkey")
    groups = c.groupBy("c_nationkey").agg(first.alias("first"))
    rows = c.join(F.broadcast(groups), "c_nationkey")
    changed = F.when((F.col("c_custkey") == F.col("first")) & (F.col("c_nationkey") % 2 == 0), "changed").otherwise(F.col("c_name"))
    lines = rows.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list(row("c_name"))), "\n").alias("base"), F.array_join(F.array_sort(F.collect_list(row(changed))), "\n").alias("target"))
    return lines.select(F.col("c_nationkey").alias("id"), "base", F.when(F.col("id") % 2 == 1, F.concat("target", F.lit("\nx,y,z"))).otherwise(F.col("target")).alias("target"))


_F.frame("dif03_csv_diff", lambda spark, d: versions.table_diff(_tables(spark, d)).select("id", "kind", "col"), "SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS id, CASE WHEN c_nationkey % 2 = 0 THEN 'Modified' ELSE 'Added' END AS kind, CAST(CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE -1 END AS INT) AS col FROM customer WHERE c_custkey < 500")
_F.frame("dif04_column_change", lambda spark, d: versions.table_diff(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat_ws("\n", F.concat_ws(",", "n_name", F.lit("a")), F.lit("p,q")).alias("base"), F.concat_ws("\n", F.concat_ws(",", "n_name", F.lit("new"), F.lit("a")), F.lit("p,other,q")).alias("target"))).select("id", "kind", "col"), "SELECT CAST(n_nationkey AS BIGINT) AS id, 'ColumnAdded' AS kind, CAST(1 AS INT) AS col FROM nation")
_F.same("dif08_change_validation", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN l_linestatus = 'O' WHEN 'R' THEN l_linestatus = 'F' ELSE true END AS valid FROM lineitem")
_F.same("dif11_cache_key", "SELECT o_orderkey, sha2(concat_ws('|', CAST(o_custkey AS STRING), CAST(o_orderkey AS STRING), 'profile-1'), 256) AS cache_key FROM orders", "SELECT o_orderkey, sha256(concat_ws('|', o_custkey, o_orderkey, 'profile-1')) AS cache_key FROM orders")
_F.frame("ver01_lifecycle", lambda spark, d: versions.lifecycle(table(spark, d, "events").select(F.col("user_id").alias("document"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "publish").when(F.col("event_id") % 3 == 1, "withdraw").otherwise("reopen").alias("operation"))),
         """WITH RECURSIVE e AS (SELECT user_id AS document, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 3 AS op FROM events),
f(document, n, state, refused) AS (SELECT document, 0::BIGINT, 'WORKING', 0::BIGINT FROM (SELECT DISTINCT document FROM e) x UNION ALL
SELECT f.document, e.n, CASE WHEN state = 'WORKING' AND op = 0 THEN 'PUBLISHED' WHEN state = 'PUBLISHED' AND op = 1 THEN 'WITHDRAWN' WHEN state = 'WITHDRAWN' AND op = 2 THEN 'WORKING' ELSE state END,
refused + CASE WHEN state = 'WORKING' AND op = 0 OR state = 'PUBLISHED' AND op = 1 OR state = 'WITHDRAWN' AND op = 2 THEN 0 ELSE 1 END FROM f JOIN e ON e.document = f.document AND e.n = f.n + 1)
SELECT document, arg_max(state, n) AS state, arg_max(refused, n) AS refused FROM f GROUP BY document""")


def _delivered(spark: SparkSession, d: str) -> DataFrame:
    events = delivery.stream_events(spark, d)
    attempts = events.select(F.col("user_id").alias("event_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "ok").when((F.col("event_type") == "error") & (F.col("event_id") % 4 == 0), "terminal").otherwise("retry").alias("result"))
    return delivery.run_delivery(attempts)


_F.frame("stm07_delivery_stream", _delivered,
         """WITH e AS (SELECT user_id AS event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_type = 'purchase' THEN 'ok' WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'terminal' ELSE 'retry' END AS r FROM events),
s AS (SELECT event_id, min(n) FILTER (WHERE r <> 'retry') AS done, max(n) AS total FROM e GROUP BY event_id)
SELECT s.event_id, CAST(least(coalesce(done, total), total, 8) AS INT) AS attempts, CASE WHEN done <= 8 AND e.r = 'ok' THEN 'DELIVERED' WHEN done <= 8 OR total >= 8 THEN 'DEAD_LETTER' ELSE 'PENDING' END AS outcome FROM s LEFT JOIN e ON e.event_id = s.event_id AND e.n = s.done""")
_F.frame("stx01_windowed_counts", lambda spark, d: delivery.windowed_counts(delivery.stream_events(spark, d)), "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
_F.same("stm09_breaker", "SELECT user_id, event_id, CASE WHEN fails >= 3 THEN 'Open' WHEN fails > 0 THEN 'HalfOpen' ELSE 'Closed' END AS breaker FROM (SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS fails FROM events) x")
_F.same("stm11_event_indexing", "SELECT user_id AS resource, max(event_id) AS generation, max(event_id) % 2 = 0 AS reused FROM events GROUP BY user_id")
_F.same("stm13_pin", "SELECT o_custkey AS source, max(o_orderkey) AS pinned_generation FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
_F.same("stm20_monitor_deltas", "SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) x WHERE before IS NULL OR before <> event_type")
_F.same("aud05_recovery", "SELECT user_id, CASE WHEN errors > 20 THEN 'Lost' WHEN confirmed = 0 THEN 'NoCheckpoint' WHEN confirmed < n THEN 'AuthenticThrough' ELSE 'Authentic' END AS verdict FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase') AS confirmed FROM events GROUP BY user_id) x")
_F.same("aud08_history_resolution", "SELECT event_id, CASE WHEN rn = 1 AND event_type = 'purchase' THEN 'Resolved' WHEN event_id BETWEEN 100 AND 300 THEN 'RecordLost' ELSE 'Unaudited' END AS verdict FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) x")
_F.same("aud10_envelope_validation", "SELECT event_id, get_json_object(props, '$.k') IS NOT NULL AND event_type IN ('click', 'view', 'purchase', 'error', 'signup') AS valid FROM events", "SELECT event_id, (props ->> '$.k') IS NOT NULL AND event_type IN ('click', 'view', 'purchase', 'error', 'signup') AS valid FROM events")
_F.same("cat05_allow_folder", "SELECT n_nationkey AS folder, bool_and(CASE WHEN n_regionkey % 2 = 0 THEN c_mktsegment <> '' ELSE c_custkey % 2 = 0 END) AS allowed FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
_F.same("cat09_withdrawal_eligibility", "SELECT o_custkey, NOT bool_or(o_orderstatus = 'P') AND bool_or(o_orderstatus = 'O') AS eligible FROM orders GROUP BY o_custkey")
_F.same("wrk08_findings", "SELECT o_custkey AS task, count(*) AS findings FROM orders WHERE o_orderstatus = 'F' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY o_custkey")
_F.same("knw07_assemble_claims", "SELECT l_partkey AS subject, CASE WHEN count(DISTINCT l_returnflag) > 2 THEN 'Conflicted' WHEN count(DISTINCT l_orderkey) < 2 THEN 'Unknown' ELSE 'Supported' END AS state, count(DISTINCT l_orderkey) AS refs FROM lineitem GROUP BY l_partkey")
_F.same("knw08_compile_projection", "SELECT p_partkey, p_brand IS NOT NULL AND p_type <> '' AND p_size > 0 AS complete, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) THEN 'related' ELSE 'isolated' END AS relations FROM part")
_F.same("knw10_probe_capability", "SELECT p_partkey, p_type IN ('ECONOMY', 'PROMO') AND p_size BETWEEN 5 AND 40 AS covers FROM part")
_F.same("knw14_supports_mode", "SELECT n_nationkey, array_contains(array('lexical', CASE WHEN n_regionkey = 1 THEN 'vector' ELSE 'graph' END), 'vector') AS supports FROM nation", "SELECT n_nationkey, n_regionkey = 1 AS supports FROM nation")
_F.same("knw16_remote_absence", "SELECT p_partkey AS native_id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
_F.same("knw18_model_identity", "SELECT label, sha2(concat_ws('|', 'model-1', CAST(label AS STRING), '64'), 256) AS model_id FROM (SELECT DISTINCT label FROM embeddings) x", "SELECT label, sha256(concat_ws('|', 'model-1', label, '64')) AS model_id FROM (SELECT DISTINCT label FROM embeddings) x")
_F.same("arr03_multiset_equality", "SELECT l_orderkey, array_sort(collect_list(l_suppkey)) = array_sort(collect_list(CASE WHEN l_orderkey % 3 = 0 AND l_linenumber = 1 THEN -1 ELSE l_suppkey END)) AS same FROM lineitem GROUP BY l_orderkey", "SELECT l_orderkey, l_orderkey % 3 <> 0 OR count(*) FILTER (WHERE l_linenumber = 1) = 0 AS same FROM lineitem GROUP BY l_orderkey")
_F.same("dat04_nanos_codec", "SELECT event_id, CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS DECIMAL(30,0)) * 1000 AS nanos FROM events", "SELECT event_id, CAST(epoch_us(ts) AS DECIMAL(30,0)) * 1000 AS nanos FROM events")
_F.same("mth07_checked_arithmetic", "SELECT doc_id, try_add(n_chars, 9223372036854775807) IS NULL AS overflows FROM documents", "SELECT doc_id, n_chars > 0 AS overflows FROM documents")
_F.same("evl03_fusion_metrics", "SELECT lang, round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 6) AS recall10, round(avg(1 / rank), 6) AS mrr FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) x GROUP BY lang")
_F.same("evl09_path_classification", "SELECT l_orderkey, CASE WHEN count(*) = 1 THEN 'Invalid' WHEN count(DISTINCT l_suppkey) = count(*) THEN 'Valid' ELSE 'FalseComposite' END AS class FROM lineitem GROUP BY l_orderkey")
_F.same("evl10_nary_composite", "SELECT a.l_orderkey, count(*) AS composites FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_returnflag = b.l_returnflag AND a.l_suppkey <> b.l_suppkey GROUP BY a.l_orderkey")


RESAMPLES = 10_000


def _bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Paired bootstrap of all documents; a fixed seed repeats it exactly.

    A resample's mean needs only how often each difference was drawn, which is multinomial.
    """
    counts = table(spark, d, "documents").groupBy((F.col("n_chars") % 7 - 3).alias("diff")).count().where("diff is not null").orderBy("diff").collect()  # at most 13 rows
    n = sum(r["count"] for r in counts)
    if not n:
        return spark.createDataFrame([(None, None)], "low double, high double")
    drawn = np.random.default_rng(11).multinomial(n, [r["count"] / n for r in counts], RESAMPLES)
    means = spark.createDataFrame([(float(m),) for m in drawn @ [r["diff"] for r in counts] / n], "m double")
    return means.agg(F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"))


_F.frame("evl05_paired_bootstrap", _bootstrap)
_F.same("qry02_discover_route", "SELECT lang, CASE WHEN count(*) FILTER (WHERE n_chars > 5000) > 0 THEN 'Sufficient' ELSE 'Unresolved' END AS outcome, count(*) AS examined FROM documents GROUP BY lang")
_F.same("qry03_scoped_discovery", "SELECT lang, count(*) AS visible FROM documents WHERE source NOT IN ('src0', 'src9') GROUP BY lang")
_F.same("lex01_lexical_schema", "SELECT p_partkey, lower(p_name) AS exact_name, size(split(p_name, ' ')) AS positions FROM part", "SELECT p_partkey, lower(p_name) AS exact_name, CAST(len(string_split(p_name, ' ')) AS INT) AS positions FROM part")
_F.same("lex07_index_build_checks", "SELECT source, count(*) = count(DISTINCT doc_id) AS unique_ids, min(length(text)) > 0 AS all_text FROM documents GROUP BY source")
