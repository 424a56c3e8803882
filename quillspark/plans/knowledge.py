"""Queries of knowledge resolution, delivery, audit, diff and evaluation.

Bindings: prices of line items by part are competing assertions, returns and
statuses are origins; events are observations, outbox events and audit rows;
consecutive turns of a conversation are base and target of a diff; equal labels
of embeddings are relevance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillspark.operators import audit, containment, evaluation, neighbours, ranking, resolve
from quillspark.plans.binding import Family
from quillspark.scratch import materialize
from quillspark.tables import table

_F = Family()
QUERIES, ORACLES = _F.queries, _F.oracles


def _assertions(spark: SparkSession, d: str) -> DataFrame:
    item = table(spark, d, "lineitem")
    origin = F.element_at(F.array(*map(F.lit, ("Authoritative", "Curated", "Observed", "Inferred", "Ignored"))), (F.col("l_orderkey") % 5 + 1).cast("int"))
    return item.select(F.col("l_partkey").alias("subject"), F.lit("tax").alias("predicate"), F.col("l_linenumber").alias("value"), origin.alias("origin"))


_POLICY = [("Authoritative", 3), ("Curated", 3), ("Observed", 2), ("Inferred", 4)]
_F.frame("knw01_resolve_assertions", lambda spark, d: resolve.resolve_assertions(_assertions(spark, d), spark.createDataFrame(_POLICY, "origin string, rank int")),
         """WITH a AS (SELECT l_partkey AS subject, l_linenumber AS value, CASE l_orderkey % 5 WHEN 0 THEN 'Authoritative' WHEN 1 THEN 'Curated' WHEN 2 THEN 'Observed' WHEN 3 THEN 'Inferred' END AS origin FROM lineitem),
r AS (SELECT *, CASE origin WHEN 'Observed' THEN 2 WHEN 'Inferred' THEN 4 ELSE 3 END AS rank, bool_or(origin IN ('Authoritative', 'Curated')) OVER (PARTITION BY subject) AS p FROM a WHERE origin IS NOT NULL),
k AS (SELECT * FROM r WHERE NOT (p AND origin = 'Inferred') QUALIFY rank = max(rank) OVER (PARTITION BY subject))
SELECT subject, 'tax' AS predicate, CASE WHEN count(DISTINCT value) > 1 THEN 'Conflict' ELSE 'Resolved' END AS state, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, max(rank) AS rank FROM k GROUP BY subject""")
_KINDS = ("IntegrityDigest", "CanonicalUri", "NameSimilarity", "SchemaSimilarity")
_F.frame("knw02_resolve_identity", lambda spark, d: resolve.resolve_identity(table(spark, d, "events").select(F.col("user_id").alias("pair"), F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 4 + 1).cast("int")).alias("kind"), (F.col("event_id") % 7 > 0).alias("supports")).where("pair % 3 = 0 or kind like '%Similarity'")),
         """SELECT user_id AS pair, CASE WHEN bool_or(event_id % 4 < 2 AND event_id % 7 > 0) AND bool_or(event_id % 4 < 2 AND event_id % 7 = 0) THEN 'Conflict' WHEN bool_or(event_id % 4 < 2 AND event_id % 7 > 0) THEN 'Resolved' WHEN bool_or(event_id % 4 < 2 AND event_id % 7 = 0) THEN 'Unresolved' WHEN bool_or(event_id % 4 >= 2 AND event_id % 7 > 0) THEN 'Provisional' ELSE 'Unresolved' END AS state
FROM events WHERE user_id % 3 = 0 OR event_id % 4 >= 2 GROUP BY user_id""")
_F.same("knw03_strong_kinds", "SELECT DISTINCT event_type, event_type IN ('purchase', 'signup') AS strong FROM events")
_F.frame("knw04_effective_state", lambda spark, d: resolve.effective_state(table(spark, d, "events").select(F.col("user_id").alias("resource"), F.col("event_id").alias("seq"), F.col("ts").alias("observed_at"), F.when(F.col("event_type") == "error", "Absent").otherwise("Present").alias("presence"), F.when(F.col("event_id") % 2 == 0, "QueryResult").otherwise("CompleteEnumeration").alias("coverage"), (F.col("event_id") % 4).alias("version"), F.col("event_type").alias("digest"))),
         """WITH e AS (SELECT user_id AS resource, event_id, ts, CASE WHEN event_type = 'error' THEN 'Absent' ELSE 'Present' END AS presence, event_id % 2 = 0 AS query, event_id % 4 AS version, event_type FROM events),
l AS (SELECT resource, presence, query FROM e QUALIFY row_number() OVER (PARTITION BY resource ORDER BY ts DESC, event_id DESC) = 1),
g AS (SELECT resource, bool_or(n > 1) AS c FROM (SELECT resource, version, count(DISTINCT event_type) AS n FROM e GROUP BY resource, version) x GROUP BY resource)
SELECT l.resource, CASE WHEN presence = 'Absent' AND query THEN 'Unknown' ELSE presence END AS presence, c AS integrity_conflict FROM l JOIN g USING (resource)""")


def _claims(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "nation").select(F.col("n_nationkey").alias("claim"), F.when(F.col("n_nationkey") % 9 == 0, "Conflicted").when(F.col("n_nationkey") % 4 == 0, "Unknown").otherwise("Supported").alias("state"))
    c = table(spark, d, "customer")
    role = F.when(F.col("c_custkey") % 97 == 0, "Contradicting").when(F.col("c_custkey") % 2 == 0, "Primary").otherwise("Contextual")
    evidence = c.select(F.col("c_nationkey").alias("claim"), role.alias("role"), (F.col("c_custkey") % 3 == 0).alias("is_summary"), F.concat(F.lit(" "), "c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, " ").otherwise("")).alias("origin"))
    return resolve.evidence_sufficiency(claims, evidence, 3)


_SUFFICIENT = """SELECT n_nationkey AS claim, CASE WHEN n_nationkey % 9 = 0 OR against THEN 'Conflicted' WHEN coalesce(origins, 0) < 3 THEN 'Insufficient' WHEN n_nationkey % 4 = 0 THEN 'Unresolved' ELSE 'Sufficient' END AS verdict
FROM nation LEFT JOIN (SELECT c_nationkey, count(DISTINCT CASE WHEN c_custkey % 97 <> 0 AND c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN c_mktsegment END) AS origins, bool_or(c_custkey % 97 = 0 AND c_custkey % 3 <> 0) AS against FROM customer GROUP BY c_nationkey) e ON c_nationkey = n_nationkey"""
_F.frame("knw05_evidence_sufficiency", _claims, _SUFFICIENT)
_F.frame("knw06_direct_evidence", lambda spark, d: table(spark, d, "customer").select("c_custkey", resolve.direct_evidence(F.when(F.col("c_custkey") % 2 == 0, "Primary").otherwise("Contextual"), F.col("c_custkey") % 3 == 0, F.when(F.col("c_custkey") % 5 == 0, " ").otherwise("x")).alias("direct")), "SELECT c_custkey, c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS direct FROM customer")
_F.frame("dat01_freshness", lambda spark, d: table(spark, d, "events").select("event_id", resolve.freshness(F.when(F.col("event_id") % 6 > 0, F.col("event_id") * 10), F.lit(80000), F.when(F.col("event_id") % 5 > 0, F.lit(30000))).alias("state")),
         "SELECT event_id, CASE WHEN event_id % 6 = 0 OR event_id % 5 = 0 OR event_id * 10 > 80000 THEN 'Unknown' WHEN 80000 - event_id * 10 > 30000 THEN 'Stale' ELSE 'Fresh' END AS state FROM events")
_F.frame("dat02_effective_at", lambda spark, d: table(spark, d, "orders").select("o_orderkey", resolve.effective_at(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate")), F.when(F.col("o_orderkey") % 2 > 0, F.expr("o_orderdate + interval '30' day")), F.expr("timestamp_ntz '1998-01-01 00:00:00'")).alias("state")),
         "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'Unknown' WHEN (o_orderkey % 3 = 0 OR o_orderdate <= TIMESTAMP '1998-01-01') AND (o_orderkey % 2 = 0 OR TIMESTAMP '1998-01-01' < o_orderdate + INTERVAL 30 DAY) THEN 'True' ELSE 'False' END AS state FROM orders")
_F.same("dat03_to_micros", "SELECT event_id, unix_micros(CAST(ts AS TIMESTAMP)) AS us FROM events", "SELECT event_id, epoch_us(ts) AS us FROM events")
_F.same("dat05_due_overdue", "SELECT o_orderkey, CASE WHEN o_orderdate <= TIMESTAMP '1998-01-01 00:00:00' THEN 'Overdue' WHEN o_orderdate <= TIMESTAMP '1998-01-08 00:00:00' THEN 'DueSoon' END AS attention FROM orders")
_F.same("dat07_epoch_seconds", "SELECT event_id, CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS DOUBLE) / 1000000 AS seconds FROM events", "SELECT event_id, epoch_us(ts)::DOUBLE / 1000000 AS seconds FROM events")

# Delivery: state of every event at a fixed time, and the steps of a cycle.
_OUTBOX = """SELECT event_id, ts AS available_at, event_id % 9 AS attempts, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL '6' HOUR END AS lease_until, event_type = 'purchase' AS delivered, event_type = 'error' AS dead FROM events"""
_NOW = "TIMESTAMP '2024-01-05 00:00:00'"
_STATE = f"CASE WHEN delivered THEN 'DELIVERED' WHEN dead THEN 'DEAD_LETTER' WHEN lease_until > {_NOW} THEN 'IN_FLIGHT' ELSE 'PENDING' END"
_CLAIM = f"NOT delivered AND NOT dead AND available_at <= {_NOW} AND (lease_until IS NULL OR lease_until <= {_NOW}) AND attempts < 8"
_F.same("stm01_processing_state", f"SELECT event_id, {_STATE} AS state, NOT delivered AND NOT dead AND lease_until <= {_NOW} AS recovery_pending FROM ({_OUTBOX}) o")
_F.same("stm02_claim", f"SELECT event_id, attempts + 1 AS attempt, 8 AS attempt_limit FROM ({_OUTBOX}) o WHERE {_CLAIM} ORDER BY available_at, event_id LIMIT 32")
_F.same("src22_outbox_scan", f"SELECT event_id, available_at FROM ({_OUTBOX}) o WHERE NOT delivered AND NOT dead ORDER BY available_at, event_id LIMIT 200")
_F.same("stm03_renew", f"SELECT event_id, CASE WHEN lease_until > {_NOW} AND event_id % 6 = 0 THEN 'Held' ELSE 'Lost' END AS fence FROM ({_OUTBOX}) o WHERE lease_until IS NOT NULL")
_F.same("stm04_settle_success", f"SELECT event_id, CASE WHEN lease_until > {_NOW} AND event_id % 6 = 0 AND NOT delivered AND NOT dead THEN 'Settled' ELSE 'Lost' END AS fence FROM ({_OUTBOX}) o")
_F.same("stm05_settle_failure", f"SELECT event_id, CASE WHEN attempts + 1 >= 8 OR event_id % 50 = 0 THEN 'DEAD_LETTER' ELSE 'RETRY' END AS outcome, CAST(CASE WHEN attempts + 1 >= 8 OR event_id % 50 = 0 THEN NULL ELSE least(300, pow(2, attempts)) END AS BIGINT) AS delay_s FROM ({_OUTBOX}) o WHERE {_CLAIM}")
_F.same("stm06_reap_exhausted", f"SELECT event_id FROM ({_OUTBOX}) o WHERE NOT delivered AND NOT dead AND attempts >= 8 AND lease_until <= {_NOW} ORDER BY available_at, event_id LIMIT 100")
_F.same("stm10_idempotent_apply", "SELECT operation, CASE WHEN digests > 1 THEN 'conflict' WHEN n > 1 THEN 'replayed' ELSE 'applied' END AS outcome FROM (SELECT user_id AS operation, count(*) AS n, count(DISTINCT event_type) AS digests FROM events GROUP BY user_id) x")
_F.same("stm12_generation_lifecycle", "SELECT c_custkey AS source, o_orderkey AS generation, CASE WHEN o_orderstatus = 'F' THEN 'Failed' WHEN row_number() OVER (PARTITION BY c_custkey, o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 'Current' ELSE 'Retired' END AS state FROM customer JOIN orders ON o_custkey = c_custkey")
_F.same("stm14_gc", "SELECT o_orderkey AS generation FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS age FROM orders) x WHERE age > 3 AND NOT EXISTS (SELECT 1 FROM events WHERE event_id = o_orderkey AND event_type = 'click')")
_F.same("stm15_copy_and_delta", "SELECT p_partkey AS k, 'base' AS origin FROM part WHERE p_partkey % 10 <> 3 AND p_partkey % 10 <> 4 UNION ALL SELECT p_partkey, 'replaced' FROM part WHERE p_partkey % 10 = 4")
_F.same("stm16_build_reuse", "SELECT d.doc_id, CASE WHEN e.doc_id IS NULL THEN 'embed' ELSE 'reuse' END AS action FROM documents d LEFT JOIN (SELECT min(doc_id) AS doc_id, text FROM documents WHERE doc_id % 2 = 0 GROUP BY text) e ON e.text = d.text")
_F.same("stm17_scope_epoch", "SELECT c_custkey, c_custkey % 7 >= c_nationkey % 7 AS published FROM customer")
_F.same("stm18_expiry_cache", "SELECT event_id, least(600, CAST(value AS INT) * 10, 300) AS ttl, least(600, CAST(value AS INT) * 10, 300) > event_id % 400 AS live FROM (SELECT event_id, floor(value) AS value FROM events) e")
_F.same("stm19_scheduled_publication", f"SELECT event_id FROM ({_OUTBOX}) o WHERE NOT delivered AND NOT dead AND available_at <= {_NOW}")


def _audit_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    return e.select(F.col("user_id").alias("log"), seq.alias("seq"), F.lpad(F.lower(F.hex("event_id")), 32, "0").alias("event"), F.col("props").alias("envelope"))


_CHAIN = """WITH RECURSIVE e AS (SELECT user_id AS log, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, lpad(lower(hex(event_id)), 32, '0') AS event, sha256(props) AS digest FROM events),
c(log, seq, event, digest, chain) AS (SELECT log, 0::BIGINT, '', '', sha256('kp-audit-chain-genesis-v1') FROM (SELECT DISTINCT log FROM e) l
UNION ALL SELECT e.log, e.seq, e.event, e.digest, sha256(CAST('kp-audit-chain-v1' AS BLOB) || unhex(c.chain) || unhex(lpad(hex(e.seq), 16, '0')) || unhex(e.event) || unhex(e.digest)) FROM c JOIN e ON e.log = c.log AND e.seq = c.seq + 1)
SELECT log, seq, event, digest, chain FROM c WHERE seq > 0"""
_F.frame("aud01_chain", lambda spark, d: audit.build_chain(_audit_events(spark, d)), _CHAIN)
_F.frame("win08_running_fold", lambda spark, d: audit.build_chain(_audit_events(spark, d)).groupBy("log").agg(F.max_by("chain", "seq").alias("head")), f"SELECT log, arg_max(chain, seq) AS head FROM ({_CHAIN}) x GROUP BY log")
_F.frame("aud02_envelope_digest", lambda spark, d: table(spark, d, "events").select("event_id", audit.envelope_digest(F.col("props")).alias("digest")), "SELECT event_id, sha256(props) AS digest FROM events")


def _export(spark: SparkSession, d: str) -> DataFrame:
    """The chain as exported, with one link of every tenth log damaged."""
    chain = audit.build_chain(_audit_events(spark, d)).join(_audit_events(spark, d).select("log", "seq", "envelope"), ["log", "seq"])
    w = Window.partitionBy("log").orderBy("seq")
    damaged = F.when((F.col("log") % 10 == 0) & (F.col("seq") == 3), F.sha2("chain", 256)).otherwise(F.col("chain"))
    chain = chain.withColumn("prev_chain", F.coalesce(F.lag("chain").over(w), F.sha2(F.lit(audit.GENESIS), 256)))
    return chain.withColumn("chain", damaged)


_F.frame("aud03_verify_export", lambda spark, d: audit.verify_chain(_export(spark, d)), "SELECT user_id AS log, count(*) AS rows, CASE WHEN user_id % 10 = 0 AND count(*) >= 3 THEN 3::BIGINT END AS first_bad FROM events GROUP BY user_id")
_F.same("aud04_checkpoint_compare", "SELECT user_id, CASE WHEN checkpoint_seq > head THEN 'StoreBehind' WHEN checkpoint_seq = head THEN 'Match' ELSE 'Ahead' END AS outcome FROM (SELECT user_id, count(*) AS head, user_id % 200 + 50 AS checkpoint_seq FROM events GROUP BY user_id) x")
_F.same("aud06_overall_class", "SELECT event_type, CASE event_type WHEN 'error' THEN 'Rejected' WHEN 'click' THEN 'Review' ELSE 'Authentic' END AS class, count(*) AS n FROM events GROUP BY event_type")


def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    deliveries = e.where("event_id % 13 <> 0").select(F.col("event_id").alias("event"), F.when(F.col("event_id") % 3 == 0, "delivered").when(F.col("event_id") % 3 == 1, "pending").otherwise("quarantined").alias("state"), F.sha2("props", 256).alias("digest"))
    receipts = e.where("event_id % 5 <> 0").select(F.col("event_id").alias("event"), F.sha2(F.when(F.col("event_id") % 101 == 0, F.lit("x")).otherwise(F.col("props")), 256).alias("digest"))
    return audit.reconcile(deliveries, receipts)


_RECONCILED = """SELECT event_id AS event, CASE WHEN event_id % 13 = 0 THEN 'store_only' WHEN event_id % 5 <> 0 AND event_id % 101 = 0 THEN 'digest_mismatch' WHEN event_id % 3 = 0 AND event_id % 5 = 0 THEN 'delivered_missing' WHEN event_id % 3 = 0 THEN 'confirmed'
WHEN event_id % 3 = 2 AND event_id % 5 <> 0 THEN 'quarantined_present' WHEN event_id % 3 = 2 THEN 'quarantined' WHEN event_id % 5 <> 0 THEN 'pending_present' ELSE 'pending' END AS class FROM events WHERE event_id % 13 <> 0 OR event_id % 5 <> 0"""
_F.frame("aud07_reconcile", _reconciled, _RECONCILED)
_F.frame("jon19_full_outer_classify", lambda spark, d: _reconciled(spark, d).groupBy("class").agg(F.count(F.lit(1)).alias("n")), f"SELECT class, count(*) AS n FROM ({_RECONCILED}) x GROUP BY class")
_F.frame("aud09_counts_alarms", lambda spark, d: _reconciled(spark, d).groupBy("class").agg(F.count(F.lit(1)).alias("n")).withColumn("alarm", F.col("class").isin("digest_mismatch", "delivered_missing", "store_only")), f"SELECT class, count(*) AS n, class IN ('digest_mismatch', 'delivered_missing', 'store_only') AS alarm FROM ({_RECONCILED}) x GROUP BY class")
_EXPIRED = "SELECT user_id, sha256(CAST('kp-audit-expired-set-v1' AS BLOB) || unhex(string_agg(lpad(hex(event_id), 16, '0'), '' ORDER BY event_id))) AS digest FROM events WHERE event_type = 'error' GROUP BY user_id"
_F.frame("aud12_expired_set_digest", lambda spark, d: table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(audit.expired_set_digest(F.collect_list("event_id")).alias("digest")), _EXPIRED)

_F.same("arr01_dedup_keeping_order", "SELECT conv_id, array_join(array_distinct(transform(array_sort(collect_list(struct(turn, role))), x -> x.role)), ',') AS roles FROM conversations GROUP BY conv_id", "SELECT conv_id, string_agg(role, ',' ORDER BY first_turn) AS roles FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY conv_id, role) x GROUP BY conv_id")
_F.same("arr02_sorted_distinct", "SELECT l_orderkey, array_join(array_sort(collect_set(l_suppkey)), ',') AS suppliers FROM lineitem GROUP BY l_orderkey", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS suppliers FROM lineitem GROUP BY l_orderkey")
_F.same("arr04_unnest", "SELECT p_partkey, word FROM part LATERAL VIEW explode(split(p_name, ' ')) w AS word", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
_F.same("map01_facet_lookup", "SELECT p_partkey, try_element_at(map('brand', p_brand, 'type', p_type), CASE WHEN p_partkey % 2 = 0 THEN 'brand' ELSE 'colour' END) AS facet FROM part", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS facet FROM part")
_F.same("map02_lens_selection", "SELECT p_partkey, array_join(array_sort(map_keys(map_filter(map('brand', p_brand, 'type', p_type, 'size', CAST(p_size AS STRING)), (k, v) -> array_contains(array('brand', 'size'), k)))), ',') AS kept FROM part", "SELECT p_partkey, 'brand,size' AS kept FROM part")
_F.same("jsn01_field_text", "SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, props ->> '$.k' AS k FROM events")
_F.same("jsn02_build_object", "SELECT o_orderkey, to_json(named_struct('id', o_orderkey, 'status', o_orderstatus)) AS details FROM orders", "SELECT o_orderkey, '{\"id\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}' AS details FROM orders")
_F.same("jsn03_typeof", "SELECT event_id, schema_of_variant(variant_get(parse_json(props), '$.k')) AS kind FROM events", "SELECT event_id, 'BIGINT' AS kind FROM events")

# Diff of consecutive turns of a conversation, by lines.
_PAIRS = "SELECT a.conv_id, a.turn, a.text AS base, b.text AS target FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"
# Equal lines at the start and the end: the place of the first unequal pair, in one pass.
_F.same("dif02_text_diff", f"""SELECT conv_id, turn, CASE WHEN base = target THEN 'None' WHEN nb - p - s = 1 AND nt - p - s = 1 THEN 'Modified' WHEN nb - p - s = 0 THEN 'Added' WHEN nt - p - s = 0 THEN 'Removed' ELSE 'AmbiguousAlignment' END AS change, p AS prefix, s AS suffix FROM (
  SELECT *, CAST(coalesce(nullif(array_position(zip_with(slice(reverse(b), 1, least(nb, nt) - p), slice(reverse(t), 1, least(nb, nt) - p), (x, y) -> x = y), false), 0) - 1, least(nb, nt) - p) AS INT) AS s FROM (
  SELECT *, CAST(coalesce(nullif(array_position(zip_with(slice(b, 1, least(nb, nt)), slice(t, 1, least(nb, nt)), (x, y) -> x = y), false), 0) - 1, least(nb, nt)) AS INT) AS p FROM (SELECT *, split(base, '\\n') AS b, split(target, '\\n') AS t, size(split(base, '\\n')) AS nb, size(split(target, '\\n')) AS nt FROM ({_PAIRS}) x) y) z) w""",
        f"""SELECT conv_id, turn, CASE WHEN base = target THEN 'None' WHEN nb - p - s = 1 AND nt - p - s = 1 THEN 'Modified' WHEN nb - p - s = 0 THEN 'Added' WHEN nt - p - s = 0 THEN 'Removed' ELSE 'AmbiguousAlignment' END AS change, CAST(p AS INT) AS prefix, CAST(s AS INT) AS suffix FROM (
  SELECT *, len(list_filter(range(0, least(nb, nt) - p + 1), lambda k: k = 0 OR b[nb - k + 1:nb] = t[nt - k + 1:nt])) - 1 AS s FROM (
  SELECT *, len(list_filter(range(0, least(nb, nt) + 1), lambda k: k = 0 OR b[1:k] = t[1:k])) - 1 AS p FROM (SELECT *, string_split(base, chr(10)) AS b, string_split(target, chr(10)) AS t, len(string_split(base, chr(10))) AS nb, len(string_split(target, chr(10))) AS nt FROM ({_PAIRS}) x) y) z) w""")
_F.same("dif05_duplicate_rows", "SELECT doc_id, size(split(text, '\\n')) > size(array_distinct(split(text, '\\n'))) AS duplicates FROM documents", "SELECT doc_id, len(string_split(text, chr(10))) > len(list_distinct(string_split(text, chr(10)))) AS duplicates FROM documents")
_ALIGN = """WITH b AS (SELECT l_orderkey AS path, l_linenumber AS ordinal, min(l_partkey) AS fp, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_linenumber), t AS (SELECT l_orderkey AS path, l_linenumber AS ordinal, min(l_partkey) AS fp, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey, l_linenumber),
p1 AS (SELECT b.path, b.ordinal AS base, t.ordinal AS target, 1 AS pass FROM b JOIN t ON b.path = t.path AND b.ordinal = t.ordinal WHERE b.n = 1 AND t.n = 1),
rb AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.path = b.path AND p1.base = b.ordinal)), rt AS (SELECT t.* FROM t WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.path = t.path AND p1.target = t.ordinal)),
ub AS (SELECT path, min(ordinal) AS ordinal FROM rb GROUP BY path HAVING count(*) = 1), ut AS (SELECT path, min(ordinal) AS ordinal FROM rt GROUP BY path HAVING count(*) = 1)
SELECT path, base, target, pass FROM p1 UNION ALL SELECT ub.path, ub.ordinal, ut.ordinal, 2 FROM ub JOIN ut ON ub.path = ut.path"""
_F.same("dif01_align_items", _ALIGN)
_F.same("jon20_alignment_join", f"SELECT pass, count(*) AS n FROM ({_ALIGN}) x GROUP BY pass")
_F.same("dif09_comparison_table", "SELECT 1 AS section, l_orderkey AS k, 'change' AS kind FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1 UNION ALL SELECT 2, l_orderkey, 'unverified' FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1 UNION ALL SELECT 3, o_orderkey, 'ancillary' FROM orders WHERE o_orderstatus = 'P'")
_F.same("dif12_manifest_identity", "SELECT l_orderkey, sha2(array_join(transform(array_sort(collect_list(struct(l_linenumber, l_partkey, l_suppkey))), x -> concat(CAST(x.l_linenumber AS STRING), ':', CAST(x.l_partkey AS STRING), ':', CAST(x.l_suppkey AS STRING))), ';'), 256) AS digest FROM lineitem GROUP BY l_orderkey", "SELECT l_orderkey, sha256(string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ';' ORDER BY l_linenumber, l_partkey, l_suppkey)) AS digest FROM lineitem GROUP BY l_orderkey")
_F.same("fpr01_fingerprint", "SELECT doc_id, sha2(text, 256) AS fingerprint FROM documents", "SELECT doc_id, sha256(text) AS fingerprint FROM documents")
_F.same("fpr04_authority_migration", "SELECT p_brand, bool_and(p_size >= 2) AS migrates, count(*) FILTER (WHERE p_size < 2) AS missing FROM part GROUP BY p_brand")
_F.same("ver02_revision_number", "SELECT o_custkey, o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS major FROM orders")

# Evaluation: neighbours of a vector of equal label are relevant.
_RANKED = "SELECT q, id, label = qlabel AS relevant, CAST(row_number() OVER (PARTITION BY q ORDER BY similarity DESC, id) AS INT) AS rank FROM (SELECT a.vec_id AS q, b.vec_id AS id, a.label AS qlabel, b.label, {dot} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id) x"
_D_DOT = "round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)), 6)"
_SCORES = "SELECT q, count(*) FILTER (WHERE relevant AND rank <= 1) AS hits1, count(*) FILTER (WHERE relevant AND rank <= 10) AS hits10, round(coalesce(CAST(1 AS DOUBLE) / min(CASE WHEN relevant THEN rank END), 0), 6) AS rr, round(sum(CASE WHEN relevant AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg10 FROM ({0}) r GROUP BY q"
_SUMMARY = "SELECT q % 2 AS split, count(*) AS questions, round(avg(rr), 6) AS mrr, round(avg(ndcg10), 6) AS ndcg10 FROM ({0}) s GROUP BY q % 2 UNION ALL SELECT -1, count(*), round(avg(rr), 6), round(avg(ndcg10), 6) FROM ({0}) s"


def _question_scores(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("values"))
    return neighbours.question_scores(vectors, F.col("id") % 20 == 0)


def _summary(spark: SparkSession, d: str) -> DataFrame:
    scores = materialize(_question_scores(spark, d), "scores").withColumn("split", F.col("q") % 2)
    means = [F.count(F.lit(1)).alias("questions"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg10"), 6).alias("ndcg10")]
    return scores.groupBy("split").agg(*means).union(scores.agg(*means).select(F.lit(-1).cast("long").alias("split"), "questions", "mrr", "ndcg10"))


_F.frame("evl01_question_scores", _question_scores, _SCORES.format(_RANKED.format(dot=_D_DOT)))
_F.frame("evl02_summarize", _summary, _SUMMARY.format(_SCORES.format(_RANKED.format(dot=_D_DOT))))


def _signs(spark: SparkSession, d: str) -> DataFrame:
    even = F.count(F.when(F.col("n_chars") % 2 == 0, 1))
    return evaluation.sign_tests(table(spark, d, "documents").groupBy("lang").agg(even.alias("wins"), F.count(F.lit(1)).alias("n")), "lang")


_F.frame("evl06_sign_test", _signs,
         "SELECT lang, wins, n, round(least(1, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) FROM range(0, least(wins, n - wins) + 1) g(k))), 6) AS p FROM (SELECT lang, count(*) FILTER (WHERE n_chars % 2 = 0) AS wins, count(*) AS n FROM documents GROUP BY lang) x")
_F.same("evl07_hash_split", "SELECT doc_id, CASE WHEN aggregate(split(sha2(CAST(doc_id AS STRING), 256), ''), 0, (a, c) -> CASE WHEN c = '' THEN a ELSE (a * 16 + CAST(conv(c, 16, 10) AS INT)) % 10 END) < 3 THEN 'tuning' ELSE 'final' END AS split FROM documents",
        "SELECT doc_id, CASE WHEN list_reduce(list_prepend(0, list_transform(range(1, 65), lambda i: strpos('0123456789abcdef', substr(sha256(doc_id::VARCHAR), i, 1)) - 1)), lambda a, c: (a * 16 + c) % 10) < 3 THEN 'tuning' ELSE 'final' END AS split FROM documents")
_F.same("evl08_scenario", "SELECT user_id, CASE WHEN errors > 0 AND clicks = 0 THEN 'Source' WHEN purchases = 0 THEN 'Retrieval' WHEN errors > clicks THEN 'Safety' ELSE 'None' END AS failing FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events GROUP BY user_id) x")
_F.same("evl11_report", "SELECT count(*) AS scenarios, count(*) FILTER (WHERE event_type = 'error') AS failures, CAST(sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS BIGINT) AS slow, count(DISTINCT user_id) AS subjects FROM events")
_F.same("evl12_question_terms", "SELECT term, min(doc_id) AS doc_id FROM (SELECT DISTINCT doc_id, term FROM documents LATERAL VIEW explode(regexp_extract_all(text, '[A-Za-z]{6,14}', 0)) t AS term) x GROUP BY term HAVING count(*) = 1", "SELECT term, min(doc_id) AS doc_id FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{6,14}')) AS term FROM documents) x GROUP BY term HAVING count(*) = 1")

# Sources, routing and composed queries.
_F.same("src03_csv_units", "SELECT event_id, pos AS field, value FROM (SELECT event_id, split(concat_ws(',', CAST(event_id AS STRING), event_type, '', props), ',') AS r FROM events) x LATERAL VIEW posexplode(r) f AS pos, value WHERE value <> ''", "SELECT event_id, CAST(i - 1 AS INT) AS field, r[i] AS value FROM (SELECT event_id, r, unnest(range(1, len(r) + 1)) AS i FROM (SELECT event_id, string_split(concat_ws(',', event_id::VARCHAR, event_type, '', props), ',') AS r FROM events) x) y WHERE r[i] <> ''")
_F.same("src11_coverage_verdict", "SELECT doc_id, CASE WHEN reasons = 0 THEN 'Supported' WHEN n_chars < 200 THEN 'Unsupported' ELSE 'Partial' END AS verdict FROM (SELECT doc_id, n_chars, CASE WHEN contains(text, '|') THEN 1 ELSE 0 END AS reasons FROM documents) x")
_F.same("src13_budget_meter", "SELECT source, CAST(sum(n_chars) AS BIGINT) AS charged, sum(n_chars) <= 120000 AS within, max(n_chars) <= 20000 AS each_within FROM documents GROUP BY source")
_DETECT = "SELECT page_id, CASE WHEN html_is THEN 'html' WHEN zip_is THEN 'zip' WHEN pdf_is THEN 'pdf' ELSE 'text' END AS format FROM (SELECT page_id, {0}(lower(html), '<!doctype html') AS html_is, {0}(html, 'PK') AS zip_is, {0}(html, '%PDF') AS pdf_is FROM pages) x"
_F.same("src14_format_detection", _DETECT.format("startswith"), _DETECT.format("starts_with"))
_F.same("src16_html_sniff", "SELECT doc_id, contains(lower(text), '<html') OR contains(lower(text), '<!doctype') AS anywhere FROM documents UNION ALL SELECT page_id, startswith(ltrim(lower(html)), '<!doctype html') FROM pages", "SELECT doc_id, contains(lower(text), '<html') OR contains(lower(text), '<!doctype') AS anywhere FROM documents UNION ALL SELECT page_id, starts_with(ltrim(lower(html)), '<!doctype html') FROM pages")
_F.same("src17_csv_sniff", "SELECT doc_id, contains(split_part(text, chr(10), 1), ',') OR contains(split_part(text, chr(10), 1), ';') OR contains(split_part(text, chr(10), 1), chr(9)) AS csv FROM documents")
_F.same("src18_snapshot_scan", "SELECT o_orderkey AS version_id, o_custkey AS document_id, c_name, f.first_end FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first_end FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) f ON f.l_orderkey = o_orderkey")
_F.same("src19_authoritative_items", "SELECT o_orderkey, l_linenumber, p_name FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'N') i ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey")
_F.same("src20_visibility", "SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'PublicationEnded' WHEN o_orderstatus = 'O' AND rn = 1 THEN 'CurrentPublished' WHEN o_orderstatus = 'O' THEN 'HistoricalPublished' WHEN o_orderstatus = 'F' THEN 'Withdrawn' ELSE 'WorkingAuthoring' END AS visibility FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) x")
_F.same("src21_relations", "SELECT o_orderkey AS version, 'document_has_version' AS relation, 2 AS participants FROM orders UNION ALL SELECT o_orderkey, 'document_current_placement', 3 FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 17 <> 0")
_F.same("rte01_source_routing", "SELECT source, n, CASE WHEN source = 'src0' THEN 'Required' WHEN source IN ('src1', 'src2') THEN 'Preferred' ELSE 'Other' END AS preference, CASE WHEN n > 55 THEN 'Unsupported' WHEN n > 50 THEN 'Unresolved' ELSE 'Planned' END AS state FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) x")
_F.same("rte02_retriever_planning", "SELECT source, kind, priority FROM (SELECT DISTINCT source FROM documents) s JOIN (SELECT 'directory' AS kind, 1 AS priority UNION ALL SELECT 'structured', 2 UNION ALL SELECT 'lexical', 3 UNION ALL SELECT 'vector', 4 UNION ALL SELECT 'graph', 5) k ON priority <= 3 OR source IN ('src0', 'src1')")
_F.same("rte03_action_state", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'RouteUnresolved' WHEN doc_id % 5 = 0 THEN 'AdapterMissing' WHEN doc_id % 3 = 0 THEN 'MissingInput' ELSE 'Planned' END AS state FROM documents")
_F.same("rte04_presence", "SELECT doc_id, CASE WHEN n_chars > 0 THEN 'Present' WHEN doc_id % 2 = 0 THEN 'Absent' ELSE 'Unknown' END AS presence FROM documents")
_F.frame("exe01_visible_ranking", lambda spark, d: ranking.ranked(table(spark, d, "documents").where("source NOT IN ('src2', 'src4')").select("doc_id", "n_chars"), [F.col("n_chars").desc(), F.col("doc_id")]).select("doc_id", F.col("rank").cast("int").alias("rank")),
         "SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS INT) AS rank FROM documents WHERE source NOT IN ('src2', 'src4')")
_F.same("qry01_search_route", "WITH f AS (SELECT doc_id, n_chars FROM documents WHERE contains(text, 'attion') AND source <> 'src3' ORDER BY n_chars DESC, doc_id LIMIT 11) SELECT doc_id, rank, (SELECT count(*) FROM f) > 10 AS more FROM (SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS INT) AS rank FROM f) x WHERE rank <= 10",
        "SELECT doc_id, rank, total > 10 AS more FROM (SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS INT) AS rank, count(*) OVER () AS total FROM documents WHERE contains(text, 'attion') AND source <> 'src3') x WHERE rank <= 10")
_F.same("qry04_source_browse", "SELECT source, count(*) AS documents FROM documents WHERE source > 'src1' GROUP BY source ORDER BY source LIMIT 10")
_F.same("qry05_resource_read", "SELECT doc_id, source, lang, n_chars FROM documents WHERE doc_id = 42")
_F.same("qry06_public_projection", "SELECT source, count(*) AS qualified, least(count(*), 50) AS shown, CASE WHEN count(*) > 50 THEN 'Bounded' ELSE 'Complete' END AS completeness FROM documents GROUP BY source")
_F.same("qry07_absence_proof", "SELECT source, CASE WHEN max(CASE WHEN contains(text, 'idiot') THEN 1 ELSE 0 END) = 1 THEN 'Present' WHEN min(n_chars) > 0 THEN 'Absent' ELSE 'Unknown' END AS verdict FROM documents GROUP BY source")
_F.frame("qry08_exact_text_evidence", lambda spark, d: table(spark, d, "benchmark").select("item_id").join(containment.containing(table(spark, d, "benchmark"), table(spark, d, "documents")), "item_id", "left").groupBy("item_id").agg(F.count("doc_id").alias("supporting")),
         "SELECT item_id, count(doc_id) AS supporting FROM benchmark LEFT JOIN documents ON contains(documents.text, benchmark.text) GROUP BY item_id")
_F.same("knw09_materialization", "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'Denied' WHEN p_size < 5 THEN 'MetadataOnly' WHEN p_size < 25 THEN 'Probed' ELSE 'Materialized' END AS state FROM part")
_F.same("knw11_next_action", "SELECT c_nationkey, c_custkey AS action FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment = 'BUILDING' DESC, c_acctbal DESC, c_custkey) AS rn FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 400000)) x WHERE rn = 1")
_F.frame("knw12_cost_order", lambda spark, d: ranking.ranked(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), [F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0), F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey")], "position").select("p_partkey", F.col("position").cast("int").alias("position")),
         "SELECT p_partkey, CAST(row_number() OVER (ORDER BY CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END, p_size, p_retailprice, p_partkey) AS INT) AS position FROM part")
_F.same("knw13_context_compile", "SELECT source, CAST(sum(octet_length(text)) AS BIGINT) AS bytes, sum(octet_length(text)) <= 200000 AS within FROM documents WHERE doc_id % 3 = 0 GROUP BY source", "SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes, sum(strlen(text)) <= 200000 AS within FROM documents WHERE doc_id % 3 = 0 GROUP BY source")
_F.same("knw15_bind_if_absent", "SELECT l_partkey, CASE WHEN count(DISTINCT l_suppkey) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'unchanged' ELSE 'inserted' END AS outcome FROM lineitem GROUP BY l_partkey")
_F.same("knw17_unit_validation", "SELECT conv_id, count(*) = max(turn) + 1 AND min(turn) = 0 AS contiguous, count(*) = count(DISTINCT turn) AS distinct_ordinals FROM conversations GROUP BY conv_id")
