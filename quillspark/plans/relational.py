"""Relational operators of the catalog: joins, aggregates, rankings, pages, set operations.

Bindings: a customer's orders are the versions of a document (ordered by date),
status F, O, P are the lifecycle WITHDRAWN, PUBLISHED, WORKING; region, nation
and customer are a folder hierarchy; market segments are access scopes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.operators import ranking
from quillspark.operators.skew import distinct_not_in
from quillspark.plans.binding import Family
from quillspark.tables import table

_F = Family()
QUERIES, ORACLES = _F.queries, _F.oracles


def _numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their position in ``order`` as int."""
    return ranking.ranked(df, order, name).withColumn(name, F.col(name).cast("int"))


#: Versions of a document, numbered in order.
VERSIONS = """SELECT o_custkey AS document_id, o_orderkey AS version_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS version_no,
  CASE o_orderstatus WHEN 'F' THEN 'WITHDRAWN' WHEN 'O' THEN 'PUBLISHED' ELSE 'WORKING' END AS state, o_orderdate AS created_at, o_totalprice AS bytes FROM orders"""
#: Folders: a root, regions, nations; customers are filed below their nation.
FOLDERS = """SELECT 'root' AS folder_id, CAST(NULL AS VARCHAR(20)) AS parent_id, 'root' AS name
  UNION ALL SELECT concat('r', CAST(r_regionkey AS VARCHAR(20))), 'root', r_name FROM region
  UNION ALL SELECT concat('n', CAST(n_nationkey AS VARCHAR(20))), concat('r', CAST(n_regionkey AS VARCHAR(20))), n_name FROM nation"""

_F.same("jon01_inner_equi", """SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
_F.same("jon02_left_outer_equi", """SELECT c_custkey, o_orderkey, o_orderpriority FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'""")
_F.same("jon03_lateral_top1_inner", f"""WITH v AS ({VERSIONS}), p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY CASE state WHEN 'WORKING' THEN 0 ELSE 1 END, version_no DESC) AS rn FROM v)
SELECT c_custkey AS document_id, version_id, version_no, state FROM customer JOIN p ON document_id = c_custkey WHERE rn = 1""")
_F.same("jon04_lateral_top1_left", """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem)
SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN f ON l_orderkey = o_orderkey AND rn = 1""")
_F.same("jon05_lateral_aggregate", """SELECT o_orderkey, coalesce(n, 0) AS item_count, coalesce(total, 0) AS total_quantity FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey) i ON l_orderkey = o_orderkey""")
_F.same("jon06_semi_exists", """SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
_F.same("jon07_anti_not_exists", """SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
_F.same("jon08_relational_division", """SELECT o_custkey AS c_custkey, count(DISTINCT o_orderpriority) AS granted FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 3""")
_RECURSIVE = """WITH RECURSIVE f AS ({folders}), t(folder_id, depth) AS (SELECT 'r1', 0 UNION ALL SELECT f.folder_id, t.depth + 1 FROM t JOIN f ON f.parent_id = t.folder_id WHERE t.depth < 1024)
SELECT folder_id, depth FROM t"""
_F.same("jon09_recursive_descendants", _RECURSIVE.format(folders=FOLDERS))
_F.same("set03_union_all_recursion", _RECURSIVE.format(folders=FOLDERS).replace("'r1', 0", "'root', 0"))
_F.same("jon10_recursive_ancestors", f"""WITH RECURSIVE f AS ({FOLDERS}), a(leaf, folder_id, depth) AS (SELECT folder_id, folder_id, 0 FROM f UNION ALL SELECT a.leaf, f.parent_id, a.depth + 1 FROM a JOIN f ON f.folder_id = a.folder_id WHERE f.parent_id IS NOT NULL AND a.depth < 1024)
SELECT DISTINCT leaf, folder_id AS ancestor FROM a""")
_F.same("jon11_nearest_ancestor", f"""WITH RECURSIVE f AS ({FOLDERS}), p AS (SELECT folder_id AS at, concat('policy-', folder_id) AS policy FROM f WHERE folder_id = 'root' OR folder_id LIKE 'r%' AND folder_id IN ('r1', 'r3') OR folder_id IN ('n5', 'n8')),
a(leaf, folder_id, depth) AS (SELECT folder_id, folder_id, 0 FROM f UNION ALL SELECT a.leaf, f.parent_id, a.depth + 1 FROM a JOIN f ON f.folder_id = a.folder_id WHERE f.parent_id IS NOT NULL)
SELECT leaf, policy FROM (SELECT leaf, policy, row_number() OVER (PARTITION BY leaf ORDER BY depth) AS rn FROM a JOIN p ON p.at = a.folder_id) x WHERE rn = 1""")
_F.same("jon12_subtree_cycle_check", f"""WITH RECURSIVE f AS ({FOLDERS}), s(top, folder_id) AS (SELECT folder_id, folder_id FROM f UNION ALL SELECT s.top, f.folder_id FROM s JOIN f ON f.parent_id = s.folder_id)
SELECT m.folder_id, m.target, EXISTS (SELECT 1 FROM s WHERE s.top = m.folder_id AND s.folder_id = m.target) AS folder_cycle
FROM (SELECT a.folder_id, b.folder_id AS target FROM f a JOIN f b ON a.folder_id <> b.folder_id) m""")
_F.same("jon13_key_set_semi", """SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 = 0)""")
_F.same("jon14_incidence_join", """WITH p AS (SELECT l_orderkey AS relation_id, 'part' AS role, l_partkey AS resource FROM lineitem UNION ALL SELECT l_orderkey, 'supplier', l_suppkey FROM lineitem)
SELECT DISTINCT resource, role, relation_id FROM p WHERE role = 'supplier' AND resource < 5""")
_F.same("jon15_cross_join_scalar", """WITH tick AS (SELECT max(ts) AS now FROM events) SELECT event_id, event_type, CASE WHEN ts >= now - INTERVAL '1' DAY THEN 'recent' ELSE 'old' END AS age FROM events CROSS JOIN tick""")
_F.same("jon16_temporal_join", """WITH v AS (SELECT o_custkey, min(o_orderdate) AS valid_from, max(o_orderdate) AS valid_to FROM orders GROUP BY o_custkey)
SELECT o_custkey, (valid_from <= TIMESTAMP '1998-06-01 00:00:00' AND TIMESTAMP '1998-06-01 00:00:00' < valid_to) AS visible FROM v""")
_F.same("jon17_as_of_current", f"""WITH v AS ({VERSIONS}) SELECT document_id, version_id, version_no FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY version_no DESC) AS rn FROM v WHERE state <> 'WORKING') x WHERE rn = 1""")
_F.same("jon18_keyset_theta", """SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate < TIMESTAMP '1997-01-01 00:00:00' OR o_orderdate = TIMESTAMP '1997-01-01 00:00:00' AND o_orderkey < 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51""")
_F.same("jon21_exactly_one_owner", """SELECT l_partkey, count(DISTINCT l_suppkey) AS owners, count(DISTINCT l_suppkey) = 1 AS owned FROM lineitem GROUP BY l_partkey""")
_F.same("jon22_two_way_set_equality", """WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), b AS (SELECT o_orderkey AS k FROM orders)
SELECT 'staged_only' AS side, count(*) AS n FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = a.k) UNION ALL SELECT 'manifest_only', count(*) FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.k = a.k)""")
_F.same("jon23_segment_of_owner", """SELECT l_orderkey AS relation_id, CASE WHEN count(DISTINCT s_nationkey) = 1 THEN concat('n', CAST(min(s_nationkey) AS VARCHAR(20))) ELSE 'remainder' END AS segment FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey""")

_EVENT_STATE = "CASE WHEN event_type = 'purchase' THEN 'delivered' WHEN event_type = 'error' THEN 'dead_letter' WHEN event_id % 5 = 0 THEN 'in_flight' ELSE 'pending' END"
_F.same("agg01_filtered_counts", f"""SELECT count(*) FILTER (WHERE s = 'pending') AS pending, count(*) FILTER (WHERE s = 'in_flight') AS in_flight, count(*) FILTER (WHERE s = 'dead_letter') AS dead_letter, count(*) FILTER (WHERE s = 'delivered') AS delivered FROM (SELECT {_EVENT_STATE} AS s FROM events) x""")
_F.same("agg02_max_age", f"""SELECT greatest(0, CAST(unix_micros(CAST(max(ts) AS TIMESTAMP)) - unix_micros(CAST(min(ts) FILTER (WHERE s = 'pending') AS TIMESTAMP)) AS BIGINT)) AS age_us FROM (SELECT ts, {_EVENT_STATE} AS s FROM events) x""",
        f"""SELECT greatest(0, CAST(epoch_us(max(ts)) - epoch_us(min(ts) FILTER (WHERE s = 'pending')) AS BIGINT)) AS age_us FROM (SELECT ts, {_EVENT_STATE} AS s FROM events) x""")
_F.same("agg03_count_sum_coalesce", """SELECT c_custkey, count(o_orderkey) AS files, coalesce(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT), 0) AS bytes FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey""")
_F.same("agg04_scalar_subquery_count", """SELECT c_custkey, coalesce(w, 0) AS working, coalesce(p, 0) AS published FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'P') AS w, count(*) FILTER (WHERE o_orderstatus = 'O') AS p FROM orders GROUP BY o_custkey) x ON o_custkey = c_custkey""")
_F.same("agg05_distinct", """SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem""")
_F.same("agg06_count_distinct_origins", """SELECT label_claim, count(DISTINCT trim(source)) AS origins FROM (SELECT source, lang AS label_claim FROM documents) x WHERE trim(source) <> '' GROUP BY label_claim""")
_F.same("agg07_conflicting_groups", """SELECT l_partkey, l_suppkey, count(DISTINCT l_tax) AS digests, min(l_orderkey) AS first_version FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(DISTINCT l_tax) > 1""")
_F.same("agg08_latest_by_time", """SELECT user_id, max_by(event_id, struct(ts, event_id)) AS last_event FROM events GROUP BY user_id""", """SELECT user_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS last_event FROM events GROUP BY user_id""")
_F.same("agg09_grouped_grants", """SELECT c_mktsegment AS subject, array_join(array_sort(collect_set(o_orderpriority)), ',') AS actions FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment""", """SELECT c_mktsegment AS subject, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS actions FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment""")
_F.same("agg10_class_histogram", f"""SELECT s AS class, count(*) AS n, s IN ('dead_letter', 'in_flight') AS alarm FROM (SELECT {_EVENT_STATE} AS s FROM events) x GROUP BY s""")
_F.same("agg11_report_rollup", """SELECT event_type AS category, count(*) AS scenarios, count(*) FILTER (WHERE value > 20) AS failures, count(*) FILTER (WHERE value <= 20) AS passes FROM events GROUP BY event_type""")
_F.same("agg12_grouping_sets", """SELECT l_returnflag AS system, l_linestatus AS split, coalesce(CAST(l_linenumber AS VARCHAR(20)), 'ALL') AS type, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, l_linenumber), (l_returnflag, l_linestatus))""")
_F.frame("agg13_mean_percentile", lambda spark, d: ranking.order_statistics(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95}).withColumn("mean", F.round("mean", 6)),
        """SELECT event_type, round(avg(value), 6) AS mean, list_sort(list(value))[CAST(floor(count(*) / 2) AS INT) + 1] AS p50, list_sort(list(value))[CAST(least(count(*) - 1, floor(CAST(0.95 AS DOUBLE) * count(*))) AS INT) + 1] AS p95 FROM events GROUP BY event_type""")
_F.same("agg14_bounded_count_per_parent", """SELECT n_nationkey, CAST(coalesce(sum(least(n, 5)), 0) AS BIGINT) AS attention_count FROM nation LEFT JOIN (SELECT c_nationkey, o_custkey, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' GROUP BY c_nationkey, o_custkey) x ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
_F.same("agg15_dedup_bound", """SELECT code, blocking, rn FROM (SELECT code, blocking, CAST(row_number() OVER (ORDER BY first_at) AS INT) AS rn FROM (SELECT event_type AS code, event_id % 3 = 0 AS blocking, min(event_id) AS first_at FROM events GROUP BY event_type, event_id % 3 = 0) g) x WHERE rn <= 64""")
_F.same("agg16_ordered_set_digest", """SELECT user_id, sha2(array_join(transform(array_sort(collect_list(event_id)), x -> CAST(x AS STRING)), ','), 256) AS digest FROM events GROUP BY user_id""", """SELECT user_id, sha256(array_to_string(list_sort(list(event_id)), ',')) AS digest FROM events GROUP BY user_id""")

_F.same("win00_row_number_backfill", f"""WITH v AS ({VERSIONS}), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY created_at, version_no, version_id) AS BIGINT) AS major_no FROM v WHERE state <> 'WORKING')
SELECT document_id, version_id, major_no, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, major_no DESC) = 1 AS last_known FROM p""")
_F.frame("win01_dense_output_rank", lambda spark, d: _numbered(table(spark, d, "documents").where("source <> 'src3'").select("doc_id", "n_chars"), [F.col("n_chars").desc(), F.col("doc_id")], "rank").select("doc_id", "rank"),
         """SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS INT) AS rank FROM documents WHERE source <> 'src3'""")
_F.same("win02_best_per_parent", """SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END DESC, l_extendedprice DESC, l_linenumber, l_partkey) AS rn FROM lineitem) x WHERE rn = 1""")
_F.same("win03_best_tier_per_id", """SELECT id, tier, score FROM (SELECT id, tier, score, row_number() OVER (PARTITION BY id ORDER BY tier, score DESC) AS rn FROM (SELECT l_partkey AS id, l_linenumber AS tier, l_quantity AS score FROM lineitem) h) x WHERE rn = 1""")
_F.same("win04_first_occurrence", """SELECT l_partkey AS group_key, min(l_orderkey * 10 + l_linenumber) AS pos, count(*) AS hits FROM lineitem GROUP BY l_partkey""")
_F.same("win05_max_by_priority", """SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END, c_acctbal DESC, c_custkey) AS rn FROM customer) x WHERE rn = 1""")
_F.same("win06_latest_revision", """SELECT l_partkey, major, minor FROM (SELECT l_partkey, l_linenumber AS major, l_orderkey AS minor, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber DESC, l_orderkey DESC) AS rn FROM lineitem) x WHERE rn = 1""")
_F.frame("win07_prev_row_link", lambda spark, d: ranking.previous(table(spark, d, "events").select("event_id"), [F.col("event_id")], "event_id", "before").select("event_id", F.coalesce(F.col("event_id") == F.col("before") + 1, F.col("event_id") == 0).alias("linked")),
         """SELECT event_id, coalesce(event_id = lag(event_id) OVER (ORDER BY event_id) + 1, event_id = 0) AS linked FROM events""")

_F.same("top01_top_k_by_score", """SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40""")
# The first rows are taken before they are numbered, and the total is counted apart.
_F.same("top02_oversample_refill", "SELECT doc_id AS parent, n_chars AS score, (SELECT count(*) FROM documents) <= 640 AS exhausted FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10",
        """SELECT doc_id AS parent, n_chars AS score, total <= 640 AS exhausted FROM (SELECT doc_id, n_chars, count(*) OVER () AS total, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rn FROM documents) x WHERE rn <= 10""")
_F.same("top04_unit_to_parent_fold", """SELECT conv_id AS parent, turn AS unit FROM (SELECT conv_id, turn, len, row_number() OVER (PARTITION BY conv_id ORDER BY len DESC, turn) AS rn FROM (SELECT conv_id, turn, length(text) AS len FROM conversations) t) x WHERE rn = 1 ORDER BY len DESC, conv_id LIMIT 20""")
_F.same("top05_keyset_page", f"""WITH v AS ({VERSIONS}) SELECT version_id, created_at, version_no FROM v WHERE created_at > TIMESTAMP '1996-01-01 00:00:00' OR created_at = TIMESTAMP '1996-01-01 00:00:00' AND version_id > 100 ORDER BY created_at, version_id LIMIT 21""")
_F.same("top06_nulls_last_offset", """SELECT event_id, occurred_at FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS occurred_at FROM events) x ORDER BY occurred_at DESC NULLS LAST, event_id LIMIT 50 OFFSET 25""")
_F.frame("top07_binary_sort", lambda spark, d: _numbered(table(spark, d, "part").select(F.col("p_name").alias("name")).distinct(), [F.col("name")], "rn").select("name", "rn"),
         """SELECT name, rn FROM (SELECT p_name AS name, CAST(row_number() OVER (ORDER BY p_name) AS INT) AS rn FROM (SELECT DISTINCT p_name FROM part) p) x""")
_F.same("top10_slice_page", "SELECT doc_id, rank, (SELECT count(*) FROM documents) > 40 AS more FROM (SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS INT) AS rank FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40) f) x WHERE rank BETWEEN 21 AND 40",
        """SELECT doc_id, rank, total > 40 AS more FROM (SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS INT) AS rank, count(*) OVER () AS total FROM documents) x WHERE rank BETWEEN 21 AND 40""")
_F.same("top11_claim_order", f"""SELECT event_id, ts FROM events WHERE event_type <> 'purchase' AND event_type <> 'error' ORDER BY ts, event_id LIMIT 32""")

_F.same("set01_union_all_history", """SELECT kind, id, occurred_at FROM (SELECT 'published' AS kind, o_orderkey AS id, o_orderdate AS occurred_at FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'withdrawn', o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'working', o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'shipped', l_orderkey, l_shipdate FROM lineitem WHERE l_linenumber = 1
UNION ALL SELECT 'fallback', o_orderkey, o_orderdate FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) h""")
_F.same("set02_union_distinct", """SELECT l_partkey AS file_id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O'""")
_F.same("set04_intersection_difference", """SELECT 'both' AS part, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') x UNION ALL SELECT 'only', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') y""")
_F.same("set05_disjoint_subset", """SELECT s.l_suppkey, NOT EXISTS (SELECT 1 FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey WHERE a.l_suppkey = s.l_suppkey AND a.l_returnflag = 'R' AND b.l_returnflag = 'N') AS disjoint FROM (SELECT DISTINCT l_suppkey FROM lineitem) s""",
        """SELECT l_suppkey, len(list_intersect(coalesce(list(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'R'), []), coalesce(list(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'N'), []))) = 0 AS disjoint FROM lineitem GROUP BY l_suppkey""")
_F.same("set06_multiset_match", """WITH e AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey), a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey)
SELECT coalesce(e.k, a.k) AS k, least(coalesce(e.n, 0), coalesce(a.n, 0)) AS matched, greatest(coalesce(e.n, 0) - coalesce(a.n, 0), 0) AS missing, greatest(coalesce(a.n, 0) - coalesce(e.n, 0), 0) AS unexpected FROM e FULL OUTER JOIN a ON e.k = a.k""")


def _stores_only(spark: SparkSession, d: str) -> DataFrame:
    item, of = table(spark, d, "lineitem"), lambda flag: F.col("l_returnflag") == flag
    return distinct_not_in(item.where(of("R")).select("l_partkey"), item.where(of("A")).select("l_partkey")).toDF("store_only")


_F.frame("set07_left_anti_chain", _stores_only, """SELECT DISTINCT l_partkey AS store_only FROM lineitem WHERE l_returnflag = 'R' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')""")

_F.same("cat01_document_page", f"""WITH RECURSIVE f AS ({FOLDERS}), t(folder_id, depth) AS (SELECT 'root', 0 UNION ALL SELECT f.folder_id, t.depth + 1 FROM t JOIN f ON f.parent_id = t.folder_id WHERE t.depth < 1024), v AS ({VERSIONS}),
shown AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY version_no DESC) AS rn FROM v WHERE state = 'PUBLISHED')
SELECT c_custkey AS document_id, s.version_no, s.created_at, t.depth FROM customer JOIN t ON t.folder_id = concat('n', CAST(c_nationkey AS VARCHAR(20))) JOIN shown s ON s.document_id = c_custkey AND s.rn = 1
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND (s.created_at < TIMESTAMP '2000-01-01 00:00:00' OR s.created_at = TIMESTAMP '2000-01-01 00:00:00' AND c_custkey < 500) ORDER BY s.created_at DESC, c_custkey DESC LIMIT 51""")
_F.same("cat02_folder_page", f"""WITH f AS ({FOLDERS}) SELECT folder_id, name FROM f WHERE parent_id = 'r2' ORDER BY name, folder_id LIMIT 50""")
_F.same("cat03_history_page", """SELECT kind, id, occurred_at FROM (SELECT 'published' AS kind, o_orderkey AS id, o_orderdate AS occurred_at FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O' UNION ALL SELECT 'withdrawn', o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F' UNION ALL SELECT 'working', o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'P') h ORDER BY occurred_at DESC NULLS LAST, kind, id LIMIT 20""")
_F.same("cat04_allow_document", """WITH req AS (SELECT 'READ' AS action UNION ALL SELECT 'SEARCH'), g AS (SELECT c_custkey AS document_id, CASE WHEN c_custkey % 2 = 0 THEN 'READ' ELSE 'WRITE' END AS action FROM customer UNION ALL SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'SEARCH' ELSE 'LIST' END FROM customer)
SELECT c_custkey AS document_id, coalesce(n, 0) = 2 AS allowed FROM customer LEFT JOIN (SELECT document_id, count(DISTINCT g.action) AS n FROM g JOIN req ON req.action = g.action GROUP BY document_id) x ON document_id = c_custkey""")
_F.same("cat06_evaluate_policy", """SELECT c_custkey, CASE WHEN size(required) = 0 THEN false ELSE size(array_except(required, granted)) = 0 END AS allowed FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN array() WHEN c_custkey % 4 = 1 THEN array('READ') ELSE array('READ', 'WRITE') END AS required, CASE WHEN c_custkey % 3 = 0 THEN array('READ', 'WRITE') ELSE array('READ') END AS granted FROM customer) x""",
        """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN false WHEN c_custkey % 4 = 1 THEN true ELSE c_custkey % 3 = 0 END AS allowed FROM customer""")
_F.same("cat07_read_state", """SELECT c_custkey AS version_id, first_read_at, first_read_at IS NULL OR c_custkey % 10 = 0 AS needs_recheck FROM customer LEFT JOIN (SELECT user_id, min(ts) AS first_read_at FROM events WHERE event_type = 'view' GROUP BY user_id) r ON user_id = c_custkey""")
_F.same("cat08_capability_flags", """SELECT c_custkey, coalesce(w, false) AS has_working, coalesce(p, false) AS has_published, coalesce(n, 0) AS versions FROM customer LEFT JOIN (SELECT o_custkey, bool_or(o_orderstatus = 'P') AS w, bool_or(o_orderstatus = 'O') AS p, count(*) AS n FROM orders GROUP BY o_custkey) x ON o_custkey = c_custkey""")

_ASSIGN = """SELECT c_custkey AS id, c_nationkey AS unit_id, c_custkey % 6 AS role_id, min(o_orderdate) AS valid_from, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE max(o_orderdate) END AS valid_until, CASE WHEN c_custkey % 13 = 0 THEN min(o_orderdate) ELSE NULL END AS revoked_at FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey"""
_AT = "TIMESTAMP '1998-01-01 00:00:00'"
_EFFECTIVE = f"(revoked_at IS NULL AND valid_from <= {_AT} AND (valid_until IS NULL OR {_AT} < valid_until))"
_F.same("wrk01_effective_assignment", f"""WITH a AS ({_ASSIGN}) SELECT id, {_EFFECTIVE} AND unit_id IN (SELECT n_nationkey FROM nation) AS effective FROM a""")
_F.same("wrk02_effective_delegation", f"""WITH a AS ({_ASSIGN}), e AS (SELECT * FROM a WHERE {_EFFECTIVE}) SELECT d.id AS delegation_id, e.id AS source_id, e.id IS NOT NULL AS effective FROM a d LEFT JOIN e ON e.id = d.id - 1 AND e.unit_id <> d.unit_id""")
_F.same("wrk03_responsibilities", f"""WITH a AS ({_ASSIGN}), e AS (SELECT * FROM a WHERE {_EFFECTIVE}) SELECT id AS principal, 'assignment' AS kind, role_id FROM e UNION ALL SELECT e.id + 1, 'delegation', e.role_id FROM e JOIN a ON a.id = e.id + 1 WHERE e.role_id % 2 = a.role_id % 2 OR e.role_id = 0""")
_F.same("wrk04_can_manage", f"""WITH a AS ({_ASSIGN}) SELECT unit_id, bool_or({_EFFECTIVE} AND role_id = 3) AS can_manage FROM a GROUP BY unit_id""")
_F.same("wrk05_organization_view", f"""WITH a AS ({_ASSIGN}) SELECT n_nationkey AS unit_id, n_name, count(id) AS members FROM nation LEFT JOIN a ON unit_id = n_nationkey AND {_EFFECTIVE} GROUP BY n_nationkey, n_name""")
_F.same("wrk06_attention", f"""SELECT o_orderkey AS task, kind FROM (SELECT o_orderkey, 'NewlyAssigned' AS kind FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, CASE WHEN o_orderdate <= {_AT} THEN 'Overdue' ELSE 'DueSoon' END FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-08 00:00:00') x""")
_F.same("wrk07_context_view", """SELECT c_nationkey AS context, count(*) AS tasks, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, round(CAST(100 AS DOUBLE) * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 3) AS progress FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey""",
        """SELECT c_nationkey AS context, count(*) AS tasks, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, round(CAST(100 AS DOUBLE) * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 3) AS progress FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey""")
_F.same("wrk09_policy_integrity", f"""WITH a AS ({_ASSIGN}) SELECT 'unit' AS rule, count(*) AS broken FROM a WHERE unit_id NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'interval', count(*) FROM a WHERE valid_until IS NOT NULL AND valid_until <= valid_from""")
