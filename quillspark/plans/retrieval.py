"""Queries of text functions, lexical, vector and graph retrieval, and federation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillspark.functions import text as tx
from quillspark.operators import federation, graph, lexical, vector
from quillspark.plans.binding import Family
from quillspark.tables import spread, table

_F = Family()
QUERIES, ORACLES = _F.queries, _F.oracles

BODY_QUERY, TITLE_QUERY = "and attion to thanedble", "red widget"
_TOKENS = "list_transform(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x))"
_UNITS = "SELECT doc_id, i - 1 AS line, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents) a) b WHERE l[i] <> ''"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


_F.frame("src02_text_units", lambda spark, d: lexical.units(_documents(spark, d)).select("doc_id", "line", F.length("text").alias("n_chars")),
         f"SELECT doc_id, CAST(line AS INT) AS line, CAST(length(text) AS INT) AS n_chars FROM ({_UNITS}) u")
_F.frame("src10_unit_emit", lambda spark, d: lexical.units(_documents(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_units"), F.max(F.octet_length("text")).alias("peak_bytes")),
         f"SELECT doc_id, count(*) AS n_units, CAST(max(strlen(text)) AS INT) AS peak_bytes FROM ({_UNITS}) u GROUP BY doc_id")
_F.frame("win09_unit_ordinals", lambda spark, d: lexical.units(_documents(spark, d)).withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("line")) - 1).select("doc_id", "line", "ordinal"),
         f"SELECT doc_id, CAST(line AS INT) AS line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INT) AS ordinal FROM ({_UNITS}) u")

_F.frame("str01_normalize_unit_text", lambda spark, d: _documents(spark, d).select("doc_id", F.sha2(tx.normalize_newlines(F.col("text")), 256).alias("digest")),
         "SELECT doc_id, sha256(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)))) AS digest FROM documents")
_F.frame("str02_normalize_exact", lambda spark, d: table(spark, d, "part").select("p_partkey", tx.normalize_exact(F.concat(F.lit("\t "), F.upper("p_name"), F.lit(" \n"))).alias("name")),
         "SELECT p_partkey, lower(p_name) AS name FROM part")
_F.frame("str03_tokenize", lambda spark, d: spread(_documents(spark, d).select("doc_id", "text")).select("doc_id", tx.tokenize(F.col("text")).alias("t")).select("doc_id", F.sha2(F.array_join("t", " "), 256).alias("digest"), F.size("t").alias("n_tokens")),
         f"SELECT doc_id, sha256(array_to_string(t, ' ')) AS digest, CAST(len(t) AS INT) AS n_tokens FROM (SELECT doc_id, list_filter({_TOKENS.format('text')}, lambda x: strlen(x) < 40) AS t FROM documents) x")
_F.frame("str04_cjk_class", lambda spark, d: spark.range(1).select(F.explode(F.array(*map(F.lit, ("東京都", "F1（エフ・ワン）", "法第2条", "Hello, World")))).alias("s")).select("s", F.array_join(tx.tokenize(F.col("s")), ",").alias("tokens")),
         "SELECT * FROM (VALUES ('東京都', '東京,京都'), ('F1（エフ・ワン）', 'f1,エフ,ワン'), ('法第2条', '法第,2,条'), ('Hello, World', 'hello,world')) v(s, tokens)")
_F.same("str05_legacy_analyzer", "SELECT doc_id, size(filter(split(lower(text), '[^\\\\p{L}\\\\p{N}]+'), x -> x <> '' AND octet_length(x) < 40)) AS n_tokens FROM documents",
        f"SELECT doc_id, CAST(len(list_filter({_TOKENS.format('text')}, lambda x: strlen(x) < 40)) AS INT) AS n_tokens FROM documents")
_F.frame("str06_excerpt_around", lambda spark, d: _documents(spark, d).select("doc_id", tx.excerpt_around(F.col("text"), F.locate("the", F.col("text")), F.lit(3)).alias("excerpt")).where(F.locate("the", F.col("excerpt")) > 0),
         "SELECT doc_id, e AS excerpt FROM (SELECT doc_id, trim(regexp_replace(substr(text, CAST(greatest(1, least(strpos(text, 'the') - 158, length(text) - 319)) AS INT), 320), '[[:cntrl:]]', ' ', 'g')) AS e FROM documents) x WHERE strpos(e, 'the') > 0")
_F.frame("str07_longest_query_part", lambda spark, d: _documents(spark, d).select("doc_id", tx.longest_query_part(F.col("text"), "thanedble the").alias("part")),
         "SELECT doc_id, (SELECT part FROM (SELECT substr('thanedble the', i, n) AS part, n, i FROM range(1, 14) a(i), range(2, 14) b(n) WHERE i + n <= 14) p WHERE length(trim(part)) >= 2 AND contains(text, part) ORDER BY n DESC, i LIMIT 1) AS part FROM documents")
_F.frame("str08_literal_escape", lambda spark, d: table(spark, d, "events").select("event_id", tx.literal_escape(F.col("props")).alias("escaped")), "SELECT event_id, replace(replace(props, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') AS escaped FROM events")
_F.same("str09_text_span", "SELECT doc_id, octet_length(substr(text, 1, locate('the', text) - 1)) AS start_byte, octet_length(substr(text, 1, locate('the', text) + 2)) AS end_byte FROM documents WHERE locate('the', text) > 0",
        "SELECT doc_id, CAST(strlen(substr(text, 1, strpos(text, 'the') - 1)) AS INT) AS start_byte, CAST(strlen(substr(text, 1, strpos(text, 'the') + 2)) AS INT) AS end_byte FROM documents WHERE strpos(text, 'the') > 0")
_F.frame("str10_logical_path", lambda spark, d: table(spark, d, "pages").select("page_id", tx.logical_path_ok(F.col("url")).alias("url_ok"), tx.logical_path_ok(F.concat(F.lit("/"), F.col("url"))).alias("rooted_ok")), "SELECT page_id, true AS url_ok, false AS rooted_ok FROM pages")
_F.frame("str11_folder_name", lambda spark, d: table(spark, d, "nation").select("n_nationkey", tx.folder_name(F.concat(F.lit("  "), F.col("n_name"), F.when(F.col("n_nationkey") % 3 == 0, "/x").otherwise(" "))).alias("name")), "SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS name FROM nation")
_F.frame("str12_media_type", lambda spark, d: table(spark, d, "part").select("p_partkey", tx.media_type(F.concat(F.lit(" Text/"), F.col("p_type"), F.lit(" ; charset=x"))).alias("essence")), "SELECT p_partkey, lower('text/' || p_type) AS essence FROM part")
_F.same("str13_title_key", "SELECT p_partkey, position('ring' IN p_name) > 0 AS found FROM part")
_F.frame("str14_pointer_escape", lambda spark, d: table(spark, d, "pages").select("page_id", tx.pointer_escape(F.concat(F.lit("~"), F.col("url"))).alias("pointer")), "SELECT page_id, '~0' || replace(replace(url, '~', '~0'), '/', '~1') AS pointer FROM pages")
_F.same("str15_normalize_uri", "SELECT page_id, concat(lower(regexp_extract(url, '^([A-Za-z]+)://', 1)), '://', lower(regexp_extract(url, '://([^/?#]*)', 1)), regexp_extract(url, '://[^/?#]*(.*)$', 1)) AS uri FROM pages")
_F.same("str16_hex", "SELECT event_id, regexp_like(sha2(props, 256), '^[0-9a-f]{64}$') AS valid, lower(hex(substr(props, 1, 4))) AS hex4 FROM events", "SELECT event_id, regexp_matches(sha256(props), '^[0-9a-f]{64}$') AS valid, lower(hex(substr(props, 1, 4))) AS hex4 FROM events")
_F.frame("str17_framed_sha256", lambda spark, d: table(spark, d, "part").select("p_partkey", tx.framed_sha256("kp-v1", F.col("p_name"), F.col("p_brand")).alias("digest")),
         "SELECT p_partkey, sha256(CAST('kp-v1' AS BLOB) || unhex(lpad(hex(strlen(p_name)), 8, '0')) || CAST(p_name AS BLOB) || unhex(lpad(hex(strlen(p_brand)), 8, '0')) || CAST(p_brand AS BLOB)) AS digest FROM part")
_F.frame("str18_unit_id", lambda spark, d: lexical.units(_documents(spark, d)).select("doc_id", "line", F.concat(F.lit("ku1:"), tx.framed_sha256("kp-unit", F.col("doc_id").cast("string"), F.col("line").cast("string"))).alias("unit_id")),
         f"SELECT doc_id, CAST(line AS INT) AS line, 'ku1:' || sha256(CAST('kp-unit' AS BLOB) || unhex(lpad(hex(strlen(doc_id::VARCHAR)), 8, '0')) || CAST(doc_id::VARCHAR AS BLOB) || unhex(lpad(hex(strlen(line::VARCHAR)), 8, '0')) || CAST(line::VARCHAR AS BLOB)) AS unit_id FROM ({_UNITS}) u")

_QT = ["and", "attion", "to", "thanedble"]
_TF = ", ".join(f"len(list_filter(t, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(_QT))
_SCORE = " + ".join(f"ln(1 + (n_units - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / average))" for i in range(4))
_BODY = f"""WITH u AS (SELECT doc_id, line, contains(text, '{BODY_QUERY}') AS literal, list_filter({_TOKENS.format('text')}, lambda x: strlen(x) < 40) AS t FROM ({_UNITS}) x),
r AS (SELECT doc_id, line, literal, len(t) AS n, {_TF} FROM u),
s AS (SELECT count(*)::DOUBLE AS n_units, sum(n)::DOUBLE / count(*) AS average, {", ".join(f"count(*) FILTER (WHERE tf{i} > 0)::DOUBLE AS df{i}" for i in range(4))} FROM r),
m AS (SELECT doc_id, line, literal, round({_SCORE}, 6) AS score FROM r, s WHERE {" + ".join(f"(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END)" for i in range(4))} >= 3),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY literal DESC, score DESC, line) = 1)
SELECT doc_id, CAST(line AS INT) AS line, literal, score, CAST(row_number() OVER (ORDER BY literal DESC, score DESC, doc_id) AS INT) AS rank FROM b ORDER BY rank LIMIT 50"""
#: One index for each session and state of the table's files: later queries read what the first one built.
_indexes: dict[tuple, lexical.Index] = {}


def document_index(spark: SparkSession, d: str) -> lexical.Index:
    """The index of ``documents``, built once for the files as they are now."""
    fs = spark._jvm.org.apache.hadoop.fs
    files = []
    for name in sorted(_documents(spark, d).inputFiles()):
        path = fs.Path(spark._jvm.java.net.URI(name))
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        files.append((name, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, tuple(files))
    if key not in _indexes:
        _indexes[key] = lexical.build_index(_documents(spark, d))
    return _indexes[key]


def search_documents(spark: SparkSession, d: str, query: str, limit: int) -> DataFrame:
    """Body search over ``documents`` by its index."""
    return lexical.search_index(spark, document_index(spark, d), query, limit)


_F.frame("lex07_index_postings", lambda spark, d: spark.read.parquet(document_index(spark, d).path + "/postings").groupBy("token").agg(F.count(F.lit(1)).alias("n_units"), F.sum("tf").alias("n_tokens")),
         f"SELECT token, count(DISTINCT (doc_id, line)) AS n_units, count(*) AS n_tokens FROM (SELECT doc_id, line, unnest(list_filter({_TOKENS.format('text')}, lambda x: strlen(x) < 40)) AS token FROM ({_UNITS}) u) t GROUP BY token")
_F.frame("lex04_body_search", lambda spark, d: search_documents(spark, d, BODY_QUERY, 50), _BODY)
_F.frame("evl04_bm25_ranking", lambda spark, d: search_documents(spark, d, BODY_QUERY, 10).select("doc_id", "rank"), f"SELECT doc_id, rank FROM ({_BODY}) z WHERE rank <= 10")
_F.frame("lex05_empty_query", lambda spark, d: search_documents(spark, d, "--- !!", 50).agg(F.count(F.lit(1)).alias("hits")), "SELECT 0::BIGINT AS hits")
_F.frame("lex06_body_hit", lambda spark, d: search_documents(spark, d, BODY_QUERY, 50).select("doc_id", F.when(F.col("literal"), F.col("line")).alias("unit_ref")), f"SELECT doc_id, CASE WHEN literal THEN line END AS unit_ref FROM ({_BODY}) z")
_F.frame("mth04_min_token_share", lambda spark, d: table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("n")).select("n", F.when(F.col("n") <= 2, F.col("n")).otherwise(F.floor((3 * F.col("n") + 4) / 5).cast("int")).alias("required")), "SELECT n_nationkey + 1 AS n, CAST(CASE WHEN n_nationkey + 1 <= 2 THEN n_nationkey + 1 ELSE ceil((n_nationkey + 1) * 3 / 5.0) END AS INT) AS required FROM nation")


def _named(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("high_signal"))


_F.frame("lex02_tiered_search", lambda spark, d: lexical.tiered_search(_named(spark, d), TITLE_QUERY, 256),
         f"SELECT id, tier, CAST(row_number() OVER (ORDER BY tier, id) AS INT) AS rank FROM (SELECT p_partkey AS id, CASE WHEN lower(p_name) = '{TITLE_QUERY}' THEN 3 ELSE 7 END AS tier FROM part WHERE contains(' ' || lower(p_name) || ' ', ' {TITLE_QUERY} ')) x ORDER BY tier, id LIMIT 256")
_F.frame("lex03_tier_order", lambda spark, d: spark.createDataFrame([(i, f, w) for i, (f, w) in enumerate(lexical.TIERS, 1)], "tier int, field string, exact boolean"),
         "SELECT * FROM (VALUES (1, 'canonical_name', true), (2, 'aliases', true), (3, 'title', true), (4, 'canonical_name', false), (5, 'aliases', false), (6, 'title', false), (7, 'high_signal', false), (8, 'body', false)) v(tier, field, exact)")
_F.same("dir01_directory", "SELECT p_partkey AS resource FROM part WHERE p_type NOT IN ('ECONOMY', 'PROMO')")
_F.same("dir02_structured", "SELECT p_partkey AS resource, CASE WHEN p_size IS NULL THEN 'Unknown' WHEN p_size = 10 THEN 'Match' ELSE 'Mismatch' END AS size_outcome, CASE WHEN p_brand = 'Brand#3' THEN 'Match' ELSE 'Mismatch' END AS brand_outcome FROM part WHERE p_type NOT IN ('ECONOMY', 'PROMO')")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"))


def _search(spark: SparkSession, d: str, k: int, floor: float = -1.0) -> DataFrame:
    query = _vectors(spark, d).where("id = 7").first()["values"]
    return vector.search(_vectors(spark, d), list(query), k, floor)


_DOT = "list_sum(list_transform(range(1, 65), lambda i: e.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE))"
_NEAR = f"SELECT e.vec_id AS id, e.label, round({_DOT}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q"
_RANKED = "SELECT id, similarity, CAST(row_number() OVER (ORDER BY similarity DESC, id) AS INT) AS rank FROM ({0}) x {1} ORDER BY rank LIMIT {2}"
_F.frame("vec01_exact_search", lambda spark, d: _search(spark, d, 20), _RANKED.format(_NEAR, "", 20))
_F.frame("top03_vector_top_k", lambda spark, d: _search(spark, d, 50, 0.1), _RANKED.format(_NEAR, "WHERE similarity >= 0.1", 50))
_F.frame("vec02_fold_to_parents", lambda spark, d: vector.fold_to_parents(_search(spark, d, 80).select((F.col("id") % 40).alias("parent"), "rank"), 10),
         f"SELECT parent, CAST(row_number() OVER (ORDER BY f, parent) AS INT) AS rank FROM (SELECT id % 40 AS parent, min(rank) AS f FROM ({_RANKED.format(_NEAR, '', 80)}) y GROUP BY parent) z ORDER BY rank LIMIT 10")
_F.frame("vec03_hit_resolution", lambda spark, d: _search(spark, d, 40).select("id", F.when(F.col("id") % 7 == 0, "Unavailable").when(F.col("id") % 5 == 0, "Suppressed").otherwise("Resolved").alias("state")),
         f"SELECT id, CASE WHEN id % 7 = 0 THEN 'Unavailable' WHEN id % 5 = 0 THEN 'Suppressed' ELSE 'Resolved' END AS state FROM ({_RANKED.format(_NEAR, '', 40)}) y")
_F.frame("mth01_dot", lambda spark, d: _vectors(spark, d).select("id", F.round(vector.dot(F.col("values"), F.reverse("values")), 6).alias("dot")), "SELECT vec_id AS id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * embedding[65 - i]::DOUBLE)), 6) AS dot FROM embeddings")
_F.frame("mth02_vector_validity", lambda spark, d: _vectors(spark, d).select("id", vector.valid(F.col("values"), 64).alias("valid")), "SELECT vec_id AS id, len(embedding) = 64 AND abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) <= 0.001 AS valid FROM embeddings")
_F.same("mth06_log_gain", "SELECT l_linenumber AS rank, round(1 / log2(l_linenumber + 1), 9) AS gain FROM (SELECT DISTINCT l_linenumber FROM lineitem) x")


def _lineitem_graph(spark: SparkSession, d: str, lines: str) -> tuple[DataFrame, DataFrame]:
    """Relations part - supplier of the line items that ``lines`` holds for."""
    item = table(spark, d, "lineitem").where(lines).select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    key = F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_partkey", F.lit("-"), "l_suppkey")
    part = item.select(key.alias("relation_id"), F.lit("part").alias("role"), F.concat(F.lit("p"), "l_partkey").alias("resource"))
    supplier = item.select(key.alias("relation_id"), F.lit("supplier").alias("role"), F.concat(F.lit("s"), "l_suppkey").alias("resource"))
    participants = part.union(supplier)
    return participants, participants.select("relation_id").distinct().withColumn("relation_type", F.lit("supply"))


def _paths(spark: SparkSession, d: str, visible: bool = False, lines: str = "true") -> DataFrame:
    participants, relations = _lineitem_graph(spark, d, lines)
    seeds = spark.createDataFrame([("s1",), ("s2",)], "resource string")
    seen = participants.select("resource").distinct().where("resource not like 'p%7'") if visible else None
    return graph.traverse(participants, relations, seeds, [graph.Hop("supply", "supplier", "part"), graph.Hop("supply", "part", "supplier")], seen)


_PATHS = "WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) SELECT 's' || a.l_suppkey AS start, 's' || b.l_suppkey AS resource FROM l a JOIN l b ON a.l_partkey = b.l_partkey WHERE a.l_suppkey IN (1, 2)"
_F.frame("grf01_traversal", lambda spark, d: _paths(spark, d).select("start", "resource"), _PATHS)
_F.frame("grf02_traversal_by_end", lambda spark, d: _paths(spark, d).groupBy("resource").agg(F.count(F.lit(1)).alias("paths")), f"SELECT resource, count(*) AS paths FROM ({_PATHS}) x GROUP BY resource")
_F.frame("grf03_visibility", lambda spark, d: _paths(spark, d, True).select("start", "resource"), _PATHS + " AND a.l_partkey % 10 <> 7")
_F.frame("grf04_group_paths", lambda spark, d: graph.group_paths(_paths(spark, d)).select("resource", "paths"), f"SELECT resource, count(*) AS paths FROM ({_PATHS}) x GROUP BY resource")


def _checked_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths over all line items, damaged by their part's number, and what the check says of them."""
    participants, relations = _lineitem_graph(spark, d, "true")
    kind = F.substring(F.get("path", F.lit(2)), 2, 20).cast("long") % 5
    put = lambda i, value: F.transform("path", lambda x, k: F.when(k == i, value).otherwise(x))
    path = F.when(kind == 1, put(0, "s-1")).when(kind == 3, put(1, "none")).when(kind == 4, put(2, "p-1")).otherwise(F.col("path"))
    paths = _paths(spark, d).select(F.when(kind == 1, "s-1").otherwise(F.col("start")).alias("start"), F.when(kind == 2, "s-1").otherwise(F.col("resource")).alias("resource"), path.alias("path"))
    return graph.check_paths(paths, participants, relations, spark.createDataFrame([("s1",), ("s2",)], "resource string"), [graph.Hop("supply", "supplier", "part"), graph.Hop("supply", "part", "supplier")])


_F.frame("grf06_returned_path_check", lambda spark, d: _checked_paths(spark, d).groupBy("problem").agg(F.count(F.lit(1)).alias("paths")),
         "WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) SELECT CASE a.l_partkey % 5 WHEN 1 THEN 'seed' WHEN 2 THEN 'endpoint' WHEN 3 THEN 'relation' WHEN 4 THEN 'participants' END AS problem, count(*) AS paths FROM l a JOIN l b ON a.l_partkey = b.l_partkey WHERE a.l_suppkey IN (1, 2) GROUP BY 1")
_F.same("grf07_pattern_lookup", "SELECT DISTINCT l_orderkey AS relation_id FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey = 3")
_F.same("grf08_relation_validation", "SELECT l_orderkey, count(*) >= 2 AS enough, bool_and(l_returnflag <> '') AS roles_ok FROM lineitem GROUP BY l_orderkey")
_F.same("grf09_incidence_index", "SELECT l_suppkey AS resource, 'supplier' AS role, count(DISTINCT l_orderkey) AS relations FROM lineitem GROUP BY l_suppkey UNION ALL SELECT l_partkey, 'part', count(DISTINCT l_orderkey) FROM lineitem GROUP BY l_partkey")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Two ranked lists of documents: by length, and by number of lines."""
    rows = _documents(spark, d).select(F.col("doc_id").alias("id"), "n_chars", F.size(F.split("text", "\n")).alias("lines"))

    def first(number: int, by: str) -> DataFrame:
        order = [F.col(by).desc(), F.col("id")]
        return rows.orderBy(*order).limit(60).select(F.lit(number).alias("list_no"), F.row_number().over(Window.orderBy(*order)).alias("rank"), "id")

    return first(1, "n_chars").union(first(2, "lines"))


_HITS = """(SELECT 1 AS list_no, rank, id FROM (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents) a WHERE rank <= 60
UNION ALL SELECT 2, rank, id FROM (SELECT doc_id AS id, row_number() OVER (ORDER BY len(string_split(text, chr(10))) DESC, doc_id) AS rank FROM documents) b WHERE rank <= 60) h"""
_F.frame("fed01_merge", lambda spark, d: federation.priority_concat(_hits(spark, d).where("id % 5 <> 0")).select("id", "position", "hits"), f"SELECT id, CAST(row_number() OVER (ORDER BY f, id) AS INT) AS position, hits FROM (SELECT id, min(list_no * 1000 + rank) AS f, count(*) AS hits FROM {_HITS} WHERE id % 5 <> 0 GROUP BY id) x")
_F.frame("fed05_priority_concat", lambda spark, d: federation.priority_concat(_hits(spark, d)), f"SELECT id, CAST(row_number() OVER (ORDER BY f, id) AS INT) AS position, hits FROM (SELECT id, min(list_no * 1000 + rank) AS f, count(*) AS hits FROM {_HITS} GROUP BY id) x")
_F.same("fed02_list_validation", "SELECT source, count(DISTINCT lang) = 1 AS one_generation FROM documents GROUP BY source")
_F.frame("fed03_associations", lambda spark, d: federation.associations(_documents(spark, d).select(F.col("source").alias("local"), F.col("lang").alias("logical"), F.when(F.col("doc_id") % 50 == 0, "Conflict").when(F.col("lang") == "es", "Resolved").otherwise("Provisional").alias("state"))),
         "SELECT source AS local, CASE WHEN bool_or(doc_id % 50 = 0) THEN 'Conflict' WHEN bool_or(lang = 'es') THEN 'Unique' ELSE 'None' END AS association, CASE WHEN NOT bool_or(doc_id % 50 = 0) AND bool_or(lang = 'es') THEN 'es' END AS logical FROM documents GROUP BY source")
_F.same("fed04_group_key", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN concat('logical-', lang) END, CASE WHEN doc_id % 3 = 1 THEN concat('local-', source) END, concat('row-', CAST(doc_id AS VARCHAR(20)))) AS group_key FROM documents")
_RRF = "SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS position FROM (SELECT id, round(sum({0} / (60 + rank)), 9) AS score FROM {1} GROUP BY id) x"
_F.frame("fed06_rrf", lambda spark, d: federation.reciprocal_rank_fusion(_hits(spark, d)), _RRF.format("1.0::DOUBLE", _HITS))
_F.frame("fed07_weighted_rrf", lambda spark, d: federation.reciprocal_rank_fusion(_hits(spark, d), weights={1: 0.7, 2: 0.3}), _RRF.format("(CASE list_no WHEN 1 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END)", _HITS))
_F.frame("fed08_gated_concat", lambda spark, d: federation.priority_concat(_hits(spark, d), limit=70).select("id", "position"), f"SELECT id, position FROM (SELECT id, CAST(row_number() OVER (ORDER BY f, id) AS INT) AS position FROM (SELECT id, min(list_no * 1000 + rank) AS f FROM {_HITS} GROUP BY id) x) y WHERE position <= 70")
