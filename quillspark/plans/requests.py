"""Queries of request checks, containers, fingerprints and model arithmetic."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import requests as rq
from quillspark.functions.text import normalize_newlines
from quillspark.operators import vector
from quillspark.plans.binding import Family
from quillspark.plans.retrieval import _TOKENS, _UNITS, search_documents
from quillspark.sources import html_nodes, readers
from quillspark.streaming.delivery import retry_delay
from quillspark.tables import table

_F = Family()
QUERIES, ORACLES = _F.queries, _F.oracles


def _verdicts(name: str, check: Callable, cases: list[tuple[tuple, str]]) -> None:
    """A query of the outcome of each case; its SQL is the expected outcomes."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = []
        for i, (arguments, _) in enumerate(cases):
            try:
                check(*arguments)
                out.append((i, "ok"))
            except rq.InvalidRequest as refused:
                out.append((i, str(refused)))
        return spark.createDataFrame(out, "case_no int, outcome string")

    _F.frame(name, run, "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{want}')" for i, (_, want) in enumerate(cases)) + ") v(case_no, outcome)")


_verdicts("prd30_search_input", rq.search_input, [(("q", ["a"], [], 1), "ok"), ((" ", [], [], 1), "query"), (("q", ["a", "a"], [], 1), "sources"), (("q", [], list("abcdefghi"), 1), "types"), (("q", [], [], 101), "page")])
_verdicts("prd31_remote_input", rq.remote_input, [(("t", [("a", 1)], 5, ["a"]), "ok"), (("", [], 5, []), "text"), (("t", [("b", 1)], 5, ["a"]), "facets"), (("t", [("a", [1])], 5, ["a"]), "facet value"), (("t", [], 0, []), "window")])
_verdicts("vec04_query_compile", rq.vector_query, [((" q ", 5, True), "ok"), (("q", 5, False), "activation"), (("  ", 5, True), "text"), (("q", 101, True), "window")])
_verdicts("grf05_plan_validation", rq.graph_plan, [((["s"], ["h"], ["n"], 2, 2, 9), "ok"), (([], ["h"], ["n"], 2, 2, 9), "empty plan"), ((["s"], ["h"], ["n"], 0, 2, 9), "budget"), ((["s", "t", "u"], ["h"], ["n"], 2, 2, 9), "over budget")])
_verdicts("stm08_policy_validation", rq.delivery_policy, [((32, 8, 30000, 5000, 1000, 300000), "ok"), ((33, 8, 30000, 5000, 1000, 300000), "size"), ((1, 1, 30000, 10000, 1000, 300000), "lease"), ((1, 1, 30000, 5000, 5000, 1000), "backoff")])
_verdicts("top12_page_size", rq.page_size, [((1,), "ok"), ((200,), "ok"), ((0,), "page size"), ((201,), "page size")])
_TOKEN = rq.encode_cursor("documents", "created", {"a": 1}, "p", 3, ["x", 7])
_verdicts("top08_cursor_token", rq.decode_cursor, [((_TOKEN, "documents", "created", {"a": 1}, "p", 3), "ok"), ((_TOKEN, "documents", "created", {"a": 2}, "p", 3), "cursor"), ((_TOKEN, "documents", "created", {"a": 1}, "q", 3), "cursor"), (("bad", "documents", "created", {}, "p", 3), "cursor")])


def _one_shot(age: float, binding: str, twice: bool) -> None:
    store = rq.CursorStore()
    handle = store.issue(("actor",), 20, 0.0)
    if twice:
        store.consume(handle, ("actor",), 1.0)
    store.consume(handle, (binding,), age)


_verdicts("top09_ram_cursor", _one_shot, [((30.0, "actor", False), "ok"), ((61.0, "actor", False), "cursor"), ((1.0, "other", False), "cursor"), ((1.0, "actor", True), "cursor")])


def _container(kind: str, name: str, text: str) -> bytes:
    """A smallest container of one fragment."""
    word, sheet, drawing = ("http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main")
    parts = {
        "docx": {"word/document.xml": f'<w:document xmlns:w="{word}"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>'},
        "xlsx": {"xl/workbook.xml": "<w/>", "xl/worksheets/sheet1.xml": f'<s xmlns="{sheet}"><c r="A1" t="inlineStr"><is><t>{text}</t></is></c></s>'},
        "pptx": {"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": f'<s xmlns:a="{drawing}"><a:p><a:r><a:t>{text}</a:t></a:r></a:p></s>'},
        "zip": {"a.txt": text},
    }[kind]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for part, body in ({"[Content_Types].xml": "<Types/>"} | parts if kind != "zip" else parts).items():
            z.writestr(part, body)
    return out.getvalue()


def _containers(spark: SparkSession, d: str, kind: str) -> DataFrame:
    names = table(spark, d, "nation").select("n_nationkey", "n_name").collect()  # 25 rows
    return spark.createDataFrame([(r["n_nationkey"], kind, "utf-8", bytearray(_container(kind, r["n_name"], r["n_name"]))) for r in names], "item long, format string, charset string, raw binary")


for _id, _kind, _unit in (("src05_docx_reader", "docx", "Paragraph"), ("src06_spreadsheet_reader", "xlsx", "Cell"), ("src07_pptx_reader", "pptx", "Paragraph")):
    _F.frame(_id, lambda spark, d, kind=_kind: readers.extract_units(_containers(spark, d, kind)).select("item", "kind", "text"), f"SELECT n_nationkey::BIGINT AS item, '{_unit}' AS kind, n_name AS text FROM nation")


def _zips(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for r in _containers(spark, d, "zip").collect():
        plan = {"a.txt": ("text", "utf-8")} if r["item"] % 3 else {"b.txt": ("text", "utf-8")}
        try:
            out += [(r["item"], "ok", u[2]) for u in readers.read_zip(bytes(r["raw"]), plan)]
        except readers.ReaderFailure as failure:
            out.append((r["item"], str(failure), None))
    return spark.createDataFrame(out, "item long, outcome string, text string")


_F.frame("src09_archive_reader", _zips, "SELECT n_nationkey::BIGINT AS item, CASE WHEN n_nationkey % 3 = 0 THEN 'UnregisteredMember' ELSE 'ok' END AS outcome, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS text FROM nation")
_F.frame("src15_ooxml_sniff", lambda spark, d: spark.createDataFrame([(k, readers.detect_ooxml(_container(k, "x", "y"))) for k in ("docx", "xlsx", "pptx", "zip")], "container string, detected string"), "SELECT * FROM (VALUES ('docx', 'docx'), ('xlsx', 'xlsx'), ('pptx', 'pptx'), ('zip', NULL)) v(container, detected)")
_F.frame("fpr02_text_projection", lambda spark, d: table(spark, d, "documents").select("doc_id", F.sha2(normalize_newlines(F.col("text")), 256).alias("fingerprint")), "SELECT doc_id, sha256(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)))) AS fingerprint FROM documents")
_EVENT = uuid.UUID(int=7)
_F.frame("dat06_retry_delay", lambda spark, d: spark.createDataFrame([(n, 2 ** (n - 1) <= retry_delay(_EVENT, n) <= 1.25 * 2 ** (n - 1), retry_delay(_EVENT, n) <= 300) for n in range(1, 9)] + [(10, False, retry_delay(_EVENT, 10) == 300)], "attempt int, within boolean, capped boolean"), "SELECT CAST(n AS INT) AS attempt, true AS within, true AS capped FROM range(1, 9) r(n) UNION ALL SELECT 10, false, true")
_F.frame("mth03_mean_pool", lambda spark, d: table(spark, d, "embeddings").select("vec_id", vector.mean_pool(F.array(*(F.transform(F.slice("embedding", s, 2), lambda x: x.cast("double")) for s in (1, 2, 3))), F.array(F.lit(1), F.lit(0), F.lit(1))).alias("p")).select("vec_id", F.round(F.col("p")[0], 6).alias("x"), F.round(F.col("p")[1], 6).alias("y")),
         "SELECT vec_id, round(a / sqrt(a * a + b * b), 6) AS x, round(b / sqrt(a * a + b * b), 6) AS y FROM (SELECT vec_id, embedding[1]::DOUBLE + embedding[3]::DOUBLE AS a, embedding[2]::DOUBLE + embedding[4]::DOUBLE AS b FROM embeddings) x")
_F.frame("fpr03_html_projection", lambda spark, d: html_nodes.html_fingerprints(table(spark, d, "pages").select(F.col("page_id").alias("id"), "html")))
_F.frame("dif06_html_diff", lambda spark, d: html_nodes.html_diff(table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("base"), F.when(F.col("page_id") % 2 == 0, F.regexp_replace("html", "<h1>", "<h1>changed ")).otherwise(F.regexp_replace("html", "<article>", "<article><hr>")).alias("target"))).select("id", "kind"),
         "SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN 'Text' ELSE 'Added' END AS kind FROM pages")
_F.same("mth05_bm25", "SELECT p_brand, n, df, round(ln(1 + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))), 9) AS idf FROM (SELECT p_brand, count(*) AS df FROM part GROUP BY p_brand) a CROSS JOIN (SELECT count(*) AS n FROM part) b")
_TWO = f"""WITH u AS (SELECT doc_id, line, contains(text, 'the and') AS literal, list_filter({_TOKENS.format('text')}, lambda x: strlen(x) < 40) AS t FROM ({_UNITS}) x),
r AS (SELECT doc_id, line, literal, len(t) AS n, len(list_filter(t, lambda x: x = 'the')) AS tf0, len(list_filter(t, lambda x: x = 'and')) AS tf1 FROM u),
s AS (SELECT count(*)::DOUBLE AS n_units, sum(n)::DOUBLE / count(*) AS average, count(*) FILTER (WHERE tf0 > 0)::DOUBLE AS df0, count(*) FILTER (WHERE tf1 > 0)::DOUBLE AS df1 FROM r),
m AS (SELECT doc_id, line, literal, round({" + ".join(f"ln(1 + (n_units - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / average))" for i in range(2))}, 6) AS score FROM r, s WHERE tf0 > 0 AND tf1 > 0),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY literal DESC, score DESC, line) = 1)
SELECT doc_id, CAST(line AS INT) AS line, score, CAST(row_number() OVER (ORDER BY literal DESC, score DESC, doc_id) AS INT) AS rank FROM b ORDER BY rank LIMIT 10"""
_F.frame("lex08_scoring", lambda spark, d: search_documents(spark, d, "the and", 10).select("doc_id", "line", "score", "rank"), _TWO)
