"""Queries of typed predicates, applicability and gates.

Facts of a subject are columns of part; every seventh size, fifth brand is
missing.  Origins follow from the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.functions import gates, truth as t
from quillspark.functions.truth import Operand
from quillspark.plans.binding import Family
from quillspark.tables import table

_F = Family()
QUERIES, ORACLES = _F.queries, _F.oracles

_FACTS = """(SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS size, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS brand,
  p_type AS type, p_retailprice AS price, CASE WHEN p_partkey % 2 = 0 THEN 'JPY' ELSE 'USD' END AS currency, CASE p_partkey % 5 WHEN 0 THEN 'Explicit' WHEN 1 THEN 'Authoritative' WHEN 2 THEN 'Observed' WHEN 3 THEN 'Derived' ELSE 'Inferred' END AS origin FROM part) f"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    origin = F.element_at(F.array(*map(F.lit, ("Explicit", "Authoritative", "Observed", "Derived", "Inferred"))), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("k"), F.when(k % 7 != 0, F.col("p_size")).alias("size"), F.when(k % 5 != 0, F.col("p_brand")).alias("brand"), F.col("p_type").alias("type"), F.col("p_retailprice").alias("price"), F.when(k % 2 == 0, "JPY").otherwise("USD").alias("currency"), origin.alias("origin"))


def _int(value) -> Operand:
    return Operand("Integer", value if isinstance(value, Column) else F.lit(value))


def _str(value) -> Operand:
    return Operand("String", value if isinstance(value, Column) else F.lit(value))


def _list(*values) -> Operand:
    return Operand("List", F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)))


def _truth(name: str, build, sql: str) -> None:
    """A query of one truth per subject."""
    _F.frame(name, lambda spark, d: _facts(spark, d).select("k", build().alias("truth")), f"SELECT k, {sql} AS truth FROM {_FACTS}")


def _sql3(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'True' WHEN NOT ({condition}) THEN 'False' ELSE 'Unknown' END"


_A, _B = "size > 20", "brand = 'Brand#3'"
_truth("prd01_evaluate", lambda: t.evaluate(("and", ("gt", "size", _int(20)), ("or", ("eq", "brand", _str("Brand#3")), ("not", ("exists", "brand")), ("missing", "nothing"))), {"size": _int(F.col("size")), "brand": _str(F.col("brand"))}), _sql3(_A))
_truth("prd02_and", lambda: t.and_(t.gt(_int(F.col("size")), _int(20)), t.eq(_str(F.col("brand")), _str("Brand#3"))), _sql3(f"({_A}) AND ({_B})"))
_truth("prd03_or", lambda: t.or_(t.gt(_int(F.col("size")), _int(20)), t.eq(_str(F.col("brand")), _str("Brand#3"))), _sql3(f"({_A}) OR ({_B})"))
_truth("prd04_not", lambda: t.not_(t.gt(_int(F.col("size")), _int(20))), _sql3(f"NOT ({_A})"))
_truth("prd05_exists_missing", lambda: t.and_(t.exists(_int(F.col("size"))), t.missing(_str(F.col("brand")))), "CASE WHEN size IS NOT NULL AND brand IS NULL THEN 'True' ELSE 'False' END")
_truth("prd06_eq_ne", lambda: t.or_(t.eq(_str(F.col("brand")), _str("Brand#3")), t.ne(_int(F.col("size")), _str("x"))), "CASE WHEN size IS NOT NULL THEN 'Error' WHEN brand = 'Brand#3' THEN 'True' ELSE 'Unknown' END")
_truth("prd07_ordering", lambda: t.and_(t.lt(_int(F.col("size")), _int(40)), t.lte(_int(F.col("size")), _int(30)), t.gte(_int(F.col("size")), _int(10))), _sql3("size < 40 AND size <= 30 AND size >= 10"))
_truth("prd08_in", lambda: t.in_(_str(F.col("brand")), _list("Brand#1", "Brand#2"), "String"), _sql3("brand IN ('Brand#1', 'Brand#2')"))
_truth("prd09_contains", lambda: t.contains(_list("Brand#1", "Brand#2"), _int(F.col("size")), "String"), "CASE WHEN size IS NULL THEN 'Unknown' ELSE 'Error' END")
_truth("prd10_intersects", lambda: t.intersects(_list(F.col("type"), "ECONOMY"), _list("STANDARD", "PROMO")), _sql3("type IN ('STANDARD', 'PROMO')"))
_truth("prd11_subset", lambda: t.subset(_list(F.col("type")), _list("STANDARD", "PROMO", "ECONOMY")), _sql3("type IN ('STANDARD', 'PROMO', 'ECONOMY')"))
_truth("prd12_concept", lambda: t.concept(Operand("ConceptRef", F.col("brand")), Operand("ConceptRef", F.lit("Brand#1")), lambda a, b: a.startswith(b)), _sql3("starts_with(brand, 'Brand#1')"))
_truth("prd13_missing_operand", lambda: t.evaluate(("eq", "nothing", _int(1)), {}), "'Unknown'")
_truth("prd14_decimal_compare", lambda: t.lte(Operand("Decimal", F.col("price").cast("decimal(18,4)")), Operand("Decimal", F.lit("1000.5").cast("decimal(10,1)"))), _sql3("price <= 1000.5"))
_truth("prd15_money_compare", lambda: t.lt(Operand("Money", F.col("price"), F.col("currency")), Operand("Money", F.lit(1000.0), F.lit("JPY"))), "CASE WHEN currency <> 'JPY' THEN 'Error' WHEN price < 1000 THEN 'True' ELSE 'False' END")
_truth("prd16_list_equality", lambda: t.eq(_list(F.col("type"), "x"), _list("STANDARD", "x")), _sql3("type = 'STANDARD'"))
_truth("prd17_set_equality", lambda: t.eq(Operand("Set", F.array("type", "type", F.lit("x"))), Operand("Set", F.array(F.lit("x"), F.lit("STANDARD")))), _sql3("type = 'STANDARD'"))

_F.frame("prd18_minimum_evidence", lambda spark, d: _facts(spark, d).select("k", gates.accepts("NotInferred", F.col("origin")).alias("not_inferred"), gates.accepts("AuthoritativeOrExplicit", F.col("origin")).alias("strong"), gates.accepts("Any", F.col("origin")).alias("any_origin")),
         f"SELECT k, origin <> 'Inferred' AS not_inferred, origin IN ('Authoritative', 'Explicit') AS strong, true AS any_origin FROM {_FACTS}")


def _weak() -> Column:
    present = lambda c: F.when(F.col(c).isNotNull(), F.col("origin"))
    return gates.first_weak_fact({"size": present("size"), "brand": present("brand")}, "AuthoritativeOrExplicit")


_WEAK = "CASE WHEN size IS NOT NULL AND origin NOT IN ('Authoritative', 'Explicit') THEN 'size' WHEN brand IS NOT NULL AND origin NOT IN ('Authoritative', 'Explicit') THEN 'brand' END"
_F.frame("prd19_insufficient_fact", lambda spark, d: _facts(spark, d).select("k", _weak().alias("fact")), f"SELECT k, {_WEAK} AS fact FROM {_FACTS}")


def _applicability() -> Column:
    hard = gates.rule_state(t.gt(_int(F.col("size")), _int(20)), True, _weak())
    soft = gates.rule_state(t.lt(Operand("Money", F.col("price"), F.col("currency")), Operand("Money", F.lit(1000.0), F.lit("JPY"))), False)
    return gates.strongest([hard, soft])


_APPLICABILITY = f"CASE WHEN currency <> 'JPY' THEN 'Invalid' WHEN ({_WEAK}) IS NOT NULL OR size IS NULL THEN 'Unresolved' WHEN size <= 20 THEN 'Excluded' ELSE 'Applicable' END"
_F.frame("prd20_applicability", lambda spark, d: _facts(spark, d).select("k", _applicability().alias("state")), f"SELECT k, {_APPLICABILITY} AS state FROM {_FACTS}")
_F.frame("prd21_qualify", lambda spark, d: _facts(spark, d).where(_applicability() == "Applicable").select("k"), f"SELECT k FROM {_FACTS} WHERE {_APPLICABILITY} = 'Applicable'")
_F.frame("prd22_contrast", lambda spark, d: _facts(spark, d).select("k", F.when(F.col("k") % 3 == 0, _applicability()).otherwise("Invalid").alias("state")), f"SELECT k, CASE WHEN k % 3 = 0 THEN {_APPLICABILITY} ELSE 'Invalid' END AS state FROM {_FACTS}")


def _facet(spark: SparkSession, d: str) -> DataFrame:
    """Facet outcome: the facet's own state first, then the comparison."""
    k = F.col("k")
    state = F.when(k % 11 == 0, "NotApplicable").when(k % 13 == 0, "Conflict").when(F.col("brand").isNull(), "Unknown").otherwise("Known")
    match = F.when(t.eq(_str(F.col("brand")), _str("Brand#3")) == "True", "Match").otherwise("Mismatch")
    return _facts(spark, d).select("k", F.when(state == "Known", match).otherwise(state).alias("outcome"))


_F.frame("prd23_facet_outcome", _facet, f"SELECT k, CASE WHEN k % 11 = 0 THEN 'NotApplicable' WHEN k % 13 = 0 THEN 'Conflict' WHEN brand IS NULL THEN 'Unknown' WHEN brand = 'Brand#3' THEN 'Match' ELSE 'Mismatch' END AS outcome FROM {_FACTS}")


def _gates() -> dict[str, Column]:
    k = F.col("k")
    return {"applicability": F.when(k % 2 == 0, "Applicable").otherwise("Unresolved"), "structured": F.when(k % 3 == 0, "Excluded").otherwise("Applicable"), "access": F.when(k % 17 == 0, "Invalid").otherwise("Applicable"), "temporal": F.when(k % 5 == 0, "Unresolved").otherwise("Applicable")}


_F.frame("prd24_gate_state", lambda spark, d: _facts(spark, d).select("k", gates.strongest(list(_gates().values())).alias("state")), f"SELECT k, CASE WHEN k % 17 = 0 THEN 'Invalid' WHEN k % 3 = 0 THEN 'Excluded' WHEN k % 2 <> 0 OR k % 5 = 0 THEN 'Unresolved' ELSE 'Applicable' END AS state FROM {_FACTS}")
_F.frame("prd25_gate_gaps", lambda spark, d: _facts(spark, d).select("k", F.concat_ws(",", *(F.when(s == "Unresolved", F.lit(g + ":blocking")) for g, s in _gates().items())).alias("gaps")), f"SELECT k, concat_ws(',', CASE WHEN k % 2 <> 0 THEN 'applicability:blocking' END, CASE WHEN k % 5 = 0 THEN 'temporal:blocking' END) AS gaps FROM {_FACTS}")

_F.same("prd26_relation_pattern", """SELECT DISTINCT a.l_orderkey AS relation_id FROM lineitem a WHERE a.l_returnflag = 'R' AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey = 3) AND EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = a.l_orderkey AND c.l_linenumber = 1)""")
_F.same("prd27_relation_allowed", """SELECT l_orderkey, l_linenumber, l_partkey, (l_returnflag IN ('R', 'A') AND l_linestatus = 'O' AND l_shipdate <= TIMESTAMP '1998-01-01 00:00:00') AS allowed FROM lineitem""")
_F.same("prd28_interval_contains", """SELECT o_orderkey, coalesce(TIMESTAMP '1998-01-01 00:00:00' >= valid_from, true) AND coalesce(TIMESTAMP '1998-01-01 00:00:00' < valid_to, true) AS contains FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS valid_from, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL '90' DAY END AS valid_to FROM orders) x""")
_F.same("prd29_catalog_filters", """SELECT p_partkey FROM part WHERE position('ring' IN p_name) > 0 AND p_type = 'ECONOMY' AND p_size >= 5 AND p_size < 40""")
_F.same("prd32_opaque_native_id", """SELECT page_id, NOT (url = '' OR position('://' IN url) > 0 OR position('//' IN url) = 1) AS whole_valid, NOT (regexp_like(tail, '^[A-Za-z][A-Za-z0-9+.-]*:') OR tail = '') AS tail_valid FROM (SELECT page_id, url, split_part(url, '/', 4) AS tail FROM pages) x""", """SELECT page_id, NOT (url = '' OR position('://' IN url) > 0 OR position('//' IN url) = 1) AS whole_valid, NOT (regexp_matches(tail, '^[A-Za-z][A-Za-z0-9+.-]*:') OR tail = '') AS tail_valid FROM (SELECT page_id, url, split_part(url, '/', 4) AS tail FROM pages) x""")
