import pytest
from pyspark.sql import functions as F

from quillspark.functions import gates, truth as t
from quillspark.functions.truth import Operand


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("x")).first()["x"]


I = lambda v: Operand("Integer", F.lit(v).cast("bigint"))  # noqa: E731, E741
L = lambda *v: Operand("List", F.array(*map(F.lit, v)))
TRUTHS = ("True", "False", "Unknown", "Error")


@pytest.mark.parametrize("a", TRUTHS)
@pytest.mark.parametrize("b", TRUTHS)
def test_connectives(value, a, b):
    both = {a, b}
    want_and = next(x for x in ("Error", "False", "Unknown", "True") if x in both)
    want_or = next(x for x in ("Error", "True", "Unknown", "False") if x in both)
    assert value(t.and_(F.lit(a), F.lit(b))) == want_and and value(t.or_(F.lit(a), F.lit(b))) == want_or
    assert value(t.not_(F.lit(a))) == {"True": "False", "False": "True"}.get(a, a)


def test_empty_connectives_are_errors(value):
    assert value(t.and_()) == "Error" and value(t.or_()) == "Error"


def test_missing_and_types(value):
    assert value(t.eq(I(None), I(1))) == "Unknown"
    assert value(t.eq(I(1), Operand("String", F.lit("1")))) == "Error"
    assert value(t.lt(L(1), L(2))) == "Error"


def test_presence(value):
    flag = Operand("Bool", F.lit(False))
    assert value(t.missing(flag)) == "False" and value(t.exists(flag)) == "True"
    assert value(t.evaluate(("missing", "x"), {})) == "True"


def test_money_and_decimal(value):
    money = lambda n, c: Operand("Money", F.lit(n).cast("decimal(38,0)"), F.lit(c))
    assert value(t.lt(money("9007199254740993", "JPY"), money("9007199254740994", "JPY"))) == "True"
    assert value(t.eq(money("100", "JPY"), money("100", "USD"))) == "Error"
    decimal = lambda n, p: Operand("Decimal", F.lit(n).cast(p))
    assert value(t.lte(decimal("1.20", "decimal(5,2)"), decimal("1.3", "decimal(5,1)"))) == "True"


def test_collections(value):
    assert value(t.in_(I(1), L(1, 2), "Integer")) == "True"
    assert value(t.in_(I(1), L("a"), "String")) == "Error"
    assert value(t.subset(L(), L(1))) == "True" and value(t.intersects(L(), L(1))) == "False"
    assert value(t.eq(Operand("Set", F.array(F.lit(1), F.lit(1))), Operand("Set", F.array(F.lit(1))))) == "True"


def test_depth(value):
    tree = ("exists", "x")
    for _ in range(t.MAX_DEPTH + 1):
        tree = ("not", tree)
    assert value(t.evaluate(tree, {})) == "Error"


def test_gates(value):
    assert value(gates.rule_state(F.lit("False"), True)) == "Excluded"
    assert value(gates.rule_state(F.lit("True"), True, F.lit("weak"))) == "Unresolved"
    assert value(gates.rule_state(F.lit("False"), False)) == "Applicable"
    assert value(gates.strongest([F.lit("Unresolved"), F.lit("Invalid"), F.lit("Excluded")])) == "Invalid"
