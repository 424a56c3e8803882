"""Four-valued predicates as columns.

A truth is "True", "False", "Unknown" or "Error".  An operand is a value column
with a static type tag; a null value is a missing fact.  Nothing short-circuits:
an error anywhere in a connective is an error of the whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

MAX_DEPTH = 64
_AND = ("True", "Unknown", "False", "Error")
_OR = ("False", "Unknown", "True", "Error")


@dataclass(frozen=True)
class Operand:
    """A typed value; ``unit`` is the currency or unit of Money and Quantity."""

    tag: str
    value: Column
    unit: Column | None = None


def known(condition: Column) -> Column:
    """True or False; a null condition is Unknown."""
    return F.when(condition.isNull(), "Unknown").when(condition, "True").otherwise("False")


def _ranked(truths: tuple[Column, ...], order: tuple[str, ...]) -> Column:
    if not truths:
        return F.lit("Error")
    ranks = [F.array_position(F.array(*map(F.lit, order)), t) for t in truths]
    top = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
    return F.element_at(F.array(*map(F.lit, order)), top.cast("int"))


def and_(*truths: Column) -> Column:
    """Error over False over Unknown over True; none is Error."""
    return _ranked(truths, _AND)


def or_(*truths: Column) -> Column:
    """Error over True over Unknown over False; none is Error."""
    return _ranked(truths, _OR)


def not_(truth: Column) -> Column:
    # A map names its argument once, so nested negations stay linear.
    return F.element_at(F.create_map(*map(F.lit, ("True", "False", "False", "True", "Unknown", "Unknown", "Error", "Error"))), truth)


def exists(fact: Operand) -> Column:
    return known(fact.value.isNotNull())


def missing(fact: Operand) -> Column:
    return known(fact.value.isNull())


def _compare(left: Operand, right: Operand, test: Callable[[Column, Column], Column]) -> Column:
    absent = left.value.isNull() | right.value.isNull()
    if left.tag != right.tag:
        return F.when(absent, "Unknown").otherwise("Error")
    out = known(test(left.value, right.value))
    if left.unit is not None and right.unit is not None:
        out = F.when(left.unit != right.unit, "Error").otherwise(out)
    return F.when(absent, "Unknown").otherwise(out)


def _same(tag: str) -> Callable[[Column, Column], Column]:
    if tag == "Set":
        return lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    return lambda a, b: a == b


def eq(left: Operand, right: Operand) -> Column:
    return _compare(left, right, _same(left.tag))


def ne(left: Operand, right: Operand) -> Column:
    return not_(eq(left, right))


def ordered(left: Operand, right: Operand, test: Callable[[Column, Column], Column]) -> Column:
    """Lists and sets have no order: comparing them is an error."""
    if left.tag in ("List", "Set"):
        return F.when(left.value.isNull() | right.value.isNull(), "Unknown").otherwise("Error")
    return _compare(left, right, test)


def lt(left: Operand, right: Operand) -> Column:
    return ordered(left, right, lambda a, b: a < b)


def lte(left: Operand, right: Operand) -> Column:
    return ordered(left, right, lambda a, b: a <= b)


def gt(left: Operand, right: Operand) -> Column:
    return ordered(left, right, lambda a, b: a > b)


def gte(left: Operand, right: Operand) -> Column:
    return ordered(left, right, lambda a, b: a >= b)


def in_(needle: Operand, haystack: Operand, element: str) -> Column:
    """Membership in a list or set whose elements have the tag ``element``; another tag is an error unless it is empty."""
    absent = needle.value.isNull() | haystack.value.isNull()
    if haystack.tag not in ("List", "Set"):
        return F.when(absent, "Unknown").otherwise("Error")
    if needle.tag != element:
        return F.when(absent, "Unknown").when(F.size(haystack.value) == 0, "False").otherwise("Error")
    return F.when(absent, "Unknown").otherwise(known(F.array_contains(haystack.value, needle.value)))


def contains(haystack: Operand, needle: Operand, element: str) -> Column:
    return in_(needle, haystack, element)


def intersects(left: Operand, right: Operand) -> Column:
    """Any element of the left in the right; an empty left is False."""
    return _compare(Operand("List", left.value), Operand("List", right.value), lambda a, b: F.size(F.array_intersect(a, b)) > 0)


def subset(left: Operand, right: Operand) -> Column:
    """Every element of the left in the right; an empty left is True."""
    return _compare(Operand("List", left.value), Operand("List", right.value), lambda a, b: F.size(F.array_except(a, b)) == 0)


def concept(left: Operand, right: Operand, test: Callable[[Column, Column], Column]) -> Column:
    """A concept relation by a pinned resolver; anything but concept references is an error."""
    if left.tag != "ConceptRef" or right.tag != "ConceptRef":
        return F.when(left.value.isNull() | right.value.isNull(), "Unknown").otherwise("Error")
    return _compare(left, right, test)


_BINARY = {"eq": eq, "ne": ne, "lt": lt, "lte": lte, "gt": gt, "gte": gte, "intersects": intersects, "subset": subset}


def evaluate(tree: tuple, facts: dict[str, Operand], depth: int = 0) -> Column:
    """Compile a tree like ("and", ("eq", "size", Operand), ("exists", "name")).

    Strings name facts; a name without a fact is a missing operand.  Trees
    deeper than ``MAX_DEPTH`` are Error.
    """
    if depth > MAX_DEPTH:
        return F.lit("Error")
    kind, *parts = tree
    operand = lambda x: facts.get(x, None) if isinstance(x, str) else x
    if kind in ("and", "or"):
        return (and_ if kind == "and" else or_)(*(evaluate(p, facts, depth + 1) for p in parts))
    if kind == "not":
        return not_(evaluate(parts[0], facts, depth + 1))
    if kind in ("exists", "missing"):
        fact = operand(parts[0])
        if fact is None:
            return F.lit("False" if kind == "exists" else "True")
        return exists(fact) if kind == "exists" else missing(fact)
    left, right = operand(parts[0]), operand(parts[1])
    if left is None or right is None:
        return F.lit("Unknown")
    if kind in ("in", "contains"):
        return in_(left, right, parts[2]) if kind == "in" else contains(left, right, parts[2])
    return _BINARY[kind](left, right)


def facts_in(tree: tuple) -> list[str]:
    """Fact names of a tree, in pre-order, left to right."""
    kind, *parts = tree
    out: list[str] = []
    for p in parts:
        out += facts_in(p) if isinstance(p, tuple) else [p] if isinstance(p, str) and kind not in ("in", "contains") or isinstance(p, str) and p in parts[:2] else []
    return list(dict.fromkeys(out))
