"""Evidence minimums, applicability and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: States from weakest to strongest claim on a candidate.
STATES = ("Applicable", "Unresolved", "Excluded", "Invalid")


def accepts(minimum: str, origin: Column) -> Column:
    """Does a fact's origin satisfy Any, NotInferred or AuthoritativeOrExplicit?"""
    if minimum == "Any":
        return F.lit(True)
    if minimum == "NotInferred":
        return origin != "Inferred"
    return origin.isin("Authoritative", "Explicit")


def first_weak_fact(origins: dict[str, Column], minimum: str) -> Column:
    """Name of the first present fact, in the order given, whose origin is too weak; null if none is."""
    found = [F.when(origin.isNotNull() & ~accepts(minimum, origin), F.lit(name)) for name, origin in origins.items()]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def rule_state(truth: Column, hard: bool, weak: Column | None = None) -> Column:
    """State that one discriminator asks for; a weak fact makes anything but an error unknown."""
    if weak is not None:
        truth = F.when(weak.isNotNull() & (truth != "Error"), "Unknown").otherwise(truth)
    out = F.when(truth == "Error", "Invalid")
    if hard:
        out = out.when(truth == "False", "Excluded").when(truth == "Unknown", "Unresolved")
    return out.otherwise("Applicable")


def strongest(states: list[Column]) -> Column:
    """Invalid over Excluded over Unresolved over Applicable."""
    order = F.array(*map(F.lit, STATES))
    ranks = [F.array_position(order, s) for s in states]
    return F.element_at(order, reduce(lambda a, b: F.greatest(a, b), ranks).cast("int"))
