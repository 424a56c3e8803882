"""N-ary graph traversal over relations and their participants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.operators.skew import possible
from quillspark.scratch import materialize


class BudgetExceeded(RuntimeError):
    """A traversal went over its budget; results are never cut instead."""


@dataclass(frozen=True)
class Hop:
    """From a resource in one role to the resources in another of relations of one type."""

    relation_type: str
    from_role: str
    to_role: str


def contains(at, start: Column, end: Column) -> Column:
    """Half-open interval with open null ends."""
    return F.coalesce(F.lit(at) >= start, F.lit(True)) & F.coalesce(F.lit(at) < end, F.lit(True))


def traverse(participants: DataFrame, relations: DataFrame, seeds: DataFrame, plan: list[Hop], visible: DataFrame | None = None, max_relations: int = 1_000_000) -> DataFrame:
    """Paths of ``plan`` from ``seeds`` (resource): start, resource, path.

    ``participants``: relation_id, role, resource; ``relations``: relation_id,
    relation_type.  With ``visible`` (resource), relations with a hidden
    participant are not followed.  A hop that follows more than
    ``max_relations`` relations raises.  Each hop reads the tables past what the
    frontier touches: only relations with a participant in the frontier, and
    their participants, are moved or written, never the tables.  What a hop
    follows is written once: the budget is counted from it, and the next hop
    does not repeat the earlier ones.
    """
    if not plan:
        raise ValueError("a plan needs hops")
    if visible is not None:
        seeds = seeds.join(possible(visible, seeds, ["resource"]), "resource", "left_semi")
    frontier = seeds.select("resource").distinct().select(F.col("resource").alias("start"), "resource", F.array(F.col("resource").cast("string")).alias("path"))
    for i, hop in enumerate(plan):
        if i:
            frontier = materialize(frontier, "frontier")
        near = possible(participants.where(F.col("role") == hop.from_role).select("relation_id", "resource"), frontier, ["resource"])
        near = materialize(near.join(frontier.select("resource").distinct(), "resource", "left_semi").select("relation_id", "resource").distinct(), "near")
        members = materialize(possible(participants.select("relation_id", "role", "resource"), near, ["relation_id"]), "members")
        typed = possible(relations.where(F.col("relation_type") == hop.relation_type).select("relation_id"), near, ["relation_id"])
        usable = near.join(typed, "relation_id", "left_semi")
        if visible is not None:
            hidden = members.join(possible(visible, members, ["resource"]), "resource", "left_anti").select("relation_id").distinct()
            usable = usable.join(hidden, "relation_id", "left_anti")
        followed = materialize(frontier.join(usable, "resource"), "hop")
        if followed.select("relation_id").distinct().limit(max_relations + 1).count() > max_relations:
            raise BudgetExceeded(f"more than {max_relations} relations in a hop")
        far = members.where(F.col("role") == hop.to_role).select("relation_id", F.col("resource").alias("next")).distinct()
        step = F.concat("path", F.array(F.col("relation_id").cast("string"), F.col("next").cast("string")))
        frontier = followed.join(far, "relation_id").select("start", F.col("next").alias("resource"), step.alias("path"))
    return frontier


def group_paths(paths: DataFrame) -> DataFrame:
    """End resource, number of distinct paths, and the least of them."""
    distinct = paths.select("resource", F.array_join("path", ">").alias("path")).distinct()
    return distinct.groupBy("resource").agg(F.count(F.lit(1)).alias("paths"), F.min("path").alias("first_path"))


def check_paths(paths: DataFrame, participants: DataFrame, relations: DataFrame, seeds: DataFrame, plan: list[Hop], max_paths: int = 1_000_000) -> DataFrame:
    """Returned paths (start, resource, path) with ``problem``: the first rule of ``plan`` that one breaks, null without.

    "shape": as many steps as hops; "seed": starts at a seed; "endpoint": ends at
    its resource; "relation": each step's is known and of the hop's type;
    "participants": each step's has two or more, none without a role, and both
    ends in the hop's roles.  More than ``max_paths`` paths raise.
    """
    if paths.limit(max_paths + 1).count() > max_paths:
        raise BudgetExceeded(f"more than {max_paths} paths")
    members = F.collect_set(F.struct("role", F.col("resource").cast("string").alias("resource")))
    facts = participants.join(relations, "relation_id").groupBy(F.col("relation_id").cast("string").alias("relation_id")).agg(F.collect_set("relation_type").alias("types"), members.alias("members"))
    at = lambda i: F.get("path", F.lit(i))
    out = paths.join(seeds.select(F.col("resource").cast("string").alias("seed")).distinct(), at(0) == F.col("seed"), "left")
    first, last = at(0), F.element_at("path", -1)
    problem = F.when(F.size("path") != 2 * len(plan) + 1, "shape").when(F.col("seed").isNull() | ~first.eqNullSafe(F.col("start")), "seed").when(~last.eqNullSafe(F.col("resource")), "endpoint")
    for i, hop in enumerate(plan):
        out = out.join(facts.select(F.col("relation_id").alias(f"r{i}"), F.col("types").alias(f"t{i}"), F.col("members").alias(f"m{i}")), at(2 * i + 1) == F.col(f"r{i}"), "left")
        has = lambda role, k, m=f"m{i}": F.exists(m, lambda x: (x["role"] == role) & (x["resource"] == at(k)))
        whole = (F.size(f"m{i}") >= 2) & F.forall(f"m{i}", lambda x: x["role"] != "") & has(hop.from_role, 2 * i) & has(hop.to_role, 2 * i + 2)
        problem = problem.when(~F.coalesce(F.array_contains(f"t{i}", hop.relation_type), F.lit(False)), "relation").when(~F.coalesce(whole, F.lit(False)), "participants")
    return out.select("start", "resource", "path", problem.alias("problem"))
