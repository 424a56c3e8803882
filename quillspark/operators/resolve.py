"""Resolution of competing knowledge: authority, identity, observation, time, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Identity evidence that is strong, and evidence roles that are direct.
STRONG_EVIDENCE = ("StableProviderId", "SourceNativeId", "CanonicalUri", "IntegrityDigest", "ExplicitDeclaration", "SchemaAndContentIdentity")
DIRECT_ROLES = ("Primary", "Corroborating", "Contradicting")


def resolve_assertions(assertions: DataFrame, policy: DataFrame) -> DataFrame:
    """subject, predicate, state, value, rank from assertions (subject, predicate, value, origin).

    ``policy`` (origin, rank) says which origins count.  Inferred values drop
    out beside Authoritative or Curated ones; of the rest only the highest rank
    counts, and more than one distinct value of it is a conflict.
    """
    ranked = assertions.join(F.broadcast(policy), "origin")
    keys = ["subject", "predicate"]
    protected = ranked.groupBy(*keys).agg(F.bool_or(F.col("origin").isin("Authoritative", "Curated")).alias("protected"), F.max("rank").alias("top"), F.max(F.when(F.col("origin") != "Inferred", F.col("rank"))).alias("top_other"))
    rows = ranked.join(protected, keys).where(~(F.col("protected") & (F.col("origin") == "Inferred")))
    rows = rows.where(F.col("rank") == F.when(F.col("protected"), F.col("top_other")).otherwise(F.col("top")))
    out = rows.groupBy(*keys).agg(F.count_distinct("value").alias("n"), F.min("value").alias("least"), F.max("rank").alias("rank"))
    return out.select(*keys, F.when(F.col("n") > 1, "Conflict").otherwise("Resolved").alias("state"), F.when(F.col("n") == 1, F.col("least")).alias("value"), "rank")


def resolve_identity(evidence: DataFrame) -> DataFrame:
    """pair, state from evidence (pair, kind, supports)."""
    strong = F.col("kind").isin(*STRONG_EVIDENCE)
    flags = evidence.groupBy("pair").agg(F.bool_or(strong & F.col("supports")).alias("yes"), F.bool_or(strong & ~F.col("supports")).alias("no"), F.bool_or(~strong & F.col("supports")).alias("weak"))
    state = F.when(F.col("yes") & F.col("no"), "Conflict").when(F.col("yes"), "Resolved").when(F.col("no"), "Unresolved").when(F.col("weak"), "Provisional").otherwise("Unresolved")
    return flags.select("pair", state.alias("state"))


def effective_state(observations: DataFrame) -> DataFrame:
    """resource, presence, integrity_conflict from observations (resource, seq, observed_at, presence, coverage, version, digest).

    The latest observation counts, of equals the later row; an absence seen with
    partial or query coverage proves nothing.  Two digests of one version are a
    conflict; observations without a version say nothing of that.
    """
    latest = observations.groupBy("resource").agg(F.max_by(F.struct("presence", "coverage"), F.struct("observed_at", "seq")).alias("o"))
    presence = F.when((F.col("o.presence") == "Absent") & F.col("o.coverage").isin("PartialEnumeration", "QueryResult"), "Unknown").otherwise(F.col("o.presence"))
    digests = observations.where("digest is not null and version is not null").groupBy("resource", "version").agg(F.count_distinct("digest").alias("n"))
    broken = digests.groupBy("resource").agg(F.bool_or(F.col("n") > 1).alias("integrity_conflict"))
    return latest.join(broken, "resource", "left").select("resource", presence.alias("presence"), F.coalesce("integrity_conflict", F.lit(False)).alias("integrity_conflict"))


def freshness(anchor: Column, now: Column, max_age: Column) -> Column:
    """Fresh or Stale by age in seconds; Unknown without an anchor or limit, or with an anchor in the future."""
    age = now - anchor
    return F.when(anchor.isNull() | max_age.isNull() | (max_age < 0) | (anchor > now), "Unknown").when(age > max_age, "Stale").otherwise("Fresh")


def effective_at(start: Column, end: Column, target: Column) -> Column:
    """True in the half-open interval; Unknown without bounds."""
    inside = F.coalesce(target >= start, F.lit(True)) & F.coalesce(target < end, F.lit(True))
    return F.when(start.isNull() & end.isNull(), "Unknown").when(inside, "True").otherwise("False")


def direct_evidence(role: Column, is_summary: Column, origin: Column) -> Column:
    return ~is_summary & (F.trim(origin) != "") & role.isin(*DIRECT_ROLES)


def evidence_sufficiency(claims: DataFrame, evidence: DataFrame, min_origins: int) -> DataFrame:
    """claim, verdict from claims (claim, state) and evidence (claim, role, is_summary, origin).

    Independent origins are counted after trimming; a direct contradiction conflicts.
    """
    direct = direct_evidence(F.col("role"), F.col("is_summary"), F.col("origin"))
    found = evidence.groupBy("claim").agg(
        F.count_distinct(F.when(direct & (F.col("role") != "Contradicting"), F.trim("origin"))).alias("origins"),
        F.bool_or(direct & (F.col("role") == "Contradicting")).alias("against"))
    verdict = F.when(F.col("state") == "Invalid", "Invalid").when((F.col("state") == "Conflicted") | F.col("against"), "Conflicted").when(F.coalesce("origins", F.lit(0)) < min_origins, "Insufficient").when(F.col("state") != "Supported", "Unresolved").otherwise("Sufficient")
    return claims.join(found, "claim", "left").select("claim", verdict.alias("verdict"))
