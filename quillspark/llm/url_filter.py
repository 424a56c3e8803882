"""URL filter with empirical-Bayes host reputation, in DataFrame operations only.

Explicit rules come first.  Any other page is judged by its host: labelled
outcomes of the host's pages are shrunk through beta-binomial priors, host to
registered domain to suffix to all pages.  Prior strengths are moment estimates
from the spread of the children's rates at each level.  A page is blocked when
the lower posterior bound of its host's rate of bad pages is above a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.operators.skew import column_of, hot_cold_join, numbered, renamed
from quillspark.scratch import materialize

#: Rules as (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Suffixes of more than one label below which names are registered.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz")
Z, BAD_RATE, STRENGTH = 1.645, 0.5, (1.0, 1000.0)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    rest = F.substring_index(F.substring_index(F.substring_index(_after(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    before = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    at = F.locate("/", before)
    return F.when(at > 0, F.substring(before, at, F.length(before))).otherwise(F.lit(""))


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def registered_domain(host: Column, long_suffixes=LONG_SUFFIXES) -> Column:
    """The suffix and one label before it; a bare suffix stands for itself."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*long_suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def suffix_of(host: Column, long_suffixes=LONG_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*long_suffixes), two).otherwise(F.substring_index(host, ".", -1))


def rule_column(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule as struct<rule, verdict>, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(level: DataFrame, parent: list[str], low: float, high: float) -> DataFrame:
    """Prior strength per parent: moments of the children's bad rates."""
    rate = F.col("bad") / F.col("n")
    sums = level.where(F.col("n") > 0).groupBy(*parent).agg(F.sum("n").alias("t"), F.sum("bad").alias("b"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("t2"), F.sum(F.col("bad") * rate).alias("q"))
    t, b, k = F.col("t"), F.col("b"), F.col("k")
    mean = b / t
    # Weighted sum of squares between children, against what chance alone would give.
    between = F.col("q") - b * mean
    within = mean * (1 - mean)
    spread = (between - within * (k - 1)) / (t - F.col("t2") / t)
    strength = F.when((k < 2) | (within <= 0) | (t - F.col("t2") / t <= 0), F.lit(high)).when(spread <= 0, F.lit(high)).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), within / spread - 1)))
    return sums.select(*parent, strength.alias("m"))


def host_reputation(pages: DataFrame, host: str, bad: str, weight: str, z: float = Z, strength=STRENGTH) -> DataFrame:
    """Posterior per host from all its rows; ``bad`` is 1, 0 or null (not labelled).

    Each row stands for ``weight`` pages.

    Columns: the host, ``pages``, ``n`` and ``bad`` (labelled, bad), ``rate``
    (posterior mean) and ``low`` (its lower bound, ``z`` deviations below).
    """
    low, high = strength
    hosts = pages.groupBy(F.col(host).alias("host")).agg(F.sum(weight).alias("pages"), F.coalesce(F.sum(F.when(F.col(bad).isNotNull(), F.col(weight))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col(bad) * F.col(weight)), F.lit(0)).alias("bad"))
    hosts = materialize(hosts.withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix_of(F.col("host"))}), "host-outcomes")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # Two single rows: the overall rate and the strength of the suffixes' prior.
    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    prior = (float(bad or 0) + 0.5) / (float(n or 0) + 1)
    m_all = _strength(suffixes, [], low, high).agg(F.max("m")).first()[0] or high
    # One row per suffix, then per domain: each takes its prior from the level above.
    p_suffix = suffixes.select("suffix", ((F.col("bad") + F.lit(m_all * prior)) / (F.col("n") + F.lit(m_all))).alias("ps"))
    p_suffix = p_suffix.join(_strength(domains, ["suffix"], low, high), "suffix", "left").select("suffix", "ps", F.coalesce("m", F.lit(high)).alias("ms"))
    p_suffix = materialize(p_suffix.join(domains.groupBy("suffix").agg(F.count(F.lit(1)).alias("w")), "suffix"), "suffix-priors")
    p_domain = hot_cold_join(domains, p_suffix, ["suffix"], "w", F.col("domain")).select("domain", ((F.col("bad") + F.col("ms") * F.col("ps")) / (F.col("n") + F.col("ms"))).alias("pd"))
    p_domain = p_domain.join(_strength(hosts, ["domain"], low, high), "domain", "left").select("domain", "pd", F.coalesce("m", F.lit(high)).alias("md"))
    a, b = F.col("bad") + F.col("md") * F.col("pd"), F.col("n") - F.col("bad") + F.col("md") * (1 - F.col("pd"))
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    p_domain = materialize(p_domain.join(hosts.groupBy("domain").agg(F.count(F.lit(1)).alias("w")), "domain"), "domain-priors")
    return hot_cold_join(hosts, p_domain, ["domain"], "w", F.col("host")).select("host", "pages", "n", "bad", (a / (a + b)).alias("rate"), (a / (a + b) - z * deviation).alias("low"))


def url_filter(pages: DataFrame, labels: DataFrame, url_col: str = "url", rules=RULES, z: float = Z, bad_rate: float = BAD_RATE, strength=STRENGTH) -> DataFrame:
    """Every row of ``pages`` with ``uf_host``, ``uf_path``, ``uf_rule``, ``uf_verdict``, ``uf_rate`` and ``uf_low``.

    ``labels`` has doc_id, quality and toxic of the documents that pages show;
    a page's document is the number that starts the last segment of its path,
    and its outcome is bad where quality is 0 or toxic is 1.  Pages without a
    labelled document still count as the host's pages and are judged by the
    host's posterior.  Null urls and urls without ``://`` have empty host and
    path and share the empty host's posterior.  Labels repeated for one document
    count once (bad if any is bad); null labels count as unknown.  Repeated
    pages each count.  Empty tables give an empty result; with no labels at all
    the prior decides.  Other columns pass through; ``uf_`` columns of the input are replaced.
    """
    pages, names = numbered(pages, ("uf_host", "uf_path", "uf_rule", "uf_verdict", "uf_rate", "uf_low"))
    url = column_of(names, url_col)
    rows = pages.withColumns({"uf_host": host_of(F.coalesce(url, F.lit(""))), "uf_path": path_of(F.coalesce(url, F.lit("")))})
    outcome = labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull())).groupBy(F.col("doc_id").alias("uf_doc")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("uf_bad"))
    shown = rows.select("uf_host", F.expr("try_cast(regexp_extract(uf_path, '/([0-9]{1,18})[^/]*/?$', 1) as bigint)").alias("uf_doc"))
    # Counting pages per (host, document) first leaves the join as many rows as there are documents at most.
    shown = shown.groupBy("uf_host", "uf_doc").agg(F.count(F.lit(1)).alias("c"))
    # Pages that show no document have no outcome; they take no part in the join, where they would be one key.
    known = shown.where(F.col("uf_doc").isNotNull()).join(outcome, "uf_doc", "left").select("uf_host", "uf_bad", "c")
    joined = known.union(shown.where(F.col("uf_doc").isNull()).select("uf_host", F.lit(None).cast("int").alias("uf_bad"), "c"))
    hosts = host_reputation(joined, "uf_host", "uf_bad", "c", z, strength)
    hosts = materialize(hosts.select(F.col("host").alias("uf_host"), F.col("pages").alias("uf_pages"), F.col("rate").alias("uf_rate"), F.col("low").alias("uf_low")), "host-reputation")
    found = hot_cold_join(rows, hosts, ["uf_host"], "uf_pages", url)
    rule = rule_column(F.col("uf_host"), F.col("uf_path"), rules)
    own = F.when(F.col("uf_low") > bad_rate, "block").otherwise("allow")
    found = found.withColumn("uf_r", rule).withColumns({"uf_rule": F.col("uf_r.rule"), "uf_verdict": F.coalesce(F.col("uf_r.verdict"), own)})
    return found.select(*renamed(names), "uf_host", "uf_path", "uf_rule", "uf_verdict", "uf_rate", "uf_low")
