"""DuckDB SQL of the training-data queries that SQL can express."""

EXACT_DEDUP = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT norm, count(*) AS group_size,
         first(doc_id ORDER BY n_chars DESC, doc_id ASC NULLS LAST) AS keep_id
  FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size,
       d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""

_STRENGTH = """CASE WHEN count(*) < 2 OR sum(bad) / sum(n) * (1 - sum(bad) / sum(n)) <= 0
       OR sum(n) - sum(n * n) / sum(n) <= 0 THEN 1000.0
     WHEN (sum(bad * (bad / n)) - sum(bad) * (sum(bad) / sum(n)) - sum(bad) / sum(n) * (1 - sum(bad) / sum(n)) * (count(*) - 1)) / (sum(n) - sum(n * n) / sum(n)) <= 0 THEN 1000.0
     ELSE least(1000.0, greatest(1.0, sum(bad) / sum(n) * (1 - sum(bad) / sum(n))
       / ((sum(bad * (bad / n)) - sum(bad) * (sum(bad) / sum(n)) - sum(bad) / sum(n) * (1 - sum(bad) / sum(n)) * (count(*) - 1)) / (sum(n) - sum(n * n) / sum(n))) - 1)) END"""

URL_FILTER = f"""
WITH r AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
o AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
x AS (
  SELECT p.host, o.bad FROM p LEFT JOIN o
  ON o.doc_id = try_cast(nullif(regexp_extract(p.path, '/([0-9]{{1,18}})[^/]*/?$', 1), '') AS BIGINT)),
h AS (
  SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad,
         array_to_string(string_split(host, '.')[-2:], '.') AS domain,
         string_split(host, '.')[-1] AS suffix
  FROM x GROUP BY host),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
mg AS (SELECT coalesce(max(m), 1000.0) AS m FROM (SELECT {_STRENGTH} AS m FROM s WHERE n > 0)),
ms AS (SELECT suffix, {_STRENGTH} AS m FROM d WHERE n > 0 GROUP BY suffix),
md AS (SELECT domain, {_STRENGTH} AS m FROM h WHERE n > 0 GROUP BY domain),
g AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS p FROM s),
ps AS (SELECT s.suffix, (s.bad + mg.m * g.p) / (s.n + mg.m) AS p FROM s, mg, g),
pd AS (SELECT d.domain, (d.bad + coalesce(ms.m, 1000.0) * ps.p) / (d.n + coalesce(ms.m, 1000.0)) AS p
       FROM d JOIN ps USING (suffix) LEFT JOIN ms USING (suffix)),
ab AS (SELECT h.host, h.bad + coalesce(md.m, 1000.0) * pd.p AS a,
              h.n - h.bad + coalesce(md.m, 1000.0) * (1 - pd.p) AS b
       FROM h JOIN pd USING (domain) LEFT JOIN md USING (domain)),
q AS (SELECT host, a / (a + b) AS rate, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM ab),
rules(verdict, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
                                  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (
  SELECT p.page_id, p.host, p.path, q.rate, q.low,
    (SELECT max(struct_pack(n := length(rh || rp), rule := rh || rp, verdict := verdict)) FROM rules
     WHERE (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)) AS r
  FROM p JOIN q USING (host))
SELECT page_id, host, path, r.rule AS rule,
       coalesce(r.verdict, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       round(rate, 6) AS rate, round(low, 6) AS rate_low
FROM f
"""

TEMPERATURE_MIX = """
WITH r AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS s,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
src AS (SELECT s, sum(tokens)::BIGINT AS t, count(*) AS n, ceil(count(*) / 1000.0)::BIGINT AS nb FROM r GROUP BY s),
sh AS (SELECT s, t, t::DOUBLE / (SELECT sum(t) FROM src) AS p FROM src WHERE t > 0),
grid AS (
  SELECT k, sum(pow(p, k / 1024.0::DOUBLE)) AS z, max(t / pow(p, k / 1024.0::DOUBLE)) AS whole, max(pow(p, k / 1024.0::DOUBLE) / t) AS most
  FROM sh, range(0, 1025) AS g(k) GROUP BY k),
best AS (SELECT k, z, whole * z AS budget FROM grid WHERE most / z * (whole * z) <= 2 + 1e-9 ORDER BY k LIMIT 1),
q AS (
  SELECT src.*, pow(t::DOUBLE / (SELECT sum(t) FROM src), k / 1024.0::DOUBLE) / z * budget AS quota FROM src, best),
pl AS (SELECT *, CASE WHEN t > 0 THEN floor(quota / t + 1e-9)::BIGINT ELSE 1 END AS passes FROM q),
plan AS (SELECT *, CASE WHEN t > 0 THEN greatest(0, floor(quota - passes * t + 1e-6)::BIGINT) ELSE 0 END AS rest FROM pl),
k AS (
  SELECT r.*, p.t, p.nb, p.passes, p.rest, md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM r JOIN plan p USING (s)),
ko AS (SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % nb AS own FROM k),
kb AS (SELECT *, (own * (([2147483647, 2147483629, 2147483587, 2147483579][passes % 4 + 1] % nb) * ([2147483647, 2147483629, 2147483587, 2147483579][passes // 4 % 4 + 1] % nb) % nb) + ('0x' || substr(md5('mix|' || passes || '|' || s), 1, 8))::BIGINT % nb) % nb AS block FROM ko),
b AS (SELECT s, block, sum(tokens) AS b, max(rest) AS rest FROM kb WHERE rest > 0 GROUP BY ALL),
ba AS (SELECT *, sum(b) OVER (PARTITION BY s ORDER BY block) AS after FROM b),
cut AS (SELECT s, min(block) AS cut, min(after - b) AS whole FROM ba WHERE after > rest GROUP BY s),
ins AS (
  SELECT kb.s, key, whole, kb.rest, sum(tokens) OVER (PARTITION BY kb.s ORDER BY key RANGE UNBOUNDED PRECEDING) AS after
  FROM kb JOIN cut ON kb.s = cut.s AND kb.block = cut.cut),
ends AS (SELECT s, max(key) AS until FROM ins WHERE whole + after <= rest GROUP BY s),
o AS (
  SELECT kb.doc_id, kb.source, kb.s, kb.nb, kb.own, unnest(range(0, passes + CASE WHEN block < cut OR (block = cut AND key <= until) THEN 1 ELSE 0 END)) AS pass,
         ceil(passes + CASE WHEN t > 0 THEN rest::DOUBLE / t ELSE 0 END) AS top
  FROM kb LEFT JOIN cut USING (s) LEFT JOIN ends USING (s)),
ob AS (SELECT *, (own * (([2147483647, 2147483629, 2147483587, 2147483579][pass % 4 + 1] % nb) * ([2147483647, 2147483629, 2147483587, 2147483579][pass // 4 % 4 + 1] % nb) % nb) + ('0x' || substr(md5('mix|' || pass || '|' || s), 1, 8))::BIGINT % nb) % nb AS block FROM o)
SELECT doc_id, source, pass AS mix_pass, block AS mix_block, round((pass + (block + 0.5) / nb) / top, 6) AS position FROM ob
"""
