"""DuckDB SQL that gives the same rows as the queries it names."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"

SQL = {
    "op7_exact_dedup": rf"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS text_sha256
                   FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM d""",
    "op10_line_dedup": rf"""
        WITH docs AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
             x AS (SELECT doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM docs),
             k AS (SELECT doc_id, source, line, pos, trim(regexp_replace(line, '{_SPACE}', ' ', 'g'), ' ') AS key FROM x),
             s AS (SELECT key, min(doc_id) AS first FROM k WHERE key <> ''
                   GROUP BY key HAVING count(DISTINCT source) >= 10),
             j AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND s.first <> k.doc_id AS gone
                   FROM k LEFT JOIN s ON k.key = s.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
               coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
        FROM j GROUP BY doc_id""",
    "op8_url_reputation": r"""
        WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
                   FROM pages),
             u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                             'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
             l AS (SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1
                                                      THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
             c AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare, count(bad) AS n,
                          coalesce(sum(bad), 0) AS bad
                   FROM u LEFT JOIN l ON l.doc_id = TRY_CAST(regexp_extract(path, '/([0-9]{1,18})(?:\.[A-Za-z]+)?/?\z', 1) AS BIGINT)
                   GROUP BY host),
             g AS (SELECT host, n, bad, bare, string_split(bare, '.') AS labels, regexp_matches(bare, '^[0-9.]+$|:') AS address,
                          regexp_matches(bare, '(^|\.)(ac|co|com|edu|go|gov|net|ne|or|org)\.[a-z][a-z]$') AS second FROM c),
             h AS (SELECT host, n, bad,
                          CASE WHEN address THEN bare ELSE array_to_string(labels[CASE WHEN second THEN -2 ELSE -1 END:], '.') END AS suffix,
                          CASE WHEN address THEN bare ELSE array_to_string(labels[CASE WHEN second THEN -3 ELSE -2 END:], '.') END AS domain
                   FROM g),
             base AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) AS m0 FROM h),
             t AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m0) AS prior FROM h, base GROUP BY suffix),
             tk AS (SELECT sum(n * (bad / n - prior) ** 2 / (prior * (1 - prior))) AS s, count(*) AS k,
                           sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS spare FROM t WHERE n > 0),
             ts AS (SELECT CASE WHEN k < 2 OR spare <= 0 OR s <= k - 1 THEN 1000.0
                                ELSE least(greatest(spare / (s - (k - 1)) - 1, 1.0), 1000.0) END AS st FROM tk),
             tm AS (SELECT suffix, (prior * st + bad) / (st + n) AS prior FROM t, ts),
             m AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(tm.prior) AS prior
                   FROM h JOIN tm USING (suffix) GROUP BY suffix, domain),
             mk AS (SELECT sum(n * (bad / n - prior) ** 2 / (prior * (1 - prior))) AS s, count(*) AS k,
                           sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS spare FROM m WHERE n > 0),
             ms AS (SELECT CASE WHEN k < 2 OR spare <= 0 OR s <= k - 1 THEN 1000.0
                                ELSE least(greatest(spare / (s - (k - 1)) - 1, 1.0), 1000.0) END AS st FROM mk),
             mm AS (SELECT domain, (prior * st + bad) / (st + n) AS prior FROM m, ms),
             f AS (SELECT host, h.n, h.bad, mm.prior FROM h JOIN mm USING (domain)),
             fk AS (SELECT sum(n * (bad / n - prior) ** 2 / (prior * (1 - prior))) AS s, count(*) AS k,
                           sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS spare FROM f WHERE n > 0),
             fs AS (SELECT CASE WHEN k < 2 OR spare <= 0 OR s <= k - 1 THEN 1000.0
                                ELSE least(greatest(spare / (s - (k - 1)) - 1, 1.0), 1000.0) END AS st FROM fk),
             fr AS (SELECT host, st + n AS whole, (prior * st + bad) / (st + n) AS rate FROM f, fs),
             ab AS (SELECT host, rate * whole AS a, greatest((1 - rate) * whole, 1.0) AS b FROM fr),
             xy AS (SELECT host, a, b, 1 / (2 * a - 1) AS x, 1 / (2 * b - 1) AS y, (1.645 * 1.645 - 3) / 6 AS k FROM ab),
             hh AS (SELECT *, 2 / (x + y) AS h FROM xy),
             lo AS (SELECT host, CASE WHEN a < 1 OR h + k <= 0 THEN 0.0
                                      ELSE a / (a + b * exp(2 * (1.645 * sqrt(greatest(h + k, 0)) / h
                                                                 - (y - x) * (k + 5.0 / 6 - 2 / (3 * h))))) END AS low FROM hh),
             r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
                                         ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'),
                                         ('block', 'com', '/de/')) v(what, rh, rp)),
             b AS (SELECT page_id, arg_max(rh || rp, len(rh || rp)) AS rule, arg_max(what, len(rh || rp)) AS what
                   FROM u JOIN r ON (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp)
                   GROUP BY page_id)
        SELECT u.page_id, u.host, u.path, b.rule,
               coalesce(b.what, CASE WHEN low >= m0 THEN 'block' ELSE 'allow' END) AS verdict,
               round(low, 6) AS bad_rate_low
        FROM u LEFT JOIN b USING (page_id) LEFT JOIN lo USING (host), base""",
}
