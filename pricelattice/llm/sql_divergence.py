"""The source divergence audit in DuckDB SQL, by its definition: every kept term for every group, all pairs of sources."""

from __future__ import annotations

DIVERGENCE = r"""
    WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        terms AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
        kept AS (SELECT lang, term, count(*) AS total FROM terms GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
        counted AS (SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        langs AS (SELECT lang, count(*) AS v, sum(total) AS of_lang FROM kept GROUP BY lang),
        sources AS (SELECT DISTINCT lang, source FROM docs),
        cells AS (SELECT s.lang, s.source, k.term, k.total, coalesce(c.n, 0) AS n FROM sources s JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)),
        shares AS (SELECT lang, source, term, n,
            1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p,
            1 + (1000000000::HUGEINT * (total + 5)) // (of_lang + 5 * v) AS q FROM cells JOIN langs USING (lang)),
        apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
        above AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM above))
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""
