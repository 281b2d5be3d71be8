"""SQL that the queries of this folder are checked against."""

from __future__ import annotations


def mixture(folder_weights=(5, 2, 1), repeats: int = 3, fills: int = 2, seed: str = "mix") -> str:
    listed = ", ".join(map(str, folder_weights))
    steps = []
    for k in range(fills + 1):
        before = "drawn" if k == 0 else f"left{k - 1}"
        room = "room" if k == 0 else f"room{k - 1}"
        steps.append(f"""
        sum{k} AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto FROM {before}),
        in{k} AS (SELECT row, size FROM sum{k} WHERE upto <= {room}),
        spent{k} AS (SELECT source, max(upto) AS spent, max(place) AS place FROM sum{k} WHERE upto <= {room} GROUP BY source),
        left{k} AS (SELECT d.* EXCLUDE (room{k}), d.room{k} FROM (SELECT d.*, d.{room} - coalesce(s.spent, 0) AS room{k}, s.place AS last
            FROM {before} d LEFT JOIN spent{k} s ON d.source IS NOT DISTINCT FROM s.source) d
            WHERE (last IS NULL OR d.place > last) AND d.size <= d.room{k})""".replace("d.* EXCLUDE (room{k}), d.room{k}".format(k=k), "* EXCLUDE (last)"))
    union = " UNION ALL ".join(f"SELECT row FROM in{k}" for k in range(fills + 1))
    return f"""
    WITH sizes AS (SELECT row_number() OVER () AS row, doc_id, source,
            len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
        weighed AS (SELECT *, floor(1e6 / sqrt((size + 1)::DOUBLE))::BIGINT AS w FROM sizes),
        sums AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * w) AS weighed FROM weighed GROUP BY source),
        turn AS (SELECT *, [{listed}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(folder_weights)} + 1)::INT]::BIGINT AS weight,
            source_size * {repeats} AS most FROM sums),
        level AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level,
            row_number() OVER (ORDER BY most::DOUBLE / weight::DOUBLE, source NULLS LAST) AS reach FROM turn
            WINDOW before AS (ORDER BY most::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        goal AS (SELECT *, least(most::DOUBLE, min_by(level, reach) FILTER (level * weight <= most) OVER () * weight) AS target FROM level),
        plan AS (SELECT source, source_size, weighed, target,
            CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE) ELSE 0 END::BIGINT AS certain FROM goal),
        ranked AS (SELECT r.row, r.doc_id, r.source, r.size, r.w, p.source_size, p.target, p.certain, p.weighed,
            p.target - (p.certain * p.source_size)::DOUBLE AS room,
            (('0x' || substr(md5('{seed}' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
            FROM weighed r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source),
        chance AS (SELECT *, least(greatest(room / source_size::DOUBLE * w::DOUBLE * source_size::DOUBLE / weighed::DOUBLE, 1e-6), 1 - 1e-6::DOUBLE) AS p FROM ranked),
        odds AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS rank FROM chance),
        places AS (SELECT *, floor(rank / (1 + rank) * 281474976710655.0::DOUBLE)::BIGINT AS place FROM odds),
        drawn AS (SELECT row, source, size, place, room FROM places WHERE size > 0), {",".join(steps)},
        extra AS ({union})
    SELECT doc_id, size, source_size, target, (certain + (e.row IS NOT NULL)::BIGINT) * size AS taken
    FROM ranked r LEFT JOIN extra e USING (row)"""


MIXTURE = mixture()


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secrets() -> str:
    """Every rule by the same split: lengths between matches and of matches, summed up to each match."""
    from .secrets import BASE, RULES
    found = []
    for rank, (kind, pattern, group, least) in enumerate(RULES):
        rx = _literal(pattern)
        found.append(f"""
        SELECT row, {rank} AS rank, '{kind}' AS kind, s AS start, s + length(m) AS "end" FROM (
            SELECT row, unnest(ms) AS m, unnest(ps) AS p, unnest(list_transform(range(1, len(ms) + 1), lambda k:
                list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))) AS s
            FROM (SELECT row, regexp_extract_all(t, {rx}) AS ms, regexp_extract_all(t, {rx}, {group}) AS ps, string_split_regex(t, {rx}) AS gaps
                FROM docs WHERE regexp_matches(t, {rx}))) WHERE length(p) >= {least}""")
    base = ", ".join(f"'{k}'" for k in BASE)
    piece = "kind || ':' || start || ':' || \"end\""
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
        found AS ({" UNION ALL ".join(found)})
    SELECT doc_id, {counts},
        sha256(coalesce(string_agg({piece}, ',' ORDER BY start, rank) FILTER (kind IN ({base})), '')) AS base_sha256,
        coalesce(string_agg({piece}, ',' ORDER BY start, rank), '') AS spans
    FROM docs LEFT JOIN found USING (row) GROUP BY docs.row, doc_id"""


def chat() -> str:
    import re

    from .chat import CONTROLS, END, START
    controls = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS)
    return f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum({len(START) + len(END) + 2} + length(role) + length(text) + len(regexp_extract_all(text, {_literal(controls)})))::BIGINT AS formatted_chars
    FROM turns GROUP BY conv_id"""
