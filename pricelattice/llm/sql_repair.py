"""The conversation repair in DuckDB SQL: a fold over each conversation's rows keeps, for each of the four states, the least ``cost || audit``."""

from __future__ import annotations


def _add(state: str, cost: str, edit: str) -> str:
    return f"(lpad((left({state}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{edit}')"


def _crc32(key: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    byte = "list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"xor(list_reduce(list_transform(string_split({key}, ''), lambda c: ascii(c)::BIGINT), lambda crc, byte: {byte}, 4294967295::BIGINT), 4294967295)"


def repair() -> str:
    """Rows are ordered by turn (null first), role and SHA-256; a state is nine digits of cost and the audit so far, so that the
    least string is the least cost and then the least audit."""
    opened = f"""list_transform([acc], lambda b: [b[1], b[2],
        least(b[3], {_add('b[1]', '5', 'I')}, {_add('b[2]', '5', 'I')}, {_add('b[4]', '5', 'I')}), least(b[4], {_add('b[3]', '5', 'I')})])[1]"""
    more = "5 * (x[2] = '1')::INT"

    def stay(state: str, edit: str, cost: str) -> str:
        return f"CASE WHEN x[2] < '2' THEN {_add(state, f'{cost} + {more}', edit)} END"

    def keep(state: str, initial: str) -> str:
        return f"CASE WHEN x[1] = '{initial}' THEN {stay(state, 'K', '0')} END"

    before_u = ("b[1]", "b[2]", "b[4]")
    step = f"""list_transform([{opened}], lambda b: [{_add('b[1]', '2', 'D')},
        least({_add('b[2]', '2', 'D')}, {keep('b[1]', 's')}),
        least({_add('b[3]', '2', 'D')}, {', '.join(keep(b, 'u') for b in before_u)}, {', '.join(stay(b, 'R', '1') for b in before_u)}),
        least({_add('b[4]', '2', 'D')}, {keep('b[3]', 'a')}, {stay('b[3]', 'R', '1')})])[1]"""
    last = opened.replace("[acc]", "[folded]")
    white = r"[\x20\x09-\x0D]"
    return f"""
    WITH given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS draw FROM conversations),
        damaged AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
            unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS again FROM given WHERE draw <> 0),
        keyed AS (SELECT conv_id, turn, role, text, sha256(length(role)::VARCHAR || ':' || role || text) AS digest FROM damaged),
        placed AS (SELECT *, row_number() OVER w AS place, lag(role[1]) OVER w AS prior
            FROM keyed WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest)),
        coded AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN '2' WHEN row_number() OVER (PARTITION BY conv_id, role, digest ORDER BY place) > 1 THEN '3'
            WHEN NOT regexp_matches(text, '[.!?]{white}*$') THEN '1' ELSE '0' END AS fault FROM placed),
        folded AS (SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
            count(*) FILTER (fault = '2') AS blank, count(*) FILTER (fault = '3') AS duplicate, count(*) FILTER (fault = '1') AS truncated,
            count(*) FILTER (place > 1 AND prior || role[1] NOT IN ('su', 'ua', 'au')) AS illegal,
            list_reduce(list([role[1], fault] ORDER BY place), lambda acc, x: {step}, ['000000000', NULL, NULL, NULL]) AS folded FROM coded GROUP BY conv_id),
        found AS (SELECT *, list_transform([{last}], lambda b: least(b[1], b[4]))[1] AS least FROM folded),
        edits AS (SELECT conv_id, unnest(range(1, length(least) - 8)) AS k, substr(least, 10) AS audit FROM found),
        marked AS (SELECT conv_id, k, audit[k] AS edit, count(*) FILTER (audit[k] <> 'I') OVER w AS place,
            count(*) FILTER (audit[k] <> 'D') OVER w AS outs FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
        turned AS (SELECT m.conv_id, m.k, m.outs, m.edit, CASE WHEN m.edit = 'K' THEN c.role END AS role, CASE WHEN m.edit = 'I' THEN '' ELSE c.text END AS text
            FROM marked m LEFT JOIN coded c ON m.conv_id IS NOT DISTINCT FROM c.conv_id AND m.place = c.place AND m.edit <> 'I' WHERE m.edit <> 'D'),
        system AS (SELECT *, max((outs = 1 AND coalesce(role[1], '') = 's')::INT) OVER (PARTITION BY conv_id) AS s FROM turned),
        fixed AS (SELECT conv_id, sha256(string_agg(coalesce(role, CASE WHEN (outs - s) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY outs)) AS sha
            FROM system GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
        coalesce(illegal, 0) AS illegal, coalesce(left(least, 9)::BIGINT, 0) AS cost, coalesce(substr(least, 10), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN found f ON o.conv_id IS NOT DISTINCT FROM f.conv_id
        LEFT JOIN fixed x ON o.conv_id IS NOT DISTINCT FROM x.conv_id"""
