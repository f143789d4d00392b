"""DuckDB SQL of the operators on conversations, manifests and rules."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit."""
    step = "list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END))"
    letters = f"[CAST(ascii(substr({text}, CAST(nth AS INTEGER), 1)) AS BIGINT) FOR nth IN range(1, length({text}) + 1)]"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {letters}), lambda c, b: {step}), 4294967295)"


# Insertions before an edit, from each grammar state: edits, state, cost, lines.
_STATES = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def _insertions() -> str:
    rows = []
    for q in _STATES:
        at, ops, lines = q, "", ""
        for k in range(3):
            rows.append(f"({q}, '{ops}', {at}, {5 * k}, {lines or repr('')})")
            lines, ops, at = f"{lines} || chr(10) || '{_STATES[at][0]}:'".removeprefix(" || "), ops + "I", _STATES[at][1]
    return ", ".join(rows)


CONVERSATIONS = rf"""WITH RECURSIVE p AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    d AS (SELECT *, {crc32_sql("k")} % 20 AS fault FROM p),
    e AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM e),
    f AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS c, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
        NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
    ids AS (SELECT DISTINCT conv_id FROM conversations),
    ins(q, ops, q1, icost, ilines) AS (VALUES {_insertions()}),
    arcs(q1, op, c, q2, ecost, said) AS (VALUES (0, 'D', '', 0, 2, NULL), (1, 'D', '', 1, 2, NULL), (2, 'D', '', 2, 2, NULL), (3, 'D', '', 3, 2, NULL), (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL),
        (1, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL), (3, 'K', 'u', 2, 0, NULL), (0, 'R', '', 2, 1, 'user'), (1, 'R', '', 2, 1, 'user'), (2, 'R', '', 3, 1, 'assistant'), (3, 'R', '', 2, 1, 'user')),
    moves AS (SELECT q, ops || op AS ops, op, c, q2, icost + ecost AS cost, ilines, said FROM ins JOIN arcs USING (q1)),
    best(conv_id, i, q, m) AS (SELECT conv_id, CAST(0 AS BIGINT), 0, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''}} FROM ids
        UNION ALL SELECT b.conv_id, f.i, moves.q2, min({{'cost': b.m.cost + moves.cost + CASE WHEN op <> 'D' AND cut THEN 5 ELSE 0 END, 'audit': b.m.audit || ops,
            'lines': b.m.lines || ilines || CASE WHEN op = 'D' THEN '' ELSE chr(10) || coalesce(said, role) || ':' || text END}})
        FROM best b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1 JOIN moves ON moves.q = b.q AND (op = 'D' OR NOT (blank OR again) AND moves.c IN ('', f.c)) GROUP BY b.conv_id, f.i, moves.q2),
    n AS (SELECT conv_id, count(f.i) AS n, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps FROM f GROUP BY conv_id),
    done AS (SELECT b.conv_id, min({{'cost': b.m.cost + icost, 'audit': b.m.audit || ops, 'lines': b.m.lines || ilines}}) AS m
        FROM best b LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id JOIN ins ON ins.q = b.q AND q1 IN (0, 3) WHERE b.i = coalesce(n.n, 0) GROUP BY b.conv_id)
    SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        m.cost AS cost, m.audit AS audit, sha256(substr(m.lines, 2)) AS repaired_sha256 FROM ids JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM ids.conv_id"""


def _encoded(*values: str) -> str:
    return " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Runs hold the siblings of each place; a proof climbs run by run, first through the source's tree, then through that of the sources.
MANIFEST = f"""WITH RECURSIVE l AS (SELECT doc_id, source, sha256({_encoded("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
        CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN sha256({_encoded("doc_id", "source", "lang", "n_chars", _LOWER)}) END AS other FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
    t(source, lvl, i, h, n) AS (SELECT source, 0, i, leaf, count(*) OVER (PARTITION BY source) FROM r
        UNION ALL SELECT source, lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM t WHERE n > 1 GROUP BY source, lvl, i // 16, n),
    s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS si FROM t WHERE n = 1),
    u(lvl, i, h, n) AS (SELECT 0, si, subroot, count(*) OVER () FROM s
        UNION ALL SELECT lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM u WHERE n > 1 GROUP BY lvl, i // 16, n),
    tr AS (SELECT source, lvl, i // 16 AS run, list(h ORDER BY i) AS hs FROM t WHERE n > 1 GROUP BY source, lvl, i // 16),
    ur AS (SELECT lvl, i // 16 AS run, list(h ORDER BY i) AS hs FROM u WHERE n > 1 GROUP BY lvl, i // 16),
    a(doc_id, source, leaf, i, lvl, h, proof, top) AS (SELECT doc_id, source, leaf, i, 0, coalesce(other, leaf), '', false FROM r
        UNION ALL SELECT a.doc_id, a.source, a.leaf, CASE WHEN tr.hs IS NULL AND NOT top THEN si ELSE a.i // 16 END, CASE WHEN tr.hs IS NULL AND NOT top THEN 0 ELSE a.lvl + 1 END,
            CASE WHEN top THEN sha256(array_to_string(ur.hs[:a.i % 16], '') || h || array_to_string(ur.hs[a.i % 16 + 2:], '')) WHEN tr.hs IS NULL THEN h
                ELSE sha256(array_to_string(tr.hs[:a.i % 16], '') || h || array_to_string(tr.hs[a.i % 16 + 2:], '')) END,
            CASE WHEN top THEN proof || array_to_string(ur.hs[:a.i % 16], '') || array_to_string(ur.hs[a.i % 16 + 2:], '') WHEN tr.hs IS NULL THEN proof
                ELSE proof || array_to_string(tr.hs[:a.i % 16], '') || array_to_string(tr.hs[a.i % 16 + 2:], '') END,
            top OR tr.hs IS NULL
        FROM a JOIN s ON s.source IS NOT DISTINCT FROM a.source LEFT JOIN tr ON NOT top AND tr.source IS NOT DISTINCT FROM a.source AND tr.lvl = a.lvl AND tr.run = a.i // 16
            LEFT JOIN ur ON top AND ur.lvl = a.lvl AND ur.run = a.i // 16 WHERE NOT top OR ur.hs IS NOT NULL),
    last AS (SELECT max(lvl) AS lvl FROM u)
    SELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, a.h AS folded_root, a.h = u.h AS verified
    FROM a JOIN last ON top AND a.lvl = last.lvl JOIN u ON u.n = 1 AND u.lvl = last.lvl JOIN s ON s.source IS NOT DISTINCT FROM a.source"""

_WORDS = r"list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LETTER = r"A-Za-z\x{80}-\x{10FFFF}"

RULES = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
    w AS (SELECT *, {_WORDS} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    g AS (SELECT r, unnest(range(1, len(w) - 1)) AS k, unnest([w[k:k + 2] FOR k IN range(1, len(w) - 1)]) AS t FROM w WHERE len(w) > 2),
    c AS (SELECT r, k, count(*) OVER (PARTITION BY r, t) AS n FROM g),
    v AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([k, k + 1, k + 2]) AS k FROM c WHERE n > 1) GROUP BY r),
    m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^{_LETTER}]', '', 'g')) AS letters,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS uppers, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits,
        len(list_filter(w, lambda x: strlen(x) > 2 AND regexp_matches(x, '[^0-9{_LETTER}]{{2}}$'))) AS marked, len(list_filter(w, lambda x: regexp_matches(x, '^[0-9{_LETTER}]'))) AS plain
        FROM w LEFT JOIN v USING (r)),
    b AS (SELECT *, CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT) + 4 * CAST(n_words > 1000000 AS BIGINT) + 8 * CAST(word_chars < 2 * n_words AS BIGINT)
        + 16 * CAST(word_chars > 16 * n_words AS BIGINT) + 32 * CAST(100 * n_symbols > 10 * n_words AS BIGINT) + 64 * CAST(100 * n_dup_lines > 50 * n_lines AS BIGINT)
        + 128 * CAST(100 * uppers > 40 * letters AS BIGINT) + 256 * CAST(100 * marked > 10 * n_words AS BIGINT) + 512 * CAST(100 * plain < 60 * n_words AS BIGINT)
        + 1024 * CAST(100 * digits > 30 * word_chars AS BIGINT) AS failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed, failed & 3 <> 0 AS base_failed, failed & 423 = 0 AND bit_count(failed & 1624) <= 1 AS kept FROM b"""
