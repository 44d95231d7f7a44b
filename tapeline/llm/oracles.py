"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations


def crc32(text: str) -> str:
    """DuckDB has no crc32: the table in `crc_table` folded over the bytes of a text of code points below 256."""
    octets = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] WHEN unicode(c) < 192 THEN [194, unicode(c)] ELSE [195, unicode(c) - 64] END))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}::BIGINT[]), lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1])), 4294967295)"


#: The byte table of the checksum: eight halvings, with the polynomial for each one that falls out.
CRC_TABLE = "crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SPELLING_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
counted AS (SELECT doc, run, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, c, {crc32("doc || ':' || run")} AS h FROM counted, crc_table),
damaged AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, c FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cuts AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
    SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
    UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, CASE WHEN m >= 2 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (SELECT word, word AS root FROM forms UNION SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM forms f JOIN ends e ON f.word = e.word
"""


_INITIAL = "substr(h.role, 1, 1)"
_NEXT, _ROLE = (2, 2, 3, 2), "uuau"


def _raw(state: int) -> str:
    """The least cost of one turn's own edits from a state, by the costs n behind the turn."""
    keep = f"least(4 + n.c{state}, CASE WHEN bad THEN 1e9::BIGINT ELSE cut + n.c{_NEXT[state]} + CASE WHEN {_INITIAL} = '{_ROLE[state]}' THEN 0 ELSE 3 END END)"
    return keep if state else f"least({keep}, CASE WHEN NOT bad AND {_INITIAL} = 's' THEN cut + n.c1 ELSE 1e9::BIGINT END)"


_CHOICES = {
    s: "CASE WHEN h.done THEN 'I' "
    + f"WHEN 4 + h.d{s} = h.c{s} THEN 'D' WHEN 3 + h.c{_NEXT[s]} = h.c{s} THEN 'I' "
    + f"WHEN h.initial = '{_ROLE[s]}' AND h.cut + h.d{_NEXT[s]} = h.c{s} THEN 'K' "
    + ("WHEN h.initial = 's' AND h.cut + h.d1 = h.c0 THEN 'K' " if s == 0 else "")
    + "ELSE 'R' END"
    for s in range(4)
}
_CHOICE = "CASE w.s " + " ".join(f"WHEN {s} THEN {text}" for s, text in _CHOICES.items()) + " END"

CONVERSATIONS_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS h FROM conversations, crc_table),
hit AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM base),
placed AS (SELECT *, md5(length(role) || ':' || role || text) AS digest FROM hit),
numbered AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, lag(substr(role, 1, 1)) OVER w AS before, count(*) OVER (PARTITION BY conv_id) AS many
    FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest, copy)),
turns AS MATERIALIZED (SELECT conv_id, turn, role, text, i, many, before, fault, fault IN (1, 2) AS bad, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS cut FROM (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2 WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM numbered)),
costs AS (
    SELECT conv_id, max(many) + 1 AS i, 0::BIGINT AS c0, 6::BIGINT AS c1, 3::BIGINT AS c2, 0::BIGINT AS c3 FROM turns GROUP BY conv_id
    UNION ALL
    SELECT conv_id, i, least(b0, 3 + least(b2, 3 + b3)), least(b1, 3 + least(b2, 3 + b3)), least(b2, 3 + b3), least(b3, 3 + b2) FROM (
        SELECT h.conv_id, h.i, {_raw(0)} AS b0, {_raw(1)} AS b1, {_raw(2)} AS b2, {_raw(3)} AS b3
        FROM costs n JOIN turns h ON n.conv_id IS NOT DISTINCT FROM h.conv_id AND h.i = n.i - 1)),
known AS MATERIALIZED (
    SELECT c.conv_id, c.i, c.c0, c.c1, c.c2, c.c3, d.c0 AS d0, d.c1 AS d1, d.c2 AS d2, d.c3 AS d3, t.role, t.text, substr(t.role, 1, 1) AS initial, t.cut, t.i IS NULL AS done
    FROM costs c LEFT JOIN turns t ON c.conv_id IS NOT DISTINCT FROM t.conv_id AND c.i = t.i LEFT JOIN costs d ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND d.i = c.i + 1),
walk AS (
    SELECT conv_id, 1::BIGINT AS i, 0 AS s, '' AS audit, []::VARCHAR[] AS kept FROM turns WHERE i = 1
    UNION ALL
    SELECT conv_id, i + CASE WHEN e = 'I' THEN 0 ELSE 1 END,
        CASE WHEN e = 'D' THEN s WHEN e = 'K' AND initial = 's' THEN 1 WHEN s = 2 THEN 3 ELSE 2 END, audit || e,
        CASE e WHEN 'D' THEN kept WHEN 'K' THEN list_append(kept, role || ':' || text) ELSE list_append(kept, CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'R' THEN text ELSE '' END) END
    FROM (SELECT w.conv_id, w.i, w.s, w.audit, w.kept, h.role, h.text, h.initial, {_CHOICE} AS e
        FROM walk w JOIN known h ON w.conv_id IS NOT DISTINCT FROM h.conv_id AND w.i = h.i WHERE NOT (h.done AND w.s IN (0, 3)))),
ended AS (SELECT w.conv_id, w.audit, w.kept FROM walk w JOIN known h ON w.conv_id IS NOT DISTINCT FROM h.conv_id AND w.i = h.i WHERE h.done AND w.s IN (0, 3)),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(t.gaps, 0) AS BIGINT) AS gaps, coalesce(t.blank, 0) AS blank, coalesce(t.duplicate, 0) AS duplicate, coalesce(t.truncated, 0) AS truncated, coalesce(t.illegal, 0) AS illegal,
    coalesce(k.c0, 0) AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN known k ON c.conv_id IS NOT DISTINCT FROM k.conv_id AND k.i = 1
"""
