"""DuckDB SQL for the queries of this subpackage that SQL can express; columns are named as in the queries."""

from __future__ import annotations

from barline.llm.decontamination import MASKS, SPAN
from barline.llm.licenses import COMMENT, CUES, LEAST, TEMPLATES

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

OP2 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' ') || '/' || least(len(w), 5)) END) AS x FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n
"""

OP4 = """
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(text, '\\', '\\\\'), '</turn>', '\\</turn>'), '###', '\\###')) + length(role) + 15 AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS last FROM t
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM e
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR last THEN upto END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

_MASKED = ", ".join("'" + str(m) + "/' || " + " || ' ' || ".join(f"t[i + {i}]" for i, c in enumerate(mask) if c == "1") for m, mask in enumerate(MASKS))

OP6 = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM documents
), b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM benchmark
), dw AS (SELECT doc_id, t, unnest(range(1, len(t) - {SPAN - 2})) AS i FROM d
), bw AS (SELECT item_id, t, unnest(range(1, len(t) - {SPAN - 2})) AS i FROM b
), few AS (SELECT item_id, t, len(t) AS n FROM b WHERE len(t) BETWEEN 1 AND {SPAN - 1}
), dn AS (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM few)
), ds AS (SELECT doc_id, i, unnest([{_MASKED}]) AS seed FROM dw UNION ALL SELECT doc_id, i, n || ':' || array_to_string(t[i:i + n - 1], ' ') FROM dn
), bs AS (SELECT item_id, i, unnest([{_MASKED}]) AS seed FROM bw UNION ALL SELECT item_id, 1, n || ':' || array_to_string(t, ' ') FROM few
), hits AS (SELECT doc_id, item_id, ds.i - bs.i AS shift, list(DISTINCT bs.i) AS spots FROM ds JOIN bs USING (seed) GROUP BY ALL
), v AS (
  SELECT doc_id, item_id, spots, len(b.t) AS n, list_transform(range(1, len(b.t) + 1), lambda k: k + shift >= 1 AND d.t[k + shift] IS NOT DISTINCT FROM b.t[k]) AS same
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)
), m AS (
  SELECT doc_id, item_id, max(n) AS n, max(len(list_filter(same, lambda x: x))) AS matched,
         max(list_max(list_transform(string_split_regex(array_to_string(list_transform(same, lambda x: CASE WHEN x THEN '1' ELSE '0' END), ''), '0+'), lambda x: length(x)))) AS longest
  FROM v GROUP BY ALL
), near AS (
  SELECT doc_id, item_id, count(DISTINCT k) AS around
  FROM (SELECT doc_id, item_id, unnest(list_filter(range(1, n + 1), lambda k: same[k] AND len(list_filter(spots, lambda a: k >= a AND k < a + {SPAN})) > 0)) AS k FROM v) GROUP BY ALL
)
SELECT doc_id, count(*) AS n_items, max(matched) AS most_matched, max(longest) AS longest_run, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items
FROM m JOIN near USING (doc_id, item_id)
WHERE (greatest(matched, around) >= 0.5 * n AND greatest(matched, around) >= 10) OR (longest = n AND n >= 5) OR longest >= 13 GROUP BY doc_id
"""

OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents
), p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d
), h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS c FROM p
), covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM h WHERE c > 1
), words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d
), kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def _hashes(words: str) -> str:
    return f"CASE WHEN len({words}) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_sort(list_distinct(list_transform(range(1, greatest(len({words}) - 3, 2)), lambda i: left(md5(array_to_string({words}[i:i + 4], ' ')), 8)))) END"


def _sketch(hashes: str) -> str:
    return f"CASE WHEN len({hashes}) BETWEEN 1 AND 128 THEN list_prepend('*', {hashes}) ELSE list_filter({hashes}, lambda h: h < '6') END"


def _near(x: str, y: str) -> str:
    """x, y: lists of all distinct hashes; compared whole if neither has more than 128."""
    low = [f"CASE WHEN greatest(len({x}), len({y})) <= 128 THEN {z} ELSE list_filter({z}, lambda h: h < '6') END" for z in (x, y)]
    return f"round(CASE WHEN len({x}) = 0 AND len({y}) = 0 THEN 1.0 WHEN least(len({low[0]}), len({low[1]})) > 0 THEN len(list_intersect({low[0]}, {low[1]})) / least(len({low[0]}), len({low[1]})) ELSE 0.0 END, 6)"


OP9 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, coalesce(lead(doc_id) OVER (ORDER BY doc_id), min(doc_id) OVER ()) AS next_id FROM documents
), e AS (
  SELECT a.doc_id, a.next_id, a.n, a.t, left(a.t, a.n - a.n // 4) || left(b.t, a.n // 4) AS edited FROM d a JOIN d b ON b.doc_id = a.next_id
), w AS (
  SELECT *, {_WORDS.replace("text", "t")} AS tw, {_WORDS.replace("text", "edited")} AS ew FROM e
), h AS (SELECT *, {_hashes("tw")} AS th, {_hashes("ew")} AS eh FROM w
), s AS (SELECT *, {_sketch("th")} AS ts, {_sketch("eh")} AS es FROM h)
SELECT a.doc_id, a.n AS n_chars, sha256(a.edited) AS edited_sha256, coalesce(array_to_string(a.ts, ','), '') AS fingerprint, coalesce(array_to_string(a.es, ','), '') AS edited_fingerprint,
       {_near("a.th", "a.eh")} AS near_edited, {_near("a.th", "b.th")} AS near_next
FROM s a JOIN s b ON b.doc_id = a.next_id
"""

_TEMPLATES = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))
_COMMENT = COMMENT.replace("'", "''")


def _cued(text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{c}')" for c in CUES) + ")"


def _worded(text: str) -> str:
    return f"array_to_string(list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda t: t <> ''), ' ')"


OP10 = f"""
WITH f AS (
  SELECT doc_id, coalesce(text, '') AS text, '/' || coalesce(source, 'unknown') || '/' || doc_id // 1000 || '/' || doc_id // 100 AS dir,
         '/' || coalesce(source, 'unknown') || '/' || doc_id // 1000 || '/' || doc_id // 100 || '/' || doc_id AS path, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), cued AS (SELECT *, coalesce(nullif(list_position(list_transform(lines, lambda x: regexp_matches(x, '{_COMMENT}')), false), 0), len(lines) + 1) AS code FROM f WHERE {_cued("lower(text)")}
), units AS (
  SELECT DISTINCT path, unit FROM (
    SELECT path, {_worded("line")} AS unit FROM (SELECT path, unnest(lines) AS line FROM cued)
    UNION ALL SELECT path, {_worded("array_to_string(lines[1:code - 1], ' ')")} FROM cued
    UNION ALL SELECT path, {_worded("part")} FROM (SELECT path, unnest(string_split_regex(text, '\\n[^A-Za-z0-9\\n]*\\n')) AS part FROM cued)
  ) WHERE {_cued("unit")}
), worded AS (SELECT DISTINCT unit FROM units
), terms AS (SELECT unit, token, count(*) AS tf FROM (SELECT unit, unnest(string_split(unit, ' ')) AS token FROM worded) GROUP BY ALL
), templates(template, license, line) AS (VALUES {_TEMPLATES}
), tt AS (
  SELECT template, license, token, count(*) AS tf FROM (SELECT template, license, unnest(string_split({_worded("line")}, ' ')) AS token FROM templates) GROUP BY ALL
), idf AS (
  SELECT token, ln((1 + (SELECT count(*) + {len(TEMPLATES)} FROM worded)) / (1 + count(*))) + 1 AS idf FROM (SELECT unit, token FROM terms UNION ALL SELECT CAST(template AS VARCHAR), token FROM tt) GROUP BY token
), w AS (SELECT unit, token, tf * idf AS w FROM terms JOIN idf USING (token)
), u AS (SELECT template, license, token, tf * idf AS u FROM tt JOIN idf USING (token)
), wn AS (SELECT unit, sqrt(sum(w * w)) AS n FROM w GROUP BY unit
), un AS (SELECT template, sqrt(sum(u * u)) AS n FROM u GROUP BY template
), score AS (
  SELECT unit, license, max(score) AS score FROM (
    SELECT w.unit, u.license, round(sum(w * u) / (any_value(wn.n) * any_value(un.n)), 6) AS score
    FROM w JOIN u USING (token) JOIN wn ON wn.unit = w.unit JOIN un USING (template) GROUP BY w.unit, u.template, u.license
  ) WHERE score >= {LEAST} GROUP BY unit, license
), own AS (
  SELECT path, license, score FROM (SELECT path, license, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, license) AS k FROM units JOIN score USING (unit)) WHERE k = 1
), files AS (
  SELECT path, dir FROM cued
  WHERE len(string_split_regex(array_to_string(list_filter(lines, lambda x: {_cued(_worded("x"))}), ' '), '\\s+')) >= 0.1 * len(string_split_regex(text, '\\s+'))
), sources AS (SELECT dir, arg_min(license, path) AS license FROM files JOIN own USING (path) GROUP BY dir
), up AS (
  SELECT dir, k, array_to_string(string_split(dir, '/')[1:k], '/') AS from_dir FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS k FROM (SELECT DISTINCT dir FROM f))
), near AS (SELECT up.dir, arg_max(from_dir, k) AS from_dir, arg_max(license, k) AS license FROM up JOIN sources s ON s.dir = up.from_dir GROUP BY up.dir)
SELECT f.doc_id, f.path, coalesce(own.license, near.license) AS license, own.score, CASE WHEN own.license IS NOT NULL THEN 'stated' WHEN near.dir IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN own.license IS NULL THEN near.from_dir END AS from_dir
FROM f LEFT JOIN own USING (path) LEFT JOIN near ON near.dir = f.dir
"""

OP12 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w, sha256('42:' || doc_id) AS h FROM documents
), x AS (
  SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(w) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(w) + 1) AS b, CAST('0x' || h[17:24] AS BIGINT) % 100 AS c, CAST('0x' || h[25:32] AS BIGINT) % 100 AS e FROM d
), y AS (
  SELECT *, array_to_string(w[1:least(a, b)], '') AS prefix, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(w[greatest(a, b) + 1:], '') AS suffix,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 50 THEN 'plain' WHEN e < 80 THEN 'spm' ELSE 'psm' END AS form FROM x
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM y
"""

OP13 = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p
), g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(k))
), f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10
), totals AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang
), cuts AS (
  SELECT f.lang, f.k, f.phrase, f.a, c.j, array_to_string(string_split(f.phrase, ' ')[1:c.j], ' ') AS head, array_to_string(string_split(f.phrase, ' ')[c.j + 1:], ' ') AS tail
  FROM f, (VALUES (1), (2)) AS c(j) WHERE c.j < f.k
), scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.j, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head AND x.k = c.j JOIN f y ON y.lang = c.lang AND y.phrase = c.tail AND y.k = c.k - c.j
), least AS (SELECT *, row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, j) AS nth FROM scored
), held AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase FROM f WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
  FROM least s LEFT JOIN held h ON s.k = 2 AND h.lang = s.lang AND h.phrase = s.phrase WHERE s.nth = 1 AND (h.a IS NULL OR 100 * h.a < 50 * s.a)
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) WHERE rank <= 2000
"""

SQL = {
    "op2_bbit_minhash": OP2,
    "op4_prefix_targets": OP4,
    "op6_spaced_seeds": OP6,
    "op8_difference_cover": OP8,
    "op9_scaled_sketch": OP9,
    "op10_license_inheritance": OP10,
    "op12_skip_list_middle": OP12,
    "op13_tiled_collocations": OP13,
}
