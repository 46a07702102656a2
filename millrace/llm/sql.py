"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
windows AS (SELECT r, i, list_slice(ws, i, i + 7) AS k FROM w, unnest(range(1, len(ws) - 6)) AS u(i)),
twice AS (SELECT r, k FROM windows GROUP BY r, k HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n
            FROM windows JOIN twice USING (r, k), unnest(range(0, 8)) AS o(j) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(list_aggregate(ws || [''], 'string_agg', ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_shouts
      FROM w LEFT JOIN covered USING (r)),
b AS (SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (100 * n_symbols > 25 * n_words)::BIGINT
             + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (word_chars > 16 * n_words)::BIGINT
             + 32 * (100 * n_shouts > 40 * n_words)::BIGINT) AS fail_bits FROM m)
SELECT *, 'web.2' AS policy, fail_bits = 0 AS kept, (fail_bits & 3) <> 0 AS base_failed FROM b
"""

OP9 = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, substr(md5(text), 1, 16), text) AS r, doc_id, text
           FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
s AS (SELECT r, regexp_extract(text, '^[\x20\x09-\x0D]*') AS head, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS ps FROM d),
p AS (SELECT r, i, head, ps[i] AS piece, len(ps) AS n, regexp_extract(ps[i], '^[^\x20\x09-\x0D]+') AS word FROM s, unnest(range(1, len(ps) + 1)) AS u(i)),
w AS (SELECT *, lower(word) AS low,
             length(head) + coalesce(sum(length(piece)) OVER earlier, 0) AS start_at,
             length(head) - length(replace(head, chr(10), '')) + coalesce(sum(length(piece) - length(replace(piece, chr(10), ''))) OVER earlier, 0) AS line
      FROM p WINDOW earlier AS (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lines AS (SELECT r, line, md5(string_agg(low, ' ' ORDER BY i)) AS k FROM w GROUP BY r, line HAVING count(*) >= 15),
later_lines AS (SELECT r, line FROM (SELECT r, line, row_number() OVER (PARTITION BY k ORDER BY r, line) AS nth FROM lines) WHERE nth > 1),
lists AS (SELECT r, list(low ORDER BY i) AS ws FROM w GROUP BY r HAVING count(*) >= 50),
passages AS (SELECT r, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS k FROM lists, unnest(range(1, len(ws) - 48)) AS u(i)),
firsts AS (SELECT k, min(struct_pack(r := r, i := i)) AS f FROM passages GROUP BY k HAVING count(*) > 1),
later AS (SELECT r, i FROM passages JOIN firsts USING (k) WHERE r <> f.r OR i >= f.i + 50),
gone AS (SELECT r, i + j AS i FROM later, unnest(range(0, 50)) AS u(j) UNION SELECT r, i FROM w JOIN later_lines USING (r, line)),
flagged AS (SELECT w.*, g.i IS NOT NULL AS cut, lag(piece) OVER (PARTITION BY w.r ORDER BY w.i) AS before, max(g.i IS NOT NULL) OVER (PARTITION BY w.r) AS any_cut
            FROM w LEFT JOIN gone g ON w.r = g.r AND w.i = g.i),
f AS (SELECT * FROM flagged WHERE any_cut),
ends AS (SELECT r, any_value(head) AS head, arg_max(piece, i) AS last_piece FROM f GROUP BY r),
runs AS (SELECT r, min(start_at) AS a, max(start_at + length(word)) AS b FROM (SELECT *, i - row_number() OVER (PARTITION BY r ORDER BY i) AS run FROM f WHERE cut) GROUP BY r, run),
spans AS (SELECT r, count(*) AS n, string_agg(concat(a::BIGINT, ':', b::BIGINT), ',' ORDER BY a) AS spans FROM runs GROUP BY r),
kept AS (SELECT f.r, i, n, piece, lead(i) OVER (PARTITION BY f.r ORDER BY i) AS next_i, lead(before) OVER (PARTITION BY f.r ORDER BY i) AS next_before, last_piece
         FROM f JOIN ends e ON f.r = e.r WHERE NOT cut),
joined AS (SELECT r, string_agg(piece || CASE WHEN coalesce(next_i, n + 1) > i + 1 AND contains(coalesce(next_before, last_piece), chr(10)) AND NOT contains(piece, chr(10))
                                              THEN chr(10) ELSE '' END, '' ORDER BY i) AS left_text FROM kept GROUP BY r)
SELECT o.doc_id, CASE WHEN x.n IS NULL THEN o.text ELSE e.head || coalesce(j.left_text, '') END AS text,
       coalesce(x.n, 0)::BIGINT AS n_removed, coalesce(x.spans, '') AS removed_spans
FROM documents o LEFT JOIN d ON o.doc_id IS NOT DISTINCT FROM d.doc_id AND o.text = d.text
LEFT JOIN spans x ON x.r = d.r LEFT JOIN ends e ON e.r = d.r LEFT JOIN joined j ON j.r = d.r
"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spelled(text: str, spellings) -> str:
    for found, kept in spellings:
        text = f"replace({text}, {_literal(found)}, {_literal(kept)})"
    return text


def op8(known, spellings, copyright_line: str) -> str:
    """SQL of the licence scan for a catalogue; the expression of copyright lines is written as RE2 reads it."""
    values = ", ".join(f"({_literal(i)}, {_literal(t)})" for i, t in known)
    return rf"""
WITH known(id, text) AS (VALUES {values}),
texts AS (SELECT 'k' AS kind, NULL::BIGINT AS doc_id, id, text, row_number() OVER () AS r FROM known
          UNION ALL SELECT 'd', doc_id, NULL, coalesce(text, ''), -row_number() OVER () FROM documents),
plain AS (SELECT kind, doc_id, id, r, regexp_replace(regexp_replace(lower(text), {_literal(copyright_line)}, '', 'g'), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS t FROM texts),
bare AS (SELECT kind, doc_id, id, r, list_transform(string_split(t, chr(10)), lambda l: trim(l)) AS every FROM plain),
lines AS (SELECT kind, doc_id, id, r, string_split({_spelled("array_to_string(list_filter(every, lambda l: l <> ''), chr(10))", spellings)}, chr(10)) AS ls,
          list_transform(list_filter(string_split_regex(regexp_replace(array_to_string(every, chr(10)), '^\n+|\n+$', '', 'g'), '\n{{2,}}'), lambda b: contains(b, chr(10))), lambda b: {_spelled("replace(b, chr(10), ' ')", spellings)}) AS bs FROM bare),
forms AS (SELECT kind, doc_id, id, r, ls || bs AS ls, sha256({_spelled("array_to_string(ls, ' ')", spellings)}) AS digest FROM lines),
catalogue AS (SELECT digest, min(id) AS id FROM forms WHERE kind = 'k' GROUP BY digest),
hits AS (SELECT f.r, c.id FROM (SELECT r, unnest(ls) AS l FROM forms WHERE kind = 'd') f JOIN catalogue c ON sha256(f.l) = c.digest),
counted AS (SELECT r, count(*) AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS notices FROM hits GROUP BY r)
SELECT f.doc_id, f.digest AS canonical_sha256, c.id AS license_id, coalesce(n, 0)::BIGINT AS n_notices, coalesce(notices, '') AS notices
FROM forms f LEFT JOIN catalogue c USING (digest) LEFT JOIN counted ON f.r = counted.r WHERE kind = 'd'
"""


def op11(k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256, dimensions: int = 64) -> str:
    """SQL of the clustering: every round as two tables, the nearest centroids and the means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (SELECT r, c, sum((p.x - m.x) * (p.x - m.x))::BIGINT AS d FROM points p JOIN m{r} m USING (i) GROUP BY r, c),
a{r} AS MATERIALIZED (SELECT r, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM d{r} GROUP BY r)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN points USING (r) GROUP BY c, i),
m{r + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM m{r} LEFT JOIN s{r} USING (c, i))""")
    return f"""
WITH good AS (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings
              WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
points AS MATERIALIZED (SELECT r, i, floor({scale} * e[i]::DOUBLE)::BIGINT AS x FROM good, unnest(range(1, {dimensions + 1})) AS u(i)),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, e) - 1 AS c FROM good QUALIFY c < {k}),
m0 AS MATERIALIZED (SELECT c, i, x FROM first JOIN points USING (r)),{",".join(steps)},
totals AS (SELECT c, sum(d)::BIGINT AS own FROM a{rounds} GROUP BY c),
digests AS (SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY i)) AS digest FROM m{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, own AS cluster_inertia, (SELECT sum(own) FROM totals)::BIGINT AS inertia, digest AS centroid_sha256
FROM a{rounds} JOIN good USING (r) JOIN totals USING (c) JOIN digests USING (c)
"""


def _crc_steps(value: int) -> int:
    """An entry of the usual table of CRC-32: what one byte does to the checksum."""
    for _ in range(8):
        value = value >> 1 ^ 0xEDB88320 * (value & 1)
    return value


def op12(profile: int = 400) -> str:
    """SQL of the language identification; the checksum that deals documents out is computed from its table."""
    table = "[" + ", ".join(str(_crc_steps(i)) for i in range(256)) + "]::BIGINT[]"
    # DuckDB gives list_reduce no start value, so the list begins with it.
    crc = f"xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda s, b: xor(({table})[xor(s, b) % 256 + 1], s >> 8)))"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, text, {crc} % 5 = 0 AS held_out FROM documents),
w AS (SELECT r, ' ' || unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}]+')) || ' ' AS w FROM d),
words AS (SELECT r, w, count(*) AS n FROM w GROUP BY r, w),
g AS MATERIALIZED (SELECT r, g, sum(n)::BIGINT AS n
      FROM (SELECT r, n, substr(w, i, k) AS g FROM words, unnest([1, 2, 3]) AS a(k), unnest(range(1, 64)) AS u(i) WHERE i + k - 1 <= length(w)
            UNION ALL SELECT r, n, substr(w, i, k) FROM words, unnest([1, 2, 3]) AS a(k), unnest(range(64, length(w) + 1)) AS u(i) WHERE i + k - 1 <= length(w))
      WHERE g <> ' ' GROUP BY r, g),
p AS MATERIALIZED (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) AS p
      FROM (SELECT lang, g, sum(n) AS n FROM g JOIN d USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g) QUALIFY p <= {profile}),
o AS MATERIALIZED (SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY n DESC, g) AS o FROM g QUALIFY o <= {profile}),
near AS (SELECT r, lang, sum({profile} - abs(o - p)) AS s FROM o JOIN p USING (g) GROUP BY r, lang),
sized AS (SELECT r, count(*) AS m FROM o GROUP BY r),
far AS (SELECT r, lang, m, {profile} * m - coalesce(s, 0) AS x FROM sized CROSS JOIN (SELECT DISTINCT lang FROM p) LEFT JOIN near USING (r, lang)),
best AS (SELECT r, arg_min(lang, struct_pack(x := x, lang := lang)) AS lang, min(x) AS x, any_value(m) AS m FROM far GROUP BY r)
SELECT doc_id, held_out, CASE WHEN best.lang IS NULL OR NOT regexp_matches(text, '\p{{L}}') THEN 'und' ELSE best.lang END AS lang_pred,
       CASE WHEN best.lang IS NULL OR NOT regexp_matches(text, '\p{{L}}') THEN 0 ELSE 1 - x::DOUBLE / ({profile} * m) END::DOUBLE AS score
FROM d LEFT JOIN best USING (r)
"""


OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ 	-]+') AS ws FROM d),
f AS (SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM x a JOIN x b ON b.bit <> a.bit JOIN x c ON c.bit NOT IN (a.bit, b.bit) JOIN x d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN x e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(list_slice(bits, 1, k - 1)), 0)::INT AS earlier FROM o, unnest(range(1, 6)) AS u(k)),
r AS (SELECT part, filter_order, step, bit,
             coalesce(sum(n) FILTER (WHERE mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & earlier <> 0), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
      FROM c CROSS JOIN s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
