"""DuckDB SQL of the queries that SQL can express, over whole tables, written from the definitions."""

from __future__ import annotations

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"


def _leaf(counter: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(f"({c})") for c in ("doc_id", "source", "lang", counter, "text")) + ")"


#: crc32 of the decimal doc_id: every byte is taken in, then eight shifts (marked -1) follow.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::VARCHAR, '')])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""
_CLIMB = """SELECT {g} level + 1, i // 2, (size + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM {t} WHERE size > 1 GROUP BY {g} level, i // 2, size"""
_STEP = "CASE WHEN s.digest IS NULL THEN '' WHEN s.i < x.i >> l.level THEN 'L' || s.digest ELSE 'R' || s.digest END"
_FOLD = """list_reduce(list_concat([{0}], path), lambda a, e: sha256(CASE WHEN e[1] = 'L' THEN e[2:] || a WHEN e[1] = 'R' THEN a || e[2:] ELSE a END))"""

MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN {_CRC} % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf("n_chars::HUGEINT + 1")} END AS tampered FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS size,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM leaves),
tree(g, level, i, size, digest) AS (
  SELECT g, 0, i, size, leaf FROM placed UNION ALL {_CLIMB.format(g="g,", t="tree")}),
tops AS (SELECT g AS i, digest, count(*) OVER () AS size FROM tree WHERE size = 1),
above(level, i, size, digest) AS (SELECT 0, i, size, digest FROM tops UNION ALL {_CLIMB.format(g="", t="above")}),
inner_path AS (
  SELECT x.g, x.i, list({_STEP} ORDER BY l.level) AS path
  FROM placed x JOIN (SELECT DISTINCT g, level, size FROM tree WHERE size > 1) l ON l.g = x.g
  LEFT JOIN tree s ON s.g = x.g AND s.level = l.level AND s.i = xor(x.i >> l.level, 1) GROUP BY x.g, x.i),
outer_path AS (
  SELECT x.i AS g, list({_STEP} ORDER BY l.level) AS path
  FROM tops x JOIN (SELECT DISTINCT level, size FROM above WHERE size > 1) l ON true
  LEFT JOIN above s ON s.level = l.level AND s.i = xor(x.i >> l.level, 1) GROUP BY x.i),
proofs AS (
  SELECT p.doc_id, p.leaf, p.tampered, t.digest AS subroot, (SELECT digest FROM above WHERE size = 1) AS root,
    list_concat(coalesce(n.path, []::VARCHAR[]), coalesce(o.path, []::VARCHAR[])) AS path
  FROM placed p JOIN tops t ON t.i = p.g LEFT JOIN inner_path n ON n.g = p.g AND n.i = p.i LEFT JOIN outer_path o ON o.g = p.g),
done AS (SELECT *, {_FOLD.format("coalesce(tampered, leaf)")} AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([e[2:] FOR e IN path], '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM done
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (SELECT lang, unnest(list_zip(w, w[2:], w[3:])) AS g FROM words),
grams AS MATERIALIZED (SELECT lang, g[1] AS w1, g[2] AS w2, g[3] AS w3 FROM runs),
f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS f FROM grams GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS f FROM grams WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS f FROM grams WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2 WHERE c.f >= 10
    AND NOT EXISTS (FROM f3 g WHERE g.lang = c.lang AND g.w1 = c.w1 AND g.w2 = c.w2 AND 100 * g.f >= 50 * c.f)
    AND NOT EXISTS (FROM f3 g WHERE g.lang = c.lang AND g.w2 = c.w1 AND g.w3 = c.w2 AND 100 * g.f >= 50 * c.f)
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, x.f, y.f, 1
  FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, x.f, y.f, 2
  FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3),
scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

#: Rules and their bits are written out: bit i of ``failed`` is the i-th line.
RULE_LEDGER = r"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM texts),
words AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM cut),
windows AS (
  SELECT row, i, word AS a, lead(word, 1) OVER line AS b, lead(word, 2) OVER line AS c FROM words WINDOW line AS (PARTITION BY row ORDER BY i)),
twice AS (SELECT row, i FROM windows WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY row, a, b, c) >= 2),
covered AS (SELECT row, count(DISTINCT i + k)::BIGINT AS n FROM twice, (VALUES (0), (1), (2)) AS t(k) GROUP BY row),
bodies AS (SELECT *, array_to_string(w, '') AS body FROM cut),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(body)::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words,
    length(regexp_replace(body, '[^\p{L}]+', '', 'g')) AS n_letters, length(regexp_replace(body, '[^\p{Lu}]+', '', 'g')) AS n_upper,
    length(regexp_replace(body, '[^\p{Lu}\p{Ll}]+', '', 'g')) AS n_cased
  FROM bodies LEFT JOIN covered USING (row)),
judged AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_cased >= 20 AND 2 * n_upper > n_cased THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_letters < word_chars THEN 64 ELSE 0 END)::BIGINT AS failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM judged
"""

ARCHIVE = """
WITH bodies AS (SELECT page_id::BIGINT AS page_id, coalesce(html, '') AS body FROM pages),
sized AS (SELECT *, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM bodies),
placed AS (
  SELECT *, payload_bytes < 1000 OR row_number() OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST) = 1 AS holds,
    max(page_id) OVER (PARTITION BY body) AS holder FROM sized)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN holds THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT holds THEN holder END AS refers_to
FROM placed
"""

ORACLES: dict[str, str] = {
    "op4_rule_ledger": RULE_LEDGER,
    "op6_content_archive": ARCHIVE,
    "op11_bitmap_rank_manifest": MERKLE,
    "op12_branch_bound_collocations": COLLOCATIONS,
}
