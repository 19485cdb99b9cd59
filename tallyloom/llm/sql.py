"""SQL twins of decontamination, the manifest and spelling variants, each by another way than the operator's."""

from __future__ import annotations


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of an ASCII or Latin-1 text: every byte enters, then eight shifts follow."""
    byte = "CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT,0,0,0,0,0,0,0] ELSE [195,0,0,0,0,0,0,0,ord(ch)::BIGINT-64,0,0,0,0,0,0,0] END"
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: {byte}))"
    shift = "xor(xor(crc, b) >> 1, 3988292384::BIGINT * (xor(crc, b) & 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda crc, b: {shift}), 4294967295::BIGINT)"


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), w AS (
  SELECT DISTINCT item, width, array_to_string(words[spot + 1:spot + width], ' ') AS gram
  FROM (SELECT item, words, least(10, len(words)) AS width, unnest(range(0, len(words) - least(10, len(words)) + 1)) AS spot FROM b WHERE len(words) > 0)
), p AS (
  SELECT rid, spot, width, array_to_string(words[spot + 1:spot + width], ' ') AS gram
  FROM (SELECT rid, words, width, unnest(range(0, len(words) - width + 1)) AS spot FROM d, (SELECT DISTINCT width FROM w) WHERE len(words) >= width)
), h AS (SELECT p.rid, p.spot, p.width, w.item FROM p JOIN w ON p.gram = w.gram),
n AS (SELECT rid, count(DISTINCT word) AS n_hit FROM (SELECT rid, unnest(range(spot, spot + width)) AS word FROM (SELECT DISTINCT rid, spot, width FROM h)) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.rid = n.rid LEFT JOIN i ON d.rid = i.rid
"""


def _leaf(text: str) -> str:
    fields = [f"{c}::VARCHAR" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE octet_length(encode({f}))::VARCHAR || ':' || {f} END" for f in fields) + ")"


MANIFEST = f"""
WITH RECURSIVE l AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('S' || source, '') AS tree, {_leaf("text")} AS leaf,
         CASE WHEN {crc32("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf(LOWER.format("text"))} END AS other
  FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l
), t AS (
  SELECT tree, 0 AS lvl, pos, n, leaf AS hash FROM r
  UNION ALL
  SELECT tree, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY tree, lvl, n, pos // 16
), s AS (
  SELECT tree, hash AS subroot, row_number() OVER (ORDER BY tree) - 1 AS spot, count(*) OVER () AS m FROM t WHERE n = 1
), u AS (
  SELECT 100 AS lvl, spot AS pos, m AS n, subroot AS hash FROM s
  UNION ALL
  SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, n, pos // 16
), k AS (
  SELECT r.rid, t.lvl, string_agg(t.hash, '' ORDER BY t.pos) FILTER (t.pos < r.pos // (16 ** t.lvl)::BIGINT) AS before,
         string_agg(t.hash, '' ORDER BY t.pos) FILTER (t.pos > r.pos // (16 ** t.lvl)::BIGINT) AS behind
  FROM r JOIN t ON r.tree = t.tree AND t.n > 1 AND t.pos // 16 = r.pos // (16 ** (t.lvl + 1))::BIGINT GROUP BY r.rid, t.lvl
  UNION ALL
  SELECT r.rid, u.lvl, string_agg(u.hash, '' ORDER BY u.pos) FILTER (u.pos < s.spot // (16 ** (u.lvl - 100))::BIGINT),
         string_agg(u.hash, '' ORDER BY u.pos) FILTER (u.pos > s.spot // (16 ** (u.lvl - 100))::BIGINT)
  FROM r JOIN s ON r.tree = s.tree JOIN u ON u.n > 1 AND u.pos // 16 = s.spot // (16 ** (u.lvl - 99))::BIGINT GROUP BY r.rid, u.lvl
), p AS (
  SELECT rid, string_agg(coalesce(before, '') || coalesce(behind, ''), '' ORDER BY lvl) AS beside,
         list(coalesce(before, '') || '*' || coalesce(behind, '') ORDER BY lvl) AS steps
  FROM k GROUP BY rid
), f AS (
  SELECT r.doc_id, r.leaf, s.subroot, (SELECT hash FROM u WHERE n = 1) AS root, sha256(coalesce(p.beside, '')) AS proof_sha256,
         list_reduce(list_prepend(coalesce(r.other, r.leaf), coalesce(p.steps, [])), lambda node, step: sha256(replace(step, '*', node))) AS folded_root
  FROM r JOIN s ON r.tree = s.tree LEFT JOIN p ON r.rid = p.rid
)
SELECT *, folded_root = root AS verified FROM f
"""

SPELLING = rf"""
WITH RECURSIVE o AS (
  SELECT doc_id, unnest(regexp_extract_all({LOWER.format("text")}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), c AS (SELECT doc_id, run, count(*) AS n FROM o GROUP BY doc_id, run),
h AS (SELECT run, n, {crc32("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM c),
v AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % len(run))::INT) || substr(run, (h % len(run))::INT + 2) ELSE run END AS word, n FROM h)
  WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), x AS (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v),
g AS (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM x),
near AS (
  SELECT a.word, b.word AS other, b.n FROM g a JOIN g b ON a.head = b.head AND a.tail = b.tail AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT g.word, v.word, v.n FROM g JOIN v ON g.head || g.tail = v.word
  UNION
  SELECT v.word, g.word, g.n FROM g JOIN v ON g.head || g.tail = v.word
), best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form,
         CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n
  FROM v LEFT JOIN best ON v.word = best.word
), walk AS (
  SELECT word, word AS root, form FROM forms
  UNION ALL
  SELECT walk.word, forms.word, forms.form FROM walk JOIN forms ON walk.form = forms.word
)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON f.word = w.word WHERE w.form IS NULL
"""
