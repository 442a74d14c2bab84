"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from termsheet.llm import rules, spans

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_CRC32 = """xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda p: ('0x' || p)::BIGINT),
    lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"""

_CRC_TABLE = """crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, x: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t)"""

OP7 = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {_CRC32.format("coalesce(text, '')")} AS text_crc32,
        source IS NULL AS none, coalesce(source, '') AS stratum, md5('interleave:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents, crc_table),
r AS (SELECT *, row_number() OVER (PARTITION BY none, stratum ORDER BY digest) - 1 AS rank, count(*) OVER (PARTITION BY none, stratum) AS n FROM d),
p AS (SELECT *, (rank + ('0x' || substr(md5('interleave:source:' || none::VARCHAR || stratum), 1, 8))::BIGINT::DOUBLE / 4294967296.0) / n AS part FROM r),
q AS (SELECT *, row_number() OVER (ORDER BY part, none, stratum, digest) - 1 AS place, count(*) OVER () AS total FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (place * 24 // total)::INTEGER AS shard,
       (place - ((place * 24 // total) * total + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM q"""


def op9(risk: float = 0.05, delta: float = 0.05) -> str:
    tests = [(name, c, f"{a} > {c} * {b}") for name, a, b, cs in rules.RULES for c in cs]
    counted = ", ".join(f"count(*) FILTER ({t}) AS f{i}" for i, (_, _, t) in enumerate(tests))
    listed = " UNION ALL ".join(f"SELECT lang, n, '{name}' AS rule, {c} AS cutoff, f{i} AS k FROM counted" for i, (name, c, _) in enumerate(tests))
    share = risk / len(rules.RULES)
    bound = (f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)"
             f" + i * ln({share}) + (n - i) * ln(1 - {share}))))")
    fails = ", ".join(f"CASE WHEN {a} > (SELECT min(cutoff) FROM safe s WHERE s.lang IS NOT DISTINCT FROM b.lang AND s.rule = '{name}') * {b_} THEN '{name}' END"
                      for name, a, b_, _ in rules.RULES)
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
w AS (SELECT row, unnest({_WORDS.format("t")}) AS w, generate_subscripts({_WORDS.format("t")}, 1) AS i FROM t),
g AS (SELECT row, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY row ORDER BY i)),
c AS (SELECT row, i, count(*) OVER (PARTITION BY row, w, w2, w3) AS n FROM g WHERE w3 IS NOT NULL),
rep AS (SELECT row, count(DISTINCT j) AS n_repeat_words FROM (SELECT row, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY row),
l AS (SELECT row, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
m AS (SELECT doc_id, lang, len({_WORDS.format("t")}) AS n_words, coalesce(list_sum(list_transform({_WORDS.format("t")}, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(t) - length(translate(t, '{rules.SYMBOLS}', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_capitals,
        length(t) - length(replace(t, '!', '')) AS n_shouts FROM t JOIN l USING (row) LEFT JOIN rep USING (row)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
counted AS (SELECT lang, count(*) AS n, {counted} FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY lang),
listed AS ({listed}),
safe AS (SELECT * FROM listed WHERE k <= n * {share} AND {bound} <= {delta} / (SELECT count(*) FROM listed)),
j AS (SELECT *, list_filter([{fails}], lambda x: x IS NOT NULL) AS failed_rules FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND len(failed_rules) = 0 AS kept, failed_rules
FROM j"""


def op6(sentences: int = 2, min_words: int = 20) -> str:
    return rf"""
WITH t AS (SELECT row_number() OVER (ORDER BY doc_id) AS row, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT row, unnest(regexp_extract_all(t, '{spans.SENTENCE}')) AS s, generate_subscripts(regexp_extract_all(t, '{spans.SENTENCE}'), 1) AS i FROM t),
n AS (SELECT row, i, s, {_WORDS.format("lower(s)")} AS w FROM s),
k AS (SELECT row, i, len(w) AS n, array_to_string(w, ' ') AS norm, row_number() OVER o AS k,
        (sum(len(w)) OVER (o ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM n WHERE len(w) > 0 WINDOW o AS (PARTITION BY row ORDER BY i)),
r AS (SELECT a.row, a.k, a.i, min(b.k) AS e FROM k a JOIN k b ON a.row = b.row AND b.k >= a.k + {sentences - 1} AND b.upto - a.upto + a.n >= {min_words}
      GROUP BY a.row, a.k, a.i),
span AS (SELECT r.row, r.k, r.e, string_agg(k.norm, chr(10) ORDER BY k.k) AS span FROM r JOIN k ON k.row = r.row AND k.k BETWEEN r.k AND r.e GROUP BY r.row, r.k, r.e),
again AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY span ORDER BY row, k) AS turn FROM span) WHERE turn > 1),
gone AS (SELECT DISTINCT k.row, k.i FROM again a JOIN k ON k.row = a.row AND k.k BETWEEN a.k AND a.e),
kept AS (SELECT n.row, coalesce(string_agg(n.s, '' ORDER BY n.i) FILTER (gone.i IS NULL), '') AS kept, count(gone.i) AS n_removed_sentences
         FROM n LEFT JOIN gone ON gone.row = n.row AND gone.i = n.i GROUP BY n.row)
SELECT doc_id, octet_length(encode(t))::BIGINT AS n_bytes, (octet_length(encode(t)) - octet_length(encode(coalesce(kept, ''))))::BIGINT AS n_removed,
       coalesce(n_removed_sentences, 0)::BIGINT AS n_removed_sentences, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (row)"""


def op13(fanout: int = 8) -> str:
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR END"
    known = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    up = (f"SELECT tree, k + 1, i // {fanout}, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + {fanout - 1}) // {fanout}"
          f" FROM {{0}} WHERE n > 1 GROUP BY tree, k, i // {fanout}")
    sides = (f"coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < p.i), '') AS l, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > p.i), '') AS r"
             f" FROM {{0}} p JOIN {{1}} s ON s.tree = p.tree AND s.k = p.k AND s.i // {fanout} = p.i // {fanout}")
    return f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce('=' || lang, '') AS tree, sha256({known} || {field.format("text")}) AS leaf,
        CASE WHEN doc_id IS NOT NULL AND {_CRC32.format("doc_id::VARCHAR")} % 3 = 0 THEN sha256({known} || {field.format(lower)}) END AS bad FROM documents, crc_table),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
up(tree, k, i, h, n) AS (SELECT tree, 0, i, leaf, n FROM o UNION ALL {up.format("up")}),
sub AS MATERIALIZED (SELECT tree AS of, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top(tree, k, i, h, n) AS (SELECT 0, 0, i, h, n FROM sub UNION ALL {up.format("top")}),
own(row, tree, k, i) AS (SELECT row, tree, up.k, o.i // ({fanout} ** up.k)::BIGINT FROM o JOIN (SELECT DISTINCT tree, k FROM up WHERE n > 1) up USING (tree)),
over(of, tree, k, i) AS (SELECT of, 0, top.k, sub.i // ({fanout} ** top.k)::BIGINT FROM sub, (SELECT DISTINCT k FROM top WHERE n > 1) top),
step AS (SELECT p.row, p.k, {sides.format("own", "up")} GROUP BY p.row, p.k, p.i
  UNION ALL SELECT o.row, 1000 + x.k, x.l, x.r FROM o JOIN (SELECT p.of, p.k, {sides.format("over", "top")} GROUP BY p.of, p.k, p.i) x ON x.of = o.tree),
turn AS MATERIALIZED (SELECT row, l, r, row_number() OVER (PARTITION BY row ORDER BY k) - 1 AS k, count(*) OVER (PARTITION BY row) AS n FROM step),
proof AS (SELECT row, string_agg(l || r, '' ORDER BY k) AS proof FROM turn GROUP BY row),
fold(row, k, h) AS (SELECT row, 0, coalesce(bad, leaf) FROM o UNION ALL SELECT fold.row, fold.k + 1, sha256(l || h || r) FROM fold JOIN turn ON turn.row = fold.row AND turn.k = fold.k),
last AS (SELECT row, arg_max(h, k) AS folded_root FROM fold GROUP BY row)
SELECT doc_id, leaf, sub.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root,
       folded_root = (SELECT h FROM top WHERE n = 1) AS verified
FROM o JOIN sub ON sub.of = o.tree JOIN last USING (row) LEFT JOIN proof USING (row)"""


OP12 = f"""
WITH {_CRC_TABLE},
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
        coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, list(struct_pack(role := role, text := text) ORDER BY i) AS own FROM t GROUP BY c),
h AS (SELECT c, own, c - c % 5 AS base, {_CRC32.format("c::VARCHAR")} % 9 AS h FROM k, crc_table),
r AS MATERIALIZED (SELECT h.c, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS turns FROM h LEFT JOIN k b ON b.c = h.base),
p AS MATERIALIZED (SELECT c, d, turns[1:d] AS path, len(turns) = d AS ends FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS MATERIALIZED (SELECT path, d, min(c) AS c, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ended,
        (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(path[d].text)) END AS saved FROM p GROUP BY path, d),
e AS MATERIALIZED (SELECT a.path, a.d, a.c, a.n, a.ended, a.saved, b.c AS parent FROM n a LEFT JOIN n b ON a.d > 0 AND b.path = a.path[1:a.d - 1]),
kids AS MATERIALIZED (SELECT path[1:d - 1] AS path, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
below AS (SELECT path, unnest(range(0, d + 1)) AS up, saved, d, path NOT IN (SELECT path FROM kids) AS leaf FROM n),
sums AS (SELECT path[1:up] AS path, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves FROM below GROUP BY 1)
SELECT c::BIGINT AS conv_id, d::BIGINT AS depth, parent::BIGINT AS parent_conv_id, n::BIGINT AS n_convs, coalesce(kids, 0)::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens, sha256(ended) AS ends_sha256
FROM e LEFT JOIN kids USING (path) JOIN sums USING (path)"""
