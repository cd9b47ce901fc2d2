"""DuckDB SQL for the queries that SQL can express, made from the same fixed values."""

from __future__ import annotations

from lanternql.llm import embedding_dedup, jaccard_join, lm_scoring, quality
from lanternql.llm.secret_scan import RULES

WORD = r"[^\x20\x09-\x0D]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def numbers(values) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


def js(counts: str, shares: str, total: str) -> str:
    """Jensen-Shannon distance of counts from shares."""
    p, q = f"(z[1] / {total})", "z[2]"
    middle = f"(({p} + {q}) / 2)"
    part = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / {middle}) ELSE 0 END"
    return f"sqrt(greatest(0, list_sum(list_transform(list_zip({counts}, {shares}), lambda z: {part(p)} + {part(q)})) / 2))"


def quality_sql() -> str:
    references = ", ".join(f"({quoted(lang)}, {numbers(chars)}, [{', '.join(map(quoted, common))}], {numbers(words)})" for lang, (chars, common, words) in quality.REFERENCES.items())
    classes = ", ".join(f"length(regexp_replace(text, {quoted(f'[^{c}]+')}, '', 'g'))::DOUBLE" for c in quality.CLASSES)
    known = ", ".join(map(quoted, quality.REFERENCES))
    (cl, cs), (wl, ws) = quality.CHAR_LIMIT, quality.WORD_LIMIT
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, lang FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words FROM t),
tok AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT doc_id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS g FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, lang, words, text, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines, coalesce(rep.n, 0) AS n_repeat_words, [{classes}] AS cc
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
k AS (SELECT *, list_append(cc, length(text) - list_sum(cc)) AS chars FROM m),
ref(ref_lang, q_chars, common, q_words) AS (VALUES {references}),
each_ref AS (
  SELECT doc_id, ref_lang, {js('chars', 'q_chars', 'length(text)')} AS cd,
    list_transform(common, lambda c: len(list_filter(words, lambda x: lower(x) = c))::DOUBLE) AS wc, q_words, n_words
  FROM k, ref WHERE n_words > 0 AND (lang = ref_lang OR lang IS NULL OR lang NOT IN ({known}))),
near AS (
  SELECT doc_id, min(cd) AS cd, min({js('list_append(wc, n_words - list_sum(wc))', 'q_words', 'n_words')}) AS wd FROM each_ref GROUP BY doc_id)
SELECT k.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words)
    AND NOT coalesce(length(text) >= {quality.LEAST_CHARS_JUDGED} AND cd > {cl} + {cs} / sqrt(n_words), false)
    AND NOT coalesce(n_words >= {quality.LEAST_WORDS_JUDGED} AND wd > {wl} + {ws} / sqrt(n_words), false) AS kept
FROM k LEFT JOIN near ON k.doc_id = near.doc_id"""


def secrets_sql() -> str:
    parts = []
    for rank, rule in enumerate(RULES):
        pattern = quoted(rule.pattern)
        parts.append(
            f"SELECT doc_id, {rank} AS rank, {quoted(rule.kind)} AS kind, {str(rule.base).lower()} AS base, regexp_extract_all(text, {pattern}) AS found, "
            f"regexp_extract_all(text, {pattern}, {rule.group}) AS body, string_split_regex(text, {pattern}) AS gaps, {rule.least} AS least FROM t"
        )
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
r AS ({' UNION ALL '.join(parts)}),
p AS (SELECT doc_id, rank, kind, base, least, found, body, gaps, unnest(generate_series(1, len(found))) AS i FROM r WHERE len(found) > 0),
s AS (
  SELECT doc_id, rank, kind, base, length(body[i]) >= least AS good,
    (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start, length(found[i]) AS n FROM p),
a AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, rank, start + n) FILTER (base) AS base_spans,
    string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, rank, start + n) AS spans FROM s WHERE good GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a ON t.doc_id = a.doc_id"""


#: crc32 of a number's text, as zlib has it.
CRC = """
crc_table AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table)"""


def katz_sql() -> str:
    """The model by joins on words themselves; discounts, weights and all three levels."""
    k, spare = lm_scoring.K, lm_scoring.HELD

    def factors(level: str) -> str:
        """d(1..K) of a table of counts c."""
        numbers = ", ".join(f"count(*) FILTER (c = {r})" for r in range(1, k + 2))
        common = f"CASE WHEN n[1] > 0 THEN {k + 1.0} * n[{k + 1}] / n[1] ELSE 1.0 END"
        d = [f"CASE WHEN n[{r}] > 0 AND common < 1 THEN ({r + 1.0} * n[{r + 1}] / ({r} * nullif(n[{r}], 0)) - common) / nullif(1 - common, 0) ELSE 0 END" for r in range(1, k + 1)]
        fit = ", ".join(f"CASE WHEN x[{r}] > 0 AND x[{r}] < 1 THEN x[{r}] ELSE {(r - 0.5) / r!r} END" for r in range(1, k + 1))
        return f"SELECT [{fit}] AS d FROM (SELECT [{', '.join(d)}] AS x FROM (SELECT *, {common} AS common FROM (SELECT [{numbers}] AS n FROM {level})))"

    cut = lambda c, d: f"({c} * CASE WHEN {c} <= {k} THEN {d}[{c}] ELSE 1 END)"
    return rf"""
WITH {CRC},
d AS (
  SELECT row_number() OVER () AS row, documents.doc_id, coalesce(crc % 5 = 1, false) AS held,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
  FROM documents LEFT JOIN crc ON documents.doc_id = crc.doc_id),
t AS (SELECT row, held, unnest(list_append(words, ' end')) AS w, generate_subscripts(list_append(words, ' end'), 1) AS i FROM d),
g AS (SELECT row, held, w, coalesce(lag(w) OVER o, ' start') AS v, coalesce(lag(w, 2) OVER o, ' start') AS u FROM t WINDOW o AS (PARTITION BY row ORDER BY i)),
one AS (SELECT w, count(*) AS c FROM g WHERE NOT held GROUP BY w),
two AS (SELECT v, w, count(*) AS c FROM g WHERE NOT held GROUP BY v, w),
three AS (SELECT u, v, w, count(*) AS c FROM g WHERE NOT held GROUP BY u, v, w),
d1 AS ({factors("one")}), d2 AS ({factors("two")}), d3 AS ({factors("three")}),
n AS (SELECT coalesce(sum(c), 0)::DOUBLE AS n, count(*) AS types FROM one),
unknown AS (SELECT (coalesce((SELECT sum(c - {cut("c", "d")}) FROM one, d1), 0) + {spare}) / (n + {spare}) AS rest FROM n),
p1 AS (SELECT w, {cut("c", "d")} / (n + {spare}) AS p FROM one, d1, n),
h1 AS (
  SELECT v, sum(two.c) AS c, (sum(two.c - {cut("two.c", "d")}) + {spare}) / (sum(two.c) + {spare}) / greatest(1 - sum(p), any_value(rest)) AS a
  FROM two JOIN p1 ON two.w = p1.w, d2, unknown GROUP BY v),
p2 AS (SELECT two.v, w, {cut("two.c", "d")} / (h1.c + {spare}) AS p FROM two JOIN h1 ON two.v = h1.v, d2),
h2 AS (
  SELECT u, three.v, sum(three.c) AS c, (sum(three.c - {cut("three.c", "d")}) + {spare}) / (sum(three.c) + {spare}) / greatest(1 - sum(p), any_value(h1.a) * any_value(rest)) AS a
  FROM three JOIN p2 ON three.v = p2.v AND three.w = p2.w JOIN h1 ON three.v = h1.v, d3, unknown GROUP BY u, three.v),
p3 AS (SELECT three.u, three.v, w, {cut("three.c", "d")} / (h2.c + {spare}) AS p FROM three JOIN h2 ON three.u = h2.u AND three.v = h2.v, d3),
s AS (
  SELECT g.row, one.c AS c, log10(coalesce(p3.p, coalesce(h2.a, 1) * coalesce(p2.p, coalesce(h1.a, 1) * coalesce(p1.p, rest)))) AS score
  FROM g LEFT JOIN one ON g.w = one.w LEFT JOIN p1 ON g.w = p1.w LEFT JOIN p2 ON g.v = p2.v AND g.w = p2.w LEFT JOIN h1 ON g.v = h1.v
    LEFT JOIN h2 ON g.u = h2.u AND g.v = h2.v LEFT JOIN p3 ON g.u = p3.u AND g.v = p3.v AND g.w = p3.w, unknown)
SELECT any_value(d.doc_id) AS doc_id, any_value(held) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens,
  sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (types + 1)))) AS base_score, sum(score) AS score
FROM s JOIN d ON s.row = d.row, n GROUP BY s.row"""


def reach(links: str) -> str:
    """Common table expressions: all (a, b) that ``links`` connect."""
    return f"reach(a, b) AS (SELECT a, b FROM {links} UNION SELECT reach.a, {links}.b FROM reach JOIN {links} ON reach.b = {links}.a)"


def jaccard_sql() -> str:
    """All pairs of texts that share a shingle, on the words themselves; nothing is missed, so recall is 1."""
    k = jaccard_join.SHINGLE
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
nodes AS (SELECT row_number() OVER () AS node, * FROM (SELECT text, min(doc_id) AS copy_id, count(*) AS weight FROM d GROUP BY text)),
w AS (SELECT node, regexp_extract_all(text, '{WORD}') AS words FROM nodes),
p AS (SELECT node, words, unnest(generate_series(1, greatest(len(words) - {k - 1}, least(len(words), 1)))) AS i FROM w),
s AS (SELECT DISTINCT node, array_to_string(words[i:i + {k - 1}], ' ') AS g FROM p),
size AS (SELECT node, count(*) AS n FROM s GROUP BY node),
pairs AS (SELECT x.node AS a, y.node AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.node <> y.node GROUP BY x.node, y.node),
links AS (SELECT a, b FROM pairs JOIN size x ON a = x.node JOIN size y ON b = y.node WHERE shared >= {jaccard_join.SIMILARITY} * (x.n + y.n - shared) - 1e-9),
{reach("links")},
own AS (SELECT a AS node, min(copy_id) AS least FROM reach JOIN nodes ON b = node GROUP BY a),
other AS (SELECT a AS node, sum(weight) AS n FROM links JOIN nodes ON b = node GROUP BY a)
SELECT doc_id, coalesce(least, copy_id) AS class_id, (coalesce(n, 0) + weight - 1)::BIGINT AS n_links, copy_id,
  coalesce(doc_id = coalesce(least, copy_id), coalesce(least, copy_id) IS NULL) AS kept, 1::DOUBLE AS recall
FROM d JOIN nodes ON d.text = nodes.text LEFT JOIN own ON nodes.node = own.node LEFT JOIN other ON nodes.node = other.node"""


def embeddings_sql() -> str:
    """All pairs of one label."""
    return rf"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS row, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
fine AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.row AS a, y.row AS b FROM fine x JOIN fine y ON x.label = y.label AND x.row <> y.row AND len(x.e) = len(y.e)
  WHERE CASE WHEN len(x.e) = len(y.e) THEN list_cosine_similarity(x.e, y.e) >= {embedding_dedup.COSINE} ELSE false END),
{reach("links")},
own AS (SELECT a AS row, min(vec_id) AS least FROM reach JOIN v ON b = v.row GROUP BY a),
other AS (SELECT a AS row, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least, vec_id) AS component_id, coalesce(vec_id = coalesce(least, vec_id), true) AS kept
FROM v LEFT JOIN own ON v.row = own.row LEFT JOIN other ON v.row = other.row"""


def all_sql() -> dict[str, str]:
    return {
        "op1_jaccard_join": jaccard_sql(), "op2_quality_divergence": quality_sql(), "op3_katz_scores": katz_sql(), "op4_secret_scan": secrets_sql(), "op6_embedding_dedup": embeddings_sql(),
    }
