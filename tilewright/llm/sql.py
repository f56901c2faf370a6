"""DuckDB SQL for the queries of this subpackage that SQL can express; constants come from the operators' parameters."""

from __future__ import annotations

from tilewright.llm import decontamination as clean
from tilewright.llm import jaccard_join as near
from tilewright.llm import quality_rules as rules

WORD = r"[^\x20\x09-\x0D]+"


def quality_rules() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    classes = {
        "lower": "[a-z]",
        "upper": "[A-Z]",
        "digit": "[0-9]",
        "space": r"[\x20\x09-\x0D]",
        "sentence": "[.,;:!?'\"()\\-]",
        "wide": r"[^\x00-\x7F]",
    }
    count = lambda pattern: f"length(regexp_replace(text, {quoted(pattern)}, '', 'g'))"
    parts = {name: f"(length(text) - {count(pattern)})" for name, pattern in classes.items()}
    parts["symbol"] = f"(length(text) - {' - '.join(parts.values())})"
    class_rows = ", ".join(f"{{'bin': {k}, 'n': {parts[name]}::BIGINT}}" for k, name in enumerate(rules.CLASSES))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    distance = lambda table, ref: (
        f"""SELECT p.k, q.lang, sqrt(greatest(0, least(1, (sum(CASE WHEN p.p > 0 THEN p.p * log2(p.p / ((p.p + q.p) / 2)) ELSE 0 END)
          + sum(CASE WHEN q.p > 0 THEN q.p * log2(q.p / ((p.p + q.p) / 2)) ELSE 0 END)) / 2))) AS d
          FROM {table} p JOIN {ref} q USING (bin) GROUP BY p.k, q.lang"""
    )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS text FROM documents),
base AS (SELECT k, doc_id, lang, text, regexp_extract_all(text, '{WORD}') AS w FROM docs),
spans AS (SELECT k, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM spans) WHERE n >= 2),
repeated AS (SELECT k, count(DISTINCT i + j) AS n FROM twice, range(0, 5) r(j) GROUP BY k),
lines AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{WORD}') GROUP BY k),
counted AS (
  SELECT base.k, doc_id, lang, text, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN lines USING (k) LEFT JOIN repeated USING (k)),
chars AS (SELECT k, lang, unnest([{class_rows}], recursive := true) FROM docs),
words AS (SELECT k, lang, unnest(list_transform(w, lambda x: translate(x, '{upper}', '{lower}'))) AS word FROM base),
common AS (SELECT row_number() OVER (ORDER BY word) AS bin, word FROM (SELECT DISTINCT word FROM (
  SELECT word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r FROM words WHERE lang IS NOT NULL GROUP BY lang, word) WHERE r <= {rules.COMMON_WORDS})),
found AS (SELECT k, lang, coalesce(bin, 0) AS bin, count(*) AS n FROM words LEFT JOIN common USING (word) GROUP BY ALL),
bins AS (SELECT 0 AS bin UNION ALL SELECT bin FROM common),
texts AS (SELECT DISTINCT k, lang FROM found),
seen AS (SELECT texts.k, texts.lang, bins.bin, coalesce(found.n, 0) AS n FROM texts CROSS JOIN bins LEFT JOIN found ON found.k = texts.k AND found.bin = bins.bin),
used AS (SELECT DISTINCT lang FROM docs WHERE lang IS NOT NULL),
char_ref AS (SELECT lang, bin, sum(n) / greatest(sum(sum(n)) OVER (PARTITION BY lang), 1) AS p FROM chars JOIN used USING (lang) GROUP BY lang, bin),
word_ref AS (SELECT lang, bin, sum(n) / greatest(sum(sum(n)) OVER (PARTITION BY lang), 1) AS p FROM seen JOIN used USING (lang) GROUP BY lang, bin),
char_p AS (SELECT k, bin, n / sum(n) OVER (PARTITION BY k) AS p, sum(n) OVER (PARTITION BY k) AS total FROM chars),
word_p AS (SELECT k, bin, n / sum(n) OVER (PARTITION BY k) AS p FROM seen),
char_d AS ({distance('char_p', 'char_ref')}),
word_d AS ({distance('word_p', 'word_ref')}),
scored AS (SELECT c.k, c.d AS c, coalesce(w.d, 1) AS w, row_number() OVER (PARTITION BY c.k ORDER BY c.d + coalesce(w.d, 1), c.lang) AS r
  FROM char_d c LEFT JOIN word_d w ON w.k = c.k AND w.lang = c.lang),
judged AS (SELECT t.*, n_words < {rules.MIN_WORDS_BASE} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  coalesce(length(text) >= {rules.MIN_CHARS} AND (c > {rules.MAX_CLASS_DISTANCE} OR n_words >= {rules.MIN_WORDS} AND c + w > {rules.MAX_TOTAL_DISTANCE}), false) AS far
  FROM counted t LEFT JOIN scored s ON s.k = t.k AND s.r = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept FROM judged
"""


def decontamination() -> str:
    listed = f"regexp_extract_all(translate(coalesce(text, ''), '{clean.UPPER}', '{clean.LOWER}'), '[^{clean.BETWEEN[1:-2]}]+')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, {listed} AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, {listed} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, win, len(win) AS size FROM (
  SELECT item, array_to_string(x, ' ') AS joined, x AS win FROM (SELECT item, unnest(list_transform(range(1, greatest(len(w) - {clean.WINDOW} + 1, 1) + 1), lambda i: w[i:i + {clean.WINDOW - 1}])) AS x FROM items WHERE len(w) > 0))),
grams AS (SELECT k, size, i, w[i:i + size - 1] AS win FROM (
  SELECT k, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT k, i, size, item FROM grams JOIN windows USING (size, win)),
hits AS (SELECT k, count(DISTINCT i + j) AS n FROM (SELECT DISTINCT k, i, size FROM found) f, range(0, {clean.WINDOW}) r(j) WHERE j < f.size GROUP BY k),
named AS (SELECT k, count(item) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM found) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(named.items, '')) AS items_sha256,
  coalesce(hits.n, 0) > 0 AND {clean.HIT_SHARE} * coalesce(hits.n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (k) LEFT JOIN named USING (k)
"""


def jaccard_join() -> str:
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{clean.UPPER}', '{clean.LOWER}'), '{WORD}') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(x, ' ') AS s FROM (
  SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - {near.WIDTH} + 1, 1) + 1), lambda i: w[i:i + {near.WIDTH - 1}])) AS x FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM common JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * c >= {near.PERCENT} * (a.n + b.n - c)),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(r.v, doc_id))::BIGINT AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT u, min(v) AS v FROM reach GROUP BY u) r ON r.u = doc_id
"""
