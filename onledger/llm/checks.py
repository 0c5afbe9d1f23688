"""DuckDB statements that the registered queries must equal, where SQL can say it and finish."""

from __future__ import annotations

from onledger.llm import quality

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
 win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
 rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
 gone AS (SELECT DISTINCT doc_id, i + j AS p FROM rep, range(0, 20) t(j)),
 one AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
 kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_FOLDED} AS ws FROM documents),
 b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_FOLDED} AS ws FROM benchmark),
 bw AS (SELECT DISTINCT item, least(len(ws), 10) AS size, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS k
   FROM (SELECT item, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
 sizes AS (SELECT DISTINCT size FROM bw),
 dw AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS k
   FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)),
 hit AS (SELECT doc_id, i, size, item FROM dw JOIN bw USING (size, k)),
 covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
 items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _js(p: str, q: str) -> str:
    """One bin of the Jensen-Shannon divergence."""
    return (f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) "
            "ELSE 0 END) / 2")


def quality_rules() -> str:
    """The rules of ``quality.judge``."""
    left = {n: f"length(regexp_replace(coalesce(text, ''), '{p.replace(chr(39), chr(39) * 2)}', '', 'g'))" for n, p in quality.CLASSES.items()}
    names = [*left, "space", "rest"]
    columns = ", ".join(f"{c} AS c_{n}" for n, c in left.items())
    rest = " - ".join(["word_chars", *[f"c_{n}" for n in left]])
    sums = ", ".join(f"CAST(sum(c_{n}) AS DOUBLE) AS r_{n}" for n in names)
    every = " + ".join(f"r_{n}" for n in names)
    chars = " + ".join(_js(f"coalesce(c_{n} / nullif(n_chars, 0), 0)", f"coalesce(r_{n} / nullif(r_all, 0), 0)") for n in names)
    return rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
 win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 7], ' ')) AS c
   FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
 again AS MATERIALIZED (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM win, range(0, 8) t(j) WHERE c > 1 GROUP BY doc_id),
 m AS (SELECT w.doc_id, lang, ws, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, length(text) AS n_chars,
   CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
     - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
   CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, {columns} FROM w LEFT JOIN again USING (doc_id)),
 b AS MATERIALIZED (SELECT *, n_chars - word_chars AS c_space, greatest({rest}, 0) AS c_rest, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
 r AS MATERIALIZED (SELECT lang, sum(n_words) AS r_words, {sums} FROM b GROUP BY lang),
 tok AS (SELECT doc_id, lang, unnest(list_transform(ws, lambda x: lower(x))) AS word FROM b),
 common AS MATERIALIZED (SELECT lang, word, n / r_words AS q FROM (SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS rn
   FROM tok GROUP BY lang, word) JOIN r USING (lang) WHERE rn <= {quality.COMMON}),
 seen AS (SELECT doc_id, q, CAST(count(*) AS DOUBLE) / any_value(n_words) AS p FROM tok JOIN common USING (lang, word) JOIN (SELECT doc_id, n_words FROM b) USING (doc_id)
   GROUP BY doc_id, word, q),
 js AS MATERIALIZED (SELECT doc_id, sum({_js('p', 'q')} - q / 2) AS js, sum(p) AS p_all FROM seen GROUP BY doc_id),
 far AS (SELECT b.*, sqrt(greatest({chars}, 0)) AS char_distance, greatest(1 - coalesce(p_all, 0), 0) AS po, greatest(1 - coalesce(q_all, 0), 0) AS qo,
   coalesce(js, 0) + coalesce(q_all, 0) / 2 AS js_words
   FROM b JOIN (SELECT *, {every} AS r_all FROM r) USING (lang) LEFT JOIN (SELECT lang, sum(q) AS q_all FROM common GROUP BY lang) USING (lang) LEFT JOIN js USING (doc_id))
SELECT doc_id, n_words, word_chars, CAST(c_symbol AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {quality.MIN_WORDS} AND (char_distance > {quality.MAX_CHAR_DISTANCE}
    OR sqrt(greatest(js_words + {_js('po', 'qo')}, 0)) > {quality.MAX_WORD_DISTANCE})) AS kept FROM far"""
