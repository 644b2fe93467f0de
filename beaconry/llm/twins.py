"""DuckDB twins of the numbered queries that SQL can express."""

from __future__ import annotations

from beaconry.llm import bloom, codebooks, quality, vafile
from beaconry.llm.common import SPACE, WORD


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def quality_sql() -> str:
    """Every measure and verdict of the quality rules, the threshold table compiled into one condition."""
    bounds = [f"{m} {sign} {bound}::DOUBLE" for m, *sides in quality.RULES for sign, bound in zip((">=", "<="), sides, strict=True) if bound is not None]
    last = quality.WINDOW - 1
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
lists AS (
  SELECT r, doc_id, t,
    list_filter(string_split_regex(t, '{SPACE}+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l
  FROM texts),
windows AS (
  SELECT r, unnest(list_transform(range(1, len(w) - {last - 1}), lambda i: {{'i': i, 'k': array_to_string(list_slice(w, i, i + {last}), ' ')}})) AS s
  FROM lists WHERE len(w) > {last}),
twice AS (SELECT r, s.i AS i FROM windows QUALIFY count(*) OVER (PARTITION BY r, s.k) > 1),
cover AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range({quality.WINDOW}) AS g(j) GROUP BY r),
counts AS (
  SELECT doc_id::BIGINT AS doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(l) AS n_lines, greatest(len(w), 1)::DOUBLE AS per_word,
    len(list_filter(w, lambda x: lower(x) IN ({_list(quality.STOP_WORDS)}))) AS n_stop_words,
    len(list_filter(w, lambda x: x = '|')) AS n_bars,
    len(list_filter(w, lambda x: ends_with(x, '!!'))) AS n_exclaimed
  FROM lists LEFT JOIN cover USING (r)),
measured AS (
  SELECT *, word_chars / per_word AS mean_word_chars, n_symbols / per_word AS symbols_per_word, n_stop_words / per_word AS stop_word_share,
    n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_share, n_bars / per_word AS bar_share, n_exclaimed / per_word AS exclaimed_share,
    n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed
  FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(bounds)} AS kept
FROM measured
"""


def urls_sql() -> str:
    """Rules by join, listed hosts by pattern: what the cascade must answer without either."""
    rules = ", ".join(f"('{action}', '{host}', '{path}')" for action, host, path in bloom.RULES)
    return f"""
WITH rules(action, rule_host, rule_path) AS (VALUES {rules}),
rests AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM rests),
fits AS (
  SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY r)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN regexp_matches(host, '{bloom.AD_LABEL}') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (r)
"""


def codes_sql() -> str:
    """Complete scans in every round, where the operator compares active entries only."""
    parts, entries = codebooks.PARTS, codebooks.ENTRIES
    assigned = """
a{n} AS (
  SELECT r, p, arg_min(e.i, struct_pack(d := {d}, i := e.i)) AS i, min({d}) AS d
  FROM parts JOIN e{n} AS e USING (p) GROUP BY r, p)"""
    moved = """
m{n} AS (
  SELECT p, i, list(s ORDER BY j) AS v FROM (
    SELECT a.p, a.i, j, floor(sum(parts.v[j])::DOUBLE / count(*))::BIGINT AS s
    FROM a{n} AS a JOIN parts USING (r, p), range(1, (SELECT w FROM width) + 1) AS g(j) GROUP BY a.p, a.i, j) GROUP BY p, i),
e{after} AS (SELECT e.p, e.i, coalesce(m.v, e.v) AS v FROM e{n} AS e LEFT JOIN m{n} AS m USING (p, i))"""
    distance = "list_sum(list_transform(list_zip(parts.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = ",".join(assigned.format(n=n, d=distance) + ("," + moved.format(n=n, after=n + 1) if n < codebooks.ROUNDS else "") for n in range(codebooks.ROUNDS + 1))
    last = codebooks.ROUNDS
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({codebooks.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT max(len(v)) // {parts} AS w FROM kept),
parts AS (SELECT r, p, v[p * w + 1 : (p + 1) * w] AS v FROM kept, width, range({parts}) AS g(p)),
e0 AS (SELECT p, r - 1 AS i, v FROM parts WHERE r <= {entries}),{steps},
coded AS (SELECT r, string_agg(lower(format('{{:02x}}', i)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, i)) FROM e{last}) AS codebooks_sha256
FROM coded JOIN kept USING (r)
"""


def nearest_sql() -> str:
    """Every inner product, where the operator reads few exact vectors."""
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({vafile.SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id, q.r, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM kept AS q JOIN kept AS c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER best)::INTEGER AS rank, vec_id, score FROM ranked
WINDOW best AS (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) QUALIFY rank <= {vafile.BEST}
"""


def oracles() -> dict[str, str]:
    return {"op7_url_cascade": urls_sql(), "op9_quality": quality_sql(), "op11_nearest": nearest_sql(), "op12_codes": codes_sql()}
