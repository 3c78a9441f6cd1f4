"""DuckDB SQL for the rows of operators 11 to 13."""

from __future__ import annotations

from gridlake.llm import outliers


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of a text of ASCII characters."""
    return f"""xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::BIGINT),
      lambda c, b: list_reduce([xor(c, b)] || range(8), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))))"""


PREFIX_TRIE = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own)),
rebuilt AS (
  SELECT i.conv_id, o.p, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.conv_id - i.conv_id % 5 AND o.p <= i.h
  UNION ALL SELECT i.conv_id, o.p, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.p > i.h),
deep AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS depth, strlen(text) AS size,
         sha256(length(role) || ':' || role || text) AS turn FROM rebuilt),
path AS (SELECT conv_id, depth, size, sha256(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM deep
         UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
named AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
          depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM path),
node AS (SELECT key, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(size) AS size, any_value(parent) AS parent,
         count(*) AS n FROM named GROUP BY key),
kids AS (SELECT parent AS key, count(*) AS n_children FROM node WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT p.key, sum((n.n - 1) * n.size)::BIGINT AS saved, count(*) FILTER (WHERE k.key IS NULL) AS leaves
          FROM node n JOIN named p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN kids k ON k.key = n.key GROUP BY p.key),
done AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM named WHERE ends GROUP BY key)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
       b.leaves AS n_leaves, b.saved AS saved_tokens, coalesce(d.ends_sha256, sha256('')) AS ends_sha256
FROM node n LEFT JOIN node u ON u.key = n.parent LEFT JOIN kids k ON k.key = n.key JOIN below b ON b.key = n.key LEFT JOIN done d ON d.key = n.key
"""

CONVERSATION_REPAIR = f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS code FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) t(copy)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
r AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM placed),
ids AS (SELECT DISTINCT conv_id FROM conversations),
ins(f, t, cost, audit, said) AS (VALUES
  ('e', 'e', 0, '', ''), ('e', 'u', 3, 'I', chr(10) || 'user:'), ('e', 'a', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('s', 's', 0, '', ''), ('s', 'u', 3, 'I', chr(10) || 'user:'), ('s', 'a', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('u', 'u', 0, '', ''), ('u', 'a', 3, 'I', chr(10) || 'assistant:'), ('a', 'a', 0, '', ''), ('a', 'u', 3, 'I', chr(10) || 'user:')),
step(f, t, letter, cost) AS (VALUES
  ('e', 'e', 'D', 4), ('s', 's', 'D', 4), ('u', 'u', 'D', 4), ('a', 'a', 'D', 4),
  ('e', 'u', 'R', 3), ('s', 'u', 'R', 3), ('a', 'u', 'R', 3), ('u', 'a', 'R', 3),
  ('e', 's', 'K', 0), ('e', 'u', 'K', 0), ('s', 'u', 'K', 0), ('a', 'u', 'K', 0), ('u', 'a', 'K', 0)),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, 'e' AS s, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS b FROM ids
  UNION ALL
  SELECT dp.conv_id, r.i, step.t, min({{
      'c': dp.b.c + ins.cost + step.cost + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END,
      'a': dp.b.a || ins.audit || letter,
      't': dp.b.t || ins.said || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text
           ELSE chr(10) || CASE step.t WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text END}})
  FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1 JOIN ins ON ins.f = dp.s JOIN step ON step.f = ins.t
  WHERE letter = 'D' OR fault NOT IN ('blank', 'duplicate') AND (letter = 'R' OR role[1] = step.t)
  GROUP BY dp.conv_id, r.i, step.t),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY conv_id),
best AS (
  SELECT dp.conv_id, min({{'c': dp.b.c + ins.cost, 'a': dp.b.a || ins.audit, 't': dp.b.t || ins.said}}) AS b
  FROM dp JOIN ins ON ins.f = dp.s LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id
  WHERE ins.t IN ('e', 'a') AND dp.i = coalesce(f.n, 0) GROUP BY dp.conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.c AS cost, b.a AS audit, sha256(substr(b.t, 2)) AS repaired_sha256
FROM ids JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


def robust_outliers() -> str:
    """The verdicts from sorted distances instead of bins, and from three starts."""
    p, pairs = outliers.P, outliers.PAIRS
    x = [name for name, _, _ in outliers.FEATURES]
    sums = ", ".join(["count(*) AS m", *[f"sum({x[i]}) AS s{i}" for i in range(p)], *[f"sum({x[i]} * {x[j]}) AS s{i}_{j}" for i, j in pairs]])

    def shape(name: str, moments: str, keys: str, factor: float) -> list[str]:
        """CTEs from moments to centre, Cholesky factor and log determinant."""
        made = [f"{name}_c AS (SELECT *, {', '.join(f's{i} / m AS c{i}' for i in range(p))} FROM ({moments}))"]
        last = f"{name}_c"
        for i, j in pairs:
            own = f"{factor!r} * (s{i}_{j} / m - c{i} * c{j})"
            own = f"greatest({own}, 0) + {outliers.FEATURES[i][2] ** 2!r}" if i == j else own
            own = " - ".join([own, *[f"l{i}_{k} * l{j}_{k}" for k in range(j)]])
            own = f"sqrt(greatest({own}, 1e-9))" if i == j else f"({own}) / l{j}_{j}"
            made.append(f"{name}_{i}_{j} AS (SELECT *, {own} AS l{i}_{j} FROM {last})")
            last = f"{name}_{i}_{j}"
        made.append(f"{name} AS MATERIALIZED (SELECT {keys}, {', '.join(outliers.SHAPE[:-1])}, "
                    f"2 * ({' + '.join(f'ln(l{i}_{i})' for i in range(p))}) AS logdet FROM {last})")
        return made

    def distance(name: str, rows: str) -> list[str]:
        made, last = [], rows
        for i in range(p):
            own = " - ".join([f"{x[i]} - c{i}", *[f"l{i}_{k} * y{k}" for k in range(i)]])
            made.append(f"{name}_{i} AS (SELECT *, ({own}) / l{i}_{i} AS y{i} FROM {last})")
            last = f"{name}_{i}"
        return [*made, f"{name} AS (SELECT *, {' + '.join(f'y{i} * y{i}' for i in range(p))} AS d2 FROM {last})"]

    features = ", ".join(f"{sql} AS {name}" for name, sql, _ in outliers.FEATURES).replace("log1p(n_words)", "ln(1 + n_words)")
    features = features.replace("log1p(1000 * n_symbols / word_chars)", "ln(1 + 1000 * n_symbols / word_chars)").replace(
        "log1p(n_dup_lines)", "ln(1 + n_dup_lines)")
    ctes = [
        "d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, "
        "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)",
        "win AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS often FROM d, range(1, len(w) - 1) t(i))",
        "rep AS (SELECT r, count(DISTINCT i + k) AS n FROM win, range(0, 3) t(k) WHERE often > 1 GROUP BY r)",
        "lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS l FROM d)",
        "stats AS (SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, "
        "len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, "
        "coalesce(n, 0)::BIGINT AS n_repeat_words FROM d JOIN lines USING (r) LEFT JOIN rep USING (r))",
        f"judged AS MATERIALIZED (SELECT *, n_words < {outliers.BASE_WORDS} OR 100 * n_repeat_words > {outliers.BASE_REPEAT_PERCENT} * n_words AS base_failed FROM stats)",
        f"grouped AS (SELECT *, count(*) OVER (PARTITION BY lang, source) AS size, {features} FROM judged WHERE NOT base_failed)",
        f"x AS MATERIALIZED (SELECT *, CASE WHEN size >= {outliers.LEAST_ROWS} THEN coalesce(lang, chr(1)) || chr(0) || coalesce(source, chr(1)) "
        "ELSE '' END AS g, row_number() OVER (PARTITION BY lang, source ORDER BY r) % 2 AS half FROM grouped)",
        *shape("e0", f"SELECT g, start, {sums} FROM x, range(3) t(start) WHERE start = 2 OR half = start GROUP BY g, start", "g, start", 1.0)]
    for k in range(outliers.STEPS):
        ctes += distance(f"d{k}", f"(SELECT x.*, e.* EXCLUDE (g) FROM x JOIN e{k} e ON e.g = x.g)")
        ctes.append(f"n{k} AS (SELECT *, row_number() OVER (PARTITION BY g, start ORDER BY d2, r) AS near, count(*) OVER (PARTITION BY g, start) AS rows FROM d{k})")
        ctes += shape(f"e{k + 1}", f"SELECT g, start, {sums} FROM n{k} WHERE near <= ceil(rows * {outliers.ALPHA}) GROUP BY g, start", "g, start",
                      outliers.consistency(outliers.ALPHA, p))
    ctes.append(f"best AS (SELECT * EXCLUDE (start, logdet) FROM e{outliers.STEPS} QUALIFY row_number() OVER (PARTITION BY g ORDER BY logdet, start) = 1)")
    ctes += distance("db", "(SELECT x.*, e.* EXCLUDE (g) FROM x JOIN best e ON e.g = x.g)")
    ctes += shape("final", f"SELECT g, {sums} FROM db WHERE d2 <= {outliers.chi2_quantile(outliers.NEAR, p)!r} GROUP BY g", "g",
                  outliers.consistency(outliers.NEAR, p))
    ctes += distance("df", "(SELECT x.*, e.* EXCLUDE (g), count(*) OVER (PARTITION BY x.g) AS rows FROM x JOIN final e ON e.g = x.g)")
    return f"""WITH {', '.join(ctes)}
SELECT j.doc_id, {', '.join('j.' + c for c in outliers.STATS)}, j.base_failed,
  NOT j.base_failed AND coalesce(df.rows < {outliers.LEAST_ROWS} OR df.d2 <= {outliers.chi2_quantile(outliers.CUT, p)!r}, true) AS kept
FROM judged j LEFT JOIN df ON df.r = j.r"""
