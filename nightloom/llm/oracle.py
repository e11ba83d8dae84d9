"""DuckDB SQL for the operators whose whole result SQL can express, written apart from their code."""

from __future__ import annotations

from . import jaccard_join, quality_rules, quote_links, secrets

WORD = r"[^\x20\x09-\x0D]+"
_GRID = ", ".join(f"('{rule}', {i}, {c}::DOUBLE)" for rule, (_, _, grid) in quality_rules.RULES.items() for i, c in enumerate(grid))
_RATIOS = ", ".join(f"{a}::DOUBLE / greatest({b}, 1) AS r_{rule}" for rule, (a, b, _) in quality_rules.RULES.items())
_UNPIVOT = " UNION ALL ".join(f"SELECT rk, stratum, '{rule}' AS rule, r_{rule} AS ratio FROM q" for rule in quality_rules.RULES)
_FAMILY = ", ".join(str((i, *member)) for i, member in enumerate(quality_rules.FAMILY))

OP1 = f"""WITH d AS (SELECT row_number() OVER () AS rk, doc_id, CASE WHEN lang IN {quality_rules.STRATA} THEN lang ELSE 'other' END AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS ls FROM d),
win AS (SELECT rk, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rk, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT rk, i FROM (SELECT *, count(*) OVER (PARTITION BY rk, g) AS c FROM win) WHERE c >= 2),
cov AS (SELECT rk, count(DISTINCT p) AS c FROM (SELECT rk, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
s AS (SELECT w.rk, doc_id, stratum, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^!]', '', 'g')) AS n_shouts, len(ls) AS n_lines FROM w LEFT JOIN cov ON cov.rk = w.rk),
q AS (SELECT *, {_RATIOS}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
m AS ({_UNPIVOT}),
good AS (SELECT rk, substring(md5(doc_id::VARCHAR), 32, 1) IN ('0', '4', '8', 'c') AS learns FROM q WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
grid AS (SELECT * FROM (VALUES {_GRID}) g(rule, step, cutoff)), fam AS (SELECT * FROM (VALUES {_FAMILY}) f(f, scale, back)),
ex AS (SELECT rk, stratum, learns, m.rule, step, ratio > cutoff AS over FROM m JOIN good USING (rk) JOIN grid ON grid.rule = m.rule),
learned AS (SELECT stratum, rule, step, count_if(over) AS k, count(*) AS n FROM ex WHERE learns GROUP BY ALL),
cand AS (SELECT stratum, rule, f, coalesce(max(step) FILTER (k * {len(quality_rules.RULES)} <= scale * 0.01 * n + 1e-9), -1) - any_value(back) AS step FROM learned, fam GROUP BY ALL),
held AS (SELECT stratum, count(*) AS n FROM q JOIN good USING (rk) WHERE NOT learns GROUP BY 1),
rej AS (SELECT stratum, f, count(DISTINCT rk) AS k FROM ex JOIN cand USING (stratum, rule, step) WHERE NOT learns AND over GROUP BY 1, 2),
tally AS (SELECT DISTINCT stratum, f, n, coalesce(k, 0) AS k FROM cand JOIN held USING (stratum) LEFT JOIN rej USING (stratum, f)),
tail AS (SELECT stratum, f, CASE WHEN k >= n THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99))) FROM (SELECT unnest(range(k::BIGINT + 1)) AS i)) END AS p FROM tally),
walk AS (SELECT *, max((p > 0.05 / {len(quality_rules.STRATA) + 1})::INTEGER) OVER (PARTITION BY stratum ORDER BY f) AS stopped FROM tail),
last AS (SELECT stratum, max(f) AS f FROM walk WHERE stopped = 0 GROUP BY 1),
best AS (SELECT stratum, rule, cutoff FROM last JOIN cand USING (stratum, f) JOIN grid USING (rule, step)),
hit AS (SELECT rk, string_agg(m.rule, ',' ORDER BY m.rule) AS rules FROM m JOIN best ON best.stratum = m.stratum AND best.rule = m.rule WHERE ratio > cutoff GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rules IS NULL AS kept, coalesce(rules, '') AS failed_rules FROM q LEFT JOIN hit ON hit.rk = q.rk"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_K, _T = jaccard_join.WORDS, jaccard_join.NUM
OP3 = f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS rk, doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS ws FROM documents),
sh AS (SELECT DISTINCT rk, doc_id, array_to_string(ws[i:i + least({_K}, len(ws)) - 1], ' ') AS g FROM (SELECT rk, doc_id, ws, unnest(range(1, greatest(len(ws) - {_K} + 1, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT rk, doc_id, count(*) AS n FROM sh GROUP BY ALL),
meet AS (SELECT a.rk AS a, b.rk AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.rk < b.rk GROUP BY ALL),
link AS (SELECT x.doc_id AS a, y.doc_id AS b FROM meet JOIN n x ON x.rk = a JOIN n y ON y.rk = b WHERE 100 * c >= {_T} * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, b AS met FROM edge UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.met),
low AS (SELECT doc_id, min(met) AS met FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(l.met, w.doc_id)) AS component_id FROM w LEFT JOIN n ON n.rk = w.rk LEFT JOIN low l ON l.doc_id = w.doc_id"""


def _kind(kind: str, rank: int, group: int, keep: str) -> str:
    p = secrets.PATTERNS[kind].replace("'", "''")
    return f"""SELECT rk, doc_id, owner, repo, '{kind}' AS kind, {rank} AS rank, pos AS start, pos + length(x) AS stop, v AS value FROM (
 SELECT rk, doc_id, owner, repo, ms[i] AS x, vs[i] AS v, (list_sum(list_transform(ps[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda z: length(z))), 0))::BIGINT AS pos FROM (
 SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rk, doc_id, owner, repo, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS vs, string_split_regex(t, '{p}') AS ps FROM d))) WHERE {keep}"""


_SPANS = " UNION ALL ".join((
    _kind("assign", 0, 2, "length(v) >= 12"), _kind("access", 1, 0, "true"), _kind("hex", 2, 0, "true"),
    _kind("owned", 3, 0, "regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[0-9]')"),
))
_TOLD = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank){}, '')"
OP5 = f"""WITH d AS (SELECT row_number() OVER () AS rk, doc_id, coalesce(source, '') AS owner, coalesce(source, '') || chr(0) || coalesce(lang, '') AS repo, coalesce(text, '') AS t FROM documents),
sp AS ({_SPANS}), own AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM sp GROUP BY 1), j AS (SELECT sp.*, owners, repos, owners < 3 AND repos < 4 AS live FROM sp JOIN own USING (value)),
r AS (SELECT rk, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex, {_TOLD.format(" FILTER (kind <> 'owned')")} AS base, {_TOLD.format(" FILTER (kind <> 'owned' OR live)")} AS spans,
 count_if(live) AS n_live, count_if(NOT live) AS n_copied, max(owners) AS most_owners, max(repos) AS most_repos FROM j GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
 coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos FROM d LEFT JOIN r ON r.rk = d.rk"""

_MARK, _INTRO = quote_links.MARK, quote_links.INTRO
_OWN = f"""regexp_replace(regexp_replace(array_to_string(list_filter(string_split(t, chr(10)), lambda x, i: NOT regexp_matches(x, '{_MARK}')
 AND NOT (regexp_matches(x, '{_INTRO}') AND coalesce(regexp_matches(string_split(t, chr(10))[i + 1], '{_MARK}'), false))), chr(10)), '^[\\t\\n\\x0B\\f\\r ]+', ''), '[\\t\\n\\x0B\\f\\r ]+$', '')"""
_NORMAL = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_RENDERED = """one AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2),
 back AS (SELECT c.conv_id, c.turn, c.role, c.text, array_to_string(list_transform(string_split(x.text, chr(10)), lambda l: '> ' || l), chr(10)) || chr(10) AS near,
  array_to_string(list_transform(string_split(y.text, chr(10)), lambda l: '> > ' || l), chr(10)) || chr(10) AS far
  FROM conversations c LEFT JOIN one x ON x.conv_id = c.conv_id AND x.turn = c.turn - 1 LEFT JOIN one y ON y.conv_id = c.conv_id AND y.turn = c.turn - 2),
 replies AS (SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN coalesce(near, '') || coalesce(text, '') ELSE coalesce(far, '') || coalesce(near, '') || coalesce(text, '') END AS text FROM back), """
_LINKS = f"""m AS (SELECT row_number() OVER () AS rk, conv_id, turn, role, coalesce(text, '') AS t FROM {{source}}), o AS (SELECT *, {_OWN} AS own FROM m),
l AS (SELECT rk, conv_id, turn, i, string_split(t, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM m WHERE regexp_matches(t, '(?m){_MARK}'))),
v AS (SELECT *, length(regexp_extract(line, '{_MARK}')) - length(replace(regexp_extract(line, '{_MARK}'), '>', '')) AS level, trim(regexp_replace(line, '{_MARK}', '')) AS body FROM l),
x AS (SELECT * FROM (SELECT *, lead(level) OVER (PARTITION BY rk ORDER BY i) AS nx FROM v) WHERE NOT (level < coalesce(nx, 0) AND regexp_matches(body, '{_INTRO}'))),
g AS (SELECT *, sum(nw) OVER (PARTITION BY rk ORDER BY i) AS run, sum((body = '')::INTEGER) OVER (PARTITION BY rk ORDER BY i) AS par FROM (SELECT *, coalesce((level <> lag(level) OVER (PARTITION BY rk ORDER BY i))::INTEGER, 0) AS nw FROM x)),
u AS (SELECT conv_id, turn, level, body, false AS whole FROM g WHERE level > 0 UNION ALL SELECT conv_id, turn, level, string_agg(body, ' ' ORDER BY i), false FROM g WHERE level > 0 GROUP BY rk, run, par, conv_id, turn, level
 UNION ALL SELECT conv_id, turn, level, string_agg(body, ' ' ORDER BY i), true FROM g WHERE level > 0 GROUP BY rk, run, conv_id, turn, level),
qd AS (SELECT conv_id, turn, level, {_NORMAL.format("body")} AS h, bool_or(whole) AS quoted FROM u GROUP BY 1, 2, 3, 4 HAVING length(h) > 0),
wr AS (SELECT conv_id, turn AS frm, {_NORMAL.format("unit")} AS h, bool_or(whole) AS said FROM (SELECT conv_id, turn, own AS unit, true AS whole FROM o UNION ALL SELECT conv_id, turn, unnest(string_split_regex(own, '\\n[ \\t]*\\n')), false FROM o UNION ALL SELECT conv_id, turn, unnest(string_split(own, chr(10))), false FROM o) GROUP BY 1, 2, 3),
mt AS (SELECT conv_id, turn, frm, level, sum(length(h)) AS size FROM qd JOIN wr USING (conv_id, h) WHERE frm < turn AND (length(h) >= {quote_links.LEAST} OR quoted OR said) GROUP BY ALL),
up AS (SELECT conv_id, turn, (arg_min(frm, (level, -size, -frm))) AS parent, count(DISTINCT frm) AS links FROM mt GROUP BY ALL),
th AS (SELECT conv_id, turn, parent AS thread, 1 AS depth FROM up UNION ALL SELECT th.conv_id, th.turn, up.parent, depth + 1 FROM th JOIN up ON up.conv_id = th.conv_id AND up.turn = th.thread),
tp AS (SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM th GROUP BY 1, 2)
SELECT o.conv_id, o.turn, role, own AS own_text, parent, coalesce(links, 0) AS links, coalesce(thread, o.turn) AS thread, coalesce(depth, 0) AS depth
FROM o LEFT JOIN up ON up.conv_id = o.conv_id AND up.turn = o.turn LEFT JOIN tp ON tp.conv_id = o.conv_id AND tp.turn = o.turn"""
OP6 = "WITH RECURSIVE " + _LINKS.replace("{source}", "conversations")
RENDERED = "WITH RECURSIVE " + _RENDERED + _LINKS.replace("{source}", "replies")


_KEPT = """kept AS MATERIALIZED (SELECT row_number() OVER () AS rk, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


def _code_round(r: int, last: bool) -> str:
    """Assignment to the entries of round r, and the next entries."""
    d = " + ".join(f"(q.v[{i}] - b.v[{i}]) * (q.v[{i}] - b.v[{i}])" for i in range(1, 5))
    means = ", ".join(f"floor(sum(v[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, 5))
    assign = f"a{r} AS MATERIALIZED (SELECT rk, q.p, min(({d}) * 64 + e) AS de FROM part q JOIN b{r} b ON b.p = q.p GROUP BY ALL)"
    replace = f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM b{r} b LEFT JOIN (SELECT p, de % 64 AS e, [{means}] AS v FROM a{r} JOIN part USING (rk, p) GROUP BY ALL) n ON n.p = b.p AND n.e = b.e)"
    return assign if last else f"{assign},\n{replace}"


OP11 = f"""WITH {_KEPT},
part AS MATERIALIZED (SELECT rk, p, x[4 * p + 1:4 * p + 4] AS v FROM kept, range(16) t(p)),
starts AS (SELECT rk, row_number() OVER (ORDER BY vec_id, x) - 1 AS e FROM kept WHERE vec_id IS NOT NULL ORDER BY vec_id, x LIMIT 64),
b0 AS MATERIALIZED (SELECT p, e, v FROM starts JOIN part USING (rk)),
{", ".join(_code_round(r, r == 2) for r in range(3))},
sha AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM b2),
c AS (SELECT rk, string_agg(printf('%02x', (de % 64)::INTEGER), '' ORDER BY p) AS code, sum(de // 64)::BIGINT AS error FROM a2 GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN c USING (rk), sha"""


def _cluster_round(r: int, last: bool) -> str:
    assign = f"a{r} AS MATERIALIZED (SELECT rk, min(list_sum(list_transform(range(1, 65), lambda i: (q.x[i] - b.x[i]) * (q.x[i] - b.x[i])))::BIGINT * 64 + c) AS dc FROM kept q, b{r} b GROUP BY 1)"
    means = f"(SELECT c, list(m ORDER BY i) AS x FROM (SELECT dc % 64 AS c, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM a{r} JOIN kept USING (rk), range(1, 65) t(i) GROUP BY ALL) GROUP BY c)"
    return assign if last else f"{assign},\nb{r + 1} AS MATERIALIZED (SELECT b.c, coalesce(n.x, b.x) AS x FROM b{r} b LEFT JOIN {means} n ON n.c = b.c)"


OP13 = f"""WITH {_KEPT},
b0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM kept WHERE vec_id IS NOT NULL ORDER BY sha256('2:' || vec_id), x LIMIT 40),
{", ".join(_cluster_round(r, r == 5) for r in range(6))},
own AS (SELECT rk, (dc % 64)::INTEGER AS cluster, dc // 64 AS distance FROM a5)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
 sha256(array_to_string(b.x, ',')) AS centroid_sha256 FROM own JOIN kept USING (rk) JOIN b5 b ON b.c = cluster"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1, "op3_jaccard_join": OP3, "op5_secret_scan": OP5, "op6_quote_links": OP6, "rendered_quote_links": RENDERED, "op11_heap_codes": OP11, "op13_drake_clusters": OP13}
