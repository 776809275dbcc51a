"""DuckDB SQL that gives the same rows as the queries, by plain and exact means."""

from quillframe.llm import license_scan, url_trust

FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1(rules: list[tuple[str, str]] = RULES) -> str:
    """Rules, and the propagation as a sum of walks of each length."""
    fit = [(v, r, *r.partition("/")[::2]) for v, r in sorted(rules, key=lambda x: -len(x[1]))]
    case = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN {i}" for i, (_, _, h, p) in enumerate(fit)) + " END"
    link = url_trust.LINK.replace("'", "''")
    return rf"""
WITH RECURSIVE u AS (SELECT page_id, html, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {FOLD}) AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
p AS (SELECT *, {case} AS r FROM h),
q AS (SELECT *, ([{", ".join(f"'{r}'" for _, r, _, _ in fit)}])[r + 1] AS rule, ([{", ".join(f"'{v}'" for v, _, _, _ in fit)}])[r + 1] AS verdict FROM p),
seeds AS (SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS t, avg(CASE WHEN verdict = 'block' THEN 1.0 ELSE 0.0 END) AS b FROM q WHERE host <> '' GROUP BY host),
l AS (SELECT host AS source, translate(unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '{link}', 1))), {FOLD}) AS target FROM h),
e AS (SELECT source, target, count(*) AS w FROM l WHERE source <> '' AND target <> '' AND source <> target GROUP BY ALL),
k AS (SELECT 't' AS kind, source AS host, target AS dest, w FROM e UNION ALL SELECT 'b', target, source, w FROM e),
flow AS MATERIALIZED (SELECT kind, host, dest, {url_trust.DAMPING} * w / sum(w) OVER (PARTITION BY kind, host) AS share FROM k),
walk(step, kind, host, mass) AS (SELECT 0, kind, host, start::DOUBLE FROM (SELECT 't' AS kind, host, t AS start FROM seeds UNION ALL SELECT 'b', host, b FROM seeds) WHERE start > 0
  UNION ALL SELECT step + 1, walk.kind, dest, sum(mass * share) FROM walk JOIN flow ON walk.kind = flow.kind AND walk.host = flow.host WHERE step < {url_trust.steps_to()} GROUP BY step, walk.kind, dest),
last AS (SELECT kind, host, sum(mass) AS mass FROM walk GROUP BY kind, host),
tot AS (SELECT kind, sum(mass) AS total FROM last GROUP BY kind),
sc AS (SELECT host, sum(CASE WHEN kind = 't' THEN mass / total ELSE 0 END) AS trust, sum(CASE WHEN kind = 'b' THEN mass / total ELSE 0 END) AS distrust FROM last JOIN tot USING (kind) GROUP BY host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN round(distrust / (trust + distrust), {url_trust.DECIMALS}) > {url_trust.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN sc USING (host)
"""


def op2() -> str:
    """Every template word is matched wherever it stands, without an index; places are counted together."""
    rows = []
    for i, t in enumerate(license_scan.TEMPLATES):
        words, phrase = t.text.split(), t.phrase.split()
        at = next(k for k in range(len(words)) if words[k : k + len(phrase)] == phrase)
        rows += [f"({i}, '{t.label}', {t.base}, {j}, '{w}', {int(at <= j < at + len(phrase))}, {len(phrase)}, {len(words)})" for j, w in enumerate(words)]
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {FOLD}), '{license_scan.WORD}') AS w FROM documents),
t(tid, label, base, j, word, must, n_must, n) AS (VALUES {", ".join(rows)}),
v AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
m AS (SELECT doc_id, tid, label, base, pos - j AS start, n, n_must, count(*) AS c, sum(must) AS cm FROM v JOIN t USING (word) GROUP BY ALL),
f AS (SELECT *, c / n::DOUBLE AS share FROM m WHERE cm = n_must AND c / n::DOUBLE >= {license_scan.KEEP}),
a AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM f GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN a USING (doc_id)
"""


#: doc_id and the base columns of op3, by patterns alone.
OP3_BASE = r"""
WITH p(k, kind, pattern, grp, least) AS (VALUES (0, 'assign', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 18), (2, 'hex', '[0-9a-f]+', 0, 16)),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT rid, 0 AS k, regexp_extract_all(t, (SELECT pattern FROM p WHERE k = 0)) AS hit, regexp_extract_all(t, (SELECT pattern FROM p WHERE k = 0), 2) AS g, regexp_split_to_array(t, (SELECT pattern FROM p WHERE k = 0)) AS gap FROM d
  UNION ALL SELECT rid, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_split_to_array(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT rid, 2, regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_split_to_array(t, '[0-9a-f]+') FROM d),
e AS (SELECT rid, k, unnest(hit) AS hit, unnest(g) AS g, unnest(gap[:len(hit)]) AS gap, unnest(range(len(hit))) AS i FROM m),
s AS (SELECT rid, k, g, length(hit) AS n, sum(length(hit) + length(gap)) OVER (PARTITION BY rid, k ORDER BY i) AS stop FROM e),
f AS (SELECT s.rid, k, kind, stop - n AS start, stop FROM s JOIN p USING (k) WHERE length(g) >= least),
a AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, k) AS told FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(told, '')) AS base_sha256 FROM d LEFT JOIN a USING (rid)
"""

OP8 = r"""
WITH RECURSIVE
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT rid, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM d),
n AS (SELECT rid, doc_id, len(g)::BIGINT AS n FROM s),
e AS (SELECT rid, hash(unnest(g)) AS h FROM s),
common AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM e x JOIN e y ON x.h = y.h AND x.rid < y.rid GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT x.rid, y.rid FROM n x JOIN n y ON x.doc_id = y.doc_id AND x.rid <> y.rid),
reach(rid, r) AS (SELECT rid, rid FROM n UNION SELECT reach.rid, edges.b FROM reach JOIN edges ON reach.r = edges.a),
comp AS (SELECT reach.rid, min(doc_id)::BIGINT AS component_id FROM reach JOIN n ON n.rid = r GROUP BY reach.rid)
SELECT n.doc_id, n.n AS n_shingles, component_id, CASE WHEN n.doc_id IS NULL THEN component_id IS NULL ELSE n.doc_id = component_id END AS kept FROM n JOIN comp USING (rid)
"""

OP9 = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT * FROM v WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(c.v, q.v) AS score FROM s q JOIN s c ON q.vec_id % 20 = 0 AND c.rid <> q.rid AND len(c.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Each row's place of removal in each order, counted by step.
OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
lab AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
      regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS bad FROM w LEFT JOIN lab ON w.doc_id = lab.doc_id),
g AS (SELECT part, bad, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT a || b || c || d || e AS filter_order FROM unnest(['A', 'B', 'C', 'D', 'E']) x(a), unnest(['A', 'B', 'C', 'D', 'E']) y(b), unnest(['A', 'B', 'C', 'D', 'E']) z(c), unnest(['A', 'B', 'C', 'D', 'E']) u(d), unnest(['A', 'B', 'C', 'D', 'E']) v(e)
      WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS letter FROM o, range(1, 6) r(step)),
m AS (SELECT g.*, filter_order, coalesce(list_min(list_transform(list_filter(range(1, 6), lambda i: bad[i]), lambda i: instr(filter_order, 'ABCDE'[i]))), 6) AS falls FROM g, o),
c AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (falls > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (falls = step), 0)::BIGINT AS removed,
      coalesce(sum(n) FILTER (falls < step AND bad[instr('ABCDE', letter)]), 0)::BIGINT AS redundant,
      coalesce(sum(n) FILTER (bad[instr('ABCDE', letter)] AND len(list_filter(bad, lambda x: x)) = 1), 0)::BIGINT AS unique_fails,
      coalesce(sum(good) FILTER (falls = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (falls = step), 0)::BIGINT AS toxic_lost FROM m JOIN s USING (filter_order) GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM c
"""

#: Features are counted by joins; the CRC of each distinct one is worked out byte by byte from a table that SQL makes.
OP12 = rf"""
WITH tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i::BIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda s, x: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END) AS v FROM range(256) r(i))),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
x AS (SELECT rid, 0 AS target, text FROM d UNION ALL SELECT row_number() OVER (), 1, text FROM benchmark),
w AS (SELECT rid, target, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {FOLD}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM x),
f AS MATERIALIZED (SELECT rid, target, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
b AS MATERIALIZED (SELECT f, xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda s, b: xor(s >> 8, tab[(xor(s, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM u, tab),
n AS MATERIALIZED (SELECT rid, target, bucket, count(*) AS n FROM f JOIN b USING (f) GROUP BY ALL),
t AS (SELECT bucket, sum(n) FILTER (target = 0)::DOUBLE AS s, coalesce(sum(n) FILTER (target = 1), 0)::DOUBLE AS t FROM n GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM t) + 10000) / ((s + 1) * ((SELECT sum(t) FROM t) + 10000))))::BIGINT AS gain FROM t WHERE s IS NOT NULL),
m AS (SELECT rid, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM n JOIN g USING (bucket) WHERE target = 0 GROUP BY rid),
z AS (SELECT d.rid, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[:8])::BIGINT AS h FROM d LEFT JOIN m USING (rid)),
c AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, n_features >= 39 AS able FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS rank, count(*) FILTER (able) OVER () AS n FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND rank <= 25 * n // 100 THEN rank END AS rank FROM r
"""
