"""DuckDB SQL for the queries that SQL can express."""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACE = r"[^\x20\x09-\x0D]+"


def _words(text: str, pattern: str = _SPACE) -> str:
    return f"regexp_extract_all({text}, '{pattern}')"


def _quality() -> str:
    ratios = {"word_length": ("word_chars", "n_words", 500_000), "symbols": ("n_symbols", "n_words", 20_000),
              "dup_lines": ("n_dup_lines", "n_lines", 200_000), "repeats": ("n_repeat_words", "n_words", 120_000)}
    cell = "((v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0))"
    stacked = " UNION ALL ".join(f"SELECT rid, lang, source, base_failed, '{k}' AS ratio, {f} AS floor_, CASE WHEN {d} > 0 THEN {n} * 1000000 // {d} ELSE 0 END AS v FROM base"
                                 for k, (n, d, f) in ratios.items())
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, lang, source FROM documents),
w AS (SELECT *, {_words('text')} AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM docs),
tri AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
rep AS (SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM tri) WHERE k > 1) GROUP BY rid),
base AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM (
  SELECT rid, doc_id, lang, source, len(words)::BIGINT AS n_words, list_sum(list_transform(words, lambda x: length(x)))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (rid))),
ratios AS (SELECT rid, lang, source, base_failed, ratio, floor_, {cell} AS low FROM ({stacked})),
sk AS (SELECT lang, source, ratio, floor_, low, count(*)::BIGINT AS n FROM ratios WHERE NOT base_failed GROUP BY ALL),
lg AS (SELECT *, sum(n) OVER (PARTITION BY lang, ratio ORDER BY low)::BIGINT AS upto, sum(n) OVER (PARTITION BY lang, ratio)::BIGINT AS t
  FROM (SELECT lang, ratio, low, sum(n)::BIGINT AS n FROM sk GROUP BY ALL)),
pr AS (SELECT lang, ratio, low, 3 * ((64 * upto + t) // (2 * t) - (64 * (upto - n) + t) // (2 * t)) AS n FROM lg),
grp AS (SELECT DISTINCT lang, source, ratio, floor_ FROM sk),
al AS (SELECT lang, source, ratio, floor_, low, sum(n)::BIGINT AS n FROM (SELECT * FROM sk UNION ALL
  SELECT g.lang, g.source, g.ratio, g.floor_, p.low, p.n FROM grp g JOIN pr p ON g.lang IS NOT DISTINCT FROM p.lang AND g.ratio = p.ratio WHERE p.n > 0) GROUP BY ALL),
cu AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, ratio ORDER BY low) AS upto, sum(n) OVER (PARTITION BY lang, source, ratio) AS t FROM al),
q AS (SELECT lang, source, ratio, floor_, min(low) FILTER (WHERE 4 * upto >= t) AS q1, min(low) FILTER (WHERE 4 * upto >= 3 * t) AS lo3 FROM cu GROUP BY ALL),
f AS (SELECT lang, source, ratio, floor_, q1, lo3 + (1::BIGINT << greatest(length(bin(lo3)) - 7, 0)) - 1 AS q3 FROM q),
bad AS (SELECT r.rid, count(*) AS n FROM ratios r JOIN f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source AND r.ratio = f.ratio
  WHERE low > q3 + 3 * greatest(q3 - q1, f.floor_) OR (r.ratio = 'word_length' AND low < q1 - 3 * greatest(q3 - q1, f.floor_)) GROUP BY ALL)
SELECT doc_id, n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND bad.n IS NULL) AS kept
FROM base LEFT JOIN bad USING (rid)"""


_URLS = r"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(url, '') AS url, html FROM pages),
h AS (SELECT page_id, url, html, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM p),
links AS (SELECT url AS source, unnest(regexp_extract_all(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script\s*>', ' ', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM p),
tg AS (SELECT source, CASE WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?\s*canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
  WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b') THEN regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?[^"''>]*?\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) END AS link FROM links),
rs AS (SELECT source, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN link LIKE '//%' THEN regexp_extract(source, '(?s)^(.*?)://', 1) || ':' || link
  WHEN link LIKE '/%' THEN regexp_extract(source, '(?s)^(.*?://[^/?#]*)', 1) || link
  ELSE CASE WHEN regexp_extract(source, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1) = regexp_extract(source, '(?s)^(.*?://[^/?#]*)', 1) THEN regexp_extract(source, '(?s)^(.*?://[^/?#]*)', 1) || '/'
       ELSE regexp_extract(source, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1) END || link END AS target FROM tg WHERE link IS NOT NULL AND link <> ''),
ends AS (SELECT DISTINCT url FROM (SELECT url FROM p UNION ALL SELECT source FROM rs UNION ALL SELECT target FROM rs)),
pl AS (SELECT url, host, path, CASE WHEN instr(url, '://') > 0 THEN host || regexp_replace(path, '/+$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS node FROM (
  SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*\??([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid)='))), '&') AS query
  FROM ends)),
rules(rh, rp, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
own AS (SELECT url, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict FROM pl JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY url),
e AS (SELECT DISTINCT a.node AS u, b.node AS v FROM rs JOIN pl a ON a.url = source JOIN pl b ON b.url = target WHERE a.node <> b.node),
e2 AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach(a, b) AS (SELECT DISTINCT node, node FROM pl WHERE node IS NOT NULL UNION SELECT a, v FROM reach JOIN e2 ON b = u),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
passed AS (SELECT component, min(verdict) AS v FROM pl JOIN own USING (url) JOIN comp USING (node) GROUP BY component)
SELECT h.page_id, h.host, h.path, own.rule AS rule, coalesce(own.verdict, passed.v, 'allow') AS verdict
FROM h JOIN pl USING (url) LEFT JOIN own USING (url) LEFT JOIN comp USING (node) LEFT JOIN passed USING (component)"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DECONTAM = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words(f"translate(coalesce(text, ''), {_AZ})", _ALNUM)} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_words(f"translate(coalesce(text, ''), {_AZ})", _ALNUM)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
gr AS (SELECT rid, k, s, array_to_string(w[s : s + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT DISTINCT rid, s, win.k, item_id FROM gr JOIN win ON gr.g = win.g AND gr.k = win.k),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT rid, s, k FROM hit)) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, (cov.n IS NOT NULL) AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)"""

_MIX = f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key, len({_words("coalesce(text, '')")})::BIGINT AS size,
  md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS o FROM documents),
s AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INTEGER] AS weight FROM (SELECT key, sum(size)::BIGINT AS source_size FROM d GROUP BY key)),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (SELECT sum(size) FROM d)::DOUBLE AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER (ORDER BY cap / weight, key) AS rn FROM c),
lv AS (SELECT arg_min(level, rn) FILTER (WHERE level * weight <= cap) AS level FROM l),
t AS (SELECT key, source_size, least(cap, weight * coalesce(lv.level, 0)) AS target FROM c, lv),
m AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY key ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS mid FROM d),
k AS (SELECT key, weight * (1 + tilt) AS w0, weight * (1 - tilt) AS w1 FROM (SELECT key, weight, CASE WHEN row_number() OVER (ORDER BY key) % 2 = 1 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS tilt FROM s)),
f AS (SELECT m.*, source_size, target, w0, w1, 2 * ((w0 + w1) / 2) AS a2 FROM m JOIN t USING (key) JOIN k USING (key))
SELECT doc_id, size, source_size, target, (size * ((mid < target)::BIGINT + (mid + source_size < target)::BIGINT))::BIGINT AS taken,
  CASE WHEN mid < target THEN round(least(mid / target * a2 / (w0 + sqrt(w0 * w0 + (w1 - w0) * a2 * mid / target)), 1), 9) END AS first_position,
  CASE WHEN mid + source_size < target THEN round(least((mid + source_size) / target * a2 / (w0 + sqrt(w0 * w0 + (w1 - w0) * a2 * (mid + source_size) / target)), 1), 9) END AS second_position FROM f"""

_LINES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ}) AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INTEGER) >= 3),
f AS (SELECT k.rid, k.doc_id, k.line, k.pos, (g.key IS NOT NULL AND k.doc_id IS DISTINCT FROM g.keeper) AS gone FROM k LEFT JOIN g USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM f GROUP BY rid"""

_JACCARD = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_words(f"translate(coalesce(text, ''), {_AZ})")} AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*)::BIGINT AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
reach(a, b) AS (SELECT rid, rid FROM d UNION SELECT a, y FROM reach JOIN e ON b = x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (rid) JOIN (SELECT a AS rid, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.rid = b GROUP BY a) c USING (rid)"""

_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_FIM = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, {_words('text', _UNIT)} AS w, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT for i in range(4)] AS r FROM d),
c AS (SELECT *, len(w) AS n, least(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS a, greatest(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""

_NEAREST = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM p QUALIFY rank <= 20"""

_AUDIT = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  {_words(f"translate(coalesce(text, ''), {_AZ})", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")} AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
l AS (SELECT lang, sum(n)::HUGEINT AS lang_n, count(*)::HUGEINT AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT s.lang, s.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN c USING (lang, source) GROUP BY ALL),
e AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (l.lang_n + l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM e a JOIN e b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM e WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 200"""

ORACLES = {"op1_quality_rules": _quality(), "op2_url_filters": _URLS, "op4_decontamination": _DECONTAM, "op5_mix_sources": _MIX, "op7_jaccard_join": _JACCARD, "op10_line_dedup": _LINES, "op11_fill_in_middle": _FIM,
           "op12_nearest_neighbours": _NEAREST, "op13_divergence_audit": _AUDIT}
