"""DuckDB statements of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from .url_filter import ALPHABET, LOWER, RULES, SIGNS, UPPER

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quality_base() -> str:
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, key) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
       coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(w) < 10 OR 100 * coalesce(covered.n, 0) > 20 * len(w) AS base_failed
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)"""


def _mixing_targets() -> str:
    return f"""
WITH d AS (SELECT source, len({_WORDS}) AS size FROM documents),
s AS (SELECT source, count(*) AS n, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM d GROUP BY source),
caps AS (SELECT *, 2.0 * source_size::DOUBLE AS cap, 1.5 * sum(source_size) OVER () AS total FROM s),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER before, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level FROM caps
           WINDOW before AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT arg_min(level, cap / weight) AS level FROM levels WHERE cap > level * weight)
SELECT source, n::BIGINT AS n, source_size, CASE WHEN cap <= levels.level * weight THEN cap ELSE least(cap, weight * (SELECT level FROM final)) END AS target,
       true AS is_near, true AS is_bounded FROM levels"""


MEDIA_SIZES = "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, (576 * greatest(1, ceil(strlen(coalesce(text, '')) / 576)))::BIGINT AS payload_bytes FROM documents"

_NGRAM_JOIN = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS tokens FROM words),
keyed AS (SELECT doc_id, tokens, CASE WHEN len(tokens) = 0 THEN 'alone ' || doc_id ELSE md5(array_to_string(list_sort(tokens), chr(10))) END AS node FROM sets),
nodes AS (SELECT node, min(doc_id) AS copy_of, arg_min(tokens, doc_id) AS tokens, len(arg_min(tokens, doc_id)) AS n FROM keyed GROUP BY node),
each AS (SELECT copy_of AS id, n, unnest(tokens) AS token FROM nodes),
met AS (SELECT x.id AS a, y.id AS b, any_value(x.n) + any_value(y.n) AS n_both, count(*) AS common FROM each x JOIN each y ON x.token = y.token AND x.id <> y.id GROUP BY x.id, y.id),
links AS (SELECT a, b FROM met WHERE common >= 0.8 * (n_both - common) - 1e-9),
reached(id, other) AS (SELECT copy_of, copy_of FROM nodes UNION SELECT r.id, l.b FROM reached r JOIN links l ON r.other = l.a),
classes AS (SELECT id, min(other) AS class_id FROM reached GROUP BY id),
counts AS (SELECT a AS id, count(*) AS n_links FROM links GROUP BY a)
SELECT k.doc_id, c.class_id, nodes.copy_of, coalesce(counts.n_links, 0)::BIGINT AS n_links
FROM keyed k JOIN nodes USING (node) JOIN classes c ON c.id = nodes.copy_of LEFT JOIN counts ON counts.id = nodes.copy_of"""


def _url_filter() -> str:
    """The whole of op7, models included."""
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    longest = sorted(RULES, key=lambda r: (len(r.text), r.text), reverse=True)
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{getattr(r, value)}'" for r in longest) + " END"
    smooth = lambda k: f"(k{k} + t0_{k} / {SIGNS} + 1.0::DOUBLE / {SIGNS}) / (s0_{k} + t0_{k} + 1.0::DOUBLE)"
    mid = lambda k: f"CASE WHEN s1_1 + s1_0 >= 4 THEN (m{k} + t1_{k} * low{k} + low{k}) / (s1_{k} + t1_{k} + 1.0::DOUBLE) ELSE low{k} END"
    high = lambda k: f"CASE WHEN s2_1 + s2_0 >= 4 THEN (n{k} + t2_{k} * mid{k} + mid{k}) / (s2_{k} + t2_{k} + 1.0::DOUBLE) ELSE mid{k} END"
    totals = lambda n, c: ", ".join(f"sum({c}{k})::BIGINT AS s{n}_{k}, count_if({c}{k} > 0) AS t{n}_{k}" for k in (1, 0))
    return rf"""
WITH hosts AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                      regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
ruled AS (SELECT *, {case("text")} AS rule, {case("verdict")} AS by_rule FROM hosts),
signs AS (SELECT url, translate(url, '{UPPER}', '{LOWER}') AS low FROM (SELECT DISTINCT coalesce(url, '') AS url FROM pages)),
numbers AS (SELECT url, [0, 0] || [CASE WHEN instr('{ALPHABET}', substring(low, i, 1)) > 0 THEN instr('{ALPHABET}', substring(low, i, 1)) ELSE {SIGNS - 1} END FOR i IN range(1, length(low) + 1)] AS x FROM signs),
triples AS (SELECT url, x[i] AS a, x[i + 1] AS b, x[i + 2] AS c FROM (SELECT url, x, unnest(range(1, len(x) - 1)) AS i FROM numbers)),
known AS (SELECT url, by_rule = 'allow' AS accepted, count(*) AS n_rows FROM ruled WHERE by_rule IS NOT NULL AND url IS NOT NULL GROUP BY 1, 2),
counted AS (SELECT a, b, c, sum(n_rows) FILTER (accepted) AS n1, sum(n_rows) FILTER (NOT accepted) AS n0 FROM triples JOIN known USING (url) GROUP BY a, b, c),
grid AS (SELECT x.i AS a, y.i AS b, z.i AS c FROM range({SIGNS}) x(i), range({SIGNS}) y(i), range({SIGNS}) z(i)),
seen AS (SELECT a, b, c, coalesce(n1, 0)::BIGINT AS n1, coalesce(n0, 0)::BIGINT AS n0 FROM grid LEFT JOIN counted USING (a, b, c)),
one AS (SELECT b, c, sum(n1)::BIGINT AS m1, sum(n0)::BIGINT AS m0 FROM seen GROUP BY b, c),
zero AS (SELECT c, sum(n1)::BIGINT AS k1, sum(n0)::BIGINT AS k0 FROM seen GROUP BY c),
two_all AS (SELECT a, b, {totals(2, "n")} FROM seen GROUP BY a, b), one_all AS (SELECT b, {totals(1, "m")} FROM one GROUP BY b), zero_all AS (SELECT {totals(0, "k")} FROM zero),
lows AS (SELECT *, {smooth(1)} AS low1, {smooth(0)} AS low0 FROM seen JOIN one USING (b, c) JOIN zero USING (c) JOIN two_all USING (a, b) JOIN one_all USING (b), zero_all),
mids AS (SELECT *, {mid(1)} AS mid1, {mid(0)} AS mid0 FROM lows),
ratios AS (SELECT a, b, c, round((ln({high(1)}) - ln({high(0)})) * 1e9)::BIGINT AS d FROM mids),
sums AS (SELECT url, sum(d) AS total, count(*) AS size FROM triples JOIN ratios USING (a, b, c) GROUP BY url),
scored AS (SELECT url, round(coalesce(total / size / 1e9, 0.0), 9) AS difference FROM signs LEFT JOIN sums USING (url)),
points AS (SELECT difference AS d, coalesce(sum(n_rows) FILTER (accepted), 0) AS good, coalesce(sum(n_rows) FILTER (NOT accepted), 0) AS bad FROM known JOIN scored USING (url) GROUP BY difference),
worths AS (SELECT d, round(coalesce(sum(bad) OVER before, 0) / sum(bad) OVER () - coalesce(sum(good) OVER before, 0) / sum(good) OVER (), 9) AS worth FROM points
           WINDOW before AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT d, worth FROM worths ORDER BY worth DESC, d LIMIT 1)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN difference >= (SELECT CASE WHEN worth > 0 THEN d ELSE '-inf'::DOUBLE END FROM best) THEN 'allow' ELSE 'block' END) AS verdict, difference
FROM ruled JOIN scored ON scored.url = coalesce(ruled.url, '')"""


_LINE_DEDUP = f"""
WITH lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS keeper FROM (SELECT DISTINCT key, doc_id FROM keyed WHERE length(key) >= 20) GROUP BY key HAVING count(*) >= 3),
judged AS (SELECT doc_id, line, i, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id"""


def _vector_codes() -> str:
    """The whole of op13: each round compares all parts with all entries."""
    nearest = lambda r: f"""
a{r} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (
  SELECT vec_id, p.part, x, entry, list_sum([(t[1] - t[2]) * (t[1] - t[2]) FOR t IN list_zip(x, c)])::BIGINT AS d FROM p JOIN c{r} USING (part)) GROUP BY vec_id, part)"""  # noqa: E731
    moved = lambda r: f"""
m{r} AS (SELECT part, entry, list(mean ORDER BY i) AS mean FROM (
  SELECT part, entry, i, floor(sum(v)::DOUBLE / count(*))::BIGINT AS mean FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY part, entry, i) GROUP BY part, entry),
c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(mean, c) AS c FROM c{r} LEFT JOIN m{r} USING (part, entry))"""  # noqa: E731
    rounds = ",".join(f"{nearest(r)},{moved(r)}" for r in range(4))
    return f"""
WITH v AS (SELECT vec_id, label, [floor(1024 * y::DOUBLE)::BIGINT FOR y IN embedding] AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, x[part * (len(x) // 4) + 1 : (part + 1) * (len(x) // 4)] AS x FROM v, range(4) AS t(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 256),
{rounds},{nearest(4)},
codes AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(n::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(c) AS n, generate_subscripts(c, 1) AS i FROM c4))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN v USING (vec_id), books"""


ORACLES = {
    "op11_line_dedup": _LINE_DEDUP,
    "op13_vector_codes": _vector_codes(),
    "op6_ngram_join": _NGRAM_JOIN,
    "op7_url_filter": _url_filter(),
    "quality_base": _quality_base(),
    "mixing_targets": _mixing_targets(),
    "media_sizes": MEDIA_SIZES,
}
