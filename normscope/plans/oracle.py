"""DuckDB statements that give the registered queries' rows from the same tables."""

from __future__ import annotations

import re

from .. import constants as C

EV = """ev AS (SELECT event_id, user_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  CASE WHEN event_type = 'error' THEN value ELSE 0.0 END AS error_cost FROM events)"""
SPLIT = f"""{EV}, sp AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) <= floor(count(*) OVER () * 0.6::DOUBLE) AS training FROM ev)"""
LI = """li AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0.0 END AS returned_amount FROM lineitem)"""


def _scopes(source: str, dims: tuple[str, ...]) -> str:
    """All rows of ``source`` in every prefix scope."""
    parts = [f"SELECT *, 0 AS depth, '*' AS scope_key FROM {source}"]
    for k in range(1, len(dims) + 1):
        key = " || '|' || ".join(f"'{d}=' || coalesce(CAST({d} AS VARCHAR), '')" for d in sorted(dims[:k]))
        parts.append(f"SELECT *, {k} AS depth, {key} AS scope_key FROM {source}")
    return " UNION ALL ".join(parts)


def _values(source: str, features: tuple[str, ...], keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM {source} WHERE {f} IS NOT NULL" for f in features)


def _stats(values: str, keys: str) -> str:
    """CTEs up to ``st``: robust statistics of v in every group of keys."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    q = "[0.5, 0.05, 0.25, 0.75, 0.95]"
    return f"""vals AS ({values}),
s1 AS (SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE v <> 0) AS nz, quantile_cont(v, {q}) AS qa, quantile_cont(v, {q}) FILTER (WHERE v <> 0) AS qn,
  min(v) AS la, max(v) AS ha, min(v) FILTER (WHERE v <> 0) AS ln_, max(v) FILTER (WHERE v <> 0) AS hn FROM vals GROUP BY {keys}),
s2 AS (SELECT *, (n - nz) / n::DOUBLE AS es, ((n - nz) / n::DOUBLE >= {C.ZERO_INFLATION_SHARE}) AND nz >= 3 AS u FROM s1 WHERE n >= 3),
s3 AS (SELECT {keys}, n, es, u, CASE WHEN u THEN nz ELSE n END AS informative, CASE WHEN u THEN qn ELSE qa END AS q, CASE WHEN u THEN ln_ ELSE la END AS lo, CASE WHEN u THEN hn ELSE ha END AS hi FROM s2),
md AS (SELECT {", ".join("a." + k.strip() for k in keys.split(","))}, quantile_cont(abs(a.v - b.q[1]), 0.5) AS mad FROM vals a JOIN s3 b ON {on} WHERE NOT b.u OR a.v <> 0 GROUP BY ALL),
s4 AS (SELECT a.*, b.mad, greatest(b.mad * {C.MAD_TO_SIGMA}, abs(a.q[1]) * {C.RELATIVE_SIGMA_FLOOR}) AS sg FROM s3 a JOIN md b ON {on}),
st AS (SELECT {keys}, n AS "count", round(es, 4) AS zero_share, informative, round(q[1], 6) AS median, round(mad, 6) AS mad, round(CASE WHEN sg > 0 THEN sg ELSE (hi - lo) / 4 END, 6) AS sigma,
  round(q[2], 6) AS p05, round(q[3], 6) AS p25, round(q[4], 6) AS p75, round(q[5], 6) AS p95, round(lo, 6) AS "min", round(hi, 6) AS "max", es >= {C.ZERO_INFLATION_SHARE} AS zero_inflated FROM s4)"""


def _rollup(head: str, source: str, dims: tuple[str, ...], features: tuple[str, ...]) -> str:
    keys = "scope_key, depth, feature"
    return f"WITH {head}, sc AS ({_scopes(source, dims)}), {_stats(_values('sc', features, 'scope_key, depth'), keys)}"


EVENT_FEATURES, LINE_FEATURES = ("value", "k", "error_cost"), ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "returned_amount")
TRAIN = f"{SPLIT}, tr AS (SELECT * EXCLUDE (training) FROM sp WHERE training)"

RESOLVED = f"""{_rollup(TRAIN, 'tr', ('event_type',), EVENT_FEATURES)},
ok AS (SELECT scope_key FROM sc WHERE depth = 1 GROUP BY scope_key HAVING count(*) >= {C.MIN_SCOPE_SAMPLES}),
rs AS (SELECT e.*, CASE WHEN o.scope_key IS NOT NULL THEN o.scope_key ELSE '*' END AS baseline_scope FROM sp e LEFT JOIN ok o ON o.scope_key = 'event_type=' || coalesce(e.event_type, '') WHERE NOT training),
rv AS ({" UNION ALL ".join(f"SELECT event_id, baseline_scope, '{f}' AS feature, {f} AS v FROM rs" for f in EVENT_FEATURES)}),
rz AS (SELECT r.*, s.median - 3 * s.sigma AS lo, s.median + 3 * s.sigma AS hi, s.median IS NOT NULL AS known,
  CASE WHEN r.v IS NULL OR s.median IS NULL THEN NULL WHEN s.sigma <= 0 OR (s.zero_inflated AND (r.v = 0 OR s.informative < {C.MIN_INFORMATIVE})) THEN 0.0 ELSE (r.v - s.median) / s.sigma END AS z
  FROM rv r LEFT JOIN st s ON s.scope_key = r.baseline_scope AND s.feature = r.feature),
rd AS (SELECT *, abs(z) / (abs(z) + {C.ROBUST_KNEE}) AS d FROM rz)"""

ORDINAL = f"{EV}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM ev)"
FRAME = "OVER (PARTITION BY user_id, event_type ORDER BY rn RANGE BETWEEN 400 PRECEDING AND 1 PRECEDING)"


def _rolling() -> str:
    cols, unions = [], []
    for i, f in enumerate(EVENT_FEATURES):
        cols.append(f"""count({f}) {FRAME} AS n{i}, count(nullif({f}, 0)) {FRAME} AS nz{i}, quantile_cont({f}, 0.9) {FRAME} AS u{i}, quantile_cont({f}, 0.5) {FRAME} AS m{i},
  quantile_cont(nullif({f}, 0), 0.9) {FRAME} AS un{i}, quantile_cont(nullif({f}, 0), 0.5) {FRAME} AS mn{i}""")
        inflated = f"(n{i} - nz{i}) / n{i}::DOUBLE >= {C.ZERO_INFLATION_SHARE}"
        unions.append(f"""SELECT event_id, {f} AS v, CASE WHEN {inflated} THEN un{i} ELSE u{i} END AS up, CASE WHEN {inflated} THEN mn{i} ELSE m{i} END AS med,
  n{i} >= 12 AND (NOT ({inflated}) OR ({f} <> 0 AND nz{i} >= 12)) AS usable FROM w""")
    return f"""WITH {ORDINAL}, w AS (SELECT *, count(*) {FRAME} AS hn, {", ".join(cols)} FROM o), p AS ({" UNION ALL ".join(unions)}),
x AS (SELECT event_id, CASE WHEN usable AND greatest(up - med, abs(med) * {C.ROLLING_SPREAD_FLOOR}) > 0 THEN (v - up) / greatest(up - med, abs(med) * {C.ROLLING_SPREAD_FLOOR}) END AS r FROM p),
y AS (SELECT event_id, max(CASE WHEN r > 0 THEN r / (r + 2.0) END) AS s, count(*) FILTER (WHERE r > 0 AND r / (r + 2.0) >= {C.ROLLING_REASON}) AS k FROM x GROUP BY event_id)
SELECT w.event_id, w.hn >= 12 AS applicable, CASE WHEN w.hn >= 12 THEN round(coalesce(y.s, 0.0), 5) ELSE 0.0 END AS score, CASE WHEN w.hn >= 12 THEN y.k ELSE 0 END AS n_reasons FROM w JOIN y USING (event_id)"""


def _change() -> str:
    unions = " UNION ALL ".join(f"SELECT event_id, list_append(coalesce(list({f}) FILTER (WHERE {f} IS NOT NULL) {FRAME}, []), {f}) AS s, count({f}) {FRAME} AS n, {f} IS NOT NULL AS here FROM o" for f in EVENT_FEATURES)
    return f"""WITH {ORDINAL}, h AS (SELECT event_id, count(*) {FRAME} AS hn FROM o), q AS ({unions}),
c AS (SELECT event_id, row_number() OVER () AS g, list_transform(s, lambda v: v - list_avg(s)) AS x, list_avg(s) AS mu, len(s) AS n FROM q WHERE n >= 20 AND here),
e AS (SELECT event_id, g, n, i, mu, list_sum(x[1:i]) AS l, list_sum(x[i + 1:n]) AS r, list_sum(list_transform(x, lambda v: v * v)) AS sq FROM c, unnest(range(5, n - 4)) AS t(i)),
e2 AS (SELECT *, sq - l * l / i - r * r / (n - i) AS raw FROM e), e3 AS (SELECT *, CASE WHEN raw <= 1e-9 * sq THEN 0.0 ELSE raw END AS err FROM e2),
b AS (SELECT * FROM e3 QUALIFY row_number() OVER (PARTITION BY g ORDER BY err, i) = 1),
k AS (SELECT event_id, abs(r / (n - i) - l / i) AS gap, sqrt(err / greatest(n - 2, 1)) AS sd FROM b),
z AS (SELECT event_id, CASE WHEN gap <= 1e-12 THEN NULL WHEN sd > 0 THEN (gap / sd) / (gap / sd + 2.0) ELSE 1.0 END AS d FROM k),
m AS (SELECT event_id, max(d) FILTER (WHERE d >= {C.CHANGE_STRENGTH}) AS s, count(*) FILTER (WHERE d >= {C.CHANGE_STRENGTH}) AS k FROM z GROUP BY event_id)
SELECT h.event_id, h.hn >= 20 AS applicable, CASE WHEN h.hn >= 20 THEN round(coalesce(m.s, 0.0), 5) ELSE 0.0 END AS score, CASE WHEN h.hn >= 20 THEN coalesce(m.k, 0) ELSE 0 END AS n_reasons FROM h LEFT JOIN m USING (event_id)"""


def _peers(head: str, source: str, dims: tuple[str, ...], entity: str, means: tuple[str, ...], rates: tuple[str, ...]) -> str:
    """CTEs up to ``pf``: score of every (scope, entity) over all metrics and over rates."""
    aggregates = ", ".join([*(f'avg({f}) AS "mean:{f}"' for f in means), *(f'avg(CAST({f} <> 0 AS DOUBLE)) AS "rate:{f}"' for f in rates)])
    names = [*(f"mean:{f}" for f in means), *(f"rate:{f}" for f in rates)]
    long = " UNION ALL ".join(f"""SELECT scope_key, depth, entity, event_count, '{n}' AS metric, "{n}" AS value FROM pw WHERE "{n}" IS NOT NULL""" for n in names)
    return f"""{head}, psc AS ({_scopes(source, dims)}),
pw AS (SELECT scope_key, depth, {entity} AS entity, count(*) AS event_count, {aggregates} FROM psc GROUP BY scope_key, depth, {entity} HAVING count(*) >= {C.PEER_MIN_EVENTS}), pl AS ({long}),
p1 AS (SELECT scope_key, metric, quantile_cont(value, 0.5) AS median, count(*) AS peers, max(value) - min(value) AS spread FROM pl GROUP BY scope_key, metric HAVING count(*) >= {C.PEER_MIN_ENTITIES}),
p2 AS (SELECT a.scope_key, a.metric, quantile_cont(abs(a.value - b.median), 0.5) * {C.MAD_TO_SIGMA} AS sg FROM pl a JOIN p1 b USING (scope_key, metric) GROUP BY ALL),
ps AS (SELECT p1.scope_key, p1.metric, p1.median, CASE WHEN sg > 0 THEN sg ELSE spread / 4 END AS sigma, peers FROM p1 JOIN p2 USING (scope_key, metric)),
pg AS (SELECT scope_key FROM pl GROUP BY scope_key HAVING count(DISTINCT entity) >= {C.PEER_MIN_ENTITIES}),
pd AS (SELECT l.scope_key, l.entity, l.metric, CASE WHEN s.sigma > 0 AND l.value > s.median THEN ((l.value - s.median) / s.sigma) / ((l.value - s.median) / s.sigma + {C.PEER_KNEE}) END AS d
  FROM pl l JOIN pg USING (scope_key) LEFT JOIN ps s USING (scope_key, metric)),
pf AS (SELECT scope_key, entity, coalesce(max(d), 0.0) AS score, coalesce(max(d) FILTER (WHERE metric LIKE 'rate:%'), 0.0) AS rate_score FROM pd GROUP BY scope_key, entity)"""


LINE_PEERS = _peers(f"WITH {LI}", "li", ("l_returnflag", "l_linestatus"), "l_suppkey", LINE_FEATURES, ("returned_amount",))
EVENT_PEERS = _peers(f"WITH {TRAIN}", "tr", ("event_type",), "user_id", EVENT_FEATURES, ("error_cost",))


def _fused(n: int) -> str:
    """CTEs from ``mr`` (event_id, i, detector, w, applies, s, n_reasons) of n detectors and ``ev`` up to ``en``, fused."""
    return f"""ap AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY s DESC, i) AS place FROM mr WHERE applies),
ag AS (SELECT event_id, count(*) AS n_applicable, count(*) FILTER (WHERE s >= {C.FIRING_SCORE}) AS n_firing, sum(n_reasons) AS n_reasons, max(s) AS peak, sum(w * s) AS ws, sum(w) AS sw,
  max(w) FILTER (WHERE place = 1) AS w1, max(detector) FILTER (WHERE place = 1) AS first_detector FROM ap GROUP BY event_id),
en AS (SELECT event_id, coalesce(n_applicable, 0) AS n_applicable, coalesce(n_firing, 0) AS n_firing, coalesce(n_reasons, 0)::BIGINT AS n_reasons,
  CASE WHEN peak > 0 THEN first_detector END AS strongest, coalesce(ws / nullif(sw, 0), 0.0) AS weighted_mean,
  round(100 * CASE WHEN n_applicable IS NULL THEN 0.0 ELSE least(1.0, peak + (1 - peak) * (CASE WHEN n_applicable >= 2 AND sw - w1 > 1e-12 THEN (ws - w1 * peak) / (sw - w1) ELSE 0.0 END) * {C.AGREEMENT_WEIGHT}) END, 2) AS score,
  CASE WHEN coalesce(n_applicable, 0) = 0 THEN 0.0 ELSE round(least(0.95, 0.35 + 0.35 * n_applicable / {n}.0::DOUBLE + 0.30::DOUBLE * n_firing / n_applicable), 4) END AS confidence FROM ev LEFT JOIN ag USING (event_id))"""


def _made() -> str:
    """CTEs up to ``en``: the made results of the six detectors, fused."""
    weights = [C.DETECTOR_WEIGHTS[d] for d in C.DETECTORS]
    parts = " UNION ALL ".join(
        f"""SELECT event_id, {i} AS i, '{d}' AS detector, {w}::DOUBLE AS w, (event_id + {i}) % {i + 2} <> 0 AS applies,
  CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE ((event_id * {37 + 12 * i} + {11 * i}) % 997) / 997.0::DOUBLE END AS s, '{("value", "k")[i % 2]}' AS feature FROM ev"""
        for i, (d, w) in enumerate(zip(C.DETECTORS, weights, strict=True))
    )
    return f"""{EV}, mr AS (SELECT *, (s >= 0.5)::INT AS n_reasons FROM ({parts})), {_fused(6)},
es AS (SELECT en.*, event_type, user_id, CASE WHEN score >= 85 THEN 'critical' WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS severity FROM en JOIN ev USING (event_id)),
gp AS (SELECT *, CASE WHEN score < 60 OR confidence < 0.5 THEN NULL WHEN event_type = 'error' AND score <= 95 AND coalesce(strongest IN ('peer_group', 'change_point'), false) THEN 'p1'
  WHEN event_type = 'view' AND score <= 80 THEN 'p2' WHEN score <= 90 AND coalesce(strongest = 'isolation_forest', false) THEN 'p3' END AS policy_id FROM es),
gt AS (SELECT *, CASE WHEN score < 60 THEN 'low_score' WHEN confidence < 0.5 THEN 'low_confidence' WHEN policy_id IS NOT NULL THEN 'suppressed' WHEN n_reasons = 0 THEN 'unexplained' ELSE 'candidate' END AS gate FROM gp)"""


MADE = f"WITH {_made()}"
FINGERPRINT = """fr AS (SELECT event_id, list(DISTINCT feature) AS every, list(DISTINCT feature) FILTER (WHERE place = 1) AS own FROM ap WHERE s >= 0.5 GROUP BY event_id)"""

def _joined() -> str:
    """What the detectors that SQL can state say of the events after the split, fused and gated. Their own statements round last; here they don't."""
    whole = lambda sql: re.sub(r"round\((coalesce\([a-z.]+, 0\.0\)), 5\)", r"\1", sql)
    robust = f"{RESOLVED} SELECT event_id, bool_or(known) AS applicable, coalesce(max(d), 0.0) AS score, count(*) FILTER (WHERE d >= {C.ROBUST_REASON}) AS n_reasons FROM rd GROUP BY event_id"
    rarity = f"""WITH {TRAIN}, sc AS ({_scopes("tr", ("event_type",))}), g AS (SELECT scope_key, event_type AS v, count(*) AS n FROM sc WHERE event_type <> '' GROUP BY ALL),
t AS (SELECT scope_key, sum(n) AS c, count(*) AS k FROM g GROUP BY scope_key), ok AS (SELECT scope_key FROM sc WHERE depth = 1 GROUP BY scope_key HAVING count(*) >= {C.MIN_SCOPE_SAMPLES}),
e AS (SELECT event_id, event_type AS v, coalesce(ok.scope_key, '*') AS bs FROM sp LEFT JOIN ok ON ok.scope_key = 'event_type=' || coalesce(event_type, '') WHERE NOT training),
d AS (SELECT event_id, t.c IS NOT NULL AS applicable, CASE WHEN e.v <> '' AND t.c IS NOT NULL THEN greatest(0.0, least(1.0, 1 - (coalesce(g.n, 0) / t.c::DOUBLE * t.c + 1) / (t.c + t.k + 1) * (t.k + 1))) END AS r
  FROM e LEFT JOIN t ON t.scope_key = bs LEFT JOIN g ON g.scope_key = bs AND g.v = e.v)
SELECT event_id, applicable, coalesce(r, 0.0) AS score, (coalesce(r, 0.0) >= {C.RARITY_REASON})::BIGINT AS n_reasons FROM d"""
    peer = f"""{EVENT_PEERS} SELECT event_id, a.entity IS NOT NULL OR b.entity IS NOT NULL AS applicable, coalesce(a.score, b.rate_score, 0.0) AS score,
  (coalesce(a.score, b.rate_score, 0.0) >= {C.PEER_REASON})::BIGINT AS n_reasons FROM sp LEFT JOIN pf a ON a.entity = sp.user_id AND a.scope_key = 'event_type=' || coalesce(event_type, '')
  LEFT JOIN pf b ON b.entity = sp.user_id AND b.scope_key = '*' WHERE NOT training"""
    of = {"robust_deviation": robust, "categorical_rarity": rarity, "rolling_quantile": whole(_rolling()), "change_point": whole(_change()), "peer_group": peer}
    parts = " UNION ALL ".join(
        f"SELECT event_id, {i} AS i, '{d}' AS detector, {C.DETECTOR_WEIGHTS[d]}::DOUBLE AS w, applicable AS applies, score AS s, n_reasons FROM ({sql})" for i, (d, sql) in enumerate(of.items())
    )
    return f"""WITH {SPLIT.replace("ev AS", "e0 AS", 1).replace("FROM ev)", "FROM e0)")}, ev AS (SELECT * EXCLUDE (training) FROM sp WHERE NOT training),
mr AS (SELECT x.* FROM ({parts}) x SEMI JOIN ev USING (event_id)), {_fused(5)}
SELECT event_id, score, strongest, n_applicable, n_firing, confidence, CASE WHEN score < 60 THEN 'low_score' WHEN confidence < 0.5 THEN 'low_confidence' WHEN n_reasons = 0 THEN 'unexplained' ELSE 'candidate' END AS gate FROM en"""


VERDICTS = """vd AS (SELECT doc_id AS id, source AS strongest, 'lang=' || lang AS baseline_scope, CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'duplicate' ELSE 'true_exception' END ELSE 'false_positive' END AS label,
  (n_chars % 100)::DOUBLE AS anomaly_score FROM labels JOIN documents USING (doc_id)),
dq AS (SELECT coalesce(nullif(strongest, ''), 'unknown') AS detector, count(*) AS total, count(*) FILTER (WHERE label = 'true_exception') AS confirmed,
  count(*) FILTER (WHERE label IN ('false_positive', 'expected_behavior')) AS rejected FROM vd GROUP BY 1),
dp AS (SELECT *, CASE WHEN confirmed + rejected > 0 THEN round(confirmed / (confirmed + rejected)::DOUBLE, 4) ELSE 0.0 END AS precision FROM dq)"""

CASES = """oc AS (SELECT o_orderkey AS id, o_orderpriority AS schema_id, o_custkey AS entity_id, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE 'resolved' END AS status,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity, round(o_totalprice, 2) AS anomaly_score FROM orders)"""

BATCH = f"""{EV}, bt AS (SELECT event_id AS idx, CAST(event_id - CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS ext, CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS entity_id,
  event_id % 11 <> 0 AS has_time, (event_id % 7 = 0)::INT + (event_id % 11 = 0)::INT + (event_id % 13 = 0)::INT AS n_problems FROM ev),
gd AS (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY idx) AS place FROM bt WHERE n_problems = 0),
outc AS (SELECT idx, n_problems, 'rejected' AS outcome FROM bt WHERE n_problems > 0 UNION ALL
  SELECT idx, 0, CASE WHEN place = 1 AND ext NOT IN (SELECT CAST(event_id AS VARCHAR) FROM ev WHERE event_id % 17 = 0) THEN 'accepted' ELSE 'duplicate' END FROM gd)"""

NUMBER = r"^[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?$"

ORACLES = {
    "detector_gates": _joined(),
    "temporal_split": f"WITH {SPLIT} SELECT event_id, training FROM sp",
    "baseline_rollup_numeric": f"{_rollup(TRAIN, 'tr', ('event_type',), EVENT_FEATURES)} SELECT * FROM st",
    "baseline_rollup_lineitem": f"{_rollup(LI, 'li', ('l_returnflag', 'l_linestatus'), LINE_FEATURES)} SELECT * FROM st",
    "baseline_zero_inflated": f"{_rollup(EV, 'ev', (), ('error_cost',))} SELECT * FROM st",
    "baseline_categorical": f"""WITH {LI}, sc AS ({_scopes('li', ('l_returnflag', 'l_linestatus'))}),
c AS (SELECT scope_key, depth, 'l_returnflag' AS feature, l_returnflag AS cat_value FROM sc UNION ALL SELECT scope_key, depth, 'l_linestatus', l_linestatus FROM sc),
g AS (SELECT *, count(*) AS n FROM c WHERE cat_value IS NOT NULL AND cat_value <> '' GROUP BY ALL)
SELECT *, CAST(sum(n) OVER (PARTITION BY scope_key, feature) AS BIGINT) AS "count", count(*) OVER (PARTITION BY scope_key, feature) AS distinct_values,
  round(n / sum(n) OVER (PARTITION BY scope_key, feature)::DOUBLE, 6) AS share FROM g""",
    "baseline_fallback": f"""WITH oj AS (SELECT c_mktsegment, o_orderpriority, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
sc AS ({_scopes('oj', ('c_mktsegment', 'o_orderpriority'))}), {_stats(_values('sc', ('o_totalprice',), 'scope_key, depth'), 'scope_key, depth, feature')},
sm AS (SELECT scope_key, depth, count(*) AS sample_count, count(*) >= 600 OR depth = 0 AS adequate, CASE WHEN depth = 2 THEN split_part(scope_key, '|', 1) END AS p0 FROM sc GROUP BY scope_key, depth),
src AS (SELECT a.*, CASE WHEN a.adequate THEN a.scope_key WHEN b.adequate THEN b.scope_key ELSE '*' END AS stats_scope FROM sm a LEFT JOIN sm b ON b.scope_key = a.p0)
SELECT src.scope_key, sample_count, adequate, CASE WHEN stats_scope <> src.scope_key THEN stats_scope END AS fallback_from, median, sigma FROM src JOIN st ON st.scope_key = stats_scope""",
    "baseline_lookup": f"""WITH {SPLIT}, ok AS (SELECT event_type FROM sp WHERE training GROUP BY event_type HAVING count(*) >= 1200)
SELECT event_id, CASE WHEN ok.event_type IS NOT NULL THEN 'event_type=' || sp.event_type ELSE '*' END AS baseline_scope FROM sp LEFT JOIN ok ON ok.event_type = sp.event_type""",
    "robust_deviation_scores": f"{RESOLVED} SELECT event_id, baseline_scope, bool_or(known) AS applicable, round(coalesce(max(d), 0.0), 6) AS score FROM rd GROUP BY event_id, baseline_scope",
    "robust_deviation_reasons": f"{RESOLVED} SELECT event_id, feature, round(v, 6) AS observed_num, round(lo, 4) AS lo, round(hi, 4) AS hi, round(d, 4) AS deviation FROM rd WHERE d >= {C.ROBUST_REASON}",
    "categorical_rarity_scores": f"""WITH sc AS ({_scopes('orders', ('o_orderstatus',))}), c AS (SELECT scope_key, 'p' AS f, o_orderpriority AS v FROM sc UNION ALL SELECT scope_key, 's', o_orderstatus FROM sc),
g AS (SELECT scope_key, f, v, count(*) AS n FROM c WHERE v IS NOT NULL AND v <> '' GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY scope_key, f) AS c, count(*) OVER (PARTITION BY scope_key, f) AS k FROM g),
ok AS (SELECT scope_key FROM sc WHERE depth = 1 GROUP BY scope_key HAVING count(*) >= 30),
e AS (SELECT o.*, coalesce(ok.scope_key, '*') AS bs FROM orders o LEFT JOIN ok ON ok.scope_key = 'o_orderstatus=' || coalesce(o_orderstatus, '')),
x AS (SELECT o_orderkey, bs, 'p' AS f, o_orderpriority AS v FROM e UNION ALL SELECT o_orderkey, bs, 's', o_orderstatus FROM e),
d AS (SELECT x.o_orderkey, greatest(0.0, least(1.0, 1 - (t.n / t.c::DOUBLE * t.c + 1) / (t.c + t.k + 1) * (t.k + 1))) AS r FROM x JOIN t ON t.scope_key = x.bs AND t.f = x.f AND t.v = x.v)
SELECT o_orderkey, round(max(r), 6) AS score, count(*) FILTER (WHERE r >= {C.RARITY_REASON}) AS n_reasons FROM d GROUP BY o_orderkey""",
    "rolling_window_history": f"""WITH {EV} SELECT event_id, count(*) OVER w AS n, round(coalesce(sum(value) OVER w, 0.0), 4) AS total FROM ev
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    "scoped_history_depth": f"WITH {ORDINAL} SELECT event_id, CAST(rn AS INTEGER) AS rn, 1 AS depth, count(*) {FRAME} AS n FROM o",
    "rolling_quantile_scores": _rolling(),
    "change_point_scores": _change(),
    "peer_profiles": f"{LINE_PEERS} SELECT scope_key, depth, entity, event_count, metric, round(value, 3) AS value FROM pl",
    "peer_stats": f"{LINE_PEERS} SELECT scope_key, metric, round(median, 5) AS median, round(sigma, 5) AS sigma, peers FROM ps",
    "peer_findings": f"{LINE_PEERS} SELECT scope_key, entity, round(score, 5) AS score, round(rate_score, 5) AS rate_score FROM pf",
    "peer_group_scores": f"""{EVENT_PEERS} SELECT event_id, a.entity IS NOT NULL OR b.entity IS NOT NULL AS applicable, CASE WHEN a.entity IS NOT NULL THEN a.scope_key WHEN b.entity IS NOT NULL THEN '*' END AS scope,
  round(coalesce(a.score, b.rate_score, 0.0), 5) AS score FROM sp LEFT JOIN pf a ON a.entity = sp.user_id AND a.scope_key = 'event_type=' || coalesce(event_type, '')
  LEFT JOIN pf b ON b.entity = sp.user_id AND b.scope_key = '*' WHERE NOT training""",
    "ensemble_scores": f"{MADE} SELECT event_id, score, round(weighted_mean, 6) AS weighted_mean FROM es",
    "confidence_severity": f"{MADE} SELECT event_id, n_applicable, n_firing, confidence, severity FROM es",
    "strongest_detector": f"{MADE} SELECT event_id, strongest, n_reasons FROM es",
    "recompute_scores": f"{MADE} SELECT event_id, score AS recomputed, true AS matches FROM es",
    "policy_suppression": f"{MADE} SELECT event_id, policy_id FROM gt WHERE policy_id IS NOT NULL",
    "gate_outcomes": f"{MADE} SELECT gate, count(*) AS events FROM gt GROUP BY gate",
    "case_fingerprint": f"""{MADE}, {FINGERPRINT} SELECT event_id, left(sha1(CAST(user_id AS VARCHAR) || '|' || coalesce(strongest, '') || '|' || array_to_string(list_sort(coalesce(own, every)), '|')), 32) AS fingerprint
FROM gt JOIN fr USING (event_id) WHERE gate = 'candidate'""",
    "dedup_fold": f"""WITH RECURSIVE {EV}, c AS (SELECT user_id, event_id, epoch_us(ts) AS tm, event_id % 5 AS fp, event_id % 5 = 0 AS el, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM ev),
f AS (SELECT user_id, event_id, rn, 'created' AS kind, event_id AS ref, [{{'fp': fp, 'tm': tm, 'id': event_id}}] AS st FROM c WHERE rn = 1
UNION ALL SELECT c.user_id, c.event_id, c.rn, CASE WHEN len(list_filter(f.st, lambda o: o.fp = c.fp AND (c.el OR o.tm >= c.tm - {C.DEDUP_HOURS * 3600 * 1000000}))) > 0 THEN 'duplicate' WHEN len(f.st) >= {C.MAX_OPEN_PER_ENTITY} THEN 'capped' ELSE 'created' END,
  CASE WHEN len(list_filter(f.st, lambda o: o.fp = c.fp AND (c.el OR o.tm >= c.tm - {C.DEDUP_HOURS * 3600 * 1000000}))) > 0 THEN list_filter(f.st, lambda o: o.fp = c.fp AND (c.el OR o.tm >= c.tm - {C.DEDUP_HOURS * 3600 * 1000000}))[1].id
    WHEN len(f.st) >= {C.MAX_OPEN_PER_ENTITY} THEN NULL ELSE c.event_id END,
  CASE WHEN len(list_filter(f.st, lambda o: o.fp = c.fp AND (c.el OR o.tm >= c.tm - {C.DEDUP_HOURS * 3600 * 1000000}))) > 0 OR len(f.st) >= {C.MAX_OPEN_PER_ENTITY} THEN f.st ELSE list_append(f.st, {{'fp': c.fp, 'tm': c.tm, 'id': c.event_id}}) END
FROM f JOIN c ON c.user_id = f.user_id AND c.rn = f.rn + 1) SELECT event_id, kind, ref FROM f""",
    "case_queue_filtered": f"WITH {CASES} SELECT id, entity_id, anomaly_score FROM oc WHERE status = 'open' AND severity = 'critical'",
    "case_queue_topk": f"WITH {CASES} SELECT id, status, anomaly_score FROM oc WHERE status IN ('open', 'acknowledged', 'in_progress') ORDER BY anomaly_score DESC, id LIMIT 100",
    "overview_counts": f"""WITH {CASES} SELECT count(*) AS cases, count(*) FILTER (WHERE status = 'open') AS open_cases, count(*) FILTER (WHERE status IN ('open', 'in_progress')) AS unresolved,
  count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE status = 'resolved') AS resolved FROM oc""",
    "schema_counts": f"WITH {CASES} SELECT schema_id, count(*) AS event_count, count(*) FILTER (WHERE status = 'open') AS open_cases FROM oc GROUP BY schema_id",
    "latest_label": "SELECT conv_id AS id, max_by(role, turn) AS feedback_label FROM conversations GROUP BY conv_id",
    "labelled_cases": "SELECT doc_id AS id, source, CAST(quality AS VARCHAR) AS label FROM labels JOIN documents USING (doc_id)",
    "detector_precision": f"WITH {VERDICTS} SELECT * FROM dp",
    "retraining_weights": f"""WITH {VERDICTS}, w AS (SELECT detector, total, precision, CASE detector WHEN 'src1' THEN 0.7 WHEN 'src2' THEN 0.3 ELSE 1.0 END::DOUBLE AS current FROM dp WHERE (SELECT count(*) FROM vd) >= {C.FEEDBACK_OVERALL}),
m AS (SELECT *, round(current + 0.5::DOUBLE * (greatest({C.WEIGHT_FLOOR}, least(1.0, precision)) - current), 4) AS moved FROM w)
SELECT detector, total, precision, current, CASE WHEN total >= {C.FEEDBACK_PER_DETECTOR} AND abs(moved - current) >= {C.WEIGHT_MIN_CHANGE} THEN greatest({C.WEIGHT_FLOOR}, moved) ELSE current END AS suggested FROM m""",
    "proposed_threshold": f"""WITH {VERDICTS}, t AS (SELECT count(*) AS labels, count(*) FILTER (WHERE label <> 'duplicate') AS rejected, max(anomaly_score) FILTER (WHERE label <> 'duplicate') AS ceiling FROM vd),
r AS (SELECT *, least({C.SCORE_CAP}, greatest(60.0, round(ceiling + {C.SCORE_STEP}, 1)))::DOUBLE AS raised FROM t)
SELECT labels, rejected, CASE WHEN labels >= {C.FEEDBACK_OVERALL} AND rejected / greatest(labels, 1)::DOUBLE > {C.REJECT_SHARE} AND raised > 60 THEN raised END AS suggested FROM r""",
    "proposed_policies": f"""WITH {VERDICTS} SELECT baseline_scope, strongest AS detector, count(*) AS support, least({C.POLICY_CEILING}, round(max(anomaly_score) + {C.POLICY_MARGIN}, 1))::DOUBLE AS max_score,
  substr(baseline_scope, 6) AS lang, array_to_string(list_sort(list(id))[1:10], ',') AS supporting FROM vd WHERE label = 'false_positive' AND (SELECT count(*) FROM vd) >= {C.FEEDBACK_OVERALL}
GROUP BY baseline_scope, strongest HAVING count(*) >= {C.POLICY_SUPPORT}""",
    "similar_cases": """WITH v AS (SELECT p_partkey AS id, split_part(p_type, ' ', 1) AS schema_id, p_brand AS e, p_type AS sc, p_size % 4 AS sev, CASE WHEN p_size > 25 THEN 'resolved' ELSE 'open' END AS status,
  list_distinct(string_split(p_name, ' ')) AS keys, p_size::DOUBLE AS size, p_retailprice AS price FROM part),
p AS (SELECT t.id AS target_id, c.id, c.status, 0.0::DOUBLE + 0.40::DOUBLE * CASE WHEN len(list_distinct(list_concat(t.keys, c.keys))) > 0 THEN len(list_intersect(t.keys, c.keys)) / len(list_distinct(list_concat(t.keys, c.keys)))::DOUBLE ELSE 0 END
  + 0.15::DOUBLE * (t.e = c.e)::INT + 0.15::DOUBLE * (t.sc = c.sc)::INT + 0.10::DOUBLE * (t.sev = c.sev)::INT
  + 0.20::DOUBLE * ((CASE WHEN t.size = 0 AND c.size = 0 THEN 1.0 ELSE least(t.size, c.size) / greatest(t.size, c.size) END + CASE WHEN t.price = 0 AND c.price = 0 THEN 1.0 ELSE least(t.price, c.price) / greatest(t.price, c.price) END) / 2) AS total
  FROM v t JOIN v c ON t.schema_id = c.schema_id AND t.id <> c.id WHERE t.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(total, 9) DESC, status <> 'resolved', id) AS place FROM p WHERE round(total, 9) >= 0.25)
SELECT target_id, id, round(total, 6) AS total, place FROM r WHERE place <= 5""",
    "ingest_validate": f"WITH {BATCH} SELECT idx, CAST(n_problems AS BIGINT) AS n_problems, entity_id, has_time FROM bt",
    "ingest_dedupe": f"WITH {BATCH} SELECT idx, outcome FROM outc",
    "ingest_summary": f"WITH {BATCH} SELECT count(*) FILTER (WHERE outcome = 'accepted') AS accepted, count(*) FILTER (WHERE outcome = 'duplicate') AS duplicates, count(*) FILTER (WHERE outcome = 'rejected') AS rejected FROM outc",
    "ingest_errors": f"WITH {BATCH} SELECT idx, CAST(n_problems AS BIGINT) AS n_problems FROM outc WHERE outcome = 'rejected' ORDER BY idx LIMIT 50",
    "number_coercion": f"""WITH r AS (SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_extendedprice, 2) AS DECIMAL(15, 2)) AS VARCHAR) AS p FROM lineitem),
t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN ' ' || p || ' ' WHEN 2 THEN replace(p, '.', ',') WHEN 3 THEN p || 'd' WHEN 4 THEN '-' || p WHEN 5 THEN 'NaN' WHEN 6 THEN p || 'e2' ELSE '' END AS raw FROM r)
SELECT l_orderkey, l_linenumber, raw, CASE WHEN regexp_full_match(trim(raw), '{NUMBER[1:-1]}') THEN round(TRY_CAST(replace(trim(raw), ',', '.') AS DOUBLE), 4) END AS number FROM t""",
    "pii_redaction": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[\w.+-]+@[\w-]+\.[\w.]+', '[email]', 'g'), '\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b', '[iban]', 'g'), '\+?\d[\d\s\-()]{7,}\d', '[phone]', 'g')) AS redacted_md5 FROM documents""",
    "strip_code_fence": r"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '```json' || chr(10) || text || chr(10) || '```' ELSE text END AS x FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN trim(x)[1] = '`' THEN trim(regexp_replace(regexp_replace(trim(x), '^`{3}[a-zA-Z]*\n?', ''), '\n?`{3}$', '')) ELSE trim(x) END) AS inner_md5 FROM t""",
    "notification_payload": f"""{MADE}, rr AS (SELECT event_id, detector, row_number() OVER (PARTITION BY event_id ORDER BY place) AS k FROM ap WHERE s >= 0.5),
rl AS (SELECT event_id, string_agg('by ' || detector, '; ' ORDER BY k) AS explanations FROM rr WHERE k <= 3 GROUP BY event_id)
SELECT event_id, severity, score, coalesce(explanations, '') AS explanations FROM es LEFT JOIN rl USING (event_id) WHERE severity IN ('critical', 'high')""",
    "scope_key_roundtrip": """WITH d AS (SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem)
SELECT '*' AS scope_key, 0::BIGINT AS depth, 'all data' AS described, NULL::VARCHAR AS flag, NULL::VARCHAR AS status UNION
SELECT 'l_returnflag=' || f, 1, 'l_returnflag=' || f, f, NULL FROM d UNION SELECT 'l_linestatus=' || s || '|l_returnflag=' || f, 2, 'l_linestatus=' || s || ', l_returnflag=' || f, f, s FROM d""",
    "tenant_lookup": "SELECT c_custkey AS tenant_id, c_name AS slug, sha256(c_name) AS key_hash FROM customer WHERE c_name IN ('Customer#000000007', 'Customer#000000001')",
    "policy_scan": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_nationkey AS VARCHAR) END AS schema_id FROM supplier WHERE s_acctbal > 0 AND (s_suppkey % 4 = 0 OR s_nationkey = 3)",
    "time_parsing": """WITH t AS (SELECT event_id, event_id % 4 AS n, date_trunc('second', ts) AS s FROM events)
SELECT event_id, CASE n WHEN 0 THEN strftime(s, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(s, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(s, '%Y-%m-%d') ELSE '31/12/2024' END AS raw,
  CASE WHEN n < 2 THEN CAST(epoch(s) AS BIGINT) WHEN n = 2 THEN CAST(epoch(date_trunc('day', s)) AS BIGINT) ELSE 0 END AS seconds FROM t""",
}
