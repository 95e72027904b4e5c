"""DuckDB SQL for the registered queries, over a node table that is built level by level.

Written apart from the Spark side: rules, weights and bounds stand here as SQL of their own.
"""

from __future__ import annotations

import math

LIMIT = repr(1 + math.log(4) / math.log(12))
OPS = "('Add', 'Mul', 'exp', 'log')"


def _line(i: str, p: str, k: int) -> str:
    return f"(({i}*1000003 + {p}*8191 + {k}*7919 + 12345) % 2147483647) * 48271 % 2147483647"


def _mix(z: str) -> str:
    return f"(({z} % 46337) * ({z} // 46337 + 1009) + {z}) * 69621 % 2147483647"


_LEAF = "CASE h3 % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE '1' END"
_LABEL = f"""CASE WHEN level >= target OR h1 % 100 < 15 THEN {_LEAF}
 WHEN positive THEN CASE WHEN h2 % 100 < 30 THEN {_LEAF} WHEN h2 % 100 < 60 THEN 'Add' WHEN h2 % 100 < 85 THEN 'Mul' ELSE 'exp' END
 WHEN h2 % 100 < 30 THEN 'Add' WHEN h2 % 100 < 60 THEN 'Mul' WHEN h2 % 100 < 80 THEN 'exp' ELSE 'log' END"""


def _drawn(source: str) -> str:
    """source, which has i and p, with the draws h1, h2 and h3."""
    lines = ", ".join(f"{_line('i', 'p', k)} z{k}" for k in (1, 2, 3))
    return f"(SELECT *, {_mix('z1')} h1, {_mix('z2')} h2, {_mix('z3')} h3 FROM (SELECT *, {lines} FROM {source}))"


def _e(a: str, b: str) -> str:
    return f"hash('eml', {a}, {b})"


_one = "hash('leaf', '1', '')"


def _ln(z: str) -> list[str]:
    a = _e(_one, z)
    return [a, _e(a, _one), _e(_one, _e(a, _one))]


def _minus(a: str, b: str) -> list[str]:
    return [*_ln(a), _e(b, _one), _e(_ln(a)[2], _e(b, _one))]


def _plus(a: str, b: str) -> list[str]:
    nil = _ln(_one)
    neg = _minus(nil[2], b)
    return nil + neg + _minus(a, neg[-1])


def _times(a: str, b: str) -> list[str]:
    s = _plus(_ln(a)[2], _ln(b)[2])
    return _ln(a) + _ln(b) + s + [_e(s[-1], _one)]


_TERMS = {"Add": _plus("a.g", "b.g"), "Mul": _times("a.g", "b.g"), "exp": [_e("a.g", _one)], "log": _ln("a.g")}
_F0 = """CASE n.label WHEN 'Add' THEN CASE WHEN a.F = '0' THEN b.F WHEN b.F = '0' THEN a.F ELSE 'Add(' || a.F || ', ' || b.F || ')' END
 WHEN 'Mul' THEN CASE WHEN '0' IN (a.F, b.F) THEN '0' WHEN a.F = '1' THEN b.F WHEN b.F = '1' THEN a.F ELSE 'Mul(' || a.F || ', ' || b.F || ')' END"""
_F1 = _F0.replace(".F", ".f1") + """ WHEN 'exp' THEN CASE WHEN a.f1 = '0' THEN '1' WHEN starts_with(a.f1, 'log(') THEN a.f1[5:-2] ELSE 'exp(' || a.f1 || ')' END
 WHEN 'log' THEN CASE WHEN a.f1 = '1' THEN '0' WHEN starts_with(a.f1, 'exp(') THEN a.f1[5:-2] ELSE 'log(' || a.f1 || ')' END ELSE n.label END"""
_F0 = _F0.replace(".F", ".f0") + " WHEN 'exp' THEN 'exp(' || a.f0 || ')' WHEN 'log' THEN 'log(' || a.f0 || ')' ELSE n.label END"


def _levels() -> str:
    out = []
    for level in (4, 3, 2, 1, 0):
        child = f"t{level + 1}" if level < 4 else "(SELECT NULL::BIGINT i, NULL::BIGINT p, NULL s, NULL::INT d, NULL::BOOLEAN c, NULL::UBIGINT g, NULL::DOUBLE v, NULL f0, NULL f1)"
        ids = " ".join(f"WHEN '{k}' THEN {v[-1]}" for k, v in _TERMS.items())
        lists = " ".join(f"WHEN '{k}' THEN [{', '.join(dict.fromkeys(v + [_one]))}]" for k, v in _TERMS.items())
        out.append(f"""t{level} AS MATERIALIZED (SELECT n.i, n.p, n.level, n.label, a.label l, b.label r,
  CASE WHEN n.label IN ('Add', 'Mul') THEN n.label || '(' || a.s || ', ' || b.s || ')' WHEN n.label IN ('exp', 'log') THEN n.label || '(' || a.s || ')' ELSE n.label END s, a.s sa, b.s sb,
  CASE n.label WHEN 'Add' THEN greatest(9, a.d + 4, b.d + 4) WHEN 'Mul' THEN greatest(10, a.d + 8, b.d + 8) WHEN 'exp' THEN a.d + 1 WHEN 'log' THEN a.d + 3 ELSE 0 END::INT d,
  CASE WHEN n.label IN ('Add', 'Mul') THEN a.c AND b.c WHEN n.label IN ('exp', 'log') THEN a.c ELSE n.label = '1' END c,
  CASE n.label WHEN 'x' THEN 1.3::DOUBLE WHEN 'y' THEN 2.1::DOUBLE WHEN '1' THEN 1::DOUBLE WHEN 'Add' THEN a.v + b.v WHEN 'Mul' THEN a.v * b.v WHEN 'exp' THEN CASE WHEN a.v > 709 THEN 'inf'::DOUBLE ELSE exp(a.v) END
   ELSE CASE WHEN a.v = 0 THEN '-inf'::DOUBLE WHEN a.v < 0 OR isnan(a.v) THEN 'nan'::DOUBLE WHEN isinf(a.v) THEN a.v ELSE ln(a.v) END END v,
  CASE n.label {ids} ELSE hash('leaf', n.label, '') END g, CASE n.label {lists} ELSE [hash('leaf', n.label, '')] END terms,
  {_F0} f0, {_F1} f1
  FROM n LEFT JOIN {child.replace(" f1)", " f1, NULL label)")} a ON a.i = n.i AND a.p = 2 * n.p LEFT JOIN {child.replace(" f1)", " f1, NULL label)")} b ON b.i = n.i AND b.p = 2 * n.p + 1 WHERE n.level = {level})""")
    return ",\n".join(out)


_KEYS = f"(SELECT event_id i, 1::BIGINT p, 0 AS level, false AS positive, {_line('event_id', '0', 9)} z FROM events WHERE event_id IS NOT NULL)"
_TOPS = f"(SELECT *, CASE WHEN h < 3 THEN 0 WHEN h < 15 THEN 1 WHEN h < 37 THEN 2 WHEN h < 65 THEN 3 ELSE 4 END target FROM (SELECT i, p, level, positive, {_mix('z')} % 100 h FROM {_KEYS}))"
_NEXT = "(SELECT i, 2 * p + k p, level + 1 AS level, target, CASE label WHEN 'log' THEN true WHEN 'exp' THEN false ELSE positive END positive FROM n0, (VALUES (0), (1)) z(k) WHERE label IN ('Add', 'Mul') OR (k = 0 AND label IN ('exp', 'log')))"
BASE = f"""WITH RECURSIVE n0 AS (
 SELECT i, p, level, target, positive, {_LABEL} label FROM {_drawn(_TOPS)}
 UNION ALL
 SELECT i, p, level, target, positive, {_LABEL} label FROM {_drawn(_NEXT)}
), n AS MATERIALIZED (SELECT * FROM n0),
{_levels()},
t AS MATERIALIZED (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4),
e AS MATERIALIZED (SELECT i, p parent, 2 * p child, CASE WHEN label IN ('exp', 'log') THEN 'arg0' ELSE 'left' END slot, label parent_label, l child_label FROM t WHERE l IS NOT NULL
 UNION ALL SELECT i, p, 2 * p + 1, 'right', label, r FROM t WHERE r IS NOT NULL),
dag AS (SELECT i, count(DISTINCT x) eml_dag_nodes FROM (SELECT i, unnest(terms) x FROM t) GROUP BY i),
m0 AS (SELECT i expr_id, any_value(s) FILTER (p = 1) expression, count(*) ast_nodes, max(level) ast_depth, count(DISTINCT s) ast_dag_nodes,
 count(*) FILTER (label = 'Add') n_add, count(*) FILTER (label = 'Mul') n_mul, count(*) FILTER (label = 'exp') n_exp, count(*) FILTER (label = 'log') n_log,
 count(*) FILTER (label IN ('x', 'y')) n_symbols, count(*) FILTER (label = '1') n_constants, any_value(d) FILTER (p = 1) eml_depth, any_value(v) FILTER (p = 1) AS value,
 sum(CASE label WHEN 'Add' THEN 25 WHEN 'Mul' THEN 39 WHEN 'exp' THEN 2 WHEN 'log' THEN 6 ELSE 1 END)::BIGINT eml_nodes,
 sum(CASE label WHEN 'Add' THEN 26 WHEN 'Mul' THEN 34 WHEN 'exp' THEN 3 WHEN 'log' THEN 6 ELSE 1 END)::BIGINT estimated_cost,
 any_value(f0) FILTER (p = 1) form_safe, any_value(f1) FILTER (p = 1) form_positive_real,
 count(*) FILTER (label = 'Mul' AND (l = '1' OR r = '1')) mul_by_one, count(*) FILTER (label IN ('Add', 'Mul') AND c) constant_only, count(*) FILTER (label = 'log' AND l = '1') log_one,
 count(*) FILTER (label = 'exp' AND l = 'log') exp_log, count(*) FILTER (label = 'log' AND l = 'exp') log_exp, count(*) FILTER (label IN ('Add', 'Mul') AND l = '1' AND r = '1') number_only
 FROM t GROUP BY i),
m1 AS (SELECT m0.*, eml_dag_nodes, n_symbols + n_constants n_leaves, mul_by_one + constant_only + log_one + exp_log + log_exp total_score,
 (mul_by_one > 0)::BIGINT + (log_one > 0)::BIGINT + (exp_log > 0)::BIGINT + (log_exp > 0)::BIGINT + number_only triviality_score,
 concat_ws('+', CASE WHEN n_add > 0 THEN 'Add' END, CASE WHEN n_mul > 0 THEN 'Mul' END, CASE WHEN n_exp > 0 THEN 'exp' END, CASE WHEN n_log > 0 THEN 'log' END) sig,
 list_filter([('Add', n_add), ('Mul', n_mul), ('exp', n_exp), ('log', n_log)], lambda z: z[2] = greatest(n_add, n_mul, n_exp, n_log)) tops,
 ('0x' || substr(sha256('0:' || expr_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE share FROM m0 JOIN dag ON dag.i = expr_id),
m AS MATERIALIZED (SELECT *, eml_nodes / ast_nodes tree_alpha, ast_nodes / ast_dag_nodes ast_compression, eml_dag_nodes / ast_nodes dag_alpha, eml_dag_nodes / ast_dag_nodes dag_alpha_vs_dag,
 eml_nodes / eml_dag_nodes dag_compression, eml_nodes / ast_nodes < {LIMIT} below_threshold,
 CASE WHEN ast_nodes <= 3 THEN '1-3' WHEN ast_nodes <= 7 THEN '4-7' WHEN ast_nodes <= 15 THEN '8-15' WHEN ast_nodes <= 31 THEN '16-31' ELSE '32+' END ast_node_bucket,
 CASE WHEN ast_depth <= 1 THEN '0-1' WHEN ast_depth <= 4 THEN ast_depth::VARCHAR ELSE '5+' END ast_depth_bucket,
 CASE WHEN eml_nodes < 16 THEN '1-15' WHEN eml_nodes < 32 THEN '16-31' WHEN eml_nodes < 64 THEN '32-63' WHEN eml_nodes < 128 THEN '64-127' WHEN eml_nodes < 256 THEN '128-255' ELSE '256+' END eml_node_bucket,
 CASE WHEN eml_nodes < 2 * ast_nodes THEN '0-<2' WHEN eml_nodes < 5 * ast_nodes THEN '2-<5' WHEN eml_nodes < 10 * ast_nodes THEN '5-<10' WHEN eml_nodes < 15 * ast_nodes THEN '10-<15' ELSE '15+' END alpha_bucket,
 CASE sig WHEN '' THEN 'leaf_only' ELSE sig END operator_signature,
 CASE WHEN ast_nodes = n_leaves THEN 'leaf_only' WHEN len(tops) > 1 THEN 'mixed_' ELSE '' END || CASE WHEN ast_nodes = n_leaves THEN '' ELSE array_to_string(list_transform(tops, lambda z: z[1]), '+') END dominant_family,
 CASE WHEN share < 0.7 THEN 'train' WHEN share < 0.85 THEN 'validation' ELSE 'test' END split,
 CASE WHEN total_score > 0 THEN 'identity_heavy_v1' ELSE 'nontrivial_v1' END counter_subset, CASE WHEN triviality_score > 0 THEN 'identity_heavy_v1' ELSE 'nontrivial_v1' END feature_subset FROM m1)
"""
SUMMARY = f"""count(*) AS n, round(avg(tree_alpha), 6) AS mean_alpha, round(median(tree_alpha), 6) AS median_alpha, round(quantile_disc(tree_alpha, 0.9), 6) AS p90_alpha,
 round(quantile_disc(tree_alpha, 0.95), 6) AS p95_alpha, round(max(tree_alpha), 6) AS max_alpha, round(avg(ast_nodes), 6) AS mean_ast_nodes, round(avg(eml_nodes), 6) AS mean_eml_nodes,
 round(100.0::DOUBLE * avg((tree_alpha < {LIMIT})::INT), 6) AS percent_below"""
DAG = f"""count(*) AS n, round(median(tree_alpha), 6) AS median_tree_alpha, round(median(dag_alpha), 6) AS median_dag_alpha, round(median(dag_alpha_vs_dag), 6) AS median_dag_alpha_vs_dag,
 round(median(dag_compression), 6) AS median_dag_compression, round(quantile_disc(dag_compression, 0.9), 6) AS p90_dag_compression, round(100.0::DOUBLE * avg((dag_alpha < {LIMIT})::INT), 6) AS percent_below_dag,
 round(100.0::DOUBLE * avg((dag_alpha_vs_dag < {LIMIT})::INT), 6) AS percent_below_dag_vs_dag, round(median(tree_alpha - dag_alpha), 6) AS median_improvement"""
MACRO = """count(*) AS n, round(median(ast_dag_nodes / ast_nodes), 6) AS median_macro_alpha, round(median(eml_dag_nodes / ast_dag_nodes), 6) AS median_gain, round(avg(ast_dag_nodes), 6) AS nodes_mean,
 round(median(ast_dag_nodes), 6) AS nodes_median, round(quantile_cont(ast_dag_nodes, 0.9), 6) AS nodes_p90, round(avg(eml_dag_nodes / ast_dag_nodes), 6) AS gain_mean, round(quantile_cont(eml_dag_nodes / ast_dag_nodes, 0.9), 6) AS gain_p90"""


def q(text: str) -> str:
    return BASE + text


def grouped(what: str, *keys: str, source: str = "m") -> str:
    return q(f"SELECT {', '.join(keys)}, {what} FROM {source} GROUP BY ALL")


def ranked(inner: str, order: str, n: int, columns: str, where: str = "") -> str:
    return q(f"SELECT row_number() OVER (ORDER BY {order}) AS rank, {columns} FROM ({inner}) {where} ORDER BY rank LIMIT {n}")


def booleans(what: str) -> str:
    flags = " UNION ALL ".join(f"SELECT 'contains_{x}' AS feature, n_{x.lower()} > 0 AS value, m.* EXCLUDE (value) FROM m" for x in ("Add", "Mul", "exp", "log"))
    return q(f", flags AS ({flags}), s AS (SELECT feature, value, {what} FROM flags GROUP BY ALL) SELECT g.feature, g.value, coalesce(s.n, 0) AS n, s.* EXCLUDE (feature, value, n) FROM (SELECT unnest(['contains_Add', 'contains_Mul', 'contains_exp', 'contains_log']) AS feature, b AS value FROM (VALUES (false), (true)) x(b)) g LEFT JOIN s USING (feature, value)")


def scenarios() -> str:
    out = []
    for k, v in ((4, 3), (2, 2), (8, 4)):
        limit = repr(1 + math.log(k) / math.log(4 * v))
        below = ", ".join(f"round(100.0::DOUBLE * avg(({x} < {limit})::INT), 6) AS percent_{n}" for n, x in (("tree", "tree_alpha"), ("cost", "estimated_cost / ast_nodes"), ("dag", "dag_alpha"), ("dag_vs_dag", "dag_alpha_vs_dag")))
        out.append(f"SELECT {k}::BIGINT AS k, {v}::BIGINT AS variables, round({limit}::DOUBLE, 6) AS threshold, count(*) AS n, round(avg(tree_alpha), 6) AS mean_alpha, round(median(tree_alpha), 6) AS median_alpha, count(*) FILTER (tree_alpha >= {limit}) AS above, {below} FROM m")
    return " UNION ALL ".join(out)


def histogram(value: str) -> str:
    return q(f", z AS (SELECT {value} AS z FROM m), ends AS (SELECT min(z) AS low, max(z) AS high FROM z) SELECT least(floor((z - low) * 40 / (high - low)), 39)::BIGINT AS bin, count(*) AS n FROM z, ends GROUP BY ALL")


# nodes of the shared expression, references between them, and occurrences of motifs of one or two of them
SHARED = """, dn AS MATERIALIZED (SELECT i, s, any_value(label) label, count(*) copies, any_value(l) l, any_value(r) r, any_value(sa) sa, any_value(sb) sb FROM t GROUP BY i, s),
o AS MATERIALIZED (SELECT i expr_id, label signature, 1::BIGINT node_count, s root FROM dn WHERE l IS NOT NULL
 UNION ALL SELECT i, CASE WHEN sa = sb THEN label || '[left:' || l || ',right:' || l || ']' WHEN label IN ('exp', 'log') THEN label || '[arg0:' || l || ']' ELSE label || '[left:' || l || ']' END, 2, s FROM dn WHERE l IN ('Add', 'Mul', 'exp', 'log')
 UNION ALL SELECT i, label || '[right:' || r || ']', 2, s FROM dn WHERE r IN ('Add', 'Mul', 'exp', 'log') AND sa <> sb),
f AS (SELECT signature, node_count, split, sum(c)::BIGINT AS support, count(*) AS coverage, count(*) FILTER (feature_subset = 'nontrivial_v1') AS nontrivial_coverage
 FROM (SELECT expr_id, signature, node_count, count(*) AS c FROM o GROUP BY ALL) JOIN m USING (expr_id) GROUP BY ALL)
"""
SCORES = """SELECT printf('%.1f/%.1f/%.1f/%.1f', gc, gn, gv, ge) AS trial, signature, split, node_count, round(support * (node_count - 1) + gc * coverage + gn * nontrivial_coverage - gv * node_count - ge * node_count * 2, 6) AS score
 FROM f, (SELECT unnest([0, 1]::DOUBLE[]) gc), (SELECT unnest([0, 0.5]::DOUBLE[]) gn), (SELECT unnest([0, 1]::DOUBLE[]) gv), (SELECT unnest([0, 0.1]::DOUBLE[]) ge)"""
SELECTED = f""", s AS ({SCORES}), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY score DESC, signature) AS r FROM s WHERE split = 'train') WHERE r <= 5),
c AS (SELECT b.trial, count(*) AS n, round(sum(b.score), 6) AS train_score, round(sum(coalesce(x.score, 0)), 6) AS validation_score FROM b LEFT JOIN (SELECT * FROM s WHERE split = 'validation') x USING (trial, signature) GROUP BY ALL)"""
MODES = """, g0 AS (SELECT 'ast_tree' representation_mode, i expr_id, i || ':' || p node_id, label FROM t
 UNION ALL SELECT 'ast_dag', i, i || ':' || s, label FROM dn UNION ALL SELECT 'macro_graph', i, i || ':' || s, CASE WHEN label IN ('Add', 'Mul', 'exp', 'log') THEN 'eml_' || lower(label) ELSE label END FROM dn),
g1 AS (SELECT 'ast_tree' representation_mode, i expr_id, i || ':' || parent AS source, i || ':' || child AS target, slot edge_type FROM e
 UNION ALL SELECT mode, i, i || ':' || s, i || ':' || sa, CASE WHEN label IN ('exp', 'log') THEN 'arg0' ELSE 'left' END FROM dn, (VALUES ('ast_dag'), ('macro_graph')) z(mode) WHERE l IS NOT NULL
 UNION ALL SELECT mode, i, i || ':' || s, i || ':' || sb, 'right' FROM dn, (VALUES ('ast_dag'), ('macro_graph')) z(mode) WHERE r IS NOT NULL)"""


def size(weights: tuple) -> str:
    add, mul, exp, log, leaf, nil = weights
    count = lambda part: f"((length(z) - length(replace(z, '{part}', ''))) // {len(part)})"
    return f"({add} * {count('Add')} + {mul} * {count('Mul')} + {exp} * {count('exp')} + {log} * {count('log')} + {leaf} * ({count('x')} - {count('exp')} + {count('y')} + {count('1')}) + {nil} * {count('0')})::BIGINT"


STUDY = f""", y0 AS (SELECT m.*, 'safe' AS rule_mode, form_safe AS z FROM m UNION ALL SELECT m.*, 'positive_real', form_positive_real FROM m),
y1 AS (SELECT *, z AS normal_form, {size((1, 1, 1, 1, 1, 1))} AS new_ast_nodes, {size((25, 39, 2, 6, 1, 7))} AS new_eml_nodes FROM y0),
y AS (SELECT *, new_eml_nodes / ast_nodes AS new_alpha, eml_nodes / new_eml_nodes AS gain, CASE sign(new_eml_nodes - eml_nodes) WHEN -1 THEN 'improved' WHEN 0 THEN 'equal' ELSE 'worse' END AS outcome,
 tree_alpha >= {LIMIT} AND new_eml_nodes / ast_nodes < {LIMIT} AS crossed FROM y1)"""
GAINS = f"""count(*) AS n, round(100.0::DOUBLE * avg((outcome = 'improved')::INT), 6) AS percent_improved, round(100.0::DOUBLE * avg((outcome = 'worse')::INT), 6) AS percent_worse, round(100.0::DOUBLE * avg((outcome = 'equal')::INT), 6) AS percent_equal,
 round(100.0::DOUBLE * avg((tree_alpha < {LIMIT})::INT), 6) AS percent_below_before, round(100.0::DOUBLE * avg((new_alpha < {LIMIT})::INT), 6) AS percent_below_after, round(median(new_alpha), 6) AS median_new_alpha,
 round(avg(gain), 6) AS gain_mean, round(median(gain), 6) AS gain_median, round(quantile_cont(gain, 0.9), 6) AS gain_p90"""
GROUP = f"SELECT operator_signature, {SUMMARY} FROM m GROUP BY ALL"
DAGS = f"SELECT operator_signature, {DAG} FROM m GROUP BY ALL"
SIGNATURES = f"SELECT rule_mode, operator_signature, {GAINS} FROM y GROUP BY ALL"


def study(text: str) -> str:
    return q(STUDY + " " + text)


def best(inner: str, score: str, order: str, columns: str, n: int = 6, base: str = "") -> str:
    return q(base + f" SELECT row_number() OVER (ORDER BY {order}) AS rank, {columns} FROM (SELECT *, round({score}, 6) AS score FROM ({inner})) ORDER BY rank LIMIT {n}")


FEATURES = " UNION ALL ".join(f"SELECT '{x}' AS feature, {x} > 0 AS value, tree_alpha FROM m" for x in ("mul_by_one", "log_one", "exp_log", "log_exp", "number_only", "constant_only"))
PAIRS = "SELECT o_orderkey AS expr_id FROM orders WHERE o_orderstatus = 'F'"
ORACLE = {
    "corpus_nodes": q("SELECT i AS expr_id, p AS node, level, label FROM t"),
    "corpus_edges": q("SELECT i AS expr_id, parent, child, slot, parent_label, child_label FROM e"),
    "tree_stats": q("SELECT expr_id, ast_nodes, ast_nodes - 1 AS ast_edges, n_leaves AS ast_leaves, ast_nodes - n_leaves AS ast_operators, ast_depth, eml_nodes, eml_nodes - 1 AS eml_edges, (eml_nodes + 1) // 2 AS eml_leaves FROM m"),
    "eml_tree_alpha": q("SELECT expr_id, eml_nodes, round(tree_alpha, 9) AS tree_alpha, below_threshold FROM m"),
    "eml_tree_depth": q("SELECT expr_id, ast_depth, eml_depth FROM m"),
    "estimated_cost": q("SELECT expr_id, estimated_cost, round(estimated_cost / ast_nodes, 9) AS cost_alpha FROM m"),
    "operator_features": q("SELECT expr_id, n_add, n_mul, n_exp, n_log, n_symbols, n_constants FROM m"),
    "operator_signature": q("SELECT expr_id, operator_signature, dominant_family FROM m"),
    "size_buckets": q("SELECT expr_id, ast_node_bucket, ast_depth_bucket, eml_node_bucket, alpha_bucket FROM m"),
    "nontriviality": q("SELECT expr_id, mul_by_one, constant_only, log_one, exp_log, log_exp, total_score FROM m"),
    "triviality_subsets": q("SELECT expr_id, triviality_score, counter_subset, feature_subset FROM m"),
    "triviality_groups": q(f"SELECT feature, value, count(*) AS n, round(avg(tree_alpha), 6) AS mean_alpha FROM ({FEATURES}) GROUP BY ALL"),
    "log_arg_classes": q("SELECT CASE child_label WHEN '1' THEN 'one' WHEN 'x' THEN 'symbol' WHEN 'y' THEN 'symbol' ELSE lower(child_label) END AS class, count(*) AS n FROM e WHERE parent_label = 'log' GROUP BY ALL"),
    "split_assignment": q("SELECT expr_id, split FROM m"),
    "split_counts": q("SELECT s.split, count(m.expr_id) AS n FROM (VALUES ('train'), ('validation'), ('test')) s(split) LEFT JOIN m USING (split) GROUP BY ALL"),
    "eval_probe": q("SELECT expr_id, CASE WHEN isnan(value) THEN 'undefined' WHEN isinf(value) THEN 'infinite' ELSE 'finite' END AS kind, CASE WHEN abs(value) < 1e6 THEN round(value, 6) END AS value FROM m"),
    "group_by_depth": grouped(SUMMARY, "ast_depth"),
    "group_by_size": grouped(SUMMARY, "ast_node_bucket"),
    "group_by_family": grouped(SUMMARY, "dominant_family"),
    "group_by_signature": grouped(SUMMARY, "operator_signature"),
    "group_by_boolean": booleans(SUMMARY),
    "subset_replicated_groups": grouped(SUMMARY, "subset", "operator_signature", source="(SELECT 'all_v1' AS subset, m.* FROM m UNION ALL SELECT feature_subset, m.* FROM m)"),
    "alpha_summary": q(f"SELECT {SUMMARY}, quantile_disc(ast_nodes, 0.5)::DOUBLE AS median_ast_nodes FROM m"),
    "threshold_scenarios": q(scenarios()),
    "distribution_summary": q("SELECT split, count(*) AS n, round(avg(tree_alpha), 6) AS alpha_mean, round(quantile_cont(tree_alpha, 0.5), 6) AS alpha_median, round(quantile_cont(tree_alpha, 0.9), 6) AS alpha_p90, round(avg(ast_compression), 6) AS compression_mean, round(quantile_cont(ast_compression, 0.5), 6) AS compression_median, round(quantile_cont(ast_compression, 0.9), 6) AS compression_p90 FROM m GROUP BY ALL"),
    "alpha_histogram": histogram("tree_alpha"),
    "gain_histogram": histogram("eml_dag_nodes / ast_dag_nodes"),
    "size_scatter": q("SELECT ast_nodes, eml_nodes, eml_dag_nodes, count(*) AS n FROM m GROUP BY ALL"),
    "alpha_scatter": q("SELECT expr_id, round(tree_alpha, 9) AS tree_alpha, round(dag_alpha, 9) AS dag_alpha FROM m"),
    "improvement_by_size": q("SELECT ast_node_bucket, count(*) AS n, round(median(tree_alpha - dag_alpha), 6) AS median_improvement FROM m GROUP BY ALL"),
    "below_tree_and_dag": q(f"SELECT feature_subset, round(100.0::DOUBLE * avg((tree_alpha < {LIMIT})::INT), 6) AS percent_tree, round(100.0::DOUBLE * avg((dag_alpha < {LIMIT})::INT), 6) AS percent_dag FROM m GROUP BY ALL"),
    "family_metric": q(", a AS (SELECT dominant_family, operator_signature, count(*) AS w, median(dag_alpha) AS v FROM m GROUP BY ALL) SELECT dominant_family, sum(w)::BIGINT AS n, round(sum(v * w) / sum(w), 6) AS weighted_alpha FROM a GROUP BY ALL ORDER BY n DESC, dominant_family LIMIT 12"),
    "top_alpha": ranked("SELECT expr_id, expression, round(tree_alpha, 6) AS alpha, eml_nodes, tree_alpha FROM m", "tree_alpha DESC, expr_id", 20, "expr_id, expression, alpha, eml_nodes"),
    "top_depth": ranked("SELECT expr_id, eml_depth, round(tree_alpha, 6) AS alpha, tree_alpha FROM m", "eml_depth DESC, tree_alpha DESC, expr_id", 20, "expr_id, eml_depth, alpha"),
    "rank_worst_signatures": q(f"SELECT operator_signature, median_rank, p90_rank, n, median_alpha, p90_alpha FROM (SELECT *, row_number() OVER (ORDER BY median_alpha DESC, p90_alpha DESC, n DESC, operator_signature) AS median_rank, row_number() OVER (ORDER BY p90_alpha DESC, median_alpha DESC, n DESC, operator_signature) AS p90_rank FROM ({GROUP})) WHERE median_rank <= 6 OR p90_rank <= 6 ORDER BY median_rank, p90_rank, operator_signature LIMIT 6"),
    "rank_safest_signatures": ranked(f"SELECT *, round(abs(median_alpha - {LIMIT}), 6) AS gap FROM ({GROUP})", "percent_below DESC, gap, p90_alpha, n DESC, operator_signature", 6, "operator_signature, percent_below, gap, p90_alpha, n"),
    "rank_safe_regimes": ranked(f"SELECT operator_signature, {SUMMARY}, round(avg(eml_nodes / ast_nodes), 6) AS size_ratio FROM m GROUP BY ALL", "percent_below DESC, median_alpha, p90_alpha, size_ratio, operator_signature", 6, "operator_signature, percent_below, median_alpha, p90_alpha, size_ratio"),
    "depth_failure_modes": ranked(f"SELECT ast_depth, {SUMMARY} FROM m GROUP BY ALL", "p90_alpha DESC, mean_alpha DESC, mean_eml_nodes DESC, ast_depth", 6, "ast_depth, p90_alpha, mean_alpha, mean_eml_nodes, n"),
    "corpus_dedup": q("SELECT expression, min(expr_id) AS expr_id, count(*) AS copies FROM m GROUP BY ALL"),
    "generation_summary": q("SELECT ast_depth, sum(c)::BIGINT AS n, count(*) AS n_distinct, round((sum(c) - count(*)) / sum(c), 6) AS duplicate_rate FROM (SELECT ast_depth, expression, count(*) AS c FROM m GROUP BY ALL) GROUP BY ALL"),
    "ast_dag_size": q("SELECT expr_id, ast_nodes, ast_dag_nodes, round(ast_compression, 9) AS ast_compression FROM m"),
    "shared_subtrees": ranked(f"SELECT s AS subtree, label, count(*) AS occurrences, count(DISTINCT i) AS n_expressions FROM t WHERE label IN {OPS} GROUP BY ALL", "occurrences DESC, n_expressions DESC, subtree", 50, "subtree, label, occurrences, n_expressions"),
    "shared_in_expression": q(SHARED + f"SELECT expr_id, subtree, copies, rank FROM (SELECT i AS expr_id, s AS subtree, copies, row_number() OVER (PARTITION BY i ORDER BY copies DESC, label, s) AS rank FROM dn WHERE label IN {OPS} AND copies > 1) WHERE rank <= 3"),
    # shared form
    "eml_dag_size": q("SELECT expr_id, eml_dag_nodes, round(dag_alpha, 9) AS dag_alpha, round(dag_compression, 9) AS dag_compression FROM m"),
    "dag_alpha": q(f"SELECT expr_id, round(dag_alpha_vs_dag, 9) AS dag_alpha_vs_dag, dag_alpha < {LIMIT} AS below_dag, dag_alpha_vs_dag < {LIMIT} AS below_dag_vs_dag FROM m"),
    "dag_group_by_signature": grouped(DAG, "operator_signature"),
    "dag_group_by_depth": grouped(DAG, "ast_depth"),
    "dag_group_by_size": grouped(DAG, "ast_node_bucket"),
    "dag_group_by_family": grouped(DAG, "dominant_family"),
    "dag_group_by_boolean": booleans(DAG),
    "dag_summary": q(f"SELECT metric, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(quantile_disc(v, 0.9), 6) AS p90, round(quantile_disc(v, 0.95), 6) AS p95, round(max(v), 6) AS max, round(100.0::DOUBLE * avg((v < {LIMIT})::INT), 6) AS percent_below FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS metric, {x} AS v FROM m" for x in ("tree_alpha", "dag_alpha", "dag_alpha_vs_dag", "dag_compression")) + ") GROUP BY ALL"),
    "dag_successes": ranked("SELECT *, round(dag_compression * greatest(tree_alpha - dag_alpha, 0), 6) AS success_score FROM m", "success_score DESC, round(dag_compression, 9) DESC, round(tree_alpha - dag_alpha, 9) DESC, expr_id", 20, "expr_id, expression, success_score, round(dag_compression, 9) AS dag_compression"),
    "dag_failures": ranked("SELECT *, round(dag_alpha + dag_alpha_vs_dag + greatest(0, 2 - dag_compression), 6) AS failure_score FROM m", "failure_score DESC, round(dag_compression, 9), round(dag_alpha, 9) DESC, expr_id", 20, "expr_id, expression, failure_score, round(dag_alpha, 9) AS dag_alpha"),
    "dag_best_signatures": best(DAGS, "median_improvement * median_dag_compression", "score DESC, median_improvement DESC, median_dag_compression DESC, median_dag_alpha, operator_signature", "operator_signature, score, n"),
    "dag_worst_signatures": best(DAGS, "median_dag_alpha + median_dag_alpha_vs_dag + greatest(0, 2 - median_dag_compression)", "score DESC, median_dag_alpha DESC, median_dag_compression, n DESC, operator_signature", "operator_signature, score, n"),
    "dag_safe_regimes": best(DAGS, "percent_below_dag", "score DESC, median_dag_alpha, median_improvement DESC, n DESC, operator_signature", "operator_signature, score, n"),
    "macro_graph_size": q(SHARED + f"SELECT expr_id, macro_nodes, refs AS macro_refs, ast_depth AS macro_depth, round(macro_nodes / ast_nodes, 9) AS alpha_vs_tree, round(eml_dag_nodes / macro_nodes, 9) AS gain FROM m JOIN (SELECT i AS expr_id, count(*) AS macro_nodes, sum((l IS NOT NULL)::INT + (r IS NOT NULL)::INT)::BIGINT AS refs FROM dn GROUP BY i) USING (expr_id)"),
    "macro_summary": grouped(MACRO, "subset", source="(SELECT 'all_v1' AS subset, m.* FROM m UNION ALL SELECT feature_subset, m.* FROM m)"),
    "macro_by_family": grouped(MACRO, "dominant_family"),
    "macro_by_signature": grouped(MACRO, "operator_signature"),
    # motifs
    "motifs_size1_2": q(SHARED + "SELECT signature, node_count, count(*) AS support, count(DISTINCT expr_id) AS coverage FROM o GROUP BY ALL"),
    "motif_split_features": q(SHARED + "SELECT * FROM f"),
    "motif_subsets": q(SHARED + "SELECT signature, node_count, feature_subset, count(*) AS support, count(DISTINCT expr_id) AS coverage, min(expr_id) AS first_expr FROM o JOIN m USING (expr_id) GROUP BY ALL"),
    "motif_scores": q(SHARED + f"SELECT trial, signature, split, score FROM ({SCORES})"),
    "motif_selection": q(SHARED + SELECTED + " SELECT * FROM c"),
    "motif_best_trial": q(SHARED + SELECTED + " SELECT * FROM c ORDER BY validation_score DESC, train_score DESC, trial LIMIT 1"),
    "motif_train_vs_full": q(SHARED + """, z AS (SELECT signature, count(*) FILTER (split = 'train') AS train_support, count(*) AS support FROM o JOIN m USING (expr_id) WHERE node_count = 2 GROUP BY ALL),
 k AS (SELECT signature, train_support >= 50 AS in_train, support >= 50 AS in_full FROM z), w AS (SELECT expr_id, count(*) FILTER (in_train) AS a, count(*) FILTER (in_full) AS b FROM o JOIN k USING (signature) WHERE node_count = 2 GROUP BY ALL)
 SELECT split, feature_subset, count(*) AS n, coalesce(sum(a), 0)::BIGINT AS train_occurrences, coalesce(sum(b), 0)::BIGINT AS full_occurrences, round(avg(coalesce(b, 0) - coalesce(a, 0)), 6) AS mean_delta FROM m LEFT JOIN w USING (expr_id) GROUP BY ALL"""),
    # joins with expressions that another table's keys name
    "baseline_join": q(f"SELECT expr_id, split, round(tree_alpha - a, 6) AS delta_alpha FROM m JOIN ({PAIRS}) USING (expr_id) JOIN (SELECT split, avg(tree_alpha) AS a FROM m GROUP BY ALL) USING (split)"),
    "missing_baseline_anti": q(f"SELECT expr_id, expression FROM m ANTI JOIN ({PAIRS}) USING (expr_id)"),
    "resume_anti": q("SELECT expr_id, expression FROM m ANTI JOIN (SELECT event_id AS expr_id FROM events WHERE event_type = 'click') USING (expr_id)"),
    "graph_bundles": q(f"SELECT expr_id, ast_nodes, eml_dag_nodes, ast_dag_nodes AS macro_nodes, l_quantity AS quantity FROM m JOIN ({PAIRS}) USING (expr_id) JOIN (SELECT l_orderkey AS expr_id, round(sum(l_quantity), 2) AS l_quantity FROM lineitem GROUP BY ALL) USING (expr_id)"),
    "left_form_join": q(f"SELECT expr_id, p.expr_id IS NOT NULL AS has_form, CASE WHEN p.expr_id IS NOT NULL THEN form_positive_real END AS normal_form FROM m LEFT JOIN ({PAIRS}) p USING (expr_id)"),
    "form_mismatches": q(f"SELECT split, count(DISTINCT expr_id) AS n FROM m JOIN ({PAIRS}) USING (expr_id) WHERE expression <> form_safe GROUP BY ALL"),
    # export
    "graph_export_nodes": q(SHARED + MODES + " SELECT representation_mode, node_id, expr_id, label, CASE WHEN label IN ('x', 'y') THEN 'variable' WHEN label = '1' THEN 'constant' ELSE 'operator' END AS kind FROM g0"),
    "graph_export_edges": q(SHARED + MODES + " SELECT * FROM g1"),
    "export_summary": q(SHARED + MODES + " SELECT * FROM (SELECT representation_mode, count(*) AS nodes, count(DISTINCT expr_id) AS graphs FROM g0 GROUP BY ALL) JOIN (SELECT representation_mode, count(*) AS edges FROM g1 GROUP BY ALL) USING (representation_mode)"),
    "export_integrity": q("SELECT expr_id, ast_nodes AS n_nodes, count(child) AS n_edges, count(child) = ast_nodes - 1 AND count(DISTINCT child) = count(child) AS valid FROM m LEFT JOIN e ON e.i = m.expr_id GROUP BY expr_id, ast_nodes"),
    "comparison_table": q("SELECT mode, count(*) AS n, round(median(v), 6) AS median_nodes, round(avg(v / ast_nodes), 6) AS mean_alpha FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS mode, {b} AS v, ast_nodes FROM m" for a, b in (("ast_tree", "ast_nodes"), ("ast_dag", "ast_dag_nodes"), ("eml_tree", "eml_nodes"), ("eml_dag", "eml_dag_nodes"), ("estimated", "estimated_cost"))) + ") GROUP BY ALL"),
    # rewriting
    "rewrite_rows": study("SELECT expr_id, rule_mode, normal_form, new_ast_nodes, new_eml_nodes, round(gain, 9) AS gain, outcome, crossed FROM y"),
    "rewrite_summary": study(f"SELECT rule_mode, {GAINS} FROM y GROUP BY ALL"),
    "rewrite_by_signature": study(SIGNATURES),
    "rewrite_by_subset": study(f"SELECT rule_mode, subset, {GAINS} FROM (SELECT 'all_v1' AS subset, y.* FROM y UNION ALL SELECT feature_subset, y.* FROM y) GROUP BY ALL"),
    "rewrite_by_family": study(f"SELECT rule_mode, dominant_family, n_add > 0 AS has_add, n_mul > 0 AS has_mul, n_exp > 0 AS has_exp, n_log > 0 AS has_log, {GAINS} FROM y GROUP BY ALL"),
    "rewrite_by_size": study(f"SELECT rule_mode, ast_node_bucket, eml_node_bucket, {GAINS} FROM y GROUP BY ALL"),
    "rewrite_by_triviality": study(f"SELECT rule_mode, feature, value, {GAINS} FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS feature, ({x} > 0)::VARCHAR AS value, y.* FROM y" for x in ("mul_by_one", "log_one", "exp_log", "log_exp", "number_only", "constant_only")) + ") GROUP BY ALL"),
    "rewrite_outcomes": study("SELECT rule_mode, outcome, count(*) AS n FROM y GROUP BY ALL"),
    "rewrite_top_successes": study("SELECT row_number() OVER (ORDER BY crossed DESC, round(gain, 9) DESC, round(new_alpha, 9), expr_id) AS rank, expr_id, expression, normal_form, crossed, round(gain, 6) AS shown_gain, round(gain + 10 * crossed::INT - 0.01 * new_alpha, 6) AS success_score FROM y WHERE rule_mode = 'positive_real' AND outcome = 'improved' ORDER BY rank LIMIT 20"),
    "rewrite_subset_successes": study("SELECT row_number() OVER (ORDER BY crossed DESC, round(gain, 9) DESC, round(new_alpha, 9), expr_id) AS rank, expr_id, expression, normal_form, crossed FROM y WHERE rule_mode = 'positive_real' AND outcome = 'improved' AND feature_subset = 'identity_heavy_v1' ORDER BY rank LIMIT 20"),
    "rewrite_top_failures": study("SELECT row_number() OVER (ORDER BY failure_score DESC, expr_id) AS rank, expr_id, expression, failure_score FROM (SELECT *, round(CASE WHEN gain <= 1 THEN 200.0::DOUBLE ELSE 0 END + new_alpha + 100 * greatest(0.0::DOUBLE, 1 - gain), 6) AS failure_score FROM y WHERE rule_mode = 'positive_real') ORDER BY rank LIMIT 20"),
    "rewrite_mode_gap": study("SELECT expr_id, max(new_eml_nodes) FILTER (rule_mode = 'safe') AS safe_nodes, max(new_eml_nodes) FILTER (rule_mode = 'positive_real') AS positive_nodes, max(new_eml_nodes) FILTER (rule_mode = 'safe') - max(new_eml_nodes) FILTER (rule_mode = 'positive_real') AS saved FROM y GROUP BY ALL"),
    "rewrite_best_signatures": best(SIGNATURES, "10 * gain_median + percent_improved + percent_below_after", "score DESC, gain_median DESC, percent_improved DESC, rule_mode, operator_signature", "rule_mode, operator_signature, score, n", base=STUDY),
    "rewrite_worst_signatures": best(SIGNATURES, "10 * median_new_alpha + percent_worse + 0.25 * percent_equal", "score DESC, median_new_alpha DESC, rule_mode, operator_signature", "rule_mode, operator_signature, score, n", base=STUDY),
    "rewrite_safe_regimes": best(f"SELECT feature_subset, operator_signature, {GAINS} FROM y WHERE rule_mode = 'safe' GROUP BY ALL", "percent_below_after + 0.1 * percent_improved", "score DESC, feature_subset DESC, percent_below_after DESC, n DESC, operator_signature", "feature_subset, operator_signature, score, n", base=STUDY),
    "rewrite_top_families": study("SELECT rule_mode, arg_max(dominant_family, (round(w, 6), n, dominant_family)) AS success_family, arg_min(dominant_family, (round(w, 6), -n, dominant_family)) AS failure_family FROM (SELECT rule_mode, dominant_family, count(*) AS n, avg(gain) AS w FROM y GROUP BY ALL) GROUP BY ALL"),
    # expressions that somebody wrote, as text
    "given_measures": """WITH o AS (SELECT o_orderkey AS k, 2 + o_custkey % 97 AS a, 2 + o_orderkey % 7 AS b, o_orderkey % 3 AS c FROM orders)
SELECT k AS expr_id, CASE c WHEN 1 THEN 6 ELSE 7 END::BIGINT AS ast_nodes, 2 AS ast_depth,
 CASE c WHEN 0 THEN (26 * a - 25) + 1 + 39 + 1 + (26 * b - 25) + 47 + 25 WHEN 1 THEN 1 + 6 + (26 * a - 25) + 63 ELSE 1 + (26 * b - 25) + 39 + 1 + 9 END::BIGINT AS eml_nodes FROM o""",
}
ORACLE["motif_vocabulary"] = q(SHARED + "SELECT row_number() OVER (ORDER BY score DESC, support DESC, node_count DESC, signature) AS rank, * FROM (SELECT signature, node_count, count(*) AS support, count(DISTINCT expr_id) AS coverage, count(*) * (node_count - 1) AS score FROM o GROUP BY signature, node_count HAVING count(*) >= 50) ORDER BY rank LIMIT 30")
