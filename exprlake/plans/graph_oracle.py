"""DuckDB SQL for the queries over graphs: motifs of up to three nodes, their replacement, and the shared EML DAG.

Joins over node and reference tables; nothing here is shared with the Spark side, which works inside rows.
"""

from __future__ import annotations

from exprlake.plans.oracle import _TERMS, BASE, SCORES, _e, _ln, _minus, _one, _plus, _times, q


def _cut(term: str) -> str:
    """A hash('eml', a, b) as a struct (id, a, b)."""
    inner, depth = term[len("hash('eml', ") : -1], 0
    for at, c in enumerate(inner):
        depth += (c in "([") - (c in ")]")
        if c == "," and depth == 0:
            return f"{{'id': {term}, 'a': {inner[:at]}, 'b': {inner[at + 2 :]}}}"
    raise ValueError(term)


# nodes and references of macro graphs, a node's id being its first place
GRAPH = """, gn AS MATERIALIZED (SELECT i, s, min(p) id, any_value(label) label, any_value(sa) sa, any_value(sb) sb, any_value(g) g FROM t GROUP BY i, s),
gr AS MATERIALIZED (SELECT a.i, a.id parent, b.id child, 0 AS sx FROM gn a JOIN gn b ON a.i = b.i AND a.sa = b.s UNION ALL SELECT a.i, a.id, b.id, 1 FROM gn a JOIN gn b ON a.i = b.i AND a.sb = b.s)"""

# sets of up to three nodes, their nodes numbered by the smaller of a direct path and one over a third node
SETS = """, s2 AS (SELECT DISTINCT i, parent root, list_sort([parent, child]) z FROM gr),
s3 AS (SELECT DISTINCT s2.i, root, list_sort(list_append(z, child)) z FROM s2 JOIN gr ON gr.i = s2.i AND list_contains(z, parent) AND NOT list_contains(z, child)),
ss AS MATERIALIZED (SELECT i, id root, [id] z FROM gn WHERE sa IS NOT NULL UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3),
sv AS (SELECT i, root, z, unnest(z) v FROM ss),
d1 AS (SELECT sv.i, root, z, v, min(sx::VARCHAR) w FROM sv JOIN gr ON gr.i = sv.i AND parent = root AND child = v GROUP BY ALL),
d2 AS (SELECT sv.i, root, z, v, min(a.sx::VARCHAR || b.sx::VARCHAR) w FROM sv JOIN gr b ON b.i = sv.i AND b.child = v AND list_contains(z, b.parent) AND b.parent <> root JOIN gr a ON a.i = sv.i AND a.parent = root AND a.child = b.parent GROUP BY ALL),
sl AS MATERIALIZED (SELECT i, root, z, v, row_number() OVER (PARTITION BY i, root, z ORDER BY w) - 1 AS loc FROM (SELECT i, root, z, v, min(w) w FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT i, root, z, root, '' FROM ss) GROUP BY ALL)),
sn AS (SELECT sl.i, root, z, string_agg(label, ',' ORDER BY loc) names FROM sl JOIN gn ON gn.i = sl.i AND gn.id = v GROUP BY ALL),
si AS (SELECT a.i, a.root, a.z, string_agg(a.loc || '.' || sx || '>' || b.loc, ',' ORDER BY a.loc, sx) inside, count(*) n_inner FROM sl a JOIN gr ON gr.i = a.i AND parent = a.v JOIN sl b ON b.i = a.i AND b.root = a.root AND b.z = a.z AND b.v = child GROUP BY ALL),
so AS (SELECT a.i, a.root, a.z, string_agg(a.loc || '.' || sx, ',' ORDER BY a.loc, sx) outside FROM sl a JOIN gr ON gr.i = a.i AND parent = a.v AND NOT list_contains(a.z, child) GROUP BY ALL),
su AS (SELECT DISTINCT sl.i, root, z FROM sl JOIN gr ON gr.i = sl.i AND child = v AND v <> root AND NOT list_contains(z, parent)),
oc AS MATERIALIZED (SELECT sn.i, sn.root, sn.z, len(sn.z) k, names || '|' || coalesce(inside, '') || '|' || coalesce(outside, '') sig, coalesce(n_inner, 0) n_inner, su.i IS NULL safe
 FROM sn LEFT JOIN si USING (i, root, z) LEFT JOIN so USING (i, root, z) LEFT JOIN su ON su.i = sn.i AND su.root = sn.root AND su.z = sn.z),
cn AS (SELECT sig, k, count(*) support, count(DISTINCT i) coverage FROM oc GROUP BY ALL),
vo AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, support DESC, k DESC, sig) AS rank FROM (SELECT *, support * (k - 1) score FROM cn WHERE support >= 50) ORDER BY rank LIMIT 30)"""

GREEDY = """, ca AS MATERIALIZED (SELECT oc.i, oc.root, z, oc.k, n_inner, row_number() OVER (PARTITION BY oc.i ORDER BY score DESC, oc.k DESC, oc.root, rank) n FROM oc JOIN vo USING (sig) WHERE safe AND oc.k > 1),
go AS (SELECT DISTINCT i, 0::BIGINT n, []::BIGINT[] used, false took FROM t
 UNION ALL SELECT go.i, ca.n, CASE WHEN list_has_any(used, z) THEN used ELSE list_concat(used, z) END, NOT list_has_any(used, z) FROM go JOIN ca ON ca.i = go.i AND ca.n = go.n + 1),
ke AS MATERIALIZED (SELECT ca.* FROM go JOIN ca ON ca.i = go.i AND ca.n = go.n WHERE took),
kn AS (SELECT i, count(*) c, sum(k)::BIGINT covered, sum(n_inner)::BIGINT inside FROM ke GROUP BY i),
nn AS (SELECT i, count(*) n, string_agg(id || ':' || label, ',' ORDER BY id) said FROM gn GROUP BY i),
rr AS (SELECT i, count(*) n, string_agg(parent || '.' || sx || '>' || child, ',' ORDER BY parent, child, sx) said FROM gr GROUP BY i)"""

_pairs = " ".join(f"WHEN '{k}' THEN [{', '.join(_cut(x) for x in v)}]" for k, v in _TERMS.items()).replace("a.g", "ga").replace("b.g", "gb")
# pairs that the macros of distinct subtrees make
DAG = f""", mc AS (SELECT DISTINCT n.s, n.label, a.g ga, b.g gb FROM gn n JOIN gn a ON a.i = n.i AND a.s = n.sa LEFT JOIN gn b ON b.i = n.i AND b.s = n.sb),
ml AS (SELECT s, CASE label {_pairs} END x FROM mc),
mp AS (SELECT s, unnest(x, recursive := true), unnest(range(len(x))) AS pos FROM ml),
lf AS (SELECT unnest(['x', 'y', '1']) label),
rt AS (SELECT g, count(*) c FROM t WHERE p = 1 GROUP BY g),
md AS MATERIALIZED (SELECT id, any_value(a) a, any_value(b) b, count(*) n_made, min({{'s': s, 'pos': pos}}) f FROM mp GROUP BY id),
dg AS MATERIALIZED (SELECT id, f.s || '#' || f.pos AS name, 'eml' AS label, n_made FROM md
 UNION ALL SELECT hash('leaf', label, ''), label, label, 0 FROM lf WHERE hash('leaf', label, '') IN (SELECT a FROM md UNION ALL SELECT b FROM md UNION ALL SELECT g FROM rt)),
dr AS MATERIALIZED (SELECT id parent, a child, 0 AS sx FROM md UNION ALL SELECT id, b, 1 FROM md)"""

# motifs of one or two nodes in each expression's pure DAG
PURE = f""", pl AS (SELECT n.i, CASE n.label {_pairs} END x FROM (SELECT n.i, n.label, a.g ga, b.g gb FROM gn n JOIN gn a ON a.i = n.i AND a.s = n.sa LEFT JOIN gn b ON b.i = n.i AND b.s = n.sb) n),
pp AS MATERIALIZED (SELECT DISTINCT i, unnest(x, recursive := true) FROM pl),
po AS (SELECT i, 'eml||0.0,0.1' sig, 1 k FROM pp
 UNION ALL SELECT pp.i, 'eml,' || CASE c WHEN hash('leaf', 'x', '') THEN 'x' WHEN hash('leaf', 'y', '') THEN 'y' WHEN hash('leaf', '1', '') THEN '1' ELSE 'eml' END
  || CASE WHEN a = b THEN '|0.0>1,0.1>1|' WHEN c = a THEN '|0.0>1|0.1' ELSE '|0.1>1|0.0' END
  || CASE WHEN c IN (hash('leaf', 'x', ''), hash('leaf', 'y', ''), hash('leaf', '1', '')) THEN '' WHEN a = b THEN '1.0,1.1' ELSE ',1.0,1.1' END, 2
 FROM (SELECT *, a AS c FROM pp UNION SELECT *, b FROM pp) pp)"""


def _opposite(z: str) -> list[str]:
    nil = _ln(_one)
    return nil + _minus(nil[2], z)


def _reciprocal(z: str) -> list[str]:
    less = _opposite(_ln(z)[2])
    return _ln(z) + less + [_e(less[-1], _one)]


def _quotient(a: str, b: str) -> list[str]:
    return _reciprocal(b) + _times(a, _reciprocal(b)[-1])


def _power(a: str, b: str) -> list[str]:
    f = _times(b, _ln(a)[2])
    return _ln(a) + f + [_e(f[-1], _one)]


_KINDS = [[_e("ga", _one)], _ln("ga"), _minus("ga", "gb"), _opposite("ga"), _plus("ga", "gb"), _reciprocal("ga"), _times("ga", "gb"), _quotient("ga", "gb"), _power("ga", "gb")]
_names = "['exp', 'log', 'sub', 'neg', 'Add', 'inv', 'Mul', 'div', 'pow']"
EXPANSION = f""", tops AS (SELECT a.i, a.g ga, coalesce(b.g, a.g) gb, a.i % 9 k FROM t a LEFT JOIN t b ON b.i = a.i AND b.p = 2 WHERE a.p = 1),
ids AS (SELECT i, unnest(CASE k {' '.join(f'WHEN {k} THEN [{", ".join(dict.fromkeys(v))}]' for k, v in enumerate(_KINDS))} END) id FROM tops
 UNION SELECT i, id FROM pp UNION SELECT i, g FROM gn WHERE sa IS NULL UNION SELECT i, {_one} FROM tops)"""

# six rounds of candidates: enough for nine tenths of the keys
ROUNDS = BASE.replace("FROM events WHERE", "FROM (SELECT event_id + r * 1000000007 AS event_id FROM events, (SELECT unnest(range(6)) r)) WHERE") + """, cd AS (SELECT i, s, i // 1000000007 turn, l IS NULL trivial FROM t WHERE p = 1),
fr AS (SELECT s, min(i) i, min(i) // 1000000007 turn FROM cd WHERE NOT trivial GROUP BY s),
wa AS (SELECT floor(count(*) * 0.9)::BIGINT w FROM events),
od AS (SELECT *, row_number() OVER (ORDER BY i) n FROM fr),
kp AS (SELECT od.* FROM od, wa WHERE n <= w)"""

# candidates of both graph types; a pair's place is where it first stands in root, pair 1 and its sides, pair 2 and its sides, ...
_leaves = "(hash('leaf', 'x', ''), hash('leaf', 'y', ''), hash('leaf', '1', ''))"
LEARNED = (
    GRAPH
    + SETS
    + f""", px AS (SELECT i, place, unnest(x, recursive := true), unnest(range(len(x))) AS pos FROM (SELECT n.i, n.id place, CASE n.label {_pairs} END x FROM (SELECT n.i, n.id, n.label, a.g ga, b.g gb FROM gn n JOIN gn a ON a.i = n.i AND a.s = n.sa LEFT JOIN gn b ON b.i = n.i AND b.s = n.sb) n)),
pz AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY i ORDER BY o) nth FROM (SELECT i, id, any_value(a) a, any_value(b) b, min(place * 1000 + pos) o FROM px GROUP BY i, id)),
pa AS (SELECT i, v, min(w) AS spot FROM (SELECT i, id v, 3 * nth w FROM pz UNION ALL SELECT i, a, 3 * nth + 1 FROM pz UNION ALL SELECT i, b, 3 * nth + 2 FROM pz UNION ALL SELECT i, g, -1 FROM t WHERE p = 1) GROUP BY i, v),
pp AS (SELECT i, v, count(*) parents FROM (SELECT i, a v, id FROM pz UNION SELECT i, b, id FROM pz) GROUP BY i, v),
cf AS MATERIALIZED (SELECT 'macro_graph' typ, i, root::UBIGINT root, z::UBIGINT[] z, k, n_inner, sig AS shape, root AS spot, safe FROM oc WHERE k > 1
 UNION ALL SELECT 'pure_eml_dag', z.i, z.id, [z.id, c], 2, CASE WHEN a = b THEN 2 ELSE 1 END, 'eml,' || CASE c WHEN hash('leaf', 'x', '') THEN 'x' WHEN hash('leaf', 'y', '') THEN 'y' WHEN hash('leaf', '1', '') THEN '1' ELSE 'eml' END
  || CASE WHEN a = b THEN '|0.0>1,0.1>1|' WHEN c = a THEN '|0.0>1|0.1' ELSE '|0.1>1|0.0' END || CASE WHEN c IN {_leaves} THEN '' WHEN a = b THEN '1.0,1.1' ELSE ',1.0,1.1' END, pa.spot, parents = 1
 FROM (SELECT *, a AS c FROM pz UNION SELECT *, b FROM pz) z JOIN pa ON pa.i = z.i AND pa.v = z.id JOIN pp ON pp.i = z.i AND pp.v = c),
fe AS MATERIALIZED (SELECT typ, shape AS signature, k::BIGINT node_count, split, count(*) support, count(*) * k coverage, count(*) FILTER (feature_subset = 'nontrivial_v1') * k nontrivial_coverage FROM cf JOIN m ON expr_id = i GROUP BY typ, shape, k, split),
po AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY typ ORDER BY score DESC, support DESC, node_count DESC, signature) pr FROM (SELECT typ, signature, node_count, support, support * (node_count - 1) score FROM fe WHERE split = 'train' AND support >= 50)) WHERE pr <= 30),
f2 AS (SELECT fe.* FROM fe SEMI JOIN po USING (typ, signature)),
sx AS MATERIALIZED ({SCORES.replace(chr(10) + " FROM f,", ", typ FROM f2,")}),
bx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY typ, trial ORDER BY score DESC, signature) r FROM sx WHERE split = 'train') WHERE r <= 10),
cx AS (SELECT bx.typ, bx.trial, round(sum(bx.score), 6) a, round(sum(coalesce(x.score, 0)), 6) v FROM bx LEFT JOIN (SELECT * FROM sx WHERE split = 'validation') x USING (typ, trial, signature) GROUP BY ALL),
bt AS (SELECT typ, trial FROM (SELECT *, row_number() OVER (PARTITION BY typ ORDER BY v DESC, a DESC, trial) r FROM cx) WHERE r = 1),
vp AS (SELECT po.*, z.score selection_score FROM po LEFT JOIN (SELECT sx.* FROM sx JOIN bt USING (typ, trial) WHERE split = 'train') z USING (typ, signature)),
vs AS MATERIALIZED (SELECT *, printf('%s_%s_%04d', vocabulary, typ, rank - 1) motif_id FROM (SELECT 'frequent' vocabulary, * REPLACE (NULL::DOUBLE AS selection_score), pr AS rank FROM vp
 UNION ALL SELECT 'learned', *, row_number() OVER (PARTITION BY typ ORDER BY selection_score DESC NULLS LAST, signature) FROM vp
 UNION ALL SELECT 'random', * REPLACE (NULL::DOUBLE AS selection_score), row_number() OVER (PARTITION BY typ ORDER BY sha256('0/' || signature)) FROM vp) WHERE rank <= 10)"""
)
TAKEN = """, ca AS MATERIALIZED (SELECT vocabulary, cf.*, row_number() OVER (PARTITION BY vocabulary, cf.typ, i ORDER BY score DESC, k DESC, spot, rank) n FROM cf JOIN vs ON vs.typ = cf.typ AND signature = shape WHERE safe),
go AS (SELECT DISTINCT vocabulary, typ, i, 0::BIGINT n, []::UBIGINT[] used, false took FROM ca
 UNION ALL SELECT go.vocabulary, go.typ, go.i, ca.n, CASE WHEN list_has_any(used, z) THEN used ELSE list_concat(used, z) END, NOT list_has_any(used, z) FROM go JOIN ca ON ca.vocabulary = go.vocabulary AND ca.typ = go.typ AND ca.i = go.i AND ca.n = go.n + 1),
kn AS MATERIALIZED (SELECT ca.vocabulary, ca.typ, ca.i, count(*) c, sum(k)::BIGINT covered, sum(n_inner)::BIGINT inside FROM go JOIN ca ON ca.vocabulary = go.vocabulary AND ca.typ = go.typ AND ca.i = go.i AND ca.n = go.n WHERE took GROUP BY ALL),
nn AS (SELECT i, count(*) n FROM gn GROUP BY i), rr AS (SELECT i, count(*) n FROM gr GROUP BY i),
kw AS (SELECT i, """ + ", ".join(
    f"coalesce(sum({what}) FILTER (vocabulary = '{name}' AND typ = '{kind}'), 0)::BIGINT AS {letter}{short}_{name}"
    for name in ("frequent", "learned", "random")
    for short, kind in (("m", "macro_graph"), ("p", "pure_eml_dag"))
    for letter, what in (("s", "covered - c"), ("c", "covered"), ("i", "inside"))
) + """ FROM kn GROUP BY i),
lr AS (SELECT expr_id, split, feature_subset, eml_dag_nodes p_n, nn.n m_n, """ + ", ".join(
    f"{n} - coalesce(s{short}_{name}, 0) AS {short}_{name}" for name in ("frequent", "learned", "random") for short, n in (("m", "nn.n"), ("p", "eml_dag_nodes"))
) + """, coalesce(cm_learned, 0) cm, coalesce(cp_learned, 0) cp FROM m JOIN nn ON nn.i = expr_id LEFT JOIN kw ON kw.i = expr_id),
ls AS MATERIALIZED (SELECT *, least(m_frequent, p_frequent) frequent_nodes, least(m_learned, p_learned) learned_nodes, least(m_random, p_random) random_nodes FROM lr),
lm AS MATERIALIZED (SELECT expr_id, split, feature_subset, p_n AS pure_nodes, m_n AS macro_nodes, frequent_nodes, learned_nodes, random_nodes, CASE WHEN m_learned <= p_learned THEN 'macro_graph' ELSE 'pure_eml_dag' END AS graph_type,
 round(100.0::DOUBLE * CASE WHEN m_learned <= p_learned THEN cm / m_n ELSE cp / p_n END, 6) AS coverage_percent, round(p_n / frequent_nodes, 9) AS frequent_gain, round(p_n / learned_nodes, 9) AS learned_gain, round(p_n / random_nodes, 9) AS random_gain,
 round(frequent_nodes / learned_nodes, 9) AS gain_vs_frequent, round(m_n / learned_nodes, 9) AS gain_vs_macro, round(random_nodes / learned_nodes, 9) AS gain_vs_random, true AS valid FROM ls),
lg AS (SELECT 'split' AS "grouping", split AS name, * FROM lm UNION ALL SELECT 'subset', feature_subset, * FROM lm UNION ALL SELECT 'subset', 'all_v1', * FROM lm)"""


def _spread(*columns: str) -> str:
    """SQL of the summary of columns by group."""
    each = ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(median({c}), 6) AS {c}_median, round(quantile_cont({c}::DOUBLE, 0.9), 6) AS {c}_p90" for c in columns)
    return q(LEARNED + TAKEN + f' SELECT "grouping", name, count(*) AS n, count(*) AS n_valid, 0::BIGINT AS failures, {each} FROM lg GROUP BY ALL')


GRAPH_ORACLE = {
    "learned_vocabulary": q(LEARNED + " SELECT vocabulary, motif_id, typ AS motif_type, signature, node_count, support, score, selection_score, rank FROM vs"),
    "learned_metric_rows": q(LEARNED + TAKEN + " SELECT * FROM lm"),
    "learned_summary": _spread("learned_nodes", "random_nodes", "learned_gain", "random_gain", "gain_vs_frequent", "gain_vs_macro", "gain_vs_random", "coverage_percent"),
    "frequent_summary": _spread("pure_nodes", "macro_nodes", "frequent_nodes", "frequent_gain"),
    "hierarchical_graph": q(LEARNED + TAKEN + """, pe AS (SELECT i, count(*) n FROM pz GROUP BY i)
 SELECT expr_id, ast_nodes, nn.n AS macro_nodes, eml_dag_nodes AS pure_eml_dag_nodes, nn.n - coalesce(sm_frequent, 0) AS motif_nodes, nn.n - coalesce(sm_learned, 0) AS learned_motif_nodes,
 ast_nodes - 1 + 3 * coalesce(rr.n, 0) + 2 * coalesce(pe.n, 0) - coalesce(im_frequent, 0) - coalesce(im_learned, 0) AS edges, ast_nodes + 3 * nn.n AS links, 0::BIGINT AS dangling, 0::BIGINT AS bare, true AS reconstructs
 FROM m JOIN nn ON nn.i = expr_id LEFT JOIN rr ON rr.i = expr_id LEFT JOIN pe ON pe.i = expr_id LEFT JOIN kw ON kw.i = expr_id"""),
    "metric_file_join": q(" SELECT expr_id, split, round(tree_alpha, 9) AS tree_alpha, round(dag_alpha, 9) AS file_dag_alpha, round((tree_alpha - dag_alpha) / tree_alpha, 9) AS saved_share, round(dag_compression, 9) AS compression, true AS same_text FROM m WHERE expr_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"),
    "hierarchical_edges": q(LEARNED + TAKEN + """, ke AS MATERIALIZED (SELECT CASE ca.vocabulary WHEN 'frequent' THEN 3 ELSE 4 END lv, ca.i, ca.z, ca.n_inner FROM go JOIN ca ON ca.vocabulary = go.vocabulary AND ca.typ = go.typ AND ca.i = go.i AND ca.n = go.n WHERE took AND ca.typ = 'macro_graph' AND ca.vocabulary <> 'random'),
un AS (SELECT lv, i, unnest(z) v FROM ke), w AS (SELECT unnest([3, 4]) lv)
 SELECT "level", slot, count(*) AS n FROM (SELECT 0 AS "level", (p % 2)::VARCHAR AS slot FROM t WHERE p > 1 UNION ALL SELECT 1, sx::VARCHAR FROM gr UNION ALL SELECT 2, unnest(['0', '1']) FROM pz
 UNION ALL SELECT w.lv, sx::VARCHAR FROM gr CROSS JOIN w LEFT JOIN un ON un.lv = w.lv AND un.i = gr.i AND un.v = gr.parent WHERE un.v IS NULL
 UNION ALL SELECT lv, 'boundary_' || unnest(range(c)) FROM (SELECT ke.lv, ke.i, ke.z, count(*) - any_value(n_inner) c FROM ke JOIN gr ON gr.i = ke.i AND list_contains(ke.z, gr.parent::UBIGINT) GROUP BY ALL)) GROUP BY ALL"""),
    "macro_expansion": q(GRAPH + PURE + EXPANSION + f" SELECT tops.i AS expr_id, {_names}[k + 1] AS kind, (SELECT count(*) + 1 FROM gn WHERE gn.i = tops.i) AS macro_nodes, (SELECT count(*) FROM ids WHERE ids.i = tops.i) AS eml_nodes, true AS valid FROM tops"),
    "generation_rounds": ROUNDS + " SELECT i AS candidate_id, s AS expression, turn::INTEGER AS round FROM kp",
    "generation_attempts": ROUNDS + """ SELECT c.turn::INTEGER AS round, attempts, trivial, attempts - trivial - coalesce(fresh, 0) AS duplicates, coalesce(kept, 0) AS kept
 FROM (SELECT turn, count(*) attempts, count(*) FILTER (trivial) trivial FROM cd GROUP BY turn) c LEFT JOIN (SELECT turn, count(*) fresh FROM fr GROUP BY turn) f USING (turn) LEFT JOIN (SELECT turn, count(*) kept FROM kp GROUP BY turn) k USING (turn)
 WHERE c.turn <= (SELECT max(turn) FROM kp)""",
    "motifs_size3": q(GRAPH + SETS + " SELECT sig AS signature, k AS node_count, support, coverage FROM cn"),
    "motif_vocabulary_size3": q(GRAPH + SETS + " SELECT printf('macro_graph_%04d', rank - 1) AS motif_id, rank, sig AS signature, k AS node_count, support, coverage, score FROM vo"),
    "motifs_pure": q(GRAPH + PURE + " SELECT po.sig AS signature, k::BIGINT AS node_count, feature_subset, count(*) AS support, count(DISTINCT i) AS coverage FROM po JOIN m ON expr_id = i GROUP BY ALL"),
    "vocabulary_quota": q(GRAPH + SETS + PURE + """, pv AS (SELECT *, row_number() OVER (ORDER BY score DESC, support DESC, k DESC, sig) AS rank FROM (SELECT sig, k, count(*) support, count(*) * (k - 1) score FROM po GROUP BY sig, k HAVING count(*) >= 50)),
 three AS (SELECT 'pure_eml_dag' motif_type, rank, sig, k, support, score, NULL::VARCHAR src FROM pv WHERE rank <= 10 UNION ALL SELECT 'macro_graph', rank, sig, k, support, score, NULL::VARCHAR FROM vo WHERE rank <= 10
  UNION ALL SELECT 'mixed_macro_expansion', rank, 'mixed:' || sig, k, support, score, printf('macro_graph_%04d', rank - 1) FROM vo WHERE rank <= 10)
 SELECT motif_type, sig AS signature, k::BIGINT AS node_count, support, score, src AS source_motif_id, printf('%s_%04d', motif_type, rank - 1) AS motif_id FROM three"""),
    "greedy_compression": q(GRAPH + SETS + GREEDY + """ SELECT expr_id, split, feature_subset, nn.n AS original_nodes, coalesce(rr.n, 0) AS original_refs, nn.n - coalesce(covered, 0) + coalesce(c, 0) AS compressed_nodes,
 coalesce(rr.n, 0) - coalesce(inside, 0) AS compressed_refs, coalesce(c, 0) AS replacements, coalesce(covered, 0) AS covered_nodes, round(100.0::DOUBLE * coalesce(covered, 0) / nn.n, 6) AS coverage_percent
 FROM m JOIN nn ON nn.i = expr_id LEFT JOIN rr ON rr.i = expr_id LEFT JOIN kn ON kn.i = expr_id"""),
    "motif_graph": q(GRAPH + SETS + GREEDY + """, un AS (SELECT i, unnest(z) v, n FROM ke) SELECT item, count(*) AS n FROM (
 SELECT gn.label item FROM gn LEFT JOIN un ON un.i = gn.i AND un.v = gn.id WHERE un.v IS NULL UNION ALL SELECT 'motif' FROM ke
 UNION ALL SELECT CASE WHEN a.v IS NULL THEN sx::VARCHAR ELSE 'boundary' END FROM gr LEFT JOIN un a ON a.i = gr.i AND a.v = parent LEFT JOIN un b ON b.i = gr.i AND b.v = child WHERE a.n IS NULL OR b.n IS NULL OR a.n <> b.n) GROUP BY item"""),
    "motif_reconstruction": q(GRAPH + SETS + GREEDY + " SELECT nn.i AS expr_id, coalesce(c, 0) AS replacements, sha256(nn.said || '|' || coalesce(rr.said, '')) AS original_sha256, 0::BIGINT AS errors, true AS equal FROM nn LEFT JOIN rr USING (i) LEFT JOIN kn USING (i)"),
    "graph_classes": q(", z AS (SELECT expr_id, expression, replace(expression, 'exp', 'E') e FROM m) SELECT sha256(replace(CASE WHEN regexp_extract(e, '[xy]') = 'y' THEN translate(e, 'xy', 'yx') ELSE e END, 'E', 'exp')) AS shape, count(*) AS n, count(DISTINCT expression) AS n_expressions, min(expr_id) AS first_expr FROM z GROUP BY ALL"),
    "eml_dag_nodes": q(GRAPH + DAG + " SELECT name, label, n_made, coalesce(c, 0) AS n_roots FROM dg LEFT JOIN rt ON g = id"),
    "eml_dag_edges": q(GRAPH + DAG + ' SELECT a.name AS parent, b.name AS child, sx AS "at" FROM dr JOIN dg a ON a.id = parent JOIN dg b ON b.id = child'),
    "dag_audit": q(GRAPH + DAG + " SELECT (SELECT count(*) FROM dg) AS nodes, (SELECT count(*) FROM dr) AS refs, (SELECT count(*) FROM dg WHERE id NOT IN (SELECT parent FROM dr)) AS leaves, (SELECT count(*) FROM dg WHERE id IN (SELECT g FROM rt)) AS roots, (SELECT count(*) FROM dr WHERE child NOT IN (SELECT id FROM dg)) AS dangling, (SELECT count(*) FROM dg WHERE label NOT IN ('eml', 'x', 'y', '1')) AS impure, (SELECT count(*) FROM (SELECT id, label, count(parent) c FROM dg LEFT JOIN dr ON parent = id GROUP BY ALL) WHERE c <> CASE label WHEN 'eml' THEN 2 ELSE 0 END) AS wrong_arity, (SELECT count(*) - count(DISTINCT (parent, sx)) FROM dr) AS double_slots, (SELECT count(*) FROM dg WHERE id NOT IN (SELECT child FROM dr) AND id NOT IN (SELECT g FROM rt)) AS orphans"),
    "hierarchical_links": q(GRAPH + SETS + GREEDY + """, un AS (SELECT i, unnest(z) v, root FROM ke)
 SELECT 'ast_tree' AS level_from, 'ast_dag' AS level_to, i || ':' || p AS source, i || ':' || s AS target FROM t UNION ALL SELECT 'ast_dag', 'macro_graph', i || ':' || s, i || ':' || s FROM gn
 UNION ALL SELECT 'macro_graph', 'motif_graph', gn.i || ':' || s, gn.i || ':motif_graph:' || coalesce(un.root, id) FROM gn LEFT JOIN un ON un.i = gn.i AND un.v = gn.id"""),
}
