"""Graphs of expressions: motifs and their replacement against plain Python, reconstruction, and the audit of the shared DAG."""

import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from exprlake.operators import export, graphs, patterns
from exprlake.operators.stages import stage
from exprlake.plans import registry

SF = "/root/testdata/sf0.001"


def plain_motifs(nodes, refs, most):
    """(signature, root, nodes, inner references, safe) of every connected set of at most most nodes, by trying all sets."""
    label = dict(nodes)
    below = {n: sorted((at, c) for p, c, at in refs if p == n) for n in label}
    out = []
    for k in range(1, most + 1):
        for chosen in combinations(label, k):
            for root in chosen:
                order = []

                def visit(n, order=order, chosen=chosen):
                    if n not in order:
                        order.append(n)
                        for _, c in below[n]:
                            if c in chosen:
                                visit(c)

                visit(root)
                mine = [(order.index(p), at, c) for p in order for at, c in below[p]]
                if len(order) == k and mine:
                    inner = [f"{p}.{at}>{order.index(c)}" for p, at, c in mine if c in chosen]
                    outer = [f"{p}.{at}" for p, at, c in mine if c not in chosen]
                    safe = all(p in chosen for p, c, _ in refs if c in chosen and c != root)
                    out.append(("|".join((",".join(label[n] for n in order), ",".join(inner), ",".join(outer))), root, tuple(order), len(inner), safe))
    return out


def as_tuples(row):
    return [tuple(n) for n in row["nodes"]], [tuple(r) for r in row["refs"]]


@pytest.fixture(scope="module")
def few(spark):
    """Macro graphs of two hundred expressions, written once."""
    return stage(graphs.macro_graphs(registry.facts_of(spark, SF)).where("expr_id % 5 = 0"), "few")


@pytest.fixture(scope="module")
def greedy(few):
    found = patterns.occurrences(few, 3)
    motifs = stage(patterns.vocabulary(found, min_support=5, size=20), "motifs")
    return stage(patterns.replaced(found, motifs), "replaced"), motifs


def test_motifs_equal_brute_force(few):
    seen = 0
    for row in patterns.occurrences(few, 3).collect():
        found = sorted((o["signature"], o["root"], tuple(o["nodes"]), len(o["inner"]), o["safe"]) for o in row["found"])
        assert found == sorted(plain_motifs(*as_tuples(row), 3))
        seen += len(found)
    assert seen > 2_000


def test_motifs_of_four_nodes(few):
    for row in patterns.occurrences(few.where("size(nodes) < 9"), 4).collect():
        assert sorted((o["signature"], o["root"], tuple(o["nodes"])) for o in row["found"]) == sorted(x[:3] for x in plain_motifs(*as_tuples(row), 4))


def test_motifs_of_the_pure_dag(spark):
    rows = graphs.pure_graphs(registry.facts_of(spark, SF)).where("size(nodes) < 25 and expr_id % 3 = 0")
    for row in patterns.occurrences(rows, 2).collect():
        assert sorted((o["signature"], o["root"]) for o in row["found"]) == sorted(x[:2] for x in plain_motifs(*as_tuples(row), 2))


def test_greedy_replacement_equals_a_plain_scan(few, greedy):
    kept, motifs = greedy
    score = {r["signature"]: (-r["score"], r["motif_id"]) for r in motifs.collect() if r["node_count"] > 1}
    replaced = 0
    for row in kept.collect():
        found = [m for m in plain_motifs(*as_tuples(row), 3) if m[4] and m[0] in score]
        taken, mine = set(), []
        for m in sorted(found, key=lambda m: (score[m[0]][0], -len(m[2]), m[1], score[m[0]][1])):
            if not taken & set(m[2]):
                taken |= set(m[2])
                mine.append((score[m[0]][1], m[1], m[2]))
        assert [(k["motif_id"], k["root"], tuple(k["nodes"])) for k in row["kept"]] == mine
        replaced += len(mine)
    assert replaced > 100


def test_no_two_kept_occurrences_overlap(greedy):
    kept = greedy[0].select("expr_id", F.explode("kept").alias("k")).select("expr_id", F.explode("k.nodes").alias("n"))
    assert kept.groupBy("expr_id", "n").count().where("count > 1").count() == 0


def test_compressed_tables_have_the_counted_sizes(greedy):
    nodes, refs, _ = patterns.compressed(greedy[0])
    sizes = nodes.groupBy("expr_id").agg(F.count("*").alias("n")).join(refs.groupBy("expr_id").agg(F.count("*").alias("r")), "expr_id", "left").fillna(0)
    both = patterns.compression(greedy[0]).join(sizes, "expr_id")
    assert both.count() == greedy[0].count() and both.where("n <> compressed_nodes or r <> compressed_refs").count() == 0
    ends = refs.select("expr_id", F.explode(F.array("parent", "child")).alias("id"))
    assert ends.join(nodes, ["expr_id", "id"], "left_anti").count() == 0


def test_reconstruction_and_damage(greedy):
    kept, motifs = greedy
    nodes, refs, bindings = (stage(t, "table") for t in patterns.compressed(kept))
    told = lambda *tables: patterns.reconstruction(kept, motifs, tables)
    sound = told(nodes, refs, bindings)
    assert sound.count() == kept.count() and sound.where("not equal or errors > 0").count() == 0
    victim = bindings.where("local = 1").orderBy("expr_id").first()
    here = (F.col("expr_id") == victim["expr_id"]) & (F.col("root") == victim["root"]) & (F.col("local") == 1)
    wrong = told(nodes, refs, bindings.withColumn("id", F.when(here, F.lit(99)).otherwise(F.col("id"))))
    assert [(r["expr_id"], r["errors"]) for r in wrong.where("not equal").collect()] == [(victim["expr_id"], 0)]
    lost = told(nodes, refs, bindings.where(~here))
    assert [(r["expr_id"], r["errors"]) for r in lost.where("not equal").collect()] == [(victim["expr_id"], 1)]
    unknown = patterns.reconstruction(kept, motifs.where(F.col("motif_id") != victim["motif_id"]), (nodes, refs, bindings))
    assert unknown.where("not equal").count() == unknown.where("errors > 0").count() > 0


def test_no_link_between_levels_dangles(spark, greedy):
    rows = registry.facts_of(spark, SF)
    rows = rows.where("expr_id % 5 = 0")
    links = export.hierarchical_links(rows, greedy[0])
    nodes = export.graph_nodes(rows).select(F.col("representation_mode").alias("level"), "node_id")
    motif = patterns.compressed(greedy[0])[0].select(F.lit("motif_graph").alias("level"), F.concat_ws(":", "expr_id", F.lit("motif_graph"), "id").alias("node_id"))
    assert links.count() > 2_000 and export.dangling(links, nodes.unionByName(motif)).count() == 0
    assert export.dangling(links, nodes).select("level_to").distinct().collect() == [("motif_graph",)]


@pytest.fixture(scope="module")
def shared(spark):
    nodes, refs = graphs.dag_tables(registry.facts_of(spark, SF))
    return stage(nodes, "nodes"), stage(refs, "refs")


def test_shared_dag_holds_every_pure_graph(spark, shared):
    rows = registry.facts_of(spark, SF)
    pure = graphs.pure_graphs(rows)
    assert pure.join(rows.select("expr_id", "eml_dag_nodes"), "expr_id").where("size(nodes) <> eml_dag_nodes").count() == 0
    ids = pure.select(F.explode("nodes").alias("n")).select("n.id", "n.label").distinct()
    assert ids.count() == shared[0].count() and ids.join(shared[0], ["id", "label"], "left_anti").count() == 0
    assert shared[0].select("name").distinct().count() == shared[0].count()
    arcs = pure.select(F.explode("refs").alias("r")).select("r.*").distinct()
    assert arcs.exceptAll(shared[1]).count() == 0 and arcs.count() == shared[1].count()


def test_values_equal_a_plain_evaluation(spark, shared):
    """Every node against its own references, leaves given; and each expression's root against its value, where both are finite."""
    rows = registry.facts_of(spark, SF)
    found = {r["name"]: r["value"] for r in graphs.dag_values(rows).collect()}
    nodes = {r["id"]: r["name"] for r in shared[0].collect()}
    assert set(nodes.values()) <= set(found)
    sides = {}
    for r in shared[1].collect():
        sides.setdefault(nodes[r["parent"]], {})[r["at"]] = found[nodes[r["child"]]]
    close = lambda a, b: (a != a and b != b) or a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)

    def exp(v):
        return math.inf if v > 709.782 else math.exp(v)

    for name, pair in sides.items():
        ln = -math.inf if pair[1] == 0 else math.nan if not pair[1] >= 0 else math.log(pair[1])
        assert close(found[name], exp(pair[0]) - ln), name
    assert {n: found[n] for n in ("x", "y", "1")} == {"x": 1.3, "y": 2.1, "1": 1.0}
    roots = {r["id"]: r["root"] for r in graphs.pure_graphs(rows).select(F.col("expr_id").alias("id"), "root").collect()}
    same = 0
    for r in rows.select("expr_id", "value").collect():
        pure = found[nodes[roots[r["expr_id"]]]]
        if math.isfinite(pure) and math.isfinite(r["value"]) and abs(r["value"]) < 1e3:
            same += math.isclose(pure, r["value"], rel_tol=1e-6, abs_tol=1e-6)
    assert same > 300


def test_audit_reports_damage(spark, shared):
    nodes, refs = shared
    clean = graphs.audit(nodes, refs).first().asDict()
    assert clean["nodes"] > 2_000 and clean["refs"] == 2 * (clean["nodes"] - clean["leaves"])
    assert not any(clean[k] for k in ("dangling", "impure", "wrong_arity", "double_slots", "orphans"))
    extra = spark.createDataFrame([(1, "p#0", "eml", 0, 0), (2, "q#0", "sin", 0, 0), (3, "r#0", "eml", 0, 0)], nodes.schema)
    arcs = spark.createDataFrame([(1, 3, 0), (1, 999, 0), (3, 102, 0), (3, 103, 1)], refs.schema)
    told = graphs.audit(nodes.unionByName(extra), refs.unionByName(arcs)).first()
    assert (told["dangling"], told["impure"], told["wrong_arity"], told["double_slots"], told["orphans"]) == (1, 1, 0, 1, 2)
    assert sorted(r["id"] for r in graphs.unreachable(nodes.unionByName(extra), refs.unionByName(arcs)).collect()) == [1, 2, 3]
    assert graphs.unreachable(nodes, refs).count() == 0
    assert graphs.audit(nodes.where("false"), refs.where("false")).first()["nodes"] == 0


def test_shapes_ignore_the_names_of_variables(spark):
    said = ["Add(x, exp(y))", "Add(y, exp(x))", "Add(x, exp(x))", "exp(y)", "exp(x)", "1"]
    rows = spark.createDataFrame(list(enumerate(said)), "expr_id long, expression string")
    assert sorted((r["n"], r["first_expr"]) for r in graphs.classes(rows).collect()) == [(1, 2), (1, 5), (2, 0), (2, 3)]


def test_a_corpus_without_rows(spark):
    rows = registry.corpus.facts(spark.createDataFrame([], "event_id long"))
    found = patterns.occurrences(graphs.macro_graphs(rows), 3)
    motifs = patterns.vocabulary(found)
    assert found.count() == motifs.count() == patterns.compression(patterns.replaced(found, motifs)).count() == 0
    assert graphs.dag_tables(rows)[0].count() == 0


def test_distinct_expressions_stand_for_their_copies(spark):
    """Counts over distinct expressions with their copies are those over all, and results are led back to every row with its own split."""
    corpus = registry.corpus
    rows = stage(registry.facts_of(spark, SF).select("expr_id", "split", "feature_subset", "codes", "labels", "subtrees"), "facts")
    few, table = corpus.distinct(rows)
    n = table.selectExpr("sum(copies[0] + copies[1] + copies[2]) n", "count(*) d").first()
    assert n["n"] == rows.count() > 1.5 * n["d"] and n["d"] == rows.select("codes").distinct().count() == few.count()
    keys = ("split", "feature_subset")
    told = {tuple(r) for r in patterns.counted(patterns.tallied(graphs.macro_graphs(few, "copies"), 3), *keys).collect()}
    assert told == {tuple(r) for r in patterns.counted(patterns.occurrences(graphs.macro_graphs(rows), 3), *keys).collect()} and len(told) > 100
    back = corpus.returned(rows, table, few.select("expr_id", "split", "codes"))
    assert back.exceptAll(rows.select("expr_id", "split", "codes")).count() == 0 and back.count() == rows.count()


def test_signatures_of_wide_labels_and_many_arcs(spark):
    """Sets whose parts don't fit one number, and a graph without nodes."""
    import pyarrow as pa

    from exprlake.functions import sets

    kind = (pa.list_(pa.struct([("id", pa.int64()), ("label", pa.string())])), pa.list_(pa.struct([("parent", pa.int64()), ("child", pa.int64()), ("at", pa.int32())])))
    nodes = [{"id": i, "label": f"n{i}"} for i in range(3)]
    refs = [{"parent": i, "child": j, "at": 9 * i + k} for i, j in ((0, 1), (1, 2), (0, 2)) for k in range(9)]
    found = sets.found(pa.array([[], nodes, []], kind[0]), pa.array([[], refs, []], kind[1]), 3).to_pylist()
    plain = plain_motifs([(n["id"], n["label"]) for n in nodes], [(r["parent"], r["child"], r["at"]) for r in refs], 3)
    assert found[0] == found[2] == [] and len(found[1]) == len(plain)
    assert sorted((o["root"], sorted(o["nodes"]), o["safe"], len(o["inner"])) for o in found[1]) == sorted((m[1], sorted(m[2]), m[4], m[3]) for m in plain)


def test_expansion_needs_no_join_and_sees_damage(spark):
    """Macro graphs and names of one row stay together; a graph with a wrong label is not what the compiler makes of the codes."""
    from exprlake.functions import batches, eml

    rows = registry.facts_of(spark, SF)
    assert "Join" not in graphs.expansion(rows)._jdf.queryExecution().executedPlan().toString()
    made = graphs.macro_graphs(rows).where("expr_id < 50 and size(nodes) > 3").select("nodes", "refs", F.lit(1).cast("long").alias("second"), F.lit("exp").alias("kind"))
    damaged = made.withColumn("nodes", F.expr("transform(nodes, n -> named_struct('id', n.id, 'label', if(n.label = 'x', 'y', if(n.label = 'y', 'x', n.label))))"))
    told = lambda t: t.withColumn("d", eml.expanded("nodes", "refs", "second", "kind")).select("d.*", F.exists("nodes", lambda n: n.label.isin("x", "y")).alias("variable")).collect()
    pairs = [*zip(told(made), told(damaged), strict=True)]
    assert len(pairs) > 10 and all(a["eml_nodes"] == b["eml_nodes"] and (a["result"] != b["result"]) == a["variable"] for a, b in pairs)
    cycle = spark.createDataFrame([([(1, "exp")], [(1, 1, 0)], 1, "exp")], made.schema).toArrow().combine_chunks().to_batches()[0]
    with pytest.raises(ValueError, match="cycle"):
        batches.expanded(cycle.column(0), cycle.column(1), cycle.column(2).to_numpy(), cycle.column(3))


def test_macro_graphs_of_codes_are_those_of_subtrees(spark):
    """Nodes stand where a subtree's string stands first, and refer to where their children's do."""
    seen = 0
    rows = registry.facts_of(spark, SF)
    for r in graphs.macro_graphs(rows).join(rows.select("expr_id", "labels", "subtrees"), "expr_id").collect():
        first = [None if s is None else r["subtrees"].index(s) + 1 for s in r["subtrees"]]
        nodes = [(p, r["labels"][p - 1]) for k, p in enumerate(first) if p == k + 1]
        assert as_tuples(r) == (nodes, [(p, first[2 * p - 1 + at], at) for p, label in nodes for at in range({"Add": 2, "Mul": 2, "exp": 1, "log": 1}.get(label, 0))])
        seen += sum(p is not None for p in first) > len(nodes)
    assert seen > 100


def test_greedy_in_batches_takes_what_the_fold_takes(spark, few, greedy):
    """Whole rows are equal, macro and pure, also where a vocabulary has motifs of one score."""
    kept, motifs = greedy
    fast = patterns.greedy(few, 3, {"kept": motifs, "none": motifs.where("false")})
    assert fast.select("kept").schema[0].dataType.simpleString() == kept.select("kept").schema[0].dataType.simpleString()
    plain = {r["expr_id"]: r for r in kept.collect()}
    rows = fast.collect()
    assert len(rows) == len(plain) and all(r["kept"] == plain[r["expr_id"]]["kept"] and r["none"] == [] for r in rows)
    pure = stage(graphs.pure_graphs(registry.facts_of(spark, SF).where("expr_id % 7 = 0")), "pure")
    found = patterns.occurrences(pure, 2)
    same = stage(patterns.vocabulary(found, 5, 30).withColumn("score", F.col("score") % 3), "same")
    plain = {r["expr_id"]: r["kept"] for r in patterns.replaced(found, same).collect()}
    assert {r["expr_id"]: r["kept"] for r in patterns.greedy(pure, 2, {"kept": same}).collect()} == plain and sum(map(len, plain.values())) > 1_000


def test_graphs_undone_in_batches_are_those_undone_from_tables(spark, greedy):
    """Sound graphs are equal; a wrong binding, a missing one and an unknown motif are told as they are from tables."""
    kept, motifs = greedy
    told = lambda rows, known=motifs: {r["expr_id"]: tuple(r) for r in patterns.restored(rows, known).select("expr_id", "replacements", "original_sha256", "errors", "equal").collect()}
    plain = {r["expr_id"]: tuple(r) for r in patterns.reconstruction(kept, motifs).collect()}
    assert told(kept) == plain and all(r[3:] == (0, True) for r in plain.values())
    victim = kept.where("size(kept) > 0 and size(kept[0].nodes) > 1 and size(kept[0].outer) > 0").orderBy("expr_id").first()
    one = kept.where(F.col("expr_id") == victim["expr_id"])
    bad = lambda nodes, outer="k.outer", motif="k.motif_id": told(one.withColumn("kept", F.expr(f"transform(kept, (k, i) -> if(i > 0, k, named_struct('first', k.first, 'second', k.second, 'at', k.at, 'root', k.root, 'motif_id', {motif}, 'nodes', {nodes}, 'labels', k.labels, 'inner', k.inner, 'outer', {outer})))")))[victim["expr_id"]][3:]
    assert bad("k.nodes") == (0, True)
    assert bad("transform(k.nodes, (n, i) -> if(i = 1, 99L, n))") == (0, False)
    assert bad("slice(k.nodes, 1, 1)") == (1, False)
    assert bad("k.nodes", "slice(k.outer, 1, size(k.outer) - 1)") == (1, False)
    assert bad("k.nodes", "transform(k.outer, r -> named_struct('parent', r.parent, 'at', r.at, 'child', 99L))") == (0, False)
    assert bad("k.nodes", motif="'none'") == (1, False)
    unknown = told(kept, motifs.where(F.col("motif_id") != victim["kept"][0]["motif_id"]))
    assert {k for k, r in unknown.items() if r[3] or not r[4]} == {r["expr_id"] for r in kept.where(F.exists("kept", lambda k: k["motif_id"] == victim["kept"][0]["motif_id"])).collect()}


@pytest.mark.parametrize("name", ["motif_graph", "motif_reconstruction", "greedy_compression", "hierarchical_links", "hierarchical_edges"])
def test_results_of_distinct_expressions_meet_the_rows_once(spark, name):
    """What is made for distinct expressions is carried with their codes, or added up in the tasks: at most one join, with the rows themselves."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == (0 if name in ("motif_graph", "hierarchical_edges") else 1) and "Broadcast" not in plan


def test_items_are_those_of_the_compressed_tables(greedy):
    nodes, refs, _ = patterns.compressed(greedy[0])
    plain = nodes.select(F.regexp_replace("label", "^motif:.*", "motif").alias("item")).unionByName(refs.select(F.regexp_replace("slot", "_.*", "").alias("item")))
    told = sorted(map(tuple, patterns.items(greedy[0]).groupBy("item").count().collect()))
    assert told == sorted(map(tuple, plain.groupBy("item").count().collect())) and len(told) > 8


def test_groups_of_shapes_are_groups_of_rows(spark):
    """Exact percentiles, ranks and shares over shapes with their numbers are those over rows; what percentiles read is one row a shape."""
    from exprlake.operators import dag

    rows = stage(registry.facts_of(spark, SF).select("operator_signature", "ast_nodes", "eml_nodes", "ast_dag_nodes", "eml_dag_nodes", *dag.METRICS), "rows")
    few = dag.shapes(rows, "operator_signature")
    assert few.agg(F.sum("n")).first()[0] == rows.count() > few.count()
    plain = rows.groupBy("operator_signature").agg(*dag.columns()).collect()
    assert sorted(map(tuple, dag.group_summary(rows, "operator_signature").collect())) == sorted(map(tuple, plain)) and len(plain) > 10
