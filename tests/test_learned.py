"""Learned vocabularies and what they save against plain Python, and five-level graphs with damage."""

import pytest
from pyspark.sql import functions as F

from exprlake.operators import graphs, hierarchy, learned, patterns
from exprlake.operators.stages import stage
from exprlake.plans import registry
from test_graphs import as_tuples, plain_motifs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    """A quarter of the expressions, the pure DAGs small enough for plain Python."""
    return stage(registry.facts_of(spark, SF).where("expr_id % 4 = 0 and eml_dag_nodes < 30"), "rows")


@pytest.fixture(scope="module")
def study(rows):
    found = learned.found_by_type(rows)
    pool = stage(learned.candidates(found, min_support=5, size=12), "pool")
    known = stage(learned.features(found, pool), "known")
    chosen = stage(learned.vocabularies(pool, known, size=4), "chosen")
    taken = {k: stage(r, k) for k, r in learned.replacements(found, chosen).items()}
    return found, pool, known, chosen, taken


def plain_graphs(rows):
    made = {"macro_graph": graphs.macro_graphs(rows), "pure_eml_dag": graphs.pure_graphs(rows)}
    return {kind: {r["expr_id"]: (r["split"], r["feature_subset"], *as_tuples(r)) for r in g.collect()} for kind, g in made.items()}


def plain_greedy(nodes, refs, most, score):
    """Nodes that are left when safe motifs of score are replaced one after the other, and the covered ones."""
    place = {n: i for i, (n, _) in enumerate(nodes)}
    found = [m for m in plain_motifs(nodes, refs, most) if m[4] and m[0] in score and len(m[2]) > 1]
    covered, kept = set(), 0
    for m in sorted(found, key=lambda m: (-score[m[0]][0], -len(m[2]), place[m[1]], score[m[0]][1])):
        if not covered & set(m[2]):
            covered |= set(m[2])
            kept += 1
    return len(nodes) - len(covered) + kept, len(covered)


def test_candidates_and_features_are_counts(rows, study):
    _, pool, known, _, _ = study
    plain, nodes = {}, {}
    for kind, every in plain_graphs(rows).items():
        for split, subset, n, r in every.values():
            for sig, _, chosen, _, _ in plain_motifs(n, r, learned.MOST_NODES[kind]):
                if len(chosen) > 1:
                    nodes[kind, sig] = len(chosen)
                    cell = plain.setdefault((kind, sig, split), [0, 0])
                    cell[0] += 1
                    cell[1] += len(chosen) * (subset == "nontrivial_v1")
    for kind in learned.MOST_NODES:
        frequent = [(-c[0] * (nodes[k, s] - 1), -c[0], -nodes[k, s], s) for (k, s, split), c in plain.items() if k == kind and split == "train" and c[0] >= 5]
        assert {r["signature"] for r in pool.where(F.col("motif_type") == kind).collect()} == {f[3] for f in sorted(frequent)[:12]}
    told = {(r["motif_type"], r["signature"], r["split"]): (r["support"], r["coverage"], r["nontrivial_coverage"]) for r in known.collect()}
    keys = {(r["motif_type"], r["signature"]) for r in pool.collect()}
    assert told == {k: (c[0], c[0] * nodes[k[:2]], c[1]) for k, c in plain.items() if k[:2] in keys} and len(told) > 20


def test_sizes_equal_plain_replacement(rows, study):
    _, _, _, chosen, taken = study
    score = {}
    for r in chosen.collect():
        score.setdefault((r["vocabulary"], r["motif_type"]), {})[r["signature"]] = (r["score"], r["motif_id"])
    every = plain_graphs(rows)
    told = learned.metric_rows(taken, chosen).collect()
    assert len(told) == len(every["macro_graph"]) and all(r["valid"] for r in told)
    smaller = 0
    for r in told:
        left = {}
        for (name, kind), known in score.items():
            left[name, kind] = plain_greedy(*every[kind][r["expr_id"]][2:], learned.MOST_NODES[kind], known)
        for name in learned.NAMES:
            assert r[f"{name}_nodes"] == min(left[name, "macro_graph"][0], left[name, "pure_eml_dag"][0])
        kind = r["graph_type"]
        assert (kind == "macro_graph") == (left["learned", "macro_graph"][0] <= left["learned", "pure_eml_dag"][0])
        size = len(every[kind][r["expr_id"]][2])
        assert r["coverage_percent"] == pytest.approx(100 * left["learned", kind][1] / size, abs=1e-6)
        assert r["learned_gain"] == pytest.approx(r["pure_nodes"] / r["learned_nodes"], abs=1e-8)
        smaller += r["learned_nodes"] < r["macro_nodes"]
    assert smaller > 10


def test_vocabularies_are_bounded_and_drawn_alike(study):
    _, pool, known, chosen, _ = study
    sizes = {(r["vocabulary"], r["motif_type"]): r["count"] for r in chosen.groupBy("vocabulary", "motif_type").count().collect()}
    assert len(sizes) == 6 and max(sizes.values()) == 4
    again = lambda seed: sorted(map(tuple, learned.vocabularies(pool, known, 4, seed).where("vocabulary = 'random'").select("motif_type", "signature").collect()))
    assert again(0) == sorted(map(tuple, chosen.where("vocabulary = 'random'").select("motif_type", "signature").collect())) and again(0) != again(1)


def test_failures_are_counted_and_left_out(spark):
    rows = spark.createDataFrame([(1, "train", "nontrivial_v1", 4, True), (2, "test", "nontrivial_v1", 8, True), (3, "test", "identity_heavy_v1", 1000, False)], "expr_id long, split string, feature_subset string, size long, valid boolean")
    told = {(r["grouping"], r["name"]): tuple(r)[2:] for r in learned.summary(rows, "size").collect()}
    assert told["subset", "all_v1"] == (3, 2, 1, 6.0, 6.0, 7.6)
    assert told["split", "test"] == (2, 1, 1, 8.0, 8.0, 8.0)
    assert told["subset", "identity_heavy_v1"] == (1, 0, 1, None, None, None)


@pytest.fixture(scope="module")
def five(rows, study):
    return stage(hierarchy.merged(rows, study[4]["macro_graph"]), "five")


def test_five_levels_hold_their_graphs(rows, study, five):
    nodes = hierarchy.nodes_of(five)
    sizes = {(r["expr_id"], r["level"]): r["count"] for r in nodes.groupBy("expr_id", "level").count().collect()}
    told = study[4]["macro_graph"].select("expr_id", F.size("nodes").alias("m"), F.expr("size(nodes) - aggregate(learned, 0, (t, k) -> t + size(k.nodes)) + size(learned)").alias("l"))
    for r in rows.select("expr_id", "ast_nodes", "eml_dag_nodes").join(told, "expr_id").collect():
        assert [sizes[r["expr_id"], k] for k in (0, 1, 2, 4)] == [r["ast_nodes"], r["m"], r["eml_dag_nodes"], r["l"]]
    assert nodes.groupBy("node_id").count().where("count > 1").count() == 0
    ends = hierarchy.edges_of(five).select(F.explode(F.array("source", "target")).alias("node_id"))
    links = nodes.select(F.explode("targets").alias("node_id"))
    assert ends.unionByName(links).join(nodes, "node_id", "left_anti").count() == 0
    sound = hierarchy.audit(five)
    assert sound.where("not reconstructs").count() == 0 and sound.count() == rows.count()


def test_damage_to_a_level_is_told(five):
    victim = five.where("exists(nodes, n -> n.level = 4 and size(n.targets) > 1) and exists(edges, e -> e.level = 2)").orderBy("expr_id").limit(1)
    bad = lambda **columns: hierarchy.audit(victim.withColumns({k: F.expr(v) for k, v in columns.items()})).first()
    lost = bad(nodes="transform(nodes, n -> if(n.level = 4, named_struct('level', n.level, 'id', n.id, 'label', n.label, 'targets', slice(n.targets, 1, 1)), n))")
    assert (lost["reconstructs"], lost["dangling"], lost["bare"]) == (False, 0, 0)
    bare = bad(nodes="transform(nodes, n -> if(n.level = 1, named_struct('level', n.level, 'id', n.id, 'label', n.label, 'targets', slice(n.targets, 1, 0)), n))")
    assert not bare["reconstructs"] and bare["bare"] == bare["macro_nodes"]
    cut = bad(edges="filter(edges, e -> e.level <> 2)")
    assert not cut["reconstructs"] and cut["dangling"] == 0
    gone = bad(nodes="filter(nodes, n -> n.level <> 2)")
    assert not gone["reconstructs"] and gone["dangling"] > 0


def test_a_corpus_without_rows_or_candidates(spark, rows):
    empty = registry.corpus.facts(spark.createDataFrame([], "event_id long"))
    assert learned.study(empty).count() == 0 and learned.choice(empty)[1].count() == 0
    few = rows.limit(3)
    told = learned.study(few).collect()
    assert len(told) == 3 and all(r["learned_nodes"] == r["macro_nodes"] and r["valid"] for r in told)


def test_metrics_in_batches_are_those_of_tables(rows, study):
    """Sizes, coverage and validity of both graphs, made in batches of codes, are those that occurrences, tables and joins give."""
    chosen, taken = study[3:]
    plain, told = (sorted(map(tuple, t.collect())) for t in (learned.metric_rows(taken, chosen), learned.metrics_of(rows, chosen)))
    assert told == plain and len(told) > 50


def test_a_summary_counts_copies(spark):
    """Rows with copies are what the same rows repeated are."""
    kind = "expr_id long, feature_subset string, size long, valid boolean"
    few = [(1, "a", 4, True, [2, 0, 1]), (2, "a", 8, True, [0, 3, 0]), (3, "b", 9, True, [1, 1, 1]), (4, "b", 1000, False, [0, 0, 2])]
    rows = [(i, subset, size, valid, split) for i, subset, size, valid, n in few for split, k in zip(registry.corpus.SPLITS, n, strict=True) for _ in range(k)]
    a, b = (sorted(map(tuple, learned.summary(spark.createDataFrame(r, f"{kind}, {last}"), "size").collect())) for r, last in ((few, "copies array<long>"), (rows, "split string")))
    assert a == b and ("subset", "all_v1", 11, 9, 2) in [r[:5] for r in a]


def test_slots_are_those_of_the_edges(rows, study, five):
    """Edges that are counted without their ends are the graph's edges."""
    kept = study[4]["macro_graph"].join(rows.select("expr_id", "codes", "labels", "subtrees"), "expr_id")
    plain = sorted(map(tuple, hierarchy.edges_of(five).groupBy("level", "slot").count().collect()))
    assert sorted(map(tuple, hierarchy.slots(kept).groupBy("level", "slot").count().collect())) == plain and len(plain) > 8
    again = lambda t: sorted(map(str, t.select("expr_id", "nodes", "edges").collect()))
    assert again(hierarchy.merged_rows(kept)) == again(five)
