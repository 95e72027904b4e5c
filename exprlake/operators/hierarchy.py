"""Five levels of an expression as one graph: tree, macro graph, pure EML DAG, and the graphs that two vocabularies leave, with links from each node to what it stands for.

A node's targets lie one level nearer to the pure form: a tree node's is its macro node, a macro node's the pure node of its result, and a motif graph's are
the macro nodes that it covers. So every level can be followed back to the pure DAG, which audit() does inside the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprlake.functions import eml
from exprlake.operators import graphs, patterns
from exprlake.operators.corpus import settled

#: Names of the levels; a node's id is level:expression-wide id.
LEVELS = ("ast", "macro", "pure_eml_dag", "motif", "learned_motif")
_NODE = "named_struct('level', {level}, 'id', {id}, 'label', {label}, 'targets', {targets})"
_EDGE = "named_struct('level', {level}, 'source', {source}, 'target', {target}, 'slot', {slot})"


def _id(level: int, sql: str) -> str:
    return f"concat('{LEVELS[level]}:', {sql})"


def merged(rows: DataFrame, kept: DataFrame, names: tuple[str, str] = ("frequent", "learned")) -> DataFrame:
    """expr_id, split, feature_subset, nodes (level, id, label, targets) and edges (level, source, target, slot).

    kept has macro graphs with two columns of taken occurrences, by names. It meets the tree and the pure DAG by one equi-join on expr_id, the key."""
    pure = graphs.pure_graphs(rows, "labels", "subtrees")
    pure = pure.select("expr_id", "names", "labels", "subtrees", F.col("nodes").alias("pure_nodes"), F.col("refs").alias("pure_refs"))
    return _merged(kept.select(*patterns.ROW, *names).join(pure, "expr_id"), names)


def merged_rows(kept: DataFrame, *carried: str, names: tuple[str, str] = ("frequent", "learned")) -> DataFrame:
    """merged() with the carried columns, where kept has codes, labels and subtrees too: nothing is joined."""
    both = kept.withColumn("pure", eml.pure_graph("codes"))
    return _merged(both.select(*patterns.ROW, *carried, *names, "labels", "subtrees", "pure.names", F.col("pure.nodes").alias("pure_nodes"), F.col("pure.refs").alias("pure_refs")), names, *carried)


def slots(kept: DataFrame, *carried: str, names: tuple[str, str] = ("frequent", "learned")) -> DataFrame:
    """level, slot and the carried columns: the edges that merged_rows() has, one row each, without their ends. kept needs no labels or subtrees."""
    both = settled(kept.select(*carried, *names, "codes", "refs", eml.pure_slots("codes").alias("pure")), *carried, *names, "codes", "refs", "pure")
    edge = lambda level, slot: f"named_struct('level', {level}, 'slot', {slot})"
    parts = [
        f"transform(filter(sequence(1, size(codes) - 1), k -> codes[k] > 0), k -> {edge(0, 'cast((k + 1) % 2 as string)')})",
        f"transform(refs, r -> {edge(1, 'cast(r.at as string)')})",
        f"transform(pure, at -> {edge(2, 'cast(at as string)')})",
    ]
    for level, name in zip((3, 4), names, strict=True):
        parts.append(f"transform(filter(refs, r -> NOT exists({name}, k -> array_contains(k.nodes, r.parent))), r -> {edge(level, 'cast(r.at as string)')})")
        below = f"transform(k.outer, (r, i) -> {edge(level, "concat('boundary_', i)")})"
        parts.append(f"flatten(transform({name}, k -> {below}))")
    return both.select(*carried, F.explode(F.expr(f"concat({', '.join(parts)})")).alias("e")).select("e.level", "e.slot", *carried)


def _merged(both: DataFrame, names: tuple[str, str], *carried: str) -> DataFrame:
    """merged() of rows that have all parts."""
    both = settled(both, *graphs.GRAPH, *carried, "nodes", "refs", *names, "names", "labels", "subtrees", "pure_nodes", "pure_refs")
    places = "filter(sequence(0, size(labels) - 1), k -> labels[k] IS NOT NULL)"
    node = lambda level, i, label, targets: _NODE.format(level=level, id=_id(level, i), label=label, targets=targets)
    edge = lambda level, a, b, slot: _EDGE.format(level=level, source=_id(level, a), target=_id(level, b), slot=slot)
    none = "cast(array() as array<string>)"
    parts_n = [
        f"transform({places}, k -> {node(0, 'k + 1', 'labels[k]', 'array(' + _id(1, 'array_position(subtrees, subtrees[k])') + ')')})",
        f"transform(nodes, n -> {node(1, 'n.id', 'n.label', 'array(' + _id(2, 'names[cast(n.id as int) - 1]') + ')')})",
        f"transform(pure_nodes, n -> {node(2, 'n.id', 'n.label', none)})",
    ]
    parts_e = [
        f"transform(filter({places}, k -> k > 0), k -> {edge(0, '(k + 1) div 2', 'k + 1', "cast((k + 1) % 2 as string)")})",
        f"transform(refs, r -> {edge(1, 'r.parent', 'r.child', 'cast(r.at as string)')})",
        f"transform(pure_refs, r -> {edge(2, 'r.parent', 'r.child', 'cast(r.at as string)')})",
    ]
    for level, name in zip((3, 4), names, strict=True):
        owner = f"coalesce(get(filter({name}, k -> array_contains(k.nodes, {{0}})), 0).root, {{0}})"
        plain = f"filter(nodes, n -> NOT exists({name}, k -> array_contains(k.nodes, n.id)))"
        parts_n.append(f"transform({plain}, n -> {node(level, 'n.id', 'n.label', 'array(' + _id(1, 'n.id') + ')')})")
        covers = f"transform(k.nodes, v -> {_id(1, 'v')})"
        parts_n.append(f"transform({name}, k -> {node(level, 'k.root', "concat('motif:', k.motif_id)", covers)})")
        outside = f"filter(refs, r -> NOT exists({name}, k -> array_contains(k.nodes, r.parent)))"
        parts_e.append(f"transform({outside}, r -> {edge(level, 'r.parent', owner.format('r.child'), 'cast(r.at as string)')})")
        below = f"transform(k.outer, (r, i) -> {edge(level, 'k.root', owner.format('r.child'), "concat('boundary_', i)")})"
        parts_e.append(f"flatten(transform({name}, k -> {below}))")
    both = both.select(*graphs.GRAPH, *carried, F.expr(f"concat({', '.join(parts_n)})").alias("nodes"), F.expr(f"concat({', '.join(parts_e)})").alias("edges"))
    return settled(both, *graphs.GRAPH, *carried, "nodes", "edges")


def nodes_of(graph: DataFrame) -> DataFrame:
    """expr_id, level, node_id, label, targets: one row a node."""
    rows = graph.select("expr_id", F.explode("nodes").alias("n"))
    return rows.select("expr_id", "n.level", F.concat_ws(":", "expr_id", "n.id").alias("node_id"), "n.label", F.transform("n.targets", lambda t: F.concat_ws(":", "expr_id", t)).alias("targets"))


def edges_of(graph: DataFrame) -> DataFrame:
    """expr_id, level, source, target, slot: one row a reference, links between levels left out."""
    rows = graph.select("expr_id", F.explode("edges").alias("e"))
    return rows.select("expr_id", "e.level", F.concat_ws(":", "expr_id", "e.source").alias("source"), F.concat_ws(":", "expr_id", "e.target").alias("target"), "e.slot")


#: Rounds that lead from a macro's result to all pairs of its template.
ROUNDS = max(len(steps) for kind, steps in eml.templates().items() if kind in ("Add", "Mul", "exp", "log"))


def audit(graph: DataFrame, *carried: str) -> DataFrame:
    """Per expression: nodes of each level, edges, links, dangling (ends of edges and links that are no node), bare (nodes above the pure level without a target) and reconstructs.

    reconstructs: from the nodes of either motif level, targets followed to the macro nodes reach all of these, targets of macro nodes reach pure nodes, and what lies
    below those by references is the whole pure DAG; no end dangles and no target is missing. A pure node lies less than ROUNDS references below the result of a macro that makes it."""
    ids = "transform(nodes, n -> n.id)"
    rows = settled(graph.select("expr_id", *carried, "nodes", "edges", F.expr(ids).alias("ids")), "expr_id", *carried, "nodes", "edges", "ids")
    of = lambda level: f"filter(nodes, n -> n.level = {level})"
    sized = [F.expr(f"cast(size({of(i)}) as bigint)").alias(f"{name}_nodes") for i, name in enumerate(LEVELS)]
    ends = "concat(transform(edges, e -> e.source), transform(edges, e -> e.target), flatten(transform(nodes, n -> n.targets)))"
    macro = f"transform({of(1)}, n -> n.id)"
    targets = lambda level: f"array_distinct(flatten(transform({of(level)}, n -> n.targets)))"
    rows = rows.select(
        "expr_id",
        *carried,
        *sized,
        F.expr("cast(size(edges) as bigint)").alias("edges"),
        F.expr("cast(size(flatten(transform(nodes, n -> n.targets))) as bigint)").alias("links"),
        F.expr(f"cast(size(filter({ends}, x -> NOT array_contains(ids, x))) as bigint)").alias("dangling"),
        F.expr("cast(size(filter(nodes, n -> n.level <> 2 AND size(n.targets) = 0)) as bigint)").alias("bare"),
        F.expr(f"size(array_except({macro}, {targets(3)})) = 0 AND size(array_except({macro}, {targets(4)})) = 0 AND size(array_except({macro}, {targets(0)})) = 0").alias("covered"),
        F.expr(f"named_struct('seen', {targets(1)}, 'last', {targets(1)})").alias("reach"),
        F.expr(f"transform({of(2)}, n -> n.id)").alias("pure"),
        F.expr("filter(edges, e -> e.level = 2)").alias("arcs"),
    )
    counts = (*(f"{n}_nodes" for n in LEVELS), "edges", "links", "dangling", "bare", "covered")
    rows = settled(rows, "expr_id", *carried, *counts, "reach", "pure", "arcs")
    step = "transform(array(array_except(array_distinct(transform(filter(arcs, e -> array_contains(acc.last, e.source)), e -> e.target)), acc.seen)), z -> named_struct('seen', concat(acc.seen, z), 'last', z))[0]"
    reached = f"aggregate(sequence(1, {ROUNDS}), reach, (acc, i) -> if(size(acc.last) = 0, acc, {step})).seen"
    whole = F.expr(f"size(array_except(pure, {reached})) = 0")
    return rows.select("expr_id", *counts[:-1], (F.col("covered") & whole & (F.col("dangling") == 0) & (F.col("bare") == 0)).alias("reconstructs"), *carried)
