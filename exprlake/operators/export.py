"""Neutral graph export in several representations: node and edge tables, integrity checks, nested records and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprlake.functions.measures import FAMILIES
from exprlake.operators.corpus import settled

MODES = ("ast_tree", "ast_dag", "macro_graph")


def graph_nodes(rows: DataFrame) -> DataFrame:
    """representation_mode, node_id, expr_id, label, kind: nodes of the tree, of the shared expression and of its macro graph."""
    rows = settled(rows, "expr_id", "labels", "subtrees")
    tree = "filter(transform(labels, (l, k) -> named_struct('id', cast(k + 1 as string), 'label', l)), x -> x.label is not null)"
    shared = "array_distinct(filter(transform(labels, (l, k) -> named_struct('id', subtrees[k], 'label', l)), x -> x.label is not null))"
    macro = f"transform({shared}, x -> named_struct('id', x.id, 'label', if(x.label in {FAMILIES}, concat('eml_', lower(x.label)), x.label)))"
    out = _modes(rows, dict(zip(MODES, (tree, shared, macro), strict=True)))
    plain = F.col("x.label")
    kind = F.when(plain.isin("x", "y"), "variable").when(plain == "1", "constant").otherwise("operator")
    return out.select("representation_mode", F.concat_ws(":", "expr_id", "x.id").alias("node_id"), "expr_id", plain.alias("label"), kind.alias("kind"))


def graph_edges(rows: DataFrame) -> DataFrame:
    """representation_mode, expr_id, source, target, edge_type: references from parents to children, by slot."""
    rows = settled(rows, "expr_id", "labels", "subtrees")
    slot = "CASE WHEN labels[p] IN ('exp', 'log') THEN 'arg0' WHEN k % 2 = 1 THEN 'left' ELSE 'right' END"
    places = "filter(sequence(1, size(labels) - 1), k -> labels[k] is not null)"
    tree = f"transform(transform({places}, k -> named_struct('k', k, 'p', (k - 1) div 2)), z -> named_struct('s', cast(z.p + 1 as string), 't', cast(z.k + 1 as string), 'slot', {slot.replace('[p]', '[int(z.p)]').replace('k %', 'z.k %')}))"
    shared = f"array_distinct(transform(transform({places}, k -> named_struct('k', k, 'p', (k - 1) div 2)), z -> named_struct('s', subtrees[int(z.p)], 't', subtrees[z.k], 'slot', {slot.replace('[p]', '[int(z.p)]').replace('k %', 'z.k %')})))"
    out = _modes(rows, dict(zip(MODES, (tree, shared, shared), strict=True)))
    return out.select("representation_mode", "expr_id", F.concat_ws(":", "expr_id", "x.s").alias("source"), F.concat_ws(":", "expr_id", "x.t").alias("target"), F.col("x.slot").alias("edge_type"))


def _modes(rows: DataFrame, lists: dict[str, str]) -> DataFrame:
    """One row an item of every mode's list."""
    both = F.array(*(F.struct(F.lit(m).alias("mode"), F.expr(sql).alias("items")) for m, sql in lists.items()))
    out = rows.select("expr_id", F.explode(both).alias("m")).select("expr_id", F.col("m.mode").alias("representation_mode"), F.explode("m.items").alias("x"))
    return out


def sizes(rows: DataFrame) -> DataFrame:
    """expr_id, representation_mode, nodes, edges of every mode, counted inside the row."""
    rows = settled(rows, "expr_id", "labels", "subtrees", "ast_nodes")
    shared = "array_distinct(filter(transform(labels, (l, k) -> named_struct('l', l, 's', subtrees[k])), x -> x.l is not null))"
    refs = "aggregate(shared, 0L, (t, x) -> t + CASE WHEN x.l IN ('Add', 'Mul') THEN 2 WHEN x.l IN ('exp', 'log') THEN 1 ELSE 0 END)"
    rows = settled(rows.select("expr_id", "ast_nodes", F.expr(shared).alias("shared")), "expr_id", "ast_nodes", "shared")
    small = f"'nodes', cast(size(shared) as bigint), 'edges', {refs}"
    modes = f"array(named_struct('mode', 'ast_tree', 'nodes', ast_nodes, 'edges', ast_nodes - 1), named_struct('mode', 'ast_dag', {small}), named_struct('mode', 'macro_graph', {small}))"
    return rows.select("expr_id", F.explode(F.expr(modes)).alias("x")).select("expr_id", F.col("x.mode").alias("representation_mode"), "x.nodes", "x.edges")


def summary(rows: DataFrame) -> DataFrame:
    """Nodes, edges and graphs of every mode, in one pass."""
    return sizes(rows).groupBy("representation_mode").agg(F.sum("nodes").alias("nodes"), F.count("*").alias("graphs"), F.sum("edges").alias("edges"))


def integrity(rows: DataFrame) -> DataFrame:
    """Per expression: a tree has one edge fewer than nodes, and no node has two parents."""
    rows = settled(rows, "expr_id", "labels", "ast_nodes")
    edges = F.expr("filter(transform(labels, (l, k) -> named_struct('parent', get(labels, cast((k + 1) div 2 - 1 as int)), 'child', k, 'label', l)), x -> x.label is not null and x.parent is not null and x.child > 0)")
    rows = rows.select("expr_id", F.col("ast_nodes").alias("n_nodes"), edges.alias("e"))
    n, distinct = F.size("e").cast("long"), F.size(F.expr("array_distinct(transform(e, x -> x.child))"))
    return rows.select("expr_id", "n_nodes", n.alias("n_edges"), ((n == F.col("n_nodes") - 1) & (n == distinct)).alias("valid"))


def hierarchical_links(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """level_from, level_to, source, target: from every node to the node that it becomes on the next level.

    Levels are the tree, the shared expression, its macro graph and the motif-compressed graph of kept (patterns.replaced()), where a replaced node becomes its motif's. Node ids
    are those of graph_nodes(), and expr:motif_graph:place on the last level."""
    out = links(rows, kept).select("expr_id", F.explode("links").alias("x"))
    return out.select("x.level_from", "x.level_to", F.concat_ws(":", "expr_id", "x.source").alias("source"), F.concat_ws(":", "expr_id", "x.target").alias("target"))


def links(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """expr_id, links: hierarchical_links() as one array an expression, ids without the expression's."""
    return linked(settled(rows, "expr_id", "subtrees").join(kept.select("expr_id", "nodes", "kept"), "expr_id", "left"))


def linked(names: DataFrame, *carried: str) -> DataFrame:
    """links() of rows that have subtrees, nodes and kept (patterns.replaced()) together, with the carried columns."""
    there = "filter(transform(subtrees, (s, k) -> named_struct('p', cast(k + 1 as string), 's', s)), x -> x.s is not null)"
    link = lambda a, b, source, target: f"named_struct('level_from', '{a}', 'level_to', '{b}', 'source', {source}, 'target', {target})"
    up = f"transform({there}, x -> {link('ast_tree', 'ast_dag', 'x.p', 'x.s')})"
    across = f"transform(array_distinct(filter(subtrees, s -> s is not null)), s -> {link('ast_dag', 'macro_graph', 's', 's')})"
    names = settled(names, "expr_id", *carried, "nodes", "kept", "subtrees")
    owner = "concat('motif_graph:', coalesce(get(filter(kept, k -> array_contains(k.nodes, n.id)), 0).root, n.id))"
    last = f"transform(nodes, n -> {link('macro_graph', 'motif_graph', 'subtrees[cast(n.id as int) - 1]', owner)})"
    return names.select("expr_id", *carried, F.expr(f"concat({up}, {across}, coalesce({last}, array()))").alias("links"))


def dangling(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with an end that nodes (level, node_id) doesn't have."""
    ids = nodes.select("level", "node_id")
    a = ids.select(F.col("level").alias("level_from"), F.col("node_id").alias("source"), F.lit(1).alias("a"))
    b = ids.select(F.col("level").alias("level_to"), F.col("node_id").alias("target"), F.lit(1).alias("b"))
    return links.join(a, ["level_from", "source"], "left").join(b, ["level_to", "target"], "left").where("a is null or b is null").drop("a", "b")


def records(rows: DataFrame) -> DataFrame:
    """One nested record an expression: graph_id, expression, nodes and edges as arrays of structs."""
    rows = settled(rows, "expr_id", "expression", "labels")  # records may be filtered
    nodes = F.expr("filter(transform(labels, (l, k) -> named_struct('id', k + 1, 'label', l)), x -> x.label is not null)")
    edges = F.expr("filter(transform(labels, (l, k) -> named_struct('source', (k + 1) div 2, 'target', k + 1, 'label', l)), x -> x.label is not null and x.source > 0)")
    return rows.select(F.concat(F.lit("ast_tree:"), "expr_id").alias("graph_id"), "expression", nodes.alias("nodes"), edges.alias("edges"))


def validated(records: DataFrame) -> DataFrame:
    """graph_id and errors: what a record breaks of the schema's rules, empty where it is sound.

    Rules: node ids are unique, the root (id 1) is there, edges end at nodes, and no parent has more than two children."""
    checks = {
        "node ids are not unique": F.expr("size(array_distinct(transform(nodes, n -> n.id))) < size(nodes)"),
        "root node id is missing": F.expr("not exists(nodes, n -> n.id = 1)"),
        "edge source missing": F.expr("exists(edges, e -> not exists(nodes, n -> n.id = e.source))"),
        "edge target missing": F.expr("exists(edges, e -> not exists(nodes, n -> n.id = e.target))"),
        "a parent has duplicate child slots": F.expr("size(array_distinct(transform(edges, e -> struct(e.source, e.target)))) < size(edges)"),
    }
    return records.select("graph_id", F.array_compact(F.array(*(F.when(test, F.lit(text)) for text, test in checks.items()))).alias("errors"))
