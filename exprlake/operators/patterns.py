"""Connected motifs of any size in graph rows: enumeration, signatures, frequent vocabulary, greedy replacement, reconstruction.

A motif's occurrence is a root and a set of nodes that are reached from it inside the set. Sets grow by one reference at a time, all of one
size at once, and each set is kept once. Its nodes are numbered by their smallest path from the root, so equal motifs have equal signatures
wherever they stand. Greedy replacement is a sorted fold over a row's candidates. What crosses rows is the vocabulary only: at most `size` motifs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from exprlake.functions import batches, sets
from exprlake.operators.corpus import SPLITS, settled
from exprlake.operators.graphs import GRAPH

ROW = (*GRAPH, "nodes", "refs", "root")
#: Type of what occurrences() finds, and graphs that are worked on at once.
FOUND = "array<struct<signature:string,root:bigint,nodes:array<bigint>,labels:array<string>,inner:array<struct<parent:int,at:int,child:int>>,outer:array<struct<parent:int,at:int,child:bigint>>,safe:boolean>>"
KEPT = "array<struct<first:bigint,second:int,at:bigint,root:bigint,motif_id:string,nodes:array<bigint>,labels:array<string>,inner:array<struct<parent:int,at:int,child:int>>,outer:array<struct<parent:int,at:int,child:bigint>>>>"
BATCH = 1_000


def occurrences(graphs: DataFrame, max_nodes: int = 3) -> DataFrame:
    """graphs with found: array of (root, nodes in canonical order, signature, inner, safe, outer).

    inner are the references within the set as (parent, child, at) in canonical numbers, outer those that leave it as (parent, at, child), the child being a node of the graph.
    safe: no node of the set but the root has a parent outside. A signature lists labels, inner and outer references. Sets without any reference
    (single leaves) are no motifs."""
    rows = graphs.select(*ROW)
    kind = StructType([*rows.schema, *StructType.fromDDL(f"found {FOUND}")])

    def find(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH):
                part = batch.slice(low, BATCH)
                at = [part.schema.get_field_index(name) for name in ("nodes", "refs")]
                yield pa.RecordBatch.from_arrays([*part.columns, sets.found(*(part.column(k) for k in at), max_nodes)], [*ROW, "found"])

    return rows.mapInArrow(find, kind)


def tallied(graphs: DataFrame, max_nodes: int = 3, made: Callable[[np.ndarray], pa.StructArray] | None = None) -> DataFrame:
    """What counted() needs to know of graphs of distinct expressions with their copies (corpus.distinct()): signature, node_count, split, feature_subset, support, coverage.

    With made, graphs are rows of the corpus, whose graphs are made of their codes where they are counted (batches.macro_graphs, batches.pure_graphs). A task adds up what its graphs have and gives one row a motif, split and subset, so that no occurrence leaves it. Rows of several tasks may have the same keys."""

    def count(parts):
        sums = defaultdict(lambda: np.zeros(2, np.int64))
        for batch in parts:
            for low in range(0, batch.num_rows, BATCH):
                subset, copies, *graph = batch.slice(low, BATCH).columns
                nodes, refs = (graph if made is None else map(made(batches.matrix(graph[0])).field, ("nodes", "refs")))
                subset = subset.dictionary_encode()
                names, weights = subset.dictionary.to_pylist(), np.asarray(copies.flatten()).reshape(-1, len(SPLITS))
                for sign, size, group, split, *n in sets.tallies(nodes, refs, max_nodes, subset.indices.to_numpy(), weights):
                    sums[sign, size, SPLITS[split], names[group]] += n
        if sums:
            columns = [*zip(*((*k, *n.tolist()) for k, n in sums.items()), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["signature", "node_count", "split", "feature_subset", "support", "coverage"])

    kind = "signature string, node_count long, split string, feature_subset string, support long, coverage long"
    read = ("nodes", "refs") if made is None else ("codes",)
    return settled(graphs, "feature_subset", "copies", *read).mapInArrow(count, kind)


def counted(found: DataFrame, *keys: str) -> DataFrame:
    """signature, node_count and keys, with support (occurrences) and coverage (graphs); a graph counts its own occurrences before the shuffle. found may be tallied()."""
    if "found" not in found.columns:
        return found.groupBy("signature", "node_count", *keys).agg(F.sum("support").alias("support"), F.sum("coverage").alias("coverage"))
    per = "transform(array_distinct(transform(found, o -> named_struct('signature', o.signature, 'node_count', cast(size(o.nodes) as bigint)))), s -> named_struct('signature', s.signature, 'node_count', s.node_count, 'c', cast(size(filter(found, o -> o.signature = s.signature)) as bigint)))"
    items = found.select(*keys, F.explode(F.expr(per)).alias("s"))
    return items.groupBy("s.signature", "s.node_count", *keys).agg(F.sum("s.c").alias("support"), F.count("*").alias("coverage"))


def vocabulary(found: DataFrame, min_support: int = 50, size: int = 30, prefix: str = "macro_graph", least: int = 1) -> DataFrame:
    """The motifs that are frequent, by score support * (nodes - 1), support, nodes and signature: motif_id, rank, signature, node_count, support, coverage, score; at most size rows."""
    groups = counted(found).where((F.col("support") >= min_support) & (F.col("node_count") >= least)).withColumn("score", F.col("support") * (F.col("node_count") - 1))
    kept = groups.orderBy(F.desc("score"), F.desc("support"), F.desc("node_count"), "signature").limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("support"), F.desc("node_count"), "signature"))  # size rows
    return kept.select(F.format_string(f"{prefix}_%04d", rank - 1).alias("motif_id"), rank.cast("long").alias("rank"), "signature", "node_count", "support", "coverage", "score")


def quota(pure: DataFrame, macro: DataFrame, size: int = 30) -> DataFrame:
    """One vocabulary under quotas: a third pure motifs, a third macro motifs, and what is left are mixed ones, each a macro motif with its pure expansion.

    A stratum with fewer motifs leaves its places free. Motifs are numbered by type. pure and macro are vocabularies of at most size rows, so windows over one type are small."""
    third = max(1, size // 3)
    mixed = max(0, size - 2 * third)
    kinds = (("pure_eml_dag", pure, third, ""), ("macro_graph", macro, third, ""), ("mixed_macro_expansion", macro.where(F.col("rank") <= third), mixed, "mixed:"))
    parts = None
    for kind, rows, limit, prefix in kinds:
        rows = rows.where(F.col("rank") <= limit)
        part = rows.select(F.lit(kind).alias("motif_type"), "rank", F.concat(F.lit(prefix), "signature").alias("signature"), "node_count", "support", "score", F.when(F.lit(prefix) != "", F.col("motif_id")).alias("source_motif_id"))
        parts = part if parts is None else parts.unionByName(part)
    number = F.row_number().over(Window.partitionBy("motif_type").orderBy("rank"))
    return parts.withColumn("motif_id", F.format_string("%s_%04d", "motif_type", number - 1)).drop("rank")


def replaced(found: DataFrame, motifs: DataFrame) -> DataFrame:
    """found with kept: the occurrences that greedy replacement takes, with motif_id.

    Candidates have a motif of two or more nodes and are safe; they are taken by score, size and the root's place among the nodes, where no node is taken yet. motifs is a
    vocabulary: a bounded number of rows, which reach every task as one map."""
    return taken(found, motifs).select(*ROW, "kept")


def taken(found: DataFrame, motifs: DataFrame, name: str = "kept", *carried: str) -> DataFrame:
    """replaced() under another column's name, with found and the carried columns beside it, so that one row can hold what several vocabularies take."""
    known = F.map_from_entries(F.collect_list(F.struct("signature", F.struct("motif_id", "score"))))
    one = motifs.where("node_count > 1").agg(known.alias("known")).withColumn("one", F.lit(1))
    rows = found.withColumn("one", F.lit(1)).join(F.broadcast(one), "one")  # a single row, bounded by the vocabulary's size
    at = "array_position(transform(nodes, n -> n.id), o.root)"
    candidate = f"named_struct('first', -known[o.signature].score, 'second', -size(o.nodes), 'at', {at}, 'root', o.root, 'motif_id', known[o.signature].motif_id, 'nodes', o.nodes, 'labels', o.labels, 'inner', o.inner, 'outer', o.outer)"
    some = f"array_sort(transform(filter(found, o -> o.safe AND map_contains_key(known, o.signature)), o -> {candidate}))"
    rest = (*ROW, "found", *carried)
    rows = settled(rows.select(*rest, F.expr(some).alias("some")), *rest, "some")
    fold = "aggregate(some, slice(some, 1, 0), (acc, c) -> if(exists(acc, k -> arrays_overlap(k.nodes, c.nodes)), acc, concat(acc, array(c))))"
    return settled(rows.select(*rest, F.expr(fold).alias(name)), *rest, name)


def known(motifs: DataFrame) -> sets.Known:
    """A vocabulary as greedy replacement reads it: at most its size of rows."""
    return {r["signature"]: (r["score"], r["motif_id"]) for r in motifs.where("node_count > 1").select("signature", "score", "motif_id").collect()}


def greedy(graphs: DataFrame, max_nodes: int, vocabularies: dict[str, DataFrame], *carried: str) -> DataFrame:
    """graphs and the carried columns with what greedy replacement by each vocabulary takes, under the vocabulary's name, as taken() gives it.

    Occurrences are found and taken a batch of graphs at a time; those that are not taken don't leave the task."""
    rows = graphs.select(*ROW, *carried)
    kind = StructType([*rows.schema, *StructType.fromDDL(", ".join(f"{name} {KEPT}" for name in vocabularies))])
    names, told = [*rows.columns, *vocabularies], [known(v) for v in vocabularies.values()]

    def take(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH):
                part = batch.slice(low, BATCH)
                at = [part.schema.get_field_index(name) for name in ("nodes", "refs")]
                yield pa.RecordBatch.from_arrays([*part.columns, *sets.kept(*(part.column(k) for k in at), max_nodes, told)], names)

    return rows.mapInArrow(take, kind)


def compression(kept: DataFrame, *carried: str) -> DataFrame:
    """Per graph: nodes and references before and after, replacements, covered nodes and their percent."""
    covered = "aggregate(kept, 0L, (t, k) -> t + size(k.nodes))"
    inside = "aggregate(kept, 0L, (t, k) -> t + size(k.inner))"
    return kept.selectExpr(
        *GRAPH, *carried, "cast(size(nodes) as bigint) AS original_nodes", "cast(size(refs) as bigint) AS original_refs", f"size(nodes) - {covered} + size(kept) AS compressed_nodes",
        f"size(refs) - {inside} AS compressed_refs", "cast(size(kept) as bigint) AS replacements", f"{covered} AS covered_nodes", f"round(100D * {covered} / size(nodes), 6) AS coverage_percent",
    )


def compressed(kept: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The compressed graphs as three tables.

    nodes (expr_id, id, label): what is left, and a node for each replacement, with its root's id and the label motif:<motif_id>; refs (expr_id, parent, child, slot): slot is the
    child's place, or boundary_<n> below a replacement; bindings (expr_id, motif_id, root, local, id, outer): the original node of each local number, and on local
    number 0 the outer children in order."""
    taken = "flatten(transform(kept, k -> transform(k.nodes, v -> named_struct('id', v, 'root', k.root))))"
    rows = settled(kept.select("expr_id", "nodes", "refs", "kept", F.expr(taken).alias("taken")), "expr_id", "nodes", "refs", "kept", "taken")
    left = "filter(nodes, n -> NOT exists(taken, t -> t.id = n.id))"
    made = "transform(kept, k -> named_struct('id', k.root, 'label', concat('motif:', k.motif_id)))"
    nodes = rows.select("expr_id", F.explode(F.expr(f"concat({left}, {made})")).alias("n")).select("expr_id", "n.*")
    plain = "transform(filter(refs, r -> NOT exists(taken, t -> t.id = r.parent)), r -> named_struct('parent', r.parent, 'child', coalesce(get(filter(taken, t -> t.id = r.child), 0).root, r.child), 'slot', cast(r.at as string)))"
    below = "flatten(transform(kept, k -> transform(k.outer, (r, i) -> named_struct('parent', k.root, 'child', coalesce(get(filter(taken, t -> t.id = r.child), 0).root, r.child), 'slot', concat('boundary_', i)))))"
    refs = rows.select("expr_id", F.explode(F.expr(f"concat({plain}, {below})")).alias("r")).select("expr_id", "r.*")
    bound = "flatten(transform(kept, k -> transform(k.nodes, (v, i) -> named_struct('motif_id', k.motif_id, 'root', k.root, 'local', i, 'id', v, 'outer', if(i = 0, transform(k.outer, r -> r.child), null)))))"
    bindings = rows.select("expr_id", F.explode(F.expr(bound)).alias("b")).select("expr_id", "b.*")
    return nodes, refs, bindings


def items(kept: DataFrame, *carried: str) -> DataFrame:
    """item and the carried columns: a row for each node and reference of the compressed graphs, its label (motif for every replacement's) or slot (boundary below a replacement), in one pass."""
    rows = settled(kept.select(*carried, "nodes", "refs", "kept", F.expr("flatten(transform(kept, k -> k.nodes))").alias("taken")), *carried, "nodes", "refs", "kept", "taken")
    parts = (
        "transform(filter(nodes, n -> NOT array_contains(taken, n.id)), n -> n.label)",
        "transform(kept, k -> 'motif')",
        "transform(filter(refs, r -> NOT array_contains(taken, r.parent)), r -> cast(r.at as string))",
        "flatten(transform(kept, k -> transform(k.outer, r -> 'boundary')))",
    )
    return rows.select(*carried, F.explode(F.expr(f"concat({', '.join(parts)})")).alias("item"))


def templates(motifs: DataFrame) -> DataFrame:
    """motif_id, labels, inner, outer of every motif, read from its signature: a bounded number of rows."""
    part = F.split("signature", r"\|")
    listed = lambda k: F.filter(F.split(part[k], ","), lambda x: x != "")
    inner = F.transform(listed(1), lambda r: F.struct(F.split(r, r"[.>]")[0].cast("int").alias("parent"), F.split(r, r"[.>]")[1].cast("int").alias("at"), F.split(r, r"[.>]")[2].cast("int").alias("child")))
    outer = F.transform(listed(2), lambda r: F.struct(F.split(r, r"[.]")[0].cast("int").alias("parent"), F.split(r, r"[.]")[1].cast("int").alias("at")))
    return motifs.select("motif_id", listed(0).alias("labels"), inner.alias("inner"), outer.alias("outer"))


def reconstructed(nodes: DataFrame, refs: DataFrame, bindings: DataFrame, motifs: DataFrame) -> DataFrame:
    """expr_id, nodes, refs (sorted arrays) and errors of the original graphs, from compressed() tables and templates alone.

    A replacement's bindings are brought together, joined with its template, and give back its nodes, its inner references and, by its outer children, those that leave it. Errors count
    replacements whose motif is unknown or whose bindings or outer children do not fit the template."""
    local = F.sort_array(F.collect_list(F.struct("local", "id")))
    whole = bindings.groupBy("expr_id", "motif_id", "root").agg(local.alias("local"), F.max("outer").alias("out"))
    whole = whole.join(F.broadcast(templates(motifs)), "motif_id", "left")
    fits = "coalesce(size(local) = size(labels) AND transform(local, x -> x.local) = sequence(0, size(labels) - 1) AND size(out) = size(outer) AND local[0].id = root, false)"
    whole = settled(whole.select("expr_id", "root", "local", "labels", "inner", "outer", "out", F.expr(fits).alias("ok")), "expr_id", "root", "local", "labels", "inner", "outer", "out", "ok")
    of = lambda name: f"local[{name}].id"
    made = "if(ok, transform(labels, (l, i) -> named_struct('id', local[i].id, 'label', l)), array())"
    arcs = f"if(ok, concat(transform(inner, r -> named_struct('parent', {of('r.parent')}, 'child', {of('r.child')}, 'at', r.at)), transform(outer, (r, i) -> named_struct('parent', {of('r.parent')}, 'child', out[i], 'at', r.at))), array())"
    expanded = whole.groupBy("expr_id").agg(F.flatten(F.collect_list(F.expr(made))).alias("n"), F.flatten(F.collect_list(F.expr(arcs))).alias("r"), F.count_if(~F.col("ok")).alias("errors"))
    kept = nodes.where("label not like 'motif:%'").groupBy("expr_id").agg(F.collect_list(F.struct("id", "label")).alias("n"))
    plain = refs.where("slot not like 'boundary%'").groupBy("expr_id").agg(F.collect_list(F.struct("parent", "child", F.col("slot").cast("int").alias("at"))).alias("r"))
    graphs = nodes.select("expr_id").distinct()
    for part, n, r in ((expanded, "n1", "r1"), (kept, "n2", None), (plain, None, "r3")):
        named = part.select("expr_id", *(["errors"] if part is expanded else []), *([F.col("n").alias(n)] if n else []), *([F.col("r").alias(r)] if r else []))
        graphs = graphs.join(named, "expr_id", "left")
    empty = lambda a, b, kind: F.sort_array(F.concat(F.coalesce(a, F.array().cast(kind)), F.coalesce(b, F.array().cast(kind))))
    node_kind, ref_kind = "array<struct<id:bigint,label:string>>", "array<struct<parent:bigint,child:bigint,at:int>>"
    return graphs.select("expr_id", empty("n1", "n2", node_kind).alias("nodes"), empty("r1", "r3", ref_kind).alias("refs"), F.coalesce("errors", F.lit(0)).alias("errors"))


def graph_hash(nodes: str = "nodes", refs: str = "refs") -> Column:
    """A digest of a whole graph, from its sorted nodes and references."""
    said = F.expr(f"concat(array_join(transform(array_sort({nodes}), n -> concat(n.id, ':', n.label)), ','), '|', array_join(transform(array_sort({refs}), r -> concat(r.parent, '.', r.at, '>', r.child)), ','))")
    return F.sha2(said, 256)


def reconstruction(kept: DataFrame, motifs: DataFrame, tables: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Per graph: replacements, errors, and whether what its compressed tables give back has the original's digest."""
    nodes, refs, bindings = tables or compressed(kept)
    back = reconstructed(nodes, refs, bindings, motifs).select("expr_id", "errors", graph_hash().alias("again"))
    was = kept.select("expr_id", F.size("kept").cast("long").alias("replacements"), graph_hash().alias("original_sha256"))
    both = was.join(back, "expr_id", "left")
    return both.select("expr_id", "replacements", "original_sha256", F.coalesce("errors", F.lit(0)).cast("long").alias("errors"), F.coalesce(F.col("again") == F.col("original_sha256"), F.lit(False)).alias("equal"))


def _templates(motifs: DataFrame) -> dict[str, sets.Template]:
    """templates() by motif_id: at most the vocabulary's size of rows."""
    return {r["motif_id"]: (r["labels"], [tuple(x) for x in r["inner"]], [tuple(x) for x in r["outer"]]) for r in templates(motifs).collect()}


def restored(kept: DataFrame, motifs: DataFrame, *carried: str) -> DataFrame:
    """reconstruction(), a batch of graphs at a time: compressed and undone where they are, and compared whole. Nothing is shuffled."""
    told = _templates(motifs)

    @F.arrow_udf("errors bigint, equal boolean")
    def undo(nodes: pa.Array, refs: pa.Array, taken: pa.Array) -> pa.Array:
        parts = [sets.restored(*(c.slice(low, BATCH) for c in (nodes, refs, taken)), told) for low in range(0, len(nodes), BATCH)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([x for x, *_ in parts])), pa.array(np.concatenate([x for _, x in parts]))], ["errors", "equal"])

    rows = kept.select("expr_id", *carried, F.size("kept").cast("long").alias("replacements"), graph_hash().alias("original_sha256"), undo("nodes", "refs", "kept").alias("u"))
    return rows.select("expr_id", *carried, "replacements", "original_sha256", "u.errors", "u.equal")


def used(graph: Column, max_nodes: int, vocabularies: dict[str, DataFrame], shown: str) -> Column:
    """Of graphs (nodes, refs): n, nodes that each vocabulary leaves (by its name), those that the shown one covers, and valid, whether its replacements can be undone."""
    names = ["n", *vocabularies, "covered", "valid"]
    told, which, back = [known(v) for v in vocabularies.values()], [*vocabularies].index(shown), _templates(vocabularies[shown])

    @F.arrow_udf(", ".join(f"{name} bigint" for name in names[:-1]) + ", valid boolean")
    def use(graph: pa.Array) -> pa.Array:
        parts = [sets.used(*(graph.field(k).slice(low, BATCH) for k in ("nodes", "refs")), max_nodes, told, which, back) for low in range(0, len(graph), BATCH)]
        columns = [(n, *left, covered, valid) for n, left, covered, valid in parts]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)], names)

    return use(graph)
