"""The corpus as DataFrames: one row an expression, and the long node and edge tables.

A row holds the codes of its heap's places as one array; labels, canonical strings, depths, values and normal forms are made from it level by level, so that a plan has one expression for each of them; queries read the
columns that they need and the rest is pruned. Nothing here shuffles or joins, but for distinct() and returned().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprlake.functions import eml, grammar, measures, normal
from exprlake.operators.stages import stage

#: Values of the variables in the numeric probe.
X, Y = 1.3, 2.1


def total(test: str) -> Column:
    """How many places pass the test on k, the place's code, and on l and r, its children's codes (0 where there is none)."""
    test = test.replace("{l}", "coalesce(get(codes, 2 * i + 1), 0)").replace("{r}", "coalesce(get(codes, 2 * i + 2), 0)")
    return F.expr(f"cast(size(filter(codes, (k, i) -> {test})) as bigint)")


def settled(rows: DataFrame, *names: str) -> DataFrame:
    """The named columns of facts(), each made once a row.

    What stands above facts() is merged into it otherwise: a filter would be copied into its steps, and a column that a lambda reads would be made once for each
    of the lambda's items. A generator's output stays where it is."""
    return rows.select(F.inline(F.array(F.struct(*names))))


def facts(keys: DataFrame, key: str = "event_id", *carried: str) -> DataFrame:
    """Every column of an expression that the studies read, with the carried ones of keys. Filter them, and read their arrays in lambdas, behind settled() only."""
    rows = keys.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("expr_id"), *carried)
    rows = settled(rows.select("expr_id", *carried, eml.codes("expr_id").alias("codes")), "expr_id", *carried, "codes")
    constant = lambda k, a, b: f"{k} = 3" if a is None else f"CASE WHEN {k} IN (4, 5) THEN {a} AND {b} WHEN {k} IN (6, 7) THEN {a} ELSE {k} = 3 END"
    every = lambda step, kind: F.expr(grammar.climb_sql(step, kind))
    first = lambda step, kind: F.expr(grammar.climb_sql(step, kind, root=True))
    count = {f"n_{f.lower()}": total(f"k = {grammar.CODES[f]}") for f in measures.FAMILIES}
    rows = rows.select(
        "*",
        labels().alias("labels"),
        subtrees().alias("subtrees"),
        every(measures.depth_step, "int").alias("depths"),
        first(measures.string_step, "string").alias("expression"),
        first(measures.depth_step, "int").alias("eml_depth"),
        first(lambda k, a, b: measures.value_step(k, a, b, X, Y), "double").alias("value"),
        *(c.alias(n) for n, c in count.items()),
        total("k IN (1, 2)").alias("n_symbols"),
        total("k = 3").alias("n_constants"),
        F.expr("length(bin(array_max(transform(codes, (k, i) -> if(k > 0, i + 1, 1))))) - 1").alias("ast_depth"),
        total("k = 5 AND ({l} = 3 OR {r} = 3)").alias("mul_by_one"),
        F.expr(f"transform(array({grammar.climb_sql(constant, 'boolean')}), c -> cast(size(filter(codes, (k, i) -> k IN (4, 5) AND get(c, 2 * i + 1) AND get(c, 2 * i + 2))) as bigint))[0]").alias("constant_only"),
        total("k = 7 AND {l} = 3").alias("log_one"),
        total("k = 6 AND {l} = 7").alias("exp_log"),
        total("k = 7 AND {l} = 6").alias("log_exp"),
        total("k IN (4, 5) AND {l} = 3 AND {r} = 3").alias("number_only"),
        *(first(lambda k, a, b, mode=mode: normal.step(mode, k, a, b), "string").alias(f"form_{mode}") for mode in normal.MODES),
    )
    rows = rows.select("*", F.expr("n_symbols + n_constants").alias("n_leaves"), F.expr("n_symbols + n_constants + n_add + n_mul + n_exp + n_log").alias("ast_nodes"))
    shared = F.size(F.array_distinct(F.array_compact("subtrees"))).cast("long")
    rows = rows.select("*", shared.alias("ast_dag_nodes"), measures.weighed(measures.EML_WEIGHT).alias("eml_nodes"), measures.weighed(measures.COST_WEIGHT).alias("estimated_cost"), eml.dag_nodes("codes").alias("eml_dag_nodes"))
    return categories(trivial(rows))


def trivial(rows: DataFrame) -> DataFrame:
    """rows with the triviality scores, and the subset by the rule of counters and by the rule of features."""
    every = F.expr("mul_by_one + constant_only + log_one + exp_log + log_exp")
    flags = F.expr("if(mul_by_one > 0, 1L, 0L) + if(log_one > 0, 1L, 0L) + if(exp_log > 0, 1L, 0L) + if(log_exp > 0, 1L, 0L) + number_only")
    subset = lambda score: F.when(score > 0, "identity_heavy_v1").otherwise("nontrivial_v1")
    return rows.select("*", every.alias("total_score"), flags.alias("triviality_score"), subset(every).alias("counter_subset"), subset(flags).alias("feature_subset"))


def categories(rows: DataFrame) -> DataFrame:
    """Ratios, threshold flags, buckets, signature, family and split."""
    ratio = lambda a, b: F.col(a) / F.col(b)
    alpha = ratio("eml_nodes", "ast_nodes")
    return rows.select(
        "*",
        alpha.alias("tree_alpha"),
        ratio("ast_nodes", "ast_dag_nodes").alias("ast_compression"),
        ratio("eml_dag_nodes", "ast_nodes").alias("dag_alpha"),
        ratio("eml_dag_nodes", "ast_dag_nodes").alias("dag_alpha_vs_dag"),
        ratio("eml_nodes", "eml_dag_nodes").alias("dag_compression"),
        (alpha < measures.threshold()).alias("below_threshold"),
        F.expr(measures.bucket_sql("ast_nodes", measures.AST_NODE_BUCKETS)).alias("ast_node_bucket"),
        F.expr(measures.bucket_sql("ast_depth", measures.AST_DEPTH_BUCKETS)).alias("ast_depth_bucket"),
        F.expr(measures.bucket_sql("eml_nodes", measures.EML_NODE_BUCKETS)).alias("eml_node_bucket"),
        F.expr(measures.bucket_sql("eml_nodes / ast_nodes", measures.ALPHA_BUCKETS, strict=True)).alias("alpha_bucket"),
        F.expr(measures.signature_sql()).alias("operator_signature"),
        F.expr(measures.dominant_sql()).alias("dominant_family"),
        split_of("expr_id").alias("split"),
    )


def split_of(key: str, seed: int = 0) -> Column:
    """train below 0.7, validation below 0.85, else test, by the first 64 bits of a SHA-256 over seed and key."""
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, 16), 16, 10)
    share = bits.cast("decimal(20,0)").cast("double") / F.lit(float(2**64))
    return F.when(share < 0.7, "train").when(share < 0.85, "validation").otherwise("test")


#: Splits in the order of copies, and distinct expressions that one task works on.
SPLITS, TASK_EXPRESSIONS = ("train", "validation", "test"), 10_000


def keyed(rows: DataFrame) -> DataFrame:
    """expr_id, split, head, tail: the whole array of codes as two numbers, three bits a code, so that equal expressions have equal ones."""
    number = lambda low, n: F.expr(f"aggregate(slice(codes, {low}, {n}), 0L, (s, k) -> s * 8L + k)")
    return settled(rows, "expr_id", "split", "codes").select("expr_id", "split", number(1, 21).alias("head"), number(22, grammar.PLACES - 21).alias("tail"))


def distinct(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """facts() of one row for each distinct expression, the one with the smallest expr_id, with copies, how many rows of each of SPLITS it stands for; and the table by which returned() leads back.

    What depends on the expression alone is made for these rows only: of a million keys about 300,000 differ, of four million about a million."""
    copies = F.array(*(F.count_if(F.col("split") == s) for s in SPLITS))
    table = stage(keyed(rows).groupBy("head", "tail").agg(F.min("expr_id").alias("expr_id"), copies.alias("copies")), "distinct")
    parts = max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // TASK_EXPRESSIONS))
    return facts(table.select("expr_id", "copies", "head", "tail").repartition(parts), "expr_id", "copies", "head", "tail"), table


def returned(rows: DataFrame, table: DataFrame, found: DataFrame) -> DataFrame:
    """found, which has a row for each distinct expression, for every row of rows: with its own expr_id and, where found has one, its own split.

    Where found has kept head and tail, it meets the rows by these, and they are left out. found grows with the corpus, and its arrays are larger than the files that
    it is read from, so it is never broadcast."""
    names = [c for c in found.columns if c not in ("head", "tail")]
    if "head" in found.columns:
        known = found.drop("split", "expr_id")
    else:
        known = found.drop("split").withColumnRenamed("expr_id", "first").join(table.select("head", "tail", F.col("expr_id").alias("first")), "first")
    return keyed(rows).join(known.hint("merge"), ["head", "tail"]).select(*names)


def labels() -> Column:
    """The labels of all places, of the codes."""
    return F.expr("transform(codes, k -> CASE k " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in grammar.CODES.items()) + " END)")


def subtrees() -> Column:
    """The canonical strings of all places, of the codes."""
    return F.expr(grammar.climb_sql(measures.string_step, "string"))


def nodes(rows: DataFrame) -> DataFrame:
    """expr_id, node, level, label, subtree, eml_depth: one row a node."""
    rows = settled(rows, "expr_id", "labels", "subtrees", "depths")
    items = F.explode(F.expr("filter(transform(labels, (l, k) -> named_struct('node', k + 1L, 'label', l, 'subtree', subtrees[k], 'eml_depth', depths[k])), x -> x.label is not null)"))
    out = rows.select("expr_id", items.alias("x")).select("expr_id", "x.*")
    return out.select("expr_id", "node", (F.length(F.bin("node")) - 1).cast("int").alias("level"), "label", "subtree", "eml_depth")


def edges(rows: DataFrame) -> DataFrame:
    """expr_id, parent, child, slot, parent_label, child_label: from each row's own arrays, without a join."""
    rows = settled(rows, "expr_id", "labels")
    items = F.explode(F.expr("filter(transform(labels, (l, k) -> named_struct('parent', (k + 1L) div 2, 'child', k + 1L, 'parent_label', get(labels, cast((k + 1) div 2 - 1 as int)), 'child_label', l)), x -> x.child_label is not null and x.parent > 0)"))
    out = rows.select("expr_id", items.alias("x")).select("expr_id", "x.*")
    return out.select("expr_id", "parent", "child", slot("parent_label", "child").alias("slot"), "parent_label", "child_label")


def slot(label: str, child: str) -> Column:
    return F.when(F.col(label).isin("exp", "log"), "arg0").when(F.col(child) % 2 == 0, "left").otherwise("right")
