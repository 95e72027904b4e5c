"""Learned motif vocabularies over macro graphs and pure EML DAGs: candidates, selection, and what each vocabulary saves on every expression.

Candidates are frequent among training rows. Weights of a linear score are chosen on validation rows; the learned vocabulary holds what scores best
on training rows under them, and stands beside the most frequent candidates and a draw of as many. Test rows enter nothing but the metrics.
Vocabularies are bounded tables; what is asked of one expression is asked inside its row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exprlake.functions import batches, eml
from exprlake.functions.stats import distribution, rounded, safe_divide
from exprlake.operators import corpus, graphs, motifs, patterns
from exprlake.operators.corpus import settled
from exprlake.operators.stages import stage

#: Most nodes of a motif by the type of its graph.
MOST_NODES = {"macro_graph": 3, "pure_eml_dag": 2}
#: Motifs of a vocabulary, and candidates of a type.
SIZE, POOL = 10, 30
#: Vocabularies that are compared.
NAMES = ("frequent", "learned", "random")


MADE = {"macro_graph": graphs.macro_graphs, "pure_eml_dag": graphs.pure_graphs}
#: The same of a batch of codes, and as a column.
BATCHES = {"macro_graph": batches.macro_graphs, "pure_eml_dag": batches.pure_graphs}
COLUMNS = {"macro_graph": eml.macro_graph, "pure_eml_dag": eml.pure_graph}


def found_by_type(rows: DataFrame, *kinds: str) -> dict[str, DataFrame]:
    """Occurrences of every graph type, or of those named, each written once."""
    return {kind: stage(patterns.occurrences(MADE[kind](rows), MOST_NODES[kind]), kind) for kind in kinds or MOST_NODES}


def tallies_by_type(rows: DataFrame) -> dict[str, DataFrame]:
    """Counts of every graph type's motifs over distinct expressions (corpus.distinct()), each written once."""
    return {kind: stage(patterns.tallied(rows, most, BATCHES[kind]), f"{kind}-tallies") for kind, most in MOST_NODES.items()}


def candidates(found: dict[str, DataFrame], min_support: int = 50, size: int = POOL) -> DataFrame:
    """Motifs of two or more nodes that occur min_support times in training rows, at most size of each type: motif_type, signature, node_count, support, coverage, score."""
    parts = None
    for kind, rows in found.items():
        part = patterns.vocabulary(rows.where("split = 'train'"), min_support, size, kind, least=2).withColumn("motif_type", F.lit(kind))
        parts = part if parts is None else parts.unionByName(part)
    return parts.select("motif_type", "signature", "node_count", "support", "coverage", "score")


def features(found: dict[str, DataFrame], pool: DataFrame) -> DataFrame:
    """Per candidate and split: support, coverage (nodes that its occurrences hold) and the coverage of nontrivial expressions. A split without occurrences has no row."""
    nodes = F.col("support") * F.col("node_count")
    plain = F.sum(F.when(F.col("feature_subset") == "nontrivial_v1", nodes).otherwise(0))
    parts = None
    for kind, rows in found.items():
        mine = F.broadcast(pool.where(F.col("motif_type") == kind).select("signature"))  # at most POOL rows
        groups = patterns.counted(rows, "split", "feature_subset").join(mine, "signature", "left_semi")
        part = groups.groupBy("signature", "node_count", "split").agg(F.sum("support").alias("support"), F.sum(nodes).alias("coverage"), plain.alias("nontrivial_coverage")).withColumn("motif_type", F.lit(kind))
        parts = part if parts is None else parts.unionByName(part)
    return parts.select("motif_type", "signature", "node_count", "split", "support", "coverage", "nontrivial_coverage")


def vocabularies(pool: DataFrame, known: DataFrame, size: int = SIZE, seed: int = 0) -> DataFrame:
    """vocabulary, motif_id, motif_type, signature, node_count, support, score, selection_score, rank: frequent, learned and random motifs, size of each for each graph type.

    known are the features() of pool. Learned motifs go by training score under the trial that scores best on validation rows of their type; frequent ones by score, random
    ones by a digest of seed and motif. selection_score is null but for learned motifs. score, which greedy replacement goes by, is the pool's."""
    trained = None
    for kind in MOST_NODES:
        mine = known.where(F.col("motif_type") == kind)
        trial = F.broadcast(motifs.best_trial(mine, size).select("trial"))  # one row
        part = motifs.scores(mine).where("split = 'train'").join(trial, "trial").select(F.lit(kind).alias("motif_type"), "signature", F.col("score").alias("selection_score"))
        trained = part if trained is None else trained.unionByName(part)
    rows = pool.join(trained, ["motif_type", "signature"], "left")
    order = {
        "frequent": [F.desc("score"), F.desc("support"), F.desc("node_count"), F.col("signature")],
        "learned": [F.desc_nulls_last("selection_score"), F.col("signature")],
        "random": [F.sha2(F.concat(F.lit(f"{seed}/"), "signature"), 256)],
    }
    parts = None
    for name in NAMES:
        rank = F.row_number().over(Window.partitionBy("motif_type").orderBy(*order[name]))  # at most POOL rows of a type
        part = rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= size).withColumn("vocabulary", F.lit(name))
        part = part.withColumn("selection_score", F.col("selection_score") if name == "learned" else F.lit(None).cast("double"))
        parts = part if parts is None else parts.unionByName(part)
    motif_id = F.format_string("%s_%s_%04d", "vocabulary", "motif_type", F.col("rank") - 1)
    return parts.select("vocabulary", motif_id.alias("motif_id"), "motif_type", "signature", "node_count", "support", "score", "selection_score", "rank")


def replacements(found: dict[str, DataFrame], chosen: DataFrame) -> dict[str, DataFrame]:
    """Per graph type, rows with one column of taken occurrences for each vocabulary."""
    out = {}
    for kind, rows in found.items():
        done: tuple[str, ...] = ()
        for name in NAMES:
            rows = patterns.taken(rows, chosen.where((F.col("vocabulary") == name) & (F.col("motif_type") == kind)), name, *done)
            done = (*done, name)
        out[kind] = rows.select(*patterns.ROW, *NAMES)
    return out


def _sized(kept: DataFrame, kind: str, valid: DataFrame) -> DataFrame:
    """expr_id, <kind>_n and, for each vocabulary, <kind>_<name> (nodes that are left), with the nodes that learned motifs cover and whether their replacement can be undone."""
    short = {"macro_graph": "m", "pure_eml_dag": "p"}[kind]
    covered = "aggregate({0}, 0L, (t, k) -> t + size(k.nodes))"
    left = [F.expr(f"size(nodes) - {covered.format(n)} + size({n})").alias(f"{short}_{n}") for n in NAMES]
    sizes = kept.select(*(patterns.GRAPH if short == "m" else ("expr_id",)), F.size("nodes").cast("long").alias(f"{short}_n"), *left, F.expr(covered.format("learned")).alias(f"{short}_covered"))
    return sizes.join(valid.select("expr_id", F.col("equal").alias(f"{short}_valid")), "expr_id", "left")


def metric_rows(taken: dict[str, DataFrame], chosen: DataFrame) -> DataFrame:
    """Per expression: nodes of the pure DAG and of the macro graph, nodes that each vocabulary leaves, gains, coverage of the learned one, and valid.

    A vocabulary is used on the macro graph or on the pure DAG, whichever is left smaller, on the macro graph at a tie. valid: learned replacements of both graphs,
    undone from tables and templates, give the originals. expr_id is the key; the two graphs of an expression meet by one equi-join."""
    sides = {}
    for kind, rows in taken.items():
        kept = rows.select(*patterns.ROW, F.col("learned").alias("kept"))
        mine = chosen.where((F.col("vocabulary") == "learned") & (F.col("motif_type") == kind))
        sides[kind] = _sized(rows, kind, patterns.reconstruction(kept, mine))
    return _metrics(sides["macro_graph"].join(sides["pure_eml_dag"], "expr_id"))


def metrics_of(rows: DataFrame, chosen: DataFrame, *carried: str) -> DataFrame:
    """metric_rows() with the carried columns, of rows of the corpus: both graphs are made of the codes, compressed and undone where they are, a batch at a time. Nothing is shuffled."""
    sides = []
    for kind, short in (("macro_graph", "m"), ("pure_eml_dag", "p")):
        mine = {n: chosen.where((F.col("vocabulary") == n) & (F.col("motif_type") == kind)) for n in NAMES}
        sides.append(patterns.used(COLUMNS[kind]("codes"), MOST_NODES[kind], mine, "learned").alias(short))
    rows = settled(rows, *patterns.GRAPH, *carried, "codes").select(*patterns.GRAPH, *carried, *sides)
    return _metrics(rows.select(*patterns.GRAPH, *carried, *(F.col(f"{k}.{n}").alias(f"{k}_{n}") for k in "mp" for n in ("n", *NAMES, "covered", "valid"))), *carried)


def _metrics(both: DataFrame, *carried: str) -> DataFrame:
    """metric_rows() of the sizes of both graphs."""
    both = both.withColumns({f"{n}_nodes": F.least(f"m_{n}", f"p_{n}") for n in NAMES})
    macro = F.col("m_learned") <= F.col("p_learned")
    ratio = lambda a, b: rounded(safe_divide(F.col(a), F.col(b)), 9)
    return both.select(
        *patterns.GRAPH,
        F.col("p_n").alias("pure_nodes"),
        F.col("m_n").alias("macro_nodes"),
        *(f"{n}_nodes" for n in NAMES),
        F.when(macro, "macro_graph").otherwise("pure_eml_dag").alias("graph_type"),
        rounded(100 * F.when(macro, F.col("m_covered") / F.col("m_n")).otherwise(F.col("p_covered") / F.col("p_n"))).alias("coverage_percent"),
        ratio("p_n", "frequent_nodes").alias("frequent_gain"),
        ratio("p_n", "learned_nodes").alias("learned_gain"),
        ratio("p_n", "random_nodes").alias("random_gain"),
        ratio("frequent_nodes", "learned_nodes").alias("gain_vs_frequent"),
        ratio("m_n", "learned_nodes").alias("gain_vs_macro"),
        ratio("random_nodes", "learned_nodes").alias("gain_vs_random"),
        F.coalesce(F.col("m_valid") & F.col("p_valid"), F.lit(False)).alias("valid"),
        *carried,
    )


def grouped(rows: DataFrame) -> DataFrame:
    """Each row for its split, for its subset and for all_v1."""
    pair = lambda kind, name: F.struct(F.lit(kind).alias("grouping"), name.alias("name"))
    return rows.withColumn("g", F.explode(F.array(pair("split", F.col("split")), pair("subset", F.col("feature_subset")), pair("subset", F.lit("all_v1"))))).select("*", "g.*")


def summary(rows: DataFrame, *measures: str) -> DataFrame:
    """Per split and subset: rows, those that are valid, failures, and mean, median and 90th percentile of the measures over the valid ones.

    rows that have copies count once for each of them, by split. Rows with the same measures are added up before the groups are."""
    rows = rows.select("feature_subset", "valid", *measures, *(["copies"] if "copies" in rows.columns else ["split", F.lit(1).cast("long").alias("n")]))
    if "copies" in rows.columns:
        cells = F.array(*(F.struct(F.lit(name).alias("split"), F.col("copies")[k].alias("n")) for k, name in enumerate(corpus.SPLITS)))
        rows = rows.select("*", F.inline(cells)).where("n > 0")
    shown = [F.when(F.col("valid"), F.col(c)).alias(c) for c in measures]
    same = rows.select("split", "feature_subset", "valid", *shown, "n").groupBy("split", "feature_subset", "valid", *measures).agg(F.sum("n").alias("n"))
    sums = [c for m in measures for c in distribution(m, m, "n")]
    ok = F.coalesce(F.sum(F.when(F.col("valid"), F.col("n"))), F.lit(0))
    return grouped(same).groupBy("grouping", "name").agg(F.sum("n").alias("n"), ok.alias("n_valid"), (F.sum("n") - ok).alias("failures"), *sums)


def choice(rows: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Counts of every graph type's motifs and the vocabularies, written once. rows are a corpus or its distinct expressions with their copies."""
    few = rows if "copies" in rows.columns else corpus.distinct(rows)[0]
    known = tallies_by_type(few)
    pool = stage(candidates(known), "candidates")
    return known, stage(vocabularies(pool, stage(features(known, pool), "features")), "vocabularies")


def study(rows: DataFrame) -> DataFrame:
    """metric_rows() of a corpus, made once for each distinct expression."""
    few, table = corpus.distinct(rows)
    return corpus.returned(rows, table, stage(metrics_of(few, choice(few)[1], "head", "tail"), "metrics"))


def summarized(rows: DataFrame, *measures: str) -> DataFrame:
    """summary() of a corpus' study, a distinct expression counting once for each of its copies."""
    few = corpus.distinct(rows)[0]
    return summary(metrics_of(few, choice(few)[1], "copies"), *measures)
