"""Generation in rounds: candidates are drawn, those that are trivial or known already are rejected, until enough distinct expressions are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exprlake.operators import corpus
from exprlake.operators.stages import stage

#: Distance of the ids of one round's candidates from those of the round before; no small multiple of it is near a multiple of the draws' modulus.
STRIDE = 1_000_000_007


def rounds(keys: DataFrame, key: str, share: float = 1.0, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """Distinct, nontrivial expressions, one for every key or for a share of them, and a row a round with what became of its candidates.

    Round k draws a candidate for every key from the id key + k * STRIDE. A candidate is trivial if it has no operator, a duplicate if a smaller id of
    its round has the same expression or an earlier round kept it. The kept ones of a round are found by one grouped minimum and one anti-join with all that is
    kept before, and are written. Rounds end as soon as share of the keys' number is reached; the last round gives what is still wanted, smallest ids first, so
    that the number is exact. More than most rounds are an error, since the grammar then has too few expressions.

    Returns (candidate_id, expression, round) and (round, attempts, trivial, duplicates, kept). Null keys draw nothing; a table without keys keeps nothing."""
    base = keys.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"))
    wanted = int(base.count() * share)
    kept, told, have = None, [], 0
    for turn in range(most):
        if turn and have >= wanted:
            break
        drawn = corpus.facts(base.select((F.col("k") + turn * STRIDE).alias("k")), "k")
        drawn = corpus.settled(drawn, "expr_id", "expression", "ast_nodes", "n_leaves")
        groups = drawn.groupBy("expression").agg(F.min("expr_id").alias("candidate_id"), F.count("*").alias("n"), F.max(F.col("ast_nodes") == F.col("n_leaves")).alias("trivial"))
        if kept is not None:
            known = kept.select("expression", F.lit(True).alias("known"))
            groups = groups.join(known, "expression", "left")
        else:
            groups = groups.withColumn("known", F.lit(None).cast("boolean"))
        groups = stage(groups, "round")
        sums = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("attempts"), F.coalesce(F.sum(F.when(F.col("trivial"), F.col("n"))), F.lit(0)).alias("trivial"), F.count_if(F.expr("not trivial and known is null")).alias("new")).first()
        fresh = groups.where("not trivial and known is null")
        take = min(sums["new"], wanted - have)
        if take < sums["new"]:
            fresh = fresh.orderBy("candidate_id").limit(take)
        fresh = stage(fresh.select("candidate_id", "expression", F.lit(turn).alias("round")), "kept")
        kept = fresh if kept is None else kept.unionByName(fresh)
        have += take
        told.append((turn, sums["attempts"], sums["trivial"], sums["attempts"] - sums["trivial"] - sums["new"], take))
    else:
        if have < wanted:
            raise RuntimeError(f"{have} of {wanted} expressions after {most} rounds")
    return kept, keys.sparkSession.createDataFrame(told, "round int, attempts long, trivial long, duplicates long, kept long")
