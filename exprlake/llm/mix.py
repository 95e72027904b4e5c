"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Sources weigh 3, 1, 2, repeating in code point order (null last). They share SHARE times all words by weight; a target stops
at CAP times its source's words and the excess goes to the others by weight. Each source's documents fall into blocks
by hash. A source takes whole passes over its blocks and then a prefix of a permutation of them, cut inside the last
block so that its words meet the target exactly. The block quotas of all sources are dealt to output shards of equal
block counts: a binary tree over the sources splits each node's vector of shard counts between its two children by
multivariate-hypergeometric draws, so every leaf holds a source's exact quota for each shard. A source's permuted blocks
then fill its quotas in turn, and each shard is shuffled by a hash inside its own files. Random draws are hashes of
the seed: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprlake.llm.common import WORD, stage

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Documents to a block on average, fewest output shards, and documents of the input to a shard where there are more.
BLOCK_DOCS, SHARDS, SHARD_DOCS = 256, 16, 1 << 24
#: Bits of an order's hash that cut a source's blocks into runs.
RUN_BITS = 10


def words_in(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts) -> Column:
    """A number in [0, 1) that depends on the arguments only."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def targets(sums: DataFrame) -> DataFrame:
    """source, source_size, docs, blocks, place, target from source, source_size, docs.

    The windows without a key run over the table of sources, one row each."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sums.withColumn("place", F.row_number().over(order) - 1)
    placed = placed.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")))
    every = Window.partitionBy()
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(0, Window.unboundedFollowing)
    placed = placed.withColumn("all_size", F.sum("source_size").over(every))
    placed = placed.withColumn("level", (SHARE * F.col("all_size") - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after))
    full = F.col("level") * F.col("weight") >= CAP * F.col("source_size")
    placed = placed.withColumn("level", F.max(F.when(~full, F.col("level"))).over(every))
    target = F.least(CAP * F.col("source_size").cast("double"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return placed.select("source", "source_size", "docs", F.ceil(F.col("docs") / BLOCK_DOCS).alias("blocks"), "place", target.alias("target"))


def _draw(n_all: str, n_marked: str, n_drawn: str, u: str) -> str:
    """SQL for a hypergeometric draw: marked ones among n_drawn of n_all, by inverting the distribution at u.

    Beyond 8 standard deviations plus 8 around the mean the chance is below double precision and left out."""
    share = "q.k / greatest(q.a, 1)"
    far = f"cast(8 * sqrt(q.n * ({share}) * (1 - {share}) * ((q.a - q.n) / greatest(q.a - 1, 1))) + 8 as bigint)"
    ratio = "cast((y.k - x) as double) * (y.n - x) / (cast(x + 1 as double) * greatest(y.a - y.k - y.n + x + 1, 1))"
    steps = [  # each step names what the next one uses
        f"transform(array(named_struct('a', cast({n_all} as bigint), 'k', cast({n_marked} as bigint), 'n', cast({n_drawn} as bigint))), q -> named_struct('q', q, 'mean', cast(q.n * ({share}) as bigint), 'far', {far}))",
        "m -> named_struct('a', m.q.a, 'k', m.q.k, 'n', m.q.n, 'low', greatest(0L, m.q.n - (m.q.a - m.q.k), m.mean - m.far), 'high', least(m.q.n, m.q.k, m.mean + m.far))",
        f"y -> named_struct('y', y, 'until', ({u}) * aggregate(sequence(y.low, y.high), named_struct('w', 1D, 't', 0D), (s, x) -> named_struct('w', s.w * ({ratio}), 't', s.t + s.w), s -> s.t))",
        f"z -> aggregate(sequence(z.y.low, z.y.high), named_struct('w', 1D, 't', 0D, 'at', z.y.low), (s, x) -> named_struct('w', s.w * ({ratio.replace('y.', 'z.y.')}), 't', s.t + s.w, 'at', if(s.t + s.w <= z.until, least(x + 1, z.y.high), s.at)), s -> s.at)",
    ]
    sql = steps[0]
    for step in steps[1:]:
        sql = f"transform({sql}, {step})"
    return f"{sql}[0]"


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """place, v: each source's exact number of blocks for every shard.

    quotas has place (0, 1, ...) and q. The root holds the shards' capacities, which differ by one at most."""
    top = quotas.agg(F.sum("q").alias("q"), F.max("place").alias("last"))
    depth = max(0, int(top.first()["last"] or 0).bit_length())
    capacity = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda h: F.floor(F.col("q") * (h + 1) / shards) - F.floor(F.col("q") * h / shards))
    nodes = top.select(F.lit(0).cast("long").alias("g"), capacity.alias("v"))
    u = f"(shiftrightunsigned(xxhash64({seed}, level, g, s.i), 11) / {float(1 << 53)}D)"
    draw = _draw("s.a", "v[s.i]", "s.n", u)
    # the draw for shard i, given those before it: of the node's a blocks left, v[i] go to shard i and n belong to the left child
    left = f"""aggregate(v, named_struct('a', aggregate(v, 0L, (t, x) -> t + x), 'n', ql, 'i', 0, 'out', cast(array() as array<bigint>)),
        (s, x) -> transform(array({draw}), d -> named_struct('a', s.a - v[s.i], 'n', s.n - d, 'i', s.i + 1, 'out', concat(s.out, array(d))))[0], s -> s.out)"""
    for level in range(depth - 1, -1, -1):
        child = F.shiftright(F.col("place").cast("long"), level)
        sums = quotas.groupBy(F.shiftright(child, 1).alias("g")).agg(F.coalesce(F.sum(F.when(child % 2 == 0, F.col("q"))), F.lit(0)).cast("long").alias("ql"))
        nodes = nodes.join(sums, "g").withColumn("level", F.lit(level)).withColumn("l", F.expr(left))
        both = F.array(
            F.struct((2 * F.col("g")).alias("g"), F.col("l").alias("v")),
            F.struct((2 * F.col("g") + 1).alias("g"), F.zip_with("v", "l", lambda a, b: a - b).alias("v")),
        )
        nodes = stage(nodes.select(F.explode(both).alias("x")).select("x.g", "x.v"), "tree")
    return nodes.select(F.col("g").alias("place"), "v")


def _before(rows: DataFrame, value: str, order: Column, *ties: str) -> DataFrame:
    """rows with before: the sum of value over the rows of the same place that come earlier by order, a hash, then ties.

    The hash's leading bits cut each place into runs, which are summed first: no window holds all blocks of a source."""
    rows = rows.withColumn("run", F.shiftright(order, 64 - RUN_BITS))
    ahead = Window.partitionBy("place").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("place", "run").agg(F.sum(value).alias("held"))
    runs = runs.select("place", "run", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("place", "run").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(runs, ["place", "run"])
    return rows.withColumn("before", F.col("ahead") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("run", "ahead")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", row: bool = False, shards: int | None = None, seed: int = 7) -> DataFrame:
    """Per row of docs: key, size, source_size, target, draws (array of pass, shard, words), order_key; with row, the whole row as a struct.

    A null text counts as empty, a null source is a source of its own that sorts last. Rows with a null or repeated key take
    part one by one; equal rows are interchangeable. Sources without words have target 0. Without row only
    three columns are read, so other columns never clash. A very long text is one row and is only counted. An empty table gives
    no rows. Unless given, shards are SHARDS, or one for SHARD_DOCS rows if that is more.
    """
    base = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words_in(text).alias("size"), F.xxhash64(F.lit(seed), key, text).alias("h"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if row else []))
    if not row:
        base = stage(base, "sizes")
    per_source = stage(targets(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))), "targets")
    shards = shards or max(SHARDS, -(-int(per_source.agg(F.sum("docs")).first()[0] or 0) // SHARD_DOCS))
    quota = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("int")
    per_source = per_source.withColumn("passes", passes).withColumn("rest", quota - F.col("passes") * F.col("source_size"))

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["source"].eqNullSafe(b["source"])

    placed = base.join(per_source, same(base, per_source)).drop(per_source["source"]).withColumn("block", F.pmod("h", "blocks"))
    blocks = stage(placed.groupBy("place", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest")), "blocks")
    blocks = _before(blocks, "words", F.xxhash64(F.lit(seed), F.lit("part"), "place", "block"), "block")
    blocks = stage(blocks.withColumn("room", F.col("rest") - F.col("before")).drop("before"), "rooms")
    tokens = F.concat(F.expr("sequence(0, passes)"), F.array())
    tokens = blocks.withColumn("pass", F.explode(tokens)).where("pass < passes or room > 0")
    quotas = per_source.select("place").join(tokens.groupBy("place").agg(F.count("*").alias("q")), "place", "left").select("place", F.coalesce("q", F.lit(0)).alias("q"))
    split = split_tree(stage(quotas, "quotas"), shards, seed)
    ends = F.expr("transform(sequence(0, size(v) - 1), i -> aggregate(slice(v, 1, i + 1), 0L, (s, x) -> s + x))")
    turns = _before(tokens.withColumn("one", F.lit(1)), "one", F.xxhash64(F.lit(seed), F.lit("deal"), "place", "block", "pass"), "block", "pass")
    dealt = turns.withColumn("turn", F.col("before") + 1).join(split.withColumn("ends", ends), "place")
    dealt = dealt.withColumn("shard", F.expr("size(filter(ends, e -> e < turn))"))
    held = dealt.groupBy("place", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("tokens"))
    held = stage(blocks.join(held, ["place", "block"], "left").select("place", "block", "room", F.col("words").alias("block_words"), "tokens"), "dealt")
    placed = placed.join(held, ["place", "block"])
    cut = F.col("room").between(F.lit(1), F.col("block_words") - 1)
    inside = Window.partitionBy("place", "block").orderBy("h", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.where(~cut).withColumn("part", F.when(F.col("room") > 0, F.col("size")).otherwise(F.lit(0).cast("long")))
    some = placed.where(cut).withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("room") - F.coalesce(F.sum("size").over(inside), F.lit(0)))))
    out = whole.unionByName(some)
    draws = F.transform(F.coalesce("tokens", F.expr("cast(array() as array<struct<pass: int, shard: int>>)")), lambda t: F.struct(t["pass"].alias("pass"), t["shard"].alias("shard"), F.when(t["pass"] < F.col("passes"), F.col("size")).otherwise(F.col("part")).alias("words")))
    return out.select(F.col("key").alias(key), "size", "source_size", "target", draws.alias("draws"), "h", *(["row"] if row else []))


def taken() -> Column:
    return F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d["words"])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: row (docs' columns as a struct, so that none clashes), shard and order, one row for every copy taken.

    A document at the cut counts if half of it fits. Documents without words come along in each pass that takes their block."""
    rows = mix(docs, row=True, **options)
    rows = rows.withColumn("draw", F.explode("draws")).where("2 * draw.words >= size")
    return rows.select("row", F.col("draw.shard").alias("shard"), F.xxhash64("h", "draw.pass").alias("order"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix with docs' columns, of any names."""
    return mixed(docs, **options).select("row.*")


def write_mix(docs: DataFrame, path: str, **options) -> None:
    """Write the mix, one folder a shard, each file in shuffled order; the folders are named by mix_shard, which docs must not have."""
    rows = mixed(docs, **options).repartition("shard").sortWithinPartitions("shard", "order")
    rows.select("row.*", F.col("shard").alias("mix_shard")).write.partitionBy("mix_shard").parquet(path)
