"""URL filters by path-template trees.

Each host has a tree of path segments. Level by level, a segment that is a number or rare among its siblings becomes a
wildcard; a segment that stands once counts as rare where many do. Labelled urls give every tree node counts of blocked
and labelled urls, and nodes are split as long as labels and different paths are left. A branch whose blocked share does not differ significantly
from that of its siblings together is merged with them: it takes their pooled share. A node's purity is its blocked share
smoothed towards its parent's, the root's towards that of all labelled urls; a template with purity of REJECT or more is
blocked. Everything is grouped sums and joins on (host, template prefix), with partial sums before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprlake.llm.common import lower_ascii, release, stage

#: Least share of its siblings' urls for a segment to stay as it is, and how many siblings that stand once are variable.
KEEP_SHARE, VARIABLE = 0.02, 8
#: Weight of the parent's share, least blocked share of a rejected template, critical value of the branch test.
PRIOR, REJECT, CRITICAL = 4.0, 0.5, 1.96


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(rules, host: Column, path: Column) -> Column:
    """The longest fitting rule as a struct of its name and verdict, null without one."""
    fits = []
    for verdict, name, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        on = (host == name) | host.endswith("." + name)
        fits.append(F.when(on & path.startswith(prefix), F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def _segments(path: Column) -> Column:
    """All segments of a path; numbers, with their endings, are generalised."""
    raw = F.filter(F.split(path, "/", -1), lambda s: s != "")
    return F.transform(raw, lambda s: F.when(s.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$"), F.concat(F.lit("{n}"), F.regexp_extract(s, r"(\.[A-Za-z0-9]+)?$", 0))).otherwise(s))


def _share(purity: Column, labelled: Column, hits: Column, l: Column, h: Column) -> Column:
    """A branch's blocked share from its own counts l and h, smoothed to its parent's; its parent's where it has no label or is like its siblings together."""
    rest, rest_hits = labelled - l, hits - h
    pooled = hits / F.greatest(labelled, F.lit(1))
    gap = F.abs(h / l - rest_hits / rest)
    deviation = F.sqrt(pooled * (1 - pooled) * (1 / l + 1 / rest))
    alike = F.when(l == 0, True).when(rest == 0, False).otherwise(gap <= CRITICAL * deviation)
    return F.when(alike, purity).otherwise((h + PRIOR * purity) / (l + PRIOR))


def templates(urls: DataFrame) -> DataFrame:
    """Per distinct host and segment list: steps (its template) and purity.

    urls has host, segments, blocked (null: no label). Rows fall to one per distinct list before anything is joined. The tree grows level by level: a node is split while it has labels and
    more than one list, so that it is as deep as the paths that labels tell apart; where it is not split, ** stands for what follows, or the path itself if there is but one."""
    lists = urls.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("blocked").alias("l"), F.coalesce(F.sum(F.col("blocked").cast("long")), F.lit(0)).alias("h"))
    lists = stage(lists, "url-lists")
    base = lists.agg(F.coalesce(F.sum("h"), F.lit(0)).alias("h"), F.coalesce(F.sum("l"), F.lit(0)).alias("l")).first()
    overall = (base["h"] + 0.5) / (base["l"] + 2.0)  # one row: blocked share of all labelled urls, below one half without any
    roots = lists.groupBy("host").agg(F.sum("l").alias("labelled"), F.sum("h").alias("hits"), F.count("*").alias("lists"))
    roots = roots.withColumn("purity", (F.col("hits") + PRIOR * overall) / (F.col("labelled") + PRIOR))
    open_ = lambda: (F.col("labelled") > 0) & (F.col("lists") > 1)
    level, tree = 0, stage(lists.join(roots, "host").withColumn("steps", F.expr("cast(array() as array<string>)")).withColumn("open", open_()), "url-tree")
    done = [tree.where("not open")]
    while not (active := tree.where("open")).isEmpty():
        active = active.withColumn("step", F.coalesce(F.get("segments", F.lit(level)), F.lit("")))
        siblings = active.groupBy("host", "steps", "step").agg(F.sum("n").alias("own"))
        totals = siblings.groupBy("host", "steps").agg(F.sum("own").alias("total"), F.count_if(F.col("own") == 1).alias("once"))
        fixed = (F.col("step") == "") | F.col("step").startswith("{n}")
        often = (F.col("own") >= KEEP_SHARE * F.col("total")) & ((F.col("own") > 1) | (F.col("once") < VARIABLE))
        plain = siblings.join(totals, ["host", "steps"]).select("host", "steps", "step", (fixed | often).alias("keep"))
        moved = active.join(plain, ["host", "steps", "step"]).withColumn("steps", F.concat("steps", F.array(F.when(F.col("keep"), F.col("step")).otherwise(F.lit("*")))))
        moved = stage(moved.drop("keep", "open", "lists"), "url-moved")  # read twice below
        own = moved.groupBy("host", "steps").agg(F.sum("l").alias("cl"), F.sum("h").alias("ch"), F.count("*").alias("lists"))
        grown = moved.join(own, ["host", "steps"]).withColumn("purity", _share(*map(F.col, ("purity", "labelled", "hits", "cl", "ch"))))
        grown = grown.drop("labelled", "hits").withColumnsRenamed({"cl": "labelled", "ch": "hits"}).withColumn("open", open_() & (F.col("step") != "")).drop("step")
        tree = stage(grown, "url-tree")
        release(moved)
        level += 1
        done.append(tree.where("not open"))
    out = None
    for part in done:
        rest = F.when(F.col("lists") == 1, F.slice("segments", F.size("steps") + 1, F.size("segments"))).otherwise(F.array(F.lit("**")))
        shown = F.when(F.size("segments") > F.size("steps"), F.concat("steps", rest)).otherwise(F.filter("steps", lambda s: s != ""))
        part = part.select("host", "segments", shown.alias("steps"), "purity")
        out = part if out is None else out.unionByName(part)
    return out


def judge(pages: DataFrame, rules, key: str = "page_id", url: str = "url") -> DataFrame:
    """Per row: key, host, path, rule (null without one), verdict (allow or block), template, purity.

    A url that is null or has no :// has an empty host and path, and is judged by the template of that empty host. Urls that rules
    judge are the labelled ones. Null or repeated keys, and repeated urls, pass through row by row; paths of any length and depth are taken
    whole. Only key and url are read, so other columns never clash; an empty table gives no rows.
    """
    seen = pages.select(F.col(key).alias(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    seen = seen.withColumn("fit", rule_of(rules, F.col("host"), F.col("path"))).withColumn("segments", _segments(F.col("path")))
    judged = templates(seen.select("host", "segments", F.when(F.col("fit").isNotNull(), F.col("fit.verdict") == "block").alias("blocked")))
    judged = judged.select("host", "segments", F.concat(F.lit("/"), F.array_join("steps", "/")).alias("template"), "purity")
    method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    out = seen.join(judged, ["host", "segments"])
    return out.select(key, "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "template", "purity")
