"""WARC records and a Merkle fixity audit of replicas.

Pages become WARC response records; an archive is a run of records in offset order. Per archive a hash tree is built
over the record hashes: each node covers an ordered range of FANOUT children and hashes their hashes and their ranges
relative to its own start. Two replicas are compared at the roots; only below differing nodes are the children looked at,
level by level. The records of the lowest differing nodes are aligned by record id and hash, so that a longer, missing or
extra record does not mark the sound ones that it moves. All of it is DataFrame work: one grouped aggregate per level while
building, one join per level while descending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprlake.llm.common import stage

#: Records to an archive, children to a node, levels above the records (FANOUT ** LEVELS records at most).
ARCHIVE_RECORDS, FANOUT, LEVELS = 1_000, 16, 3
#: Fixed value: the format's line end.
CRLF = "\r\n"


def record_id(url: Column, key: Column) -> Column:
    return F.sha2(F.concat_ws("|", key.cast("string"), url), 256)


def record_bytes(url: Column, body: Column, key: Column) -> Column:
    """One WARC/1.0 resource record as text: header lines, an empty line, the body and two line ends."""
    header = F.concat_ws(
        CRLF,
        F.lit("WARC/1.0"),
        F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Record-ID: <urn:sha256:"), record_id(url, key), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    )
    return F.concat(header, F.lit(CRLF * 2), body, F.lit(CRLF * 2))


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """archive, place, offset, length, record, key, id, sha: the records of all pages in offset order.

    Archive and order follow the key; a null key goes to archive -1, rows of one key are ordered by their bytes. A null
    html is an empty body."""
    text = record_bytes(F.col(url), F.coalesce(F.col(html), F.lit("")), F.col(key))
    rows = pages.select(F.col(key).alias("key"), record_id(F.col(url), F.col(key)).alias("id"), text.alias("record"))
    rows = rows.withColumn("archive", F.coalesce(F.floor(F.col("key") / ARCHIVE_RECORDS), F.lit(-1)).cast("long"))
    rows = rows.withColumn("length", F.octet_length("record").cast("long")).withColumn("sha", F.sha2("record", 256))
    order = Window.partitionBy("archive").orderBy(F.col("key").asc_nulls_last(), "sha")
    rows = rows.withColumn("place", F.row_number().over(order) - 1)
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Nodes of every level, records first: archive, place, first (offset), end (offset), hash.

    leaves has archive, place, offset, length, sha. A node hashes its children's hashes and ranges in order, ranges from its own
    start on, so that a node that only moved hashes the same; archives of more than FANOUT ** LEVELS records have several
    roots, which are compared one by one."""
    levels = [leaves.select("archive", F.col("place").cast("long").alias("place"), F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("end"), F.col("sha").alias("hash"))]
    for _ in range(LEVELS):
        up = levels[-1].groupBy("archive", F.floor(F.col("place") / FANOUT).alias("up"))
        nodes = up.agg(F.min("first").alias("first"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("place", "first", "end", "hash"))).alias("children"))
        said = F.transform("children", lambda c: F.concat_ws(":", c["first"] - F.col("first"), c["end"] - F.col("first"), c["hash"]))
        levels.append(nodes.select("archive", F.col("up").alias("place"), "first", "end", F.sha2(F.array_join(said, "|"), 256).alias("hash")))
    return levels


def mismatches(one: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """archive, place of the lowest nodes that differ or that one replica lacks, by descending below differing nodes only."""
    suspects = None
    for a, b in zip(one[:0:-1], other[:0:-1], strict=True):
        if suspects is not None:
            up = suspects.select("archive", F.col("place").alias("up"))
            a, b = ((x.withColumn("up", F.floor(F.col("place") / FANOUT)).join(up, ["archive", "up"], "left_semi")) for x in (a, b))
        a = a.select("archive", "place", F.col("hash").alias("a"))
        b = b.select("archive", "place", F.col("hash").alias("b"))
        suspects = a.join(b, ["archive", "place"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("archive", "place")
    return suspects


def _nth(rows: DataFrame, *names: str) -> DataFrame:
    """rows with nth, the number of each row among those that agree in names, in order of place."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*names).orderBy("place")))


def align(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """The records of either side that the other lacks, with their columns and state: changed, missing or extra.

    Records of one archive are equal by id and hash, as often as both sides have them. Of what is left, records of one id
    are one changed record, in primary's place; others are missing in the replica, or extra there in the replica's place.
    Nodes that agree hold the same records on both sides, so those of the differing nodes are enough. Both sides are
    in the order of records(), where equal records cannot change places."""
    same = ["archive", "id", "sha"]
    primary, replica = _nth(primary, *same), _nth(replica, *same)
    ids = ["archive", "id"]
    lost = stage(_nth(primary.join(replica.select(*same, "nth"), [*same, "nth"], "left_anti"), *ids), "lost")
    new = stage(_nth(replica.join(primary.select(*same, "nth"), [*same, "nth"], "left_anti"), *ids), "new")
    twins = new.select(*ids, "nth", F.lit("changed").alias("twin"))
    lost = lost.join(twins, [*ids, "nth"], "left").withColumn("state", F.coalesce("twin", F.lit("missing"))).drop("twin")
    extra = new.join(lost.select(*ids, "nth"), [*ids, "nth"], "left_anti").withColumn("state", F.lit("extra"))
    return lost.unionByName(extra).drop("nth")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Per record of primary, and per extra one of replica: archive, place, offset, length, key, sha, root_ok, corrupt, state.

    Both have the columns of records(). root_ok says whether the record's archive has equal roots in both replicas; corrupt
    whether the record itself differs or is missing on one side, and state how: sound, changed, missing (in replica) or
    extra (in replica only). Sound records that a corrupt one moves stay sound. Empty replicas give no rows."""
    kept = ["archive", "place", "offset", "length", "sha", "key", "id"]
    primary, replica = stage(primary.select(kept), "primary"), stage(replica.select(kept), "replica")
    one, other = ([stage(level, f"level{k}") if k else level for k, level in enumerate(tree(x))] for x in (primary, replica))
    nodes = stage(mismatches(one, other), "mismatches").withColumnRenamed("place", "up")
    below = (x.withColumn("up", F.floor(F.col("place") / FANOUT)).join(nodes, ["archive", "up"], "left_semi").drop("up") for x in (primary, replica))
    corrupt = stage(align(*below), "corrupt")
    tops = one[-1].join(other[-1].select("archive", "place", F.col("hash").alias("twin")), ["archive", "place"], "full")
    roots = tops.groupBy("archive").agg(F.min(F.col("hash").eqNullSafe(F.col("twin"))).alias("root_ok"))
    states = corrupt.where("state <> 'extra'").select("archive", "place", "state")
    marked = primary.join(states, ["archive", "place"], "left").withColumn("state", F.coalesce("state", F.lit("sound")))
    marked = marked.unionByName(corrupt.where("state = 'extra'")).join(roots, "archive", "left")
    return marked.select("archive", "place", "offset", "length", "key", "sha", "root_ok", (F.col("state") != "sound").alias("corrupt"), "state")


def write_archives(rows: DataFrame, path: str) -> None:
    """One text file set per archive, records in offset order."""
    but_end = F.expr("substring(record, 1, length(record) - 2)")  # the writer adds each record's last line end
    rows = rows.repartition("archive").sortWithinPartitions("archive", "offset").select("archive", but_end.alias("value"))
    rows.write.option("lineSep", CRLF).partitionBy("archive").text(path)


def decayed(pages: DataFrame, key: str = "page_id", html: str = "html", below: str = "05") -> DataFrame:
    """A replica of pages in which some bodies that are not empty have decayed: those whose key's SHA-256 in hex is less than below.

    By the hash's next digit a body's last character has changed, the page is lost, the body has grown, or only its first half is left."""
    sha = F.sha2(F.col(key).cast("string"), 256)
    rotten = F.coalesce(sha < below, F.lit(False)) & F.coalesce(F.length(html) > 0, F.lit(False))
    digit = F.substring(sha, 3, 1)
    lost = rotten & F.coalesce(digit.between("4", "7"), F.lit(False))
    last = F.concat(F.expr(f"substring(`{html}`, 1, length(`{html}`) - 1)"), F.lit("\x00"))
    half = F.expr(f"substring(`{html}`, 1, length(`{html}`) div 2)")
    body = F.when(digit < "4", last).when(digit < "c", F.concat(html, F.lit("!"))).otherwise(half)
    return pages.where(~lost).withColumn(html, F.when(rotten, body).otherwise(F.col(html)))
