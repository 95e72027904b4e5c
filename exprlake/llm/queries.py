"""One thin query for every training-data operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exprlake.llm import bpe, cells, chat, extract, jaccard, licenses, mix, negatives, runs, toxic, urls, vptree, warc
from exprlake.llm.common import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    coded = bpe.encode(docs, "doc_id", "text", path or vocabulary(), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text for every document."""
    return bpe_digests(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of 4-word shingles and its component under Jaccard >= 0.85."""
    found = jaccard.join_components(table(spark, sf_dir, "documents"), n=4, percent=85)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s
  FROM words
), items AS (SELECT r, unnest(s) AS x FROM sets),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM items a JOIN items b ON a.x = b.x AND a.r <> b.r GROUP BY ALL),
links AS (
  SELECT c.a, c.b FROM common c JOIN sets p ON p.r = c.a JOIN sets q ON q.r = c.b
  WHERE 100 * c.n >= 85 * (len(p.s) + len(q.s) - c.n)
), reach AS (
  SELECT a AS r, a AS x FROM links
  UNION
  SELECT reach.r, links.b FROM reach JOIN links ON reach.x = links.a
), least AS (SELECT reach.r, min(s.doc_id) AS c FROM reach JOIN sets s ON s.r = reach.x GROUP BY ALL)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(l.c, s.doc_id) AS component_id
FROM sets s LEFT JOIN least l USING (r)
"""


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    found = mix.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", mix.taken().alias("taken"), F.transform("draws", lambda d: d["shard"]).cast("string").alias("shards"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labels that are not held out."""
    return toxic.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches of every document."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every WARC record of pages with its place, and whether the audit finds it corrupt in a replica that has decayed."""
    pages = table(spark, sf_dir, "pages")
    found = warc.audit(warc.records(pages), warc.records(warc.decayed(pages)))
    return found.select(F.col("key").alias("page_id"), "archive", "place", "offset", "length", F.col("sha").alias("record_sha256"), "root_ok", "corrupt")


OP2_SQL = """
WITH bodies AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, coalesce(page_id // 1000, -1) AS archive,
         sha256(concat_ws('|', page_id::varchar, url)) AS id
  FROM pages
), texts AS (
  SELECT page_id, archive, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:sha256:' || id || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)
         || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record, html
  FROM bodies
), hashed AS (SELECT page_id, archive, html, strlen(record) AS length, sha256(record) AS record_sha256 FROM texts),
placed AS (
  SELECT *, row_number() OVER w - 1 AS place, coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset",
         length(html) > 0 AND coalesce(sha256(page_id::varchar) < '05', false) AS corrupt
  FROM hashed WINDOW w AS (PARTITION BY archive ORDER BY page_id NULLS LAST, record_sha256)
)
SELECT page_id, archive, place, "offset"::bigint AS "offset", length, record_sha256, NOT bool_or(corrupt) OVER (PARTITION BY archive) AS root_ok, corrupt FROM placed
"""


def op3_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth vector; factor one, so exact."""
    rows = table(spark, sf_dir, "embeddings")
    return vptree.nearest(rows, rows.where("vec_id % 50 = 0"), k=5, factor=1.0)


def op7_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of one label with cosine >= 0.98."""
    found = cells.near_groups(table(spark, sf_dir, "embeddings"), least=0.98)
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")


#: Fixed rules of the contract: verdict, host, path.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: a rule's, else that of its path template, learnt from the urls that rules judge."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract.main_text(table(spark, sf_dir, "pages"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, by whole inner products; every seventh label is moved by one."""
    rows = table(spark, sf_dir, "embeddings").where(negatives.complete("embedding"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", moved.alias("label"), negatives.whole("embedding", 256).alias("embedding"))
    return negatives.hard_negatives(rows, rows.where("vec_id % 50 = 0"))


OP11_SQL = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM rows_ a JOIN rows_ c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s USING (anchor_id)
WHERE NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted windows, and of one more that says the template's own control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    # two rows for the smallest input as for the largest
    more = spark.range(0, 2, 1, 1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digests(chat.windows(turns.unionByName(more), vocabulary()))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one in ten of the texts (by the CRC of the doc_id) repeats a stretch of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # through one-item arrays, so that the words are split once
    drawn = F.transform(F.array(F.struct(words.alias("w"), F.expr("h div 10").alias("g"))), lambda x: F.struct(x["w"].alias("w"), x["g"].alias("g"), F.size(x["w"]).alias("n")))
    drawn = F.filter(drawn, lambda x: x["n"] > 0)
    drawn = F.transform(drawn, lambda x: F.struct(x["w"].alias("w"), x["n"].alias("n"), (x["g"] % x["n"]).alias("a"), x["g"].alias("g")))
    placed = "transform(sequence(0, x.n - 1), i -> x.w[cast(if(i < x.a, i, x.a + (i - x.a) % (1 + (x.n - x.a) div (3 + x.g % 8))) as int)])"
    made = F.expr(f"array_join(get(transform(drawn, x -> {placed}), 0), ' ')")  # a text without words has none
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("drawn", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), drawn))
    return rows.select("doc_id", F.coalesce(made, "text").alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of at least twelve words in every document, of which every tenth has some planted."""
    found = runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_warc_fixity": op2_warc_fixity,
    "op3_vptree": op3_vptree,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_mix": op5_mix,
    "op6_urls": op6_urls,
    "op7_cells": op7_cells,
    "op8_licenses": op8_licenses,
    "op9_main_text": op9_main_text,
    "op10_toxicity": op10_toxicity,
    "op11_negatives": op11_negatives,
    "op12_chat": op12_chat,
    "op13_runs": op13_runs,
}
ORACLE: dict[str, str] = {"op2_warc_fixity": OP2_SQL, "op4_ngram_jaccard": OP4_SQL, "op11_negatives": OP11_SQL}
