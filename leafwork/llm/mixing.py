"""Mixing sources to target weights by Sainte-Lague apportionment (operator 5).

Documents are dealt to shards of ``shard_tokens`` tokens on average by a hash of their id. Within a shard each source is a stream of documents in seeded
order, cut into blocks of ``block_tokens`` tokens (white-space words): a document belongs to the block in which its first
token falls. The shard's seats, ``share`` of its blocks, go to sources one by one by the highest quotient
weight/(2j - 1), j = 1, 2, ..; a source has no more quotients than blocks, so that what a small source can't fill goes to
the others. Of each source the blocks with the smallest seeded hash are taken, as many as its seats.

Scale: texts are counted in one pass, whose result (70 bytes a document) is written; all else reads that. Windows run over
(shard, source), quotients are one row a block; both are as large as a shard and no larger, since the number of shards is
the corpus's tokens by ``shard_tokens``: a source of any size is spread over all shards. Texts meet the chosen keys in one
semi-join.

Edge cases: a null source is a source of its own, the same as ''; a null or blank text has no tokens and belongs to the block
where it stands; a text longer than a block fills several and belongs to its first; ties of quotients go to the source first
in order, ties of hashes to the smaller id; rows without an id are dealt by their text and keep a null id; rows that repeat
an id and source (or, without an id, text and source) are kept together if the block of one of them is chosen; sources without
a weight have weight 0 and get seats only after all others; an empty table gives an empty result; other columns are not read
by ``selected``, pass through ``mix_sources``, and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafwork.llm import common
from leafwork.session import cut

SHARD_TOKENS = 1 << 20
BLOCK_TOKENS = 2048
SHARE = 0.8
SEED = "17"


def _key(id_col: str, text_col: str, seed: str) -> Column:
    """What deals and orders a row: the hash of its id, or of its text if it has none."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("long").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))))


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_tokens: int = SHARD_TOKENS, block_tokens: int = BLOCK_TOKENS, seed: str = SEED) -> DataFrame:
    """``(doc_id, source, shard, tokens, block, key)`` of every document."""
    n = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit("[^ \\t\\r\\n]+")).cast("long")
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), n.alias("tokens"), _key(id_col, text_col, seed).alias("key")))
    shards = max(1, -(-(rows.agg(F.sum("tokens")).first()[0] or 0) // shard_tokens))
    rows = rows.withColumn("shard", F.pmod(F.conv(F.substring("key", 1, 15), 16, 10).cast("long"), F.lit(shards)))
    before = F.sum("tokens").over(Window.partitionBy("shard", "source").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    return rows.withColumn("block", F.floor(before / block_tokens)).select("doc_id", "source", "shard", "tokens", "block", "key")


def quotas(blocked: DataFrame, weights: dict[str, float] | None = None, share: float = SHARE) -> DataFrame:
    """``(shard, source, available, seats)``. Without ``weights`` a source weighs the square root of its tokens."""
    have = blocked.groupBy("shard", "source").agg(F.countDistinct("block").alias("available"), F.sum("tokens").alias("tokens"))
    if weights is None:
        scale = have.groupBy("source").agg(F.sqrt(F.sum("tokens").cast("double")).alias("weight"))
    else:
        known = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.lit(None).cast("map<string,double>")
        scale = have.select("source").distinct().withColumn("weight", F.coalesce(known[F.col("source")], F.lit(0.0)))
    have = have.select("shard", "source", "available").join(scale, "source")
    by_shard = Window.partitionBy("shard")
    have = have.withColumn("total", F.floor(F.sum("available").over(by_shard) * share))
    each = have.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("available"))).alias("j")).withColumn("quotient", F.col("weight") / (2 * F.col("j") - 1))
    place = F.row_number().over(by_shard.orderBy(F.desc("quotient"), "source", "j"))
    won = F.sum((F.col("place") <= F.col("total")).cast("long"))
    return each.withColumn("place", place).groupBy("shard", "source").agg(F.max("available").alias("available"), won.alias("seats"))


def _selected(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: dict[str, float] | None, shard_tokens: int, block_tokens: int, share: float, seed: str) -> DataFrame:
    blocked = blocks(docs, id_col, text_col, source_col, shard_tokens, block_tokens, seed)
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("shard").cast("string"), F.col("source"), F.col("block").cast("string")))
    rank = F.row_number().over(Window.partitionBy("shard", "source").orderBy(key, "block"))
    ranked = blocked.select("shard", "source", "block").distinct().withColumn("rank", rank)
    chosen = ranked.join(quotas(blocked, weights, share), ["shard", "source"]).where("rank <= seats").select("shard", "source", "block")
    return blocked.join(chosen, ["shard", "source", "block"], "left_semi")


def selected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str, float] | None = None, shard_tokens: int = SHARD_TOKENS, block_tokens: int = BLOCK_TOKENS, share: float = SHARE, seed: str = SEED) -> DataFrame:
    """``(doc_id, source, shard, block, tokens)`` of the documents in the chosen blocks."""
    return _selected(docs, id_col, text_col, source_col, weights, shard_tokens, block_tokens, share, seed).select("doc_id", "source", "shard", "block", "tokens")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str, float] | None = None, shard_tokens: int = SHARD_TOKENS, block_tokens: int = BLOCK_TOKENS, share: float = SHARE, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` whose blocks are chosen; columns as they were."""
    key, source = common.fresh("key", "source")
    found = _selected(docs, id_col, text_col, source_col, weights, shard_tokens, block_tokens, share, seed).select(F.col("key").alias(key), F.col("source").alias(source))
    return docs.join(found, (_key(id_col, text_col, seed) == F.col(key)) & (F.coalesce(F.col(source_col), F.lit("")) == F.col(source)), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH n AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 't' || md5(coalesce(text, '')))) AS key,
         CAST(CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, ' ', '')) + 1 END AS BIGINT) AS tokens
  FROM (SELECT doc_id, text, coalesce(source, '') AS source,
               trim(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM documents)
), s AS (SELECT *, CAST('0x' || substr(key, 1, 15) AS BIGINT) % (SELECT CAST(greatest(1, ceil(sum(tokens) / {SHARD_TOKENS})) AS BIGINT) FROM n) AS shard FROM n),
b AS (
  SELECT doc_id, source, shard, tokens, CAST((sum(tokens) OVER (PARTITION BY shard, source ORDER BY key, doc_id, tokens
         ROWS UNBOUNDED PRECEDING) - tokens) // {BLOCK_TOKENS} AS BIGINT) AS block FROM s
), h AS (
  SELECT shard, source, count(DISTINCT block) AS available FROM b GROUP BY ALL
), w AS (SELECT source, sqrt(CAST(sum(tokens) AS DOUBLE)) AS weight FROM b GROUP BY ALL),
t AS (SELECT *, CAST(floor(sum(available) OVER (PARTITION BY shard) * {SHARE}) AS BIGINT) AS total FROM h JOIN w USING (source)),
q AS (
  SELECT shard, source, total, row_number() OVER (PARTITION BY shard ORDER BY weight / (2 * j - 1) DESC, source, j) AS place
  FROM (SELECT *, unnest(range(1, available + 1)) AS j FROM t)
), seats AS (SELECT shard, source, count(*) FILTER (WHERE place <= total) AS seats FROM q GROUP BY ALL),
r AS (
  SELECT *, row_number() OVER (PARTITION BY shard, source ORDER BY md5('{SEED}:' || shard || ':' || source || ':' || block), block) AS rank
  FROM (SELECT DISTINCT shard, source, block FROM b)
)
SELECT b.doc_id, b.source, b.shard, b.block, b.tokens FROM b JOIN r USING (shard, source, block) JOIN seats USING (shard, source)
WHERE rank <= seats
"""
