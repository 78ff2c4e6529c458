"""Hybrid retrieval: vector top-k, recent documents, ordered union, context packing, history window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.similarity import squared_distance
from loomspan.functions.text import EMPTY_CONTEXT, present


def nearest(queries: DataFrame, items: DataFrame, k: int, *, same: str | None = None) -> DataFrame:
    """The k nearest items of each query by squared distance, ties by id: (query_id, item_id, distance, rank).

    With `same` only items of equal metadata are compared.  Queries are a stated set against all items; those come in
    blocks by a hash and each block keeps its k best before they meet, so the number of rows that meet is k x blocks.
    """
    q = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("q"), *([F.col(same).alias("_q")] if same else []))
    i = items.select(F.col("id").alias("item_id"), F.col("vector").alias("v"), *([F.col(same).alias("_i")] if same else []))
    pairs = i.join(q, F.col("_q") == F.col("_i")) if same else i.join(q)
    scored = pairs.filter("query_id <> item_id").select("query_id", "item_id", squared_distance(F.col("q"), F.col("v")).alias("distance"), F.pmod(F.xxhash64("item_id"), F.lit(64)).alias("block"))
    order = [F.asc("distance"), F.asc("item_id")]
    local = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "block").orderBy(*order))).filter(F.col("rank") <= k)
    return local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k).drop("block")


def recent(results: DataFrame, images: DataFrame, most: int) -> DataFrame:
    """The latest finished result with text of each image, for each tenant the `most` newest: (user_id, image_id, id, pos)."""
    done = results.filter("status = 'done' and raw_text is not null")
    latest = done.groupBy("image_id").agg(F.max("id").alias("id")).join(images.select(F.col("id").alias("image_id"), "user_id"), "image_id")
    return latest.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("id")))).filter(F.col("pos") <= most)


def ordered_union(first: DataFrame, second: DataFrame, key: str, dedupe: str, *, most: int = 20, beside: int = 5) -> DataFrame:
    """For each `key`: rows of first by pos, then of second, each value of `dedupe` once (nulls always stay), `most` at most.

    Of second only `beside` count where first has rows.
    """
    has = first.select(key).distinct().withColumn("_has", F.lit(True))
    other = second.join(has, key, "left").filter(F.col("_has").isNull() | (F.col("pos") <= beside)).drop("_has")
    both = first.withColumn("src", F.lit(0)).unionByName(other.withColumn("src", F.lit(1)), allowMissingColumns=True)
    again = F.row_number().over(Window.partitionBy(key, dedupe).orderBy("src", "pos"))
    kept = both.withColumn("_n", again).filter((F.col("_n") == 1) | F.col(dedupe).isNull()).drop("_n")
    place = Window.partitionBy(key).orderBy("src", "pos")
    return kept.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most)


def packed(items: DataFrame, key: str, fields: list[tuple[str, str]]) -> DataFrame:
    """One context text for each key from its items in order of `place` (few: the union is capped): a header with the known fields, and an excerpt that is shorter the more items there are."""
    n = F.count("*").over(Window.partitionBy(key))
    most = F.when(n <= 5, 400).when(n <= 10, 250).otherwise(150)
    tag = lambda c, label: F.when(present(F.col(c), EMPTY_CONTEXT) != "", F.concat(F.lit(f"{label}:"), F.trim(c)))
    tags = F.concat_ws(" ", *[tag(c, label) for c, label in fields])
    header = F.concat(F.lit("[参考"), F.col("place"), F.lit("]"), F.when(tags != "", F.concat(F.lit("("), tags, F.lit(")"))).otherwise(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    excerpt = F.concat(F.left(text, F.col("_most")), F.when(F.length(text) > F.col("_most"), "…").otherwise(""))
    rows = items.withColumn("_most", most).select(key, "place", F.concat(header, F.lit("\n"), excerpt).alias("part"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "part"))), lambda x: x.part), "\n\n").alias("context"))


def history(turns: DataFrame, conversation: str, order: Column, *, most: int = 6) -> DataFrame:
    """Of the last turns of each conversation those of user and assistant with text; others still take a place."""
    last = turns.withColumn("back", F.row_number().over(Window.partitionBy(conversation).orderBy(order))).filter(F.col("back") <= most)
    return last.filter(F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != ""))
