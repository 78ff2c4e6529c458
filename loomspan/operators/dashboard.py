"""The statistics dashboard over deed facts, for all tenants at once (group by user_id) or as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.text import EMPTY_DASHBOARD, as_text, first_number, is_empty


def years(facts: DataFrame) -> DataFrame:
    return facts.filter("year is not null").groupBy("year").agg(F.count("*").alias("n"))


def _most_common(named: DataFrame, most: int | None) -> DataFrame:
    """Names by how often they occur; of equals the one that comes first (id, place in its deed)."""
    counts = named.filter(~is_empty(F.col("name"), EMPTY_DASHBOARD)).groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("first"))
    return (counts.orderBy(F.desc("n"), "first").limit(most) if most else counts).drop("first")


def places(facts: DataFrame, most: int | None = 10) -> DataFrame:
    """Places by number of deeds, as written; ties by the first deed."""
    return _most_common(facts.select("id", F.lit(0).alias("pos"), F.trim(as_text(F.col("location"))).alias("name")), most)


def people(facts: DataFrame, most: int | None = 10) -> DataFrame:
    """People by number of mentions in the three roles, as written; ties by the first mention."""
    roles = F.array(*[F.trim(as_text(F.col(c))) for c in ("seller", "buyer", "middleman")])
    return _most_common(facts.select("id", F.posexplode(roles).alias("pos", "name")), most)


def price_trend(facts: DataFrame) -> DataFrame:
    """Mean of the first numbers in prices for each year."""
    rows = facts.select("year", first_number(F.col("price")).alias("value")).dropna()
    return rows.groupBy("year").agg(F.round(F.avg("value"), 2).alias("avg_price"), F.count("*").alias("n"))


def span(facts: DataFrame) -> DataFrame:
    return facts.agg(F.min("year").alias("start"), F.max("year").alias("end"), (F.max("year") - F.min("year")).alias("span"), F.count("year").alias("docs_with_time"))


def totals(images: DataFrame, structured: DataFrame) -> DataFrame:
    """Images and analysed images of each tenant."""
    done = structured.filter("status = 'done'").groupBy("user_id").agg(F.countDistinct("image_id").alias("total_analyzed"))
    return images.groupBy("user_id").agg(F.count("*").alias("total_images")).join(done, "user_id", "left").withColumn("total_analyzed", F.coalesce("total_analyzed", F.lit(0)))
