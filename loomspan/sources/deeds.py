"""The document model over a star schema: customers own images (orders), whose recognised deeds are order lines.

A deed's structured content is JSON text, as it comes from a language model; deed_facts() reads it tolerantly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions.text import as_text

CONTENT = "Time_AD string, Location string, Seller string, Buyer string, Middleman string, Price string, Subject string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_nationkey").alias("nation"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.concat(F.lit("img_"), F.col("o_orderkey"), F.lit(".jpg")).alias("filename"), F.col("o_orderdate").alias("upload_time"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition results, one for each line number of an image: the first of lines that repeat it."""
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    status = F.when(F.col("l_returnflag") != "N", "done").when(F.col("l_linestatus") == "F", "failed").otherwise("processing")
    return lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("image_id"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        status.alias("status"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"),
        (F.col("l_quantity") / 50).alias("coverage"),
        (F.col("l_discount") >= 0.08).alias("human_corrected"),
        F.when(F.col("l_tax") > 0, F.concat_ws(" ", F.lit(" part"), "l_partkey")).alias("raw_text"),
        F.when(F.col("l_discount") >= 0.1, "   ").when(F.col("l_discount") >= 0.05, F.concat(F.lit("  PART "), "l_partkey")).alias("corrected_text"),
        "l_extendedprice",
        F.col("l_shipdate").alias("created_at"),
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured results of finished recognitions: id, ocr_result_id, user_id, content (JSON text), status."""
    r = results(spark, sf_dir).filter("status = 'done'").alias("r")
    s = table(spark, sf_dir, "supplier").alias("s")
    p = table(spark, sf_dir, "part").alias("p")
    i = images(spark, sf_dir).alias("i")
    rows = r.join(i, F.col("i.id") == F.col("r.image_id")).join(s, F.col("s.s_suppkey") == F.col("r.l_suppkey"), "left").join(p, F.col("p.p_partkey") == F.col("r.l_partkey"), "left")
    n = F.col("r.l_linenumber")
    year = F.when(F.col("r.l_partkey") % 17 == 0, "未知").when(F.col("r.l_partkey") % 19 != 0, F.year("r.created_at").cast("string"))
    place = F.when(F.col("s.s_suppkey") % 13 == 0, "未记载").when(F.col("s.s_suppkey") % 11 == 0, "未识别").otherwise(F.concat(F.lit("東村"), F.col("s.s_nationkey"), F.element_at(F.array(F.lit(""), F.lit("处"), F.lit("地方")), (F.col("r.l_partkey") % 3 + 1).cast("int"))))
    middle = F.when(n % 3 == 0, F.concat("p.p_brand", F.lit("、"), "p.p_type")).when(n % 3 == 1, F.col("p.p_brand")).otherwise("未识别")
    price = F.when(n == 6, "银十二两五钱").when(n == 5, "面议").when(n < 5, F.concat(F.col("r.l_extendedprice").cast("decimal(14,2)").cast("string"), F.lit("两")))
    content = F.to_json(F.struct(year.alias("Time_AD"), place.alias("Location"), F.col("s.s_name").alias("Seller"), F.concat(F.lit("Customer"), F.col("i.user_id")).alias("Buyer"), middle.alias("Middleman"), price.alias("Price"), F.col("p.p_name").alias("Subject")))
    return rows.select((F.col("r.id") + 5).alias("id"), F.col("r.id").alias("ocr_result_id"), F.col("r.image_id"), F.col("i.user_id"), content.alias("content"), F.lit("done").alias("status"))


def deed_facts(structured: DataFrame) -> DataFrame:
    """The fields of each structured result: content is decoded tolerantly, a year is a number or null."""
    fact = F.from_json("content", CONTENT)
    rows = structured.withColumn("fact", fact)
    fields = [F.col(f"fact.{x}").alias(x.lower()) for x in ("Location", "Seller", "Buyer", "Middleman", "Price", "Subject")]
    return rows.select("id", "image_id", "user_id", as_text(F.col("fact.Time_AD")).try_cast("int").alias("year"), *fields)


#: The same in DuckDB: results `r`, structured facts `f`.
SQL = """
r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS image_id, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_returnflag <> 'N' THEN 'done' WHEN l_linestatus = 'F' THEN 'failed' ELSE 'processing' END AS status,
    round(1 - l_discount, 2) AS confidence, l_quantity / 50 AS coverage, l_discount >= 0.08 AS human_corrected,
    CASE WHEN l_tax > 0 THEN ' part ' || l_partkey END AS raw_text,
    CASE WHEN l_discount >= 0.1 THEN '   ' WHEN l_discount >= 0.05 THEN '  PART ' || l_partkey END AS corrected_text,
    l_extendedprice, l_shipdate AS created_at
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS rn FROM lineitem) WHERE rn = 1),
i AS (SELECT o_orderkey AS id, o_custkey AS user_id, 'img_' || o_orderkey || '.jpg' AS filename, o_orderdate AS upload_time FROM orders),
f AS (SELECT r.id + 5 AS id, r.id AS ocr_result_id, r.image_id, i.user_id,
    CASE WHEN l_partkey % 17 <> 0 AND l_partkey % 19 <> 0 THEN year(created_at)::INTEGER END AS year,
    CASE WHEN s_suppkey % 13 = 0 THEN '未记载' WHEN s_suppkey % 11 = 0 THEN '未识别' ELSE '東村' || s_nationkey || (['', '处', '地方'])[l_partkey % 3 + 1] END AS location,
    CASE WHEN s_suppkey % 13 = 0 OR s_suppkey % 11 = 0 THEN '' ELSE '东村' || s_nationkey END AS place,
    s_name AS seller, 'Customer' || i.user_id AS buyer, p_brand, p_type, p_name AS subject,
    CASE WHEN l_linenumber % 3 = 0 THEN p_brand || '、' || p_type WHEN l_linenumber % 3 = 1 THEN p_brand ELSE '未识别' END AS middleman,
    CASE WHEN l_linenumber = 6 THEN '银十二两五钱' WHEN l_linenumber = 5 THEN '面议' WHEN l_linenumber < 5 THEN l_extendedprice::DECIMAL(14, 2) || '两' END AS price,
    CASE WHEN l_linenumber = 6 THEN 12.5 WHEN l_linenumber < 5 THEN l_extendedprice::DECIMAL(14, 2)::DOUBLE END AS value
  FROM r JOIN i ON i.id = r.image_id LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey WHERE r.status = 'done')
"""
