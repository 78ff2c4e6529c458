"""The eight tables of the store: explicit schemas, creation, reading, integrity, vector collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspan.operators.relational import delete, upsert

STATUS = ("pending", "processing", "done", "failed")

#: Columns of each table and, in REFERENCES, which table each key points to.
SCHEMAS = {
    "user": "id int, username string, email string, password_hash string, created_at timestamp",
    "image": "id int, user_id int, filename string, path string, upload_time timestamp",
    "ocr_result": "id int, image_id int, raw_text string, status string, confidence double, coverage double, engine string, model_versions string, original_raw_text string, corrected_text string, segments_json string, corrected_segments_json string, correction_metadata_json string, rejection_reasons string, crop_bbox_json string, image_size_json string, human_corrected boolean, created_at timestamp",
    "structured_result": "id int, ocr_result_id int, content string, status string, created_at timestamp",
    "relation_graph": "id int, structured_result_id int, content string, status string, created_at timestamp",
    "multi_task": "id int, user_id int, status string, created_at timestamp",
    "multi_relation_graph": "id int, multi_task_id int, content string, status string, created_at timestamp",
    "multi_task_structured_result": "id int, multi_task_id int, structured_result_id int, created_at timestamp",
}
REFERENCES = {
    "image": {"user_id": "user"},
    "ocr_result": {"image_id": "image"},
    "structured_result": {"ocr_result_id": "ocr_result"},
    "relation_graph": {"structured_result_id": "structured_result"},
    "multi_task": {"user_id": "user"},
    "multi_relation_graph": {"multi_task_id": "multi_task"},
    "multi_task_structured_result": {"multi_task_id": "multi_task", "structured_result_id": "structured_result"},
}
VECTORS = "id string, text string, vector array<float>, metadata map<string,string>"

BOX = "array<int>"
SEGMENT = f"segment_id string, text string, status string, confidence double, bbox {BOX}, view string, source_views array<string>, rejection_reasons array<string>"


def schema(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def create(spark: SparkSession, database: str) -> None:
    """Create the tables that don't exist yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.`{name}` ({columns}) USING parquet")


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of Parquet files under path, by its schema: no file is opened to infer one."""
    return spark.read.schema(schema(table)).parquet(f"{path}/{table}")


def over_jdbc(spark: SparkSession, url: str, table: str, *, parts: int = 16, low: int = 0, high: int = 1 << 31) -> DataFrame:
    """A table of a relational database, read in ranges of its key."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn="id", lowerBound=low, upperBound=high, numPartitions=parts).load()


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows whose key points to nothing: (table, column, id).  Spark enforces no foreign keys; this is the check."""
    out = None
    for name, keys in REFERENCES.items():
        for column, parent in keys.items():
            if name in tables and parent in tables:
                lost = tables[name].join(tables[parent].select(F.col("id").alias(column)), column, "left_anti")
                lost = lost.select(F.lit(name).alias("table"), F.lit(column).alias("column"), F.col("id").cast("long").alias("id"))
                out = lost if out is None else out.unionByName(lost)
    return out


def segments_of(results: DataFrame) -> DataFrame:
    """The segments of each result as rows, decoded tolerantly: text that isn't JSON gives none."""
    fields = ", ".join(c.replace(" ", ": ", 1) for c in SEGMENT.split(", "))
    return results.select("id", F.posexplode(F.from_json("segments_json", f"array<struct<{fields}>>"))).select("id", "pos", "col.*")


def payload(results: DataFrame) -> DataFrame:
    """Result rows with their JSON columns decoded, the original text where it was kept, and the text in force."""
    decoded = {"rejection_reasons": F.from_json("rejection_reasons", "array<string>"), "crop_bbox": F.from_json("crop_bbox_json", BOX), "image_size": F.from_json("image_size_json", BOX), "correction_metadata": F.from_json("correction_metadata_json", "map<string,string>")}
    rows = results.withColumns(decoded).drop("crop_bbox_json", "image_size_json", "correction_metadata_json")
    return rows.withColumn("original_text", F.coalesce(F.nullif(F.col("original_raw_text"), F.lit("")), F.col("raw_text")))


def patched(results: DataFrame, edits: DataFrame) -> DataFrame:
    """Corrections (id, text, editor): the original text is kept once, the correction set, the row flagged, who made it noted."""
    rows = results.join(edits.select("id", F.col("text").alias("_text"), F.col("editor").alias("_editor")), "id", "left")
    edited = F.col("_text").isNotNull()
    note = F.to_json(F.struct(F.col("_editor").alias("editor"), F.length("_text").alias("length")))
    rows = rows.withColumns({"original_raw_text": F.when(edited & F.col("original_raw_text").isNull(), F.col("raw_text")).otherwise(F.col("original_raw_text")), "corrected_text": F.when(edited, F.col("_text")).otherwise(F.col("corrected_text")), "human_corrected": edited | F.col("human_corrected"), "correction_metadata_json": F.when(edited, note).otherwise(F.col("correction_metadata_json"))})
    return rows.drop("_text", "_editor").select(*results.columns)


def put_vectors(collection: DataFrame, changes: DataFrame) -> DataFrame:
    """Documents by id: a change (with its number `n`) replaces or adds; the last of several counts."""
    return upsert(collection, changes, "id", order="n")


def drop_vectors(collection: DataFrame, ids: DataFrame) -> DataFrame:
    return delete(collection, ids, "id")


def count_vectors(collection: DataFrame, where: dict[str, str] | None = None) -> int:
    for key, value in (where or {}).items():
        collection = collection.filter(F.try_element_at("metadata", F.lit(key)) == value)
    return collection.count()
