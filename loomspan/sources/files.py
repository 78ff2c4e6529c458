"""File sources and sinks: uploads, binary reads, derived files, ground truth maps, reports."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGE_TYPES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff")
MOST_BYTES = 10 * 1024 * 1024


def images(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of a folder with content; only what a query asks for is read (path and length come from the listing)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def gated(files: DataFrame, *, types: tuple[str, ...] = IMAGE_TYPES, most: int = MOST_BYTES) -> DataFrame:
    """Files (path, length) with the reason for which an upload is refused, or null."""
    reason = F.when(~extension(F.col("path")).isin(*types), "type").when(F.col("length") == 0, "empty").when(F.col("length") > most, "too large")
    return files.withColumn("refused", reason)


def stored_name(user_id: Column, name: Column, salt: Column) -> Column:
    """A safe, unique name: tenant, a digest, the name's own letters and digits."""
    clean = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"[^\w.\-]", "_")
    return F.concat_ws("_", user_id.cast("string"), F.left(F.sha2(F.concat_ws("/", name, salt.cast("string")), 256), F.lit(8)), clean)


def outdated(sources: DataFrame, derived: DataFrame) -> DataFrame:
    """Sources without a derived file of their stem, or with an older one."""
    made = derived.select(stem(F.col("path")).alias("stem"), F.col("modificationTime").alias("made"))
    rows = sources.withColumn("stem", stem(F.col("path"))).join(made, "stem", "left")
    return rows.filter(F.col("made").isNull() | (F.col("made") < F.col("modificationTime"))).drop("made")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of key -> {title, body} as rows (key, title, body)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string, struct<title: string, body: string>>"))).select("key", "value.*")


def canonical(files: DataFrame, keys: DataFrame, *, avoid: str = "背面") -> DataFrame:
    """The best file for each key: its stem begins with the key (dots for ·); an equal stem first, then the shortest, then by name.

    Stems meet keys by their leading characters up to the key's length: an equi-join on that prefix.
    """
    named = files.select("path", stem(F.col("path")).alias("stem")).filter(~F.col("stem").contains(avoid))
    wanted = keys.select("key", F.replace("key", F.lit("·"), F.lit(".")).alias("prefix"))
    lengths = F.broadcast(wanted.select(F.length("prefix").alias("n")).distinct())  # a few lengths
    rows = named.join(lengths, F.length("stem") >= F.col("n")).withColumn("prefix", F.expr("left(stem, n)")).join(wanted, "prefix")
    order = [F.col("stem") != F.col("prefix"), F.length("stem"), F.lower("path")]
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter("rn = 1").select("key", "path")


def matched_truth(results: DataFrame, truth: DataFrame, *, pattern: str = r"(\d+[.·]\d+)") -> DataFrame:
    """The latest result for each key that its filename holds, with the true text."""
    keyed = results.withColumn("key", F.replace(F.regexp_extract("filename", pattern, 1), F.lit("."), F.lit("·"))).filter("key <> ''")
    latest = keyed.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("id")))).filter("rn = 1").drop("rn")
    return latest.join(truth.select("key", F.col("body").alias("truth")), "key")


def first_match(results: DataFrame, keys: DataFrame, *, pattern: str = r"(\d+\.\d+)") -> DataFrame:
    """For each key (dots for ·) the first result by id whose filename's first number is the key."""
    named = results.withColumn("prefix", F.regexp_extract(F.lower("filename"), pattern, 1)).filter("prefix <> ''")
    first = named.groupBy("prefix").agg(F.min("id").alias("id"))
    return keys.withColumn("prefix", F.replace("key", F.lit("·"), F.lit("."))).join(first, "prefix").drop("prefix")


def event_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as server-sent events: one `data:` line of JSON each; letters beyond ASCII stay as they are."""
    return rows.withColumn("event", F.concat(F.lit("data: "), F.to_json(F.struct(*columns))))


def event_stream(lines: DataFrame, order: list[str]) -> Iterator[str]:
    """The events in order, a partition at a time, and the closing one."""
    for row in lines.orderBy(*order).select("event").toLocalIterator():
        yield row.event + "\n\n"
    yield "data: [DONE]\n\n"


def log_lines(rows: DataFrame, logger: str, message: str, extra: list[str]) -> DataFrame:
    """Structured log lines as JSON: time, level, logger, message, and extra fields that aren't null."""
    fields = [F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), "level", F.lit(logger).alias("logger"), F.lit(message).alias("message"), *extra]
    return rows.withColumn("line", F.to_json(F.struct(*fields)))


def report(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """A report as JSON lines: what was measured, and its summary.  Letters beyond ASCII stay as they are."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    summary.write.mode("overwrite").json(f"{path}/summary")


def paired_payload(recognised: DataFrame) -> DataFrame:
    """Parallel arrays of a recogniser (texts, scores, boxes) as one row for each line; missing ones have defaults."""
    n = F.size("texts")
    at = lambda c, k: F.try_element_at(c, (k + 1).cast("int"))
    lines = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.cast("int").alias("pos"), F.coalesce(at("texts", k), F.lit("")).alias("text"), F.coalesce(at("scores", k), F.lit(0.0)).alias("score"), F.coalesce(at("boxes", k), F.array().cast("array<int>")).alias("box")))
    return recognised.filter(n > 0).select("page", F.explode(lines).alias("l")).select("page", "l.*")
