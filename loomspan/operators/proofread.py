"""Proofreading: which text is in force, overlays of edits, tones, errors by kind, refreshed results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import PLACEHOLDER, VARIANTS
from loomspan.operators.relational import latest_per

# Plain numerals and the forms that documents use instead.
NUMERAL_FORMS = dict(zip("一二三四五六七八九十百千", "壹貳叁肆伍陸柒捌玖拾佰仟", strict=True))


def valid_username(name: Column) -> Column:
    return F.length(name).between(3, 32) & name.rlike(r"^[a-zA-Z0-9_\x{4e00}-\x{9fff}]+$")


def valid_password(password: Column) -> Column:
    return F.length(password) >= 8


def legacy_correction(df: DataFrame) -> Column:
    """What a person corrected, for rows of any age: the correction, or a raw text that replaced its original; else null."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    replaced = F.coalesce(F.col("human_corrected"), F.lit(False)) & ~blank("original_raw_text") & ~blank("raw_text") & (F.col("raw_text") != F.col("original_raw_text"))
    return F.when(~blank("corrected_text"), F.col("corrected_text")).when(replaced, F.col("raw_text"))


def tone(status: Column, text: Column) -> Column:
    shown = F.coalesce(text, F.lit(""))
    return F.when(status == "rejected", "rejected").when(shown.contains(PLACEHOLDER) | (status == "uncertain"), "uncertain").when(status == "partial", "partial").otherwise("accepted")


def overlaid(segments: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with the text in force: the edit of its key if there is one (even an empty text), else its own."""
    new = edits.select(*keys, F.col("text").alias("_new"), F.lit(True).alias("_edited"))
    rows = segments.join(new, keys, "left")
    return rows.withColumn("text", F.when(F.col("_edited"), F.col("_new")).otherwise(F.coalesce("text", F.lit("")))).drop("_new", "_edited")


def composed(segments: DataFrame, key: str, order: str) -> DataFrame:
    """The text of each page from its segments in order, blank ones left out."""
    rows = segments.filter(F.coalesce("text", F.lit("")) != "")
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda s: s.text), "\n").alias("text"))


def in_percent(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes in percent of their image; null where the image has no size."""
    w, h = F.nullif(width, F.lit(0)), F.nullif(height, F.lit(0))
    return df.withColumns({"left": F.col("x1") / w * 100, "top": F.col("y1") / h * 100, "width": (F.col("x2") - F.col("x1")) / w * 100, "height": (F.col("y2") - F.col("y1")) / h * 100})


def error_kind(truth: Column, guess: Column) -> Column:
    """Of a pair of characters (empty: none): missing, extra, simplified, number_variant or wrong."""
    pairs = {(c, g[-1]) for g in VARIANTS for c in g[:-1]}
    both = F.concat(truth, guess)
    within = lambda known: both.isin(*sorted({a + b for a, b in known} | {b + a for a, b in known}))
    numbers = set(NUMERAL_FORMS.items())
    return F.when(guess == "", "missing").when(truth == "", "extra").when(within(pairs - numbers), "simplified").when(within(numbers), "number_variant").otherwise("wrong")


def refreshed(items: DataFrame, parent: str) -> DataFrame:
    """Whether each item differs from the one before it (by id) of its parent: another id or another time; the first always."""
    order = Window.partitionBy(parent).orderBy("id")
    return items.withColumn("refreshed", F.lag("id").over(order).isNull() | (F.lag("created_at").over(order) != F.col("created_at")))


def reprocessed(images: DataFrame, results: DataFrame, fresh: DataFrame) -> DataFrame:
    """The latest finished result of each image, overwritten by a fresh recognition; what a person corrected stays.

    images: id, path; fresh: image_id, text, new_confidence, ok.  Returns all images as image_id, outcome (`skipped`
    without a path or a finished result, `failed` if recognition failed, else `repaired`), and for repaired ones id,
    raw_text (a placeholder for a blank text), corrected_text, human_corrected and confidence.
    """
    latest = latest_per(results.filter("status = 'done'"), "image_id").withColumn("correction", legacy_correction(results))
    rows = images.select(F.col("id").alias("image_id"), "path").join(latest.select("image_id", "id", "correction"), "image_id", "left").join(fresh, "image_id", "left")
    outcome = F.when(F.col("path").isNull() | F.col("id").isNull(), "skipped").when(~F.coalesce("ok", F.lit(False)), "failed").otherwise("repaired")
    done = lambda c: F.when(F.col("outcome") == "repaired", c)
    text = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit(PLACEHOLDER))
    rows = rows.withColumn("outcome", outcome)
    return rows.select("image_id", "outcome", done(F.col("id")).alias("id"), done(text).alias("raw_text"), done(F.col("correction")).alias("corrected_text"), done(F.col("correction").isNotNull()).alias("human_corrected"), done(F.col("new_confidence")).alias("confidence"))


def char_shares(df: DataFrame, column: str) -> DataFrame:
    """chars, placeholders, placeholder_rate and visible of a text, blanks aside."""
    shown = F.regexp_replace(F.coalesce(column, F.lit("")), r"\s", "")
    n = F.length(shown)
    held = n - F.length(F.replace(shown, F.lit(PLACEHOLDER), F.lit("")))
    return df.withColumns({"chars": n, "placeholders": held, "placeholder_rate": F.round(held / F.greatest(n, F.lit(1)), 4), "visible": (n - held) > 0})


def run_counters(outcomes: DataFrame) -> DataFrame:
    """scanned, repaired, skipped, failed of a run, in one pass."""
    count = lambda what: F.coalesce(F.sum((F.col("outcome") == what).cast("long")), F.lit(0)).alias(what)
    return outcomes.agg(F.count("*").alias("scanned"), count("repaired"), count("skipped"), count("failed"))
