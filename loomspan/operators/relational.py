"""Relational operators of the multi-tenant store: lineage joins, latest rows, pages, locks, merges, cascades."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point(df: DataFrame, key: int, user_id: int, *, key_col: str = "id") -> DataFrame:
    """One row by key and tenant."""
    return df.filter((F.col(key_col) == key) & (F.col("user_id") == user_id)).limit(1)


def latest_per(df: DataFrame, parent: str, *, order: str = "id") -> DataFrame:
    """The row of the greatest `order` of each parent; the window is cut before the shuffle (WindowGroupLimit)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(parent).orderBy(F.desc(order)))).filter("_rn = 1").drop("_rn")


def first_seen(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the first in an order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def top_per(df: DataFrame, key: str, order: list[Column], most: int, *, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col(name) <= most)


def page(df: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    """A page of at most 100 rows in an order that ties can't change."""
    if skip < 0 or not 1 <= limit <= 100:
        raise ValueError("skip must be 0 or more, limit 1 to 100")
    return df.orderBy(*order).offset(skip).limit(limit)


def lineage(images: DataFrame, results: DataFrame, structured: DataFrame | None = None, graphs: DataFrame | None = None) -> DataFrame:
    """image -> result -> structured result -> graph, as inner joins on their keys; ids under the names of their tables."""
    df = results.withColumnRenamed("id", "ocr_result_id").join(images.select(F.col("id").alias("image_id"), "user_id", "filename", "upload_time"), "image_id")
    if structured is not None:
        df = df.join(structured.select(F.col("id").alias("structured_id"), "ocr_result_id", "content"), "ocr_result_id")
    if graphs is not None:
        df = df.join(graphs.select(F.col("id").alias("graph_id"), "structured_id"), "structured_id")
    return df


def with_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Parents with the number of their children, 0 without any; counted before the join."""
    counts = children.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias(name))
    return parents.join(counts, parents["id"] == counts["_key"], "left").drop("_key").withColumn(name, F.coalesce(name, F.lit(0)))


def missing(wanted: DataFrame, have: DataFrame, key: str = "id") -> DataFrame:
    """Wanted keys that don't exist."""
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")


def locks(results: DataFrame, now: datetime, *, minutes: int = 30) -> DataFrame:
    """State of rows in work: `blocked` if begun within the last minutes, else they count as failed (`stale`)."""
    since = F.lit(now) - F.expr(f"INTERVAL {minutes} MINUTES")
    return results.filter("status = 'processing'").withColumn("lock", F.when(F.col("created_at") >= since, "blocked").otherwise("stale"))


def upsert(current: DataFrame, changes: DataFrame, key: str, *, order: str) -> DataFrame:
    """The last change of each key replaces its row or is added; other rows stay.  Both sides have the same columns."""
    last = latest_per(changes, key, order=order)
    return current.join(last.select(key), key, "left_anti").select(*current.columns).unionByName(last.select(*current.columns))


def delete(current: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Without rows of these ids; unknown ids don't matter."""
    return current.join(ids.select(key).distinct(), key, "left_anti").select(*current.columns)


def cascade(tables: list[tuple[str, DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """What is left of a chain of tables, each (name, rows, column that names the parent), when the first one's parents in `gone` (id) go."""
    left = {}
    for name, df, parent in tables:
        dead = gone.select(F.col("id").alias(parent)).distinct()
        left[name] = df.join(dead, parent, "left_anti").select(*df.columns)
        gone = df.join(dead, parent, "left_semi").select("id")
    return left


def migrated(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns that are missing are added as nulls of their types; the rest stays as it is."""
    return df.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in columns.items() if c not in df.columns])


def repaired(df: DataFrame) -> DataFrame:
    """Legacy rows: a raw text that a correction overwrote moves to corrected_text, the original comes back; without a correction the flag goes."""
    moved = F.col("human_corrected") & F.col("corrected_text").isNull() & F.col("original_raw_text").isNotNull() & (F.col("original_raw_text") != F.col("raw_text"))
    rows = df.withColumns({"corrected_text": F.when(moved, F.col("raw_text")).otherwise(F.col("corrected_text")), "raw_text": F.when(moved, F.col("original_raw_text")).otherwise(F.col("raw_text"))})
    return rows.withColumn("human_corrected", F.col("human_corrected") & F.col("corrected_text").isNotNull())


def copied(rows: DataFrame, existing: DataFrame, user_id: int, prefix: str) -> DataFrame:
    """Rows for another tenant under generated names; names that it has already are left out, so a second run adds nothing."""
    named = rows.withColumns({"filename": F.concat(F.lit(prefix), F.col("filename")), "user_id": F.lit(user_id)})
    return named.join(existing.filter(F.col("user_id") == user_id).select("filename"), "filename", "left_anti")


def merged_edits(kept: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Corrected segments: an edit replaces the text of its segment, new ones are added; order by segment."""
    both = kept.withColumn("_new", F.lit(0)).unionByName(edits.withColumn("_new", F.lit(1)))
    return first_seen(both, keys, [F.desc("_new")]).drop("_new")


def page_with_total(df: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    """A page, and beside each of its rows the number of all rows, counted apart from it."""
    return page(df, order, skip, limit).crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))


def taken(df: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Wanted values (id, value) with whether another row than that of the same id has the value."""
    held = df.select(F.col("id").alias("_id"), F.col(column).alias("value"))
    others = wanted.join(held, "value").filter("_id <> id").select("id").distinct().withColumn("taken", F.lit(True))
    return wanted.join(others, "id", "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


def with_tenant(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent exists, with its tenant."""
    return children.join(parents.select(F.col("id").alias(key), "user_id"), key)


def with_parent(children: DataFrame, parents: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Children, all of them, with columns of their parent; null where there is none."""
    return children.join(parents.select(F.col("id").alias(key), *columns), key, "left")


def bridged(bridge: DataFrame, structured: DataFrame, results: DataFrame, task: str) -> DataFrame:
    """The documents of tasks: bridge (task, structured_id) to structured results to recognition results."""
    rows = bridge.join(structured.select(F.col("id").alias("structured_id"), "ocr_result_id"), "structured_id")
    return rows.join(results.select(F.col("id").alias("ocr_result_id"), "image_id", "confidence"), "ocr_result_id").select(task, "structured_id", "ocr_result_id", "image_id", "confidence")


def zipped(df: DataFrame, key: list[str], left: str, right: str) -> DataFrame:
    """Elements of two arrays by place (key, pos, left, right), up to the end of the shorter one."""
    n = F.least(F.size(left), F.size(right))
    return df.select(*key, F.posexplode(F.arrays_zip(F.slice(left, F.lit(1), n).alias("a"), F.slice(right, F.lit(1), n).alias("b")))).select(*key, "pos", F.col("col.a").alias(left), F.col("col.b").alias(right))


def last_of(df: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """One value for each key: the last one written."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def reopened(current: DataFrame, wanted: DataFrame, parent: str, now: datetime) -> DataFrame:
    """For each wanted parent its latest row is reset to processing, or a new one made; other rows stay.

    current has id, the parent's key, content, status and created_at.  New ids follow the greatest one.
    """
    wanted = wanted.select(parent).distinct()
    reset = latest_per(current, parent).join(wanted, parent, "left_semi").select("id", F.lit(True).alias("_reset"))
    fresh = {"content": F.lit("{}"), "status": F.lit("processing"), "created_at": F.lit(now)}
    rows = current.join(reset, "id", "left")
    rows = rows.withColumns({c: F.when(F.col("_reset"), v).otherwise(F.col(c)) for c, v in fresh.items()}).select(*current.columns)
    top = F.broadcast(current.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")))
    new = wanted.join(current.select(parent), parent, "left_anti").crossJoin(top).withColumns({"id": F.col("_top") + F.col(parent), **fresh})
    return rows.unionByName(new.select(*current.columns))


def created_task(task_id: int, user_id: int, wanted: DataFrame, structured: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """A task of a tenant and its links to structured results (wanted: structured_id).

    Both are made or none: a result that doesn't exist raises LookupError, one of another tenant PermissionError.
    """
    known = wanted.select("structured_id").join(structured.select(F.col("id").alias("structured_id"), "user_id"), "structured_id", "left")
    state = known.agg(F.sum(F.col("user_id").isNull().cast("int")).alias("missing"), F.sum((F.col("user_id") != user_id).cast("int")).alias("foreign")).first()
    if state.missing:
        raise LookupError(f"{state.missing} structured results don't exist")
    if state.foreign:
        raise PermissionError(f"{state.foreign} structured results belong to other tenants")
    stamp = F.lit(now).alias("created_at")
    task = wanted.sparkSession.range(1).select(F.lit(task_id).cast("long").alias("id"), F.lit(user_id).cast("long").alias("user_id"), stamp)
    return task, wanted.select(F.lit(task_id).cast("long").alias("multi_task_id"), "structured_id", stamp)


def cascade_counts(tables: list[tuple[str, DataFrame, str]], gone: DataFrame) -> DataFrame:
    """How many rows of each table of a chain go (name, n) when the first one's parents in `gone` (id) go."""
    out = None
    for name, df, parent in tables:
        gone = df.join(gone.select(F.col("id").alias(parent)).distinct(), parent, "left_semi").select("id")
        one = gone.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
