"""Segments of recognised pages: overlap, duplicates, clusters, reading order, votes of several views and recognisers."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.similarity import box_containment, box_iou
from loomspan.functions.text import PLACEHOLDER, visible_length
from loomspan.operators.grouped import per_group

BOX = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in BOX]


def overlaps(segments: DataFrame, page: str, *, iou: float = 0.45, contained: float = 0.72, cell: int = 64) -> DataFrame:
    """Pairs of segments of a page that overlap: (page, a, b, iou, containment).

    Boxes meet in the cells of a grid that they touch, so that a page of many boxes isn't paired with itself.
    """
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    placed = segments.withColumn("gx", F.explode(cells("x1", "x2"))).withColumn("gy", F.explode(cells("y1", "y2")))
    a, b = (placed.select(page, "gx", "gy", *[F.col(c).alias(f"{x}_{c}") for c in ("seg", *BOX)]) for x in "ab")
    pairs = a.join(b, [page, "gx", "gy"]).filter("a_seg < b_seg").drop("gx", "gy").distinct()
    scored = pairs.withColumns({"iou": box_iou(box("a_"), box("b_")), "containment": box_containment(box("a_"), box("b_"))})
    return scored.filter((F.col("iou") >= iou) | (F.col("containment") >= contained)).select(page, F.col("a_seg").alias("a"), F.col("b_seg").alias("b"), F.round("iou", 6).alias("iou"), F.round("containment", 6).alias("containment"))


def _iou(boxes: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intersection over union, and over the smaller area, of boxes with one box."""
    inner = np.clip(np.minimum(boxes[:, 2:], one[2:]) - np.maximum(boxes[:, :2], one[:2]), 0, None).prod(1)
    areas, own = np.maximum(1, (boxes[:, 2:] - boxes[:, :2]).prod(1)), max(1, (one[2:] - one[:2]).prod())
    return inner / (areas + own - inner), inner / np.minimum(areas, own)


def suppress(boxes: np.ndarray, scores: np.ndarray, *, iou: float = 0.85) -> list[int]:
    """Rows that stay: from the greatest score on, those that no kept one overlaps."""
    kept: list[int] = []
    for i in np.argsort(-scores, kind="stable").tolist():
        if not kept or (_iou(boxes[kept], boxes[i])[0] < iou).all():
            kept.append(i)
    return kept


def cluster(boxes: np.ndarray, scores: np.ndarray, *, iou: float = 0.45) -> np.ndarray:
    """Cluster of each row: from the greatest score on, a box joins the first cluster of which it overlaps a member."""
    members: list[list[int]] = []
    out = np.zeros(len(boxes), np.int64)
    for i in np.argsort(-scores, kind="stable").tolist():
        for k, own in enumerate(members):
            a, b = _iou(boxes[own], boxes[i])
            if ((a >= iou) | (b >= max(0.72, iou))).any():
                own.append(i)
                out[i] = k
                break
        else:
            out[i] = len(members)
            members.append([i])
    return out


def lines_along(centers: np.ndarray, tolerance: float, *, backwards: bool) -> np.ndarray:
    """Line of each center: taken in order, one joins the first line whose running mean is near; lines are numbered in reading order."""
    means: list[float] = []
    held: list[list[int]] = []
    for i in np.argsort(-centers if backwards else centers, kind="stable").tolist():
        for k, mean in enumerate(means):
            if abs(centers[i] - mean) <= tolerance:
                held[k].append(i)
                means[k] = float(np.mean(centers[held[k]]))
                break
        else:
            means.append(float(centers[i]))
            held.append([i])
    out = np.zeros(len(centers), np.int64)
    for n, k in enumerate(np.argsort(-np.array(means) if backwards else np.array(means), kind="stable")):
        out[held[k]] = n
    return out


def reading_order(boxes: np.ndarray, size: tuple[float, float]) -> tuple[np.ndarray, str]:
    """(position of each box, orientation): columns from the right, or rows from the top, as the median shape says."""
    extent = np.maximum(1, boxes[:, 2:] - boxes[:, :2])
    vertical = float(np.median(extent[:, 1] / extent[:, 0])) >= 1.15
    axis = 0 if vertical else 1
    tolerance = max(18.0, size[axis] * 0.025, 1.5 * float(np.median(extent[:, axis])))
    line = lines_along((boxes[:, axis] + boxes[:, axis + 2]) / 2, tolerance, backwards=vertical)
    order = np.lexsort((boxes[:, 1 - axis], line))
    place = np.empty(len(boxes), np.int64)
    place[order] = np.arange(len(boxes))
    return place, "vertical" if vertical else "horizontal"


def laid_out(segments: DataFrame, page: str, *, size: tuple[float, float] = (1000.0, 1000.0), iou: float = 0.85) -> DataFrame:
    """Segments of each page without duplicates, in reading order: page, seg, segment_id, order_index, layout_orientation.

    A page's segments go through Python together: they are those of one image.
    """

    def one(number, c) -> list[tuple]:
        boxes = np.stack([c[x] for x in BOX], 1).astype(float)
        kept = suppress(boxes, c["score"].astype(float), iou=iou)
        place, kind = reading_order(boxes[kept], size)
        return [(number, c["seg"][i], f"s{p:04d}", p, kind) for i, p in zip(kept, place.tolist(), strict=True)]

    return per_group(segments.select(page, "seg", *BOX, "score"), page, ["seg"], one, f"{page} long, seg long, segment_id string, order_index int, layout_orientation string")


def clustered(segments: DataFrame, page: str, *, iou: float = 0.45) -> DataFrame:
    """Segments of all views of each page with the cluster to which they belong."""

    def one(number, c) -> list[tuple]:
        boxes = np.stack([c[x] for x in BOX], 1).astype(float)
        return [(number, seg, k) for seg, k in zip(c["seg"], cluster(boxes, c["score"].astype(float), iou=iou).tolist(), strict=True)]

    return per_group(segments.select(page, "seg", *BOX, "score"), page, ["seg"], one, f"{page} long, seg long, cluster long")


def fixed_order(segments: DataFrame, page: str, *, vertical: bool = True) -> DataFrame:
    """Reading order for a configured orientation: a sort by two keys."""
    keys = [F.desc("x1"), F.asc("y1")] if vertical else [F.asc("y1"), F.asc("x1")]
    order = Window.partitionBy(page).orderBy(*keys, "seg")
    return segments.withColumn("order_index", F.row_number().over(order) - 1).withColumn("segment_id", F.format_string("s%04d", F.col("order_index")))


def union_box(segments: DataFrame, key: list[str]) -> DataFrame:
    return segments.groupBy(*key).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def best_of(segments: DataFrame, key: list[str]) -> DataFrame:
    """The best segment of each group: confidence, then score, then visible length; of equals the smallest number."""
    order = F.struct("confidence", "score", visible_length(F.replace(F.coalesce("text", F.lit("")), F.lit(PLACEHOLDER), F.lit(""))).alias("n"), (-F.col("seg")).alias("s"))
    return segments.groupBy(*key).agg(F.max_by(F.struct("seg", "text", "confidence"), order).alias("b")).select(*key, "b.*")


def voted(segments: DataFrame, key: list[str]) -> DataFrame:
    """The text on which at least two views of each group agree, with the least confidence among these: most views, then segments, then confidence."""
    texts = segments.filter((F.col("text") != "") & (F.col("text") != PLACEHOLDER)).groupBy(*key, "text").agg(F.countDistinct("view").alias("views"), F.count("*").alias("n"), F.sum("confidence").alias("total"), F.min("confidence").alias("confidence"))
    best = texts.groupBy(*key).agg(F.max(F.struct("views", "n", "total", "text", "confidence")).alias("b"))
    return best.filter("b.views >= 2").select(*key, "b.text", "b.views", F.round("b.confidence", 4).alias("confidence"))


def masked(first: pd.Series, second: pd.Series) -> pd.DataFrame:
    """What two readings share, each stretch of difference one placeholder, and how alike they are."""
    texts, alike = [], []
    for a, b in zip(first, second, strict=True):
        match = SequenceMatcher(None, a or "", b or "", autojunk=False)
        shared = "".join(a[i:k] if tag == "equal" else PLACEHOLDER for tag, i, k, _, _ in match.get_opcodes()) if a and b else ""
        texts.append(re.sub(f"{PLACEHOLDER}+", PLACEHOLDER, shared))
        alike.append(match.ratio() if a and b else 0.0)
    return pd.DataFrame({"text": texts, "similarity": alike})


def consensus(segments: DataFrame, key: list[str], *, similar: float = 0.4, most_chars: int = 6, sure: float = 0.75) -> DataFrame:
    """The text of each group of segments of several views: text, status, confidence, reason.

    Two views that agree decide.  Else the two surest readings, differences masked, if alike enough; else the best
    single one, if short and sure; else a placeholder.
    """
    agreed = voted(segments, key).select(*key, F.col("text").alias("vote"), F.col("confidence").alias("vote_confidence"))
    read = segments.filter((F.col("text") != "") & (F.col("text") != PLACEHOLDER))
    ranked = read.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("confidence"), "seg"))).filter("k <= 2")
    two = ranked.groupBy(*key).agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in (1, 2) for c in ("text", "confidence")])
    best = best_of(segments, key).select(*key, F.coalesce("text", F.lit("")).alias("best"), F.col("confidence").alias("best_confidence"))
    rows = best.join(agreed, key, "left").join(two, key, "left").withColumn("m", F.when(F.col("vote").isNull() & F.col("text2").isNotNull(), F.pandas_udf(masked, "text string, similarity double")("text1", "text2")))
    vote = F.col("vote").isNotNull()
    mask = F.coalesce((F.replace("m.text", F.lit(PLACEHOLDER), F.lit("")) != "") & (F.col("m.similarity") >= similar), F.lit(False))
    short = (F.length("best") <= most_chars) & (F.col("best_confidence") >= sure)
    pick = lambda a, b, c, d: F.when(vote, a).when(mask, b).when(short, c).otherwise(d)
    return rows.select(
        *key,
        pick(F.col("vote"), F.col("m.text"), F.col("best"), F.lit(PLACEHOLDER)).alias("text"),
        pick(F.lit("accepted"), F.when(F.col("m.text").contains(PLACEHOLDER), "partial").otherwise("accepted"), F.lit("accepted"), F.lit("uncertain")).alias("status"),
        F.round(pick(F.col("vote_confidence"), F.least("confidence1", "confidence2") * F.col("m.similarity"), F.col("best_confidence"), F.lit(0.0)), 4).alias("confidence"),
        pick(F.lit("accepted:multiview"), F.lit("masked:multiview_disagreement"), F.lit("accepted:single_view_short_high_confidence"), F.lit("uncertain:single_view_long_or_low_confidence")).alias("reason"),
    )


def voted_chars(slots: DataFrame, key: list[str], *, least: float = 0.5) -> DataFrame:
    """The character that two recognisers at least agree on (sure enough, but for `medium`); else a placeholder with 0."""
    votes = slots.filter("length(char) = 1").filter((F.col("source") == "medium") | (F.col("score") >= least)).groupBy(*key, "char").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.min("score").alias("score"))
    best = votes.filter("n >= 2").groupBy(*key).agg(F.max(F.struct("n", "total", "char", "score")).alias("b"))
    every = slots.select(*key).distinct()
    return every.join(best, key, "left").select(*key, F.coalesce("b.char", F.lit(PLACEHOLDER)).alias("char"), F.round(F.coalesce("b.score", F.lit(0.0)), 4).alias("score"))


def rescue_candidates(pairs: DataFrame, *, least: float = 0.6) -> DataFrame:
    """Lines whose characters are recognised one by one: short ones on which sure recognisers differ, or where one is missing or unsure."""
    a, b = F.col("medium_text"), F.coalesce(F.col("small_text"), F.lit(""))
    sure = F.least("medium_score", F.coalesce("small_score", F.lit(0.0))) >= least
    differ = (b != "") & (a != b) & (F.greatest(F.length(a), F.length(b)) <= 4) & sure
    weak = F.length(a).between(2, 4) & ((b == "") | ~sure)
    return pairs.withColumn("rescue", (F.coalesce(a, F.lit("")) != "") & (differ | weak))


def paired(medium: DataFrame, small: DataFrame, page: str) -> DataFrame:
    """Lines of two recognisers by place; where the second has none its text is empty and its score 0."""
    other = small.select(page, "pos", F.col("text").alias("small_text"), F.col("score").alias("small_score"))
    return medium.withColumnsRenamed({"text": "medium_text", "score": "medium_score"}).join(other, [page, "pos"], "left").withColumns({"small_text": F.coalesce("small_text", F.lit("")), "small_score": F.coalesce("small_score", F.lit(0.0))})


def page_quality(segments: DataFrame, page: str) -> DataFrame:
    """Confidence weighted by length, and share of visible characters, both 1 at most; reasons without `accepted:`, each once, in order."""
    n = F.length("medium_text")
    seen = F.length(F.replace("text", F.lit(PLACEHOLDER), F.lit("")))
    share = lambda x: F.round(F.least(F.lit(1.0), F.sum(x) / F.greatest(F.sum(n), F.lit(1))), 4)
    reasons = F.filter(F.sort_array(F.array_distinct(F.flatten(F.collect_set("reasons")))), lambda r: ~r.startswith("accepted:"))
    return segments.groupBy(page).agg(share(n * F.col("confidence")).alias("confidence"), share(seen).alias("coverage"), reasons.alias("reasons"))
