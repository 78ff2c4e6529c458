"""Similarity of names, places and boxes, as columns: built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.text import let, normal_chars, normal_place, surname


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def char_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def char_similarity(a: Column, b: Column) -> Column:
    """Of names in standard characters: 1 if equal, 0.8 if one holds the other, else edits and shared characters; short names rest on edits."""
    edits = F.when(F.greatest(F.length(a), F.length(b)) <= 3, F.lit(0.7)).otherwise(F.lit(0.4))
    mixed = edits * edit_similarity(a, b) + (1 - edits) * char_jaccard(a, b)
    return F.when(a == b, F.lit(1.0)).when(b.contains(a) | a.contains(b), F.lit(0.8)).otherwise(let(mixed, lambda m: F.when(m >= 0.35, m).otherwise(F.lit(0.0))))


def name_similarity(first: Column, second: Column, semantic: Column | None = None) -> Column:
    """Characters (0.35), meaning (0.65; characters again without vectors), and whether surnames agree."""
    meaning = F.lit(None).cast("double") if semantic is None else semantic
    names = F.struct(normal_chars(first).alias("a"), normal_chars(second).alias("b"))
    known = let(names, lambda n: F.struct(char_similarity(n.a, n.b).alias("chars"), ((surname(n.a) != "") & (surname(n.a) == surname(n.b))).alias("family"), meaning.alias("meaning")))

    def judged(k: Column) -> Column:
        fused = 0.35 * k.chars + 0.65 * F.coalesce(k.meaning, k.chars)
        moved = let(fused, lambda v: F.when(k.family & (v >= 0.25), F.least(F.lit(1.0), v + 0.08)).when(~k.family & (k.chars < 0.3), v * 0.7).otherwise(v))
        return F.when(k.chars == 1.0, F.lit(1.0)).when((k.chars < 0.1) & ~k.family & k.meaning.isNull(), F.lit(0.0)).otherwise(moved)

    return let(known, judged)


def person_similarity(name_a: Column, name_b: Column, year_a: Column, year_b: Column, place_a: Column, place_b: Column, semantic: Column | None = None) -> Column:
    """Name 0.55, years up to 0.20, places up to 0.25; 0 if the names have nothing in common."""
    years = let(F.abs(year_a - year_b), lambda gap: F.when(gap == 0, 0.20).when(gap <= 3, 0.18).when(gap <= 10, 0.14).when(gap <= 30, 0.08).when(gap <= 60, 0.04).otherwise(0.0))
    both = F.struct(normal_place(F.coalesce(place_a, F.lit(""))).alias("x"), normal_place(F.coalesce(place_b, F.lit(""))).alias("y"))

    def near(p: Column) -> Column:
        loose = let(edit_similarity(p.x, p.y), lambda e: F.when(e >= 0.6, e * 0.15).otherwise(F.lit(0.0)))
        return F.when((p.x == "") | (p.y == ""), F.lit(0.0)).when(p.x == p.y, F.lit(0.25)).when(p.x.contains(p.y) | p.y.contains(p.x), F.lit(0.18)).otherwise(loose)

    names = name_similarity(name_a, name_b, semantic)
    return let(names, lambda n: F.when(n < 0.1, F.lit(0.0)).otherwise(n * 0.55 + F.coalesce(years, F.lit(0.0)) + let(both, near)))


def _overlap(a: list[Column], b: list[Column]) -> Column:
    return F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def _area(a: list[Column]) -> Column:
    return F.greatest(F.lit(1), (a[2] - a[0]) * (a[3] - a[1]))


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2)."""
    return _overlap(a, b) / (_area(a) + _area(b) - _overlap(a, b))


def box_containment(a: list[Column], b: list[Column]) -> Column:
    return _overlap(a, b) / F.least(_area(a), _area(b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is."""
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)
