"""Document fingerprints by invertible Bloom lookup sketches, with DataFrame functions only.

A text's paragraphs are digested, and each digest goes to one cell of each of three tables.  A cell holds the number of
its digests, their exclusive or, and the exclusive or of their check values.  Cells of two versions subtract; in the
difference a cell with a single digest (its check value fits) names a paragraph that only one version has.  Taking
it out of its other cells brings up more (peeling), until nothing is left: then all differing digests are known.  If
cells remain, both versions are sketched again with four times the cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.shared import doc_columns

#: Cells in each of the three tables of the fingerprint; every retry has four times as many.
CELLS, TABLES, RETRIES = 8, 3, 9
#: Lines longer than this are cut after the ends of sentences.
LONG_LINE = 400
ROUNDS = 90
CELL = "struct<cell:int,n:int,key:bigint,chk:bigint>"


def digests(text: str) -> str:
    """SQL: the distinct digests of a text's paragraphs (lines; long lines are cut after sentences), blanks at the ends aside."""
    cut = rf"flatten(transform(split({text}, '\\n'), l -> if(length(l) > {LONG_LINE}, split(l, '(?<=[.!?]) '), array(l))))"
    return f"array_distinct(transform(filter(transform({cut}, p -> trim(p)), p -> p <> ''), p -> xxhash64(p)))"


def place(key: str, table: str, size: str) -> str:
    """SQL: the cell of a digest in a table of a power of two cells: digests are hashes, so each table takes other bits of them."""
    return f"({table} * {size} + cast(shiftrightunsigned({key}, 21 * {table}) & ({size} - 1) as int))"


def cells_of(key: str, size: str, sign: str) -> str:
    """SQL: the entries of one digest, one for each table, as an array."""
    one = [f"struct({place(key, str(t), size)} as cell, {sign} as n, {key} as key, xxhash64({key}, 77) as chk)" for t in range(TABLES)]
    return f"array({', '.join(one)})"


def merged(entries: str) -> str:
    """SQL: entries summed by cell; empty cells are left out.  Sorted entries are folded once from left to right."""
    start = f"struct(cast(array() as array<{CELL}>) as done, struct(-1 as cell, 0 as n, 0L as key, 0L as chk) as now)"
    filled = "(acc.now.n <> 0 or acc.now.key <> 0 or acc.now.chk <> 0)"
    done = f"if({filled}, concat(acc.done, array(acc.now)), acc.done)"
    return f"""aggregate(sort_array({entries}), {start},
        (acc, e) -> if(acc.now.cell = e.cell,
            struct(acc.done as done, struct(e.cell as cell, acc.now.n + e.n as n, acc.now.key ^ e.key as key, acc.now.chk ^ e.chk as chk) as now),
            struct({done} as done, e as now)),
        acc -> {done})"""


def sketch(keys: str, size: str, sign: str = "1") -> str:
    return merged(f"flatten(transform({keys}, k -> {cells_of('k', size, sign)}))")


def let(name: str, value: str, body: str) -> str:
    """SQL has no local names outside of lambdas: a lambda over an array of one."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def peeled(cells: str, size: str) -> str:
    """SQL: how many digests differ, from the cells of a difference; -1 if some can't be recovered.

    Rounds take the tables in turn: a digest has one cell in a table, so none is taken twice.  A cell with one digest
    goes, and that digest is taken out of its cells in the other tables.  Three idle rounds in a row are the end.
    """
    pure = f"(c.cell div {size} = i % {TABLES} and (c.n = 1 or c.n = -1) and xxhash64(c.key, 77) = c.chk)"
    others = f"transform(filter(sequence(0, {TABLES - 1}), t -> t <> i % {TABLES}), t -> struct({place('c.key', 't', size)} as cell, -c.n as n, c.key as key, c.chk as chk))"
    left = merged(f"concat(filter(s.cells, c -> not {pure}), flatten(transform(p, c -> {others})))")
    step = let("p", f"filter(s.cells, c -> {pure})", f"if(size(p) = 0, struct(s.cells as cells, s.found as found, s.idle + 1 as idle), struct({left} as cells, s.found + size(p) as found, 0 as idle))")
    return f"""aggregate(sequence(1, {ROUNDS}), struct({cells} as cells, 0 as found, 0 as idle),
        (s, i) -> if(s.idle = {TABLES} or size(s.cells) = 0, s, {step}), s -> if(size(s.cells) = 0, s.found, -1))"""


def likeness(a_keys: str, b_keys: str, a_cells: str, b_cells: str) -> str:
    """SQL: shared over all digests of two versions, from their sketches; larger ones until the difference is recovered.

    Should all retries fail, the digests themselves are compared.
    """
    negated = f"transform({b_cells}, c -> struct(c.cell as cell, -c.n as n, c.key as key, c.chk as chk))"
    # counts of the difference tell about how many digests differ: squares add up, for each table, to their number and
    # to what one version has more; so sizes that can't do aren't tried
    gap = f"(size({a_keys}) - size({b_keys}))"
    guess = f"greatest(abs({gap}), aggregate(d0, 0, (t, c) -> t + c.n * c.n) / {TABLES} - {gap} * {gap} / {CELLS})"
    first = f"if(g > {CELLS * TABLES // 2}, -1, {peeled('d0', str(CELLS))})"
    size = f"(cast({CELLS} * power(4, r) as int))"
    again = let("d", merged(f"flatten(concat(transform({a_keys}, k -> {cells_of('k', size, '1')}), transform({b_keys}, k -> {cells_of('k', size, '-1')})))"), peeled("d", size))
    retried = f"aggregate(sequence(1, {RETRIES}), {first}, (found, r) -> if(found >= 0 or g > {TABLES} * {size} / 2, found, {again}))"
    retried = let("d0", merged(f"concat({a_cells}, {negated})"), let("g", guess, retried))
    both = f"(size({a_keys}) + size({b_keys}))"
    exact = f"(size(array_except({a_keys}, {b_keys})) + size(array_except({b_keys}, {a_keys})))"
    share = f"if({both} = 0, 1D, ({both} - d) / cast({both} + d as double))"
    return let("e", retried, let("d", f"if(e < 0, {exact}, e)", share))


def printed(cells: str) -> str:
    """SQL: the filled cells in order as a string: for each its place, number of digests, exclusive or and check value."""
    one = f"transform({cells}, c -> concat(lpad(hex(c.cell), 2, 0), lpad(hex(c.n), 8, 0), lpad(hex(c.key), 16, 0), lpad(hex(c.chk & 4294967295L), 8, 0)))"
    return f"base64(unhex(concat_ws('', {one})))"


def fingerprints(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Adds to docs: digests (array), cells (the sketch) and fingerprint (its string), for every whole text.

    Null and empty texts have an empty sketch.  Equal texts have equal fingerprints.  Columns of these names are replaced.
    """
    df = docs.withColumn("digests", F.expr(digests(f"coalesce({text_col}, '')")))
    df = df.withColumn("cells", F.expr(sketch("digests", str(CELLS))))
    return df.withColumn("fingerprint", F.expr(printed("cells")))


def range_of(key: str, bounds: list[int]) -> str:
    """SQL: how many of the sorted bounds are below key, by binary search."""
    if not bounds:
        return "0"
    listed = f"array({', '.join(f'{b}L' for b in bounds)})"
    half = "((s.lo + s.hi) div 2)"
    step = f"if(element_at({listed}, cast({half} + 1 as int)) < {key}, struct({half} + 1 as lo, s.hi as hi), struct(s.lo as lo, {half} as hi))"
    return f"cast(aggregate(sequence(1, {len(bounds).bit_length()}), struct(0L as lo, {len(bounds)}L as hi), (s, i) -> if(s.lo < s.hi, {step}, s), s -> s.lo) as int)"


def with_next(rows: DataFrame, derived: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, text) with `next_text`: the text of the next row by descending doc_id (of equal ids by text); after the last comes the first.

    Columns `derived` from the text (name: SQL) are computed once a row, before it moves, and come with it: as they are
    and, under next_..., those of the next row.

    Rows go to ranges of ids, cut at quantiles of all ids: twice as many as there are shuffle partitions, each found by
    binary search.  Each range also gets a copy of what follows it: the rows of the greatest id of the next lower range,
    and for the lowest those of the greatest of all.  So texts are shuffled once, and no range depends on another.  A
    null id counts as the least.
    """
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(-(2**63))))
    spark = rows.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(rows.select(F.percentile_approx("k", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []))
    rows = rows.withColumn("part", F.expr(range_of("k", bounds)))
    tops = [(r.part, r.top) for r in rows.groupBy("part").agg(F.max("k").alias("top")).orderBy("part").collect()]
    if not tops:
        tops = [(0, -(2**63))]
    after = [(tops[i - 1][1], tops[i][0], 0) for i in range(1, len(tops))] + [(tops[-1][1], tops[0][0], 1)]
    heads = spark.createDataFrame(after, "k long, to long, wrap int")
    extra = rows.join(F.broadcast(heads), "k").select("doc_id", "text", "k", F.col("to").cast("int").alias("part"), F.lit(1).alias("extra"), "wrap")
    every = rows.select("doc_id", "text", "k", "part", F.lit(0).alias("extra"), F.lit(0).alias("wrap")).unionByName(extra)
    for name, sql in (derived or {}).items():
        every = every.withColumn(name, F.expr(sql))
    own = ["text", *(derived or {})]
    order = Window.partitionBy("part").orderBy("wrap", F.desc("k"), "extra", "text")
    return every.withColumns({f"next_{c}": F.lead(c).over(order) for c in own}).filter("extra = 0").select("doc_id", *own, *[f"next_{c}" for c in own])


def version_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of its edited version and of the next text, compared.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.  The edited
    version replaces the last half (rounded down) by as much of the beginning of the next text, by descending id.
    Likeness is the share of paragraph digests that both have, 1 for two texts without any.  Null texts are empty;
    the next text of an only row is its own.  An empty table gives an empty result; other columns are ignored.
    """
    size = str(CELLS)
    rows = with_next(doc_columns(docs, id_col=id_col, text_col=text_col), {"own": digests("text"), "own_cells": sketch("own", size)})
    rows = rows.withColumnsRenamed({"next_own": "nx", "next_own_cells": "nx_cells"}).withColumn("n_chars", F.length("text").cast("long"))
    half = "cast(floor(n_chars / 2) as int)"
    rows = rows.withColumn("edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {half}), substring(next_text, 1, {half}))"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "own_cells", "nx", "nx_cells", F.expr(digests("edited")).alias("ed"))
    rows = rows.withColumn("ed_cells", F.expr(sketch("ed", size)))
    near = lambda c: F.expr(likeness("own", c, "own_cells", f"{c}_cells"))
    return rows.select("doc_id", "n_chars", "edited_sha256", F.expr(printed("own_cells")).alias("fingerprint"), F.expr(printed("ed_cells")).alias("edited_fingerprint"), near("ed").alias("near_edited"), near("nx").alias("near_next"))
