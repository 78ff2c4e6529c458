"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document with n shingles links only to documents that share at least T = ceil(0.75 n) of them: those that occur at
least T times on its n inverted lists.  DivideSkip sets the T - 1 longest lists aside.  What occurs T times must occur
once at least on the other n - T + 1 short lists, so only these are merged; what they bring up is then probed in the
long lists by binary search until it reaches the overlap or can't.

On a cluster: shingles that turn up often in any block of documents form a bounded set of long lists, which come last
in one order shared by all documents.  The short lists of all documents are merged by a shuffle on the shingle, in packed
blocks; lists of one class of equal documents drop out there.  Documents on a list are compared to its first
document, not to each other.  Linked ones form components, and what remains are lists on which several components
meet: there, pairs of different components are compared, but for those that the distances to the first document
exclude (Jaccard distance is a metric), until they are known to be one.  Before sets move to be probed, bitmaps move
alone and exclude pairs that differ in too many shingles; only sets of rows that bitmaps leave follow.  So every link
between different components is found, and no group of near copies is expanded into all of its pairs.

Tasks read sorted rows and hold the lists of a few groups at a time, not their whole partition; lists of one first
document are dealt to as many parts as their rows need.  Each saved table goes as soon as the next one replaces it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.components import components
from loomspan.llm.shared import batch_of, doc_columns, frequent, map_arrow, pieces, release, written

#: Words of a shingle; least similarity in hundredths.
WORDS, LEAST = 5, 75
#: A shingle in so many documents of one block, and of all blocks, is on a long list; at most LONG_MOST of these are told apart.
LONG_BLOCK, LONG_ALL, LONG_MOST = 3, 24, 400_000
BLOCK_SHINGLES = 2_000_000
KEEP_WORDS = 250_000
#: Ids of documents to verify that are sent to all tasks at most (8 bytes each).
WANTED_MOST = 2_000_000
#: Rows of dropped documents, or of first documents of many rows, that are sent to all tasks at most.
SENT_MOST = 300_000
#: Shingles of a bucket of short lists; rows that a task holds at a time, but for a longer list; rows of a part of a first document's lists.
BUCKET_SHINGLES, HELD_ROWS, PART_ROWS = 1_000_000, 50_000, 1_500
#: After every shingle, in the order of signed numbers.
LAST = 2**63 - 1


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def mix(a: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        a = (a ^ (a >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        a = (a ^ (a >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return a ^ (a >> np.uint64(33))


def shingles(text: str, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: 5 words each; with fewer words the whole sequence; none without words."""
    words = text.encode().lower().split()
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(w))
    if not k:
        return w
    total = np.full(len(w) - k + 1, np.uint64(k))
    with np.errstate(over="ignore"):
        for i in range(k):
            total = total * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
    return np.unique(mix(total))


def needed(n: int) -> int:
    """T: what a set of n must share with any partner."""
    return (LEAST * n + 99) // 100


def signed(shingle: int) -> int:
    """A shingle as a signed number, in the same order."""
    return shingle - 2**63


def same(sets: np.ndarray) -> int:
    """A 64-bit digest of a set, as a signed number: the class of documents with equal sets."""
    return int(np.frombuffer(xxhash.xxh3_64_digest(sets.tobytes()), ">i8")[0])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets: the smaller probes the larger by binary search."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def bitmap(own: np.ndarray) -> bytes:
    """A set's shingles as bits, four for each at least: a power of two, 64 at least."""
    size = max(64, 1 << max(0, 4 * len(own) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(own >> np.uint64(11)) & np.uint64(size - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(x: bytes, n: int, y: bytes, m: int) -> bool:
    """Whether bitmaps of sets of n and m allow a link: each bit that only one has is a shingle that the other lacks."""
    while len(x) != len(y):  # fold the longer one
        if len(x) > len(y):
            half = len(x) // 2
            x = (int.from_bytes(x[:half]) | int.from_bytes(x[half:])).to_bytes(half)
        else:
            half = len(y) // 2
            y = (int.from_bytes(y[:half]) | int.from_bytes(y[half:])).to_bytes(half)
    a, b = int.from_bytes(x), int.from_bytes(y)
    shared = min(n - (a & ~b).bit_count(), m - (b & ~a).bit_count())
    return 100 * shared >= LEAST * (n + m - shared)


def long_lists(rows: DataFrame) -> np.ndarray:
    """Shingles of the longest lists, counted over all documents block by block."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size, seen = WordHashes(), [], 0, set()

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= LONG_BLOCK
            return batch_of(schema, h[often].view(np.int64), n[often])

        for batch in batches:
            for part in pieces(batch, "text"):
                for text in part.column(1).to_pylist():
                    own = shingles(text, hashes)
                    if (key := same(own)) not in seen:
                        seen.add(key)
                        held.append(own)
                        size += len(own)
                if len(hashes) > KEEP_WORDS:
                    hashes.clear()
                if size > BLOCK_SHINGLES:
                    yield counted()
                    held, size = [], 0
                    seen.clear()
        if held:
            yield counted()

    found = rows.select("doc_id", "text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counted_all = written(found.filter(F.col("n") >= LONG_ALL), "long-lists")
    top = np.sort(frequent(counted_all, "n", "h", LONG_MOST).select("h").toArrow().column(0).to_numpy().view(np.uint64))
    release(counted_all)
    return top


def in_order(own: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, int]:
    """A set in the shared order, long lists last, and how many of it are not long."""
    if not len(long):
        return own, len(own)
    at = np.searchsorted(long, own)
    at[at == len(long)] = 0
    is_long = long[at] == own
    return np.concatenate([own[~is_long], own[is_long]]), int((~is_long).sum())


def shingle_sets(rows: DataFrame, long: np.ndarray) -> DataFrame:
    """(doc_id, mark, n, class, until, bits, short, long) of each document: bitmap, and shingles whose lists are merged, packed, by kind of list.

    `mark` is a hash of the text, which with the id tells rows apart.

    `until` is the last of the merged short ones, in the order of signed numbers, or LAST if all short ones are merged.
    """
    held = rows.sparkSession.sparkContext.broadcast(long)
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("until", pa.int64()), ("bits", pa.binary()), ("short", pa.binary()), ("long", pa.binary())])

    def make():
        hashes, sent = WordHashes(), set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, keys, ends, bits, short, far = [], [], [], [], [], []
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                own = shingles(text, hashes)
                key = same(own)
                n.append(len(own))
                keys.append(key if len(own) and doc_id is not None else None)
                if key in sent or keys[-1] is None:  # one row of a class brings its lists
                    ends.append(None)
                    for column in (bits, short, far):
                        column.append(b"")
                    continue
                sent.add(key)
                ordered, border = in_order(own, held.value)
                merged = ordered[: len(own) - needed(len(own)) + 1]
                ends.append(LAST if border <= len(merged) else signed(int(merged[-1])))
                bits.append(bitmap(own))
                short.append(merged[:border].tobytes())
                far.append(merged[border:].tobytes())
            if len(hashes) > KEEP_WORDS:
                hashes.clear()
            if len(sent) > KEEP_WORDS:
                sent.clear()
            return batch_of(schema, batch.column("doc_id"), batch.column("mark"), n, keys, ends, bits, short, far)

        return step

    return map_arrow(rows.withColumn("mark", F.xxhash64("text")), make, "doc_id long, mark long, n long, class long, until long, bits binary, short binary, long binary")


def whole(batches: Iterable[pa.RecordBatch], *keys: str, most: int | None = None) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by keys: as many groups as make HELD_ROWS rows (or `most`), one at least."""
    held: list[pa.RecordBatch] = []
    rows, last, most = 0, None, most or HELD_ROWS
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        starts = np.flatnonzero(np.append(last is None or any(c[0] != x for c, x in zip(columns, last, strict=True)), np.any([c[1:] != c[:-1] for c in columns], 0)))
        last = [c[-1] for c in columns]
        if len(starts) and rows + starts[-1] >= most:
            if rows + starts[-1]:
                yield pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
            held, rows, batch = [], 0, batch.slice(starts[-1])
        held.append(batch)
        rows += batch.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def merged_lists(sets: DataFrame, buckets: int) -> DataFrame:
    """(h, class, is_long) on short lists with two classes at least, and on long lists."""
    packed = np.dtype([("h", "<u8"), ("c", "<i8")])
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.binary())])
    out = pa.schema([("h", pa.int64()), ("class", pa.int64())])

    def unpack(batch: pa.RecordBatch, column: str) -> np.ndarray:
        raw = batch.column(batch.schema.get_field_index(column)).to_pylist()
        found = np.empty(sum(map(len, raw)) // 8, packed)
        found["h"] = np.frombuffer(b"".join(raw), "<u8")
        found["c"] = np.repeat(batch.column("class").to_numpy(), [len(x) // 8 for x in raw])
        return found

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = unpack(batch, "short")
            bucket = (own["h"] % np.uint64(buckets)).astype(np.int32)
            own, bucket = own[(order := np.argsort(bucket, kind="stable"))], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            full = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
            yield batch_of(schema, full, [own[cuts[b] : cuts[b + 1]].tobytes() for b in full])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches, "bucket", most=1):
            own = np.concatenate([np.frombuffer(x, packed) for x in table.column("block").to_pylist()])
            own = own[np.lexsort((own["c"], own["h"]))]
            own = own[np.append(True, own[1:] != own[:-1])]
            equal = own["h"][1:] == own["h"][:-1]
            own = own[np.append(equal, False) | np.append(False, equal)]
            for at in range(0, len(own), 100_000):
                part = own[at : at + 100_000]
                yield batch_of(out, part["h"].view(np.int64), part["c"])

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = unpack(batch, "long")
            yield batch_of(out, own["h"].view(np.int64), own["c"])

    short = sets.select("class", "short").filter("length(short) > 0").mapInArrow(pack, "bucket int, block binary")
    short = short.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "h long, class long")
    far = sets.select("class", "long").filter("length(long) > 0").mapInArrow(spread, "h long, class long")
    return short.withColumn("is_long", F.lit(False)).unionByName(far.distinct().withColumn("is_long", F.lit(True)))


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (a, b) of classes those whose sizes and bitmaps allow a link."""
    side = lambda c: classes.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    fits = (F.col("n_a") * 100 >= F.col("n_b") * LEAST) & (F.col("n_b") * 100 >= F.col("n_a") * LEAST)
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(fits).select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(i).to_pylist() for i in range(2, 6))
            yield batch.select(["a", "b"]).filter(pa.array(map(may_link, x, n, y, m), pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def sets_of(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(class, own) of the rows with the wanted ids.  Up to WANTED_MOST ids are sent to the rows; beyond, rows are joined to them."""
    spark = rows.sparkSession
    schema = pa.schema([("class", pa.int64()), ("own", pa.binary())])
    many = wanted.count()
    if many <= WANTED_MOST:
        held = spark.sparkContext.broadcast(np.sort(wanted.select("doc_id").toArrow().column(0).to_numpy()))
    else:
        held, rows = None, rows.join(wanted, "doc_id", "left_semi")

    def make():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1)
            if held is not None:
                texts = texts.filter(pa.array(np.isin(batch.column(0).to_numpy(zero_copy_only=False), held.value)))
            own = [shingles(t, hashes) for t in texts.to_pylist()]
            if len(hashes) > KEEP_WORDS:
                hashes.clear()
            return batch_of(schema, list(map(same, own)), [s.tobytes() for s in own])

        return step

    return map_arrow(rows.filter("doc_id is not null"), make, "class long, own binary")


def verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, shared, either): sizes of intersection and union of the sets of classes a and b, probed by binary search."""
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = wanted.join(classes, "class").select(F.col("rep").alias("doc_id")).distinct()
    # ids may repeat with other texts: the class is taken from the text, and one row of each kept
    wanted = written(wanted, "wanted")
    own = written(sets_of(wanted, rows).dropDuplicates(["class"]), "sets", wanted)
    right = pairs.select("a", "b").join(own.select(F.col("class").alias("b"), F.col("own").alias("right")), "b")
    both = right.join(own.select(F.col("class").alias("a"), F.col("own").alias("left")), "a")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("either", pa.int64())])

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3))
            shared = [overlap(x, y) for x, y in zip(left, right, strict=True)]
            yield batch_of(out, batch.column(0), batch.column(1), shared, [len(x) + len(y) - s for x, y, s in zip(left, right, shared, strict=True)])

    return written(both.select("a", "b", "left", "right").mapInArrow(probe, "a long, b long, shared long, either long"), "verified", own)


def _compared(h: np.ndarray, n: np.ndarray, most: np.ndarray, until: np.ndarray, label: np.ndarray, far: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of lists (sorted by list and size) and others on the same list, of another component, that could link.

    Sizes, what the one whose merged shingles end first can share (`most`), and distances to the list's first document
    must allow it.  A row looks only at sizes that its own `most` allows, and is the one that ends first.
    """
    if not len(h):
        return
    # n_i + n_k - shared is the union: 75 (n_i + n_k) <= 175 shared, and shared <= n_i, n_k, most of the first to end
    low = -(-LEAST * n // 100)
    high = np.minimum(100 * n // LEAST, ((100 + LEAST) * most - LEAST * n) // LEAST)
    width = int(n.max()) + 2
    at_list = np.cumsum(np.append(0, h[1:] != h[:-1])) * width
    place = at_list + n
    other = np.searchsorted(place, at_list + low)
    stop = np.searchsorted(place, at_list + np.clip(high, -1, width - 1), "right")
    open_rows = np.flatnonzero(other < stop)
    other, stop = other[open_rows], stop[open_rows]
    while len(open_rows):
        before, both = until[open_rows] < until[other], until[open_rows] == until[other]
        # of rows that end alike each must allow it, and the pair is taken once
        ok = before | (both & (open_rows < other) & (n[open_rows] <= high[other]))
        ok &= label[open_rows] != label[other]
        ok &= ~(np.abs(far[open_rows] - far[other]) > 1 - LEAST / 100 + 1e-9)  # unknown distances exclude nothing
        yield open_rows[ok], other[ok]
        other = other + 1
        goes_on = other < stop
        open_rows, other, stop = open_rows[goes_on], other[goes_on], stop[goes_on]


def _columns(table: pa.Table) -> list[np.ndarray]:
    """h, n, most, until, label and far of rows; without a label a class is its own, without a distance it is unknown."""
    names = table.column_names
    found = [table.column(c).to_numpy() for c in ("h", "n", "most", "until", "label" if "label" in names else "class")]
    return [*found, table.column("far").to_numpy() if "far" in names else np.full(len(table), np.nan)]


def _viable(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, n, most, until, class, ...) of lists, sorted by list, that could link to another row of theirs."""
    for table in whole(batches, "h"):
        h, n, *others = _columns(table)
        order = np.lexsort((n, h))
        found = np.zeros(len(h), bool)
        for x, y in _compared(*(c[order] for c in (h, n, *others))):
            found[x] = found[y] = True
            if found.all():
                break
        yield from table.take(pa.array(order[found])).to_batches(max_chunksize=100_000)


def _groups(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.Table, dict[int, bytes]]]:
    """Of rows sorted by (first, part): those of lists, by list and size, and what rows with `column` bring for classes."""
    for table in whole(batches, "first", "part"):
        brings = pc.is_valid(table.column(column))
        given = table.filter(brings)
        held = dict(zip(given.column("class").to_pylist(), given.column(column).to_pylist(), strict=True))
        rows = table.filter(pc.invert(brings)).drop_columns(column)
        order = np.lexsort((rows.column("n").to_numpy(), rows.column("h").to_numpy()))
        yield rows.take(pa.array(order)), held


def _close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lists that could link to another component's row of theirs by bitmaps as well."""
    for rows, bits in _groups(batches, "bits"):
        n, c = rows.column("n").to_numpy(), rows.column("class").to_numpy()
        found, known = np.zeros(len(n), bool), {}
        for x, y in _compared(*_columns(rows)):
            open_pairs = ~(found[x] & found[y])
            for i, k in zip(x[open_pairs].tolist(), y[open_pairs].tolist(), strict=True):
                pair = (min(c[i], c[k]), max(c[i], c[k]))
                if (ok := known.get(pair)) is None:
                    ok = known[pair] = may_link(bits[c[i]], int(n[i]), bits[c[k]], int(n[k]))
                if ok:
                    found[i] = found[k] = True
            if len(known) > 1_000_000:
                known.clear()
        yield from rows.filter(pa.array(found)).to_batches(max_chunksize=100_000)


def _meetings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between components on lists (h, n, most, until, label, far, class, own); rows with own bring the set of a class.

    Sets are probed for each pair that could link, until its components are known to be one: so a task returns fewer
    links than it has components.
    """
    joined: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := joined.get(x, x)) != x:
            joined[x] = joined.get(up, up)
            x = up
        return x

    for rows, packed in _groups(batches, "own"):
        sets = {c: np.frombuffer(x, np.uint64) for c, x in packed.items()}
        h, n, most, until, label, far = _columns(rows)
        c = rows.column("class").to_numpy()
        seen: set[tuple[int, int]] = set()
        links: list[tuple[int, int]] = []
        for x, y in _compared(h, n, most, until, label, far):
            for i, k in zip(x.tolist(), y.tolist(), strict=True):
                pair = (min(c[i], c[k]), max(c[i], c[k]))
                a, b = root(int(label[i])), root(int(label[k]))
                if a == b or pair in seen:
                    continue
                seen.add(pair)
                shared = overlap(sets[c[i]], sets[c[k]])
                if 100 * shared >= LEAST * (n[i] + n[k] - shared):
                    joined[max(a, b)] = min(a, b)
                    links.append(pair)
            if len(seen) > 1_000_000:
                seen.clear()
        if links:
            yield batch_of(pa.schema([("a", pa.int64()), ("b", pa.int64())]), *zip(*links, strict=True))


def _dealt(rows: DataFrame, brings: DataFrame, column: str, run: Callable, schema: str) -> DataFrame:
    """run() over rows of lists and, for each class of a part, one row with its `column`: both sorted by (first, part)."""
    sent = rows.select("first", "part", "class").distinct().join(brings.select("class", column), "class")
    both = rows.withColumn(column, F.lit(None).cast("binary")).unionByName(sent, allowMissingColumns=True)
    return both.repartition("first", "part").sortWithinPartitions("first", "part").mapInArrow(run, schema)


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate classes of whole texts: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Two documents link if 100 x intersection >= 75 x union of their sets of 5-word shingles.  Null and empty texts and
    texts of blanks have no shingles and stay alone, as do rows with a null id.  Repeated rows and copies share one component; rows are kept as
    they are, one result row each.  An empty table gives an empty result; other columns are ignored.
    """
    found = _labelled(doc_columns(docs, id_col=id_col, text_col=text_col))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _labelled(rows: DataFrame) -> DataFrame:
    """(doc_id, mark, n, label, component_id) of each row; label and component_id are null where nothing can be linked."""
    spark = rows.sparkSession
    sets = written(shingle_sets(rows, long_lists(rows)), "shingles")
    classes = written(sets.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("until").alias("until"), F.max("bits").alias("bits"), (F.max(F.length("short")) / 8).cast("long").alias("n_short")), "classes")
    own = written(sets.select("doc_id", "mark", "n", "class"), "rows")
    packed = sets.agg(F.sum(F.length("short")).alias("bytes")).first().bytes or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), packed // (8 * BUCKET_SHINGLES))
    lists = written(merged_lists(sets, buckets), "lists", sets)

    # A shingle alone on its short list is in no other document whose merged shingles end at the same place or later.
    # So of two documents, what remains of the one that ends first is all that they can share.
    shared = lists.filter("not is_long").groupBy("class").agg(F.count("*").alias("met"))
    sizes = classes.join(shared, "class", "left").select("class", "n", (F.col("n") - F.col("n_short") + F.coalesce("met", F.lit(0))).alias("most"), "until")
    # rows that could link to none on their list go before anything else is done with the lists
    every = lists.join(sizes, "class").select("h", "n", "most", "until", "class")
    viable = written(every.repartition("h").sortWithinPartitions("h").mapInArrow(_viable, every.schema), "viable")
    first = viable.groupBy("h").agg(F.min("class").alias("first"))
    listed = written(viable.join(first, "h"), "listed", viable)
    # 75 (n_a + n_b) <= 175 shared
    share = "CASE WHEN until_a < until THEN most_a WHEN until < until_a THEN most ELSE least(most_a, most) END"
    fits = f"{LEAST} * (n_a + n) <= {100 + LEAST} * {share}"
    stars = listed.filter("class <> first").select(F.col("first").alias("a"), F.col("class").alias("b"), "n", "most", "until").distinct()
    stars = stars.join(sizes.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("most").alias("most_a"), F.col("until").alias("until_a")), "a").filter(fits).select("a", "b")
    pairs = written(possible(stars, classes), "pairs", lists)
    seen = verified(pairs, rows, classes)
    linked = F.col("shared") * 100 >= F.col("either") * LEAST
    links = seen.filter(linked).select("a", "b")
    labels = components(links).withColumnRenamed("id", "class")

    marked = listed.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    several = marked.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("h")
    far = seen.select(F.col("a").alias("first"), F.col("b").alias("class"), (1 - F.col("shared") / F.col("either")).alias("far"))
    rest = marked.join(several, "h", "left_semi").filter("class <> first").join(far, ["first", "class"], "left")
    rest = rest.select("h", "n", "most", "until", "label", F.coalesce("far", F.lit(float("nan"))).alias("far"), "class", "first")
    rest = written(rest.repartition("h").sortWithinPartitions("h").mapInArrow(_viable, rest.schema), "rest", pairs, listed)
    if not rest.isEmpty():
        # lists of one first document meet in as few parts as their rows need, so that few copies of a set are sent
        many = written(rest.groupBy("first").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts")).filter("parts > 1"), "parts")
        many = F.broadcast(many) if many.count() <= SENT_MOST else many
        dealt = rest.join(many, "first", "left").withColumn("part", F.coalesce(F.pmod("h", "parts"), F.lit(0).cast("long"))).drop("parts")
        close = written(_dealt(dealt, classes, "bits", _close, dealt.schema.simpleString()[7:-1]), "close", rest)
        wanted = written(close.select("class").distinct().join(classes, "class").select(F.col("rep").alias("doc_id")).distinct(), "wanted")
        brought = written(sets_of(wanted, rows).dropDuplicates(["class"]), "sets", wanted)
        more = written(_dealt(close, brought, "own", _meetings, "a long, b long").distinct(), "meetings", close, brought)
        if not more.isEmpty():
            labels = components(links.unionByName(more)).withColumnRenamed("id", "class")
    joined = written(classes.join(labels, "class", "left").select("class", "rep", F.coalesce("label", "class").alias("label")), "labelled", classes, seen)
    least = joined.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = joined.join(least, "label").select("class", "label", "component_id")
    return own.join(named, "class", "left").select("doc_id", "mark", "n", "label", "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, but for those that links join to another row that stays.

    Of the rows that links join, the one of the smallest id stays (where ids repeat, the first by text).  Repeated rows
    are copies.  Rows without a word or with a null id are linked with nothing and stay.
    """
    found = written(_labelled(doc_columns(docs, id_col=id_col, text_col=text_col)).filter("label is not null").groupBy("label", "doc_id", "mark").agg(F.count("*").alias("rows")), "found")
    chosen = found.groupBy("label").agg(F.min(F.struct("doc_id", "mark")).alias("chosen"))
    state = written(found.join(chosen, "label").select("doc_id", "mark", "rows", (F.struct("doc_id", "mark") == F.col("chosen")).alias("stays")).filter("not stays or rows > 1"), "dropped", found)
    gone, repeated = state.filter("not stays").select("doc_id", "mark"), state.filter("stays").select("doc_id", "mark")
    names = docs.columns
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"))
    if gone.count() <= SENT_MOST:
        gone = F.broadcast(gone)
    rows = rows.join(gone, ["doc_id", "mark"], "left_anti")
    if not repeated.isEmpty():  # of equal rows one stays; only these move
        if repeated.count() <= SENT_MOST:
            repeated = F.broadcast(repeated)
        equal = rows.join(repeated, ["doc_id", "mark"], "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("mark"))).filter("k = 1")
        rows = rows.join(repeated, ["doc_id", "mark"], "left_anti").unionByName(equal.drop("k"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in names])
