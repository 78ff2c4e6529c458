"""Benchmark decontamination by q-gram lemma filtering.

Two strings within k edits share at least L - q + 1 - k q of the q-grams of the item (length L), and all of these lie
within k diagonals of each other.  So shared q-grams are counted in bands of diagonals that overlap by half; bands that
reach the bound are regions of the text, and a banded alignment verifies each.

The bound must be 1 at least, so q is the greatest up to Q for which it is: short items have shorter q-grams, and one
budget rule, floor(rate x length), holds for all lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.shared import batch_of, doc_columns, keep_rows, map_arrow, written

#: Code points of a q-gram, but for short items; items of fewer code points never match.
Q = 9
#: Edits allowed for each character of an item.
RATE = 0.09
#: Characters of benchmark texts in one index; more are searched in further blocks.
BLOCK_CHARS = 4_000_000
_BITS = 22
_GAP = "\0" * Q


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case, runs of white space as one blank; and the place of each in the text."""
    low = text.lower()
    if len(low) != len(text):  # a few letters have longer lower-case forms
        low = "".join(c.lower()[0] for c in text)
    codes = np.frombuffer(low.encode("utf-32-le"), np.uint32)
    blank = (codes <= 32) & (codes > 0) | (codes == 0xA0) | (codes == 0x3000) | (codes == 0x85) | (codes >= 0x2000) & (codes <= 0x200A)
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    at = np.flatnonzero(keep)
    return np.where(blank, np.uint32(32), codes)[at], at


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit mix of each window of q code points: windows of 1, 2, 4 and 8 are joined as the bits of q say."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    windows, p = len(codes) - q + 1, np.uint64(0x9E3779B97F4A7C15)
    power, size, done = codes.astype(np.uint64), 1, 0
    mixed = np.zeros(windows, np.uint64)
    with np.errstate(over="ignore"):
        while size <= q:
            if q & size:
                mixed = mixed * p + power[done : done + windows]
                done += size
            power = power[: len(power) - size] * p + power[size:]
            size, p = 2 * size, p * p
        return mixed ^ (mixed >> np.uint64(29))


def slot(mixed: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _BITS)


@dataclass
class ItemIndex:
    """Inverted lists from q-grams to (item, place), with the bounds of each item; all items have q-grams of one length."""

    q: int
    ids: list[int]
    codes: list[np.ndarray]
    budget: np.ndarray
    least: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    maybe: np.ndarray

    @classmethod
    def all_of(cls, items: list[tuple[int, str]], rate: float) -> list[ItemIndex]:
        """An index for each length of q-grams that the items need: one if all are 36 code points or longer."""
        by_q: dict[int, list[tuple[int, np.ndarray, int]]] = {}
        for i, text in sorted(items):
            c = normal(text.strip())[0]
            if len(c) >= Q:
                k = int(rate * len(c))
                if q := min(Q, len(c) // (k + 1)):  # L - q + 1 - k q >= 1
                    by_q.setdefault(q, []).append((i, c, k))
        return [cls.of(q, *map(list, zip(*own, strict=True))) for q, own in sorted(by_q.items())]

    @classmethod
    def of(cls, q: int, ids: list[int], codes: list[np.ndarray], budgets: list[int]) -> ItemIndex:
        lengths, budget = np.array([len(c) for c in codes], np.int64), np.array(budgets, np.int64)
        mixed = [grams(c, q) for c in codes]
        flat = np.concatenate([np.zeros(0, np.uint64), *mixed])
        item = np.repeat(np.arange(len(codes)), [len(m) for m in mixed])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(m)) for m in mixed]])
        order = np.argsort(flat, kind="stable")
        keys, first = np.unique(flat[order], return_index=True)
        maybe = np.zeros(1 << _BITS, bool)
        maybe[slot(keys)] = True
        return cls(q, ids, codes, budget, lengths - q + 1 - q * budget, keys, np.append(first, len(flat)), item[order], place[order], maybe)

    def regions(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first diagonal, end diagonal) of bands that reach the bound of their item."""
        mixed = grams(codes, self.q)
        at = np.flatnonzero(self.maybe[slot(mixed)])
        if not len(at) or not len(self.keys):
            return []
        row = np.minimum(np.searchsorted(self.keys, mixed[at]), len(self.keys) - 1)
        hit = self.keys[row] == mixed[at]
        at, row = at[hit], row[hit]
        many = self.first[row + 1] - self.first[row]
        entry = np.repeat(self.first[row] - np.cumsum(many) + many, many) + np.arange(many.sum())
        item = self.item[entry]
        above = max(map(len, self.codes))  # no diagonal is below 0 then
        diagonal = np.repeat(at, many) - self.place[entry] + above
        step = self.budget[item] + 1
        band = diagonal // step
        keys, counts = np.unique(np.concatenate([item << 40 | band, item << 40 | (band - 1)]), return_counts=True)
        item, band = keys >> 40, keys & ((1 << 40) - 1)
        enough = counts >= self.least[item]
        out = []
        for i, b in zip(item[enough].tolist(), band[enough].tolist(), strict=True):
            step = int(self.budget[i]) + 1
            out.append((i, b * step - above, (b + 2) * step - above))
        return out


def align(item: np.ndarray, text: np.ndarray, shift: int, end: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of item in text on diagonals from shift up to end, if within the budget; the leftmost of equals.

    Rows are item places, columns diagonals of the band; both ends in the text are free.
    """
    lo, hi = shift - budget, end + budget
    width = hi - lo
    big = 1 << 20
    offsets = np.arange(width)
    column = np.arange(lo, hi)  # text places before the row's character
    row = np.where((column >= 0) & (column <= len(text)), 0, big)
    start = column.copy()
    for i, c in enumerate(item):
        place = column + i
        inside = (place >= 0) & (place < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[place[inside]] == c
        cost = np.where(inside, row + ~same, big)
        skip = np.append(row[1:], big) + 1  # the item's character has no partner
        take = skip < cost
        cost = np.where(take, skip, cost)
        begun = np.where(take, np.append(start[1:], 0), start)
        outside = (place + 1 < 0) | (place + 1 > len(text))
        cost = np.where(outside, big, cost)
        # characters of the text without partner: the least of all cells to the left, plus the way
        key = (cost - offsets) * (width + 1) + offsets
        least = np.minimum.accumulate(key)
        source = least % (width + 1)
        row = cost[source] + offsets - source
        row = np.where(outside, big, row)
        start = begun[source]
        if row.min() > budget:
            return None
    best = int(row.argmin())
    return (int(row[best]), int(start[best]), int(column[best] + len(item))) if row[best] <= budget else None


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Benchmark items within every whole text: doc_id, item_id, edits, start, end (code points of the text), similarity.

    One row for each document row and item that occurs in it with at most rate x length edits (case and runs of white
    space don't count): its best place, of equals the leftmost.  Items of fewer than Q characters can't be told from
    chance and never match; null items and null or empty texts match nothing.  Repeated rows of documents give repeated
    results; an empty table on either side gives none; other columns are ignored.

    Documents don't move: each task searches its rows against an index of the items.  An index holds BLOCK_CHARS
    characters at most; a larger benchmark is split by a hash of the item into more blocks.  Each is searched and its
    finds are saved before the next one is sent, so that one block is with the tasks at a time.
    """
    out, several = None, False
    for part, several in _blocks(benchmark, item_id_col, item_text_col):
        held = docs.sparkSession.sparkContext.broadcast(part)
        found = _search(docs, held, rate, id_col, text_col)
        if several:
            found = written(found, "leaks")
            held.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs in whose text find_leaks() finds no benchmark item, with all of their columns."""
    before = None
    for items, several in _blocks(benchmark, item_id_col, item_text_col):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def make(held=held):
            index = ItemIndex.all_of(held.value, rate)

            def test(ids: list, texts: list[str]) -> list[bool]:
                leaked = {doc for doc, _ in _places(index, texts)}
                return [i not in leaked for i in range(len(texts))]

            return test

        docs = keep_rows(docs, make, id_col=id_col, text_col=text_col)
        if several:
            docs = before = written(docs, "kept", *([before] if before is not None else []))
            held.destroy()
    return docs


def _blocks(benchmark: DataFrame, item_id_col: str, item_text_col: str) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The benchmark's distinct items in blocks of about BLOCK_CHARS characters, one at least; and whether there are several."""
    items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).dropna().distinct()
    size = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = -(-size // BLOCK_CHARS) or 1
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield [(r.item_id, r.text) for r in part.collect()], blocks > 1


def _places(indexes: list[ItemIndex], texts: list[str]) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """(edits, start, end, length of the item) of the best place for each (number of the text, item id) that matches."""
    codes, at = normal(_GAP.join(texts))
    raw = np.cumsum([0, *[len(t) + Q for t in texts]])
    bounds = np.searchsorted(at, raw)
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for index, item, lo, hi in ((x, *region) for x in indexes for region in x.regions(codes)):
        budget, own = int(index.budget[item]), index.codes[item]
        length = len(own)
        doc = int(np.searchsorted(bounds, max(0, (lo + hi + length) // 2), side="right")) - 1
        a, z = int(bounds[doc]), int(bounds[doc + 1]) if doc + 1 < len(bounds) else len(codes)
        text = codes[a:z]
        exact = [d for d in range(max(0, lo - a), min(hi - a, len(text) - length + 1)) if text[d] == own[0] and np.array_equal(text[d : d + length], own)]
        found = (0, exact[0], exact[0] + length) if exact else align(own, text, lo - a, hi - a, budget)
        if found and found[2] > found[1]:
            place = (found[0], int(at[a + found[1]] - raw[doc]), int(at[a + found[2] - 1] - raw[doc]) + 1, length)
            key = (doc, index.ids[item])
            best[key] = min(best.get(key, place), place)
    return best


def _search(docs: DataFrame, held: Broadcast, rate: float, id_col: str, text_col: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("similarity", pa.float64())])

    def make():
        index = ItemIndex.all_of(held.value, rate)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            best = _places(index, texts)
            if not best:
                return None
            rows = [(ids[d], i, e, s, z, 1 - e / n) for (d, i), (e, s, z, n) in sorted(best.items())]
            return batch_of(schema, *zip(*rows, strict=True))

        return step

    return map_arrow(doc_columns(docs, id_col=id_col, text_col=text_col), make, "doc_id long, item_id long, edits long, start long, end long, similarity double")
