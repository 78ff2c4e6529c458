"""Entity resolution over arrays: the mentions of many tasks are assigned side by side, with the results of analysis.resolve_task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from loomspan.functions.people import UNKNOWN, Names, Places, Texts, apart, score_all
from loomspan.operators.grouped import starts

#: Scores of all pairs of so many texts are held as one table.
FEW = 128
#: A task of more pairs goes alone, a mention at a time.
CELLS = 1 << 20


def local(ids: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers within each row for ids (rows x places, the first `size` count): (ids renumbered, ids by number, how many)."""
    valid = np.arange(ids.shape[1]) < size[:, None]
    row = np.nonzero(valid)[0]
    values, back = np.unique(row * n + ids[valid], return_inverse=True)
    of = values // n
    first = np.searchsorted(of, np.arange(len(ids)))
    many = np.bincount(of, minlength=len(ids))
    number = np.zeros(ids.shape, np.int64)
    number[valid] = back - first[row]
    known = np.zeros((len(ids), int(many.max())), np.int64)
    known[of, np.arange(len(values)) - first[of]] = values % n
    return number, known, many


class Scores:
    """Scores of the texts in each row of ids (the first `size` count) with those after them; each different pair of texts is scored once."""

    def __init__(self, texts: Texts, ids: np.ndarray, size: np.ndarray):
        n = len(texts.texts)
        if n <= FEW:
            self.table, self.row, self.number = whole_table(texts), ids * n, ids
            return
        self.number, known, many = local(ids, size, n)
        wide = known.shape[1]
        table = np.zeros((len(ids), wide, wide))
        table[:, np.arange(wide), np.arange(wide)] = texts.same[known]
        a, b = np.triu_indices(wide, 1)
        row, k = np.nonzero(b < many[:, None])
        a, b = a[k], b[k]
        pairs, back = np.unique(known[row, a] * n + known[row, b], return_inverse=True)
        table[row, a, b] = table[row, b, a] = texts.scores(pairs // n, pairs % n)[back]
        self.table, self.row = table.reshape(-1), (np.arange(len(ids))[:, None] * wide + self.number) * wide

    def after(self, k: int, rows: int) -> np.ndarray:
        """Scores of place k with the later places, in the first rows."""
        return self.table.take(self.row[:rows, k, None] + self.number[:rows, k + 1 :])


def assign(names: Scores, years: np.ndarray, places: Scores, size: np.ndarray, least: float) -> np.ndarray:
    """Entity numbers of the mentions of tasks, the longest first: a row is a task.

    The n-th mentions of all tasks are assigned at once.  For each entity and each mention to come the two greatest
    scores are kept; they rise as the entity takes a mention.
    """
    tasks, n = years.shape
    out = np.zeros((tasks, n), np.int64)
    top, second = np.zeros((tasks, 8, n)), np.zeros((tasks, 8, n))
    members, entities = np.zeros((tasks, 8), np.int64), np.zeros(tasks, np.int64)
    for k in range(n):
        m = int(np.searchsorted(-size, -k))
        live = np.arange(m)
        link = np.where(members[:m] <= 2, top[:m, :, k], (top[:m, :, k] + second[:m, :, k]) / 2)
        best = link.argmax(1)
        new = link[live, best] < least
        at = np.where(new, entities[:m], best)
        entities[:m] += new
        if int(at.max()) >= members.shape[1]:
            top, second, members = (np.concatenate([x, np.zeros_like(x)], 1) for x in (top, second, members))
        members[live, at] += 1
        out[:m, k] = at
        s = score_all(names.after(k, m), years[:m, k, None], years[:m, k + 1 :], places.after(k, m))
        now = top[live, at, k + 1 :]
        second[live, at, k + 1 :] = np.maximum(second[live, at, k + 1 :], np.minimum(now, s))
        top[live, at, k + 1 :] = np.maximum(now, s)
    return out


def whole_table(texts: Texts) -> np.ndarray:
    """Scores of all pairs of a few texts, as one row."""
    if texts.table is None:
        n = len(texts.texts)
        texts.table = np.diag(texts.same)
        a, b = np.triu_indices(n, 1)
        texts.table[a, b] = texts.table[b, a] = texts.scores(a, b)
    return texts.table.reshape(-1)


class Rows:
    """Scores of one text with all texts, kept while they fit."""

    def __init__(self, texts: Texts, ids: np.ndarray, cells: int):
        self.texts, self.cells, self.kept = texts, cells, {}
        self.known, self.number = np.unique(ids, return_inverse=True)

    def of(self, n: int) -> np.ndarray:
        if n not in self.kept:
            if (len(self.kept) + 1) * len(self.known) > self.cells:
                self.kept.clear()
            row = self.texts.scores(np.full(len(self.known), self.known[n]), self.known)
            row[n] = self.texts.same[self.known[n]]
            self.kept[n] = row
        return self.kept[n]


def assign_alone(names: Names, places: Places, name: np.ndarray, year: np.ndarray, place: np.ndarray, least: float, cells: int = CELLS * 4) -> np.ndarray:
    """Entity numbers of one long task: memory grows with its mentions, not with their pairs.  Equal members of an entity are one slot."""
    by_name, by_place = Rows(names, name, cells), Rows(places, place, cells)
    name, place = by_name.number, by_place.number
    out = np.zeros(len(name), np.int64)
    slots, members = np.zeros((5, 1024), np.int64), np.zeros(64, np.int64)
    seen: dict[tuple, int] = {}
    entities = 0
    for k in range(len(name)):
        of, n, y, p, copies = slots[:, : len(seen)]
        s = score_all(by_name.of(name[k])[n], y, year[k] or UNKNOWN, by_place.of(place[k])[p])
        top, second = np.zeros(entities + 1), np.zeros(entities + 1)
        np.maximum.at(top, of, s)
        at = entities
        if top.max() >= least:
            equal = s == top[of]
            np.maximum.at(second, of[~equal], s[~equal])
            second = np.where(np.bincount(of[equal], copies[equal], entities + 1) > 1, top, second)
            link = np.where(members[: entities + 1] <= 2, top, (top + second) / 2)
            at = int(link.argmax()) if link.max() >= least else entities
        entities = max(entities, at + 1)
        if entities >= len(members):
            members = np.concatenate([members, np.zeros_like(members)])
        members[at] += 1
        slot = seen.setdefault((at, name[k], year[k], place[k]), len(seen))
        if slot >= slots.shape[1]:
            slots = np.concatenate([slots, np.zeros_like(slots)], 1)
        slots[:4, slot] = at, name[k], year[k] or -UNKNOWN, place[k]
        slots[4, slot] += 1
        out[k] = at
    return out


def coded(column: pa.ChunkedArray) -> tuple[np.ndarray, list[str]]:
    whole = column.combine_chunks().dictionary_encode()
    return np.asarray(whole.indices).astype(np.int64), whole.dictionary.to_pylist()


def resolved(rows: pa.Table, task: str, least: float, cells: int = CELLS) -> pa.Table:
    """The entities of whole tasks, from mentions (task, id, r, name, year, place) in order: see analysis.resolve."""
    (name, names), (place, places) = coded(rows["name"]), coded(rows["place"])
    year, doc, role = (np.asarray(rows[c]).astype(np.int64) for c in ("year", "id", "r"))
    of_names, of_places, years = Names(names), Places(places), apart(year)
    begin = starts(rows[task].combine_chunks())
    size = np.diff(np.r_[begin, len(name)])
    at = np.zeros(len(name), np.int64)
    order = np.argsort(-size, kind="stable")
    while len(order):
        n = int(size[order[0]])
        if n * n > cells:
            span = slice(begin[order[0]], begin[order[0]] + n)
            at[span] = assign_alone(of_names, of_places, name[span], year[span], place[span], least)
            order = order[1:]
            continue
        some, order = order[: cells // (n * n)], order[cells // (n * n) :]
        inside = np.arange(n) < size[some][:, None]
        where = np.minimum(begin[some][:, None] + np.arange(n), len(name) - 1)
        by_name, by_place = (Scores(t, np.where(inside, x[where], 0), size[some]) for t, x in ((of_names, name), (of_places, place)))
        at[where[inside]] = assign(by_name, years[where], by_place, size[some], least)[inside]

    group = np.repeat(np.arange(len(begin)), size)
    sort = np.lexsort((at, group))
    group, at, name, doc, role = group[sort], at[sort], name[sort], doc[sort], role[sort]
    changed = np.r_[True, (group[1:] != group[:-1]) | (at[1:] != at[:-1])]
    first = np.flatnonzero(changed)
    entity = np.cumsum(changed) - 1
    key, seen, times = np.unique(entity * len(names) + name, return_index=True, return_counts=True)
    of, which = key // len(names), key % len(names)
    best = np.lexsort((seen, -times, -np.array([len(x) for x in names])[which], of))  # the most frequent of the longest, then the first
    standard = which[best[np.searchsorted(of, np.arange(len(first)))]]
    columns = {
        task: rows[task].combine_chunks().take(pa.array(begin[group[first]])),
        "entity": pa.array(at[first].astype(np.int32)),
        "name": pa.array(names, pa.string()).take(pa.array(standard)),
        "n_mentions": pa.array(np.diff(np.r_[first, len(name)])),
        "n_docs": pa.array(np.add.reduceat((changed | np.r_[True, doc[1:] != doc[:-1]]).astype(np.int64), first)),
        "cross_role": pa.array(np.minimum.reduceat(role, first) != np.maximum.reduceat(role, first)),
    }
    return pa.table(columns)
