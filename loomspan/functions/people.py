"""The similarity of people for work inside of a group: the same figures as similarity.person_similarity, a pair or many pairs at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from loomspan.functions.text import COMPOUND_SURNAMES, PLACE_ENDINGS, VARIANTS

_STANDARD = str.maketrans({c: group[-1] for group in VARIANTS for c in group[:-1]})


def _edits(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    row = list(range(len(b) + 1))
    for x in a:
        corner, row[0] = row[0], row[0] + 1
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


def _family(name: str) -> str:
    return name[:2] if name[:2] in COMPOUND_SURNAMES else name[:1]


@lru_cache(maxsize=200_000)
def score_names(first: str, second: str) -> float:
    a, b = first.translate(_STANDARD), second.translate(_STANDARD)
    if a == b:
        return 1.0
    if a in b or b in a:
        chars = 0.8
    else:
        weight = 0.7 if max(len(a), len(b)) <= 3 else 0.4
        chars = weight * _edits(a, b) + (1 - weight) * (len({*a} & {*b}) / len({*a, *b}) if a and b else 0.0)
        chars = chars if chars >= 0.35 else 0.0
    same = bool(_family(a)) and _family(a) == _family(b)
    if chars < 0.1 and not same:
        return 0.0
    if same and chars >= 0.25:
        return min(1.0, chars + 0.08)
    return chars * 0.7 if not same and chars < 0.3 else chars


@lru_cache(maxsize=50_000)
def score_places(first: str, second: str) -> float:
    a, b = (_place(x) for x in (first, second))
    if not a or not b:
        return 0.0
    if a == b:
        return 0.25
    if a in b or b in a:
        return 0.18
    near = _edits(a, b)
    return near * 0.15 if near >= 0.6 else 0.0


def _place(text: str) -> str:
    out = text.strip().translate(_STANDARD)
    for ending in PLACE_ENDINGS:
        if out.endswith(ending) and len(out) > len(ending):
            out = out[: -len(ending)]
    return out


def score_people(name_a: str, name_b: str, year_a: int | None, year_b: int | None, place_a: str, place_b: str) -> float:
    names = score_names(name_a, name_b)
    if names < 0.1:
        return 0.0
    gap = abs(year_a - year_b) if year_a and year_b else 1000
    years = next((v for most, v in ((0, 0.20), (3, 0.18), (10, 0.14), (30, 0.08), (60, 0.04)) if gap <= most), 0.0)
    return names * 0.55 + years + score_places(place_a, place_b)


#: Texts beyond this many characters are compared a pair at a time.
MOST_CHARS = 64
#: Stands for unknown years, far from all years.
UNKNOWN = 1 << 40
#: Points for a gap of so many years; the last for 61 and more.
YEARS = np.repeat([0.20, 0.18, 0.14, 0.08, 0.04, 0.0], [1, 3, 7, 20, 30, 1])


class Texts:
    """Different texts as arrays, to compare many pairs of them at once."""

    def __init__(self, texts: list[str]):
        self.texts = np.array(texts, object)
        self.table: np.ndarray | None = None
        self.length = np.array([len(t) for t in texts], np.int64)
        self.long = self.length > MOST_CHARS
        kept = [t if len(t) <= MOST_CHARS else "" for t in texts]
        size = np.where(self.long, 0, self.length)
        wide = max(1, int(size.max(initial=0)))
        inside = np.arange(wide) < size[:, None]
        points = np.array(kept, f"U{wide}").view(np.uint32).reshape(len(kept), wide)
        known = np.zeros(int(points.max(initial=0)) + 1, bool)
        known[points[inside]] = True
        dense = np.cumsum(known)
        kind = np.uint16 if dense[-1] < 65_535 else np.uint32
        self.codes = np.where(inside, dense[points], 0).astype(kind)
        turned = np.where(inside, np.take_along_axis(self.codes, np.maximum(size[:, None] - 1 - np.arange(wide), 0), 1), 0)
        self.forward, self.backward = (np.ascontiguousarray(x.T.astype(kind)) for x in (self.codes, turned))
        row, code = np.nonzero(inside)[0], self.codes[inside].astype(np.int64)
        self.sets = np.zeros((len(kept), int(dense[-1]) // 64 + 1), np.uint64)
        np.bitwise_or.at(self.sets, (row, code // 64), np.uint64(1) << (code % 64).astype(np.uint64))
        self.different = np.bitwise_count(self.sets).sum(1, dtype=np.int64)

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many different characters both texts of each pair have."""
        return np.bitwise_count(self.sets[i] & self.sets[j]).sum(1, dtype=np.int64)

    def distances(self, i: np.ndarray, j: np.ndarray, block: int = 4096) -> np.ndarray:
        """The edit distance of each pair of texts of MOST_CHARS at most: what they begin and end with alike is left out."""
        i, j = np.where(self.length[i] <= self.length[j], (i, j), (j, i))
        least = self.length[i]
        head = np.minimum(_alike(self.forward, i, j), least)
        tail = np.minimum(_alike(self.backward, i, j), least - head)
        a, b = least - head - tail, self.length[j] - head - tail
        out = b.copy()
        left = np.flatnonzero(a)
        left = left[np.lexsort((a[left], b[left]))]
        for at in (left[k : k + block] for k in range(0, len(left), block)):
            x, y = (self._middle(of[at], head[at], int(n[at].max())) for of, n in ((i, a), (j, b)))
            out[at] = _table(x, y, a[at], b[at])
        return out

    def _middle(self, of: np.ndarray, head: np.ndarray, n: int) -> np.ndarray:
        return self.codes[of, np.minimum(head + np.arange(n)[:, None], self.codes.shape[1] - 1)]

    def holds(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether one text of each pair holds the other."""
        return np.array([a in b or b in a for a, b in zip(self.texts[i], self.texts[j], strict=True)], bool)


def _alike(codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many places are equal before the first that differs."""
    equal = codes.take(i, 1) == codes.take(j, 1)
    for last, row in zip(equal, equal[1:]):
        row &= last
    return equal.view(np.uint8).sum(0, dtype=np.uint8).astype(np.int64)


def _table(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of the columns of x and y, of which the first a and b places count; a row of all tables at a time."""
    row = np.repeat(np.arange(len(y) + 1, dtype=np.int8)[:, None], y.shape[1], 1)
    out = np.empty(len(a), np.int64)
    for n, c in enumerate(x, 1):
        new = np.empty_like(row)
        new[0] = n
        np.minimum(row[:-1] + (y != c), row[1:] + np.int8(1), out=new[1:])
        for last, now in zip(new, new[1:]):
            np.minimum(now, last + np.int8(1), out=now)
        row = new
        ends = np.flatnonzero(a == n)
        out[ends] = row[b[ends], ends]
    return out


class Names(Texts):
    """Different names; scores() gives what score_names gives for each pair."""

    def __init__(self, names: list[str]):
        self.names = names
        standard = [n.translate(_STANDARD) for n in names]
        super().__init__(standard)
        families: dict[str, int] = {"": 0}
        self.family = np.array([families.setdefault(_family(n), len(families)) for n in standard], np.int64)
        self.same = np.ones(len(names))

    def scores(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        long = self.long[i] | self.long[j]
        for k in np.flatnonzero(long):
            out[k] = score_names(self.names[i[k]], self.names[j[k]])
        n, m = self.length[i], self.length[j]
        most, least = np.maximum(n, m), np.minimum(n, m)
        kinds, shared = (self.different[i], self.different[j]), self.shared(i, j)
        jaccard = shared / np.maximum(kinds[0] + kinds[1] - shared, 1)
        weight = np.where(most <= 3, 0.7, 0.4)
        # at most so near by their lengths and characters, whatever their order; only a text of shared characters can be held
        likely = (weight * (least / np.maximum(most, 1)) + (1 - weight) * jaccard >= 0.35 - 1e-9) | (shared == np.minimum(*kinds))
        live = np.flatnonzero(~long & likely)
        i, j, most, least, jaccard, weight = (x[live] for x in (i, j, most, least, jaccard, weight))
        distance = self.distances(i, j)
        chars = weight * np.where(least == 0, 0.0, 1 - distance / np.maximum(most, 1)) + (1 - weight) * jaccard
        chars = np.where(chars >= 0.35, chars, 0.0)
        inside = np.flatnonzero(distance == most - least)  # only then can one hold the other
        chars[inside[self.holds(i[inside], j[inside])]] = 0.8
        family = (self.family[i] > 0) & (self.family[i] == self.family[j]) & (chars >= 0.25)
        out[live] = np.where(distance == 0, 1.0, np.where(family, np.minimum(1.0, chars + 0.08), chars))
        return out


class Places(Texts):
    """Different places; scores() gives what score_places gives for each pair."""

    def __init__(self, places: list[str]):
        self.places = places
        super().__init__([_place(p) for p in places])
        self.same = np.where(self.length > 0, 0.25, 0.0)

    def scores(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        long = self.long[i] | self.long[j]
        for k in np.flatnonzero(long):
            out[k] = score_places(self.places[i[k]], self.places[j[k]])
        n, m = self.length[i], self.length[j]
        most, least = np.maximum(n, m), np.minimum(n, m)
        live = np.flatnonzero(~long & (least > 0) & ((least >= most * 0.6 - 1e-9) | (self.shared(i, j) == np.minimum(self.different[i], self.different[j]))))
        i, j, most, least = i[live], j[live], most[live], least[live]
        distance = self.distances(i, j)
        near = 1 - distance / most
        points = np.where(near >= 0.6, near * 0.15, 0.0)
        inside = np.flatnonzero(distance == most - least)
        points[inside[self.holds(i[inside], j[inside])]] = 0.18
        out[live] = np.where(distance == 0, 0.25, points)
        return out


def apart(years: np.ndarray) -> np.ndarray:
    """Years for score_all: unknown ones (0) lie far from all others and from each other."""
    return np.where(years == 0, UNKNOWN + 1000 * np.arange(len(years)), years)


def score_all(names: np.ndarray, years_a: np.ndarray, years_b: np.ndarray, places: np.ndarray) -> np.ndarray:
    """score_people of many pairs from the scores of their names and places; unknown years lie apart."""
    gap = years_a - years_b
    np.abs(gap, out=gap)
    np.minimum(gap, len(YEARS) - 1, out=gap)
    out = names * 0.55
    out += YEARS[gap]
    out += places
    out[names < 0.1] = 0.0
    return out
