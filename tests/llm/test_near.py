import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomspan.llm import decontaminate, fingerprints, jaccard_join
from loomspan.llm.components import components


def brute(rows):
    """(n_shingles, component) by row, all pairs compared."""
    sets, parent = [], list(range(len(rows)))
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return [(len(sets[i]), least[find(i)]) for i in range(len(rows))]


def corpus(seed, n=150):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("lmnop") * r.randint(1, 3)
    base = [[word() for _ in range(r.randint(6, 90))] for _ in range(12)]
    common = [word() for _ in range(30)]
    out = []
    for i in range(n):
        w = list(r.choice(base)) if r.random() < 0.8 else [word() for _ in range(r.randint(0, 60))]
        for _ in range(r.choice((0, 1, 1, 2, 4, 8))):
            if w:
                w[r.randrange(len(w))] = word()
        if r.random() < 0.3:
            w += common
        out.append((i * 3 + 1, " ".join(w).title() if r.random() < 0.2 else "  ".join(w)))
    return out + [(1000, None), (1001, ""), (1002, " \t"), (1003, "a"), (1004, "A"), (1005, "a b c d")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LONG_BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "LONG_ALL", 4)
    monkeypatch.setattr(jaccard_join, "WANTED_MOST", 0 if seed == 2 else 2_000_000)
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {doc: v for (doc, _), v in zip(rows, brute(rows), strict=True)}


@pytest.mark.parametrize("seed", [3, 4])
def test_pairs_of_unequal_size(spark, seed, monkeypatch):
    """Texts and the same with words appended, put in or cut off, at 0.75 to 0.85; nothing else links them."""
    if seed == 4:
        monkeypatch.setattr(jaccard_join, "LONG_BLOCK", 2)
        monkeypatch.setattr(jaccard_join, "LONG_ALL", 4)
    r = random.Random(seed)
    rows = []
    for i in range(300):
        w = ["w%d" % r.randrange(10**6) for _ in range(r.randint(30, 120))] + ["and so on as usual of course".split(), []][i % 2]
        n = len(w) - 4
        more = ["w%d" % r.randrange(10**6) for _ in range(int(n / r.uniform(0.75, 0.85)) - n)]
        other = [w + more, more + w, w[: len(w) // 2] + more[4:] + w[len(w) // 2 :], w[: len(w) - len(more) * 3 // 4]][i % 4]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    expected = brute(rows)
    assert sum(c != doc for (doc, _), (_, c) in zip(rows, expected, strict=True)) > 200
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {doc: v for (doc, _), v in zip(rows, expected, strict=True)}


def test_jaccard_rows(odd, none):
    rows = jaccard_join.jaccard_components(odd).collect()
    assert len(rows) == odd.count() and jaccard_join.jaccard_components(none).count() == 0
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.n_shingles > 0, r.component_id))
    assert by[1] == {(True, 1)} and by[9] == {(True, 1)} and by[2] == {(False, 2)} and by[3] == {(False, 3)}
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 6, 7, None, 8])
    assert jaccard_join.one_of_each(none).count() == 0


def test_bitmaps_never_exclude_a_link():
    r = np.random.default_rng(3)
    for _ in range(400):
        n, m = r.integers(1, 200, 2)
        pool = np.unique(jaccard_join.mix(r.integers(0, 2**62, 400).astype(np.uint64)))
        a, b = np.sort(r.choice(pool[: n + 20], min(n, len(pool)), replace=False)), np.sort(r.choice(pool[: m + 20], min(m, len(pool)), replace=False))
        shared = len(np.intersect1d(a, b))
        assert shared == jaccard_join.overlap(a, b)
        if 100 * shared >= 75 * (len(a) + len(b) - shared):
            assert jaccard_join.may_link(jaccard_join.bitmap(a), len(a), jaccard_join.bitmap(b), len(b))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)], "a long, b long")
    got = {r.id: r.label for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert components(links.filter("false")).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def test_leaks_within_the_edit_budget(spark):
    r = random.Random(5)
    text = lambda n: " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(n))
    items = [(i, text(30)) for i in range(8)] + [(90, "short"), (91, None), (92, "")]
    docs, expected = [], {}
    for i in range(60):
        body, planted = text(60), i % 8
        item = list(items[planted][1])
        budget = int(decontaminate.RATE * len(item))
        k = r.choice((0, 1, budget // 2, budget, 3 * budget))
        for p in r.sample(range(len(item)), k):
            item[p] = r.choice("xyz")
        item = "".join(item)
        docs.append((i, body[:100] + " " + (item.upper() if i % 5 == 0 else item.replace(" ", " \n ")) + " " + body[100:]))
        if k <= budget:
            expected[i] = (planted, edits(items[planted][1], item.lower()))
    docs += [(100, None), (101, ""), (102, text(200))]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {x.doc_id: (x.item_id, x.edits) for x in found} == expected
    for x in found:
        assert decontaminate.normal(docs[x.doc_id][1][x.start : x.end])[0][:3].tolist() == decontaminate.normal(docs[x.doc_id][1][x.start : x.end].strip())[0][:3].tolist()
        cut = re.sub(r"\s+", " ", docs[x.doc_id][1][x.start : x.end].lower())
        assert edits(cut, items[x.item_id][1]) == x.edits


def test_leak_rows(spark, odd, none, monkeypatch):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, "alpha beta gamma delta epsilon alpha beta")], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.edits, r.start) for r in decontaminate.find_leaks(odd, items).collect()}
    assert found == {(1, 1, 0, 0), (9, 1, 0, 0), (5, 2, 0, 0)}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 30)  # more blocks than one
    assert {(r.doc_id, r.item_id, r.edits, r.start) for r in decontaminate.find_leaks(odd, items).collect()} == found
    left = decontaminate.without_leaks(odd, items)
    assert left.columns == odd.columns and Counter(r.doc_id for r in left.collect()) == Counter([2, 3, 4, 6, 7, None, 8])
    assert decontaminate.find_leaks(none, items).count() == 0 and decontaminate.find_leaks(odd, items.filter("false")).count() == 0


def paragraphs(text):
    lines = (p for line in text.split("\n") for p in (re.split(r"(?<=[.!?]) ", line) if len(line) > fingerprints.LONG_LINE else [line]))
    return {p.strip(" ") for p in lines if p.strip(" ")}


def test_fingerprints_against_sets(spark):
    r = random.Random(9)
    lines = ["line %d of many." % i for i in range(3000)]
    rows = [(i, "\n".join(r.sample(lines, r.choice((0, 1, 3, 20, 200, 1500))))) for i in range(30)] + [(50, None), (51, "é😀" * 300)]
    got = {x.doc_id: x for x in fingerprints.version_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for at, (i, text) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        near = [len(a & b) / len(a | b) if a | b else 1.0 for a, b in ((paragraphs(text), paragraphs(x)) for x in (edited, after))]
        assert got[i].edited_sha256 == digest(edited)
        assert (got[i].n_chars, round(got[i].near_edited, 9), round(got[i].near_next, 9)) == (len(text), round(near[0], 9), round(near[1], 9))


def test_next_texts_of_equal_and_null_ids(spark):
    """Descending ids, of equal ones by text, null last; after the last comes the first; ids far apart and few ranges."""
    rows = [(5, "b1"), (5, "a2"), (None, "n3"), (-7, "c4"), (2**62, "d5"), (5, "a2"), (None, None)]
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (-(x[0] if x[0] is not None else -(2**63)), x[1]))
    expected = Counter((i, t, order[(n + 1) % len(order)][1]) for n, (i, t) in enumerate(order))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.with_next(docs.selectExpr("doc_id", "coalesce(text, '') as text"))
    assert Counter((r.doc_id, r.text, r.next_text) for r in got.collect()) == expected
    sha = Counter((i, hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()) for (i, t, after), n in expected.items() for _ in range(n))
    assert Counter((r.doc_id, r.edited_sha256) for r in fingerprints.version_likeness(docs).collect()) == sha


def test_ranges_by_binary_search(spark):
    for bounds in ([], [3], [-5, 0, 7, 9], list(range(0, 3000, 3))):
        got = spark.range(-10, 40).selectExpr("id", f"{fingerprints.range_of('id', bounds)} as part").collect()
        assert all(r.part == sum(b < r.id for b in bounds) for r in got)


def test_whole_groups_from_sorted_batches():
    r = random.Random(2)
    keys = sorted((r.randrange(30), r.randrange(2)) for _ in range(400))
    rows = [(a, b, n) for n, (a, b) in enumerate(keys)]
    batches, at = [], 0
    while at < len(rows):
        size = r.choice((0, 1, 2, 30))
        batches.append(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[at : at + size])] or [pa.array([], pa.int64())] * 3, ["a", "b", "n"]))
        at += size
    for most in (1, 50, 10_000):
        tables = [t.to_pylist() for t in jaccard_join.whole(batches, "a", "b", most=most)]
        assert [x["n"] for t in tables for x in t] == list(range(400))
        seen = [{(x["a"], x["b"]) for x in t} for t in tables]
        assert sum(map(len, seen)) == len(set(keys)) and all(len(t) >= most for t in tables[:-1])
    assert list(jaccard_join.whole([], "a")) == []


def test_one_row_of_each_component(spark):
    """Ids that repeat with other texts: rows are told apart by id and text, and a row that links to nothing stays."""
    a, b = " ".join("w%d" % i for i in range(60)), " ".join("v%d" % i for i in range(60))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b), (3, "alone here is this one text"), (4, a), (4, a), (5, "x y"), (5, "x y")]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (1, b), (3, "alone here is this one text"), (5, "x y")])


@pytest.mark.parametrize("length", [*range(9, 61, 3), 17, 23, 26, 34, 35])
def test_one_budget_for_all_lengths(length):
    """Items of any length are found with floor(rate x length) edits at their worst places, and not with two more."""
    r = random.Random(length)
    letters = "abcdefghijklmnop"
    for _ in range(20):
        item = "".join(r.choice(letters) for _ in range(length))
        budget = int(decontaminate.RATE * length)
        indexes = decontaminate.ItemIndex.all_of([(1, item)], decontaminate.RATE)
        for k in (0, budget, budget + 2):
            edited = list(item)
            for n in range(k):  # spread evenly, which leaves the fewest q-grams
                edited[min(length - 1, (n + 1) * length // (k + 1))] = "z"
            edited = "".join(edited)
            text = "qrst " * 5 + edited + " uvwx" * 5
            found = decontaminate._places(indexes, [text])
            near = min(edits(item, text[s:z]) for s in range(20, 30) for z in range(25 + length - 6, 25 + length + 6))
            assert bool(found) == (near <= budget), (item, edited)
            if found:
                assert found[0, 1][0] == near


def test_fingerprint_rows(odd, none):
    rows = fingerprints.version_likeness(odd).collect()
    assert len(rows) == odd.count() and fingerprints.version_likeness(none).count() == 0
    prints = fingerprints.fingerprints(odd.select("doc_id", "text")).collect()
    assert len({r.fingerprint for r in prints if r.doc_id in (1, 9)}) == 1 and len({r.fingerprint for r in prints if r.doc_id in (2, 3)}) == 1
