import itertools
import json
import os
import random
import time
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.functions import alignment, people
from loomspan.operators import analysis, layout, relational, resolution, retrieval
from loomspan.plans import catalogue
from loomspan.sources import files, providers, tables
from loomspan.streaming import tasks

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_upsert_delete_cascade(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changes = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, v string, n int")
    assert rows(relational.upsert(now, changes, "id", order="n")) == [(1, "a"), (2, "y"), (3, "z")]
    assert rows(relational.delete(now, spark.createDataFrame([(2,), (9,)], "id int"), "id")) == [(1, "a")]
    child = spark.createDataFrame([(10, 1), (11, 2)], "id int, parent int")
    grand = spark.createDataFrame([(20, 10), (21, 11)], "id int, child int")
    left = relational.cascade([("child", child, "parent"), ("grand", grand, "child")], spark.createDataFrame([(1,)], "id int"))
    assert rows(left["child"]) == [(11, 2)] and rows(left["grand"]) == [(21, 11)]


def test_pages_and_locks(spark):
    df = spark.range(10)
    assert [r.id for r in relational.page(df, [F.desc("id")], 2, 3).collect()] == [7, 6, 5]
    with pytest.raises(ValueError):
        relational.page(df, ["id"], -1, 5)
    with pytest.raises(ValueError):
        relational.page(df, ["id"], 0, 101)
    now = datetime(2024, 1, 1, 12)
    state = spark.createDataFrame([(1, "processing", datetime(2024, 1, 1, 11, 45)), (2, "processing", datetime(2024, 1, 1, 11)), (3, "done", now)], "id int, status string, created_at timestamp")
    assert [(r.id, r.lock) for r in relational.locks(state, now).orderBy("id").collect()] == [(1, "blocked"), (2, "stale")]


def test_tables(spark):
    user = spark.createDataFrame([(1, "a", None, "h", None)], tables.schema("user"))
    image = spark.createDataFrame([(5, 1, "f", "p", None), (6, 9, "g", "p", None)], tables.schema("image"))
    assert rows(tables.orphans({"user": user, "image": image})) == [("image", "user_id", 6)]
    base = [None] * 18
    one = tuple(base)
    segs = json.dumps([{"segment_id": "s0000", "text": "立", "confidence": 0.5, "bbox": [1, 2, 3, 4]}])
    full = list(one)
    full[0], full[2], full[10], full[13], full[14], full[16] = 1, "raw", segs, '["a"]', "[1,2,3,4]", False
    broken = list(full)
    broken[0], broken[10] = 2, "not json"
    df = spark.createDataFrame([tuple(full), tuple(broken)], tables.schema("ocr_result"))
    assert [(r.id, r.text, r.bbox) for r in tables.segments_of(df).collect()] == [(1, "立", [1, 2, 3, 4])]
    shown = tables.payload(df).filter("id = 1").first()
    assert shown.original_text == "raw" and shown.crop_bbox == [1, 2, 3, 4] and shown.rejection_reasons == ["a"]
    fixed = tables.patched(df, spark.createDataFrame([(1, "new", "me")], "id int, text string, editor string")).orderBy("id").collect()
    assert (fixed[0].corrected_text, fixed[0].original_raw_text, fixed[0].human_corrected) == ("new", "raw", True) and fixed[1].human_corrected is False
    assert tables.empty(spark, "multi_task").count() == 0
    vec = spark.createDataFrame([("a", "t", [0.5], {"user": "1"})], tables.VECTORS)
    assert tables.count_vectors(vec, {"user": "1"}) == 1 and tables.count_vectors(vec, {"x": "1"}) == 0 and tables.count_vectors(tables.drop_vectors(vec, vec)) == 0


def test_files(spark, tmp_path):
    for name, data in (("3.141.jpg", b"x"), ("3.141b.jpg", b"y"), ("3.141背面.jpg", b"z"), ("3.142x.png", b"q"), ("n.txt", b"t")):
        (tmp_path / name).write_bytes(data)
    got = {os.path.basename(r.path): r.refused for r in files.gated(files.images(spark, str(tmp_path))).select("path", "refused").collect()}
    assert got["n.txt"] == "type" and got["3.141.jpg"] is None
    sizes = files.gated(spark.createDataFrame([("e.png", 0), ("b.png", files.MOST_BYTES + 1)], "path string, length long"))
    assert rows(sizes.select("path", "refused")) == [("b.png", "too large"), ("e.png", "empty")]
    keys = spark.createDataFrame([("3·141",), ("3·142",), ("9·9",)], "key string")
    assert [(r.key, os.path.basename(r.path)) for r in files.canonical(files.images(spark, str(tmp_path)), keys).orderBy("key").collect()] == [("3·141", "3.141.jpg"), ("3·142", "3.142x.png")]
    (tmp_path / "truth.json").write_text(json.dumps({"3·141": {"title": "t", "body": "立契"}}, ensure_ascii=False))
    truth = files.ground_truth(spark, str(tmp_path / "truth.json"))
    assert rows(truth) == [("3·141", "t", "立契")]
    done = spark.createDataFrame([(1, "a_3.141.jpg", "old"), (2, "b_3.141.jpg", "new"), (3, "none.jpg", "x")], "id int, filename string, raw_text string")
    assert [(r.id, r.truth) for r in files.matched_truth(done, truth).collect()] == [(2, "立契")]
    files.report(truth, truth.agg(F.count("*").alias("n")), str(tmp_path / "report"))
    assert "立契" in "".join(p.read_text() for p in (tmp_path / "report/rows").glob("*.json"))
    sources = files.images(spark, str(tmp_path), "3.141*.jpg").select("path", "modificationTime")
    assert files.outdated(sources, sources).count() == 0 and files.outdated(sources, sources.filter("false")).count() == 3
    lines = files.paired_payload(spark.createDataFrame([(1, ["a", "b"], [0.5], [[1, 2, 3, 4]]), (2, [], [], [])], "page int, texts array<string>, scores array<double>, boxes array<array<int>>"))
    assert rows(lines) == [(1, 0, "a", 0.5, [1, 2, 3, 4]), (1, 1, "b", 0.0, [])]


def test_providers(spark):
    df = spark.createDataFrame([(i, f"t{i % 3}") for i in range(60)], "id int, text string")
    got = providers.provided(df, "text", "v", "array<double>", providers.hashed_vector(8)).collect()
    assert len({tuple(r.v) for r in got}) == 3

    def failing(batch):
        raise OSError

    assert {r.v for r in providers.provided(df, "text", "v", "string", failing, tries=2, pause=0.0).collect()} == {None}


def test_graph_measures():
    path = {"a": {"b"}, "b": {"a", "c"}, "c": {"b", "d"}, "d": {"c"}}
    assert analysis.betweenness(path) == {"a": 0.0, "b": 2 / 3, "c": 2 / 3, "d": 0.0}
    two = {**{x: set("abc") - {x} for x in "abc"}, **{x: set("xyz") - {x} for x in "xyz"}}
    two["a"].add("x")
    two["x"].add("a")
    parts = analysis.communities(two)
    assert len({parts[x] for x in "abc"}) == 1 and len({parts[x] for x in "xyz"}) == 1 and parts["a"] != parts["x"]


def test_resolution_takes_mentions_in_order():
    score = lambda a, b: {("a", "b"): 0.5, ("a", "c"): 0.5, ("b", "c"): 0.41}.get(tuple(sorted((a[0], b[0]))), 1.0 if a == b else 0.0)
    assert analysis.resolve_task([("b",), ("c",), ("a",)], score) == [0, 1, 0]
    assert analysis.resolve_task([("a",), ("b",), ("c",)], score) == [0, 0, 0]  # two mentions: the greater counts
    assert analysis.standard_name(["ab", "cd", "cd", "x"]) == "cd"


def plainly_resolved(mentions):
    """Entities by resolve_task, from mentions (task, id, r, name, year, place) in order."""
    out = []
    for task, some in itertools.groupby(mentions, lambda m: m[0]):
        some = [(n, r, y or None, p, i) for _, i, r, n, y, p in some]
        at = analysis.resolve_task(some, lambda x, y: people.score_people(x[0], y[0], x[2], y[2], x[3], y[3]))
        for k in range(max(at) + 1):
            g = [m for m, e in zip(some, at, strict=True) if e == k]
            out.append((task, k, analysis.standard_name([m[0] for m in g]), len(g), len({m[4] for m in g}), len({m[1] for m in g}) > 1))
    return out


def arrow_mentions(mentions):
    kinds = {"user_id": pa.int64(), "id": pa.int64(), "r": pa.int32(), "name": pa.string(), "year": pa.int32(), "place": pa.string()}
    return pa.table([pa.array(c, k) for c, k in zip(zip(*mentions, strict=True), kinds.values(), strict=True)], list(kinds))


@pytest.mark.parametrize("letters", ["张張王李欧阳三四五劉刘", "ab", "Suplier#0123456789", "".join(map(chr, range(0x4E00, 0x4F00)))])
def test_tasks_side_by_side_resolve_as_alone(letters):
    r = random.Random(4)
    name = lambda: "".join(r.choice(letters) for _ in range(r.choice((1, 2, 3, 4, 6, 15, 70))))
    places = ("", "東村处", "西村", "东村地方", "西邨", "东村里巷", "地", "x" * 70, "x" * 69)
    mentions = []
    for task in (None, *range(12)):
        names = [name() for _ in range(12)]
        mentions += [(task, *m) for m in sorted((r.randint(1, 20), r.randint(0, 2), r.choice(names), r.choice((0, 3, 1800, 1802, 1850, 2**31 - 1)), r.choice(places)) for _ in range(r.randint(1, 40)))]
    want = plainly_resolved(mentions)
    for cells in (resolution.CELLS, 400, 1):  # all side by side; long ones alone; all alone
        assert [tuple(x.values()) for x in resolution.resolved(arrow_mentions(mentions), "user_id", analysis.MERGE_AT, cells).to_pylist()] == want


def test_resolution_of_groups_cut_by_batches(spark):
    r = random.Random(6)
    said = [(r.choice((None, 5, 2**53 + 1, 2**53 + 2)), i, role, f"Supplier#{r.randrange(60):03d}", r.choice((None, 1800, 1850)), r.choice((None, "东村"))) for i in range(80) for role in analysis.ROLES]
    df = spark.createDataFrame(said, "user_id long, id long, role string, name string, year int, place string")
    order = sorted(((t, i, analysis.ROLES.index(role), n, y or 0, p or "") for t, i, role, n, y, p in said), key=lambda m: (m[0] is not None, m[0] or 0, *m[1:]))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(repr, map(tuple, analysis.resolve(df, "user_id").collect()))) == sorted(map(repr, plainly_resolved(order)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_resolution_of_a_long_task_ends(spark):
    said = [(1, i, "seller", f"Supplier#{i * 7919 % 10_007:09d}", 1700 + i % 200, f"东村{i % 50}") for i in range(2000)]
    df = spark.createDataFrame(said, "user_id long, id long, role string, name string, year int, place string")
    began = time.time()
    assert sum(e.n_mentions for e in analysis.resolve(df, "user_id").collect()) == 2000
    assert time.time() - began < 30  # two million pairs of different names


def test_layout_parts():
    boxes = np.array([[0, 0, 10, 10], [1, 0, 11, 10], [100, 0, 110, 10], [0, 50, 10, 60]], float)
    assert layout.suppress(boxes, np.array([0.5, 0.9, 0.5, 0.5]), iou=0.8) == [1, 2, 3]
    assert layout.cluster(boxes, np.array([0.5, 0.9, 0.5, 0.5])).tolist() == [0, 0, 1, 2]
    tall = np.array([[500, 0, 520, 80], [500, 100, 520, 180], [100, 0, 120, 80]], float)
    assert layout.reading_order(tall, (1000, 1000))[0].tolist() == [0, 1, 2] and layout.reading_order(tall, (1000, 1000))[1] == "vertical"
    wide = np.array([[0, 100, 80, 120], [100, 0, 180, 20], [0, 0, 80, 20]], float)
    assert layout.reading_order(wide, (1000, 1000))[0].tolist() == [2, 1, 0]


def test_votes(spark):
    slots = spark.createDataFrame([(1, 0, "medium", "立", 0.4), (1, 0, "small", "立", 0.9), (1, 0, "tiny", "文", 0.9), (1, 1, "medium", "契", 0.9), (1, 1, "small", "約", 0.2)], "page int, pos int, source string, char string, score double")
    assert rows(layout.voted_chars(slots, ["page", "pos"])) == [(1, 0, "立", 0.4), (1, 1, "□", 0.0)]
    medium = spark.createDataFrame([(1, 0, "立契", 0.9), (1, 1, "張三", 0.9), (1, 2, "很長的一行字", 0.9)], "page int, pos int, text string, score double")
    small = spark.createDataFrame([(1, 0, "立約", 0.8)], "page int, pos int, text string, score double")
    pairs = layout.rescue_candidates(layout.paired(medium, small, "page")).orderBy("pos").collect()
    assert [(r.small_text, r.rescue) for r in pairs] == [("立約", True), ("", True), ("", False)]


def test_context(spark):
    items = spark.createDataFrame([(1, k, "x" * 500, "东村" if k == 1 else "未识别") for k in range(1, 8)], "user int, place int, text string, location string")
    text = retrieval.packed(items, "user", [("location", "地点")]).first().context.split("\n\n")
    assert text[0].startswith("[参考1](地点:东村)\n") and len(text[0].split("\n")[1]) == 251 and text[6].startswith("[参考7]\n")


def test_streams(spark, tmp_path):
    spark.createDataFrame([(i, datetime(2024, 1, 1, 0, i), i % 3, "a", 1.0, "{}") for i in range(50)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "in"))
    stream = tasks.landing(spark, str(tmp_path / "in"), "*.parquet")
    seen = []
    tasks.run_stages(stream, lambda df, n: seen.append(df.count()), "test")
    assert sum(seen) == 50
    final = tasks.drained(tasks.windowed(stream), "test")
    assert 0 < final.agg(F.sum("n")).first()[0] <= 50
    assert tasks.drained(tasks.in_flight_once(stream, ["user_id"]), "test").count() == 3
    held = tasks.drained(tasks.expiring(stream, "user_id", minutes=5), "test").filter("held")
    assert {r.user_id for r in held.collect()} == {0, 1, 2}
    before = spark.createDataFrame([(1, "pending", 0), (2, "pending", 2), (3, "done", 0), (4, "pending", 0)], "id int, status string, tries int")
    outcomes = spark.createDataFrame([(1, True), (1, False), (2, False), (3, False)], "id int, ok boolean")
    assert rows(tasks.advanced(before, outcomes)) == [(1, "done", 1), (2, "failed", 3), (3, "done", 0), (4, "pending", 0)]


def test_created_task_is_whole_or_not(spark):
    now = datetime(2024, 1, 1)
    structured = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "id long, user_id long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "structured_id long")
    task, links = relational.created_task(50, 7, ids(1, 2), structured, now)
    assert [tuple(r) for r in task.collect()] == [(50, 7, now)] and sorted(r.structured_id for r in links.collect()) == [1, 2]
    with pytest.raises(LookupError):
        relational.created_task(50, 7, ids(1, 9), structured, now)
    with pytest.raises(PermissionError):
        relational.created_task(50, 7, ids(1, 3), structured, now)


def test_event_stream_in_order(spark):
    rows = spark.createDataFrame([(2, "契"), (1, "a"), (3, None)], "n int, text string")
    assert list(files.event_stream(files.event_lines(rows, ["text"]), ["n"])) == ['data: {"text":"a"}\n\n', 'data: {"text":"契"}\n\n', "data: {}\n\n", "data: [DONE]\n\n"]


def test_consensus_fallbacks(spark):
    rows = [
        ("vote", 1, "v1", "立契人", 0.9), ("vote", 2, "v2", "立契人", 0.8), ("vote", 3, "v3", "立书人", 0.99),
        ("mask", 1, "v1", "立賣契人張三", 0.9), ("mask", 2, "v2", "立買契人張三", 0.8),
        ("short", 1, "v1", "立契", 0.8), ("short", 2, "v2", "", 0.1),
        ("long", 1, "v1", "立契人張三今因移就", 0.9),
        ("unsure", 1, "v1", "立契", 0.5),
        ("apart", 1, "v1", "甲乙丙", 0.8), ("apart", 2, "v2", "丁戊己", 0.7),
        ("blank", 1, "v1", "□", 0.2),
    ]
    df = spark.createDataFrame([(k, s, v, t, c, c) for k, s, v, t, c in rows], "slot string, seg long, view string, text string, confidence double, score double")
    got = {r.slot: (r.text, r.status, r.confidence) for r in layout.consensus(df, ["slot"]).collect()}
    assert got == {
        "vote": ("立契人", "accepted", 0.8),
        "mask": ("立□契人張三", "partial", round(0.8 * 10 / 12, 4)),
        "short": ("立契", "accepted", 0.8),
        "long": ("□", "uncertain", 0.0),
        "unsure": ("□", "uncertain", 0.0),
        "apart": ("甲乙丙", "accepted", 0.8),
        "blank": ("□", "uncertain", 0.0),
    }


def test_measures_of_graphs_against_plain_definitions():
    """Betweenness by listing all shortest paths; communities: no join of two gains modularity any more."""
    r = random.Random(3)
    for _ in range(8):
        names = [f"n{i}" for i in range(9)]
        adjacent = {n: set() for n in names}
        for a, b in itertools.combinations(names, 2):
            if r.random() < 0.3:
                adjacent[a].add(b)
                adjacent[b].add(a)

        def paths(a, b):
            frontier = [[a]]
            while frontier:
                ends = [p for p in frontier if p[-1] == b]
                if ends:
                    return ends
                seen = {x for p in frontier for x in p}
                frontier = [[*p, n] for p in frontier for n in adjacent[p[-1]] if n not in p and n not in seen - {n}]
            return []

        expected = dict.fromkeys(names, 0.0)
        for a, b in itertools.permutations(names, 2):
            found = paths(a, b)
            for n in names:
                if found and n not in (a, b):
                    expected[n] += sum(n in p for p in found) / len(found) / (8 * 7)
        got = analysis.betweenness(adjacent)
        assert all(abs(got[n] - expected[n]) < 1e-9 for n in names)
        part = analysis.communities(adjacent)
        links = sum(map(len, adjacent.values())) / 2
        for a, b in itertools.combinations(set(part.values()), 2):
            between = sum(part[x] == a and part[y] == b for x in names for y in adjacent[x])
            degree = [sum(len(adjacent[x]) for x in names if part[x] == k) for k in (a, b)]
            assert not links or between / links - degree[0] * degree[1] / (2 * links * links) <= 1e-9


def test_layout_queries_against_plain_loops(spark):
    """Every page of the test tables: duplicates dropped from the surest on, clusters, reading order."""
    rows = catalogue.segments(spark, SF).collect()
    pages = {}
    for x in rows:
        pages.setdefault(x.page, []).append(x)

    def over(a, b):
        w, h = min(a.x2, b.x2) - max(a.x1, b.x1), min(a.y2, b.y2) - max(a.y1, b.y1)
        inner = max(0, w) * max(0, h)
        one, two = (max(1, (s.x2 - s.x1) * (s.y2 - s.y1)) for s in (a, b))
        return inner / (one + two - inner), inner / min(one, two)

    clusters, kept = {}, {}
    for page, own in pages.items():
        own = sorted(sorted(own, key=lambda s: s.seg), key=lambda s: -s.score)
        groups, stay = [], []
        for s in own:
            home = next((g for g in groups if any(over(s, m)[0] >= 0.45 or over(s, m)[1] >= 0.72 for m in g)), None)
            groups.append([s]) if home is None else home.append(s)
            if all(over(s, m)[0] < 0.85 for m in stay):
                stay.append(s)
        clusters |= {(page, m.seg): k for k, g in enumerate(groups) for m in g}
        shapes = sorted((s.y2 - s.y1) / (s.x2 - s.x1) for s in stay)
        middle = lambda v: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
        upright = middle(shapes) >= 1.15
        lo, hi, cross = ("x1", "x2", "y1") if upright else ("y1", "y2", "x1")
        near = max(18.0, 25.0, 1.5 * middle(sorted(getattr(s, hi) - getattr(s, lo) for s in stay)))
        lines = []
        for s in sorted(stay, key=lambda s: (getattr(s, lo) + getattr(s, hi)) / 2 * (-1 if upright else 1)):
            c = (getattr(s, lo) + getattr(s, hi)) / 2
            line = next((x for x in lines if abs(c - sum(x[0]) / len(x[0])) <= near), None)
            if line is None:
                lines.append(([c], [s]))
            else:
                line[0].append(c)
                line[1].append(s)
        lines.sort(key=lambda x: sum(x[0]) / len(x[0]) * (-1 if upright else 1))
        order = [s for _, line in lines for s in sorted(line, key=lambda s: (getattr(s, cross), stay.index(s)))]
        kept |= {(page, s.seg): (p, "vertical" if upright else "horizontal") for p, s in enumerate(order)}
    assert {(r.page, r.seg): r.cluster for r in catalogue.jn21_clusters(spark, SF).collect()} == clusters
    assert {(r.page, r.seg): (r.order_index, r.layout_orientation) for r in catalogue.st06_reading_order(spark, SF).collect()} == kept


def test_text_measures_against_plain_tables(spark):
    """ev01, ag18, ag27, ag26 from edit tables filled cell by cell."""
    rows = [("立契人張三", "立契張三三"), ("abc", ""), ("", "x"), ("同同", "同同"), ("一二三", "壹二四")]
    df = spark.createDataFrame(rows, "guess string, truth string")
    measured = alignment.char_measures(df, "guess", "truth")
    for r in measured.collect():
        a, b = r.truth, r.guess
        cost = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        shared = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                cost[i][j] = min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                shared[i][j] = shared[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(shared[i - 1][j], shared[i][j - 1])
        own = r.asDict()
        assert own["edit_distance"] == cost[-1][-1] and own["lcs_len"] == shared[-1][-1], own
    pairs = {(r.truth, r.guess): r.n for r in alignment.confusions(df, "guess", "truth").collect()}
    assert pairs.get(("四", "三")) == 1 and pairs.get(("壹", "一")) == 1
