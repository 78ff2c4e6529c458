import random

import numpy as np
from pyspark.sql import functions as F

from loomspan.functions import alignment, people, similarity, text


def column(spark, rows, schema, **columns):
    return [r.asDict() for r in spark.createDataFrame(rows, schema).select("*", *[c.alias(n) for n, c in columns.items()]).collect()]


def test_prices(spark):
    said = {"纹银八两五钱": 8.5, "银十二两": 12.0, "一百零五两": 105.0, "铜钱三千二百文": None, "价银12.5两": 12.5, "未记载": None, None: None, "萬两": 10000.0, "二十三钱": 2.3}
    got = column(spark, [(k,) for k in said], "p string", v=F.round(text.price(F.col("p")), 6))
    assert {r["p"]: r["v"] for r in got} == said


def test_names_and_places(spark):
    got = column(spark, [("張三、李四和王五", "東村地方"), ("欧阳修，未识别", "地"), ("", "大處地"), (None, None)], "n string, p string", who=text.split_people(F.col("n")), at=text.normal_place(F.col("p")), family=text.surname(F.col("n")))
    assert [r["who"] for r in got] == [["張三", "李四", "王五"], ["欧阳修"], [], []]
    assert [r["at"] for r in got] == ["东村", "地", "大处", None] and got[1]["family"] == "欧阳"


def test_fold_is_the_digest_modulo_five(spark):
    import hashlib

    keys = [f"3·{i}" for i in range(200)]
    got = column(spark, [(k,) for k in keys], "k string", split=text.fold_of(F.col("k"), ("3·7",)))
    for r in got:
        n = int(hashlib.sha256(r["k"].encode()).hexdigest(), 16) % 5
        assert r["split"] == ("regression" if r["k"] == "3·7" else {0: "test", 1: "dev"}.get(n, "audit"))


def test_usable_text(spark):
    rows = [("立契", 100, 200), ("123", 10, 60), ("123", 500, 560), ("123", 900, 960), ("abc立契", 500, 600), ("，。立", 500, 600), ("", 1, 2), (None, 1, 2)]
    got = column(spark, rows, "t string, l int, r int", ok=text.usable(F.col("t"), F.col("l"), F.col("r"), F.lit(1000)))
    assert [r["ok"] or False for r in got] == [True, False, True, False, False, False, False, False]


def test_invented_text_is_filtered(spark):
    rows = [("立契人", "立契人", 0.9), ("立" * 600, "立契", 0.9), ("立契人張三李四", "立契人", 0.9), ("立契人", "立契人", 0.3), ("".join(text.TEMPLATE_PHRASES), "".join(text.TEMPLATE_PHRASES), 0.5)]
    out, reasons = text.filtered_text(F.col("f"), F.col("t"), F.col("c"), F.lit("agreed"))
    got = column(spark, rows, "f string, t string, c double", out=out, why=reasons)
    assert [r["out"] for r in got] == ["立契人", "立契", "立契人", "agreed", rows[4][1]]
    assert got[0]["why"] == [] and [w.split(":")[1] for w in got[1]["why"]] == ["too_long", "v3_only_ratio"] and got[3]["why"] == ["hard_reject:low_model_agreement:0.30<0.45"]


def test_people_score_alike_in_both_forms(spark):
    r = random.Random(2)
    name = lambda: "".join(r.choice("張张王李欧阳三四五") for _ in range(r.randint(1, 4)))
    rows = [(name(), name(), r.choice((None, 1800, 1802, 1850)), r.choice((None, 1800, 1811)), r.choice(("", "東村处", "西村", "东村地方")), r.choice(("东村", "西邨", "东村里巷"))) for _ in range(200)]
    got = column(spark, rows, "a string, b string, y int, z int, p string, q string", v=similarity.person_similarity(*map(F.col, "abyzpq")))
    for row, r_ in zip(rows, got, strict=True):
        assert abs(r_["v"] - people.score_people(*row)) < 1e-9, row


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_alignment_against_plain_tables():
    r = random.Random(7)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(0, 12))) for _ in "ab")
        assert alignment.lcs(a, b) == slow_lcs(a, b)
        ops = alignment.edits(a, b)
        assert "".join(x for _, x, _ in ops) == a and "".join(y for _, _, y in ops) == b
        assert sum(op != "match" for op, _, _ in ops) == round(max(len(a), len(b)) * (1 - people._edits(a, b))) if a and b else len(ops) == len(a) + len(b)
        pairs = alignment.global_alignment(a, b)
        assert "".join(x for x, _ in pairs) == a and "".join(y for _, y in pairs) == b


def test_agreement_and_fusion():
    assert alignment.agreed("立契人張三", "立契人李三") == "立契人□三"
    assert alignment.fused("立契約人張三", "立契人張三")[0] == "立契約人張三"
    assert alignment.fused("多出很多很多字立契", "立契") == ("立契", 1.0)
    assert alignment.fused("x", "") == ("", 0.0) and alignment.fused("", "立契") == ("立契", 1.0)


def test_metric_modes():
    assert alignment.metric_text("立 契，□人。", "raw") == "立契，人。" and alignment.metric_text("立 契，□人。", "faithful") == "立契人"
    assert alignment.metric_text("卖与张刘", "content") == "卖与張劉"


def test_micro_average(spark):
    df = spark.createDataFrame([("abc", "abcd"), ("xyz", "abc"), (None, "q")], "guess string, truth string")
    one = alignment.micro_average(alignment.char_measures(df, "guess", "truth")).first()
    assert (one.gt_len, one.pred_len, one.lcs_len, one.edit_distance) == (8, 6, 3, 5) and one.precision == 0.5 and one.recall == 0.375 and one.cer == 0.625


def test_vectors(spark):
    got = column(spark, [([1.0, 0.0], [0.0, 1.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>", c=similarity.cosine(F.col("a"), F.col("b")), d=similarity.squared_distance(F.col("a"), F.col("b")))
    assert np.allclose([r["c"] for r in got], [0, 1, 0]) and [r["d"] for r in got] == [2.0, 2.0, 2.0]
