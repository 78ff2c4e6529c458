import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from loomspan.llm import jaccard_join, lang_id, lm, secrets, toxicity
from loomspan.llm.queries import fold

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_lm_base_scores_and_normalisation(spark, documents):
    scored = {r.doc_id: r for r in lm.lm_scores(documents, documents.filter(fold(10) != 0), frequent=500, own=100, train_tokens=20_000).collect()}
    rows = [(r.doc_id, r.text or "") for r in documents.collect()]
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in [*t.encode().lower().split(), None])
    total, distinct = sum(counts.values()), len(counts)
    for i, t in rows:
        words = [*t.encode().lower().split(), None]
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        assert abs(scored[i].base_score - base) < 1e-6
        assert (scored[i].n_tokens, scored[i].n_known, scored[i].train_tokens) == (len(words), sum(counts.get(w, 0) > 0 for w in words), total)
        assert scored[i].score < 0


def test_log_bilinear_model():
    rng = np.random.default_rng(1)
    word = np.zeros(20_000, np.int64)
    for i in range(1, len(word)):  # each word mostly follows from the one before
        word[i] = (word[i - 1] * 3 + 1) % 12 if rng.random() < 0.9 else rng.integers(12)
    contexts = np.stack([word[:-2], word[1:-1], word[2:]], 1)
    model = lm.train(contexts, 12, epochs=8, noise=12, rate=0.3)
    v, u = np.meshgrid(np.arange(12), np.arange(12))
    every = np.stack([model.log_prob(v.ravel(), u.ravel(), np.full(144, w)) for w in range(12)])
    assert np.allclose(np.exp(every).sum(0), 1, atol=1e-4)
    assert model.log_prob(*contexts.T).mean() > math.log(1 / 12) + 0.8


def test_lm_rows(odd, none):
    rows = lm.lm_scores(odd, odd, frequent=5, own=2, train_tokens=1000).collect()
    assert len(rows) == odd.count()
    first = [r for r in rows if r.doc_id == 1]
    assert len(first) == 2 and first[0] == first[1] and first[0].n_tokens == 13
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert lm.lm_scores(none, odd).count() == 0
    untrained = lm.lm_scores(odd, none, train_tokens=10).collect()
    assert {r.n_known for r in untrained} == {0} and all(abs(r.base_score) < 1e-9 for r in untrained)  # (0 + 0.1) / (0 + 0.1 x 1)


def test_lm_learns_from_all_places(spark, monkeypatch):
    """Hardly a place is drawn for the start; what follows what is learnt from all others, in several parts."""
    r = random.Random(4)
    words, rows = ["w%d" % i for i in range(20)], []
    for i in range(120):
        at, text = r.randrange(20), []
        for _ in range(300):
            at = (at * 3 + 1) % 20 if r.random() < 0.9 else r.randrange(20)
            text.append(words[at])
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = lm.Classes({w.encode(): i for i, w in enumerate(words[:12])}, 9, 4, np.zeros(12))
    expected = Counter()
    for _, text in rows:
        cls = [0, 0, *[1 + i if i < 9 else classes.of_rare(words[i].encode()) for i in (words.index(w) for w in text.split())], 0]
        expected.update(zip(cls, cls[1:], cls[2:], strict=False))
    got = Counter()
    monkeypatch.setattr(lm, "KEEP_PLACES", 1000)
    for row in lm.context_counts(docs, classes, 3).collect():
        for k, n in zip(np.frombuffer(row.keys, np.int64).tolist(), np.frombuffer(row.times, np.int64).tolist(), strict=True):
            got[k // 14**2, k // 14 % 14, k % 14] += n
    assert got == expected
    monkeypatch.setattr(lm, "PART_PLACES", 20_000)
    scored = lm.lm_scores(docs, docs, own=20, train_tokens=5).collect()
    assert sum(x.score - x.base_score for x in scored) / sum(x.n_tokens for x in scored) > 0.03


def test_sample_takes_copies_apart(spark):
    """Of many copies of a text about the share of all places is drawn, not the same places of each."""
    docs = spark.createDataFrame([(i, "a b c") for i in range(2000)], "doc_id long, text string")
    classes = lm.Classes({}, 0, 2, np.zeros(0))
    assert 600 < lm.sample_contexts(docs, classes, 0.1).count() < 1000  # 8000 places


def test_starting_contexts_of_repeated_rows(spark):
    """Without repeats all drawn places are taken as they are; of very many equal rows about as many as wanted, in proportion."""
    words = ["w%d" % i for i in range(6)]
    classes = lm.Classes({w.encode(): i for i, w in enumerate(words)}, 6, 1, np.zeros(6))
    r = random.Random(2)
    single = spark.createDataFrame([(i, " ".join(r.choices(words, k=20))) for i in range(30)], "doc_id long, text string")
    got = lm.starting_contexts(single, classes, 630, 10**6)
    drawn = Counter(map(tuple, lm.sample_contexts(single, classes, 1.0).collect()))
    assert len(got) == 630 and Counter(map(tuple, got.tolist())) == drawn
    assert got.tolist() == sorted(got.tolist(), key=lambda x: x[::-1])

    text = " ".join(r.choices(words, k=400))
    same = spark.createDataFrame([(1, text)] * 500 + [(2, text)] * 250, "doc_id long, text string")
    total = 750 * 401
    times = Counter(map(tuple, lm.sample_contexts(same, classes, 4000 / total).collect()))
    got = Counter(map(tuple, lm.starting_contexts(same, classes, total, 4000).tolist()))
    places = sum(times.values())
    assert places and sum(got.values()) == min(places, 4000) and set(got) <= set(times)
    assert all(abs(got[x] - n * sum(got.values()) / places) <= 1 for x, n in times.items())
    assert lm.starting_contexts(single.filter("false"), classes, 0, 100).shape == (0, 3)


def test_languages_held_out(documents, odd, none):
    model = lang_id.fit(documents.filter(fold(4) != 2))
    found = lang_id.identify(documents, model).join(documents.select("doc_id", "lang"), "doc_id").filter(fold(4) == 2).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    rows = {(r.doc_id, r.lang_pred) for r in lang_id.identify(odd, model).collect()}
    assert {(2, "und"), (3, "und"), (4, "und")} <= rows and len({i for i, _ in rows}) == 10
    assert lang_id.identify(odd, model).count() == odd.count() and lang_id.identify(none, model).count() == 0
    assert {r.lang_pred for r in lang_id.identify(odd, lang_id.fit(none)).collect()} == {"und"}


def test_mixed_text_has_spans(spark, documents):
    model = lang_id.fit(documents)
    texts = {r.lang: r.text for r in documents.filter("n_chars between 400 and 4000").orderBy("doc_id").collect()}
    one, two = texts["en"].split()[:60], texts["de"].split()[:60]
    spans = lang_id.identify(spark.createDataFrame([(1, " ".join(one + two))], "doc_id long, text string"), model).first().spans
    assert [s.lang for s in spans] == ["en", "de"] and abs(spans[0].end - 60) <= 6


def best_path(scores, penalty):
    ways = {(): 0.0}
    best = {(k,): s for k, s in enumerate(scores[0])}
    for row in scores[1:]:
        step = {}
        for path, total in best.items():
            for k, s in enumerate(row):
                value = total + s - penalty * (k != path[-1])
                old = step.get(k)
                if old is None or value > old[1]:
                    step[k] = (path + (k,), value)
        best = dict(step.values())
    assert ways
    return max(best.values())


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    scores = [rng.normal(0, 3, (n, 3)).astype(np.float32) for n in (7, 1, 0, 12, 4)]
    for s, path in zip(scores, lang_id.decode(scores, 2.0), strict=True):
        assert len(path) == len(s)
        if len(s):
            total = s[np.arange(len(s)), path].sum() - 2.0 * (np.diff(path.astype(int)) != 0).sum()
            assert abs(total - best_path(s.astype(float).tolist(), 2.0)) < 1e-4


def test_scripts_narrow(spark):
    rows = [(i, "привет мир как дела друзья", "ru") for i in range(4)] + [(i + 9, "hello world how are you friends", "en") for i in range(4)]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    scores = np.exp(model.word_scores(["новое", "unseen", "ωμέγα"]))
    assert scores[0, model.languages.index("ru")] > 0.99 and scores[1, model.languages.index("en")] > 0.99 and abs(scores[2, 0] - scores[2, 1]) < 1e-6


def test_severity(spark, documents, odd, none):
    r = random.Random(1)
    plain = ["the", "of", "house", "river", "green", "walk", "talk", "bread"]
    texts = [" ".join(r.choices(plain, k=30) + r.choices(["vilest", "grobian"], k=i % 4)) for i in range(400)]
    model = toxicity.fit_texts(texts, [min(i % 4, 2) for i in range(400)])
    mild, severe = model.scores(["the river walk", "the vilest walk", "vilest grobian vilest grobian vilest"])
    assert mild[0] < 0.3 < mild[1] <= mild[2] and (severe <= mild).all() and model.cuts[0] < model.cuts[1]
    rows = toxicity.severity(odd, model).collect()
    assert len(rows) == odd.count() and not any(x.toxic for x in rows) and toxicity.severity(none, model).count() == 0
    assert toxicity.without_toxic(odd, model).count() == odd.count() and toxicity.without_toxic(odd, model).columns == odd.columns
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert not any(x.toxic for x in toxicity.severity(odd, toxicity.fit(odd, labels)).collect())
    assert not any(x.toxic for x in toxicity.severity(odd, toxicity.fit(none, labels)).collect())


def test_ordinal_gradient_finds_the_order():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (600, 3))
    z = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(0, 0.3, 600)
    w, cuts = toxicity.fit_ordinal(x, np.digitize(z, [0.0, 2.0]), l2=1e-3)
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.3 * w[0] and cuts[0] < cuts[1]


def test_ordinal_fit_against_its_likelihood():
    """The likelihood, written out grade by grade, is no greater anywhere near the fit; predictions are as by hand."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 2))
    grades = np.digitize(x @ np.array([1.5, -0.5]) + rng.logistic(0, 1, 300), [0.2, 1.7])

    def likelihood(w, cuts):
        total = 0.0
        for row, g in zip(x, grades, strict=True):
            above = [1.0, *(1 / (1 + math.exp(cut - float(row @ w))) for cut in cuts), 0.0]
            total += math.log(above[g] - above[g + 1])
        return total / 300

    w, cuts = toxicity.fit_ordinal(x, grades, l2=0.0)
    best = likelihood(w, cuts)
    for step in (0.05, 0.2):
        for k in range(4):
            for sign in (step, -step):
                v = np.array([*w, *cuts])
                v[k] += sign
                assert likelihood(v[:2], v[2:]) <= best + 1e-5
    model = toxicity.SeverityModel({"foul": 0.7, "fou*": 0.1}, (1.0, 2.5))
    for text in ("", "a foul foul", "Foul words"):
        z = 0.7 * math.log1p(text.lower().count("foul"))
        assert np.allclose(model.scores([text]), [[1 / (1 + math.exp(c - z))] for c in (1.0, 2.5)])


def test_grades_come_from_labels(spark):
    docs = spark.createDataFrame([(i, "kind words here" if i % 3 == 0 else "vile words here") for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    by_hand = toxicity.fit_texts([r.text for r in docs.orderBy("doc_id").collect()], [0 if i % 3 == 0 else 2 - i % 2 for i in range(90)])
    assert model == by_hand
    assert toxicity.fit(docs, labels.drop("quality")).cuts[0] < 0 or toxicity.fit(docs, labels.drop("quality")).weights


def test_pipeline_against_brute_force(spark, documents):
    """run() by plain means: the same models' decisions, all pairs of shingle sets, substring search, the plain patterns."""
    from tests.llm.test_near import brute
    from tests.llm.test_scans import spans
    from tests.llm.test_tokens import library

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(documents, labels)
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    mild, _ = model.scores([t for _, t in rows])
    rows = [x for x, p in zip(rows, mild, strict=True) if p <= toxicity.THRESHOLD]
    rows = [x for x, (n, c) in zip(rows, brute(rows), strict=True) if c == x[0]]
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(x in " ".join(t.lower().split()) for x in items)]
    expected = {}
    for i, t in rows:
        out, at = "", 0
        for s, _, e, kind in spans(t):
            if s >= at:
                out += t[at:s] + f"[{kind}]"
            at = max(at, e)
        expected[i] = library(out + t[at:])[0]
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == expected
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "bpe"] and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_of_an_empty_table(spark, documents):
    df = documents.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
        assert df.count() == 0, name


def test_stages_keep_columns(spark, documents):
    df = documents.limit(30)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, SF).columns == documents.columns, name
    assert jaccard_join.one_of_each(df).count() <= 30 and secrets.without_secrets(df).count() == 30
