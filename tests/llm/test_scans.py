import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np

from loomspan.llm import pii, secrets
from loomspan.llm.tagger import Tagger

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def test_base_spans_as_plain_patterns():
    r = random.Random(6)
    made = pii.Spans(2)
    for _ in range(3000):
        text = "".join(r.choice("a@.+-( )019é") for _ in range(50))
        assert pii.base_spans(text) == plain(text)
    for _ in range(500):
        text = " ".join(made.of(r.randint(0, 3)) if r.random() < 0.6 else made.other() for _ in range(5))
        assert pii.base_spans(text) == plain(text)
    assert pii.base_spans("a" * 200_000) == [] and pii.base_spans("1" * 200_000) == []


def test_gradients():
    tagger = Tagger(2, dims=3, hidden=4)
    tagger.p = {k: v.astype(float) for k, v in tagger.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 100, (7, 3)), np.zeros((7, 3), int)
    y[2], y[3], y[5, 0] = 1, 2, 3
    _, g = tagger.gradients(x, y)
    for k, w in tagger.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), w.shape)
        old, step, around = w[at], 1e-3, []
        for d in (step, -step):
            w[at] = old + d
            around.append(tagger.gradients(x, y)[0])
        w[at] = old
        assert abs((around[0] - around[1]) / 2 / step - g[k][at]) < 1e-3


def test_tagger_learns_and_adds(spark, odd, none):
    ground = ["the words of a text that goes on and on without any number at all in it", "un texte en français avec des mots et des accents éà"]
    x, y = pii.training_windows(ground, [], size=900)
    tagger = Tagger(4)
    losses = tagger.fit(x, y, epochs=10)
    assert losses[-1] < losses[0] / 10
    made, right, wrong, total = pii.Spans(77), 0, 0, 0
    for _ in range(200):
        kind = made.r.randint(0, 5)
        piece = made.of(kind) if kind < 4 else made.other()
        text = f"{ground[0][:30]} {piece} {ground[1][:30]}"
        base = pii.base_spans(text)
        found = base + pii.added_spans(tagger, [text], [base])[0]
        if kind < 4:
            total += 1
            right += (kind, 31, 31 + len(piece)) in found
        else:
            wrong += bool(found)
    assert right > 0.8 * total and wrong <= 2
    rows = pii.find_personal_data(odd, tagger).collect()
    assert len(rows) == odd.count() and pii.find_personal_data(none, tagger).count() == 0
    assert all(r.base_sha256 == hashlib.sha256(r.base.encode()).hexdigest() for r in rows)
    one = pii.find_personal_data(spark.createDataFrame([(1, "mail a.b@c.de or +1 (988) 555-2485, 10.0.0.300, 4111 1111 1111 1111")], "doc_id long, text string"), tagger).first()
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 0, 1, 1) and one.base.startswith("email:5:13,card:")


def test_tagger_finds_what_base_patterns_miss(spark):
    """Held-out spans in other forms, alone and beside another one, in texts of the test tables."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tagger = pii.fit(documents)
    grounds = [r.text for r in documents.filter("n_chars between 200 and 900").orderBy("doc_id").collect() if not pii.TRIGGER.search(r.text)]
    for alone, least in ((True, 0.95), (False, 0.85)):
        made, total, right, foreign = pii.Spans(4242), 0, 0, 0
        for n in range(400):
            ground = grounds[n % len(grounds)]
            text, planted = ground[: ground.index(" ", 60) + 1], set()
            rest = ground[len(text) :]
            for kind in [made.r.randint(0, 3) for _ in range(1 if alone else 2)]:
                piece = made.of(kind)
                planted.add((kind, len(text), len(text) + len(piece)))
                text += piece + " "
            base = pii.base_spans(text + rest)
            added = pii.added_spans(tagger, [text + rest], [base])[0]
            missed = [p for p in planted - set(base) if not any(s < p[2] and p[1] < e for _, s, e in base)]
            total += len(missed)
            right += len(set(missed) & set(added))
            foreign += sum(not any(s < z and q < e for _, s, e in planted) for _, q, z in added)
        assert total > 150 and right >= least * total and foreign <= 4, (alone, total, right, foreign)


def test_best_path_and_marginals_against_all_paths():
    """Decoding of short windows: the best of all tag sequences, and marginals as sums over all of them."""
    tagger, rng = Tagger(1, dims=3, hidden=4), np.random.default_rng(5)
    tagger.p["trans"] = rng.normal(0, 1, tagger.p["trans"].shape).astype(np.float32)
    x = rng.integers(1, 100, (6, 5))
    e = tagger.emissions(x.T)[0]
    moves = tagger.p["trans"] + tagger.banned
    marginals = tagger.marginals(e)
    decoded = tagger.decode(x)
    for w in range(6):
        scores = {}
        for path in itertools.product(range(3), repeat=5):
            scores[path] = float(tagger.first[path[0]] + sum(e[t, w, path[t]] for t in range(5)) + sum(moves[path[t - 1], path[t]] for t in range(1, 5)))
        best = max(scores, key=scores.get)
        spans = [(t, next((u for u in range(t + 1, 5) if best[u] != 2), 5)) for t in range(5) if best[t] == 1]
        assert [(s, z) for _, s, z, _ in decoded[w]] == spans
        weights = {p: math.exp(v - scores[best]) for p, v in scores.items()}
        for t in range(5):
            for tag in range(3):
                assert abs(marginals[t, w, tag] - sum(v for p, v in weights.items() if p[t] == tag) / sum(weights.values())) < 1e-4


def test_reconcile_against_all_subsets():
    r = random.Random(8)
    for _ in range(60):
        found = [(r.randrange(2), s := r.randrange(30), s + r.randint(1, 9), r.choice((0.6, 0.7, 0.9, 1.0))) for _ in range(7)]
        weight = lambda spans: sum(max(p for *x, p in found if tuple(x) == k) * (k[2] - k[1]) for k in spans)
        distinct = sorted({x[:3] for x in found})
        best = max(weight(c) for n in range(8) for c in itertools.combinations(distinct, n) if all(a[2] <= b[1] or b[2] <= a[1] for a, b in itertools.combinations(c, 2)))
        got = pii.reconcile(found)
        assert abs(weight(got) - best) < 1e-9 and all(a[2] <= b[1] or b[2] <= a[1] for a, b in itertools.combinations(got, 2))


def test_reconcile():
    assert pii.reconcile([(0, 0, 10, 0.9), (0, 5, 8, 0.99), (1, 10, 20, 0.7), (1, 10, 20, 0.8)]) == [(0, 0, 10), (1, 10, 20)]
    assert pii.reconcile([]) == []


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("abcd") == {frozenset({"abc", "bcd"})}
    assert q("abc|xyz") == {frozenset({"abc"}), frozenset({"xyz"})}
    assert q("[0-9]{32}") is None and q("ab") is None and q("abc|x") is None
    assert q("api_?key") == {frozenset({"api", "pi_", "i_k", "_ke", "key"}), frozenset({"api", "pik", "ike", "key"})}
    r = random.Random(3)
    for rule in secrets.RULES:  # no match without what its query asks for
        query = q(rule.regex)
        for _ in range(300):
            text = "".join(r.choice(["password", "API_KEY", "token", "=", ": ", "'", "AKIA", "x9", "-----BEGIN ", "PRIVATE KEY-----", "ghp_", "xoxb-", "0123456789abcdef"]) for _ in range(9))
            if re.search(rule.regex, text, re.A) and query is not None:
                assert any(all(t in text.lower() for t in part) for part in query)


def spans(text):
    out = []
    for n, rule in enumerate(secrets.RULES):
        out += [(m.start(), n, m.end(), rule.kind) for m in re.finditer(rule.regex, text, re.A) if len(m.group(rule.group)) >= rule.least]
    return sorted(out)


def test_secrets_as_plain_patterns(spark, odd, none):
    r = random.Random(8)
    parts = ["password", "Secret", "API_KEY", "apikey", "token", "=", ": ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é😀", " ", "\n", "hunter2hunter2", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18, "xoxb-1234567890ab"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 25)))) for i in range(300)] + [(400, None)]
    got = {x.doc_id: [tuple(s) for s in x.found] for x in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: spans(t or "") for i, t in rows}
    assert secrets.find_secrets(odd).count() == odd.count() and secrets.find_secrets(none).count() == 0
    plan = secrets.find_secrets(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_masked_secrets(spark, odd, none):
    rows = [(1, 'a token = "0123456789abcdef0123456789abcdef" b', 46), (2, "nothing", 7), (3, None, None)]
    got = {r.doc_id: r for r in secrets.without_secrets(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert got[1].text == 'a [assign]" b' and got[1].n_chars == len(got[1].text) and got[2].text == "nothing" and got[3].text is None
    left = secrets.without_secrets(odd)
    assert left.schema == odd.schema and Counter(r.text for r in left.collect()) == Counter(r.text for r in odd.collect()) and secrets.without_secrets(none).count() == 0
