"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation, over a count-based vocabulary.

Words are classes of the model: each of the `head` most frequent words is its own, the others share a class for each
hash of their last two bytes.  Within a shared class words follow their counts over all training documents, so that
every token of any text has a probability and all sum to 1.

The log-bilinear score of class w after classes u (one back) and v (two back) is R[u] C1 . Q[w] + R[v] C2 . Q[w] + b[w].
It splits into a part for each place, S1[u, w] + S2[v, w]; the normaliser of all contexts is one batched product of
matrices, exp(S1 + b) exp(S2)^T.  Scoring a token is then three look-ups.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.shared import batch_of, doc_columns, map_arrow, pieces, written
from loomspan.llm.shared import frequent as most_frequent

ALPHA = 0.1
KEEP_COUNTS = 200_000
#: Places that a task counts at a time; places for each part of the training contexts, up to so many parts; places of
#: equal contexts that are one step of training.
KEEP_PLACES, PART_PLACES, PARTS_MOST, TOGETHER = 2_000_000, 1_000_000, 256, 8


def words_of(text: str) -> list[bytes]:
    """Lower-case A-Z; words between blanks of ASCII (space, tab to carriage return): what bytes does."""
    return text.encode().lower().split()


@dataclass
class Classes:
    """Frequent words have a number of their own, up to `own` also as class; class 0 is the end of a text."""

    words: dict[bytes, int]
    own: int
    shared: int
    count_log: np.ndarray  # of each frequent word, log10(c + ALPHA)

    @property
    def size(self) -> int:
        return 1 + self.own + self.shared

    def of_rare(self, word: bytes) -> int:
        return 1 + self.own + zlib.crc32(word[-2:]) % self.shared

    def table(self) -> np.ndarray:
        """The class of each frequent word."""
        return np.array([1 + i if i < self.own else self.of_rare(w) for w, i in self.words.items()], np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """Words of every text of (doc_id, text) with their counts: word (binary), n.  Tasks count before the shuffle, in bounded memory."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in pieces(batch, "text"):
                for text in part.column(1).to_pylist():
                    counts.update(words_of(text))
                if len(counts) > KEEP_COUNTS:
                    yield batch_of(schema, list(counts), list(counts.values()))
                    counts = Counter()
        if counts:
            yield batch_of(schema, list(counts), list(counts.values()))

    return docs.select("doc_id", "text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def sample_contexts(docs: DataFrame, classes: Classes, share: float) -> DataFrame:
    """(two back, one back, word) classes of a share of all tokens, picked at every place alike by a hash of id, text and place."""
    held = docs.sparkSession.sparkContext.broadcast(classes)
    schema = pa.schema([("v", pa.int32()), ("u", pa.int32()), ("w", pa.int32())])

    def make():
        own, table = held.value, held.value.table()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                n = len(words) + 1
                seed = [(doc_id or 0) % 2**63, zlib.crc32(text.encode())]  # copies of a text each get places of their own
                at = np.flatnonzero(np.random.default_rng(seed).random(n) < share)
                for i in at.tolist():
                    found.append([class_of(own, table, words[j]) if 0 <= j < n - 1 else 0 for j in (i - 2, i - 1, i)])
            return batch_of(schema, *np.array(found, np.int32).reshape(-1, 3).T) if found else None

        return step

    return map_arrow(docs.select("doc_id", "text"), make, "v int, u int, w int")


def starting_contexts(docs: DataFrame, classes: Classes, total: int, most: int) -> np.ndarray:
    """About `most` contexts (two back, one back, word) for the first weights, sorted, from `total` places of all texts.

    Equal contexts are counted before they come to the driver: repeated rows of one id and text have the same places, so
    that rows sent are about `most` however often a row repeats.  Of more than `most` places evenly spaced ones are
    taken, so that a context keeps its share.
    """
    drawn = sample_contexts(docs, classes, min(1.0, most / max(1, total))).groupBy("v", "u", "w").agg(F.count("*").alias("n"))
    v, u, w, n = (x.to_numpy() for x in drawn.toArrow().columns)
    order = np.lexsort((v, u, w))
    ends = np.cumsum(n[order])
    places = int(ends[-1]) if len(ends) else 0
    size = min(places, most)
    at = np.searchsorted(ends, np.arange(size) * places // max(1, size), "right")
    return np.stack([v, u, w], 1)[order[at]]


def context_counts(docs: DataFrame, classes: Classes, parts: int) -> DataFrame:
    """(part, keys, times) of all places of all texts: packed contexts (v size + u) size + w, sorted, and how often each occurs.

    A part holds all contexts of its (v, u), so what it holds depends only on the texts.  Tasks count before the shuffle;
    different contexts are size^3 at most, however many texts there are.
    """
    held = docs.sparkSession.sparkContext.broadcast(classes)
    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("times", pa.binary())])

    def counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, at = np.unique(keys, return_inverse=True)
        return found, np.bincount(at, times, len(found)).astype(np.int64)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table, size = held.value, held.value.table(), held.value.size
        get, kept, places = own.words.get, [], 0

        def packed() -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate(kept), return_counts=True)
            part = (keys // size * 2654435761 >> 12) % parts
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            full = [i for i in range(parts) if cuts[i + 1] > cuts[i]]
            block = lambda x: [x[order[cuts[i] : cuts[i + 1]]].tobytes() for i in full]
            return batch_of(schema, full, block(keys), block(times.astype(np.int64)))

        for batch in batches:
            for piece in pieces(batch, "text"):
                for text in piece.column(1).to_pylist():
                    words = words_of(text)
                    at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                    cls = np.zeros(len(words) + 3, np.int64)  # two ends before the text, one after
                    if len(table):
                        cls[2:-1] = table[at]
                    for i in np.flatnonzero(at < 0).tolist():
                        cls[2 + i] = own.of_rare(words[i])
                    kept.append((cls[:-2] * size + cls[1:-1]) * size + cls[2:])
                    places += len(words) + 1
                if places > KEEP_PLACES:
                    yield packed()
                    kept, places = [], 0
        if kept:
            yield packed()

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for part, keys, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault(part, []).append((np.frombuffer(keys, np.int64), np.frombuffer(times, np.int64)))
        for part in sorted(found):
            keys, times = counted(*map(np.concatenate, zip(*found.pop(part), strict=True)))
            yield batch_of(schema, [part], [keys.tobytes()], [times.tobytes()])

    columns = "part int, keys binary, times binary"
    return docs.select("doc_id", "text").mapInArrow(count, columns).repartition(parts, "part").mapInArrow(meet, columns)


def refined(state: list[np.ndarray], contexts: DataFrame, size: int, unigram: np.ndarray) -> list[np.ndarray]:
    """The state after training on all contexts: each part from the same start, weights averaged by places."""
    held = contexts.sparkSession.sparkContext.broadcast((state, unigram))
    schema = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("state", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, seen = held.value
        for batch in batches:
            for part, keys, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, times = np.frombuffer(keys, np.int64), np.frombuffer(times, np.int64)
                steps = -(-times // TOGETHER)
                each = np.repeat(keys, steps)
                own = np.stack([each // size**2, each // size % size, each % size], 1)
                found = fit(own, size, weights=np.repeat(times / steps, steps), start=start, unigram=seen, epochs=1, batch=1024, rate=0.15, seed=7 + part)
                yield batch_of(schema, [part], [int(times.sum())], [np.concatenate([np.ravel(x) for x in found]).astype(np.float32).tobytes()])

    rows = contexts.mapInArrow(run, "part int, n long, state binary").toArrow().sort_by("part")  # PARTS_MOST rows at most
    if not len(rows):
        return state
    n = np.array(rows.column("n").to_pylist(), float)
    mean = sum(w * np.frombuffer(x.as_py(), np.float32).astype(float) for w, x in zip(n / n.sum(), rows.column("state"), strict=True))
    cuts = np.cumsum([np.size(x) for x in state])[:-1]
    return [x.reshape(np.shape(old)) for x, old in zip(np.split(mean, cuts), state, strict=True)]


def class_of(classes: Classes, table: np.ndarray, word: bytes) -> int:
    i = classes.words.get(word)
    return classes.of_rare(word) if i is None else int(table[i])


@dataclass
class LogBilinear:
    s1: np.ndarray  # [one back, word], with the bias
    s2: np.ndarray  # [two back, word]
    log_z: np.ndarray  # [one back, two back]

    @classmethod
    def of(cls, r: np.ndarray, c1: np.ndarray, c2: np.ndarray, q: np.ndarray, b: np.ndarray) -> LogBilinear:
        s1, s2 = (r @ c1 @ q.T + b).clip(-40, 40), (r @ c2 @ q.T).clip(-40, 40)
        return cls(s1.astype(np.float32), s2.astype(np.float32), np.log(np.exp(s1) @ np.exp(s2).T).astype(np.float32))

    def log_prob(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self.s1[u, w] + self.s2[v, w] - self.log_z[u, v]


def train(contexts: np.ndarray, size: int, **how) -> LogBilinear:
    return LogBilinear.of(*fit(contexts, size, **how)[:5])


def fit(contexts: np.ndarray, size: int, *, weights: np.ndarray | None = None, start: list[np.ndarray] | None = None, unigram: np.ndarray | None = None, dims: int = 24, noise: int = 96, batch: int = 512, epochs: int = 2, rate: float = 0.08, seed: int = 7) -> list[np.ndarray]:
    """Noise-contrastive estimation with noise from the unigram distribution, shared within a batch; Adagrad.

    A context counts as many times as its weight.  Returns the weights r, c1, c2, q, b and their sums of squares, from
    which a later call may start.
    """
    rng = np.random.default_rng(seed)
    if unigram is None:
        seen = np.bincount(contexts[:, 2], minlength=size) + 1.0 if len(contexts) else np.ones(size)
        unigram = seen / seen.sum()
    weights = np.ones(len(contexts), np.float32) if weights is None else weights.astype(np.float32)
    usual = float(weights.mean()) if len(weights) else 1.0
    log_noise = (np.log(unigram) + np.log(noise)).astype(np.float32)
    up_to = np.cumsum(unigram)
    r, q = rng.normal(0, 0.1, (size, dims)), rng.normal(0, 0.1, (size, dims))
    c1, c2, b = np.eye(dims), 0.5 * np.eye(dims), np.log(unigram)
    gr, gq, gc1, gc2, gb = np.full(size, 1e-2), np.full(size, 1e-2), 1e-2, 1e-2, np.full(size, 1e-2)
    if start is not None:
        r, c1, c2, q, b, gr, gq, gc1, gc2, gb = (np.array(x, float) for x in start)
    r, c1, c2, q, b = (x.astype(np.float32) for x in (r, c1, c2, q, b))
    column = np.arange(dims)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    # sums of rows by class: one count over cells, which is faster than adding in place
    by_class = lambda at, rows: np.bincount((at[:, None] * dims + column).ravel(), rows.ravel(), size * dims).reshape(size, dims)
    for _ in range(epochs):
        order = rng.permutation(len(contexts))
        for at in range(0, len(order), batch):
            v, u, w = contexts[order[at : at + batch]].T
            times = weights[order[at : at + batch]]
            other = np.minimum(np.searchsorted(up_to, rng.random(noise)), size - 1)
            hidden = r[u] @ c1 + r[v] @ c2
            qw, qo = q[w], q[other]
            true = sigmoid((hidden * qw).sum(1) + b[w] - log_noise[w]) - 1  # derivative by the score of the data
            true *= times
            false = sigmoid(hidden @ qo.T + (b[other] - log_noise[other]))  # and of the noise
            false *= times[:, None]
            n = len(v) * usual
            dh = (true[:, None] * qw + false @ qo) / n
            dq = by_class(np.append(w, other), np.concatenate([true[:, None] * hidden, false.T @ hidden])) / n
            db = (np.bincount(w, true, size) + np.bincount(other, false.sum(0), size)) / n
            dr = by_class(np.append(u, v), np.concatenate([dh @ c1.T, dh @ c2.T]))
            d1, d2 = r[u].T @ dh, r[v].T @ dh
            gr += (dr * dr).mean(1)
            gq += (dq * dq).mean(1)
            gb += db * db
            gc1 += float((d1 * d1).mean())
            gc2 += float((d2 * d2).mean())
            r -= (rate * dr / np.sqrt(gr)[:, None]).astype(np.float32)
            q -= (rate * dq / np.sqrt(gq)[:, None]).astype(np.float32)
            b -= (rate * db / np.sqrt(gb)).astype(np.float32)
            c1 -= (0.1 * rate / np.sqrt(gc1) * d1).astype(np.float32)
            c2 -= (0.1 * rate / np.sqrt(gc2) * d2).astype(np.float32)
    return [np.asarray(x, float) for x in (r, c1, c2, q, b, gr, gq, gc1, gc2, gb)]


def lm_scores(docs: DataFrame, train_on: DataFrame, *, frequent: int = 60_000, own: int = 900, shared: int = 60, train_tokens: int = 300_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text of docs with a model of all texts of train_on.

    Returns doc_id, n_tokens (words and one end), n_known (seen in training), train_tokens, base_score (sum of log10 of
    the additively smoothed unigram probability) and score (the model's log10 probability of the text).

    Null and empty texts hold just the end.  With no training text all words are unknown and the model is level.
    Repeated rows give repeated results, an empty table an empty one; other columns are ignored.

    Counts cover all training documents and are as many as these have words.  The `frequent` first of them are sent to
    every task; of the other words each document sends one row (word, times) to where the word's count lies, so no
    word that it shuffles is frequent.  The network's weights start from about train_tokens places drawn from all
    training texts, and are then fitted on the contexts of all places of all training texts, counted by class.
    """
    spark = docs.sparkSession
    train_rows, rows = doc_columns(train_on, id_col=id_col, text_col=text_col), doc_columns(docs, id_col=id_col, text_col=text_col)
    counts = written(count_words(train_rows), "word-counts")
    ends = train_rows.count()
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = (sums.n or 0) + ends, sums.v + (ends > 0)
    below = np.log10(total + ALPHA * (distinct + 1))
    head = most_frequent(counts, "n", "word", frequent).collect()
    own = max(0, min(own, len(head)))
    classes = Classes({bytes(r.word): i for i, r in enumerate(head)}, own, shared, np.log10(np.array([r.n for r in head], float) + ALPHA))
    # what a shared class holds over all documents, for the probability of a word within it
    tail_class = F.lit(1 + own) + F.crc32(F.expr("right_bytes")) % shared
    by_class = counts.withColumn("right_bytes", F.expr("substring(word, greatest(length(word) - 1, 1), 2)")).withColumn("class", tail_class)
    by_class = by_class.join(F.broadcast(spark.createDataFrame([(r.word,) for r in head[:own]], "word binary")), "word", "left_anti") if own else by_class
    mass = np.full(classes.size, 1.0)
    held_by, kinds = np.zeros(classes.size), np.zeros(classes.size)
    for r in by_class.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        held_by[r["class"]], kinds[r["class"]] = r.n, r.v
    mass[1 + own :] = (held_by + ALPHA * (kinds + 1))[1 + own :]
    contexts = starting_contexts(train_rows, classes, total, train_tokens)
    seen = np.ones(classes.size)
    seen[0] += ends
    seen[1 : 1 + own] += [r.n for r in head[:own]]
    seen[1 + own :] += held_by[1 + own :]
    unigram = seen / seen.sum()
    parts = min(PARTS_MOST, 1 + total // PART_PLACES)
    every = written(context_counts(train_rows, classes, parts), "contexts")
    model = LogBilinear.of(*refined(fit(contexts, classes.size, unigram=unigram), every, classes.size, unigram)[:5])
    held = spark.sparkContext.broadcast((classes, model, np.log10(mass)))
    end_log = float(np.log10(ends + ALPHA))

    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("word", pa.binary()), ("times", pa.int64()), ("rows", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])

    def make():
        own_classes, own_model, log_mass = held.value
        table, get = own_classes.table(), own_classes.words.get
        log_mass_of, count_log = log_mass[table] if len(table) else table, own_classes.count_log
        nothing = -1

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, marks, words_out, times, ones, n_tokens, known, base, lm = [[] for _ in range(9)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                at = np.fromiter((get(w, nothing) for w in words), np.int64, len(words))
                is_head = at >= 0
                cls = np.zeros(len(words) + 3, np.int64)  # two ends before the text, one after
                cls[2:-1][is_head] = table[at[is_head]]
                rare = np.flatnonzero(~is_head).tolist()
                for i in rare:
                    cls[2 + i] = own_classes.of_rare(words[i])
                score = float(own_model.log_prob(cls[:-2], cls[1:-1], cls[2:]).sum(dtype=np.float64)) / np.log(10)
                in_head = at[is_head]
                in_shared = in_head[in_head >= own_classes.own]
                score += float((count_log[in_shared] - log_mass_of[in_shared]).sum())
                score -= float(log_mass[cls[2:-1][~is_head]].sum())
                mark = zlib.crc32(text.encode()) << 32 | zlib.adler32(text.encode())
                mark -= (mark >> 63) << 64
                ids.append(doc_id)
                marks.append(mark)
                words_out.append(None)
                times.append(0)
                ones.append(1)
                n_tokens.append(len(words) + 1)
                known.append(len(in_head) + (ends > 0))
                base.append(float(count_log[in_head].sum()) + end_log)
                lm.append(score)
                tail = Counter(words[i] for i in rare)
                k = len(tail)
                ids += [doc_id] * k
                marks += [mark] * k
                words_out += tail.keys()
                times += tail.values()
                for xs, x in ((ones, 0), (n_tokens, 0), (known, 0), (base, 0.0), (lm, 0.0)):
                    xs += [x] * k
            return batch_of(schema, ids, marks, words_out, times, ones, n_tokens, known, base, lm)

        return step

    scored = map_arrow(rows, make, "doc_id long, mark long, word binary, times long, rows long, n_tokens long, known long, base double, model double")
    scored = written(scored, "scored-tokens")
    whole = scored.filter("word is null").drop("word", "times")
    found = scored.filter("word is not null").select("doc_id", "mark", "word", "times").join(counts.select("word", "n"), "word", "left")
    log_count = F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(ALPHA)) * F.col("times")
    rare = found.select("doc_id", "mark", F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("known"), log_count.alias("base"), log_count.alias("model"))
    # equal rows of one id and text meet here; each gets its part back
    both = whole.unionByName(rare).groupBy("doc_id", "mark").agg(*[F.sum(c).alias(c) for c in ("rows", "n_tokens", "known", "base", "model")])
    each = lambda c: F.expr(f"{c} div rows")
    return both.select(
        "doc_id",
        each("n_tokens").alias("n_tokens"),
        each("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows") - each("n_tokens") * F.lit(float(below))).alias("base_score"),
        (F.col("model") / F.col("rows")).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_copy"),
    ).drop("_copy")
