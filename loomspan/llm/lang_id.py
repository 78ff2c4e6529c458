"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty.

A word's scripts narrow the languages that it may belong to (those whose training words use that script).  Character
trigrams score it in each of those; Viterbi over a text's words, where each change of language costs a penalty, labels
spans.  The text's language is the one whose spans hold the most letters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.shared import batch_of, doc_columns, map_arrow

WORDS = re.compile(r"[^\W\d_]+")
#: Trigrams share this many counters.
BUCKETS = 1 << 17
KEEP_WORDS = 200_000
# First code points of ranges of scripts, in order; code points below 0x0370 are Latin.
SCRIPTS = [0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0A00, 0x0B80, 0x0C00, 0x0E00, 0x1000, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x4E00, 0xA000, 0xAC00, 0xD7B0]
# Ranges that continue an earlier script: Latin Extended Additional, Greek Extended, Hangul Jamo.
SAME_SCRIPT = {17: 0, 18: 1, 15: 24}


def scripts_of(codes: np.ndarray) -> np.ndarray:
    found = np.searchsorted(np.array(SCRIPTS), codes, side="right")
    for a, b in SAME_SCRIPT.items():
        found[found == a] = b
    return found


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each trigram of ' word ', where each word's trigrams begin, script of each word's first letter)."""
    codes = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 2)
    begins = ends - lengths - 2
    mixed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(40)
    inside = np.ones(len(mixed), bool)
    inside[(ends[:-1] - 2)] = inside[(ends[:-1] - 1)] = False  # windows over the border of two words
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return (mixed[inside] % np.uint64(BUCKETS)).astype(np.int64), starts, scripts_of(codes[begins + 1])


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # [BUCKETS, languages] log probabilities
    allowed: np.ndarray  # [scripts, languages]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log posterior of each word over the languages, no less than -12; level where no language has its script."""
        if not words or not self.languages:
            return np.zeros((len(words), len(self.languages)), np.float32)
        at, starts, scripts = trigrams(words)
        raw = np.add.reduceat(self.table[at], starts)
        may = self.allowed[scripts]
        raw = np.where(may | ~may.any(1, keepdims=True), raw, -np.inf)
        raw[~may.any(1)] = 0
        raw = raw - raw.max(1, keepdims=True)
        return np.maximum(raw - np.log(np.exp(raw).sum(1, keepdims=True)), -12).astype(np.float32)


def fit(docs: DataFrame, *, max_docs: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit trigram scores on at most about max_docs labelled documents, evenly over the languages, chosen by a hash of the id.

    Rows with a null text or language don't count.  Documents are counted where they lie; counters for (language,
    trigram bucket) reach the driver, so what it receives is bounded by max_docs and BUCKETS.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool))
    each = max(1, max_docs // len(languages))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))])
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30))
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                by.setdefault(lang, []).extend(WORDS.findall(text.lower()))
            out = [[], [], []]
            for lang, words in by.items():
                if words:
                    at, _, scripts = trigrams(words)
                    for found in (np.unique(at, return_counts=True), np.unique(-1 - scripts, return_counts=True)):  # scripts: negative buckets
                        out[0] += [lang] * len(found[0])
                        out[1] += found[0].tolist()
                        out[2] += found[1].tolist()
            return batch_of(schema, *out)

        return step

    counted = map_arrow(chosen, make, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts, allowed = np.zeros((BUCKETS, len(languages)), np.float64), np.zeros((len(SCRIPTS) + 1, len(languages)), bool)
    of = np.array([languages.index(x) for x in counted.lang], np.int64)
    bucket, n = counted.bucket.to_numpy(), counted.n.to_numpy()
    counts[bucket[bucket >= 0], of[bucket >= 0]] = n[bucket >= 0]
    seen = np.zeros(allowed.shape)
    seen[-1 - bucket[bucket < 0], of[bucket < 0]] = n[bucket < 0]
    allowed = seen > 1e-3 * seen.sum(0, keepdims=True)
    counts += 0.1
    return LanguageModel(languages, np.log(counts / counts.sum(0)).astype(np.float32), allowed)


def decode(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best sequence of languages for each text; all texts advance together, the longest alone at the end."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(scores)
    if not len(lengths) or not lengths[0]:
        return out
    width = scores[order[0]].shape[1]
    flat, begins = np.concatenate([scores[i] for i in order]), np.concatenate([[0], np.cumsum(lengths)[:-1]])
    came = np.zeros(flat.shape, np.uint8)  # 1 + the language left, 0: stayed
    path = np.zeros(len(flat), np.uint8)
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # texts that have a word t
    best = flat[begins[: active[0]]].copy()
    ended = np.zeros(len(order), np.uint8)
    for t in range(1, lengths[0]):
        n = active[t]
        if n < len(best):
            ended[n : len(best)] = best[n:].argmax(1)
            best = best[:n]
        at = begins[:n] + t
        top = best.argmax(1)
        switched = best[np.arange(n), top] - penalty
        moves = switched[:, None] > best
        if moves.any():
            came[at] = np.where(moves, top[:, None] + 1, 0)
            best = np.maximum(best, switched[:, None])
        best = best + flat[at]
    ended[: len(best)] = best.argmax(1)
    state = ended.copy()
    for t in range(lengths[0] - 1, -1, -1):
        n = active[t]
        at = begins[:n] + t
        path[at] = state[:n]
        if t:
            left = came[at, state[:n]]
            state[:n] = np.where(left, left - 1, state[:n])
    assert width == flat.shape[1]
    for k, i in enumerate(order):
        out[i] = path[begins[k] : begins[k] + lengths[k]]
    return out


def identify(docs: DataFrame, model: LanguageModel, *, penalty: float = 6.0, with_spans: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Label every whole text: doc_id, lang_pred, score and (with_spans) spans: array of (lang, first word, end word).

    score is the share of letters in spans of lang_pred.  Null texts and texts without a letter are `und` with score 0
    and no spans; so is every text if the model knows no language.  Of equal languages the first in order of name wins.
    Repeated rows give repeated results, an empty table an empty one; other columns (lang, source) are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())] + ([("spans", pa.list_(span))] if with_spans else []))

    def make():
        own = held.value
        known: dict[str, int] = {}
        table = np.zeros((0, len(own.languages)), np.float32)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal known, table
            texts = batch.column(1).to_pylist()
            words = [WORDS.findall(x.lower()) for x in texts]
            fresh = list(set().union(*words).difference(known))
            if len(known) + len(fresh) > KEEP_WORDS:
                known, table = {}, table[:0]
                fresh = list(set().union(*words))
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            table = np.concatenate([table, own.word_scores(fresh)])
            at = [np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)) for ws in words]
            labels, scores, spans = [], [], []
            for text, ws, path in zip(texts, words, decode([table[a] for a in at], penalty) if own.languages else [np.zeros(0, np.uint8)] * len(at), strict=True):
                if not len(path) or not (any(map(str.isalpha, ws)) or any(map(str.isalpha, text))):
                    labels.append("und")
                    scores.append(0.0)
                    spans.append([])
                    continue
                letters = np.bincount(path, np.fromiter(map(len, ws), np.int64, len(ws)), len(own.languages))
                top = int(letters.argmax())
                labels.append(own.languages[top])
                scores.append(float(letters[top] / letters.sum()))
                if with_spans:
                    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                    spans.append([{"lang": own.languages[path[a]], "start": a, "end": b} for a, b in zip(cuts, cuts[1:])])
            return batch_of(schema, batch.column(0), labels, scores, *([spans] if with_spans else []))

        return step

    return map_arrow(doc_columns(docs, id_col=id_col, text_col=text_col), make, "doc_id long, lang_pred string, score double" + (", spans array<struct<lang:string,start:int,end:int>>" if with_spans else ""))
