"""Sequence alignment of recognised and true text, over Arrow batches (numpy inside): longest common subsequence, edit alignment, global alignment."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.text import PLACEHOLDER

MODES = ("raw", "faithful", "content")
# Simplified forms and the traditional ones that they are folded to in mode `content`.
CONTENT_PAIRS = (
    "亲親 众衆 体體 银銀 钱錢 时時 议議 价價 约約 证證 转轉 让讓 孙孫 号號 礼禮 铺鋪 头頭 万萬 亩畝 厘釐 庄莊 连連 兑兌 归歸 将將 经經 应應 实實 现現 这這 后後 无無 义義 长長 "
    "发發 兴興 开開 达達 运運 选選 荣榮 许許 国國 龙龍 随隨 广廣 台臺 学學 园園 务務 宝寶 门門 户戶 张張 刘劉 陈陳 黄黃 赵趙"
).split()
_FOLD = str.maketrans({a: b for a, b in CONTENT_PAIRS})


def metric_text(text: str | None, mode: str = "raw", placeholders: str = PLACEHOLDER) -> str:
    """What counts for a mode: no blanks or placeholders; beyond raw no punctuation (NFKC); in content variants are folded."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    source = text or ""
    if mode != "raw":
        source = "".join(c for c in unicodedata.normalize("NFKC", source) if not unicodedata.category(c).startswith("P"))
    kept = "".join(c for c in source if not c.isspace() and c not in placeholders)
    return kept.translate(_FOLD) if mode == "content" else kept


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row at a time: a running maximum replaces the inner loop."""
    x, y = codes(a), codes(b)
    row = np.zeros(len(y) + 1, np.int64)
    for c in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == c)))
    return int(row[-1])


def edits(truth: str, guess: str) -> list[tuple[str, str, str]]:
    """A least edit alignment as (operation, true character, guessed character); from the end, of equal costs a substitution, then an insertion, then a deletion."""
    x, y = codes(truth), codes(guess)
    steps = np.arange(len(y) + 1)
    cost = np.empty((len(x) + 1, len(y) + 1), np.int32)
    cost[0] = steps
    for i, c in enumerate(x):
        row = np.empty(len(y) + 1, np.int64)
        row[0] = i + 1
        row[1:] = np.minimum(cost[i, :-1] + (y != c), cost[i, 1:] + 1)
        cost[i + 1] = np.minimum.accumulate(row - steps) + steps
    out, i, j = [], len(x), len(y)
    while i or j:
        if i and j and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append(("match", truth[i], guess[j]))
        elif i and j and cost[i, j] == cost[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
            out.append(("substitute", truth[i], guess[j]))
        elif j and cost[i, j] == cost[i, j - 1] + 1:
            j -= 1
            out.append(("insert", "", guess[j]))
        else:
            i -= 1
            out.append(("delete", truth[i], ""))
    return out[::-1]


def global_alignment(a: str, b: str, *, match: int = 2, mismatch: int = -1, gap: int = -1) -> list[tuple[str, str]]:
    """Pairs of characters of the best global alignment, an empty text for a gap; of equals a pair, then a gap in b, then in a."""
    x, y = codes(a), codes(b)
    steps = gap * np.arange(len(y) + 1)
    best = np.empty((len(x) + 1, len(y) + 1), np.int64)
    best[0] = steps
    for i, c in enumerate(x):
        row = np.empty(len(y) + 1, np.int64)
        row[0] = gap * (i + 1)
        row[1:] = np.maximum(best[i, :-1] + np.where(y == c, match, mismatch), best[i, 1:] + gap)
        best[i + 1] = np.maximum.accumulate(row - steps) + steps
    out, i, j = [], len(x), len(y)
    while i or j:
        if i and j and best[i, j] == best[i - 1, j - 1] + (match if x[i - 1] == y[j - 1] else mismatch):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and best[i, j] == best[i - 1, j] + gap:
            i -= 1
            out.append((a[i], ""))
        else:
            j -= 1
            out.append(("", b[j]))
    return out[::-1]


def agreed(a: str, b: str) -> str:
    """What both texts agree on; each stretch of disagreement is one placeholder."""
    out = []
    for x, y in global_alignment("".join(a.split()), "".join(b.split())):
        if x == y:
            out.append(x)
        elif out[-1:] != [PLACEHOLDER]:
            out.append(PLACEHOLDER)
    return "".join(out)


def fused(other: str, trusted: str, *, longest: int = 2) -> tuple[str, float]:
    """(text, agreement): the trusted text, with what only the other has where it is short and has trusted neighbours on both sides."""
    if not trusted.strip():
        return "", 0.0
    if not other.strip():
        return trusted, 1.0
    pairs = global_alignment("".join(other.split()), "".join(trusted.split()))
    text: list[str] = []
    counts = dict.fromkeys(("agree", "differ", "trusted", "added"), 0)
    at = 0
    while at < len(pairs):
        x, y = pairs[at]
        if y:
            text.append(y)
            counts["agree" if x == y else "differ" if x else "trusted"] += 1
            at += 1
            continue
        end = at
        while end < len(pairs) and not pairs[end][1]:
            end += 1
        extra = [p[0] for p in pairs[at:end]]
        if len(extra) <= longest and text and end < len(pairs):
            text += extra
            counts["added"] += len(extra)
        at = end
    total = sum(counts.values())
    return "".join(text), counts["agree"] / total if total else 0.0


MEASURES = "gt_len long, pred_len long, output_len long, lcs_len long, edit_distance long, insertions long, substitutions long, deletions long, placeholder_count long"


def char_measures(df: DataFrame, guess: str, truth: str, *, mode: str = "raw") -> DataFrame:
    """Adds the integer measures of each pair of texts; ratios follow from them by with_ratios(), for rows as for sums.

    Cost grows with the product of both lengths; a task holds one such table at a time.
    """
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for g, t in zip(pdf[guess], pdf[truth], strict=True):
                a, b = metric_text(t, mode), metric_text(g, mode)
                shown = "".join((g or "").split())
                found = [op for op, _, _ in edits(a, b) if op != "match"]
                rows.append((len(a), len(b), len(shown), lcs(a, b), len(found), found.count("insert"), found.count("substitute"), found.count("delete"), sum(c in PLACEHOLDER for c in shown)))
            yield pd.concat([pdf, pd.DataFrame(rows, columns=names, index=pdf.index)], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, {MEASURES}")


def with_ratios(df: DataFrame) -> DataFrame:
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    c = F.col
    precision, recall = share(c("lcs_len"), c("pred_len")), share(c("lcs_len"), c("gt_len"))
    ratios: dict[str, Column] = {
        "precision": precision,
        "recall": recall,
        "f1": 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-10)),
        "cer": share(c("edit_distance"), c("gt_len")),
        "hallucination_rate": share(c("insertions"), c("pred_len")),
        "fabricated_rate": share(c("insertions") + c("substitutions"), c("pred_len")),
        "placeholder_rate": share(c("placeholder_count"), c("output_len")),
    }
    return df.withColumns({k: F.round(v, 4) for k, v in ratios.items()})


def micro_average(measured: DataFrame) -> DataFrame:
    """Ratios of the sums of all rows: partial sums before the shuffle."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    return with_ratios(measured.agg(F.count("*").alias("processed"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]))


def confusions(df: DataFrame, guess: str, truth: str, *, mode: str = "raw") -> DataFrame:
    """Substituted characters (true, guessed) and how often, over all pairs of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(a, b) for g, t in zip(pdf[guess], pdf[truth], strict=True) for op, a, b in edits(metric_text(t, mode), metric_text(g, mode)) if op == "substitute"]
            yield pd.DataFrame(rows, columns=["truth", "guess"])

    return df.select(guess, truth).mapInPandas(run, "truth string, guess string").groupBy("truth", "guess").agg(F.count("*").alias("n"))
