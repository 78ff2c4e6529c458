"""Personal data: exact base patterns, and spans that a character-level tagger adds.

The tagger (see tagger.py) reads overlapping windows.  Each kind of personal data holds a digit, an @ or a bracketed
"at"; windows without any of these can hold no span and aren't read.  Spans of all windows of a text are reconciled
over the whole text: of all sets of spans that don't overlap, the one of the greatest total weight stays.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.shared import batch_of, doc_columns, map_arrow
from loomspan.llm.tagger import Tagger, symbols

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 128, 64
TRIGGER = re.compile(r"[0-9@]|[\[(]\s?at\s?[\])]", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_LONG_RUN = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start; linear in the text.

    An e-mail address is sought from its @ outwards, which finds what a scan from the left would without trying each
    letter of each word.
    """
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _HOST.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def plausible(kind: int, text: str) -> bool:
    """The exact check of what the tagger proposes; forms are wider than the base patterns'."""
    digits = _digits(text)
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+\s?(?:@|[\[(]\s?at\s?[\])])\s?[\w-]+(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[\w-]+)+", text, re.I))
    if kind == 1:
        parts = re.split(r"\[\.\]|\(\.\)|\.", text)
        return len(parts) == 4 and all(re.fullmatch(r"[0-9]{1,3}", x) and int(x) <= 255 for x in parts)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9](?:[\x20._/-]{0,2}[0-9])+", text)) and 13 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"\+?\(?[0-9][\x20()./0-9-]+[0-9]", text)) and 9 <= len(digits) <= 15 and (text[0] in "+(" or len(re.findall(r"[\x20./-]+|\)\x20?", text)) >= 2)


class Spans:
    """Made-up personal data, and look-alikes that are none, for training."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self, a: int = 2, b: int = 9) -> str:
        return "".join(self.r.choice("abcdefghijklmnoprstuvwz") for _ in range(self.r.randint(a, b)))

    def number(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def card(self) -> str:
        n = self.r.choice((15, 16, 16, 16, 19))
        body = self.r.choice("3456") + self.number(n - 2)
        digits = next(body + d for d in "0123456789" if luhn(body + d))
        sep = self.r.choice(("", "", " ", "-", ".", "/"))
        return sep.join(digits[i : i + 4] for i in range(0, n, 4))

    def of(self, kind: int) -> str:
        r = self.r
        if kind == 0:
            local = self.word() + r.choice(("", "." + self.word(), "." + self.number(2), "_" + self.word(), self.number(2)))
            host = [self.word(3, 8) + r.choice(("", self.number(1))), r.choice(("", self.word(3, 8))), r.choice(("com", "org", "net", "de", "fr", "es", "io", "co.uk"))]
            at, dot = r.choice((("@", "."), ("@", "."), ("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("[at]", "."), (" @ ", ".")))
            return local + at + dot.join(x for x in host if x)
        if kind == 1:
            return r.choice((".", ".", ".", "[.]", "(.)")).join(str(r.randint(0, 255)) for _ in range(4))
        if kind == 2:
            return self.card()
        a, b, c = self.number(3), self.number(3), self.number(4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"+{self.number(2)} {a} {b} {c}", f"+{self.number(11)}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{self.number(2)}.{a}.{b}.{c}"))

    def other(self) -> str:
        r, n = self.r, self.number
        return r.choice((n(4), n(1), f"{n(1)}.{n(1)}.{n(2)}", f"{n(2)}:{n(2)}", f"20{n(2)}-{n(2)}-{n(2)}", f"${n(2)},{n(3)}.{n(2)}", f"{n(3)}%", f"no. {n(5)}", n(10), n(8), f"{n(1)}.{n(4)}", f"@{self.word()}", "".join(r.choice("0123456789abcdef") for _ in range(40)), f"v{n(1)}.{n(2)}", f"{n(3)} {n(3)}", f"{self.word()}{n(2)}", f"({n(4)})", f"+{n(1)}", f"isbn 978-{n(1)}-{n(4)}-{n(4)}-{n(1)}"))


def training_windows(backgrounds: list[str], real: list[tuple[str, list[tuple[int, int, int]]]], *, size: int = 2600, length: int = 96, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows: real ones with their base spans, and spans and look-alikes set into background text or beside each other.

    A real window whose other characters hold a long run of digits may lack a label and isn't used.
    """
    made = Spans(seed)
    xs, ys = [], []

    def add(text: str, spans: list[tuple[int, int, int]]) -> None:
        x, y = np.zeros(length, np.int64), np.zeros(length, np.int64)
        codes = symbols(np.frombuffer(text[:length].encode("utf-32-le"), np.uint32))
        x[: len(codes)] = codes
        for kind, s, e in spans:
            if 0 <= s < e <= length:
                y[s] = 1 + 2 * kind
                y[s + 1 : e] = 2 + 2 * kind
        xs.append(x)
        ys.append(y)

    backgrounds = backgrounds or ["the of and to in a is that it for"]
    outside = lambda text, spans: "".join("\n" if any(s <= i < e for _, s, e in spans) else c for i, c in enumerate(text))
    for text, spans in [x for x in real if not _LONG_RUN.search(outside(*x))][: size // 4]:
        add(text, spans)
    while len(xs) < size:
        ground = made.r.choice(backgrounds)
        cut = made.r.randint(0, max(0, len(ground) - 60))
        text, spans = ground[cut : cut + made.r.randint(0, 40)], []
        beside = False
        for _ in range(made.r.choice((1, 1, 2, 3))):
            kind = made.r.randint(0, 5)
            piece = made.of(kind) if kind < 4 else made.other()
            text += made.r.choice((" ", " ", "\n", ": ", "(", '"', ", ")) if text and not beside else ""
            if kind < 4 and len(text) + len(piece) <= length:
                spans.append((kind, len(text), len(text) + len(piece)))
            elif kind < 4:
                break
            if beside := made.r.random() < 0.4:  # the next one follows after a blank, which the base patterns take for part of it
                text += piece + " "
                continue
            text += piece + made.r.choice((" ", ".", ", ", "\n", "!! ", ") ", ""))
            text = text + (" " if text[-1:].isalnum() else "") + made.r.choice(backgrounds)[: made.r.randint(0, 30)]
        add(text, spans)
    return np.array(xs), np.array(ys)


def fit(docs: DataFrame, *, max_docs: int = 3000, max_windows: int = 600, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """Train on windows of at most about max_docs documents, chosen by a hash of id and text, and on made-up spans set into them.

    Each base span of a chosen document gives a window, a document without any gives one at a place that a hash of its
    text picks.  The driver receives at most max_windows windows of each kind (with base spans, without), those of the
    least hashes.
    """
    rows = doc_columns(docs, id_col=id_col, text_col=text_col)
    n = rows.count()
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit(min(1.0, max_docs / max(1, n)) * (1 << 30)))
    schema = pa.schema([("text", pa.string()), ("spans", pa.list_(pa.int32())), ("real", pa.bool_())])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [[], [], []]
            for text in batch.column(1).to_pylist():
                found = base_spans(text)
                for _, s, _ in found:
                    a = max(0, s - 30)
                    out[0].append(text[a : a + 96])
                    out[1].append([v for k, b, z in found if a <= b and z <= a + 96 for v in (k, b - a, z - a)])
                    out[2].append(True)
                if not found and len(text) > 100:
                    a = zlib.crc32(text.encode()) % (len(text) - 99)
                    out[0].append(text[a : a + 100])
                    out[1].append([])
                    out[2].append(False)
            return batch_of(schema, *out)

        return step

    windows = map_arrow(chosen, make, "text string, spans array<int>, real boolean").distinct()
    real, ground = (windows.filter(F.col("real") == r).orderBy(F.xxhash64("text"), "text").limit(max_windows).collect() for r in (True, False))
    labelled = [(r.text, [tuple(r.spans[i : i + 3]) for i in range(0, len(r.spans), 3)]) for r in real]
    tagger = Tagger(len(KINDS))
    tagger.fit(*training_windows([r.text for r in ground if not TRIGGER.search(r.text)], labelled), epochs=18)
    return tagger


def reconcile(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Of spans (kind, start, end, sureness) from all windows of a text, the set without overlaps of the greatest total weight (sureness x length)."""
    merged: dict[tuple[int, int, int], float] = {}
    for k, s, e, p in found:
        merged[k, s, e] = max(p, merged.get((k, s, e), 0))
    order = sorted(merged, key=lambda x: (x[2], x[1], x[0]))
    ends = np.array([x[2] for x in order])
    best: list[float] = [0.0]
    taken: list[int] = []
    for i, (k, s, e) in enumerate(order):
        before = int(np.searchsorted(ends[:i], s, side="right"))
        weight = best[before] + merged[k, s, e] * (e - s)
        taken.append(before if weight > best[-1] else -1)
        best.append(max(weight, best[-1]))
    out, i = [], len(order)
    while i:
        if taken[i - 1] >= 0:
            out.append(order[i - 1])
            i = taken[i - 1]
        else:
            i -= 1
    return sorted(out)


def window_starts(text: str) -> list[int]:
    """Starts of the windows to read: each trigger lies in two windows, so that any span of up to STRIDE characters around it is whole in one."""
    found = set()
    for m in TRIGGER.finditer(text):
        found |= {m.start() // STRIDE, m.start() // STRIDE - 1}
    return [w * STRIDE for w in sorted(found) if w >= 0]


def added_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]], *, sure: float = 0.3, batch: int = 1024) -> list[list[tuple[int, int, int]]]:
    """Spans that the tagger adds to the base ones of each text: sure enough, plausible, and clear of base spans."""
    places = [(i, s) for i, t in enumerate(texts) for s in window_starts(t)]
    proposed: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    for at in range(0, len(places), batch):
        part = places[at : at + batch]
        x = np.zeros((len(part), WINDOW), np.int64)
        for row, (i, s) in zip(x, part, strict=True):
            codes = symbols(np.frombuffer(texts[i][s : s + WINDOW].encode("utf-32-le"), np.uint32))
            row[: len(codes)] = codes
        for (i, s), spans in zip(part, tagger.decode(x), strict=True):
            for kind, a, e, p in spans:
                whole = (a > 0 or s == 0) and (s + e < s + WINDOW or s + WINDOW >= len(texts[i]))
                if whole and p >= sure and plausible(kind, texts[i][s + a : s + e]):
                    proposed[i].append((kind, s + a, s + e, p))
    out = []
    for spans, own in zip(proposed, base, strict=True):
        own = sorted(own, key=lambda x: x[1])
        out.append([x for x in reconcile(spans) if not any(s < x[2] and x[1] < e for _, s, e in own)] if spans else [])
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_personal_data(docs: DataFrame, tagger: Tagger, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every whole text: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, base, added, spans.

    The counts, base and base_sha256 cover the base patterns; added are the tagger's spans (kind:start:end, code
    points, end exclusive), spans both, by kind and start.  Null and empty texts have none.  Repeated rows give
    repeated results, an empty table an empty one; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(tagger)
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("base", pa.string()), ("added", pa.string()), ("spans", pa.string())])

    def make():
        own = held.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            more = added_spans(own, texts, base)
            shown = list(map(joined, base))
            counts = [[sum(s[0] == k for s in spans) for spans in base] for k in range(len(KINDS))]
            return batch_of(schema, batch.column(0), *counts, [hashlib.sha256(s.encode()).hexdigest() for s in shown], shown, list(map(joined, more)), [joined(a + b) for a, b in zip(base, more, strict=True)])

        return step

    return map_arrow(doc_columns(docs, id_col=id_col, text_col=text_col), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, added string, spans string")
