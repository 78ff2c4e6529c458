"""BPE encoding and decoding by prefix-sharing trie traversal.

The sorted distinct words of a slice of rows form a trie: neighbours share their longest common prefix.  It is walked
depth first.  At each prefix one state is kept, the *last token* of that prefix's encoding; the encoding itself is
found by stepping back from last token to last token.  The state of a longer prefix follows from those of the shorter
ones, so that encodings of shared prefixes are computed once.

Why one token is enough: a sequence of tokens is an encoding exactly if each pair of neighbours is (no merge crosses
their border when the two are encoded together).  So the last token of a prefix is the one suffix token t whose
predecessor, the last token of the prefix without t, may stand before t.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomspan.llm.shared import batch_of, doc_columns, map_arrow

#: Words longer than this, and words beyond this many, are not kept from slice to slice.
KEEP_CHARS, KEEP_WORDS = 48, 250_000
_END = "</w>"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in for each byte in byte-level vocabularies: itself if visible Latin-1, else from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return {b: chr(b) if b in visible else chr(next(hidden)) for b in range(256)}


class WordBpe:
    """A word-level BPE vocabulary whose last symbol of a word carries the mark </w>."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.texts: dict[int, str] = {i: t for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.texts |= {i: t for t, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.bytes = byte_alphabet()
        # a token's two parts and the order in which merges apply
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for n, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            made = vocab[a + b]
            self.rank.setdefault((vocab[a], vocab[b]), n)
            if made not in self.parts:
                self.parts[made], self.born[made] = (vocab[a], vocab[b]), n
        # suffix lookups: plain symbols, and with the mark on the last symbol
        self.plain: dict[str, int] = {}
        self.ending: dict[str, int] = {}
        for t, i in vocab.items():
            if not self._whole(i, t):
                continue
            if t.endswith(_END) and len(t) > len(_END):
                self.ending[t[: -len(_END)]] = i
            else:
                self.plain[t] = i
        self.plain_tails = {t[k:] for t in self.plain for k in range(len(t))}
        self.ending_tails = {t[k:] for t in self.ending for k in range(len(t))}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _whole(self, i: int, text: str) -> bool:
        """Whether the token is a base symbol or the join of its parts by a border that no earlier merge crosses."""
        if i not in self.parts:
            return len(text.removesuffix(_END) or text) == 1
        a, b = self.parts[i]
        return not self._crosses(a, b, self.born[i])

    def _spine(self, i: int, side: int) -> Iterator[tuple[int, float]]:
        """Tokens that stand at the border while i is being built, and the rank at which each is merged away."""
        until = float("inf")
        while True:
            yield i, until
            if i not in self.parts:
                return
            until = self.born[i]
            i = self.parts[i][side]

    def _crosses(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether some merge joins a token ending at the border with one starting there.  Of equal merges the left one goes first."""
        for a, a_until in self._spine(left, 1):
            for b, b_until in self._spine(right, 0):
                r = self.rank.get((a, b))
                if r is not None and r < a_until and r <= b_until and r < before:
                    return True
        return False

    def may_follow(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[key] = not self._crosses(left, right)
        return known

    def _last(self, symbols: str, i: int, last: list[tuple[int, int]], table: dict[str, int], tails: set[str]) -> tuple[int, int]:
        """(last token, its length) of the prefix of i symbols, from the states of the shorter prefixes."""
        fits = []
        for k in range(1, i + 1):
            tail = symbols[i - k : i]
            if tail not in tails:
                break
            if (t := table.get(tail)) is not None:
                fits.append((t, k))
        for t, k in reversed(fits):
            if k == i or self.may_follow(last[i - k][0], t):
                return t, k
        raise ValueError(f"no encoding for {symbols[:i]!r}")

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """The token ids of each word; one depth-first walk over the trie of all."""
        spelled = sorted(("".join(map(self.bytes.__getitem__, w.encode())), w) for w in words)
        out: dict[str, list[int]] = {}
        last: list[tuple[int, int]] = [(-1, 0)]  # states of the prefixes on the current path
        path = ""
        for symbols, word in spelled:
            shared, most = 0, min(len(path), len(symbols) - 1, len(last) - 1)
            while shared < most and path[shared] == symbols[shared]:
                shared += 1
            del last[shared + 1 :]
            for i in range(shared + 1, len(symbols)):
                last.append(self._last(symbols, i, last, self.plain, self.plain_tails))
            path = symbols
            token, k = self._last(symbols, len(symbols), last, self.ending, self.ending_tails)
            ids, i = [token], len(symbols) - k
            while i:
                token, k = last[i]
                ids.append(token)
                i -= k
            ids.reverse()
            out[word] = ids
        return out

    def split(self, text: str) -> list[str]:
        """The words of a text: NFC, lower case letter by letter, then the vocabulary's own pattern."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # str.lower() knows a final sigma, letter-wise lowering does not
                text = text.replace("Σ", "σ")
        text = text.lower()
        if not text.isascii() and _NEW_CAPITALS.search(text):
            text = text.translate(_NEW_LOWER)
        if not text.isascii() and _FAR.search(text) and (odd := unassigned()).search(text):
            return [text[m.start() : m.end()] for m in self.words.finditer(odd.sub("\u0378", text))]
        return self.words.findall(text)

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """The text cut at the strings of special tokens: (is one, string)."""
        if self.special_split and "<" in text:
            for n, part in enumerate(self.special_split.split(text)):
                if part:
                    yield bool(n % 2), part
        elif text:
            yield False, text

    def decode(self, ids: list[int]) -> str:
        """The token strings joined by spaces: the vocabulary file names no decoder."""
        return " ".join(map(self.texts.__getitem__, ids))


#: Beyond the letters of Latin, Greek, Cyrillic and Armenian; below, all tables of Unicode agree.
_FAR = re.compile("[^\0-\u0557]")

# Letters and numbers that Unicode 16.0 added, which the tokenizers library knows and Python 3.13 doesn't.
_UNICODE_16 = regex.compile(
    "[\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d40-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4"
    "\U00011380-\U000113d3\U000116d0-\U000116e3\U00011bc0-\U00011bf9\U00013460-\U000143fa\U00016100-\U0001611d\U00016130-\U00016139"
    "\U00016d40-\U00016d79\U00018cff\U0001ccf0-\U0001ccf9\U0001e5d0-\U0001e5fa]"
)

# Capitals that Unicode 16.0 and 17.0 added, which the tokenizers library lowers and Python 3.13 doesn't.
_NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_NEW_CAPITALS = re.compile("[" + "".join(map(chr, sorted(_NEW_LOWER))) + "]")


@lru_cache(maxsize=1)
def unassigned() -> regex.Pattern:
    """Code points that newer tables of Unicode call letters or numbers, and the tokenizers library doesn't."""
    letters = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000)))))
    return regex.compile("[" + "".join(c for c in letters if unicodedata.category(c) == "Cn" and not _UNICODE_16.match(c)) + "\U000F0000]")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


class TextEncoder:
    """Encodes slices of texts; keeps the encodings of short words from slice to slice, within bounds."""

    def __init__(self, path: str):
        self.bpe = vocabulary(path)
        self.known: dict[str, tuple[bytes, str]] = {}

    def __call__(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers, and the decoded text."""
        split = [[(mark, part if mark else self.bpe.split(part)) for mark, part in self.bpe.segments(x)] for x in texts]
        fresh = {w for parts in split for mark, words in parts if not mark for w in words if w not in self.known}
        coded = {w: (b"".join(i.to_bytes(4, "little") for i in ids), self.bpe.decode(ids)) for w, ids in self.bpe.encode_words(fresh).items()}
        if len(self.known) + len(coded) > KEEP_WORDS:
            used = {w for parts in split for mark, words in parts if not mark for w in words}
            self.known = {w: v for w, v in self.known.items() if w in used}
        self.known |= coded
        get = self.known.__getitem__
        for parts in split:
            ids, decoded = [], []
            for mark, words in parts:
                if mark:
                    ids.append(self.bpe.special[words].to_bytes(4, "little"))
                    decoded.append(words)
                elif words:
                    one, two = zip(*map(get, words), strict=True)
                    ids.extend(one)
                    decoded.extend(two)
            yield b"".join(ids), " ".join(decoded)
        if len(self.known) > KEEP_WORDS:
            self.known = {}
        else:
            for w in fresh:
                if len(w) > KEEP_CHARS:
                    self.known.pop(w, None)


def lists(lengths: list[int], raw: list[bytes]) -> pa.ListArray:
    """Packed ids of each row as an Arrow list array."""
    ends = np.cumsum([0, *lengths], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), np.int32)))


def encode(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again: doc_id, n_tokens, ids (array<int>, if with_ids), ids_sha256, decoded_sha256.

    Null and empty texts have no tokens (digests of nothing).  Rows are independent: repeated rows give repeated
    results, an empty table an empty one, other columns are ignored.  Memory: the words of one slice of about 1.5 million characters of
    text, or of one text if that is longer, and the bounded store of known words.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def make():
        encoder = TextEncoder(vocab_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids_sha, decoded_sha, ids = [], [], [], []
            for raw, decoded in encoder(batch.column(1).to_pylist()):
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    ids.append(raw)
            return batch_of(schema, batch.column(0), n, ids_sha, decoded_sha, *([lists(n, ids)] if with_ids else []))

        return step

    return map_arrow(doc_columns(docs, id_col=id_col, text_col=text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))
