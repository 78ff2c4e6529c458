"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of a slice of rows form a trie (sorted, neighbours share their longest common prefix).  It is
walked depth first; each prefix gets its unigram forward score once: the best sum of token scores over all ways to cut
that prefix into tokens of the vocabulary.  The number of tokens on the best way is stored where a pre-token ends.
"""

from __future__ import annotations

import base64
import math
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomspan.llm.shared import batch_of, doc_columns, map_arrow

#: Pre-tokens longer than this, and pre-tokens beyond this many, are not kept from slice to slice.
KEEP_BYTES, KEEP_WORDS = 48, 400_000
#: How the rank files split text before their tokens apply (fixed value of that format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class UnigramTrie:
    """Unigram scores of a rank file: by Zipf's law the token of rank r has probability in proportion to 1 / (r + 1)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        norm = math.log(math.fsum(1 / (r + 1) for r in ranks.values()))
        self.score = {t: -math.log(r + 1) - norm for t, r in ranks.items()}
        self.tails = {t[k:] for t in self.score for k in range(len(t))}
        assert all(bytes([b]) in self.score for b in range(256)), "the vocabulary must hold every byte"

    def counts(self, words: set[bytes]) -> dict[bytes, int]:
        """Tokens on the best segmentation of each pre-token; of equal scores the one with fewer tokens."""
        out: dict[bytes, int] = {}
        forward: list[tuple[float, int]] = [(0.0, 0)]  # (score, -tokens) of each prefix on the current path
        path = b""
        get, tails = self.score.get, self.tails
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del forward[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                best = (-math.inf, 0)
                for j in range(i - 1, -1, -1):
                    tail = word[j:i]
                    if tail not in tails:
                        break
                    if (s := get(tail)) is not None:
                        before = forward[j]
                        here = (before[0] + s, before[1] - 1)
                        if here > best:
                            best = here
                forward.append(best)
            path = word
            out[word] = -forward[-1][1]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> UnigramTrie:
    return UnigramTrie(path)


def token_counts(docs: DataFrame, vocab_path: str, *, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of every whole text: doc_id, n_chars, n_pretokens, n_tokens.

    Null and empty texts count 0.  Rows are independent: repeated rows give repeated results, an empty table an empty
    one, other columns are ignored.  A very long pre-token costs time in proportion to its length.  Memory: the
    pre-tokens of a slice of about 1.5 million characters of text (or one longer text) and a bounded store of known counts.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])

    def make():
        trie, split, known = vocabulary(vocab_path), regex.compile(pattern).findall, {}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal known
            texts = batch.column(1).to_pylist()
            words = [split(x) for x in texts]
            seen = set().union(*words)
            fresh = {w.encode(): w for w in seen if w not in known}
            if len(known) + len(fresh) > KEEP_WORDS:
                known = {w: n for w, n in known.items() if w in seen}
            known.update((fresh[w], n) for w, n in trie.counts(set(fresh)).items())
            counts = [sum(map(known.__getitem__, ws)) for ws in words]
            if len(known) > KEEP_WORDS:
                known = {}
            else:
                for raw, w in fresh.items():
                    if len(raw) > KEEP_BYTES:
                        known.pop(w, None)
            return batch_of(schema, batch.column(0), list(map(len, texts)), list(map(len, words)), counts)

        return step

    return map_arrow(doc_columns(docs, id_col=id_col, text_col=text_col), make, "doc_id long, n_chars long, n_pretokens long, n_tokens long")
