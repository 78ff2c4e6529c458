import hashlib
import math
import random

import public_tokenizers
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomspan.llm import bpe, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(WORDS)


def library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def same(texts):
    for text, (raw, decoded) in zip(texts, bpe.TextEncoder(WORDS)(texts), strict=True):
        ids = [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]
        assert (ids, decoded) == library(text), text


def test_bpe_as_the_library_does():
    same(["", "  ", "I've don't ΣΑΣ İ", "<|startoftext|>Hi<|endoftext|>", "a" * 3000, "日本語 テスト 😀😀", "é é ﬁ", "1²Ⅷ", "'s'll", "\x00\x01", "՘б"])
    r = random.Random(4)
    same(["".join(r.choice("abcdeghilnorstuy'. !éß") for _ in range(200)) for _ in range(100)])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x4FFF, exclude_categories=("Cs", "Cn")), max_size=60))
def test_bpe_on_any_text(text):
    same([text])


def test_new_capitals_and_letters():
    """Every code point of the blocks in which tables of Unicode differ."""
    blocks = [(0x1C80, 0x1C90), (0xA7C0, 0xA7E0), (0x10D40, 0x10D90), (0x16EA0, 0x16EE0), (0x105C0, 0x10600), (0x1E5D0, 0x1E600)]
    same([pattern % chr(c) for a, z in blocks for c in range(a, z) for pattern in ("a%sb", "%s")])


def test_encode_rows(odd, none):
    rows = bpe.encode(odd, WORDS).collect()
    assert len(rows) == odd.count() and bpe.encode(none, WORDS).count() == 0
    for r in odd.join(bpe.encode(odd, WORDS).dropDuplicates(["doc_id"]), "doc_id").select("text", "ids", "n_tokens", "ids_sha256", "decoded_sha256").collect():
        ids, decoded = library(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


def viterbi(trie, word):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for i in range(1, len(word) + 1):
        best[i] = max((best[j][0] + trie.score[word[j:i]], best[j][1] - 1) for j in range(i) if word[j:i] in trie.score)
    return -best[-1][1]


def test_counts_against_each_word_alone():
    trie = token_counts.vocabulary(RANKS)
    r = random.Random(1)
    words = {"".join(r.choice("abehlnorst éx") for _ in range(r.randint(1, 14))).encode() for _ in range(400)} | {b"\xff\xfe", b"a" * 300}
    assert trie.counts(words) == {w: viterbi(trie, w) for w in words}


def test_count_rows(odd, none):
    trie = token_counts.vocabulary(RANKS)
    got = {(r.doc_id, r.n_chars): (r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(odd, RANKS).collect()}
    for r in odd.collect():
        words = regex.findall(token_counts.PATTERN, r.text or "")
        counts = trie.counts({w.encode() for w in words})
        assert got[r.doc_id, len(r.text or "")] == (len(words), sum(counts[w.encode()] for w in words))
    assert token_counts.token_counts(none, RANKS).count() == 0 and token_counts.token_counts(odd, RANKS).count() == odd.count()
