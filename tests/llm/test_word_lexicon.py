"""Lexicon BPE against the tokenizers library."""

import random

import numpy as np
import pytest

from rankloom.llm import word_lexicon as wl
from tests.llm.helpers import awkward, documents, nothing


@pytest.fixture(scope="module")
def vocab():
    return wl.vocabulary(None)


def library(vocab, texts):
    found = vocab.library.encode_batch(texts, add_special_tokens=False)
    return [(len(e.ids), " ".join(map(str, e.ids)), vocab.library.decode(e.ids, skip_special_tokens=False))
            for e in found]


def test_documents_equal_library(spark, sf_dir, vocab):
    for docs in (documents(spark, sf_dir), awkward(spark)):
        raw = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        want = [(d, *x) for (d, _), x in zip(raw, library(vocab, [t for _, t in raw]), strict=True)]
        got = wl.encode_documents(docs, words=3000).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert wl.encoding_digests(nothing(spark)).count() == 0


def test_any_text_equals_library(vocab):
    rng = random.Random(2)
    lexicon = wl.Lexicon(wl.compile_lexicon([b"the", b"then", b"other", b"an"], vocab))
    texts = [chr(c) + "a" + chr(c) + chr(c) + " B" + chr(c) for c in [*range(0x180), *range(0x300, 0x310), 0x3a3, 0x130]]
    pool = "aB' sSt1²½ÀÿĿ́  \n#<|>é漢字😀ΣςİſK"
    texts += ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(500)]
    texts += ["a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext|>", "<|EndOfText|> <|x", "it's DON'T we'LL 'sx",
              "ab" * 3000, "a" * 2001, "thethe" * 30 + "Z"]
    assert list(wl.encode_texts(texts, lexicon, vocab)) == library(vocab, texts)


def test_automaton_is_minimal_and_exact(vocab):
    words = sorted({b"%s%s" % (a, b) for a in (b"work", b"walk", b"talk", b"play") for b in (b"", b"s", b"ed", b"ing")})
    lexicon = wl.Lexicon(wl.compile_lexicon(words, vocab))
    assert lexicon.find(words).tolist() == list(range(len(words)))
    assert lexicon.find([b"wor", b"works!", b"", b"x", b"playe", b"talkeds"]).tolist() == [-1] * 6
    # one state per different rest of a word
    rests = {frozenset(w[k:] for w in words if w.startswith(p[:k])) for p in words for k in range(len(p) + 1)}
    assert len(lexicon.final) == len(rests)
    for word, n in zip(words, lexicon.find(words), strict=True):
        ids = lexicon.ids[lexicon.starts[n]:lexicon.starts[n + 1]]
        assert (ids == wl.merge_words([word], vocab)[0]).all()
    empty = wl.Lexicon(wl.compile_lexicon([], vocab))
    assert empty.find([b"a", b""]).tolist() == [-1, -1]


def test_long_and_short_merges_agree(vocab):
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 45))).encode() for _ in range(300)]
    for word, ids in zip(words, wl.merge_words(words, vocab), strict=True):
        assert np.array_equal(ids, wl._merge_long(word, vocab))


def test_frequent_words_are_bounded_and_the_most_frequent(spark):
    rows = [(i, " ".join(f"w{chr(97 + k)}" for k in range(26) if i < 2 ** (k % 7))) for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    count = {f"w{chr(97 + k)}".encode(): 2 ** (k % 7) for k in range(26)}
    for bound in (0, 2, 5, 9, 100):
        got = wl.frequent_words(docs, bound)
        assert len(got) == len(set(got)) <= bound
        assert all(count[w] > max((count[v] for v in count if v not in got), default=0) for w in got)
    assert wl.frequent_words(docs.where("false")) == []
