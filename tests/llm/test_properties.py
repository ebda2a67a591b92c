"""Properties of the kernels on random input."""

import brute
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tempolake.llm import bpe, jaccard, substring
from tempolake.llm import textkernel as K

TEXT = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\x0b\x0c\r\x1c\x85\xa0abAB")), max_size=80)


@pytest.fixture(scope="module")
def coders():
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.Encoder(bpe.Merges(ranks), P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, max_size=6))
def test_bpe_equals_the_library(coders, texts):
    mine, theirs = coders
    ids = mine.encode(texts)
    assert [x.tolist() for x in ids] == [theirs.encode_ordinary(t) for t in texts]
    assert [mine.decode(x) for x in ids] == [t.encode() for t in texts]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, max_size=8))
def test_words(texts):
    found, hashes = [], {}
    for b in K.blocks(pa.array(texts, pa.large_string())):
        h = b.word_hashes(lower=True)
        for i in range(b.n):
            span = range(b.first[i], b.first[i + 1])
            found.append([bytes(b.data[b.start[j] : b.end[j]]).decode() for j in span])
            for w, j in zip(found[-1], span, strict=True):
                assert hashes.setdefault(brute.line_key(w), h[j]) == h[j]
    assert found == [brute.words(t) for t in texts]
    assert len(set(hashes.values())) == len(hashes)


@settings(max_examples=200, deadline=None)
@given(words=st.lists(st.sampled_from("abcd"), max_size=40), n=st.integers(1, 9))
def test_shingles_tell_sequences_apart(words, n):
    text = pa.array([" ".join(words)], pa.large_string())
    (block,) = K.blocks(text)
    runs = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    h = K.shingles(block.word_hashes(), n).tolist()
    assert len(h) == len(runs) and len(set(h)) == len(set(runs)) == len(set(zip(h, runs, strict=True)))
    (s,) = jaccard.sets_of(text, n)
    assert len(s) == len(brute.shingle_set(" ".join(words), n))


@settings(max_examples=200, deadline=None)
@given(words=st.lists(st.sampled_from("ab"), max_size=60), seed=st.integers(1, 6), extra=st.integers(0, 6))
def test_every_window_has_one_anchor(words, seed, extra):
    length = seed + extra
    for block in K.blocks(pa.array(["x y", " ".join(words)], pa.large_string())):
        d, anchor, span, first, last = substring.anchors(block, length, seed)
        covered = sorted(x for i, a, b in zip(d.tolist(), first.tolist(), last.tolist(), strict=True) if i == 1 for x in range(a, b + 1))
        assert covered == list(range(max(0, len(words) - length + 1)))


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 10**6), num=st.sampled_from([50, 80, 90]))
def test_links_connect_what_brute_force_connects(seed, num):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 60, 30)
    sets = []
    for _ in range(25):
        s = base.copy()
        s[rng.integers(0, 30, rng.integers(0, 9))] = rng.integers(0, 60, 1)
        sets.append(np.unique(s[: rng.integers(1, 31)]).astype(np.uint64))
    parent = list(range(len(sets)))
    for a, b in jaccard.link(sets, num, 100):
        assert 100 * len(np.intersect1d(sets[a], sets[b])) >= num * len(np.union1d(sets[a], sets[b]))
        x, y = sorted((parent[a], parent[b]))
        parent = [x if p == y else p for p in parent]
    same = brute.components({i: frozenset(s.tolist()) for i, s in enumerate(sets)}, num, 100)
    assert parent == [same[i] for i in range(len(sets))]
