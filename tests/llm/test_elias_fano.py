import numpy as np
import pytest

from tessera.llm import elias_fano
from tessera.llm.elias_fano import EliasFano


def level(contexts, words, sizes, seed):
    g = np.random.default_rng(seed)
    pairs = [(c, w) for c, n in enumerate(sizes) for w in sorted(g.choice(words, min(words, n), replace=False).tolist())]
    context, word = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.uint64)
    return EliasFano.load(EliasFano.build(context, word, contexts, words).arrays()), context, word


@pytest.mark.parametrize(("words", "sizes"), [(1, []), (1, [1, 0, 1]), (2, [2]), (1000, [0, 0, 3, 0, 1000, 1, 0]), (10**6, [1, 2, 0, 5] * 200), (10**6, [3] * 40 + [20_000, 0, 1] + [1] * 40 + [9_000, 9_000]), (2**32 - 1, [5, 0, 700])])
def test_ranges_and_successors_equal_plain_search(words, sizes):
    contexts = len(sizes)
    ef, context, word = level(contexts, words, sizes, len(sizes))
    every = np.arange(contexts)
    begin, end = ef.bounds(every)
    assert (begin == np.searchsorted(context, every)).all() and (end == np.searchsorted(context, every, "right")).all()
    assert (ef.word(np.arange(ef.n)) == word).all()
    g = np.random.default_rng(1)
    if not contexts:
        return
    asked = np.concatenate([g.integers(0, contexts, 3000), context])
    want = np.concatenate([g.integers(0, words + 2, 3000).astype(np.uint64), word])
    index, equal = ef.find(begin[asked], end[asked], want)
    for c, w, i, same in zip(asked.tolist(), want.tolist(), index.tolist(), equal.tolist(), strict=True):
        own = word[begin[c] : end[c]]
        at = int(np.searchsorted(own, w))
        assert i == begin[c] + at and same == (at < len(own) and own[at] == w)


def test_a_level_is_compact_and_skewed_words_are_found():
    ef, _, word = level(5000, 1 << 20, [3] * 5000, 2)
    assert 8 * sum(a.nbytes for a in ef.arrays().values()) <= len(word) * (20 + 4) + 8000
    low = np.arange(3000, dtype=np.uint64)  # all at one end of the range of words
    skewed = EliasFano.build(np.zeros(3000, np.int64), low, 1, 10**9)
    index, equal = skewed.find(np.zeros(3000, np.int64), np.full(3000, 3000), low)
    assert equal.all() and (index == np.arange(3000)).all()


def test_select_and_a_walk_of_many_words_that_selects_once(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 2**64, 500, dtype=np.uint64), np.array([1, 1 << 63, 2**64 - 1], np.uint64)])
    for r in range(64):
        some = x[np.bitwise_count(x) > r]
        want = [[i for i in range(64) if int(w) >> i & 1][r] for w in some]
        assert elias_fano._select(some, np.full(len(some), r)).tolist() == want
    calls, plain = [], elias_fano._select
    monkeypatch.setattr(elias_fano, "_select", lambda x, r: calls.append(len(x)) or plain(x, r))
    context = np.repeat(np.arange(64), rng.integers(0, 90, 64))  # ranges of more than one word of 64 bits
    level = elias_fano.EliasFano.build(context, np.arange(len(context)), 64, len(context))
    begin = np.searchsorted(context, np.arange(64))
    found = level._zero(np.arange(64))
    assert found.tolist() == (np.append(begin[1:], len(context)) + np.arange(64)).tolist() and calls == [64]
