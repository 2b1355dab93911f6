import random

import numpy as np
import public_tokenizers

from lakeloom.llm import bpe, merging, pieces, token_cuts


def words(n, seed):
    r = random.Random(seed)
    syllables = ["the", "re", "ing", "ñ", "ê", "sch", "ei", "an", "tion", "1", "9", ".", "***", "ü", "日", "\U0001f600", "e", "s", "\t"]
    return {r.choice(["", " "]) + "".join(r.choice(syllables) for _ in range(r.randrange(1, 9))) for _ in range(n)}


def test_words_merged_together_are_as_each_alone(monkeypatch):
    monkeypatch.setattr(merging, "WORDS", 100)
    b = pieces.Pieces(pieces.model_bytes())
    kept, some = pieces.Kept(b), {w.replace(" ", pieces.SPACE) for w in words(2000, 1)} | {"a", "x" * 64, "x" * 65}
    kept.learn(some)
    assert len(kept) > 1000 and "x" * 65 not in kept
    assert all(ids == b.of_stretch(w) for w, ids in kept.items())
    a = bpe.PrefixBPE(token_cuts.byte_tokens(public_tokenizers.path(token_cuts.BYTES)))
    known, plain = token_cuts.Known(a), token_cuts.Known(a)
    known.learn(words(2000, 2))
    assert len(known) > 1000 and all(ids == plain[w] for w, ids in known.items())
    known.learn(set())
    kept.learn({"\t"})


def test_equal_ranks_go_from_the_left():
    one = np.array([1])
    aa = merging.Merges(one, one, np.array([0]), np.array([2]))
    assert aa.merged(np.array([1, 1, 1, 1, 1, 1, 3]), np.array([3, 1, 3])) == [(2, 1), (1,), (2, 3)]
    assert aa.merged(np.array([3]), np.array([1])) == [(3,)]
