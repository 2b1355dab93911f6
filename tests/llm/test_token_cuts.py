import random
from bisect import bisect_left
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import regex
import sentencepiece
from tokenizers import Tokenizer

from lakeloom.llm import pieces, token_cuts

A = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
A_BYTES = token_cuts.byte_tokens(P.path("byte_bpe_50k.json"))
B_BYTES = pieces.Pieces(pieces.model_bytes()).surface


def plain(rows):
    """rows: (doc_id, text). What the query returns, by the libraries and sets of byte offsets."""
    groups_of, counts = [], Counter()
    for d, t in rows:
        a, b = ([], []) if not t else (A.encode(" " + t, add_special_tokens=False).ids, B.encode(t))
        data = (" " + t).encode() if t else b""
        if b"".join(A_BYTES[i] for i in a) != data or b"".join(B_BYTES[i] for i in b) != data:
            a = b = []
        ends = [np.cumsum([len(x[i]) for i in ids]).tolist() for x, ids in ((A_BYTES, a), (B_BYTES, b))]
        shared = sorted(set(ends[0]) & set(ends[1]))
        place, groups = [0, 0], []
        for cut in shared:
            stop = [bisect_left(e, cut) + 1 for e in ends]
            groups.append((a[place[0] : stop[0]], b[place[1] : stop[1]]))
            place = stop
        counts.update({(x, y) for xs, ys in groups for x in xs for y in ys})
        groups_of.append((d, a, b, groups))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for d, a, b, groups in groups_of:
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), sha256(text.encode()).hexdigest() if a else ""))
    return out


def shown(frame):
    return sorted(map(tuple, frame.collect()), key=lambda r: tuple((x is None, x) for x in r))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


ROWS = [(1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "the cat sat on the mat"), (5, "the cat sat on the mat"), (6, "naïve 日本語 👩‍👩‍👧"), (None, "no id"), (7, "<|endoftext|> </s> <s>"), (8, "    def f(x):\n\t\treturn x  \n\n"), (9, "=" * 700 + "-" * 300), (10, "word " * 3000), (11, "\x00\x1f\x85  x"), (12, "x" * 5000)]


@pytest.mark.parametrize("few,hot", [(1 << 20, 9), (3, 2), (3, 1 << 20)])
def test_odd_rows(spark, monkeypatch, few, hot):
    monkeypatch.setattr(token_cuts, "CELLS", 8)
    monkeypatch.setattr(token_cuts, "BLOCK", 3000)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 row", "'x' a", "2 times", "3 groups")
    out = token_cuts.aligned(docs, few=few, hot=hot)
    assert shown(out) == ordered(plain(ROWS))
    assert token_cuts.aligned(docs.limit(0)).count() == 0 and token_cuts.aligned(docs.where("doc_id < 3")).count() == 2


def test_models_that_change_texts(monkeypatch):
    """Where a model may change a text, the bytes are compared."""
    from tests.llm.test_pieces import remade

    known, split = token_cuts.Known(token_cuts.bpe.PrefixBPE(A_BYTES)), regex.compile(P.PATTERN).findall
    some = ["plain text", "ﬁne", "two  spaces", "a▁b", ""]
    for model, held in ((pieces.model_bytes(), [0, 1, 2]), (remade("nfkc", False), [0, 2]), (remade("nfkc", True), [0])):
        b = pieces.Pieces(model)
        assert b.exact == (len(held) == 3) and token_cuts.tokens_of(known, b, pieces.Kept(b), split, some)[0] == held


def test_groups_are_returned(spark):
    docs = spark.createDataFrame([(1, "unbelievable tokenization")], "doc_id long, text string")
    r = token_cuts.aligned(docs, with_groups=True).first()
    assert sha256(r.groups.encode()).hexdigest() == r.groups_sha256 and r.groups.count(";") == r.n_groups - 1


def test_byte_vocabulary_over_all_characters():
    split, known = regex.compile(P.PATTERN).findall, token_cuts.Known(token_cuts.bpe.PrefixBPE(A_BYTES))
    points = [c for c in [*range(0x3400), *range(0xA000, 0xD7FF, 7), *range(0xE000, 0x20000, 5)] if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 500):
        text = "".join(f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}" for c in points[i : i + 500])
        assert [x for p in split(text) for x in known[p]] == A.encode(text, add_special_tokens=False).ids, i


def test_ranks_of_bitsets():
    r = random.Random(3)
    for size in (1, 63, 64, 65, 1000):
        ends = np.array(sorted(r.sample(range(1, size + 1), max(1, size // 3))))
        words = token_cuts.bitset(ends, size)
        assert (token_cuts.selected(words) == ends - 1).all()
        places = np.arange(size)
        assert (token_cuts.ranks(words, places) == [(ends <= p + 1).sum() for p in places]).all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_the_tables(spark, sf):
    rows = duckdb.sql(f"select doc_id, text from '/root/testdata/{sf}/documents.parquet'").fetchall()
    assert shown(token_cuts.op12_token_cuts(spark, f"/root/testdata/{sf}")) == ordered(plain(rows))


SPACED = ["a  b   c d ", " lead", "trail ", "x\n y\n\n z \n", "tab\t x", "\u3000 x\u3000 y", "don't 've  's", " ", "  ", "\n", "w \x1c v", "z\x85 q", "..., !!! a\n\n\n  b", "a\u200b b", "日本 語", "a▁b c", "", "x" * 90 + " y", "p " * 50 + "end", "é" * 40 + " é", "word, word. Word word"]


def test_texts_are_put_together_from_segments(monkeypatch):
    """As from whole texts; segments that were met are not encoded again."""
    split = regex.compile(P.PATTERN).findall
    for text in filter(None, SPACED):
        cut = token_cuts.segments(text)
        assert " ".join(cut) == text and [x for s in cut for x in split(" " + s)] == split(" " + text)
    r = random.Random(9)
    some = SPACED + ["".join(r.choice([" ", " ", "  ", "\n", "the", "ing", "ñ", "1", ".", "\t", "sch", "日", "\u2003"]) for _ in range(r.randrange(60))) for _ in range(400)]
    met = token_cuts.segments_of(A_BYTES, pieces.model_bytes())
    whole, left, right = token_cuts.tokens_of(met.known, met.b, pieces.Kept(met.b), split, some)
    cuts = token_cuts.Cuts(left, right, *met.sizes)
    text, *pairs = cuts.pairs()
    for again in (False, True):
        if again:
            monkeypatch.setattr(token_cuts.Segments, "_learn", None)
        held, counts, groups, found = met.aligned(some)
        assert held.tolist() == whole and groups == cuts.written(*met.digits)
        assert (counts == np.array([cuts.n_a, cuts.n_b, cuts.n_groups(), cuts.n_links()])).all()
        assert all((x == y).all() for x, y in zip(found, [np.array(whole)[text], *pairs], strict=True))


def test_distinct_pairs_however_often():
    r = np.random.default_rng(4)
    text, pair = r.integers(0, 5, 300), r.integers(0, 20, 300)
    for times in (np.ones(300, np.int64), r.integers(1, 9, 300)):
        want = Counter()
        for t, p, n in zip(text.tolist(), pair.tolist(), times.tolist(), strict=True):
            want[t, p] += n
        for far in (1, 1 << 40):
            got = token_cuts.distinct(text * far, pair * (1 << 22), times)
            assert list(zip(*(x.tolist() for x in got), strict=True)) == [(t * far, p << 22, n) for (t, p), n in sorted(want.items())]
