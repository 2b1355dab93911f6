import random
from hashlib import sha256

import duckdb
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import pieces

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
OWN = pieces.Pieces(pieces.model_bytes())


def field(number, data):
    """A field of bytes, as protocol buffers write it."""
    out, n = [number << 3 | 2], len(data)
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n]) + data


def remade(rule, squeeze):
    """The model with another normaliser: the library's own compiled map of that rule."""
    spec = dict(pieces.fields(dict(pieces.fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]))
    normaliser = field(1, rule.encode()) + field(2, spec[2]) + bytes([3 << 3, 1, 4 << 3, int(squeeze)])
    return b"".join(field(n, v) for n, v in pieces.fields(pieces.model_bytes()) if n != 3) + field(3, normaliser)


def same(library, own, text):
    ids = own.encode(text)
    assert ids == library.encode(text, add_eos=True), text
    assert own.decode(ids) == library.decode(ids), text
    return ids


def check_spans(own, text, ids, plain=True):
    """plain: nothing is replaced, so the spans tile the text and hold what the pieces say."""
    data, last, mark = text.encode(), 0, "▁".encode()
    starts, ends = own.spans(text, ids)
    assert (starts <= ends).all() and (starts >= 0).all() and (ends <= len(data)).all() and len(starts) == len(ids)
    for k, (i, s, e) in enumerate(zip(ids, starts.tolist(), ends.tolist(), strict=True)):
        if plain:
            said = data[s:e].replace(b" ", mark)
            assert s == last and own.marked[i] in ([said, mark + said] if not k else [said])
            last = e
    assert not plain or last == len(data)
    return starts, ends


ODD = ["", " ", "  ", "   a", "a   ", "a  b   c", "\n", "\n\n a\n", "<s>", "</s> <unk>", "<0x0A>", "▁", "▁▁ a ▁", "a▁b", "naïve café", "日本語のテキスト", "👩‍👩‍👧 x", "\x00a\x00", "\t\tif x:\n\t\t\treturn", "e\u0301", "ﬁn ½ ２３ Ⅷ ㌀ ｶﾞ", "\u200bzero\ufeff", "a" * 300, " " * 100, "ab" * 2000, "x" + " " * 17 + "y" * 40 + "-" * 33, "Ⅷ", "\u3000wide\u3000", "…", "\r\nwin\r\n"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    check_spans(OWN, text, same(LIBRARY, OWN, text))


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n▁abcetho.,")), max_size=60))
def test_any_text(text):
    check_spans(OWN, text, same(LIBRARY, OWN, text))


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [False, True])
def test_compiled_maps(rule, squeeze):
    model = remade(rule, squeeze)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Pieces(model)
    assert len(own.map) > 1000
    r = random.Random(5)
    keys = sorted(own.map)
    for text in [*ODD, *(" ".join("".join(r.choice(keys + list("abc def")) for _ in range(r.randint(1, 9))) for _ in range(6)) for _ in range(200))]:
        ids = same(library, own, text)
        check_spans(own, text, ids, plain=False)
    text = "an ofﬁce"
    ids = own.encode(text)
    starts, ends = own.spans(text, ids)
    assert {text.encode()[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e > s} <= {"an", " an", " of", " ofﬁ", "ﬁ", "ﬁce", " ofﬁce", "ce", "c", "e", " o", "f", "fﬁ", "fﬁce"}
    assert ends.max() == len(text.encode())


def test_decoding_of_any_ids():
    r = random.Random(6)
    for _ in range(300):
        ids = [r.choice([r.randrange(3, 259), r.randrange(32000)]) for _ in range(r.randint(1, 12))]
        assert OWN.decode(ids) == LIBRARY.decode(ids), ids


def test_long_stretches_take_the_heap():
    r = random.Random(7)
    for _ in range(30):
        text = "".join(r.choice("abcdeinrst") for _ in range(r.randint(17, 400)))
        same(LIBRARY, OWN, text)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_the_tables(spark, sf):
    got = {r.doc_id: r for r in pieces.op11_pieces(spark, f"/root/testdata/{sf}").collect()}
    rows = duckdb.sql(f"select doc_id, text from '/root/testdata/{sf}/documents.parquet'").fetchall()
    assert len(rows) == len(got)
    for d, t in rows:
        ids = LIBRARY.encode(t or "", add_eos=True)
        r = got[d]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(LIBRARY.decode(ids).encode()).hexdigest())
        assert r.covered_bytes == len((t or "").encode())


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 2)
    rows = [(1, None), (2, ""), (None, "no id"), (3, "x y"), (3, "x y"), (4, "word " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' ids", "1 n_tokens", "2 starts")
    out = sorted(pieces.encoded(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.n_tokens, r.covered_bytes) for r in out[:2]] == [(1, 1, 0), (2, 1, 0)] and out[2] == out[3] and out[-1].doc_id is None
    for r, (_, t) in zip([out[2], out[4], out[5]], [rows[3], rows[5], rows[2]], strict=True):
        assert r.ids == LIBRARY.encode(t, add_eos=True) and len(r.starts) == len(r.ends) == r.n_tokens
    assert pieces.encoded(docs.limit(0)).count() == 0


def test_new_words_of_a_block_are_merged_together(monkeypatch):
    """No new word of plain letters is merged by itself, and where nothing is replaced no alignment is written out."""
    r = random.Random(8)
    some = ["".join(r.choice(["the", "re", " ", "ing", "ñ", "sch", "1", "9", ".", "ü", "\n", "  "]) for _ in range(r.randrange(200))) for _ in range(300)]
    aligned = [OWN.alignment(t, [])[1] if t else [] for t in some]
    own = pieces.Pieces(pieces.model_bytes())
    monkeypatch.setattr(pieces.Pieces, "alignment", None)
    with monkeypatch.context() as m:
        m.setattr(pieces.Pieces, "merged", lambda self, stretch: list(stretch) if len(stretch) == 1 else pytest.fail(stretch))
        got = own.encode_all(some, pieces.Kept(own))
    for text, ids, ends in zip(some, got, aligned, strict=True):
        assert ids == LIBRARY.encode(text, add_eos=True)
        stops = own.spans(text, ids)[1]
        bounds = own.lengths[ids].cumsum()[:-1] - 1
        assert stops[:-1].tolist() == [int(ends[k]) for k in bounds] and stops[-1] == len(text.encode())
        check_spans(own, text, ids)
    odd = own.encode_all(ODD, pieces.Kept(own))
    assert odd == [LIBRARY.encode(t, add_eos=True) for t in ODD]
