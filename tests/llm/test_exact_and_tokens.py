import random
from hashlib import sha256

import duckdb
import public_tokenizers as tok
import pytest
import regex
import tiktoken

from lakeloom.llm import bpe, exact_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both():
    tokens = bpe.load_ranks(tok.path(bpe.VOCABULARY))
    return bpe.PrefixBPE(tokens), tiktoken.Encoding("plain", pat_str=tok.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_dedup_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    theirs = con.sql(exact_dedup.OP1_SQL)
    ours = exact_dedup.op1_exact_dedup(spark, SF)
    assert sorted(tuple(r) for r in ours.collect()) == sorted(theirs.fetchall()) and ours.columns == theirs.columns


def test_index_is_kept_between_batches(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a  b", 0), (4, "a\tb", 0), (4, "a\tb", 0), (5, "a b ", 0), (None, "z", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id int")
    index = exact_dedup.DigestIndex(spark, buckets=3)
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in index.add(docs).collect()}
    assert got == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 3, True), (4, 3, 3, False), (5, 5, 1, True), (None, None, 1, True)}
    assert index.rows().count() == 4
    later = exact_dedup.DigestIndex(spark, index.name)
    got = {(r.doc_id, r.keep_id, r.kept) for r in later.add(spark.createDataFrame([(0, "a b"), (9, "new")], "doc_id long, text string")).collect()}
    assert got == {(0, 3, False), (9, 9, True)} and later.rows().count() == 5
    plan = docs.select("text").toDF("text_sha256").hint("merge").join(later.rows(), "text_sha256", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and plan.split("== Physical Plan ==")[1].count("Exchange") == 1
    assert later.add(docs.limit(0)).count() == 0 and exact_dedup.deduplicate(docs).columns == docs.columns


def test_encoding_is_that_of_the_library(both):
    ours, theirs = both
    split, kept, r = regex.compile(tok.PATTERN).findall, {}, random.Random(1)
    alphabet = list("abcdeth inéß中 \x1c\x1d\x85\xa0​᠎﻿\n\t\r\x0b\x0c'sll1٣२!?#$😀é́ ")
    some = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    some += ["", "a" * 5000, "the" * 3000, " " * 4000, "'" * 999, "<|endoftext|>", "1" * 3000]
    some += [t for (t,) in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]
    for text, ids in zip(some, bpe.encode_texts(ours, kept, split, some), strict=True):
        assert ids == theirs.encode_ordinary(text), text
        assert ours.decode(ids) == text.encode()


def test_tables_under_appends_and_edits(both):
    ours, theirs = both
    r, table = random.Random(2), bpe.PrefixTable(both[0])
    for _ in range(600):
        put = "".join(r.choice("abcdethinosr") for _ in range(r.randint(0, 5))).encode()
        if r.random() < 0.4:
            table.append(put)
        else:
            a = r.randint(0, len(table.data))
            table.edit(a, min(len(table.data), a + r.randint(0, 3)), put)
        assert table.ids() == ours.encode(table.data)
    assert table.ids() == theirs.encode_ordinary(table.data.decode())
    long = bpe.PrefixTable(ours, b"thenation" * 5000)
    assert long.edit(100, 101, b"x") < 1000 and long.ids() == ours.encode(long.data)


def test_token_rows(spark, both):
    rows = [(1, None, 5), (2, "", 5), (3, "Hello  world", 5), (3, "Hello  world", 5), (None, "é" * 100_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    for r, (d, t, _) in zip(bpe.tokenized(docs).collect(), rows, strict=True):
        ids = both[1].encode_ordinary(t or "")
        assert (r.doc_id, r.n_tokens, r.ids) == (d, len(ids), ids)
        assert r.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == sha256((t or "").encode()).hexdigest()
    assert bpe.tokenized(docs.limit(0)).count() == 0
