from hashlib import sha256

import duckdb
import public_tokenizers as tok
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lakeloom.llm import quality
from lakeloom.llm.bpe import VOCABULARY, load_ranks
from lakeloom.llm.common import read
from tests.llm.test_decontamination import brute
from tests.llm.test_similar import alike, plain_set

SF = "/root/testdata/sf0.001"


def plain_exact(rows):
    seen = {}
    for d, t in sorted(rows):
        for c in "\t\n\x0b\x0c\r":
            t = t.replace(c, " ")
        while "  " in t:
            t = t.replace("  ", " ")
        seen.setdefault(t, d)
    return set(seen.values())


def test_run_against_plain_stages(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    docs = read(spark, SF, "documents")
    good = {r.doc_id for r in quality.scored(docs, quality.trained(docs)).where("keep").collect()}
    rows = [x for x in rows if x[0] in good]
    first = plain_exact(rows)
    rows = [x for x in rows if x[0] in first]
    standing = {}
    for d, t in sorted(rows):
        if not any(alike(plain_set(t), x) for x in standing.values()):
            standing[d] = plain_set(t)
    rows = [x for x in rows if x[0] in standing]
    held = {d for d, _ in brute(rows, items)}
    rows = [x for x in rows if x[0] not in held]
    ranks = {t: i for i, t in enumerate(load_ranks(tok.path(VOCABULARY)))}
    enc = tiktoken.Encoding("plain", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == {d for d, _ in rows} and 50 < len(got) < 200
    for d, t in rows:
        assert got[d].ids == enc.encode_ordinary(t) and got[d].decoded_sha256 == sha256(t.encode()).hexdigest()


def test_stages_keep_columns(spark):
    docs = read(spark, SF, "documents").limit(20)
    odd = docs.limit(1).selectExpr("doc_id + 100000 doc_id", "cast(null as string) text", "cast(null as string) lang", "source", "n_chars")
    docs = docs.unionByName(odd)
    for clash in ("bad_id", "keep_id", "component_id", "fp", "h", "score", "keep", "id", "root"):
        docs = docs.withColumn(clash, F.lit(None).cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.exceptAll(docs).count() == 0 and stage(spark, docs.limit(0), SF).count() == 0, name


def test_stages_of_odd_rows(spark):
    """Each stage on nulls, empty and very long texts, repeated rows and rows without a doc_id."""
    prose = [f"Plain sentence number {i} of some ordinary words, which say nothing much about the {i}th thing at hand today." for i in range(40)]
    long = " ".join(prose) + " And " + " ".join(f"word{i} goes on" for i in range(30_000)) + "."
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(prose)]
    rows += [(50, None, None, None, None), (51, "", "en", "s", 0), (52, long, "en", "s", len(long)), (53, long, "en", "s", len(long)), (54, prose[3], "en", "s", 1), (54, prose[3], "en", "s", 1), (None, prose[5], "en", "s", 1), (None, "Nothing but one more plain sentence of its own, in usual words.", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = sorted(((r.doc_id, r.text) for r in stage(spark, docs, SF).collect()), key=str)
        ids = [d for d, _ in kept]
        assert set(kept) <= {(r[0], r[1]) for r in rows}, name
        if name == "quality":
            assert 50 not in ids and 51 not in ids and {0, 52, 53, 54} <= set(ids), name
        elif name == "exact_dedup":
            assert 50 in ids and 51 not in ids and 53 not in ids and 54 not in ids and ids.count(None) == 2, name
        elif name == "near_dedup":
            assert 50 in ids and 51 not in ids and 53 not in ids and 54 not in ids and ids.count(None) == 2, name
        else:
            assert ids.count(54) == 2 and ids.count(None) == 2 and {50, 51, 52, 53} <= set(ids), name
    out = corpus_pipeline.token_stage(spark, docs, SF)
    assert out.count() == len(rows) and {r.n_tokens for r in out.where("doc_id in (50, 51)").collect()} == {0}
