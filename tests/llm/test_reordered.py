import random

import pytest

from lakeloom.llm import decontamination as dc
from tests.llm.test_decontamination import brute


def test_reordered_passages(spark):
    r = random.Random(7)
    words = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    items = [(0, words(104)), (1, words(60)), (2, words(300))]
    docs = []
    for _, w in items:
        half = len(w) // 2
        third = len(w) // 3
        for moved in (w[half:] + w[:half], w[third:] + w[:third], w[-2:] + w[:-2], w[5:] + words(5)):
            for before, after in ((200, 200), (0, 0), (3, 0)):
                docs.append((len(docs), " ".join(words(before) + moved + words(after))))
    items = [(i, " ".join(w)) for i, w in items]
    plain = brute(docs, items)
    found = dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in found.collect()}
    assert plain[0, 0] > 0.9 and got == pytest.approx(plain)
