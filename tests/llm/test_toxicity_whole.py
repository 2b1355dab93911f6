import zlib

import duckdb
import numpy as np

from lakeloom.llm import toxicity


def crc(d, m):
    return zlib.crc32(str(d).encode()) % m


def test_long_runs_are_read_whole():
    run = "x" * 40 + "vlorkix" * 20
    assert "".join(toxicity.words_of(run)) == run and max(map(len, toxicity.words_of(run))) <= 32
    model = toxicity.Model.new({})
    a, b = toxicity.Scorer(model).scores(["好" * 40 + "坏" * 30, "好" * 70])
    assert a != b


def plain_scores(model, words):
    """Each window by itself, word by word: the states of its stretch, pooled over the window."""
    p, h, span = model.p, toxicity.HIDDEN, toxicity.SPAN
    out = []
    for s in range(max(1, len(words) - span + 1)):
        begin = s // toxicity.STEP * toxicity.STEP
        some = words[begin : begin + toxicity.STRETCH]
        x = model.inputs(some)[0]
        states = np.zeros((len(some), 2 * h))
        for way, order, part in (("f", range(len(some)), slice(0, h)), ("b", range(len(some) - 1, -1, -1), slice(h, 2 * h))):
            state = np.zeros(h)
            for i in order:
                g, own = x[i] @ p[f"in_{way}"] + p[f"bias_{way}"], state @ p[f"own_{way}"]
                z, r = (1 / (1 + np.exp(-(g[k : k + h] + own[k : k + h]))) for k in (0, h))
                state = (1 - z) * state + z * np.tanh(g[2 * h :] + r * own[2 * h :])
                states[i, part] = state
        mine = states[s - begin : s - begin + span]
        a = np.exp(np.tanh(mine @ p["att"] + p["att_bias"]) @ p["att_out"])
        out.append(float((a / a.sum()) @ mine @ p["out"] + p["out_bias"][0]))
    return out


def test_every_start_is_scored():
    for n in (0, 1, 24, 25, 60):
        assert toxicity.windows(n).tolist() == list(range(max(min(n, 1), n - toxicity.SPAN + 1)))
    r = np.random.default_rng(2)
    words = ["".join(r.choice(list("abcdefgh"), 5)) for _ in range(60)]
    model = toxicity.Model.new({w: i + 1 for i, w in enumerate(words)})
    model.p = {k: v + 0.3 * r.standard_normal(v.shape).astype(np.float32) for k, v in model.p.items()}
    some = [list(r.choice(words, n)) for n in (1, 23, 24, 25, 72, 73, 96, 97, 98, 250, 0, 5)]
    plain = [plain_scores(model, w) for w in some if w]
    gates = model.tables(model.inputs(words)[0])
    place = {w: i for i, w in enumerate(words)}
    logits = model.score(gates, np.array([place[x] for w in some for x in w]), np.array([len(w) for w in some]))
    assert np.allclose(logits, np.concatenate(plain), atol=2e-5) and len(logits) == sum(len(toxicity.windows(len(w))) for w in some)
    whole = toxicity.Scorer(model).scores([" ".join(w) for w in some])
    assert np.allclose(whole[[i for i, w in enumerate(some) if w]], [1 / (1 + np.exp(-max(x))) for x in plain], atol=1e-5) and whole[10] == 0


def test_sliding_sums():
    x = np.random.default_rng(0).random((40, 3))
    for size in (1, 5, 24, 40):
        assert np.allclose(toxicity.sliding(x, size), [x[i : i + size].sum(axis=0) for i in range(41 - size)])


def test_passages_are_found_wherever_they_stand():
    """Windows share the states of their stretch, so a score depends on where a passage stands: by how much, over all 49 places."""
    at = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, text, toxic from '{at}/documents.parquet' join '{at}/labels.parquet' using (doc_id) where text is not null order by doc_id").fetchall()
    held = [(d, t, y) for d, t, y in rows if crc(d, 5) == 0]
    sample = [[(t, y) for d, t, y in rows if crc(d, 5) and y == k][: toxicity.PER_CLASS] for k in (0, 1)]
    scorer = toxicity.Scorer(toxicity.train(sum(sample, [])))
    clean = next(t for _, t, y in held if not y and len(t.split()) > 200 and scorer.scores([t])[0] < 0.2).split()[:200]
    passages = []
    for _, t, y in rows:
        words = t.split()
        spans = [" ".join(words[i : i + toxicity.SPAN]) for i in range(0, len(words) - toxicity.SPAN, toxicity.SPAN)] if y else []
        if spans and max(scores := scorer.scores(spans)) > 0.8:
            passages.append(spans[int(np.argmax(scores))])
    moved = [" ".join([*clean[:k], p, *clean[k:]]) for p in passages[:20] for k in range(49)]
    found = (scorer.scores(moved) >= 0.5).reshape(-1, 49)
    print(len(found), "passages, found in", round(float(found.mean()), 3), "of the places; in all places", int(found.all(axis=1).sum()))
    assert len(found) >= 10 and found.mean() >= 0.9 and found.any(axis=1).mean() >= 0.95
