"""Words of the context-tree scoring, hashed some at a time."""

import collections
import math

import numpy as np

from clickloom.llm import ctw, paragraph_dedup


def test_words_of_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(ctw, "PIECE", 40)
    rng = np.random.default_rng(3)
    texts = [b" ".join(b"x" * int(n) for n in rng.integers(1, 60, int(k))) for k in rng.integers(0, 12, 60)]
    found = collections.defaultdict(list)
    for keys, owner in ctw.word_keys(texts):
        for key, i in zip(keys.tolist(), owner.tolist()):
            found[i].append(key)
    one = {w: int(paragraph_dedup.word_hashes([w])[0].view(np.int64)[0]) for t in texts for w in t.split()}
    assert len(set(one.values())) == len(one)
    for i, text in enumerate(texts):
        assert found[i] == [one[w] for w in text.split()]


def test_base_and_tokens_against_counters(spark, monkeypatch):
    monkeypatch.setattr(ctw, "PIECE", 64)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"W{k}\t" for k in rng.integers(0, 30, int(rng.integers(0, 25))))) for i in range(60)] + [(60, None), (None, "w1 w1")]
    found = ctw.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    words = {i: [*(t or "").lower().split(), None] for i, t in rows}
    held = {r.doc_id: r.held_out for r in found}
    c = collections.Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total = sum(c.values())
    assert len(found) == len(rows)
    for r in found:
        ws = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (total + 0.5 * (len(c) + 1))) for w in ws), abs_tol=1e-9)
