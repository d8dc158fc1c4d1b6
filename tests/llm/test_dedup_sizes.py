"""What paragraph dedup sends: candidates that sketches allow, and borders with all their prefixes."""

import numpy as np
import pyarrow as pa
import pytest

from clickloom.llm import paragraph_dedup


def cut(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], ["id", "doc", "text"])
    return pa.Table.from_batches(list(paragraph_dedup._cut(iter([batch])))).to_pylist()


def grams(row, texts):
    words = texts[row["id"]].split()[row["start"]:row["start"] + row["n_words"]]
    n = paragraph_dedup.SHINGLE
    return {tuple(words[i:i + n]) for i in range(max(len(words) - n + 1, 1))}


def test_sketches_keep_all_similar_pairs_and_few_others():
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(300):
        words = [f"w{k}" for k in rng.integers(0, 5000, 40)]
        texts.append(" ".join(words))
        words[int(rng.integers(0, 40))] = "edited"
        texts.append(" ".join(words))
    rows = cut(texts)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    lengths = np.array([1, 2, 100, paragraph_dedup.PAIRED_RUN, paragraph_dedup.PAIRED_RUN + 1] * (len(rows) // 360))
    rows = rows[:lengths.sum()]
    keep = paragraph_dedup._paired(lengths, np.array([r["sketch"] for r in rows], dtype=np.int32).view(np.uint32))
    sets, at = [grams(r, texts) for r in rows], 0
    for n in lengths:
        here = sets[at:at + n]
        partner = [any(i != j and len(a & b) >= paragraph_dedup.SIMILARITY * len(a | b) for j, b in enumerate(here)) for i, a in enumerate(here)]
        assert all(k or not p for k, p in zip(keep[at:at + n], partner))
        if n > paragraph_dedup.PAIRED_RUN:
            assert keep[at:at + n].all()
        at += n
    small = np.repeat(lengths <= paragraph_dedup.PAIRED_RUN, lengths)
    assert keep[small].mean() < 0.5


@pytest.mark.parametrize("busy", [0, 2, 10_000])
def test_longest_shared_prefixes(spark, monkeypatch, busy):
    monkeypatch.setattr(paragraph_dedup, "BUSY_BORDERS", busy)
    rng = np.random.default_rng(6)
    borders = []
    for border in range(120):
        words = rng.integers(0, 2, int(rng.integers(0, 7))).tolist()
        # a key stands for the whole prefix
        borders.append((border, int(rng.integers(0, 40)), [int("1" + "".join(map(str, words[:k + 1]))) for k in range(len(words))]))
    found = paragraph_dedup._longest_shared(spark.createDataFrame(borders, "border long, id long, keys array<long>"))
    expected = set()
    for border, own, keys in borders:
        others = [{i for _, i, more in borders if key in more} - {own} for key in keys]
        n = sum(bool(o) for o in others)
        if n:
            expected.add((border, n, sum(bool(o) and min(o) < own for o in others) or None))
    assert {tuple(r) for r in found.select("border", "n", "old").collect()} == expected
