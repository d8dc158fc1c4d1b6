"""Token alignment, the metric range join and heap-ordered clustering against brute force."""

import collections
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clickloom.llm import heap_kmeans, metric_join, queries, token_align
from clickloom.llm import text as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both():
    return token_align.tokenizers(token_align.BYTE_BPE, token_align.PIECE_BPE)


# 11 token alignment


def encoded(both, text):
    """Ids by the libraries alone, none where bytes are lost."""
    a = both._slow.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
    b = both.b.encode(text) if text else []
    data = (" " + (text or "")).encode()
    whole = b"".join(both.a_bytes[i] for i in a) == data == b"".join(both.b_bytes[i] for i in b)
    return (a, b) if whole else ([], [])


def aligned(both, text):
    a, b = encoded(both, text)
    ends = [np.cumsum([len(table[i]) for i in ids]).tolist() for table, ids in ((both.a_bytes, a), (both.b_bytes, b))]
    common = sorted(set(ends[0]) & set(ends[1]))
    groups = []
    for g, end in enumerate(common):
        begin = common[g - 1] if g else 0
        sides = [",".join(str(i) for i, e in zip(ids, es) if begin < e <= end) for ids, es in ((a, ends[0]), (b, ends[1]))]
        groups.append("|".join(sides))
    links = [(x, y) for x, e in zip(a, ends[0]) for y, f in zip(b, ends[1]) if e == f]
    digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
    return {"n_a": len(a), "n_b": len(b), "n_groups": len(common), "n_links": len(links), "groups_sha256": digest}, links


TOKEN_EDGES = [
    None, "", " ", "  two  spaces \n\n tab\t", "a▁b", "<|endoftext|> </s> <s> [INST]", "日本語 text 🎉 é́ à",
    "x" * 3000, "don't we'll it's 'S", "\x00 nul", "same words", "same words",
]


def check_alignment(spark, both, texts):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, pair int, pairs string").repartition(5)
    got = {r["doc_id"]: r.asDict() for r in token_align.score(df).collect()}
    want, counts = {}, collections.Counter()
    for i, t in enumerate(texts):
        want[i] = aligned(both, t)
        counts.update(want[i][1])
    best = collections.defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    assert len(got) == len(texts)
    for i, (row, links) in want.items():
        row = row | {"n_best": sum(counts[x] == best[x[1]] for x in links), "count_sum": sum(counts[x] for x in links)}
        assert {k: got[i][k] for k in row} == row, texts[i]


def test_alignment_against_brute_force(spark, both):
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    check_alignment(spark, both, TOKEN_EDGES + docs)


def test_query_on_the_whole_table(spark, both):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_token_align(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        want, _ = aligned(both, docs[r["doc_id"]])
        assert {k: r[k] for k in want} == want


def test_both_libraries_split_every_letter_alike(both):
    for begin in range(0, 0x110000, 0x8000):
        texts = [f" a{chr(c)}b {chr(c)} {chr(c)}1{chr(c)}!" for c in range(begin, begin + 0x8000) if not 0xD800 <= c < 0xE000]
        if texts:
            assert [e.ids for e in both._slow.encode_batch(texts, add_special_tokens=False)] == [both.encode_a(t) for t in texts]


def test_cut_texts_give_the_same_tokens(both, monkeypatch):
    monkeypatch.setattr(token_align, "PART", 20)
    draw = random.Random(1)
    text = "".join(draw.choice(["ab", "Word", " ", "  ", "\n", "é", "12", ".", "'s", "日本"]) for _ in range(4000))
    parts = both.cut(text)
    assert len(parts) > 50 and " ".join(parts) == text
    a, b = both.encode(parts)
    assert (np.concatenate(a).tolist(), np.concatenate(b).tolist()) == encoded(both, text)
    block = next(iter(token_align._encoded(both, pa.array([text]))))
    row = token_align._described(both, pa.array([7]), block).to_pylist()[0]
    want, _ = aligned(both, text)
    assert {k: row[k] for k in want} == want


def test_long_parts_go_to_the_other_library(both, monkeypatch):
    monkeypatch.setattr(token_align, "LONG_PART", 3)
    assert both.encode_a(" some words") == both.a.encode_ordinary(" some words")


def test_products_against_dense_matrices():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.integers(0, 2, (7, 9)), rng.integers(0, 2, (6, 9))
        ca, cb = (token_align.Csr(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1], 9) for m in (a, b))
        rows, columns, values = token_align.multiply(ca, token_align.transpose(cb))
        dense = np.zeros((7, 6), dtype=int)
        dense[rows, columns] = values
        assert (dense == a @ b.T).all()
        assert token_align.row_sizes(ca, token_align.transpose(cb)).sum() == (a @ b.T).sum()


def test_links_of_both_kinds(spark, both):
    text = "aligning tokens differently, 日本語"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    a, b = encoded(both, text)
    end_a, end_b = (np.cumsum([len(t[i]) for i in ids]) for t, ids in ((both.a_bytes, a), (both.b_bytes, b)))
    overlap = {}
    for i, e in enumerate(end_a):
        for j, f in enumerate(end_b):
            shared = min(e, f) - max(e - len(both.a_bytes[a[i]]), f - len(both.b_bytes[b[j]]))
            if shared > 0:
                overlap[(i, j)] = shared
    got = {(r["a_place"], r["b_place"]): r["weight"] for r in token_align.links(df).collect()}
    assert got == overlap
    common = sorted(set(end_a.tolist()) & set(end_b.tolist()))
    want = {(i, j) for i, e in enumerate(end_a) for j, f in enumerate(end_b) if np.searchsorted(common, e) == np.searchsorted(common, f)}
    assert {(r["a_place"], r["b_place"]) for r in token_align.links(df, "group").collect()} == want
    with pytest.raises(ValueError):
        token_align.links(df, "other")


def test_alignment_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.score(df).count() == 0
    nothing = spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string")
    assert {tuple(r)[1:] for r in token_align.score(nothing).collect()} == {(0, 0, 0, 0, 0, "", 0, 0)}


# 12 metric join


def brute_links(rows, similarity=0.93):
    """Degree and component of every row by all pairs."""
    def unit(e):
        if e is None or not len(e) or any(x is None or not math.isfinite(x) for x in e) or not any(e):
            return None
        v = np.array(e, dtype=float) / np.abs(np.array(e, dtype=float)).max()
        return v / np.sqrt(v @ v)

    units = [unit(e) for _, e, _ in rows]
    parent, degree = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][2] is not None and rows[i][2] == rows[j][2] and units[i] is not None and units[j] is not None
            if same and len(units[i]) == len(units[j]) and units[i] @ units[j] >= similarity:
                degree[i] += 1
                degree[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (v, _, _) in enumerate(rows):
        least.setdefault(root(i), []).append(v)
    out = []
    for i, (v, _, _) in enumerate(rows):
        known = [x for x in least[root(i)] if x is not None]
        component = min(known) if known else None
        out.append((v, degree[i], component, v is not None and v == component))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def check_join(spark, rows, similarity=0.93, parts=4):
    df = spark.createDataFrame([(v, e, lab, "x", 1, 2) for v, e, lab in rows], "vec_id long, embedding array<double>, label int, `group` string, node int, kind int")
    got = metric_join.near_duplicates(df.repartition(parts), similarity=similarity)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert order(tuple(r) for r in got.collect()) == order(brute_links(rows, similarity))


def clustered(rng, n, dim, spread, centres=3):
    """Clusters of several widths among single vectors, under two labels."""
    c = rng.normal(size=(centres, dim))
    rows = []
    for i in range(n):
        k = rng.integers(0, centres + 2)
        e = c[k] / np.linalg.norm(c[k]) * 3 + rng.normal(size=dim) * spread * rng.random() if k < centres else rng.normal(size=dim)
        rows.append((int(rng.integers(0, 5 * n)), e.tolist(), int(rng.integers(0, 2))))
    return rows


@pytest.mark.parametrize("dim,spread", [(3, 1.0), (16, 0.4)])
def test_join_with_pivots_against_all_pairs(spark, monkeypatch, dim, spread):
    monkeypatch.setattr(metric_join, "CELL", 24)
    check_join(spark, clustered(np.random.default_rng(dim), 300, dim, spread))


def test_join_in_blocks_without_pivots(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "PIVOT_LABELS", 1)
    monkeypatch.setattr(metric_join, "block_size", lambda n, dim: 30)
    monkeypatch.setattr(metric_join, "CELL", 24)
    check_join(spark, clustered(np.random.default_rng(9), 260, 4, 0.6))


def test_join_of_one_large_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL", 24)
    monkeypatch.setattr(metric_join, "block_size", lambda n, dim: 40)
    rng = np.random.default_rng(4)
    base = rng.normal(size=6)
    rows = [(i, base.tolist(), 0) for i in range(120)] + [(200 + i, (base * 2 + rng.normal(size=6) * 0.3).tolist(), 0) for i in range(60)]
    check_join(spark, rows + [(500 + i, rng.normal(size=6).tolist(), 0) for i in range(60)])


def test_join_at_another_similarity(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL", 24)
    rng = np.random.default_rng(5)
    rows = clustered(rng, 150, 5, 0.2)
    check_join(spark, rows + [(1000 + i, rows[i][1], rows[i][2]) for i in range(20)], 0.5)


def test_join_edges(spark):
    one = [1.0, 0.0, 0.0]
    rows = [
        (1, one, 0), (1, one, 0), (2, [2.0, 0.0, 0.0], 0), (3, one, 1), (4, one, None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0, 0.0], 0),
        (8, [1.0, None, 0.0], 0), (9, [1.0, float("nan"), 0.0], 0), (10, [1.0, float("inf"), 0.0], 0), (None, one, 0), (None, [0.0, 1.0, 0.0], 5),
        (11, [1.0, 0.0], 0), (12, [1e300, 0.0, 0.0], 0), (13, [1e-300, 0.0, 0.0], 0), (14, [-1.0, 0.0, 0.0], 0), (None, [0.0, 1.0, 0.0], 5),
    ]
    check_join(spark, rows, parts=1)
    check_join(spark, rows, parts=len(rows))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label string")
    assert metric_join.near_duplicates(empty).count() == 0
    with pytest.raises(ValueError):
        metric_join.near_duplicates(empty, similarity=0)


def test_bound_is_exact():
    at = 0.93
    block = metric_join.Block(at, False)
    angle = math.acos(at)
    rows = np.array([[1.0, 0.0], [math.cos(angle * 0.999999), math.sin(angle * 0.999999)], [math.cos(angle * 1.000001), math.sin(angle * 1.000001)]])
    block.add(np.arange(3), np.arange(3), np.arange(3), np.zeros(3, dtype=np.int64), rows)
    block.results()
    assert block.n_links.tolist() == [1, 2, 1]


def test_sent_only_where_links_can_be(spark, monkeypatch):
    """Vectors of clusters far apart are members of one block and guests of none."""
    monkeypatch.setattr(metric_join, "CELL", 24)
    rng = np.random.default_rng(8)
    centres = np.eye(8) * 5
    rows = [(i, (centres[i % 8] + rng.normal(size=8) * 0.1).tolist(), 0) for i in range(320)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    every = T.stored(metric_join.vectors(df), "v")
    groups = every.groupBy("group", "dim").agg(F.count("*").alias("n"))
    radius = math.acos(0.93)
    cells = metric_join.count_cells(every, metric_join.find_pivots(every, groups), radius)
    met = metric_join.meetings(every.withColumn("n", F.lit(320).cast("long")), cells, radius)
    assert met.count() == 320 and met.filter("kind = 1").count() == 0
    assert {r["n_links"] for r in metric_join.near_duplicates(df).collect()} == {39}


# 13 clustering


def brute_kmeans(rows, clusters, rounds, dimensions, seed="2:"):
    kept = []
    for v, e in rows:
        if e is not None and len(e) == dimensions and all(x is not None and math.isfinite(x) for x in e):
            ints = [math.floor(256 * x) for x in e]
            if max(map(abs, e)) < heap_kmeans.LIMIT // heap_kmeans.SCALE:
                kept.append((v, ints))
    first = sorted(kept, key=lambda r: (hashlib.sha256((seed + ("" if r[0] is None else str(r[0]))).encode()).hexdigest(), r[1]))[:clusters]
    centres = [list(e) for _, e in first]

    def nearest(e):
        return min((sum((x - y) ** 2 for x, y in zip(e, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(e)[1] for _, e in kept]
        for k in range(len(centres)):
            members = [e for (_, e), c in zip(kept, own) if c == k]
            if members:
                centres[k] = [sum(col) // len(members) for col in zip(*members)]
    found = [(v, *reversed(nearest(e))) for v, e in kept]
    inertia = collections.Counter()
    for _, c, d in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(v, c, d, inertia[c], sum(inertia.values()), digest[c]) for v, c, d in found]


def check_clusters(spark, rows, clusters, rounds, dimensions, parts=4):
    df = spark.createDataFrame([(v, e, 1, 2.0) for v, e in rows], "vec_id long, embedding array<double>, cluster int, key double").repartition(parts)
    got = heap_kmeans.cluster(df, clusters=clusters, rounds=rounds, dimensions=dimensions)
    assert order(tuple(r) for r in got.collect()) == order(brute_kmeans(rows, clusters, rounds, dimensions))


@pytest.mark.parametrize("clusters,rounds,dimensions", [(12, 5, 8), (1, 2, 2), (300, 2, 2)])
def test_clusters_against_brute_force(spark, clusters, rounds, dimensions):
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(4, dimensions)) * 4
    rows = [(int(i), (centres[i % 4] + rng.normal(size=dimensions) * 0.4).tolist()) for i in range(200)]
    check_clusters(spark, rows, clusters, rounds, dimensions)


def test_clusters_with_ties_and_edges(spark):
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate((x, y) for x in range(-5, 5) for y in range(-5, 5))]
    rows += [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (None, [0.25, -0.25]), (None, None), (900, []), (901, [1.0]), (902, [1.0, None]),
             (903, [1.0, float("nan")]), (904, [float("-inf"), 0.0]), (905, [1e30, 0.0]), (906, [500_000.5, -500_000.5]), (907, [-0.001, 0.001])]
    check_clusters(spark, rows, 7, 5, 2, parts=1)
    check_clusters(spark, rows, 7, 5, 2, parts=len(rows))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert heap_kmeans.cluster(empty).count() == 0


def test_equal_vectors_are_never_lost(spark):
    check_clusters(spark, [(i, [1.0, 2.0, 3.0]) for i in range(50)] + [(50, [0.0, 0.0, 0.0])], 4, 3, 3)


def test_only_expired_vectors_are_scanned(spark):
    """Clusters that stand far apart keep their vectors' gaps, so later rounds scan few of them."""
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0], [100, 0], [0, 100], [100, 100]])
    rows = [(int(i), (centres[i % 4] + rng.normal(size=2)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for seed in range(40):
        found = heap_kmeans.first_centroids(heap_kmeans.integers(df, dimensions=2), 4, f"{seed}:")
        if len({tuple(np.rint(c / 25600).astype(int)) for c in found}) == 4:
            break
    fitted = heap_kmeans.fit(heap_kmeans.integers(df, dimensions=2), 4, 5, f"{seed}:")
    assert fitted.scanned[0] == 400 and sum(fitted.scanned[1:]) < 40
    assert heap_kmeans.members(spark, fitted).count() == 400
    plan = heap_kmeans.read_runs(spark, fitted.heaps.paths).filter(heap_kmeans.held(fitted.heaps, fitted.heaps.low))._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(" in plan and "LessThan(key" in plan
