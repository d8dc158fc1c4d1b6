"""The text operators against brute force, round trips and held-out labels, on small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from checks import compare
from clickloom.llm import chat_format, components, ctw, decontaminate, domain_rules, feistel, mil_quality, oracle, paragraph_dedup, queries, simhash, source_mix, warc
from clickloom.llm import text as T

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
#: Extra columns have the names of the operators' own columns.
EDGE = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, row string, bucket int, print long"


@pytest.fixture(scope="module")
def docs():
    con = compare.connect(SF)
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.fixture(scope="module")
def edge(spark):
    long_text = " ".join(f"Word{i % 700}" for i in range(30_000))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "b"), (None, "one two three four", None, "a"),
        (4, long_text, "en", "c"), (5, "Ünï \x1c cödé É word x 𝕏 KK", "de", None), (6, "same words here now", "en", "a"),
        (6, "same words here now", "en", "a"), (7, "same words here now", "en", "b"), (None, None, None, None), (6, "other text", "en", "a"),
    ]
    return spark.createDataFrame([(i, t, l, s, len(t or ""), 0.5, 3, "r", 1, 9) for i, t, l, s in rows], EDGE)


def words(text):
    return WORD.findall(text or "")


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_against_sql(spark, name):
    assert compare.check(spark, compare.connect(SF), queries.QUERIES[name], oracle.ORACLES[name], SF) is None


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]


# 1 quality classifier


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op1_quality_classifier(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.93
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_quality_long_text_is_a_sum_over_slices(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [bytes(rng.choice(list(b"ab AB!\n#"), 5000).tolist()) for _ in range(20)]
    encoded = [mil_quality.encode([t])[0] for t in texts]
    owner = np.repeat(np.arange(20), [len(e) for e in encoded])
    model = mil_quality.train(np.concatenate(encoded), owner, np.arange(20) % 2)
    whole = model.score(texts)
    monkeypatch.setattr(mil_quality, "SLICE", 1024)
    assert np.allclose(whole, model.score(texts), atol=0.02)


def test_quality_edges(spark, edge):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (7, None, 0), (None, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    model = mil_quality.fit(edge, labels)
    scored = mil_quality.score(edge, model).collect()
    assert len(scored) == 11 and all(0 <= r["score"] <= 1 for r in scored)
    none = mil_quality.fit(edge, labels.limit(0))
    assert {r["score"] for r in mil_quality.score(edge, none).collect()} == {0.5}
    assert mil_quality.score(edge.limit(0), model).count() == 0
    assert mil_quality.keep_good(edge, none).columns == edge.columns


# 2 mixing


def test_targets_stop_at_three_times():
    got = source_mix.targets({"a": 10, "b": 1000, None: 5, "c": 0})
    assert got["a"] <= 30 and got["c"] == 0 and got[None] == 15 and math.isclose(sum(got.values()), 1015)


def test_split_quotas_are_exact():
    shares = source_mix.split_quotas([100, 7, 0, 900], 16)
    assert shares.sum(axis=1).tolist() == [100, 7, 0, 900]
    assert shares.sum(axis=0).max() - shares.sum(axis=0).min() <= 4
    assert (shares == source_mix.split_quotas([100, 7, 0, 900], 16)).all()


def test_mix_edges_and_blocks(spark, edge):
    mixed = source_mix.mix(edge, shards=4, block_words=50)
    rows = mixed.collect()
    assert set(edge.columns) <= set(mixed.columns) and {r["mix_shard"] for r in rows} <= set(range(4))
    by = collections.Counter((r["doc_id"], r["text"]) for r in rows)
    assert by[(6, "same words here now")] <= 2 * 4
    assert source_mix.mix(edge.limit(0)).count() == 0
    assert sorted(map(str, rows)) == sorted(map(str, source_mix.mix(edge.repartition(5), shards=4, block_words=50).collect()))


# 3 decontamination


def brute_hits(text, items, size=13):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w = split(text)
    hit, found = set(), set()
    for item, t in items:
        b = split(t)
        n = min(len(b), size)
        windows = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), sorted(found)


def test_decontaminate_short_items_and_edges(spark, edge):
    items = [(1, "one Two"), (2, None), (None, "same"), (3, "word"), (4, " ".join(f"word{i}" for i in range(20))), (5, "SAME words here"), (6, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["text_hash"]): r for r in decontaminate.find_hits(edge, bench).collect()}
    expect = {(r["doc_id"], r["h"]): brute_hits(r["text"], [i for i in items if i[0] is not None]) for r in edge.withColumn("h", F.xxhash64("text")).collect()}
    assert {k: (r["n_words"], r["n_hit"], sorted(r["items"])) for k, r in found.items()} == expect
    assert decontaminate.drop_contaminated(edge, bench).columns == edge.columns
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(edge.filter("doc_id = 7"), bench).collect()}
    assert cut == {7: "now"}
    assert decontaminate.find_hits(edge, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.find_hits(edge.limit(0), bench).count() == 0


# 4 SimHash


def brute_print(text):
    w = words((text or "").translate(LOWER))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    parent = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
                parent = [new if p == old else p for p in parent]
    return parent


def test_simhash_against_brute_force(spark, docs):
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in queries.op4_simhash(spark, SF).collect()}
    ids = sorted(docs)
    prints = [brute_print(docs[i]) for i in ids]
    parent = brute_groups(prints)
    assert got == {i: (p, min(ids[j] for j in range(len(ids)) if parent[j] == parent[k])) for k, (i, p) in enumerate(zip(ids, prints))}


@pytest.mark.parametrize("long_run", [4, 8192])
def test_bit_sliced_links(monkeypatch, long_run):
    monkeypatch.setattr(simhash, "LONG_RUN", long_run)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 22, (40, 3)).astype(np.uint64)
    prints = np.unique(np.concatenate([base, base[rng.integers(0, 6, 40)] ^ flips[:, 0] ^ flips[:, 1] ^ np.where(rng.random(40) < 0.5, flips[:, 2], np.uint64(0))]))
    run = np.sort(rng.integers(0, 2, len(prints)))
    got = simhash.link_runs(prints, run, list(range(64)), np.arange(len(prints)))
    for r in (0, 1):
        mine = np.flatnonzero(run == r)
        want = brute_groups([int(p) for p in prints[mine]])
        assert (got[mine] == mine[want]).all()


def test_simhash_edges(spark, edge):
    rows = simhash.groups(edge).collect()
    assert len(rows) == 11
    assert {r["print"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert {r["component_id"] for r in rows if r["doc_id"] == 7} == {6}
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert texts.count((6, "same words here now")) == 1 and (7, "same words here now") not in texts and len(texts) == len(set(texts))
    assert simhash.groups(edge.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


# 5 paragraphs


def test_repeats_inside_other_lines(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    passages = [text(56) for _ in range(20)]
    rows = []
    for i in range(60):
        rows.append((i, f"{text(int(rng.integers(5, 90)))} {passages[i % 20]} {text(40)}"))
    rows += [(100 + i, text(150)) for i in range(60)] + [(900, None), (901, ""), (None, text(30)), (902, "a b")]
    found = paragraph_dedup.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} <= set(range(60)) and len({r["doc_id"] for r in found}) >= 57
    firsts = collections.defaultdict(list)
    for r in found:
        firsts[r["class_id"]].append(r["removed"])
    assert all(v.count(False) == 1 for v in firsts.values())
    assert paragraph_dedup.find_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _planted_repeats(spark, n, pairs, edit=False, seed=8):
    """Words that find_repeats reports and removes, and the planted places, by document."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(20000)]
    words = lambda k: list(rng.choice(vocabulary, k))
    texts, planted = {}, {}
    for i in range(pairs):
        passage = words(n)
        edited = list(passage)
        if edit:
            edited[int(rng.integers(n))] = f"edit{i}"
        for k, own in enumerate((passage, edited)):
            before = words(int(rng.integers(5, 80)))
            texts[2 * i + k] = before + own + words(int(rng.integers(5, 80)))
            planted[2 * i + k] = set(range(len(before), len(before) + n))
    reported, removed = collections.defaultdict(set), collections.defaultdict(set)
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    for r in paragraph_dedup.find_repeats(df).collect():
        reported[r["doc_id"]] |= set(range(r["start"], r["start"] + r["n_words"]))
        if r["removed"]:
            removed[r["doc_id"]] |= set(range(r["removed_start"], r["removed_start"] + r["removed_words"]))
    return texts, planted, reported, removed


def test_repeated_words_equal_brute_force(spark):
    texts, planted, reported, removed = _planted_repeats(spark, 60, 150)
    n, holders = paragraph_dedup.MIN_WORDS, collections.defaultdict(set)
    for d, words in texts.items():
        for at in range(len(words) - n + 1):
            holders[tuple(words[at:at + n])].add(d)
    beyond = total = 0
    for d, words in texts.items():
        brute = set()
        for at in range(len(words) - n + 1):
            if len(holders[tuple(words[at:at + n])]) > 1:
                brute |= set(range(at, at + n))
        # a passage is found by a whole paragraph inside it; then it is found to its last word
        assert planted[d] <= brute
        assert removed[d] == (reported[d] if d % 2 else set())
        beyond, total = beyond + len((reported[d] or brute) ^ brute), total + len(brute)
    # similar paragraphs of 0.8 or more may differ in a word at their ends
    assert beyond <= 0.005 * total
    assert sum(map(bool, reported.values())) >= 0.99 * len(texts)


def test_edited_passages_are_joined(spark):
    texts, planted, reported, _ = _planted_repeats(spark, 60, 150, edit=True)
    assert sum(bool(reported[d]) for d in texts) >= 0.95 * len(texts)
    assert sum(len(reported[d] & planted[d]) for d in texts) >= 0.8 * sum(map(len, planted.values()))
    assert sum(len(reported[d] - planted[d]) for d in texts) <= 0.01 * sum(map(len, planted.values()))


def test_words_around_a_class_stay_in_one_document(spark):
    """Two later documents share more than the first one has: the first of the two keeps it."""
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(20000)]
    words = lambda k: list(rng.choice(vocabulary, k))
    passage, more = words(40), words(4)
    texts = {1: words(30) + passage + words(30), 2: words(30) + passage + more + words(30), 3: words(30) + passage + more + words(30)}
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    removed = collections.defaultdict(set)
    for r in paragraph_dedup.find_repeats(df).collect():
        if r["removed"]:
            removed[r["doc_id"]] |= set(range(r["removed_start"], r["removed_start"] + r["removed_words"]))
    assert removed == {2: set(range(30, 70)), 3: set(range(30, 74))}


def test_repeats_with_null_and_equal_ids(spark):
    rng = np.random.default_rng(10)
    vocabulary = [f"w{i}" for i in range(20000)]
    text = lambda k: " ".join(rng.choice(vocabulary, k))
    passage = text(60)
    rows = [(None, f"{text(20)} {passage}"), (None, text(90)), (7, f"{passage} {text(20)}"), (7, f"{passage} {text(30)}"), (7, text(50))]
    rows += [rows[2]]
    found = paragraph_dedup.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == {None, 7} and all(58 <= r["passage_words"] <= 62 for r in found)
    assert {r["first_doc_id"] for r in found} == {7}


def test_run_links_equal_brute_force():
    rng = np.random.default_rng(6)
    base = [np.unique(rng.integers(0, 10**6, 30)) for _ in range(4)]
    sets = [np.unique(np.concatenate([rng.choice(b, 27, replace=False), rng.integers(0, 10**6, 2)])) for b in base for _ in range(15)]
    edges = paragraph_dedup.link_run(np.arange(len(sets)), sets)
    parent = list(range(len(sets)))

    def join(pairs):
        out = list(range(len(sets)))
        for a, b in pairs:
            old, new = max(out[a], out[b]), min(out[a], out[b])
            out = [new if p == old else p for p in out]
        return out
    want = join([(i, j) for i in parent for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))])
    assert join(edges) == want


# 6 chat


def test_formats_of_all_layouts(spark):
    records = [
        '{"id": 1, "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "extra": {"a": 1}}',
        '{"id": 2, "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}',
        '{"id": 3, "instruction": "do", "input": "this", "output": "done"}', '{"id": 4, "prompt": "p", "response": null}',
        '{"id": 5, "question": "q", "answer": "a"}', "[1]", None, '{"x": 1}',
    ]
    rows = chat_format.json_to_turns(spark.createDataFrame([(r,) for r in records], "record string")).collect()
    got = collections.defaultdict(list)
    for r in rows:
        got[r["conv_id"]].append((r["role"], r["text"], r["layout"]))
    assert [x[:2] for x in got[1]] == [x[:2] for x in got[2]] == [("user", "hi"), ("assistant", "yo")]
    assert got[3][0] == ("user", "do\n\nthis", "instruction") and got[4][1][:2] == ("assistant", "")
    assert len(got[None]) == 3 and {x[2] for x in got[None]} == {None}


def test_chat_round_trip(spark):
    texts = ["<|im_end|>\n", "a\\n\\\\<\\|im_end|>", "</s>[INST] ok [/INST]", "", None, "𝕏<s><<SYS>>\\"]
    rows = [(c, i, role, t) for c in (1, None) for i, (role, t) in enumerate((r, t) for t in texts for r in ("user", "assistant", "we\nird\\ r", None))]
    turns = chat_format.to_turns(spark.createDataFrame(rows + [(1, 0, "user", texts[0])], "conv_id long, turn long, role string, text string"))
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(turns)).collect()}
    for c in (1, None):
        mine = sorted([(i, r or "", t or "") for k, i, r, t in rows if k == c] + ([(0, "user", texts[0])] if c else []))
        loss = "".join(t for _, r, t in mine if r == "assistant")
        assert back[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in mine).encode()).hexdigest()
        assert (back[c]["loss_sha256"], back[c]["loss_chars"]) == (hashlib.sha256(loss.encode()).hexdigest(), len(loss))
    whole = chat_format.conversations(chat_format.format_turns(turns)).filter("conv_id = 1").first()
    assert "".join(chat_format.unescape(whole["formatted"][s["start"]:s["end"]]) for s in whole["loss_spans"]) == "".join(t or "" for t in texts)


# 7 WARC


def test_warc_revisits_and_lookup(spark):
    big, other = "é" * 600, "y" * 2000
    rows = [(1, "http://www.a.org/x?q=1#f", big), (2, "https://A.org:443/x?q=1", big), (3, None, big), (4, "http://b.org", "small"), (5, "http://b.org/", "small"),
            (None, "http://c.org/\t\n%", other), (6, "http://c.org", None), (7, "http://d.org", other), (7, "http://d.org", other)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    archive = warc.write_archive(pages)
    keys = pages.select(warc.url_key(F.col("url")).alias("url_key"), "page_id")
    got = [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.lookup(archive, keys).collect()]
    assert sorted(got, key=str) == sorted([
        (1, 1200, "revisit", 3), (2, 1200, "revisit", 3), (3, 1200, "response", None), (4, 5, "response", None), (5, 5, "response", None),
        (None, 2000, "revisit", 7), (6, 0, "response", None), (7, 2000, "response", None), (7, 2000, "response", None)], key=str)
    assert keys.first()["url_key"] == "org,a)/x?q=1"
    one = warc.lookup(archive, spark.createDataFrame([("org,b)/", 4), ("zz", 1), ("org,b)/", 99)], "url_key string, page_id long")).collect()
    assert [(r["page_id"], bytes(r["payload"])) for r in one] == [(4, b"small")]
    empty = warc.write_archive(pages.limit(0))
    assert warc.lookup(empty, keys).count() == 0


def test_warc_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/", f"<p>{i}") for i in range(200)], "page_id long, url string, html string")
    archive = warc.write_archive(pages)
    found = warc.lookup(archive, archive.captures().select("url_key", "page_id")).collect()
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in found) == [(i, f"<p>{i}") for i in range(200)]


# 8 language model


def test_context_tree_is_a_distribution():
    rng = np.random.default_rng(8)
    runs = [r for (own, _), _ in ctw.pieces([bytes(rng.choice(list(b"abc "), 300).tolist())]) for r in own]
    keys, n = np.unique(np.array(runs, dtype=np.uint64), return_counts=True)
    context = keys[0] >> np.uint64(8) << np.uint64(8)
    every = np.union1d(keys, context | np.arange(256, dtype=np.uint64))
    counts = np.zeros(len(every), dtype=np.int64)
    counts[np.searchsorted(every, keys)] = n
    p, _ = ctw.subtrees(every, counts)
    rows = p[np.searchsorted(every, context | np.arange(256, dtype=np.uint64))]
    assert math.isclose(np.where(np.isnan(rows), 0.5, rows).prod(axis=1).sum(), 1, abs_tol=1e-9)


def test_kt_block_probability():
    def slow(zeros, ones):
        p = 1.0
        for a in range(zeros):
            p *= (a + 0.5) / (a + 1)
        for b in range(ones):
            p *= (b + 0.5) / (zeros + b + 1)
        return math.log(p)
    for zeros, ones in ((0, 0), (1, 0), (3, 5), (20, 1)):
        assert math.isclose(ctw.kt_log(np.array([zeros]), np.array([ones]))[0], slow(zeros, ones), abs_tol=1e-8)


def test_language_model_base_against_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in queries.op8_context_tree(spark, SF).collect()}
    count, total = collections.Counter(), 0
    for i, t in docs.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            tokens = words(t.translate(LOWER)) + [None]
            count.update(tokens)
            total += len(tokens)
    for i, t in docs.items():
        tokens = words(t.translate(LOWER)) + [None]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in tokens)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(count[w] > 0 for w in tokens), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)


def test_language_model_edges(spark, edge, monkeypatch):
    rows = ctw.score(edge).collect()
    assert len(rows) == 11 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert len({r["score"] for r in rows if r["n_tokens"] == 1}) == 1
    assert ctw.score(edge.limit(0)).count() == 0
    untrained = ctw.score(spark.createDataFrame([(i, "ab") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string"))
    assert {round(r["score"], 6) for r in untrained.collect()} == {round(-24 * math.log10(2), 6)}


# 9 rules


def brute_rules(text):
    w = words(text)
    windows = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    repeated = {p for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeated), failed


def test_rules_against_brute_force(spark, docs, edge):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for r in queries.op9_quality_rules(spark, SF).collect():
        assert tuple(r[c] for c in columns) == brute_rules(docs[r["doc_id"]])
    rows = domain_rules.apply_rules(edge, [0] * 64).collect()
    assert sorted(tuple(r[c] for c in columns) for r in rows) == sorted(brute_rules(r["text"]) for r in edge.collect())
    assert all(r["kept"] != r["base_failed"] for r in rows)
    assert domain_rules.fit_weights(edge.limit(0), edge.select("doc_id")) == [0] * domain_rules.BUCKETS


def test_ratio_against_brute_force(spark):
    rows = [(1, "a b a"), (2, "c c d"), (3, "a b"), (4, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    weights = domain_rules.fit_weights(frame, domain_rules.trusted_ids(labels), buckets=1 << 16)
    grams = {i: [w for w in words(t)] + list(zip(words(t), words(t)[1:])) for i, t in rows}
    raw = collections.Counter(g for v in grams.values() for g in v)
    target = collections.Counter(grams[1])
    scale = sum(target.values()) / sum(raw.values())
    want = sum(math.log((target[g] + 10) / (raw[g] * scale + 10)) for g in grams[1]) / len(grams[1])
    got = {r["doc_id"]: r["log_ratio"] for r in domain_rules.apply_rules(frame, weights).collect()}
    assert math.isclose(got[1], want, abs_tol=1e-5) and got[4] == 0


def test_toxic_words_in_good_text_are_rejected(spark, tmp_path):
    rng = np.random.default_rng(9)
    good, junk, toxic = [f"w{i}" for i in range(400)], [f"j{i}" for i in range(400)], ["idiot", "moron", "scum"]
    docs, labels = [], []
    for i in range(900):
        kind = ("clean", "clean", "clean", "toxic", "junk")[int(rng.integers(5))]
        w = list(rng.choice(junk if kind == "junk" else good, 120))
        if kind == "toxic":
            w[40:100:15] = list(rng.choice(toxic, 4))
        docs.append((i, " ".join(w), kind))
        if zlib.crc32(str(i).encode()) % 5:  # the fold 0 has no labels
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r["doc_id"]: r["kept"] for r in queries.op9_quality_rules(spark, str(tmp_path)).collect()}
    held = {k: [kept[i] for i, _, kind in docs if kind == k and zlib.crc32(str(i).encode()) % 5 == 0] for k in ("clean", "toxic", "junk")}
    assert np.mean(held["clean"]) >= 0.95 and np.mean(held["toxic"]) <= 0.05 and np.mean(held["junk"]) <= 0.05


def test_best_step():
    assert domain_rules.best_step([(3, 5, 0), (1, 0, 4), (2, 1, 1)]) == 2
    assert domain_rules.best_step([(1, 0, 4)]) is None and domain_rules.best_step([]) is None


# 10 sharding


@pytest.mark.parametrize("n", [1, 2, 3, 24, 1000, 65537])
def test_permutation(n):
    image = feistel.permute(np.arange(n), n)
    assert sorted(image.tolist()) == list(range(n))
    assert (feistel.permute(image, n, back=True) == np.arange(n)).all()
    shard, slot = feistel.locate(n - 1, n)
    assert feistel.number_at(shard, slot, n) == n - 1


def test_shards_are_level_and_gapless(spark, edge):
    for frame in (spark.read.parquet(f"{SF}/documents.parquet"), edge):
        rows = feistel.shard_rows(frame).collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r["slot"])
        sizes = [len(by[s]) for s in range(24)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
        again = feistel.shard_rows(frame.repartition(3)).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))
    assert feistel.shard_rows(edge.limit(0)).count() == 0
    crc = {r["doc_id"]: r for r in queries.op10_shard(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect():
        data = r["text"].encode()
        assert (crc[r["doc_id"]]["text_crc32"], crc[r["doc_id"]]["size"]) == (zlib.crc32(data), len(data) + 8)


# pipeline


def test_pipeline_against_brute_force(spark, docs):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = T.stored(stages["quality classifier"](spark, base, SF), "t1")
    ids = sorted(r["doc_id"] for r in good.collect())
    kept = T.stored(stages["near duplicates"](spark, good, SF), "t2")
    parent = brute_groups([brute_print(docs[i]) for i in ids])
    firsts = sorted({parent[k]: ids[k] for k in reversed(range(len(ids)))}.values())
    assert sorted(r["doc_id"] for r in kept.collect()) == firsts
    clean = T.stored(stages["decontamination"](spark, kept, SF), "t3")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    expect = []
    for i in firsts:
        n, hit, _ = brute_hits(docs[i], items)
        if not (hit > 0 and 20 * hit >= n):
            expect.append(i)
    assert sorted(r["doc_id"] for r in clean.collect()) == expect
    mixed = T.stored(stages["mixing"](spark, clean, SF), "t4")
    assert mixed.columns == base.columns
    size = {r["doc_id"]: (r["source"], len(words(r["text"]))) for r in clean.collect()}
    sums, taken = collections.Counter(), collections.Counter()
    for source, n in size.values():
        sums[source] += n
    for r in mixed.collect():
        taken[r["source"]] += size[r["doc_id"]][1]
    longest = max(n for _, n in size.values())
    assert all(abs(taken[s] - goal) <= longest for s, goal in source_mix.targets(dict(sums)).items())
    final = stages["sharding"](spark, mixed, SF)
    assert final.count() == mixed.count() and corpus_pipeline.run(spark, SF).count() == mixed.count()


@pytest.mark.parametrize("texts", [["a b"], ["a b c"], ["a", None, "b"], ["a"], ["a b c d"], [""], [None]])
def test_paragraphs_of_batches_with_few_words(texts):
    words, owner = paragraph_dedup.word_hashes([(t or "").encode() for t in texts])
    starts = paragraph_dedup.paragraphs(words, owner) if len(words) else np.zeros(0, dtype=np.int64)
    if len(words):
        with np.errstate(over="ignore"):
            grams = paragraph_dedup.shingles(words, starts)
        assert (grams[starts] != paragraph_dedup.LAST).all()


def test_repeats_where_every_partition_has_one_tiny_text(spark):
    texts = ["a b", "a b c", "a", None, "", "a b c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    assert paragraph_dedup.find_repeats(df).count() == 0


def test_remove_spans_beside_columns_of_its_own_names(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(1, f"before {passage} after", 5, "x"), (2, "clean text", 6, "y")], "doc_id long, text string, _hit_spans int, _hit_id string")
    out = decontaminate.remove_spans(docs, spark.createDataFrame([("i", passage)], "item_id string, text string"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "before after", 5, "x"), (2, "clean text", 6, "y")]


def test_mixed_words_against_sql(spark):
    def without_shards(spark, sf_dir):
        return queries.op2_mix_sources(spark, sf_dir).drop("mix_shards")

    assert compare.check(spark, compare.connect(SF), without_shards, oracle.OP2, SF) is None
    rows = queries.op2_mix_sources(spark, SF).collect()
    assert all(r["taken"] == r["size"] * len([s for s in r["mix_shards"].split(",") if s]) for r in rows)


def test_shards_of_the_mix_hold_their_quotas(spark):
    counts, words_each, shards = {"a": 40, "b": 300, "c": 90}, 10, 4
    rows = [(i, s, " ".join(["w"] * words_each)) for s, n in counts.items() for i in range(n)]
    mixed = source_mix.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), shards=shards, block_words=words_each).collect()
    goal = source_mix.targets({s: n * words_each for s, n in counts.items()})
    blocks = [int(goal[s] / words_each // counts[s]) * counts[s] for s in counts]
    quotas = [b + int((goal[s] - b * words_each) // words_each) + 1 if goal[s] > b * words_each else b for s, b in zip(counts, blocks)]
    drawn = source_mix.split_quotas(quotas, shards)
    for i, s in enumerate(counts):
        got = [sum(r["source"] == s and r["mix_shard"] == k for r in mixed) for k in range(shards)]
        # the last block of a partial pass is taken if half of it is inside
        assert all(0 <= want - have <= 1 for want, have in zip(drawn[i].tolist(), got)) and sum(drawn[i]) - sum(got) <= 1


def test_texts_without_words_keep_to_the_limit_of_the_mix(spark):
    rows = [(i, "a", t) for i, t in enumerate(["x y", "", None, " ", ""])] + [(i, "b", "w " * 500) for i in range(9, 30)]
    mixed = source_mix.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    takes = collections.Counter(r["doc_id"] for r in mixed)
    assert all(takes[i] <= 3 for i in range(5)) and takes[0] == 3


MAPPED = "doc_id long, text string, source string, _row_hash string, tags map<string,int>"


def test_map_columns_and_clashing_names(spark):
    rows = [(1, "a b c d", "s", "u", {"x": 1, "y": 2}), (1, "a b c d", "s", "u", {"y": 2, "x": 1}), (2, "other words here", "s", "v", None)]
    df = spark.createDataFrame(rows, MAPPED)
    kept = simhash.keep_one(df)
    assert kept.schema == df.schema and sorted((r["doc_id"], r["_row_hash"]) for r in kept.collect()) == [(1, "u"), (2, "v")]
    mixed = source_mix.mix(df)
    assert mixed.schema["tags"].dataType == df.schema["tags"].dataType
    assert sorted((r["doc_id"], str(sorted((r["tags"] or {}).items()))) for r in mixed.collect()) == sorted((r[0], str(sorted((r[4] or {}).items()))) for r in rows)
    placed = feistel.shard_rows(df, shards=2)
    assert sorted(r["slot"] * 2 + r["shard"] for r in placed.collect()) == [0, 1, 2]
    assert {str(r["tags"]) for r in placed.filter("doc_id = 2").collect()} == {"None"}


def test_json_records_of_unexpected_values(spark):
    records = [
        '{"id": "12", "prompt": 5, "response": true}', '{"id": "x", "prompt": "p", "response": "r"}', '{"id": 3, "messages": []}',
        '{"id": 4, "messages": [{"role": "user", "content": "hi"}, "stray"]}', '{"id": 5, "messages": [{"role": 7, "content": {"a": [1]}}, {"role": "user", "content": "q"}]}',
        '{"id": 6, "instruction": "do", "input": 0, "output": null}', '{"id": 99999999999999999999, "question": "q", "answer": "\\ud800"}',
        "[" * 100_000, '{"messages[].role": 1, "messages[].content": 2, "id": 8}', '{"id": 9.5, "question": [], "answer": "a"}', "",
    ]
    rows = chat_format.json_to_turns(spark.createDataFrame([(r,) for r in records], "record string")).collect()
    got = collections.defaultdict(list)
    for r in rows:
        got[r["conv_id"]].append((r["role"], r["text"], r["layout"]))
    assert got[12] == [("user", "5", "prompt"), ("assistant", "true", "prompt")]
    assert got[3] == [("", "", None)] and got[4] == [("", "", None)] and got[8] == [("", "", None)]
    assert got[5] == [("7", '{"a": [1]}', "messages"), ("user", "q", "messages")]
    assert got[6] == [("user", "do\n\n0", "instruction"), ("assistant", "", "instruction")]
    assert ("assistant", "\ufffd", "question") in got[None] and ("user", "p", "prompt") in got[None]


@pytest.mark.parametrize("role", ["\\\u2028", "\u2028", "\n", "\\\n\\", "\\\\\u2028n", "\\n", "<|im_end|>\n"])
def test_roles_come_back(spark, role):
    turns = spark.createDataFrame([(1, 0, role, "\\\u2028 t")], chat_format.TURNS)
    row = chat_format.read_back(chat_format.format_turns(turns)).first()
    assert row["turns_sha256"] == hashlib.sha256(f"{role}\n\\\u2028 t\n".encode()).hexdigest()


def test_quality_training_reads_whole_texts_as_scored():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.choice(list(b"ab AB!\n#"), n).tolist()) for n in (0, 1, 511, 512, 513, 40_000)]
    together, owner = mil_quality.encode(texts)
    for i, text in enumerate(texts):
        assert (mil_quality.features(text) == together[owner == i]).all()
    assert len(mil_quality.features(texts[-1])) == 79


def test_quality_sample_is_of_labelled_documents(spark):
    docs = spark.createDataFrame([(i, f"text {i} words") for i in range(40)] + [(40, "long " * 1000), (7, "second row")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5000)], "doc_id long, quality int")
    seen = {}

    def train(x, owner, label):
        seen["n"] = len(label)
        return mil_quality.Model(np.zeros(mil_quality.WIDTH), np.ones(mil_quality.WIDTH), None)

    original, mil_quality.train = mil_quality.train, train
    try:
        folds = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(41))
        mil_quality.fit(docs, labels)
        assert seen["n"] == folds
        mil_quality.fit(docs, labels, docs=10)
        assert seen["n"] == 10
        mil_quality.fit(docs, labels, longest=100)
        assert seen["n"] == folds - (zlib.crc32(b"40") % 5 != 0)
    finally:
        mil_quality.train = original


def test_partitions_of_one_tiny_text(spark, tmp_path):
    texts = [None, "", "a", "a b", "a b c", "a b c d", "a b c d e", " ", "\n"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(9)
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    assert mil_quality.score(df, mil_quality.fit(df, labels)).count() == 9
    assert len({r["doc_id"] for r in source_mix.mix(df).collect()}) == 9
    assert decontaminate.contaminated(decontaminate.find_hits(df, bench)).count() == 9
    assert simhash.groups(df).count() == 9
    assert paragraph_dedup.find_repeats(df).count() == 0
    assert ctw.score(df).count() == 9
    rules = domain_rules.fit(df, labels)
    assert domain_rules.apply_rules(df, rules.weights, rules.threshold, word_weights=rules.word_weights, word_threshold=rules.word_threshold).count() == 9
    assert feistel.shard_rows(df).count() == 9
    turns = df.selectExpr("doc_id AS conv_id", "doc_id AS turn", "'user' AS role", "coalesce(text, '') AS text")
    assert chat_format.read_back(chat_format.format_turns(turns)).count() == 9


def test_long_words_with_permuted_tails_differ():
    rng = np.random.default_rng(5)
    tail = list(b"abcdefghij" * 30)
    texts = [b"x" * 128 + bytes(rng.permutation(tail).tolist()) for _ in range(50)]
    with np.errstate(over="ignore"):
        hashes, _ = paragraph_dedup.word_hashes(texts)
        again, _ = paragraph_dedup.word_hashes([b"before " + texts[0]])
    assert len(set(hashes.tolist())) == len(set(texts)) == 50 and again[1] == hashes[0]
