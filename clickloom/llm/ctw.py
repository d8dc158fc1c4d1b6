"""Language-model scoring by context-tree weighting over bytes.

Every byte is eight binary decisions. A node of the tree is a context of up to ``DEPTH``
preceding bytes with the bits decided so far; it estimates the next bit by the
Krichevsky-Trofimov rule, and weighting mixes the estimates of all depths by how well
they coded the training text; depths that training never reached are left out of the
mixture. The tree is fixed after training, so the probability of a
byte depends only on the ``DEPTH`` bytes before it: one number for each run of
``DEPTH + 1`` bytes that occurs anywhere.

1. Tasks count these runs, and words for the unigram base; the counts are summed.
2. Subtrees below the two latest context bytes are weighted bottom-up, each in one group
   (its size is bounded by the alphabet, not by the text). The levels above have at most
   256 * 255 nodes and are weighted on the driver.
3. Documents are cut by hash into chunks of about ``CHUNK_BYTES``. A chunk asks for its
   distinct runs and words through a join and then scores its documents.

Text is scored as the base sees it: A-Z in lower case, words joined by one space, then an
end mark. Both scores are thus probabilities of the same event. Words are matched by a
64-bit hash.

Defined cases: null and empty texts are the end mark alone; a null id belongs to fold 0;
with no training text every bit has probability 1/2; repeated rows are trained on and
scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm import text as T
from clickloom.llm.paragraph_dedup import word_hashes

DEPTH = 5
FOLDS, HELD_OUT = 5, 1
CHUNK_BYTES = 16 << 20
#: Bytes handled at a time inside a task.
PIECE = 1 << 19
#: Distinct keys a task holds before it passes their counts on.
HELD_KEYS = 1 << 19
#: Byte runs of one group of subtrees, on average.
GROUP_RUNS = 250_000
#: Subtree code lengths are summed as integers of this fraction of a nat.
SCALE = 1 << 16

END = 0xFF
PAD = bytes([END]) * DEPTH
RUN, WORD, DOCS, BYTES = 0, 1, 2, 3


def normal_text(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(T.ASCII_LOWER).split())


def word_keys(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all words of some normal texts, and the text that each belongs to, some ``PIECE`` bytes at a time."""
    group, owners, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            # long texts are cut between words
            end = text.find(b" ", at + PIECE) if len(text) - at > PIECE else -1
            part = text[at:end if end >= 0 else len(text)]
            if group and size + len(part) > PIECE:
                yield _keys(group, owners)
                group, owners, size = [], [], 0
            group.append(part)
            owners.append(i)
            size += len(part)
            at += len(part) + 1
    if group:
        yield _keys(group, owners)


def _keys(parts: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray]:
    hashes, owner = word_hashes(parts)
    return hashes.view(np.int64), np.array(owners)[owner]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of some sorted ones and their numbers."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
    return keys[starts], np.diff(np.append(starts, len(keys)))


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Byte runs, and the text that each belongs to (an index below 65,536 in its piece plus an offset).

    A run has the latest context byte in its high byte and the coded byte in its low one.
    """
    group, owners, size = [], [], 0
    for i, text in enumerate(texts):
        data = PAD + text + bytes([END])
        for at in range(DEPTH, len(data), PIECE):
            part = data[at - DEPTH:at + PIECE]
            if group and (size + len(part) > PIECE or len(group) == 65_535):
                yield _runs(group), np.array(owners)
                group, owners, size = [], [], 0
            group.append(part)
            owners.append(i)
            size += len(part)
    if group:
        yield _runs(group), np.array(owners)


def _runs(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint64)
    n = len(data) - DEPTH
    runs = data[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        runs |= data[DEPTH - back:DEPTH - back + n] << np.uint64(8 * (DEPTH + 1 - back))
    inside = np.ones(len(data), dtype=bool)
    starts = np.cumsum(lengths) - lengths
    inside[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    owner = np.repeat(np.arange(len(parts), dtype=np.uint64), lengths)
    return runs[inside[DEPTH:]], owner[DEPTH:][inside[DEPTH:]]


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=int)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def count(documents: DataFrame) -> DataFrame:
    """``kind``, ``key``, ``n``: training counts of byte runs (0 for held-out ones), words, documents, and all bytes.

    ``documents`` has columns ``train`` and ``text``.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, docs, size = [], [], 0, 0, 0
        words, word_counts, held_words = [], [], 0

        def packed(kind, key, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, dtype=np.int32)), pa.array(np.asarray(key, dtype=np.int64)), pa.array(np.asarray(n, dtype=np.int64))], ["kind", "key", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                train = part.column(0).to_numpy(zero_copy_only=False)
                texts = [normal_text(v) for v in part.column(1).to_pylist()]
                size += sum(map(len, texts))
                docs += int(np.count_nonzero(train))
                for hashes, owner in word_keys(texts):
                    some = _counted(np.sort(hashes[train[owner]]))
                    words.append(some[0])
                    word_counts.append(some[1])
                    held_words += len(some[0])
                for (runs, owner), owners in pieces(texts):
                    flags = train[owners].astype(np.uint64)
                    tagged = runs << np.uint64(1) | flags[owner.astype(np.int64)]
                    tagged.sort()
                    starts = np.flatnonzero(np.concatenate([[True], tagged[1:] != tagged[:-1]]))
                    n = np.diff(np.append(starts, len(tagged))) * (tagged[starts] & np.uint64(1)).astype(np.int64)
                    keys.append(tagged[starts] >> np.uint64(1))
                    counts.append(n)
                    held += len(starts)
                if held > 2 * HELD_KEYS:
                    merged = _merged(keys, counts)
                    keys, counts, held = [merged[0]], [merged[1]], len(merged[0])
                    if held > HELD_KEYS:
                        yield packed(RUN, *merged)
                        keys, counts, held = [], [], 0
                if held_words > HELD_KEYS:
                    merged = _merged(words, word_counts)
                    words, word_counts, held_words = [merged[0]], [merged[1]], len(merged[0])
                    if held_words > HELD_KEYS // 2:
                        yield packed(WORD, *merged)
                        words, word_counts, held_words = [], [], 0
        if keys:
            yield packed(RUN, *_merged(keys, counts))
        if words:
            yield packed(WORD, *_merged(words, word_counts))
        yield packed(DOCS, [0], [docs])
        yield packed(BYTES, [0], [size])

    rows = documents.select("train", "text").mapInArrow(tally, "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a block with these counts."""
    zeros, ones = zeros.astype(np.float64), ones.astype(np.float64)
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


def weigh(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log probability of a node, and the weight of its own estimate against its children's."""
    return np.logaddexp(own, below) - np.log(2), 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def subtrees(runs: np.ndarray, n: np.ndarray, top: int = 2) -> tuple[np.ndarray, list[tuple]]:
    """Bottom-up weighting of whole subtrees below ``top`` context bytes.

    ``runs`` is sorted and distinct. Gives each run's probabilities of its eight bits as
    depth ``top`` sees them (NaN where no training text has the node there), and for each bit (index, node keys, zeros, ones, log
    probability) of the nodes at that depth.
    """
    levels, back = {DEPTH: (runs, n)}, {DEPTH: np.arange(len(runs))}
    for d in range(DEPTH - 1, top - 1, -1):
        longer, counts = levels[d + 1]
        shorter = longer >> np.uint64(16) << np.uint64(8) | longer & np.uint64(255)
        keys, inverse = np.unique(shorter, return_inverse=True)
        levels[d] = (keys, np.bincount(inverse, weights=counts, minlength=len(keys)).astype(np.int64))
        back[d] = inverse[back[d + 1]]
    out, nodes = np.zeros((len(runs), 8)), []
    for j in range(8):
        bit = (runs >> np.uint64(7 - j) & np.uint64(1)).astype(bool)
        p = below = below_keys = None
        for d in range(DEPTH, top - 1, -1):
            keys, counts = levels[d]
            node = keys >> np.uint64(8 - j)
            starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            index = np.cumsum(np.concatenate([[0], node[1:] != node[:-1]]).astype(np.int64))
            one = (keys >> np.uint64(7 - j) & np.uint64(1)).astype(np.int64) * counts
            ones, total = np.add.reduceat(one, starts), np.add.reduceat(counts, starts)
            own = kt_log(total - ones, ones)
            here = index[back[d]]
            estimate = (np.where(bit, ones[here], (total - ones)[here]) + 0.5) / (total[here] + 1)
            empty = total[here] == 0
            if d == DEPTH:
                weighted, p = own, np.where(empty, np.nan, estimate)
            else:
                parent = below_keys >> np.uint64(j + 8) << np.uint64(j) | below_keys & np.uint64((1 << j) - 1)
                children = np.bincount(np.searchsorted(node[starts], parent), weights=below, minlength=len(starts))
                weighted, weight = weigh(own, children)
                p = np.where(np.isnan(p), estimate, weight[here] * estimate + (1 - weight[here]) * p)
                p[empty] = np.nan
            below, below_keys = weighted, node[starts]
        out[:, j] = p
        nodes.append((j, below_keys, total - ones, ones, below))
    return out, nodes


def weigh_subtrees(counts: DataFrame, groups: int) -> DataFrame:
    """Rows of byte runs (``p``) and of the nodes two bytes deep (``zeros``, ``ones``, ``log_p``)."""
    runs = counts.filter(F.col("kind") == RUN).select(
        F.pmod(F.xxhash64(F.shiftright("key", 8 * (DEPTH - 1))), F.lit(groups)).alias("g"), "key", "n")
    names = ["key", "j", "zeros", "ones", "log_p", "p"]

    def solve(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy().astype(np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        p, nodes = subtrees(keys, table.column("n").to_numpy()[order])
        none = pa.nulls(len(keys), pa.int64())
        offsets = np.arange(0, 64 * len(keys) + 64, 64, dtype=np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(p.tobytes())])
        parts = [pa.table([pa.array(keys.astype(np.int64)), none.cast(pa.int32()), none, none, none, packed], names)]
        for j, node, zeros, ones, log_p in nodes:
            scaled = np.rint(log_p * SCALE).astype(np.int64)
            parts.append(pa.table([pa.array(node.astype(np.int64)), pa.array(np.full(len(node), j, dtype=np.int32)), pa.array(zeros), pa.array(ones), pa.array(scaled),
                                   pa.nulls(len(node), pa.binary())], names))
        return pa.concat_tables(parts)

    return runs.groupBy("g").applyInArrow(solve, "key long, j int, zeros long, ones long, log_p long, p binary")


class Top:
    """The tree's levels with one context byte and none."""

    def __init__(self, nodes: DataFrame):
        shown = nodes.filter("j is not null").select(
            "j", F.expr("shiftright(key, j + 8)").alias("byte"), F.expr("key & (shiftleft(1L, j) - 1)").alias("prefix"), "zeros", "ones", "log_p")
        rows = shown.groupBy("j", "byte", "prefix").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_p").alias("below")).collect()
        zeros, ones, below = (np.zeros((256, 255), dtype=np.int64) for _ in range(3))
        for r in rows:
            at = (r["byte"], (1 << r["j"]) - 1 + r["prefix"])
            zeros[at], ones[at], below[at] = r["zeros"], r["ones"], r["below"]
        log_p, self.weight_1 = weigh(kt_log(zeros, ones), below / SCALE)
        self.one_1 = np.where(zeros + ones == 0, np.nan, (ones + 0.5) / (zeros + ones + 1))
        _, self.weight_0 = weigh(kt_log(zeros.sum(axis=0), ones.sum(axis=0)), log_p.sum(axis=0))
        self.one_0 = (ones.sum(axis=0) + 0.5) / ((zeros + ones).sum(axis=0) + 1)

    def log10(self, runs: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 probability of the coded byte of every run."""
        latest, coded = (runs >> np.uint64(8 * DEPTH)).astype(np.int64), (runs & np.uint64(255)).astype(np.int64)
        total = np.zeros(len(runs))
        for j in range(8):
            node, bit = (1 << j) - 1 + (coded >> (8 - j)), (coded >> (7 - j) & 1).astype(bool)
            one_1, one_0 = self.one_1[latest, node], self.one_0[node]
            w1, w0 = self.weight_1[latest, node], self.weight_0[node]
            own_1, own_0 = np.where(bit, one_1, 1 - one_1), np.where(bit, one_0, 1 - one_0)
            q = np.where(np.isnan(p[:, j]), own_1, w1 * own_1 + (1 - w1) * p[:, j])
            total += np.log10(np.where(np.isnan(q), own_0, w0 * own_0 + (1 - w0) * q))
        return total


def run_values(nodes: DataFrame, top: Top) -> DataFrame:
    """``kind``, ``key``, ``value``: log10 probability of every byte run."""

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(0).to_numpy()
            p = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float64).reshape(-1, 8)
            value = top.log10(runs.astype(np.uint64), p)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(runs), RUN, dtype=np.int32)), pa.array(runs), pa.array(value)], ["kind", "key", "value"])

    return nodes.filter("j is null").select("key", "p").mapInArrow(mix, "kind int, key long, value double")


def score(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``n_bytes``."""
    rows = documents.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), (T.fold(F.col(f"`{doc_id}`"), folds) != held_out).alias("train"), F.col(f"`{text}`").alias("text"))
    counts = T.stored(count(rows), "counts")
    sums = {r["kind"]: (r["n"], r["rows"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    train_docs, size = sums.get(DOCS, (0, 0))[0], sums.get(BYTES, (0, 0))[0]
    train_tokens = sums.get(WORD, (0, 0))[0] + train_docs
    distinct = sums.get(WORD, (0, 0))[1] + (train_docs > 0)

    nodes = T.stored(weigh_subtrees(counts, 1 + sums.get(RUN, (0, 0))[1] // GROUP_RUNS), "nodes")
    values = run_values(nodes, Top(nodes)).unionByName(
        counts.filter(F.col("kind") == WORD).select("kind", "key", F.col("n").cast("double").alias("value")))

    chunks = 1 + size // CHUNK_BYTES
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    wanted = chunked.groupBy("chunk").applyInArrow(_wanted, "chunk int, kind int, key long")
    found = wanted.join(values, ["kind", "key"]).select("chunk", "kind", "key", "value")
    base = (train_docs, train_tokens, distinct)
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    return chunked.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_scorer(base), kind)


def _wanted(table: pa.Table) -> pa.Table:
    """Distinct byte runs and words of a chunk."""
    seen, words, held = [], [], 0
    for texts in _texts(table):
        words += [_distinct(hashes) for hashes, _ in word_keys(texts)]
        for (runs, _), _ in pieces(texts):
            seen.append(_distinct(runs))
            held += len(seen[-1])
            if held > 2 * HELD_KEYS:
                seen = [_distinct(np.concatenate(seen))]
                held = len(seen[0])
    runs, keys = _distinct(np.concatenate(seen)).astype(np.int64), _distinct(np.concatenate([np.zeros(0, dtype=np.int64), *words]))
    n = len(runs) + len(keys)
    kinds = np.repeat(np.array([RUN, WORD], dtype=np.int32), [len(runs), len(keys)])
    del seen, words
    pa.default_memory_pool().release_unused()
    chunk = pa.array(np.full(n, table.column("chunk")[0].as_py(), dtype=np.int32))
    return pa.table([chunk, pa.array(kinds), pa.array(np.concatenate([runs, keys]))], ["chunk", "kind", "key"])


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order]


def _texts(table: pa.Table) -> Iterator[list[bytes]]:
    for at in range(0, table.num_rows, 512):
        yield [normal_text(v) for v in table.column("text").slice(at, 512).to_pylist()]


def _scorer(base: tuple[int, int, int]):
    train_docs, train_tokens, distinct = base
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]

    def base_log(c):
        return np.log10((c + 0.5) / (train_tokens + 0.5 * (distinct + 1)))

    def score(table: pa.Table, found: pa.Table) -> pa.Table:
        kind, key, value = (found.column(c).to_numpy() for c in ("kind", "key", "value"))
        (runs, log_p), (known, known_n) = (_sorted(key[kind == k], value[kind == k]) for k in (RUN, WORD))
        runs = runs.astype(np.uint64)
        del found, kind, key, value
        pa.default_memory_pool().release_unused()
        n = table.num_rows
        # the end of a text is a token, seen once in each training document
        tokens, hits, sizes = np.ones(n, dtype=np.int64), np.full(n, int(train_docs > 0)), np.zeros(n, dtype=np.int64)
        base_score, total = np.full(n, base_log(float(train_docs))), np.zeros(n)
        at = 0
        for texts in _texts(table):
            here = slice(at, at + len(texts))
            for hashes, owner in word_keys(texts):
                order = np.argsort(hashes)
                one, times = _counted(hashes[order])
                place = np.minimum(np.searchsorted(known, one), max(len(known) - 1, 0))
                c = np.where(known[place] == one, known_n[place], 0.0) if len(known) else np.zeros(len(one))
                each = lambda of: np.bincount(owner[order], weights=np.repeat(of, times), minlength=len(texts))
                tokens[here] += each(np.ones(len(one))).astype(np.int64)
                hits[here] += each(c > 0).astype(np.int64)
                base_score[here] += each(base_log(c))
            sizes[here] = [len(text) for text in texts]
            for (own, owner), owners in pieces(texts):
                tagged = own << np.uint64(16) | owner
                tagged.sort()
                run = tagged >> np.uint64(16)
                starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
                p = np.repeat(log_p[np.searchsorted(runs, run[starts])], np.diff(np.append(starts, len(run))))
                part = np.bincount((tagged & np.uint64(0xFFFF)).astype(np.int64), weights=p, minlength=len(owners))
                np.add.at(total, at + owners, part)
            at += len(texts)
        held = pa.compute.invert(table.column("train"))
        return pa.table([table.column("doc_id"), held, tokens, hits, np.full(n, train_tokens, dtype=np.int64), base_score, total, sizes], names)

    return score
