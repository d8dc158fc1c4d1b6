"""Substring dedup: paragraph MinHash banding.

A repeated passage may begin and end inside other lines, so paragraphs are cut by
content: before every word whose hash is the least among ``RADIUS`` words on both sides.
A passage that is in two documents is thus cut at the same words in both, but for its
first and last few.

1. Every paragraph gets its hash and one MinHash per band over its five-word shingles.
   Equal paragraphs are merged.
2. One row per distinct paragraph and band is sorted by MinHash; members of a run of equal
   values are candidates, but for those whose sketches rule out every other member. A band of one row finds a pair of similarity 0.8 with probability
   0.8, three bands with 0.992.
3. Candidates of a run are verified by the exact Jaccard similarity of their shingle
   sets, and linked. A run is searched from pivots until all but its largest set have
   been compared with every member, so no link between different sets is lost and a run
   of similar paragraphs needs no all-pairs search.
4. Links are joined to components. A paragraph is repeated if its class is in two
   documents or more.
5. A passage goes on beyond its outermost cuts. From every border of a repeated stretch
   the prefixes of the words outside are hashed with the paragraph's class; the longest
   prefix found in two documents is added. The words up to the next cut and ``RADIUS``
   more are enough: if more agreed, the next paragraph would be repeated itself.
6. Stretches of one document with an edit between them are one passage if two documents
   hold their classes in that order and the five-word shingles of the joined passage
   that lie in the stretches are ``SIMILARITY`` of the union. Passages of at least
   ``MIN_WORDS`` words are reported. Removals are all but the class's first place, with
   the words around it that an earlier document has there too.

Words and paragraphs are compared by 64-bit hashes, A-Z in lower case.

Defined cases: null and empty texts have no paragraphs; texts of fewer than five words
are one shingle; repeats inside one id alone are not reported, and all rows with a null
id have one id in this; rows of equal id and text are one document, of equal id and
unequal text documents with passages of their own; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom import runtime
from clickloom.llm import components
from clickloom.llm import text as T

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 5
BANDS = 3
MIN_WORDS = 16
#: Documents up to this number are broadcast when their shingles are fetched again.
BROADCAST_DOCS = 2_000_000
#: So are classes up to this number when their borders are sought.
BROADCAST_CLASSES = 200_000
#: Borders beyond this number with the same first word outside are not brought together.
BUSY_BORDERS = 10_000
#: In runs up to this number the sketches of all pairs are compared.
PAIRED_RUN = 128
SLICE = 1 << 20
#: Stands for a null id among ids; the largest, so that a real id is a class's first.
NULL_ID = (1 << 63) - 1

SPACE = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
#: Random odd multipliers, drawn from fixed seeds.
BYTE_HASH = np.where(SPACE, np.uint64(0), np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64))
PLACE_HASH = np.random.default_rng(12).integers(1, 1 << 63, 128, dtype=np.uint64) | np.uint64(1)
BAND_KEYS = np.random.default_rng(13).integers(1, 1 << 63, 16, dtype=np.uint64)
#: Multipliers of a common 64-bit finaliser.
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts in order, and the text of each word."""
    data = np.frombuffer(b"\n".join(texts).translate(T.ASCII_LOWER), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    space = SPACE[data]
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(begin):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    place = np.arange(len(data)) - np.repeat(np.append(0, begin), np.diff(np.concatenate([[0], begin, [len(data)]])))
    values = BYTE_HASH[data] * PLACE_HASH[np.minimum(place, len(PLACE_HASH) - 1)]
    far = np.flatnonzero(place >= len(PLACE_HASH))
    if len(far):
        # the table ends here; the few bytes of very long words get a multiplier of their own place
        values[far] = BYTE_HASH[data[far]] * (_mix(place[far].astype(np.uint64)) | np.uint64(1))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return _mix(np.add.reduceat(values, begin)), np.searchsorted(ends, begin, side="right")


def paragraphs(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Index of the first word of every paragraph; ``owner`` is the text of each word, sorted."""
    n = len(words)
    least = np.ones(n, dtype=bool)
    for lag in range(1, RADIUS + 1):
        if lag >= n:
            least[:] = False
            break
        # a word with fewer neighbours on one side inside its text is no cut
        inside = owner[lag:] == owner[:-lag]
        least[lag:] &= inside & (words[lag:] < words[:-lag])
        least[:-lag] &= inside & (words[:-lag] < words[lag:])
        least[:lag] = False
        least[-lag:] = False
    least[np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))] = True
    return np.flatnonzero(least)


def shingles(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of the five words from every place; ``LAST`` where they leave the paragraph.

    A paragraph of fewer words has one shingle, of all its words, at its start.
    """
    n = len(words)
    lengths = np.diff(np.append(starts, n))
    left = np.repeat(starts + lengths, lengths) - np.arange(n)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, n)):
        out[:n - k] += words[k:] * PLACE_HASH[k]
    out = np.minimum(_mix(out), LAST - np.uint64(1))
    out[left < SHINGLE] = LAST
    short = lengths < SHINGLE
    out[starts[short]] = np.minimum(whole(words, starts)[short], LAST - np.uint64(1))
    return out


def whole(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of every paragraph: a sum of its words weighted by their places."""
    lengths = np.diff(np.append(starts, len(words)))
    place = (np.arange(len(words)) - np.repeat(starts, lengths)).astype(np.uint64)
    return _mix(np.add.reduceat(_mix(words + _mix(place + np.uint64(1))), starts) + lengths.astype(np.uint64))


def _blocks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a column, about ``SLICE`` bytes at a time, with the index of the first."""
    at, texts, size = 0, [], 0
    for i, value in enumerate(column):
        data = (value.as_py() or "").encode("utf-8", "surrogatepass")
        if texts and size + len(data) > SLICE:
            yield at, texts
            at, texts, size = i, [], 0
        texts.append(data)
        size += len(data)
    if texts:
        yield at, texts


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            ids, docs = batch.column(0), batch.column(1)
            for at, texts in _blocks(batch.column(2)):
                words, owner = word_hashes(texts)
                if not len(words):
                    continue
                starts = paragraphs(words, owner)
                grams = shingles(words, starts)
                doc = owner[starts]
                first = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1])
                counts = np.diff(np.append(first, len(doc)))
                bands = []
                for band in range(BANDS):
                    mixed = _mix(grams ^ BAND_KEYS[band])
                    mixed[grams == LAST] = LAST
                    bands.append((np.minimum.reduceat(mixed, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32))
                some = grams != LAST
                bits = np.where(some, np.uint32(256) << ((grams >> np.uint64(32)) * np.uint64(24) >> np.uint64(32)).astype(np.uint32), np.uint32(0))
                sketch = np.bitwise_or.reduceat(bits, starts) | np.minimum(np.add.reduceat(some.astype(np.uint32), starts), 255).astype(np.uint32)
                columns = [
                    ids.take(pa.array(at + doc)), docs.take(pa.array(at + doc)), pa.array((np.arange(len(doc)) - np.repeat(first, counts)).astype(np.int32)),
                    pa.array((starts - np.repeat(starts[first], counts)).astype(np.int32)), pa.array(np.diff(np.append(starts, len(words))).astype(np.int32)),
                    pa.array(whole(words, starts).view(np.int64)), *[pa.array(b) for b in bands], pa.array(sketch.view(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "doc", "paragraph", "start", "n_words", "hash", *[f"band_{b}" for b in range(BANDS)], "sketch"])


def keyed(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id`` (``NULL_ID`` for null), ``doc`` (a hash of id and text) and ``text``."""
    own, words = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")
    return documents.select(F.coalesce(own, F.lit(NULL_ID)).alias("id"), F.xxhash64(own, words).alias("doc"), words.alias("text"))


def cut_paragraphs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every paragraph's ``id``, ``doc``, number, first word, words, hash, MinHash values and ``sketch``.

    A sketch has 24 bits, of which every shingle sets one by its hash, and below these the
    number of shingles, or 255.
    """
    kind = "id long, doc long, paragraph int, start int, n_words int, hash long, " + "".join(f"band_{b} int, " for b in range(BANDS))
    return keyed(documents, doc_id, text).mapInArrow(_cut, kind + "sketch int")


def colliding(distinct: DataFrame) -> DataFrame:
    """``run`` and ``hash`` of the distinct paragraphs that share a MinHash value with one they may be similar to.

    Runs of the same members in several bands are one run.
    """
    # band and value in one number, which is sorted by its bits
    values = F.array(*[F.lit(b << 32) + F.col(f"band_{b}") for b in range(BANDS)])
    rows = distinct.select(F.explode(values).alias("value"), "hash", "sketch")
    rows = rows.repartition("value").sortWithinPartitions("value")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(3)]
            held = new if held is None else [np.concatenate(pair) for pair in zip(held, new)]
            cuts = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
            if len(cuts):
                yield _shared(*[h[:cuts[-1]] for h in held])
                held = [h[cuts[-1]:] for h in held]
        if held is not None:
            yield _shared(*held)

    return rows.mapInArrow(runs, "run long, hash long").distinct()


def _shared(value: np.ndarray, members: np.ndarray, sketches: np.ndarray) -> pa.RecordBatch:
    change = np.concatenate([[True], value[1:] != value[:-1]])[:len(value)]
    run = np.cumsum(change) - 1
    keep = _paired(np.bincount(run, minlength=0), sketches.view(np.uint32))
    run, members = run[keep], members[keep]
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])[:len(run)])
    with np.errstate(over="ignore"):
        name = np.add.reduceat(_mix(members.view(np.uint64)), starts) if len(starts) else np.zeros(0, dtype=np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(name, np.diff(np.append(starts, len(run)))).view(np.int64)), pa.array(members)], ["run", "hash"])


def _paired(lengths: np.ndarray, sketches: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Which members of some runs may be similar to another member of theirs.

    Sets of a and b shingles with this similarity differ in (1 - s) / (1 + s) * (a + b) at
    most, and every bit in which two sketches differ is a shingle that one of them lacks.
    So no similar pair is lost; 255 shingles and more allow all bits to differ. Runs of more than ``PAIRED_RUN`` are kept whole.
    """
    keep = np.repeat(lengths > PAIRED_RUN, lengths)
    size, bits = (sketches & np.uint32(255)).astype(np.float64), sketches >> np.uint32(8)
    after = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(keep))
    at = np.flatnonzero(~keep)
    for lag in range(1, PAIRED_RUN):
        at = at[after[at] > lag]
        if not len(at):
            break
        apart = np.bitwise_count(bits[at] ^ bits[at + lag])
        near = at[apart <= (1 - similarity) / (1 + similarity) * (size[at] + size[at + lag]) + 1e-9]
        keep[near] = keep[near + lag] = True
    return keep


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct shingles of every paragraph."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for _, texts in _blocks(batch.column(0)):
                words, owner = word_hashes(texts)
                if not len(words):
                    continue
                starts = paragraphs(words, owner)
                grams = shingles(words, starts)
                home = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
                home, grams = home[grams != LAST], grams[grams != LAST]
                order = np.lexsort([grams, home])
                home, grams = home[order], grams[order]
                new = np.concatenate([[True], (home[1:] != home[:-1]) | (grams[1:] != grams[:-1])])
                home, grams = home[new], grams[new]
                offsets = np.searchsorted(home, np.arange(len(starts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(whole(words, starts).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams.view(np.int64)))], ["hash", "grams"])


def verified_links(candidates: DataFrame, distinct: DataFrame, documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Edges (``a``, ``b``) that connect all candidates of a run with similarity of at least ``SIMILARITY``."""
    members = candidates.select("hash").distinct()
    # one document of each paragraph is cut again for its shingles
    places = distinct.select("hash", "first").join(members, "hash", "left_semi")
    wanted = T.broadcast_within(places.select(F.col("first").alias("id")).distinct(), BROADCAST_DOCS)
    rows = keyed(documents, doc_id, text).join(wanted, "id", "left_semi").select("text")
    sets = rows.mapInArrow(_sets, "hash long, grams array<long>").join(members, "hash", "left_semi").dropDuplicates(["hash"])
    runs = candidates.join(sets, "hash").repartition("run").sortWithinPartitions("run", "hash").select("run", "hash", "grams")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, hashes, grams = None, [], []

        def edges() -> pa.RecordBatch:
            pairs = link_run(np.array(hashes, dtype=np.int64), grams)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            lists = batch.column(2)
            flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i, (name, value) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if name != run and hashes:
                    yield edges()
                    hashes, grams = [], []
                run = name
                hashes.append(value)
                grams.append(flat[offsets[i]:offsets[i + 1]])
        if hashes:
            yield edges()

    return runs.mapInArrow(link, "a long, b long").distinct()


def link_run(hashes: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Star edges of the components that similar sets of one run form."""
    n = len(sets)
    if n < 2:
        return []
    size = np.array([len(s) for s in sets])
    flat, home = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, home = flat[order], home[order]
    parent = np.arange(n)

    def similar(i: int) -> np.ndarray:
        low, high = np.searchsorted(flat, sets[i]), np.searchsorted(flat, sets[i], side="right")
        common = np.bincount(np.concatenate([home[a:b] for a, b in zip(low, high)]), minlength=n)
        return np.flatnonzero(common >= similarity * (size + size[i] - common) - 1e-9)

    def compare(i: int) -> np.ndarray:
        near = similar(i)
        roots = np.unique(parent[near])
        if len(roots) > 1:
            parent[np.isin(parent, roots)] = roots.min()
        return near

    open_ = np.ones(n, dtype=bool)
    compared = np.zeros(n, dtype=bool)
    while open_.any():
        pivot = int(np.argmax(open_))
        open_[compare(pivot)] = False
        open_[pivot] = False
        compared[pivot] = True
    roots, counts = np.unique(parent, return_counts=True)
    if len(roots) > 1:
        largest = roots[np.argmax(counts)]
        for i in np.flatnonzero((parent != largest) & ~compared):
            compare(int(i))
    child = np.flatnonzero(parent != np.arange(n))
    return list(zip(hashes[child].tolist(), hashes[parent[child]].tolist()))


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all prefixes of the words outside each border, with the class of the paragraph inside."""
    names = ["id", "doc", "paragraph", "side", "keys"]
    with np.errstate(over="ignore"):
        for batch in batches:
            borders = batch.column(3)
            for at, texts in _blocks(batch.column(2)):
                words, owner = word_hashes(texts)
                starts = paragraphs(words, owner)
                mine = borders.slice(at, len(texts))
                text = np.repeat(np.arange(len(texts)), mine.value_lengths().to_numpy())
                number, side, root = (mine.flatten().field(i).to_numpy() for i in range(3))
                low, high = np.searchsorted(owner, text), np.searchsorted(owner, text, side="right")
                # a paragraph's first word and the first words of those around it, inside its text
                place = np.searchsorted(starts, low) + number
                edge = np.append(starts, len(words))
                cut = lambda k: np.clip(edge[np.clip(place + k, 0, len(starts))], low, high)
                after = np.minimum(cut(2) + RADIUS, high) - cut(1)
                before = cut(0) - np.maximum(np.where(number > 0, cut(-1), low) - RADIUS, low)
                lengths = np.where(side > 0, after, before)
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                step = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
                word = np.where(np.repeat(side > 0, lengths), np.repeat(cut(1), lengths) + step, np.repeat(cut(0), lengths) - 1 - step)
                sums = np.append(np.uint64(0), np.cumsum(_mix(words[word] + _mix(step.astype(np.uint64) + np.uint64(1)))))
                prefix = sums[1:] - np.repeat(sums[offsets[:-1]], lengths)
                inside = np.repeat(_mix(root.astype(np.int64).view(np.uint64) ^ BAND_KEYS[-1]) + side.astype(np.int64).view(np.uint64), lengths)
                keys = _mix(prefix + _mix(inside + step.astype(np.uint64) * MIX_1))
                row = pa.array(at + text)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(row), batch.column(1).take(row), pa.array(number.astype(np.int32)), pa.array(side.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys.view(np.int64)))], names)


def extensions(repeated: DataFrame, documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Words beyond the borders of repeated stretches that two documents have there.

    ``id``, ``doc``, ``paragraph``, ``before`` and ``after``; of these ``old_before`` and
    ``old_after`` are in a document with a smaller id.
    """
    # where one place of a class has a border, its other places are compared too, though more follows them
    sides = ("open_before", "open_after")
    mixed = repeated.groupBy(F.col("root").alias("m_root")).agg(
        *[(F.max(F.col(c).cast("int")) != F.min(F.col(c).cast("int"))).alias(f"m_{c}") for c in sides]).filter(" OR ".join(f"m_{c}" for c in sides))
    mixed = T.broadcast_within(T.stored(mixed, "mixed-borders"), BROADCAST_CLASSES)
    border = repeated.join(mixed, F.col("root") == F.col("m_root"), "left")
    border = border.withColumns({c: F.col(c) | F.coalesce(f"m_{c}", F.lit(False)) for c in sides}).filter("open_before OR open_after")
    ends = F.filter(F.array(F.when(F.col("open_before"), F.lit(-1)), F.when(F.col("open_after"), F.lit(1))), lambda side: side.isNotNull())
    border = border.select("id", "doc", "paragraph", "root", F.explode(ends).alias("side"))
    # no more than the paragraphs of one text
    by_doc = T.stored(border.groupBy("id", "doc").agg(F.collect_list(F.struct("paragraph", "side", "root")).alias("borders")), "borders")
    wanted = T.broadcast_within(by_doc.select("id", "doc"), BROADCAST_DOCS)
    texts = keyed(documents, doc_id, text).join(wanted, ["id", "doc"], "left_semi").join(by_doc, ["id", "doc"])
    found = texts.select("id", "doc", "text", "borders").mapInArrow(_borders, "id long, doc long, paragraph int, side int, keys array<long>")
    # a border's row stands for its place while the prefixes are compared
    found = T.stored(found.withColumn("border", F.monotonically_increasing_id()), "prefixes")
    longest = _longest_shared(found.select("border", "id", "keys"))
    ends = found.select("border", "id", "doc", "paragraph", "side").join(longest, "border")
    on = lambda side, name: F.max(F.when(F.col("side") == side, F.col(name))).alias
    return ends.groupBy("id", "doc", "paragraph").agg(
        on(-1, "n")("before"), on(1, "n")("after"), on(-1, "old")("old_before"), on(1, "old")("old_after")).fillna(0)


def _longest_shared(borders: DataFrame) -> DataFrame:
    """``border``, ``n`` (words of its longest prefix in two documents) and ``old`` (with a smaller id), where there is one.

    What has a prefix in common has the first word in common, so borders are dealt out by
    that, each with all its prefixes. Where very many have it, every prefix goes by itself.
    """
    rows = borders.filter(F.size("keys") > 0).withColumn("head", F.col("keys")[0])
    busy = F.broadcast(T.stored(rows.groupBy("head").count().filter(F.col("count") > BUSY_BORDERS).select("head"), "busy-borders"))

    def longest(one: DataFrame) -> DataFrame:
        n = F.col("at") + 1
        return one.filter("first <> last").groupBy("border").agg(F.max(n).alias("n"), F.max(F.when(F.col("first") < F.col("id"), n)).alias("old"))

    def prefixes(of: DataFrame) -> DataFrame:
        return of.select("head", "border", "id", F.posexplode("keys").alias("at", "key"))

    same = Window.partitionBy("head", "key")
    dealt = prefixes(rows.join(busy, "head", "left_anti").repartition("head"))
    few = longest(dealt.withColumns({"first": F.min("id").over(same), "last": F.max("id").over(same)}))
    hot = prefixes(rows.join(busy, "head", "left_semi"))
    many = longest(hot.join(hot.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")), "key"))
    return few.unionByName(many)


def passages(stretched: DataFrame, min_words: int) -> DataFrame:
    """``id``, ``doc``, ``stretch`` and ``passage_words`` of all stretches in a passage of ``min_words``."""
    in_doc = Window.partitionBy("id", "doc").orderBy("stretch")
    rows = stretched.groupBy("id", "doc", "stretch").agg(
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.min_by("root", "paragraph").alias("opens"), F.max_by("root", "paragraph").alias("closes"))
    words = F.col("high") - F.col("low")
    whole_grams = lambda n: F.greatest(n - (SHINGLE - 1), F.lit(0))
    rows = rows.withColumns({
        "kept": whole_grams(words) + whole_grams(F.lag(words).over(in_doc)), "all": whole_grams(F.col("high") - F.lag("low").over(in_doc)),
        "left": F.lag("closes").over(in_doc)})
    # both documents have at most (1 + 1 / SIMILARITY) / 2 times the common shingles, so the union is small enough
    rows = T.stored(rows.withColumn("near", F.coalesce(F.col("kept") >= SIMILARITY * (2 * F.col("all") - F.col("kept")) - 1e-9, F.lit(False))), "stretches")
    pairs = rows.filter("near").groupBy(F.col("left").alias("p_left"), F.col("opens").alias("p_right")).agg(F.min("id").alias("f"), F.max("id").alias("l"))
    pairs = pairs.filter("f <> l").select("p_left", "p_right")
    joined = rows.join(pairs, F.col("near") & (F.col("left") == F.col("p_left")) & (F.col("opens") == F.col("p_right")), "left")
    joined = joined.withColumn("passage", F.sum(F.when(F.col("p_left").isNull(), 1).otherwise(0)).over(in_doc))
    whole_passage = Window.partitionBy("id", "doc", "passage")
    joined = joined.withColumn("passage_words", F.max("high").over(whole_passage) - F.min("low").over(whole_passage))
    return joined.filter(F.col("passage_words") >= min_words).select("id", "doc", "stretch", "passage_words")


def find_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per paragraph inside a repeated passage.

    ``doc_id``, ``paragraph``, ``start`` and ``n_words`` (word positions, with the words
    around the paragraph that are repeated too; spans of neighbours may overlap),
    ``passage_words`` (of the whole passage), ``class_id``, ``first_doc_id`` (the smallest
    id that holds the class), ``removed`` (it is not the class's first place), and
    ``removed_start`` and ``removed_words`` (the words that an earlier place has).
    """
    cut, cut_path = T.stored_at(cut_paragraphs(documents, doc_id, text), "paragraphs")
    distinct, distinct_path = T.stored_at(cut.groupBy("hash").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), *[F.min(f"band_{b}").alias(f"band_{b}") for b in range(BANDS)], F.min("sketch").alias("sketch")), "distinct-paragraphs")
    candidates, candidates_path = T.stored_at(colliding(distinct), "colliding")
    roots = components.connected(verified_links(candidates, distinct, documents, doc_id, text))
    classes = distinct.select("hash", "first", "last").join(roots, F.col("hash") == F.col("node"), "left")
    # most classes are one paragraph of one document; they leave before the next shuffle
    classes = classes.withColumn("root", F.coalesce("root", "hash"))
    heads = roots.select(F.col("root").alias("head")).distinct()
    linked = classes.join(heads, F.col("root") == F.col("head"), "left").filter(F.col("head").isNotNull() | (F.col("first") != F.col("last")))
    spans = linked.groupBy("root").agg(F.min("first").alias("class_first"), F.max("last").alias("class_last")).filter("class_first <> class_last")
    repeated = linked.select(F.col("hash").alias("r_hash"), "root").join(spans.withColumnRenamed("root", "r_root"), F.col("root") == F.col("r_root")).select("r_hash", "root", "class_first")

    # equal rows are one document, so a paragraph counts once; one exchange serves this and the neighbours
    in_doc = Window.partitionBy("id", "doc").orderBy("paragraph")
    found = cut.join(repeated, F.col("hash") == F.col("r_hash")).select("id", "doc", "paragraph", "start", "n_words", "root", "class_first")
    found = found.repartition("id", "doc").dropDuplicates(["id", "doc", "paragraph"]).withColumns({
        "open_before": F.coalesce(F.col("paragraph") - F.lag("paragraph").over(in_doc) != 1, F.col("paragraph") > 0),
        "open_after": F.coalesce(F.lead("paragraph").over(in_doc) - F.col("paragraph") != 1, F.lit(True))})
    found = T.stored(found, "repeated")
    for path in (cut_path, distinct_path, candidates_path):
        runtime.remove(documents.sparkSession, path)
    more = ["before", "after", "old_before", "old_after"]
    wide = found.join(extensions(found, documents, doc_id, text), ["id", "doc", "paragraph"], "left").fillna(0, more)
    wide = wide.withColumns({"low": F.col("start") - F.col("before"), "high": F.col("start") + F.col("n_words") + F.col("after")})
    apart = F.coalesce(F.col("low") > F.lag("high").over(in_doc), F.lit(True))
    wide = T.stored(wide.withColumn("apart", apart.cast("int")).withColumn("stretch", F.sum("apart").over(in_doc)), "stretched")
    kept = wide.join(passages(wide, min_words), ["id", "doc", "stretch"])

    place = F.struct("id", "paragraph", "doc")
    first = kept.groupBy("root").agg(F.min(place).alias("f")).select(F.col("root").alias("f_root"), "f")
    kept = kept.join(first, F.col("root") == F.col("f_root")).withColumn("removed", place != F.col("f"))
    # the paragraph itself goes with the words around it that are old; without it these stay too
    around = lambda name: F.when(F.col("removed"), F.col(name)).otherwise(0)
    return kept.select(
        F.nullif("id", F.lit(NULL_ID)).alias("doc_id"), "paragraph", F.col("low").alias("start"), (F.col("high") - F.col("low")).alias("n_words"),
        "passage_words", F.col("root").alias("class_id"), F.nullif("class_first", F.lit(NULL_ID)).alias("first_doc_id"), "removed",
        (F.col("start") - around("old_before")).alias("removed_start"),
        F.when(F.col("removed"), F.col("n_words") + F.col("old_before") + F.col("old_after")).otherwise(0).alias("removed_words"))
