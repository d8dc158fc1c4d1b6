"""Alignment of two tokenizers by sparse token-byte incidence matrices.

A text is encoded by a byte-level BPE (A, from its JSON file) and a piece BPE with byte
fallback (B, from its model file). For each the incidence matrix has a row per token and
a column per byte, and is held in compressed rows (CSR) made here.

* Overlap links: the row product A times B transposed, by Gustavson's scheme, has the
  number of shared bytes of every pair of tokens that overlap. Those that end at the same
  byte end a group, and are the links whose counts compare the vocabularies.
* Shared-group links: the same product of the token-group incidences. ``links`` gives
  both kinds as rows; the query counts the second from the sizes of the rows alone.

Long texts are cut before single spaces between letters or digits. There both tokenizers
begin a token whatever else the text holds, so the parts are encoded and multiplied one
by one, and memory follows the parts, not the text. A part that has no such place is
taken whole.

Counts of id pairs over the corpus are a sum of one array per task. Two tokens that end
together cover the same bytes there, so one is a suffix of the other: these pairs follow
from the two vocabularies alone and bound what is counted, collected and sent to tasks.

A is run by a second library from ranks in the JSON file; ``tests/llm`` compare it with the
file's own library over all code points. Parts beyond ``LONG_PART`` go to that library.

Defined cases: a text that is null or empty, or whose tokens of A or B do not give
back its bytes (a space and the text), has no tokens, zeros and '' as its digest; strings
of special tokens are plain text; null ids and repeated rows are rows of the result; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm import text as T

#: Files of the two tokenizers; they must be at these paths on every executor.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how the byte-level BPE splits a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text multiplied at a time, and the least length of a part of a long text.
SLICE, PART = 1 << 19, 1 << 16
#: Parts of more characters are encoded by the slower library, which has no limit.
LONG_PART = 1 << 18
#: Links given at a time.
LINK_ROWS = 1 << 16


class Csr(NamedTuple):
    """Compressed rows: the columns of row i are ``indices[indptr[i]:indptr[i + 1]]``."""

    indptr: np.ndarray
    indices: np.ndarray
    n_columns: int


def incidence(lengths: np.ndarray) -> Csr:
    """Tokens that follow one another, by the bytes they cover."""
    indptr = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return Csr(indptr, np.arange(indptr[-1]), int(indptr[-1]))


def transpose(m: Csr) -> Csr:
    rows = np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr))
    order = np.argsort(m.indices, kind="stable")
    indptr = np.concatenate([[0], np.cumsum(np.bincount(m.indices, minlength=m.n_columns))])
    return Csr(indptr, rows[order], len(m.indptr) - 1)


def row_sizes(a: Csr, b: Csr) -> np.ndarray:
    """Terms of every row of the product of ``a`` and ``b``: the symbolic pass."""
    terms = np.concatenate([[0], np.cumsum(np.diff(b.indptr)[a.indices])])
    return terms[a.indptr[1:]] - terms[a.indptr[:-1]]


def multiply(a: Csr, b: Csr, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ``first`` to ``last`` of the product of two 0-1 matrices: row, column and value of its entries.

    Gustavson's scheme: every entry (i, k) of ``a`` adds row k of ``b`` to row i.
    """
    last = len(a.indptr) - 1 if last is None else last
    inner = a.indices[a.indptr[first]:a.indptr[last]]
    sizes = b.indptr[inner + 1] - b.indptr[inner]
    rows = np.repeat(np.repeat(np.arange(first, last), np.diff(a.indptr[first:last + 1])), sizes)
    offsets = np.cumsum(sizes) - sizes
    columns = b.indices[np.arange(len(rows)) + np.repeat(b.indptr[inner] - offsets, sizes)]
    keys = rows * b.n_columns + columns
    if len(keys) and (keys[1:] < keys[:-1]).any():
        keys = np.sort(keys, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[begin] // b.n_columns, keys[begin] % b.n_columns, np.diff(np.append(begin, len(keys)))


def byte_alphabet() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for
    themselves, the others for 256 and up in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and all pairs of ids that can end together."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        import sentencepiece
        import tiktoken

        alphabet = byte_alphabet()
        with open(byte_bpe, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["id"] for t in model["added_tokens"]}
        vocabulary = sorted(model["model"]["vocab"].items(), key=lambda x: x[1])
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary if i not in special}
        self.a_bytes = [b""] * (max(model["model"]["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.a = tiktoken.Encoding("byte-bpe", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_path = byte_bpe
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # a piece with a space after another letter could reach over a cut
        self.can_cut = not any(" " in p.replace("▁", " ").lstrip(" ") for p in pieces)
        self.a_length = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_length = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        self.pairs = self._pairs()
        # decimal ids, followed by one of the separators
        top = max(len(self.a_bytes), len(self.b_bytes))
        self.shown = [f"{i}{s}".encode() for i in range(top) for s in ",|;"]

    def _pairs(self) -> np.ndarray:
        """Sorted codes (A id times B ids, plus B id) of all pairs in which one token is a suffix of the other."""
        found = set()
        by_bytes: tuple[dict, dict] = ({}, {})
        for side, tokens in enumerate((self.a_bytes, self.b_bytes)):
            for i, token in enumerate(tokens):
                if token:
                    by_bytes[side].setdefault(token, []).append(i)
        n = len(self.b_bytes)
        for token, ids in by_bytes[1].items():
            for at in range(len(token)):
                found.update(a * n + b for a in by_bytes[0].get(token[at:], ()) for b in ids)
        for token, ids in by_bytes[0].items():
            for at in range(1, len(token)):
                found.update(a * n + b for b in by_bytes[1].get(token[at:], ()) for a in ids)
        return np.array(sorted(found), dtype=np.int64)

    def encode_a(self, text: str) -> list[int]:
        return self.a.encode_ordinary(text) if len(text) <= LONG_PART else self._slow.encode(text, add_special_tokens=False).ids

    @functools.cached_property
    def _slow(self):
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(self.a_path)
        slow.encode_special_tokens = True
        return slow

    def encode(self, parts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of every part with a space before it, none where bytes are lost."""
        a, b = [], []
        for part, ids_b in zip(parts, self.b.encode(parts, num_threads=1)):
            ids_a, data = self.encode_a(" " + part), (" " + part).encode()
            whole = b"".join(map(self.a_bytes.__getitem__, ids_a)) == data == b"".join(map(self.b_bytes.__getitem__, ids_b))
            a.append(np.array(ids_a if whole else [], dtype=np.int32))
            b.append(np.array(ids_b if whole else [], dtype=np.int32))
        return a, b

    def cut(self, text: str) -> list[str]:
        """Parts of ``PART`` characters or more; each but the first had a space before it."""
        parts, begin = [], 0
        while self.can_cut and len(text) - begin > 2 * PART:
            at = text.find(" ", begin + PART)
            while at >= 0 and not (text[at - 1].isalnum() and text[at + 1:at + 2].isalnum()):
                at = text.find(" ", at + 1)
            if at < 0:
                break
            parts.append(text[begin:at])
            begin = at + 1
        return [*parts, text[begin:]]


@functools.cache
def tokenizers(byte_bpe: str, piece_bpe: str) -> Tokenizers:
    """Loaded once in a process."""
    return Tokenizers(byte_bpe, piece_bpe)


class Aligned(NamedTuple):
    """The alignment of some parts, one after another."""

    a: np.ndarray  # ids
    b: np.ndarray
    overlaps: tuple[np.ndarray, np.ndarray, np.ndarray]  # A token, B token, shared bytes
    ends: np.ndarray  # which overlaps end together: one for each group, in order
    a_groups: Csr  # tokens by group
    b_groups: Csr


def align(both: Tokenizers, a: np.ndarray, b: np.ndarray) -> Aligned:
    """Align the ids of some parts, whose bytes are the same on both sides."""
    rows, columns = incidence(both.a_length[a]), incidence(both.b_length[b])
    overlaps = multiply(rows, transpose(columns))
    end = rows.indptr[overlaps[0] + 1]
    ends = np.flatnonzero(end == columns.indptr[overlaps[1] + 1])
    groups = [Csr(np.arange(len(m.indptr)), np.searchsorted(end[ends], m.indptr[1:]), len(ends)) for m in (rows, columns)]
    return Aligned(a, b, overlaps, ends, *groups)


def shown_groups(both: Tokenizers, found: Aligned) -> list[bytes]:
    """Every id with its separator, in the order of ``a1,a2|b1;a3|b2,b3;``."""
    of_a, of_b = found.a_groups.indices, found.b_groups.indices
    n = len(found.ends)
    last_a, last_b = (np.cumsum(np.bincount(g, minlength=n)) for g in (of_a, of_b))
    codes = np.empty(len(of_a) + len(of_b), dtype=np.int64)
    at = np.arange(len(of_a))
    codes[at + (last_b - np.bincount(of_b, minlength=n))[of_a]] = 3 * found.a.astype(np.int64) + (at + 1 == last_a[of_a])
    at = np.arange(len(of_b))
    codes[at + last_a[of_b]] = 3 * found.b.astype(np.int64) + 2 * (at + 1 == last_b[of_b])
    return [both.shown[c] for c in codes.tolist()]


class _Encoded(NamedTuple):
    """A text's parts by both tokenizers; no parts where it has no tokens."""

    row: int
    a: list[np.ndarray]
    b: list[np.ndarray]


def _encoded(both: Tokenizers, column: pa.Array) -> Iterator[list[_Encoded]]:
    """The texts of a column, some together while they are short."""
    held: list[tuple[int, list[str]]] = []
    size = 0

    def encode() -> list[_Encoded]:
        parts = [p for _, own in held for p in own]
        a, b, at = [], [], 0
        while at < len(parts):
            to, chars = at, 0
            while to < len(parts) and chars < SLICE:
                chars += len(parts[to])
                to += 1
            more = both.encode(parts[at:to])
            a, b, at = a + more[0], b + more[1], to
        out, at = [], 0
        for row, own in held:
            to = at + len(own)
            whole = all(len(x) for x in a[at:to])  # a part has at least its space
            out.append(_Encoded(row, a[at:to] if whole else [], b[at:to] if whole else []))
            at = to
        return out

    for row, value in enumerate(column):
        text = value.as_py()
        if held and size + len(text or "") > SLICE:
            yield encode()
            held, size = [], 0
        held.append((row, both.cut(text) if text else []))
        size += len(text or "")
    if held:
        yield encode()


def _slices(texts: list[_Encoded]) -> Iterator[list[tuple[_Encoded, np.ndarray, np.ndarray]]]:
    """Consecutive parts whose ids are multiplied together."""
    held, size = [], 0
    for text in texts:
        for a, b in zip(text.a, text.b):
            if held and size + len(a) > SLICE // 4:
                yield held
                held, size = [], 0
            held.append((text, a, b))
            size += len(a)
    if held:
        yield held


def align_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """Every document's numbers of tokens, groups and links of both kinds, ``groups_sha256``,
    and ``pairs``: the place of each link's id pair among all that can end together, as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(byte_bpe, piece_bpe)
        for batch in batches:
            for texts in _encoded(both, batch.column(1)):
                yield _described(both, batch.column(0), texts)

    return T.pick(documents, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, pairs binary")


def _described(both: Tokenizers, ids: pa.Array, texts: list[_Encoded]) -> pa.RecordBatch:
    of = {t.row: k for k, t in enumerate(texts)}
    n_a, n_b, n_links, n_shared = np.zeros((4, len(texts)), dtype=np.int64)
    pairs: list[list[bytes]] = [[] for _ in texts]
    digests = [hashlib.sha256() if t.a else None for t in texts]
    for held in _slices(texts):
        found = align(both, np.concatenate([a for _, a, _ in held]), np.concatenate([b for _, _, b in held]))
        linked_a = found.overlaps[0][found.ends]
        codes = found.a[linked_a].astype(np.int64) * len(both.b_bytes) + found.b[found.overlaps[1][found.ends]]
        places = np.searchsorted(both.pairs, codes).astype("<i4")
        shared = row_sizes(found.a_groups, transpose(found.b_groups))
        shown = shown_groups(both, found)
        first_a = first_link = first_shown = 0
        for t, a, b in held:
            k, last_a = of[t.row], first_a + len(a)
            last_link, last_shown = int(np.searchsorted(linked_a, last_a)), first_shown + len(a) + len(b)
            if n_a[k]:
                digests[k].update(b";")
            digests[k].update(b"".join(shown[first_shown:last_shown])[:-1])
            pairs[k].append(places[first_link:last_link].tobytes())
            n_a[k] += len(a)
            n_b[k] += len(b)
            n_links[k] += last_link - first_link
            n_shared[k] += int(shared[first_a:last_a].sum())
            first_a, first_link, first_shown = last_a, last_link, last_shown
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array([t.row for t in texts])), pa.array(n_a), pa.array(n_b), pa.array(n_links), pa.array(n_links), pa.array(n_shared),
         pa.array([d.hexdigest() if d else "" for d in digests]), pa.array([b"".join(p) for p in pairs], pa.binary())],
        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "pairs"])


def pair_counts(aligned: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """``a_id``, ``b_id``, their place ``pair`` and the links ``n`` that hold them, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(byte_bpe, piece_bpe)
        total = np.zeros(len(both.pairs), dtype=np.int64)
        for batch in batches:
            for data in batch.column(0):
                places = np.frombuffer(data.as_buffer(), dtype="<i4")
                if len(places) > len(total):
                    total += np.bincount(places, minlength=len(total))
                else:
                    np.add.at(total, places, 1)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["pair", "n"])

    both = tokenizers(byte_bpe, piece_bpe)
    sums = aligned.select("pairs").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(byte_bpe, piece_bpe)
        for batch in batches:
            codes = both.pairs[batch.column(0).to_numpy()]
            n = len(both.b_bytes)
            yield pa.RecordBatch.from_arrays([pa.array((codes // n).astype(np.int32)), pa.array((codes % n).astype(np.int32)), *batch.columns], ["a_id", "b_id", "pair", "n"])

    assert len(both.pairs) < 1 << 31
    return sums.mapInArrow(named, "a_id int, b_id int, pair int, n long")


def score(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """The columns of ``align_documents`` but ``pairs``, with ``n_best`` and ``count_sum`` from the counts of the corpus.

    The counts, at most one for each pair that the vocabularies allow, pass through the driver.
    """
    aligned = T.stored(align_documents(documents, doc_id, text, byte_bpe, piece_bpe), "aligned")
    rows = pair_counts(aligned, byte_bpe, piece_bpe).select("pair", "b_id", "n").toArrow()
    pair, b_id, n = (rows.column(c).to_numpy() for c in ("pair", "b_id", "n"))
    counts = np.zeros(int(pair.max()) + 1 if len(pair) else 0, dtype=np.int64)
    counts[pair] = n
    most = np.zeros(int(b_id.max()) + 1 if len(pair) else 0, dtype=np.int64)
    np.maximum.at(most, b_id, n)
    best = np.zeros(len(counts), dtype=bool)
    best[pair] = n == most[b_id]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [np.frombuffer(d.as_buffer(), dtype="<i4") for d in batch.column("pairs")]
            n_best = pa.array([int(best[p].sum()) for p in places], pa.int64())
            sums = pa.array([int(counts[p].sum()) for p in places], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n_best, sums], [*batch.schema.names[:-1], "n_best", "count_sum"])

    return aligned.mapInArrow(
        finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, n_best long, count_sum long")


def links(documents: DataFrame, kind: str = "overlap", doc_id: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE,
          piece_bpe: str = PIECE_BPE) -> DataFrame:
    """All links of all documents: ``a_place`` and ``b_place`` in the text's tokens, ``a_id``, ``b_id``,
    and ``weight``: shared bytes for ``overlap``, 1 for ``group``."""
    if kind not in ("overlap", "group"):
        raise ValueError(f"kind is overlap or group, not {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(byte_bpe, piece_bpe)
        for batch in batches:
            for texts in _encoded(both, batch.column(1)):
                for t in texts:
                    done_a = done_b = 0
                    for a, b in zip(t.a, t.b):
                        found = align(both, a, b)
                        for i, j, weight in _entries(found, kind):
                            yield pa.RecordBatch.from_arrays(
                                [pa.repeat(batch.column(0)[t.row], len(i)), pa.array(done_a + i), pa.array(done_b + j),
                                 pa.array(a[i]), pa.array(b[j]), pa.array(weight.astype(np.int32))],
                                ["doc_id", "a_place", "b_place", "a_id", "b_id", "weight"])
                        done_a, done_b = done_a + len(a), done_b + len(b)

    return T.pick(documents, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, a_place long, b_place long, a_id int, b_id int, weight int")


def _entries(found: Aligned, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries of a product, about ``LINK_ROWS`` at a time, a row of it at least."""
    if kind == "overlap":
        for at in range(0, len(found.overlaps[0]), LINK_ROWS):
            yield tuple(x[at:at + LINK_ROWS] for x in found.overlaps)
        return
    columns = transpose(found.b_groups)
    terms = np.cumsum(row_sizes(found.a_groups, columns))
    first = 0
    while first < len(terms):
        last = max(first + 1, int(np.searchsorted(terms, (terms[first - 1] if first else 0) + LINK_ROWS, side="right")))
        yield multiply(found.a_groups, columns, first, last)
        first = last
