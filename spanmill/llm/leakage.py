"""Evaluation passages in training text (problem 8).

Every window of GRAM normalised words of the evaluation items goes into a hash
set that each task holds; tasks scan the windows of their documents against
it. A hit is extended both ways with a few changed, dropped or added words and
counts if enough of the item's words stand there.

A passage of 20 words with two edits has an unbroken stretch of 7 or more, so
windows of 7 words miss none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import words

MIN_WORDS = 20
MAX_EDITS = 2
#: Characters of evaluation text that are held by every task at once; more is scanned in so many blocks as it takes.
BLOCK_CHARS = 16_000_000

_MULT = 0x9E3779B97F4A7C15


def _window_hashes(ids: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each window of word ids; ids below 0 never match."""
    n = len(ids) - gram + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    u = ids.astype(np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            h = (h ^ (u[k : k + n] + np.uint64(1))) * np.uint64(_MULT)
            h ^= h >> np.uint64(29)
    return h


class ItemIndex:
    """Windows of the evaluation items, sorted by hash, with item and place."""

    def __init__(self, rows: list[tuple[int, str]], gram: int):
        self.gram = gram
        self.vocab: dict[str, int] = {}
        self.ids, self.items = [], []
        hashes, item, place = [], [], []
        for item_id, text in rows:
            w = [self.vocab.setdefault(x, len(self.vocab)) for x in words(text or "")]
            h = _window_hashes(np.array(w, dtype=np.int64), gram)
            hashes.append(h)
            item.append(np.full(len(h), len(self.items)))
            place.append(np.arange(len(h)))
            self.ids.append(w)
            self.items.append(item_id)
        h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.item = (np.concatenate(item) if item else np.zeros(0, dtype=np.int64))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, dtype=np.int64))[order]

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document place, item number, item place) of equal windows."""
        h = _window_hashes(ids, self.gram)
        lo = np.searchsorted(self.hashes, h, side="left")
        at = np.flatnonzero((lo < len(self.hashes)) & (self.hashes[np.minimum(lo, len(self.hashes) - 1)] == h)) if len(self.hashes) else []
        if not len(at):
            return
        hi = np.searchsorted(self.hashes, h[at], side="right")
        for j, a, b in zip(at.tolist(), lo[at].tolist(), hi.tolist()):
            for x in range(a, b):
                yield j, int(self.item[x]), int(self.place[x])


def _reach(a: list[int], i: int, b: list[int], j: int, step: int, edits: int) -> list[tuple[int, int]]:
    """Most words of `a` from i that also stand in `b` from j, for 0..edits edits.

    Returns (words that agree, words of `b` passed) for each number of edits;
    step is 1 forwards, -1 backwards.
    """
    na, nb = len(a), len(b)
    out = []

    def go(i: int, j: int, left: int) -> tuple[int, int]:
        m = 0
        while 0 <= i < na and 0 <= j < nb and a[i] == b[j]:
            m, i, j = m + 1, i + step, j + step
        best = (m, m)
        if left:
            for di, dj in ((1, 1), (1, 0), (0, 1)):
                n, p = go(i + step * di, j + step * dj, left - 1)
                if n and m + n > best[0]:
                    best = (m + n, m + dj + p)
        return best

    for e in range(edits + 1):
        out.append(go(i, j, e))
    return out


def leaked(index: ItemIndex, ids: list[int], hits: list[tuple[int, int, int]], min_words: int, max_edits: int) -> dict[int, tuple[int, int, int]]:
    """item number -> (words that agree, first and last word in the document)."""
    found: dict[int, tuple[int, int, int]] = {}
    done: dict[tuple[int, int], int] = {}
    for j, item, i in hits:
        if j < done.get((item, j - i), -1):
            continue  # within a stretch that was extended already
        a = index.ids[item]
        right = _reach(a, i, ids, j, 1, max_edits)
        done[item, j - i] = j + right[0][0]
        if not right[0][0]:
            continue  # equal hashes of different words
        left = _reach(a, i - 1, ids, j - 1, -1, max_edits)
        for e in range(max_edits + 1):
            n = left[e][0] + right[max_edits - e][0]
            if n >= min_words and n > found.get(item, (0,))[0]:
                found[item] = (n, j - left[e][1], j + right[max_edits - e][1] - 1)
    return found


_held: dict = {}


def _index(block: str, rows: list, gram: int) -> ItemIndex:
    """The index of a broadcast block, built once a worker process."""
    if _held.get("key") != (block, gram):
        _held.update(key=(block, gram), index=ItemIndex(rows, gram))
    return _held["index"]


def _scan(block, gram: int, min_words: int, max_edits: int):
    name = uuid.uuid4().hex  # workers outlive queries: no two blocks may have one name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = _index(name, block.value, gram)
        get = ix.vocab.get
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                ids = [get(w, -1) for w in words(text)]
                if len(ids) < gram:
                    continue
                arr = np.array(ids, dtype=np.int64)
                arr[arr < 0] = -2 - np.arange((arr < 0).sum())
                hits = list(ix.hits(arr))
                if hits:
                    for k, (n, first, last) in leaked(ix, arr.tolist(), hits, min_words, max_edits).items():
                        out.append((doc, ix.items[k], n, first, last))
            cols = list(zip(*out)) if out else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.int32()) for c in cols[2:]]],
                names=["doc_id", "item_id", "n_words", "first_word", "last_word"],
            )

    return run


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_edits: int = MAX_EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, n_words, first_word, last_word) of leaked passages.

    A case has min_words or more words of the item in the item's order, with
    at most max_edits words changed, dropped or added among them. Words are
    compared after normalisation (see `text.words`); first_word and last_word
    are places in the document's normalised words. The longest passage of each
    pair is given. Null and empty texts have no words; repeated documents and
    items count once; empty tables give no rows.
    """
    spark = docs.sparkSession
    gram = -(-min_words // (max_edits + 1))
    items = items.where("item_id is not null and text is not null").groupBy(F.col("item_id").cast("bigint").alias("item_id")).agg(F.max("text").alias("text"))
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, item_id bigint, n_words int, first_word int, last_word int"
    out = None
    for block in _blocks(items, block_chars):
        found = rows.mapInArrow(_scan(spark.sparkContext.broadcast(block), gram, min_words, max_edits), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", "first_word", "last_word")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_words", "m.first_word", "m.last_word")


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of block_chars characters at most, one item at least.

    Rows come to the driver a partition at a time and are let go block by block.
    """
    block, size = [], 0
    for r in items.toLocalIterator():
        if block and size + len(r["text"]) > block_chars:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield block


def without_leaked(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents in which no item leaked."""
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
