"""Documents into containers of fixed capacity (problem 7).

Hierarchical residual packing: every task packs its own items best-fit
decreasing and is done with the containers that are nearly full; the others
become items of the next round, in which a group of tasks' containers is
packed together, and so on up a tree.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sweep import balanced_prefix, column
from ..session import Scratch

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Containers with at most this share of room left are done.
SLACK = 0.01
#: Rounds join the open containers of so many tasks.
FAN = 8
#: Items that a task packs at once; more are packed one lot after the other.
LOT_ROWS = 1 << 20
#: How byte-level BPE splits text before its merges (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    """Texts to token counts, by the kind of the vocabulary file."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        enc = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of whole texts, each document once; null texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer)
        for b in batches:
            n = count([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin of each item, room used of each bin).

    Open bins lie in stacks by their free room; which stacks are in use is one
    big integer, so the tightest bin that fits is its lowest set bit.
    """
    order = np.argsort(-sizes, kind="stable")
    where = np.empty(len(sizes), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    open_ = 0
    for i in order.tolist():
        size = int(sizes[i])
        fits = open_ >> size
        if fits:
            room = size + ((fits & -fits).bit_length() - 1)
            b = free[room].pop()
            if not free[room]:
                open_ ^= 1 << room
        else:
            room, b = capacity, len(used)
            used.append(0)
        where[i] = b
        used[b] += size
        room -= size
        if room:
            free[room].append(b)
            open_ |= 1 << room
    return where, np.array(used, dtype=np.int64)


_PLACED = "item bigint, bin bigint, used bigint, open boolean"


def still_open(used: np.ndarray, capacity: int, slack: float, others: int) -> np.ndarray:
    """Which bins go on to the next round.

    Best fit leaves one bin of a lot at most half full, as it puts together any
    two that are. So `others` lots have that many such bins, nothing else can
    still go into another bin, and of bins with equal room no more than `others`
    can be wanted: the rest are done without any loss.
    """
    go = capacity - used > slack * capacity
    half = used * 2 > capacity
    order = np.argsort(used, kind="stable")
    u = used[order]
    first = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, dtype=np.int64)
    nth = np.empty(len(u), dtype=np.int64)
    nth[order] = np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u))))
    return go & (~half | (nth < others))


def _pack(level: int, capacity: int, slack: float, others: int):
    """Items (item, size) of one task into bins; bin ids are unique over levels and tasks (2^24 of them, 2^32 bins each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = (level << 56) + (TaskContext.get().partitionId() << 32)
        held, n = [], 0

        def lot() -> Iterator[pa.RecordBatch]:
            nonlocal at
            item, size = (np.concatenate(x) for x in zip(*held))
            where, used = best_fit(size, capacity)
            go = still_open(used, capacity, slack, others)
            rows = pa.RecordBatch.from_arrays([pa.array(item), pa.array(at + where), pa.array(used[where]), pa.array(go[where])], names=["item", "bin", "used", "open"])
            at += len(used)
            for i in range(0, len(item), 50_000):
                yield rows.slice(i, 50_000)

        for b in batches:
            if b.num_rows:
                held.append((column(b, "item"), column(b, "size")))
                n += b.num_rows
            # later rounds take in one lot all that came to the task: still_open bounds it
            if n >= LOT_ROWS and level == 0:
                yield from lot()
                held, n = [], 0
        if n:
            yield from lot()

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """Container of each document: (doc_id, part_no, first_token, n_tokens, container_id).

    `sizes` is (doc_id, n_tokens). A document above the capacity is cut into
    full containers and a last part that is packed as an item; no other is
    cut. Containers are numbered, those of whole parts below 0. A document
    without tokens takes the room of one token. Null sizes count as 0; null ids
    are left out; an empty table gives no rows.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, "packing")
    n = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint")
    rows = sizes.where(F.col("doc_id").isNotNull()).select("doc_id", n.alias("n"))
    full = F.expr(f"greatest(n - 1, 0) div {capacity}")
    items = rows.withColumn("full", full).select(F.col("doc_id").alias("item"), F.greatest(F.col("n") - F.col("full") * capacity, F.lit(1)).alias("size"), "n", "full")
    items = scratch.put(items)
    first = items.select("item", "size")
    # lots of the first round: no more than tasks and full lots together
    tasks = first.rdd.getNumPartitions()
    lots = tasks + items.count() // LOT_ROWS
    placed = scratch.put(first.mapInArrow(_pack(0, capacity, slack, lots), _PLACED))
    level, final = 0, placed.select("item", F.col("bin").alias("container_id"))
    bins = lambda t: scratch.put(t.where("open").groupBy(F.col("bin").alias("item")).agg(F.max("used").alias("size")))
    open_ = bins(placed)
    count, moves = open_.count(), None
    while count > 1:
        level += 1
        tasks = -(-lots // FAN)
        step = scratch.put(open_.repartition(tasks, "item").mapInArrow(_pack(level, capacity, slack, tasks), _PLACED))
        now = step.select("item", "bin")
        # where each bin of the first round ended up
        moves = now.select(F.col("item").alias("first"), "bin") if moves is None else (
            moves.join(now.select(F.col("item").alias("bin"), F.col("bin").alias("to")), "bin", "left").select("first", F.coalesce("to", "bin").alias("bin"))
        )
        moves = scratch.put(moves)
        if tasks == 1:
            break
        open_, lots = bins(step), tasks
        count = open_.count()
    if moves is not None:
        final = final.join(moves.withColumnRenamed("first", "container_id"), "container_id", "left").select("item", F.coalesce("bin", "container_id").alias("container_id"))
    last = items.join(final, "item").select(
        F.col("item").alias("doc_id"), F.col("full").cast("int").alias("part_no"), (F.col("full") * capacity).alias("first_token"), (F.col("n") - F.col("full") * capacity).alias("n_tokens"), "container_id"
    )
    # Whole containers of long documents: numbered by a running sum over documents.
    long = balanced_prefix(items.where("full > 0").select("item", "full"), [], ["item"], "full", scratch)
    parts = long.select("item", (F.col("run") - F.col("full")).alias("before"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("full"))).alias("k"))
    whole = parts.select(
        F.col("item").alias("doc_id"), (F.col("k") - 1).cast("int").alias("part_no"), ((F.col("k") - 1) * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("n_tokens"),
        (-F.col("before") - F.col("k")).alias("container_id"),
    )
    return last.unionByName(whole)


def audit(placed: DataFrame, sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: documents, and how many of the promises of `pack` are broken (all 0).

    lost_tokens: tokens of documents that no container has; overfull: containers
    above the capacity; cut_needlessly: documents within it in several parts;
    shared: whole containers of a long document that hold another part;
    mergeable: containers at most half full beyond one.
    """
    doc = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("parts"))
    box = placed.groupBy("container_id").agg(F.sum(F.greatest("n_tokens", F.lit(1))).alias("used"), F.count("*").alias("docs"))
    boxes = box.agg(
        F.count(F.when(F.col("used") > capacity, 1)).alias("overfull"), F.count(F.when((F.col("container_id") < 0) & (F.col("docs") > 1), 1)).alias("shared"), F.greatest(F.count(F.when(F.col("used") * 2 <= capacity, 1)) - 1, F.lit(0)).alias("mergeable")
    )
    docs = sizes.join(doc, "doc_id", "left").agg(
        F.count("*").alias("n_docs"), F.sum(F.abs(F.col("n_tokens") - F.coalesce("t", F.lit(-1)))).alias("lost_tokens"), F.count(F.when((F.col("n_tokens") <= capacity) & (F.col("parts") > 1), 1)).alias("cut_needlessly")
    )
    # both are one row
    return docs.unionByName(boxes, allowMissingColumns=True).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in (*docs.columns, *boxes.columns)])
