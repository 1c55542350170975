"""Ranked lexical search: the best documents for every item, by presence masks.

The terms of the items are the vocabulary. One pass over the texts keeps, per document, its length and its counts of vocabulary terms, written
as a thin table; the statistics of the corpus come from it. A second pass takes the thin table in blocks. In a block, the
documents of an item are grouped by a bitmap of the item's terms they hold. A mask has a largest possible score, from the
largest counts and the shortest document of the block; masks are evaluated from the largest down, and an item is finished when its tenth best
score so far is above what any mask left can reach. Masks that could only equal it are still evaluated, since ties go by id.

Every task hands on at most ten documents per item, so what is merged grows with tasks and items and never with their product with
documents. Items are taken in blocks of bounded vocabulary, each with its own passes, so what is sent to the tasks is bounded too.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlq.llm.common import only, parts_for, stored

TOP = 10
#: Terms of items whose words are sent to the tasks at one time; more items take more passes.
BLOCK_TERMS = 400_000
#: Documents, and counts of terms, in a block.
BLOCK_DOCS = 2048
BLOCK_COUNTS = 1 << 20
#: Documents evaluated before the threshold is looked at again.
STEP = 256
#: Bytes of one text that are split at a time.
PIECE = 1 << 20
SALTS = 64
#: Every byte of a term as it counts, a blank for all that separates terms: A-Z lowered, ASCII other than letters and digits blanked.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists, whatever its size."""
    text = text.translate(TERM_BYTES)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item (a number of its own for every row), item_id, terms: the distinct terms of every item, sorted."""
    rows = only(items, item_id=item_id, text=text).withColumn("item", F.monotonically_increasing_id())
    id_type = rows.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({t for part in terms(x.as_py().encode()) for t in part}) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), batch.column("item_id"), pa.array([[t.decode() for t in x] for x in found], pa.list_(pa.string()))], ["item", "item_id", "terms"]
            )

    return rows.mapInArrow(run, f"item bigint, item_id {id_type}, terms array<string>")


def counted(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), held (numbers of the vocabulary terms in the text), tf (how often each), one row per document."""
    rows = only(docs, doc_id=doc_id, text=text)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_DOCS):
                batch = whole.slice(at, BLOCK_DOCS)
                lengths, ends, held, tf = [], [0], [], []
                for x in batch.column("text"):
                    n, counts = 0, Counter()
                    for part in terms(x.as_py().encode()):
                        n += len(part)
                        counts.update(filter(number.__contains__, part))
                    lengths.append(n)
                    held += map(number.__getitem__, counts)
                    tf += counts.values()
                    ends.append(len(held))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(held, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))],
                    ["doc_id", "n", "held", "tf"],
                )

    return rows.mapInArrow(run, f"doc_id {id_type}, n bigint, held array<int>, tf array<bigint>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def damping(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents by their lengths; beyond 64 bits the product is taken in long numbers."""
    if 90 * int(lengths.max(initial=0)) * n_docs < 1 << 63:
        return 10 + 90 * lengths * n_docs // n_terms
    return np.array([10 + 90 * int(n) * n_docs // n_terms for n in lengths], dtype=np.int64)


def contributions(tf: np.ndarray, m: np.ndarray | int, weights: np.ndarray) -> np.ndarray:
    """What counts of terms (a column per term) add to scores."""
    return weights * (1_000_000_000 * tf // np.maximum(1000 * tf + 8 * m, 1))


class Best:
    """The best `top` (score, doc_id) of an item so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, top: int):
        self.top, self.rows, self.least = top, [], 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        for score, i in zip(scores.tolist(), ids, strict=True):
            if score >= self.least:
                self.rows.append((-score, i is None, i))
        if len(self.rows) > self.top:
            self.rows = sorted(self.rows, key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))[: self.top]
        if len(self.rows) == self.top:
            self.least = max(1, -max(r[0] for r in self.rows))


class Block:
    """Documents with their counts by term."""

    def __init__(self, ids: list, m: np.ndarray, doc: np.ndarray, held: np.ndarray, tf: np.ndarray, vocabulary: int):
        self.ids, self.m = ids, m
        order = np.argsort(held, kind="stable")
        self.doc, self.tf = doc[order], tf[order]
        self.starts = np.searchsorted(held[order], np.arange(vocabulary + 1))

    def search(self, numbers: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Improve `best` by the documents of this block; returns how many were evaluated."""
        counts = np.zeros((len(numbers), len(self.ids)), np.int64)
        for j, t in enumerate(numbers):
            part = slice(self.starts[t], self.starts[t + 1])
            counts[j, self.doc[part]] = self.tf[part]
        # One bit per term of the item; whole 64-bit words of them.
        bits = np.zeros((-(-len(numbers) // 64) * 64, len(self.ids)), bool)
        bits[: len(numbers)] = counts > 0
        words = np.ascontiguousarray(np.packbits(bits, axis=0).T).view(np.uint64)
        if words.shape[1] == 1:
            masks, mask_of = np.unique(words[:, 0], return_inverse=True)
        else:
            masks, mask_of = np.unique(words, axis=0, return_inverse=True)
        masks = masks.reshape(len(masks), -1)
        most = contributions(counts.max(axis=1), int(self.m.min()), weights)
        present = np.unpackbits(np.ascontiguousarray(masks).view(np.uint8), axis=1)[:, : len(numbers)]
        bound = present.astype(np.int64) @ most
        by_mask = np.argsort(-bound, kind="stable")
        place = np.empty(len(masks), np.int64)
        place[by_mask] = np.arange(len(masks))
        mask_of = place[mask_of.reshape(-1)]
        order = np.argsort(mask_of, kind="stable")
        falling = bound[by_mask][mask_of[order]]
        done = 0
        while done < len(order) and falling[done] >= best.least:
            some = order[done : done + STEP]
            scores = contributions(counts[:, some].T, self.m[some][:, None], weights).sum(axis=1)
            good = np.flatnonzero(scores >= best.least)
            best.add(scores[good], [self.ids[i] for i in some[good]])
            done += len(some)
        return done


def blocks(batch: pa.RecordBatch, n_docs: int, n_terms: int, vocabulary: int) -> Iterator[Block]:
    """A batch of the thin table as blocks of documents of like length, so that bounds are close."""
    n = batch.column("n").to_numpy()
    m = damping(n, n_docs, n_terms)
    ids = batch.column("doc_id").to_pylist()
    ends = batch.column("held").offsets.to_numpy().astype(np.int64)
    held = batch.column("held").values.to_numpy()
    tf = batch.column("tf").values.to_numpy()
    own = np.diff(ends)
    order = np.argsort(m, kind="stable")
    order = order[own[order] > 0]
    # A block ends where its documents or their counts are enough.
    chunk = np.maximum(np.arange(len(order)) // BLOCK_DOCS, np.cumsum(own[order]) // BLOCK_COUNTS)
    for rows in np.split(order, np.flatnonzero(np.diff(chunk)) + 1):
        if len(rows):
            many = own[rows]
            at = np.repeat(ends[rows] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            yield Block([ids[i] for i in rows], m[rows], np.repeat(np.arange(len(rows)), many), held[at], tf[at], vocabulary)


def _best_of(docs: DataFrame, held: dict[int, list[str]], top: int, doc_id: str, text: str) -> DataFrame:
    """item, doc_id, score: a few best documents per task for the given items, among them the best `top` of all."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for found in held.values() for t in found}))}
    thin = stored(counted(docs, {t.encode(): i for t, i in vocabulary.items()}, doc_id, text))
    spark = docs.sparkSession
    n_docs, n_terms = thin.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One row per vocabulary term.
    df = {r["t"]: r["df"] for r in thin.select(F.explode("held").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}
    weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(vocabulary))], dtype=np.int64)
    asked = {item: np.array([vocabulary[t] for t in found], dtype=np.int64) for item, found in held.items() if found}
    shared = spark.sparkContext.broadcast((asked, weights))
    id_type = thin.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = shared.value
        best = {item: Best(top) for item in asked}
        id_kind = pa.int64()
        for batch in batches:
            id_kind = batch.schema.field("doc_id").type
            for block in blocks(batch, n_docs, n_terms, len(weights)):
                for item, numbers in asked.items():
                    block.search(numbers, weights[numbers], best[item])
        salt = TaskContext.get().partitionId() % SALTS
        rows = [(salt, item, r[2], -r[0]) for item, b in best.items() for r in b.rows]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.int32(), pa.int64(), id_kind, pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["salt", "item", "doc_id", "score"])

    return thin.mapInArrow(run, f"salt int, item bigint, doc_id {id_type}, score bigint")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the best `top` documents of every item with a score above 0, ties by ascending id.

    Null and empty texts hold no terms: such a document is found by nobody, such an item finds nothing. Repeated documents are
    documents of their own and repeated items get their list once per row; null ids come last among equal scores. Any text is read whole.
    Without documents or items there are no rows. Other columns are not looked at.
    """
    if top < 1:
        raise ValueError("top must be at least 1")
    found = stored(item_terms(items, item_id, item_text))
    n_blocks = parts_for(int(found.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]), block_terms)
    dealt = found.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks)))
    parts = []
    for k in range(n_blocks):
        held = {r["item"]: r["terms"] for r in dealt.where(F.col("block") == k).select("item", "terms").collect()}
        parts.append(_best_of(docs, held, top, doc_id, text))
    some = reduce(DataFrame.unionByName, parts)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # First among the rows of a share of the tasks, then among what those leave.
    first = some.withColumn("place", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(found.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
