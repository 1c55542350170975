"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of bytes that cover it to its end. Every byte is a learned vector, learned filters slide over
each chunk, and each filter's largest response in the chunk is kept. Over the chunks of a document these responses are
combined by their largest, mean and smallest, and one linear layer turns them into a probability. The smallest matters: a chunk of
repeated words lacks what ordinary text always has somewhere.

Fitting uses a bounded sample of labelled rows (TRAIN_ROWS documents of at most TRAIN_BYTES bytes, chosen by a hash of their
id) on the driver; scoring runs in Arrow batches on whole texts, with the fitted weights, about 30 kB, in the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlq.llm.common import only

TRAIN_ROWS = 3000
#: Bytes of text scored at a time; one longer text is scored alone.
SCORED_AT_ONCE = 4 << 20
CHUNK = 512
STEP = 448
STRIDE = 4
WIDTH = 8  # two strides
EMBED = 6
FILTERS = 32
PAD = 256
EPOCHS = 12
BATCH = 48
RATE = 4e-3
#: Chunks convolved at a time: about 25 MB.
CHUNKS_AT_ONCE = 1024


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks of n bytes: STEP apart, the last one ending with the text."""
    if n <= CHUNK:
        return np.zeros(1, dtype=np.int64)
    return np.append(np.arange(0, n - CHUNK, STEP), n - CHUNK)


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte codes of all chunks (padded with PAD) and the first chunk of each text."""
    starts = [chunk_starts(len(t)) for t in texts]
    first = np.cumsum([0] + [len(s) for s in starts])[:-1]
    codes = np.full((sum(map(len, starts)), CHUNK), PAD, dtype=np.int16)
    at = 0
    for text, own in zip(texts, starts, strict=True):
        raw = np.frombuffer(text, dtype=np.uint8)
        if len(raw) <= CHUNK:
            codes[at, : len(raw)] = raw
        else:
            codes[at : at + len(own)] = np.lib.stride_tricks.sliding_window_view(raw, CHUNK)[own]
        at += len(own)
    return codes, first


@dataclass
class Network:
    table: np.ndarray  # 257 x EMBED, the last row is 0
    filters: np.ndarray  # WIDTH*EMBED x FILTERS
    bias: np.ndarray
    head: np.ndarray  # 3*FILTERS + 1
    offset: np.ndarray  # 1

    def pooled(self, codes: np.ndarray, places: bool = False):
        """Largest response of each filter per chunk, at least 0; with `places`, also where."""
        half = STRIDE * EMBED
        a, b = self.filters[:half], self.filters[half:]
        both = np.concatenate([a, b], axis=1)
        out, where = [], []
        for at in range(0, len(codes), CHUNKS_AT_ONCE):
            x = np.take(self.table, codes[at : at + CHUNKS_AT_ONCE], axis=0).reshape(-1, half)
            y = (x @ both).reshape(-1, CHUNK // STRIDE, 2 * FILTERS)
            y = y[:, :-1, :FILTERS] + y[:, 1:, FILTERS:]
            best = y.max(axis=1)
            if places:
                at_best = np.zeros(best.shape, dtype=np.int64)
                for place in range(y.shape[1] - 1, 0, -1):
                    at_best[y[:, place] == best] = place
                where.append(at_best)
            out.append(best)
        pooled = np.maximum(np.concatenate(out) + self.bias, 0)
        return (pooled, np.concatenate(where)) if places else pooled

    def features(self, pooled: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n = np.diff(np.append(first, len(pooled)))[:, None]
        return np.concatenate(
            [
                np.maximum.reduceat(pooled, first),
                np.add.reduceat(pooled, first) / n,
                np.minimum.reduceat(pooled, first),
                (np.minimum(sizes, CHUNK) / CHUNK)[:, None],
            ],
            axis=1,
        ).astype(np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        codes, first = chunked(texts)
        z = self.features(self.pooled(codes), first, np.array([len(t) for t in texts])) @ self.head + self.offset[0]
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def fresh(rng: np.random.Generator) -> Network:
    table = rng.normal(0, 0.5, (257, EMBED)).astype(np.float32)
    table[PAD] = 0
    return Network(
        table,
        rng.normal(0, 0.3, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.05, 3 * FILTERS + 1).astype(np.float32),
        np.zeros(1, np.float32),
    )


def gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss, in the order of the network's fields."""
    codes, first = chunked(texts)
    pooled, where = net.pooled(codes, places=True)
    x = net.features(pooled, first, np.array([len(t) for t in texts]))
    z = x @ net.head + net.offset[0]
    dz = ((1 / (1 + np.exp(-z)) - labels) / len(labels)).astype(np.float32)
    dx = dz[:, None] * net.head
    sizes = np.diff(np.append(first, len(pooled)))
    owner = np.repeat(np.arange(len(texts)), sizes)
    big, mean, small = dx[:, :FILTERS], dx[:, FILTERS : 2 * FILTERS], dx[:, 2 * FILTERS : 3 * FILTERS]
    dp = (mean / sizes[:, None])[owner]
    for part, reduce in ((big, np.maximum), (small, np.minimum)):
        hit = pooled == reduce.reduceat(pooled, first)[owner]
        shared = np.add.reduceat(hit, first, dtype=np.float32)[owner]
        dp += np.where(hit, part[owner] / shared, 0)
    dp = np.where(pooled > 0, dp, 0).astype(np.float32)
    # The winning windows alone carry a gradient; so many chunks at a time, however long a text is.
    d_filters, d_table = np.zeros_like(net.filters), np.zeros((257, EMBED))
    for c in range(0, len(codes), CHUNKS_AT_ONCE):
        some, part = codes[c : c + CHUNKS_AT_ONCE], dp[c : c + CHUNKS_AT_ONCE]
        at = where[c : c + CHUNKS_AT_ONCE, :, None] * STRIDE + np.arange(WIDTH)
        seen = some[np.arange(len(some))[:, None, None], at]
        vectors = net.table[seen].reshape(len(some), FILTERS, WIDTH * EMBED)
        d_filters += np.einsum("cf,cfw->wf", part, vectors, optimize=True)
        d_vectors = (part[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
        d_table += np.stack([np.bincount(seen.ravel(), weights=d_vectors[:, e], minlength=257) for e in range(EMBED)], axis=1)
    d_table[PAD] = 0
    return [d_table.astype(np.float32), d_filters, dp.sum(axis=0), x.T @ dz, np.array([dz.sum()], np.float32)]


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Adam over shuffled batches; the same rows give the same network. One class alone gives a constant score."""
    rng = np.random.default_rng(seed)
    net = fresh(rng)
    if len(texts) == 0 or labels.min() == labels.max():
        net.head[:] = 0
        net.offset[0] = 0 if len(texts) == 0 else (4 if labels[0] else -4)
        return net
    values = [net.table, net.filters, net.bias, net.head, net.offset]
    means, squares = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    # Small samples get as many steps as large ones need.
    rounds = max(epochs, min(40, -(-epochs * 1000 // len(texts))))
    steps, k = rounds * (-(-len(texts) // BATCH)), 0
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            k += 1
            rate = RATE * (1 - 0.95 * k / steps)
            for v, m, s, g in zip(values, means, squares, gradients(net, [texts[i] for i in own], labels[own]), strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= (rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[bytes], np.ndarray]:
    """Whole texts and labels of a bounded sample: `rows` labelled ids by hash.

    The sample of ids is what is broadcast. Null labels and ids are left out; an id with two labels counts as the lower, one with two texts as the
    text with the smaller hash, so the same rows give the same sample after any loss.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    ids = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    known_texts = docs.join(F.broadcast(ids), "doc_id")
    one = known_texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("t"), F.min("quality").alias("quality"))
    found = one.select("doc_id", "t.text", "quality").orderBy("doc_id").collect()
    return [r["text"].encode() for r in found], np.array([r["quality"] for r in found], dtype=np.float32)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most 256 texts and about SCORED_AT_ONCE bytes."""
    sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        many = int(np.searchsorted(np.cumsum(sizes[at : at + 256]), SCORED_AT_ONCE, side="right"))
        yield batch.slice(at, max(1, many))
        at += max(1, many)


def scored(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, one row per input row; a null or empty text is scored as no bytes at all."""
    rows = only(docs, doc_id=doc_id, text=text)
    rows = rows.select("doc_id", held_out().alias("held_out"), "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                scores = net.scores([t.as_py().encode() for t in part.column("text")])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, **columns: str) -> DataFrame:
    """Fit on the labelled sample and score every document: one row per input row.

    Null and empty texts are scored as no bytes, repeated rows alike; a null id is never held out and never learned from. Without labels, or with one class only, all
    scores are equal; without documents there are no rows.
    """
    named = only(docs, doc_id=columns.get("doc_id", "doc_id"), text=columns.get("text", "text"))
    net = fit(*training_rows(named, labels.select("doc_id", "quality"), rows))
    return scored(docs, net, **columns)
