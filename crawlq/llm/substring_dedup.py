"""Removal of word sequences that stand anywhere else, found through fixed anchors.

Every text is cut into reference blocks of ANCHOR words that do not overlap. A window of WINDOW = 2 * ANCHOR - 1 words always
holds exactly one such block, so if a window stands in two places, the block in one of them matches a rolling
window of ANCHOR words in the other. The blocks are the index; every rolling window of every text probes it. A block that some other
place matches is a hit, and only the windows around hits are looked at further: they are
extended to the full WINDOW words, counted by two hashes of 64 bits each, the second of which also chooses the bucket, and runs of
repeated windows merge into maximal exact repeats.

Nothing is paired. Texts are dealt to batches of some megabytes. A batch sends each bucket of the hash space the sorted hashes it
holds, once each however often they occur, and gets back one bit per hash: stands elsewhere or not. A passage found in
a third of all documents is thus one hash per batch, and the answers are bits, not places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlq.llm.common import hot_keys, only, parts_for, stored, text_bytes
from crawlq.llm.hashing import Words, blocks

WINDOW = 35
PER_BATCH = 8 << 20
#: Bytes of text per bucket: about two million rolling windows.
PER_BUCKET = 12 << 20


class Batch:
    """The texts of a batch in a fixed order, their word hashes, and what can be said about their windows."""

    def __init__(self, table: pa.Table, window: int):
        self.window, self.anchor = window, (window + 1) // 2
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i], texts[i])) if len(ids) > 1 else [0] * len(ids)
        self.rows = order
        self.texts = [texts[i].encode() for i in order]
        held = table.column("copies").to_pylist()
        self.copies = [held[i] for i in order]
        first, second, owner, at = [], [], [], 0
        for block in blocks(self.texts):
            words = Words(block)
            first.append(words.hashes)
            second.append(words.hashed(2))
            owner.append(words.text + at)
            at += len(block)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        self.first, self.second, self.owner = join(first, np.uint64), join(second, np.uint64), join(owner, np.int64)
        self.begins = np.searchsorted(self.owner, np.arange(len(self.texts) + 1))
        #: Position of each word in its text.
        self.place = np.arange(len(self.owner)) - self.begins[self.owner]
        #: Words of texts that stand for more than one equal row.
        self.copied = np.array([n > 1 for n in self.copies], dtype=bool)[self.owner]

    def windows(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return Words.windows(_Stand(self.owner, hashes), k)

    def rolling(self, buckets: int) -> "Held":
        """All rolling windows of ANCHOR words, with those that are reference blocks marked."""
        at, h = self.windows(self.anchor, self.first)
        return Held(at, (h >> np.uint64(32)) % np.uint64(buckets), (h & np.uint64(0xFFFFFFFF)), self.place[at] % self.anchor == 0, copied=self.copied[at])

    def candidates(self, buckets: int, hit: np.ndarray) -> "Held":
        """The windows of WINDOW words whose reference block, given by its first word, is hit."""
        at, h = self.windows(self.window, self.first)
        block = at + (-self.place[at]) % self.anchor
        marked = np.zeros(len(self.owner) + self.anchor, dtype=bool)
        marked[hit] = True
        keep = marked[block]
        at, h = at[keep], h[keep]
        _, other = self.windows(self.window, self.second)
        other = other[keep]
        return Held(at, other % np.uint64(buckets), h, np.ones(len(at), dtype=bool), other, self.copied[at])


class _Stand:
    """Just enough of `Words` for its windows."""

    def __init__(self, text: np.ndarray, hashes: np.ndarray):
        self.text, self.hashes = text, hashes


class Held:
    """Windows of a batch, grouped by bucket and value, or by bucket and a pair of values."""

    def __init__(
        self, at: np.ndarray, bucket: np.ndarray, value: np.ndarray, wanted: np.ndarray, other: np.ndarray | None = None, copied: np.ndarray | None = None
    ):
        self.at = at
        order = np.lexsort((value, bucket) if other is None else (other, value, bucket))
        b, v = bucket[order], value[order]
        new = np.ones(len(b), dtype=bool)
        new[1:] = (b[1:] != b[:-1]) | (v[1:] != v[:-1])
        if other is not None:
            o = other[order]
            new[1:] |= o[1:] != o[:-1]
        starts = np.flatnonzero(new)
        self.group = np.empty(len(b), dtype=np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.bucket, self.value = b[starts], v[starts]
        self.other = None if other is None else o[starts]
        self.many = np.diff(np.append(starts, len(b))) > 1
        if copied is not None:
            self.many |= np.bincount(self.group, weights=copied, minlength=len(starts)) > 0
        self.wanted = np.bincount(self.group, weights=wanted, minlength=len(starts)) > 0
        changes = np.flatnonzero(self.bucket[1:] != self.bucket[:-1]) + 1
        bounds = [0, *changes.tolist(), len(self.bucket)] if len(starts) else []
        #: First and last value of each bucket.
        self.parts = list(zip(bounds, bounds[1:], strict=False))

    def messages(self, batch: int) -> dict[str, list]:
        """One row per bucket."""
        out: dict[str, list] = {"bucket": [], "batch": [], "values": [], "many": [], "wanted": []}
        for a, b in self.parts:
            out["bucket"].append(int(self.bucket[a]))
            out["batch"].append(batch)
            out["values"].append(_packed(self.value[a:b]) if self.other is None else _paired(self.value[a:b], self.other[a:b]))
            out["many"].append(np.packbits(self.many[a:b]).tobytes())
            out["wanted"].append(np.packbits(self.wanted[a:b]).tobytes())
        return out

    def answered(self, answers: dict[int, bytes]) -> np.ndarray:
        """First word of every window whose value was answered with 1."""
        yes = np.zeros(len(self.bucket), dtype=bool)
        for a, b in self.parts:
            bits = answers.get(int(self.bucket[a]))
            if bits is not None:
                yes[a:b] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=b - a)
        return self.at[yes[self.group]] if len(self.group) else self.at


def _packed(values: np.ndarray) -> bytes:
    """Sorted values of 32 bits as differences, byte by byte, which compresses well."""
    steps = np.diff(values.astype("<u4"), prepend=np.uint32(0)).astype("<u4")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps.astype(np.uint64))


def _paired(values: np.ndarray, others: np.ndarray) -> bytes:
    """Pairs of 64 bits each, all first halves before all second ones."""
    return values.astype("<u8").tobytes() + others.astype("<u8").tobytes()


def _halves(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data, dtype="<u8").reshape(2, -1)
    return both[0], both[1]


def _again(values: list[np.ndarray], many: list[np.ndarray]) -> list[np.ndarray]:
    """For each list of distinct values, which of them stand at least twice over all lists; those marked `many` do by themselves."""
    joined = np.sort(np.concatenate(values + [v[m > 0] for v, m in zip(values, many, strict=True)]))
    again = np.unique(joined[1:][joined[1:] == joined[:-1]])
    out = []
    for v in values:
        at = np.searchsorted(again, v)
        found = np.zeros(len(v), dtype=bool)
        inside = at < len(again)
        found[inside] = again[at[inside]] == v[inside]
        out.append(found)
    return out


def _pairs_again(pairs: list[tuple[np.ndarray, np.ndarray]], many: list[np.ndarray]) -> list[np.ndarray]:
    """The same for distinct pairs: both halves must be equal."""
    first, second = (np.concatenate(half) for half in zip(*pairs, strict=True))
    order = np.lexsort((second, first))
    f, s = first[order], second[order]
    new = np.ones(len(f), dtype=bool)
    new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
    group = np.cumsum(new) - 1
    places = np.bincount(group, weights=1 + (np.concatenate(many)[order] > 0))
    found = np.empty(len(f), dtype=bool)
    found[order] = places[group] >= 2
    return np.split(found, np.cumsum([len(m) for m in many])[:-1])


MESSAGE = "bucket bigint, batch bigint, values binary, many binary, wanted binary"
ANSWER = "batch bigint, kind int, bucket bigint, bits binary"
MESSAGE_TYPES = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("values", pa.binary()), ("many", pa.binary()), ("wanted", pa.binary())])
ANSWER_TYPES = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("bits", pa.binary())])


def answers(messages: DataFrame, kind: int, wide: bool) -> DataFrame:
    """For each batch and bucket, one bit per value (pair of values, if `wide`): wanted there, and found at least twice over all batches."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        values = [_halves(v) if wide else _unpacked(v) for v in table.column("values").to_pylist()]
        sizes = [len(v[0]) if wide else len(v) for v in values]
        bits = lambda name: [np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=n) for m, n in zip(table.column(name).to_pylist(), sizes, strict=True)]
        repeated = (_pairs_again if wide else _again)(values, bits("many"))
        out: dict[str, list] = {"batch": [], "kind": [], "bucket": [], "bits": []}
        for batch, found, w in zip(table.column("batch").to_pylist(), repeated, bits("wanted"), strict=True):
            found = found & (w > 0)
            if found.any():
                out["batch"].append(batch)
                out["kind"].append(kind)
                out["bucket"].append(bucket)
                out["bits"].append(np.packbits(found).tobytes())
        return pa.table(out, schema=ANSWER_TYPES)

    return messages.groupBy("bucket").applyInArrow(run, ANSWER)


def _by_bucket(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {r["bucket"]: r["bits"] for r in table.to_pylist() if r["kind"] == kind}


def repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept, spans.

    A word is removed when a window of `window` words that covers it stands at another place too, in the same text
    or another, judged on the texts as they come in. `kept` joins the other words by one blank; `spans` are the first and
    last word of each maximal repeat. A null, empty or shorter text has none. Equal rows are places of their own, so
    repeated texts of `window` words or more go entirely; a row that stands in more than a thousandth of the table is counted and dealt
    to many batches as one text and a number.
    """
    if window < 3 or window % 2 == 0:
        raise ValueError("the window must be an odd number of words, 3 or more")
    rows = only(docs, doc_id=doc_id, text=text)
    _, size = text_bytes(rows)
    batches, buckets = parts_for(size, PER_BATCH, least=32), parts_for(size, PER_BUCKET, least=32)
    dealt = _dealt(rows, batches)

    def probe(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        held = Batch(table, window).rolling(buckets)
        return pa.table(held.messages(key[0].as_py()), schema=MESSAGE_TYPES)

    def extend(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        batch = Batch(table, window)
        hit = _hit(batch, buckets, replies)
        return pa.table(batch.candidates(buckets, hit).messages(key[0].as_py()), schema=MESSAGE_TYPES)

    id_type = rows.schema["doc_id"].dataType.simpleString()

    def remove(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        batch = Batch(table, window)
        again = batch.candidates(buckets, _hit(batch, buckets, replies)).answered(_by_bucket(replies, 1))
        edges = np.zeros(len(batch.owner) + window + 1, dtype=np.int64)
        np.add.at(edges, again, 1)
        np.add.at(edges, again + window, -1)
        gone = np.cumsum(edges)[: len(batch.owner)] > 0
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": [], "spans": [], "copies": batch.copies}
        for k, data in enumerate(batch.texts):
            own = gone[batch.begins[k] : batch.begins[k + 1]]
            words = data.split()
            removed = int(own.sum())
            out["n_words"].append(len(words))
            out["n_removed"].append(removed)
            out["kept"].append(b" ".join([w for w, g in zip(words, own.tolist(), strict=True) if not g] if removed else words).decode())
            turns = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
            out["spans"].append([{"first": int(a), "last": int(b) - 1} for a, b in zip(turns[::2], turns[1::2], strict=True)])
        ids = table.column("doc_id").combine_chunks().take(pa.array(batch.rows, pa.int64()))
        return pa.table(
            [ids, pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string()),
             pa.array(out["spans"], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(out["copies"], pa.int64())],
            names=["doc_id", "n_words", "n_removed", "kept", "spans", "copies"],
        )

    hits = answers(dealt.groupBy("batch").applyInArrow(probe, MESSAGE), 0, wide=False)
    full = answers(dealt.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(extend, MESSAGE), 1, wide=True)
    schema = f"doc_id {id_type}, n_words bigint, n_removed bigint, kept string, spans array<struct<first:bigint,last:bigint>>, copies bigint"
    found = dealt.groupBy("batch").cogroup(hits.unionByName(full).groupBy("batch")).applyInArrow(remove, schema)
    return found.select("doc_id", "n_words", "n_removed", "kept", "spans", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("col")


def _dealt(rows: DataFrame, batches: int) -> DataFrame:
    """doc_id, text, copies, batch: rows by a hash of all they hold, and each very frequent row in equal shares over all batches."""
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    hot = stored(hot_keys(keyed, "doc_id", "text_key").select(F.col("doc_id").alias("hot_id"), F.col("text_key").alias("hot_key")))
    same = F.expr("doc_id <=> hot_id AND text_key = hot_key")
    at = F.xxhash64("doc_id", "text")
    alone = ("doc_id", "text", F.lit(1).cast("bigint").alias("copies"), F.pmod(at, F.lit(batches)).cast("bigint").alias("batch"))
    if hot.isEmpty():
        return rows.select(*alone)
    usual = keyed.join(F.broadcast(hot), same, "left_anti").select(*alone)
    counted = keyed.join(F.broadcast(hot), same, "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))
    shares = counted.select("doc_id", "text", "n", F.expr(f"least(n, {batches})").alias("k"))
    shares = shares.select("*", F.explode(F.expr("sequence(0, k - 1)")).alias("i"))
    return usual.unionByName(
        shares.select(
            "doc_id", "text", F.expr("n DIV k + CAST(i < n % k AS BIGINT)").alias("copies"),
            F.pmod(F.pmod(at, F.lit(batches)) + F.col("i"), F.lit(batches)).cast("bigint").alias("batch"),
        )
    )


def _hit(batch: Batch, buckets: int, replies: pa.Table) -> np.ndarray:
    """First words of the reference blocks that stand elsewhere too."""
    at = batch.rolling(buckets).answered(_by_bucket(replies, 0))
    return at[batch.place[at] % batch.anchor == 0]
