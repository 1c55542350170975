"""SimHash fingerprints of whole texts, and the search for all within a Hamming radius.

The terms of a text are its words, pairs and triples of neighbouring words. Each term has a hash of 128 bits and a weight; every
bit of the hash votes for or against the same bit of the fingerprint. Single words weigh by their length, since
short ones stand in every text. Texts that share most terms share most bits.

For the search, a fingerprint of 32 hexadecimal digits is cut into radius // 2 + 1 blocks of bits. Two within the radius differ
by at most one bit in at least one block, since two bits in every block would be more. There is a table per block, with that
block moved to the front as its key; a query looks under its own key and under those one bit from it, which
finds all. Stored fingerprints thus move once per block and only queries, which are few, many times. Candidates are compared in
full inside the join, and a pair counts in the first block that finds it, so it leaves the join once.

The radius comes from measured distances: edits that leave a 5-word Jaccard similarity of 0.8 or more move 11 bits on average.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlq.llm.common import only, parts_for, stored, text_bytes
from crawlq.llm.hashing import BLOCK, Words, blocks, mix

BITS = 128
RADIUS = 17
#: Copies of one text are spread over this many tasks where their count of near fingerprints is joined back.
SALTS = 16
#: Range partitions whose followers are looked up together.
PARTS_TOGETHER = 4096
PER_PART = 16 << 20
#: For every byte value, its bits as votes.
VOTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1
SALT = np.uint64(0xA0761D6478BD642F)
#: Bytes of text handled at a time: their votes stay in the cache.
NEAR = 1 << 17


def fingerprints_of(texts: list[bytes]) -> list[bytes]:
    """16 bytes per text; a text without words, or with votes that all tie, has zeros there."""
    found = []
    for block in blocks(texts, NEAR):
        words = Words(block)
        lengths = (words.ends - words.starts).astype(np.float64)
        votes = np.zeros(len(block) * 16 * 256)
        for k in (1, 2, 3):
            if k == 1:
                at, h, weight = np.arange(len(words.hashes)), words.hashes, np.minimum(lengths, 10) / 20
            else:
                at, h = words.windows(k)
                weight = np.ones(len(at))
            terms = np.stack([h, mix(h ^ SALT)], axis=1).view(np.uint8)
            base = words.text[at] * 4096
            for byte in range(16):
                votes += np.bincount(base + byte * 256 + terms[:, byte], weights=weight, minlength=len(votes))
        bits = votes.reshape(-1, 256) @ VOTES > 0
        packed = np.packbits(bits, axis=1).reshape(len(block), 16)
        found += [row.tobytes() for row in packed]
    return found


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """`text` with its last quarter replaced by as much of the beginning of `following`."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (32 hexadecimal digits), one row per input row; equal texts have equal fingerprints."""
    rows = only(docs, doc_id=doc_id, text=text)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                prints = [p.hex() for p in fingerprints_of([t.as_py().encode() for t in part.column("text")])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {id_type}, fingerprint string")


def _half(column: str, i: int) -> str:
    """SQL text: one half of a fingerprint of 32 digits as a signed number."""
    return f"CAST(conv(substring({column}, {1 + 16 * i}, 16), 16, -10) AS BIGINT)"


def _bounds(radius: int) -> list[tuple[int, int]]:
    """First and last bit (exclusive) of each block; three at least, so that a block fits into a number beside its index."""
    n = max(3, radius // 2 + 1)
    cuts = [round(BITS * i / n) for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _block(a: int, b: int) -> str:
    """SQL text: bits a to b of the fingerprint held in `hi` and `lo`."""
    mask = f"{(1 << (b - a)) - 1}L"
    if b <= 64:
        return f"(shiftrightunsigned(hi, {64 - b}) & {mask})"
    if a >= 64:
        return f"(shiftrightunsigned(lo, {BITS - b}) & {mask})"
    return f"((shiftleft(hi, {b - 64}) | shiftrightunsigned(lo, {BITS - b})) & {mask})"


def _differing(a: int, b: int) -> str:
    """SQL text: how many of bits a to b differ between a fingerprint and a query."""
    mask = (1 << (BITS - a)) - (1 << (BITS - b))
    halves = [("hi", mask >> 64), ("lo", mask & ((1 << 64) - 1))]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return " + ".join(f"bit_count((asked_{c} ^ {c}) & CAST('{signed(m)}' AS BIGINT))" for c, m in halves if m)


def _matches(queries: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """asked_hi, asked_lo, and hi, lo and what else `prints` holds, for each pair within the radius, once. Neither side may hold repeats."""
    bounds = _bounds(radius)
    # The index of the block stands above its bits, of which there are 43 at most.
    fronts = [f"({i}L * {1 << 48}L + {_block(a, b)})" for i, (a, b) in enumerate(bounds)]
    beside = [f"array({f}), transform(sequence(0, {b - a - 1}), j -> {f} ^ shiftleft(1L, j))" for f, (a, b) in zip(fronts, bounds, strict=True)]
    stand = prints.withColumn("front", F.explode(F.expr(f"array({', '.join(fronts)})")))
    asks = queries.withColumn("asked_front", F.explode(F.expr(f"concat({', '.join(beside)})")))
    asks = asks.select(F.col("hi").alias("asked_hi"), F.col("lo").alias("asked_lo"), "asked_front")
    first = " ".join(f"WHEN {_differing(a, b)} <= 1 THEN {i}" for i, (a, b) in enumerate(bounds))
    same = f"""front = asked_front AND bit_count(asked_hi ^ hi) + bit_count(asked_lo ^ lo) <= {radius}
        AND CASE {first} END = shiftright(front, 48)"""
    return stand.join(asks, F.expr(same)).drop("front", "asked_front")


def within(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """query, other, distance: all pairs of a query's and another fingerprint at most `radius` bits apart, equal ones included.

    Both sides have a `fingerprint` column; repeats are collapsed first, so a group of copies is one row in each table.
    A null fingerprint has no pairs.
    """
    if not 0 <= radius < BITS // 2:
        raise ValueError("the radius must be less than half of the bits")
    halves = [F.expr(_half("fingerprint", i)).alias(c) for i, c in enumerate(("hi", "lo"))]
    one = lambda df: df.select("fingerprint").where("fingerprint IS NOT NULL").distinct().select(*halves)
    return _matches(one(queries), one(prints), radius).select(
        F.expr(_digits("asked_hi", "asked_lo")).alias("query"),
        F.expr(_digits("hi", "lo")).alias("other"),
        F.expr("bit_count(asked_hi ^ hi) + bit_count(asked_lo ^ lo)").alias("distance"),
    )


def _digits(hi: str, lo: str) -> str:
    return f"lower(concat(lpad(hex({hi}), 16, '0'), lpad(hex({lo}), 16, '0')))"


def _streamed(rows: DataFrame) -> DataFrame:
    """Fingerprints along the order of ids within partitions, with the edges that cross partitions left open.

    A row with `tail` is the last of its partition and still misses its follower; `head` is the first text of a partition.
    """
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["part", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "head", "tail"]
    schema = f"part int, doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, head string, tail string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kinds = pa.schema([("part", pa.int32())])
        held: list[tuple] = []  # (id, text, fingerprint or None)
        opened = None
        id_kind = None

        def emit(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = [kinds.field("part").type, id_kind, pa.int64(), *[pa.string()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        def flush(last: bool) -> list[tuple]:
            nonlocal held, opened
            missing = [i for i, x in enumerate(held) if x[2] is None]
            for i, p in zip(missing, fingerprints_of([held[i][1].encode() for i in missing]), strict=True):
                held[i] = (*held[i][:2], p)
            changed = [edited(a[1], b[1]) for a, b in zip(held, held[1:], strict=False)]
            raw = [c.encode() for c in changed]
            out = []
            for (doc, text, own), (_, _, after), data, there in zip(held, held[1:], raw, fingerprints_of(raw), strict=False):
                out.append((part, doc, len(text), hashlib.sha256(data).hexdigest(), own.hex(), there.hex(), after.hex(), opened, None))
                opened = None
            held = held[-1:]
            if last and held:
                doc, text, own = held[0]
                out.append((part, doc, len(text), None, own.hex(), None, None, opened, text))
            return out

        size = 0
        for batch in batches:
            id_kind = batch.schema.field("doc_id").type
            for doc, value in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text = value.as_py()
                if opened is None and not held:
                    opened = text
                held.append((doc.as_py(), text, None))
                size += len(text)
                if size >= BLOCK and len(held) > 1:
                    yield emit(flush(False))
                    size = 0
        if held:
            yield emit(flush(True))

    return rows.mapInArrow(run, schema)


def edit_likeness(docs: DataFrame, radius: int = RADIUS, every: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near.

    The edited text is `edited(text, following)`; the follower of a row is the next by id (rows of one id by the hash of their
    text, null ids first), of the last row the first. `n_near`, for ids divisible by `every`, is how many other documents have a fingerprint within
    the radius, else null. Null and empty texts have the fingerprint of zeros. A single row follows itself.

    Texts are moved once, to ranges of ids. Each partition handles its own rows in order; what crosses to the next partition is one
    text per partition.
    """
    spark = docs.sparkSession
    rows = only(docs, doc_id=doc_id, text=text)
    _, size = text_bytes(rows)
    parts = parts_for(size, PER_PART, least=8)
    # Ranges are cut by sampled keys, which must be small: a hash tells the texts of one id apart.
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = stored(_streamed(ordered))
    # One row per partition: where each begins, and what its last text is followed by.
    heads = found.where("head IS NOT NULL").select("part", F.col("head"), F.col("fingerprint").alias("head_print"))
    edges = found.where("tail IS NOT NULL").select("part", "doc_id", "n_chars", "fingerprint", "tail")
    # The next partition that has rows: among its neighbours, or else the first of a later group, after the last the first of all.
    grouped = heads.select("part", F.expr(f"part DIV {PARTS_TOGETHER}").alias("together"))
    inside = grouped.withColumn("to", F.lead("part").over(Window.partitionBy("together").orderBy("part")))
    firsts = grouped.groupBy("together").agg(F.min("part").alias("first"))
    every_group = Window.orderBy("together")
    firsts = firsts.select("together", F.coalesce(F.lead("first").over(every_group), F.first("first").over(every_group)).alias("after"))
    following = inside.join(firsts, "together").select("part", F.coalesce("to", "after").alias("to"))
    crossing = edges.join(following, "part").join(heads.withColumnRenamed("part", "to"), "to")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed = [edited(a.as_py(), b.as_py()).encode() for a, b in zip(batch.column("tail"), batch.column("head"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_chars"), pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
                 batch.column("fingerprint"), pa.array([p.hex() for p in fingerprints_of(changed)], pa.string()), batch.column("head_print")],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"],
            )

    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
    crossed = crossing.mapInArrow(cross, f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")
    whole = found.where("tail IS NULL").select(*columns).unionByName(crossed)
    near = lambda a, b: F.expr(f"1 - ({' + '.join(f'bit_count({_half(a, i)} ^ {_half(b, i)})' for i in (0, 1))}) / {BITS}D")
    whole = whole.select(*columns[:-1], near("fingerprint", "edited_fingerprint").alias("near_edited"), near("fingerprint", "next_fingerprint").alias("near_next"))
    asked = F.expr(f"coalesce(CAST(doc_id AS BIGINT) % {every} = 0, false)")
    # One row per fingerprint, with its documents and whether one of them asks.
    held = found.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.max(asked).alias("asks"))
    held = stored(held.select(*[F.expr(_half("fingerprint", i)).alias(c) for i, c in enumerate(("hi", "lo"))], "n", "asks"))
    pairs = _matches(held.where("asks").select("hi", "lo"), held.select("hi", "lo", "n"), radius)
    near_by = pairs.groupBy("asked_hi", "asked_lo").agg((F.sum("n") - 1).alias("n_near"))
    near_by = near_by.select(F.expr(_digits("asked_hi", "asked_lo")).alias("query"), "n_near", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("at"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    answered = whole.where(asked).join(near_by, (F.col("fingerprint") == F.col("query")) & (salt == F.col("at")))
    rest = whole.where(~asked).select(*whole.columns, F.lit(None).cast("bigint").alias("n_near"))
    return answered.select(*whole.columns, "n_near").unionByName(rest)
