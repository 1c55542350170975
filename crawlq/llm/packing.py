"""Packing pieces of documents into sequences of a fixed number of tokens.

Only the histogram of piece lengths matters for a plan, and it has at most `capacity` rows however many pieces
there are. Over it the configuration linear program is solved by multiplicative weights: a configuration is a
set of lengths that fits a sequence, the price of a length falls as it gets covered, and a knapsack dynamic program finds
the most valuable configuration. Only full sequences are taken from the solution, which is rounded, so what it places wastes nothing; it is solved again for
what is left as long as that costs no sequence. The pieces left over are packed best-fit, still as a histogram, and the plan is never worse than best-fit alone.

The plan gives every length a list of ranges of ranks. Pieces are ranked within their length by two
levels of counts, so that a length with a third of all pieces is spread over buckets, and each piece finds its place
from its rank alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlq.llm.common import only, parts_for, stored
from crawlq.llm.tokens import VOCABULARY, encoder

CAPACITY = 2048
END = 0
#: The program covers lengths in rounds of a step of the demand up to a goal, with smaller ones where those cost a sequence, and is
#: solved again for what is left, at most PARTS times.
ROUNDS = ((0.1, 0.3), (0.05, 0.2))
PARTS = 4
RATE = 8.0
#: Lengths that may be used up before a knapsack table is made anew.
RENEW = 128
PER_BUCKET = 200_000


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids: each text's ids and the end id, cut only where they exceed `capacity`.

    The first piece holds what is over, all others are full. `ids` are packed little-endian unsigned 32-bit. A null or
    empty text is the end id alone.
    """
    rows = only(docs, doc_id=doc_id, text=text)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([END], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                where, piece, start, length, ids = [], [], [], [], []
                for row, value in enumerate(part.column("text")):
                    packed = encode(value.as_py()) + end
                    n = len(packed) // 4
                    bounds = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k in range(len(bounds) - 1):
                        where.append(row)
                        piece.append(k)
                        start.append(bounds[k])
                        length.append(bounds[k + 1] - bounds[k])
                        ids.append(packed[4 * bounds[k] : 4 * bounds[k + 1]])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(where)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return rows.mapInArrow(run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids binary")


def knapsack_table(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """The most value within every room up to `capacity`; `sizes` ascend."""
    best = np.zeros(capacity + 1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        n = fits[room]
        best[room] = max(best[room - 1], (best[room - sizes[:n]] + values[:n]).max()) if n else best[room - 1]
    return best


def fractional(sizes: np.ndarray, demand: np.ndarray, capacity: int, step: float = ROUNDS[0][0], goal: float = ROUNDS[0][1]) -> tuple[list[dict[tuple, float]], float]:
    """Full configurations that cover every length to a share, after each round up to `goal`, and a lower bound of all sequences that `demand` needs.

    Multiplicative weights over the configuration program: a round prices a length by its size, times a weight that falls with
    what is covered of it, and solves the knapsack by dynamic programming. From its table every length that is behind takes the most valuable configurations
    that hold it, of equally good ones those whose lengths are least covered. A length may run ahead of the round by half a step;
    the table is made anew when RENEW lengths have. A configuration that leaves room is worth less than its tokens, and is not taken: what
    no full one holds is left over. The prices over the best value bound the program from below.
    """
    covered = np.zeros(len(sizes))
    amounts: Counter = Counter()
    solutions = []
    bound = float((demand * sizes).sum() / capacity)
    for target in np.arange(1, round(goal / step) + 1) * step:
        limit = min(1.0, target + step / 2)
        values = sizes * np.exp(-RATE * (covered - covered.min()))
        bound = max(bound, float((demand * values).sum() / knapsack_table(sizes, values, capacity)[capacity]))
        closed = RENEW
        for i in np.argsort(-sizes, kind="stable").tolist():
            while covered[i] < target - 1e-9:
                if closed >= RENEW:
                    open_ = covered < limit - 1e-9
                    best, closed = knapsack_table(sizes[open_], values[open_], capacity), 0
                counts: Counter = Counter({i: 1})
                room = capacity - int(sizes[i])
                while room:
                    fits = np.flatnonzero(covered[: np.searchsorted(sizes, room, side="right")] < limit - 1e-9)
                    if not len(fits):
                        break
                    worth = best[room - sizes[fits]] + values[fits]
                    good = fits[worth >= worth.max() * (1 - 1e-3)]
                    k = int(good[covered[good].argmin()])
                    counts[k] += 1
                    room -= int(sizes[k])
                amount = min(float(((target if k == i else limit) - covered[k]) * demand[k] / n) for k, n in counts.items())
                if room or amount <= 0:
                    break
                amounts[tuple(sorted(counts.items()))] += amount
                for k, n in counts.items():
                    covered[k] += n * amount / demand[k]
                    closed += covered[k] >= limit - 1e-9
        solutions.append(dict(amounts))
    return solutions, bound


def rounded(config_amounts: dict[tuple, float], demand: np.ndarray) -> tuple[list[tuple[tuple, int]], np.ndarray]:
    """The solution in whole sequences, each configuration only as long as it can be filled, and the pieces that are left.

    Fractions of a sequence are carried on to the next configuration.
    """
    left, runs, carried = demand.copy(), [], 0.0
    for config, amount in sorted(config_amounts.items(), key=lambda x: (-x[1], x[0])):
        carried += amount
        many = int(carried + 1e-9)
        carried -= many
        many = min(many, *(int(left[i]) // n for i, n in config))
        if many:
            runs.append((config, many))
            for i, n in config:
                left[i] -= n * many
    return runs, left


def best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int, begun: list[tuple[tuple, int]] = ()) -> list[tuple[tuple, int]]:
    """Best fit, longest first, over a histogram into sequences `begun` and new ones: runs of equal sequences (configuration, how many)."""
    room: dict[int, list[list]] = {capacity: []}
    for config, many in begun:
        free = capacity - sum(int(sizes[i]) * n for i, n in config)
        room.setdefault(free, []).append([tuple(i for i, n in config for _ in range(n)), many])
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, todo = int(sizes[i]), int(left[i])
        while todo:
            fits = [r for r in room if r >= size and room[r] and r < capacity]
            if fits:
                r = min(fits)
                shape, many = room[r].pop()
                use = min(many, todo)
                if use < many:
                    room[r].append([shape, many - use])
                room.setdefault(r - size, []).append([(*shape, i), use])
                todo -= use
            else:
                each = capacity // size
                whole, rest = divmod(todo, each)
                if whole:
                    room.setdefault(capacity - each * size, []).append([(i,) * each, whole])
                if rest:
                    room.setdefault(capacity - rest * size, []).append([(i,) * rest, 1])
                todo = 0
    return [(tuple(sorted(Counter(shape).items())), many) for runs in room.values() for shape, many in runs]


class Plan(NamedTuple):
    """Runs of equal sequences, the fewest sequences there can be, and the share of the tokens below the capacity that the program placed."""

    runs: list[tuple[dict[int, int], int]]
    bound: int
    placed: float

    @property
    def sequences(self) -> int:
        return sum(many for _, many in self.runs)


def solved(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A packing of every piece of the histogram that never takes more sequences than best-fit alone.

    The program is solved for a part of what is left, rounded, and the rest packed best-fit; then again for a part of that rest. Of a part as many rounds
    count as cost no sequence; where none does, it ends.
    """
    if not histogram:
        return Plan([], 0, 0.0)
    if max(histogram) > capacity or min(histogram) < 1:
        raise ValueError("a length is outside 1 to the capacity")
    sizes = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    # Lengths below the capacity come first in `sizes`, so numbers of configurations hold in both.
    inner = len(sizes) - int(sizes[-1] == capacity)
    whole = int((sizes[:inner] * left[:inner]).sum())
    begun: list[tuple[tuple, int]] = []
    best, bound = best_fit(sizes, left, capacity), -(-int((sizes * left).sum()) // capacity)
    fewest = sum(many for _, many in best)
    for _ in range(PARTS):
        some = np.flatnonzero(left[:inner])
        found = None
        for step, goal in ROUNDS if len(some) else ():
            solutions, least = fractional(sizes[some], left[some], capacity, step, goal)
            if not begun:
                bound = max(bound, int(np.ceil(least - 1e-6)) + int(left[inner:].sum()))
            found = _accepted(sizes, left, some, solutions, begun, fewest, capacity)
            if found:
                break
        if not found:
            break
        begun, left, best = found
        fewest = sum(many for _, many in best)
    placed = 1 - int((sizes[:inner] * left[:inner]).sum()) / whole if whole else 0.0
    return Plan([({int(sizes[i]): n for i, n in config}, many) for config, many in best], bound, placed)


def _accepted(sizes: np.ndarray, left: np.ndarray, some: np.ndarray, solutions: list, begun: list, fewest: int, capacity: int) -> tuple | None:
    """The longest of the solutions that takes no more than `fewest` sequences: all it placed so far, what is left, and the whole packing."""
    for amounts in reversed(solutions):
        runs, rest = rounded(amounts, left[some])
        after = left.copy()
        after[some] = rest
        tried = [*begun, *[(tuple((int(some[i]), n) for i, n in config), many) for config, many in runs]]
        filled = best_fit(sizes, after, capacity, tried)
        if runs and sum(many for _, many in filled) <= fewest:
            return tried, after, filled
    return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Runs of equal sequences that hold every piece of the histogram: ({length: how many}, how many sequences)."""
    return solved(histogram, capacity).runs


def places(runs: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank, first sequence, pieces per sequence and first offset of each range of ranks."""
    found: dict[int, list[tuple]] = {}
    next_rank: Counter = Counter()
    sequence = 0
    for config, many in runs:
        offset = 0
        for size, n in sorted(config.items(), reverse=True):
            found.setdefault(size, []).append((next_rank[size], sequence, n, offset))
            next_rank[size] += n * many
            offset += n * size
        sequence += many
    return {size: tuple(np.array(column, dtype=np.int64) for column in zip(*rows, strict=True)) for size, rows in found.items()}


def ranked(items: DataFrame, order: tuple[str, ...], per_bucket: int = PER_BUCKET) -> DataFrame:
    """Adds `rank`, from 0 within each length, without bringing a length into one task.

    Items are dealt to buckets by their hash, numbered within (length, bucket), and shifted by the counts of the
    buckets before.
    """
    buckets = parts_for(items.count(), per_bucket, least=64)
    dealt = items.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sums = dealt.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0))).drop("__n")
    own = Window.partitionBy("length", "__bucket").orderBy(*order)
    numbered = dealt.withColumn("__own", F.row_number().over(own) - 1)
    joined = numbered.join(sums, ["length", "__bucket"])
    return joined.select(*items.columns, (F.col("__own") + F.col("__before")).alias("rank"))


def packed(items: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """Adds sequence_id and offset to `items`, which have a `length` of 1 to `capacity`.

    Sequences are filled without gaps from 0 and hold every item once; equal items are interchangeable. `items` is read more
    than once and must not change in between. No items, no sequences.
    """
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = places(plan(histogram, capacity))
    rows = ranked(items, order)
    names = items.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                first, base, each, start = where[int(size)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                n = rank[at] - first[k]
                sequence[at] = base[k] + n // each[k]
                offset[at] = start[k] + n % each[k] * size
            columns = [batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return rows.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, **columns: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: the pieces of all documents in sequences.

    The ids are reduced to their checksum before anything is shuffled; join `token_pieces` by doc_id and piece for the ids.
    A null or empty text is one piece, the end id; repeated rows are packed as often as they come; no documents, no rows.
    """
    pieces = token_pieces(docs, capacity, vocabulary, **columns)
    return packed(stored(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")), capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, **columns: str) -> DataFrame:
    """sequence_id, doc_ids, ids: the filled sequences themselves, packed like the pieces, with null and empty texts as end ids and repeated rows each for itself."""
    pieces = stored(token_pieces(docs, capacity, vocabulary, **columns).withColumn("ids_crc32", F.crc32("ids")))
    placed = packed(pieces.drop("ids"), capacity).dropDuplicates(["sequence_id", "offset"])
    ids = pieces.dropDuplicates(["doc_id", "piece", "ids_crc32"]).select("doc_id", "piece", "ids_crc32", "ids")
    p, i = placed.alias("p"), ids.alias("i")
    joined = p.join(i, F.expr("p.doc_id <=> i.doc_id AND p.piece = i.piece AND p.ids_crc32 = i.ids_crc32"))
    filled = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.col("p.doc_id").alias("doc_id"), "ids"))).alias("x"))
    return filled.select(
        "sequence_id", F.expr("x.doc_id").alias("doc_ids"), F.expr("unhex(array_join(transform(x, p -> hex(p.ids)), ''))").alias("ids")
    )
