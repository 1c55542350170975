"""Jaccard join over word shingles, with candidates pruned by what their MinHash values say.

1. Every text becomes its set of five-word shingles, a digest of the set and 128 MinHash values. Texts with equal sets form a
   class; everything below works on one member per class.
2. Classes that agree in one of 32 bands of four values are candidates. At the threshold of 0.8 a pair meets in some band
   but for one chance in 20 million.
3. The values of a candidate pair are compared 16 at a time. With m of h equal, the posterior (uniform prior) that
   the similarity reaches the threshold is a binomial tail; once it falls below TOLERANCE the pair is dropped. What is left
   connects classes to clusters.
4. Shingles are fetched for the classes of clusters alone. Within a cluster, cut into blocks, every pair is pruned the same way and
   the survivors are verified by exact set intersection.

No step emits pairs. Each task compares its pairs in memory and returns, per class, how many links it has, and as many edges as
connect what it found. Groups above a fixed size are cut into blocks. Where shingle sets are compared, a task takes two blocks of
one cluster, or small clusters of about one block together, so a cluster with a third of all rows is many tasks whose memory does
not grow with it. What moves does: every row of n goes to n / CLUSTER_BLOCK tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlq.llm.common import only, parts_for, stored
from crawlq.llm.graph import components
from crawlq.llm.hashing import Words, blocks, mix

SHINGLE = 5
THRESHOLD = 0.8
VALUES = 128
PER_BAND = 4
STEP = 16
#: Pairs less likely than this to reach the threshold are dropped.
TOLERANCE = 1e-9
#: Classes per block of a candidate group, and of a cluster.
GROUP_BLOCK = 1024
CLUSTER_BLOCK = 512
#: Rows per task of the comparing steps.
PER_TASK = 4096

_rng = np.random.default_rng(11)
MULTIPLY = _rng.integers(1, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
ADD = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words has one shingle of all of them, an empty one none."""
    found = []
    for block in blocks(texts):
        words = Words(block)
        counts = np.diff(words.first)
        hashes, owner = [], []
        for k in range(1, shingle + 1):
            if k < shingle and not (counts == k).any():
                continue
            at, h = words.windows(k)
            text = words.text[at]
            if k < shingle:
                keep = counts[text] == k
                text, h = text[keep], h[keep]
            hashes.append(h)
            owner.append(text)
        h, text = np.concatenate(hashes), np.concatenate(owner)
        order = np.argsort(text, kind="stable")
        cuts = np.searchsorted(text[order], np.arange(1, len(block)))
        found += [np.unique(part) for part in np.split(h[order], cuts)]
    return found


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """VALUES values of 16 bits."""
    low = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint32)
    h = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for at in range(0, len(h), 1024):
        low = np.minimum(low, (h[at : at + 1024, None] * MULTIPLY + ADD).min(axis=0))
    return (low & np.uint32(0xFFFF)).astype("<u2")


def digest(shingles: np.ndarray) -> bytes:
    """128 bits of a set, whatever its order."""
    a, b = mix(shingles), mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    return np.array([a.sum(dtype=np.uint64), b.sum(dtype=np.uint64)], dtype="<u8").tobytes()


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, fewest equal ones that keep a pair), STEP at a time.

    With a uniform prior and m of h values equal, the similarity is above t with the chance that h + 1 draws of
    chance t succeed at most m times.
    """
    steps = []
    for h in range(STEP, VALUES + 1, STEP):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += math.comb(h + 1, m) * threshold**m * (1 - threshold) ** (h + 1 - m)
        steps.append((h, m))
    return steps


def surviving(left: np.ndarray, right: np.ndarray | None, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose MinHash values keep the posterior above the tolerance; all pairs x < y within `left` if `right` is None."""
    other = left if right is None else right
    (h, m), *rest = steps
    equal = np.zeros((len(left), len(other)), dtype=np.uint8)
    for k in range(h):
        equal += left[:, k, None] == other[None, :, k]
    keep = equal >= m
    x, y = np.nonzero(np.triu(keep, 1) if right is None else keep)
    matches = equal[x, y].astype(np.int32)
    for to, m in rest:
        for at in range(0, len(x), 1 << 18):
            own = slice(at, at + (1 << 18))
            matches[own] += (left[x[own], h:to] == other[y[own], h:to]).sum(axis=1, dtype=np.int32)
        keep = matches >= m
        x, y, matches, h = x[keep], y[keep], matches[keep], to
    return x, y


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest member of each of n nodes' components."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def verified(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets have at least the threshold, by counting their common members."""
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [ids[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    common = np.zeros(len(x), dtype=np.int64)
    marked = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=bool)
    order = np.argsort(x, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(x[order])) + 1):
        a = own[x[part[0]]]
        marked[a] = True
        for at in range(0, len(part), 256):
            some = part[at : at + 256]
            hit = marked[np.concatenate([own[j] for j in y[some]])]
            common[some] = np.add.reduceat(hit, np.cumsum([0, *sizes[y[some][:-1]]]), dtype=np.int64)
        marked[a] = False
    return common >= threshold * (sizes[x] + sizes[y] - common) - 1e-9


SIGNED = "key binary, bands array<bigint>"


def signed(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, key (digest of the shingle set, null without words), bands (the MinHash values, four in one number)."""
    rows = only(docs, doc_id=doc_id, text=text).withColumn("text_key", F.xxhash64("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingle_sets([t.as_py().encode() for t in part.column("text")], shingle)
                keys = [digest(s) if len(s) else None for s in sets]
                bands = [minhashes(s).view("<i8").tolist() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "key", "bands"],
                )

    return rows.mapInArrow(run, f"doc_id {id_type}, text_key bigint, {SIGNED}")


def _blocked(df: DataFrame, size: str, per_block: int, *group: str) -> DataFrame:
    """A copy of each row for every task that compares its block: i and j number the two blocks, `first` tells which is its own."""
    df = df.withColumn("__n", F.expr(f"CAST(ceil({size} / {per_block}) AS INT)")).withColumn("__own", F.expr("pmod(xxhash64(key), __n)"))
    df = df.withColumn("__with", F.expr("explode(sequence(0, __n - 1))"))
    df = df.withColumn("i", F.expr("CAST(least(__own, __with) AS INT)")).withColumn("j", F.expr("CAST(greatest(__own, __with) AS INT)"))
    return df.withColumn("first", F.expr("__own = i")).drop("__n", "__own", "__with", size)


def _tasks(df: DataFrame, n: int, *group: str, own: str = "false") -> DataFrame:
    """Block pairs dealt to n tasks; where `own` holds, a pair is a task of its own."""
    pair = F.xxhash64(*group, "i", "j")
    return df.withColumn("task", F.when(F.expr(own), F.struct(F.lit(True), pair)).otherwise(F.struct(F.lit(False), F.pmod(pair, F.lit(n))))).groupBy("task")


def _groups(table: pa.Table, *names: str) -> Iterator[tuple[np.ndarray, bool]]:
    """Rows of each group of a task, its own block first, and whether it is one block alone."""
    held: dict[tuple, list[int]] = {}
    for k, row in enumerate(zip(*[table.column(n).to_pylist() for n in (*names, "i", "j")], strict=True)):
        held.setdefault(row, []).append(k)
    for row, at in held.items():
        yield np.array(at), row[-1] == row[-2]


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.astype("<i8").reshape(table.num_rows, -1)).view("<u2")


def _edges(keys: list, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple]:
    label = forest(len(at), x, y)
    moved = np.flatnonzero(label != np.arange(len(at)))
    return [(keys[at[k]], keys[at[label[k]]]) for k in moved]


def clusters(classes: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """key, cluster: classes connected by candidate pairs that pruning leaves; a class without any has no row."""
    banded = classes.select("key", F.posexplode("bands").alias("band", "value"))
    shared = banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = banded.join(shared, ["band", "value"]).join(classes.select("key", "bands"), "key")
    rows = stored(_blocked(members, "size", GROUP_BLOCK))
    steps = least_matches(threshold, tolerance)

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        values, keys, first = _matrix(table), table.column("key").to_pylist(), table.column("first").to_numpy(zero_copy_only=False)
        out = []
        for at, alone in _groups(table, "band", "value"):
            if alone:
                x, y = surviving(values[at], None, steps)
            else:
                at = np.concatenate([at[first[at]], at[~first[at]]])
                n = int(first[at].sum())
                if n in (0, len(at)):
                    continue
                x, y = surviving(values[at[:n]], values[at[n:]], steps)
                y = y + n
            out += _edges(keys, at, x, y)
        out = list(set(out))
        return pa.table([pa.array([e[k] for e in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    edges = _tasks(rows, parts_for(rows.count(), PER_TASK, least=16), "band", "value").applyInArrow(compare, "a binary, b binary")
    return components(edges).select(F.col("node").alias("key"), F.col("root").alias("cluster"))


def verified_links(docs: DataFrame, classes: DataFrame, clustered: DataFrame, shingle: int, threshold: float, tolerance: float) -> DataFrame:
    """key, other, linked: per class how many documents of other classes it is linked with, and edges that connect linked classes.

    Rows with `other` are edges, the others are counts.
    """
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    wanted = clustered.join(sizes, "cluster").join(classes.select("key", "doc_id", "text_key", "copies"), "key")
    w, d = wanted.alias("w"), docs.alias("d")
    texts = d.join(w, F.expr("d.doc_id <=> w.doc_id AND xxhash64(d.text) = w.text_key")).select("key", "cluster", "size", "copies", "text")
    # A row that stands twice in the input comes twice here.
    texts = texts.dropDuplicates(["key"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets([t.as_py().encode() for t in part.column("text")], shingle)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in ("key", "cluster", "size", "copies")],
                     pa.array([minhashes(s).view("<i8").tolist() for s in sets], pa.list_(pa.int64())),
                     pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())],
                    ["key", "cluster", "size", "copies", "bands", "shingles"],
                )

    found = texts.mapInArrow(shingled, "key binary, cluster binary, size bigint, copies bigint, bands array<bigint>, shingles binary")
    rows = _blocked(found.withColumn("cut", F.col("size") > CLUSTER_BLOCK), "size", CLUSTER_BLOCK)
    steps = least_matches(threshold, tolerance)
    kinds = pa.schema([("key", pa.binary()), ("other", pa.binary()), ("linked", pa.int64())])

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        values, keys, first = _matrix(table), table.column("key").to_pylist(), table.column("first").to_numpy(zero_copy_only=False)
        copies, held = table.column("copies").to_numpy(), table.column("shingles")
        out: dict[str, list] = {"key": [], "other": [], "linked": []}
        for at, alone in _groups(table, "cluster"):
            if alone:
                x, y = surviving(values[at], None, steps)
            else:
                at = np.concatenate([at[first[at]], at[~first[at]]])
                n = int(first[at].sum())
                if n in (0, len(at)):
                    continue
                x, y = surviving(values[at[:n]], values[at[n:]], steps)
                y = y + n
            if not len(x):
                continue
            sets = [np.frombuffer(held[int(k)].as_py(), dtype="<u8") for k in at]
            good = verified(sets, x, y, threshold)
            x, y = x[good], y[good]
            linked = np.bincount(x, weights=copies[at[y]], minlength=len(at)) + np.bincount(y, weights=copies[at[x]], minlength=len(at))
            for k in np.flatnonzero(linked):
                out["key"].append(keys[at[k]])
                out["other"].append(None)
                out["linked"].append(int(linked[k]))
            for a, b in _edges(keys, at, x, y):
                out["key"].append(a)
                out["other"].append(b)
                out["linked"].append(0)
        return pa.table(out, schema=kinds)

    n = parts_for(sizes.where(F.col("size") <= CLUSTER_BLOCK).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], CLUSTER_BLOCK, least=16)
    return _tasks(rows, n, "cluster", own="cut").applyInArrow(compare, "key binary, other binary, linked bigint")


def jaccard_join(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    shingle: int = SHINGLE,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, text_key, class_id, copy_id, n_copies, n_links, lead.

    `n_links` is how many other documents have a similarity of `threshold` or more. `class_id` is the smallest id of all that are
    connected by links, `copy_id` the smallest with the same shingles, `n_copies` how many have these. A text with one to
    four words has one shingle of all its words; null and empty texts have none, no links and their own id as class. Repeated rows
    are documents of their own. `lead` marks the row that stands for its class, the least id and text in it; equal rows lead together.
    """
    named = only(docs, doc_id=doc_id, text=text)
    rows = stored(signed(docs, shingle, doc_id, text))
    classes = stored(
        rows.where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.count(F.lit(1)).alias("copies"), F.max("bands").alias("bands"), F.min("doc_id").alias("copy_id"))
        .select("key", "least.doc_id", "least.text_key", "copies", "bands", "copy_id")
    )
    links = stored(verified_links(named, classes, clusters(classes, threshold, tolerance), shingle, threshold, tolerance))
    linked = links.where("other IS NULL").groupBy("key").agg(F.sum("linked").alias("linked"))
    roots = components(links.where("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b")))
    known = classes.select("key", "doc_id", "text_key", "copies", "copy_id").join(linked, "key", "left").join(
        roots.select(F.col("node").alias("key"), "root"), "key", "left"
    ).withColumn("root", F.coalesce("root", "key"))
    least = known.groupBy(F.col("root").alias("r")).agg(
        F.min("copy_id").alias("class_id"), F.min(F.struct("doc_id", "text_key")).alias("first")
    )
    known = known.join(least, F.col("root") == F.col("r")).select(F.col("key").alias("k"), "class_id", "first", "copy_id", "copies", "linked")
    joined = rows.select("doc_id", "text_key", "key").join(known, F.col("key") == F.col("k"), "left")
    return joined.select(
        "doc_id",
        "text_key",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        F.expr("coalesce(copies - 1, 0) + coalesce(linked, 0)").alias("n_links"),
        F.expr("k IS NULL OR struct(doc_id, text_key) <=> first").alias("lead"),
    )
