"""Ranked search, decontamination and centroid clustering against plain Python."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlq.llm import centroids, decontamination, ranked_search

UPPER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id bigint, text string"
ITEMS = "item_id bigint, text string"


# --- ranked search


def brute_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute_search(docs, items, top=10):
    cut = [(i, brute_terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in cut), sum(len(w) for _, w in cut)
    df = Counter(t for _, w in cut for t in set(w))
    found = []
    for item, text in items:
        rows = []
        for i, w in cut:
            if w:
                m, tf = 10 + 90 * len(w) * n_docs // n_terms, Counter(w)
                score = sum(
                    math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(brute_terms(text)) if tf[t]
                )
                if score > 0:
                    rows.append((-score, i is None, i or 0, i))
        found += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(rows)[:top], 1)]
    return Counter(found)


def made_texts(n, seed, vocabulary=120):
    rng = random.Random(seed)
    word = lambda: f"T{min(int(rng.expovariate(0.05)), vocabulary)}é"
    return [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def searched():
    docs = list(enumerate(made_texts(400, 1)))
    docs += [(3, docs[3][1])] * 5 + [(None, docs[7][1]), (900, None), (901, ""), (902, docs[9][1])]
    many = " ".join(f"t{i}é" for i in range(100))
    items = [(i, t) for i, t in enumerate(made_texts(12, 2))] + [(50, many), (51, None), (52, "nothing-like it"), (None, "T1é t2É"), (1, "t5é"), (1, "t5é")]
    return docs, items


def test_search_is_brute_force(spark, searched):
    docs, items = searched
    got = ranked_search.ranked_search(spark.createDataFrame(docs, DOCS).repartition(7), spark.createDataFrame(items, ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_search(docs, items)


def test_search_in_blocks_of_items(spark, searched):
    docs, items = searched
    got = ranked_search.ranked_search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), top=3, block_terms=60)
    assert Counter(map(tuple, got.collect())) == brute_search(docs, items, top=3)


def test_search_awkward_tables(docs, rows, nothing, spark):
    items = spark.createDataFrame([(1, "w1x1 w1x2 long5", "x"), (2, None, "x")], "item_id bigint, text string, score string")
    got = ranked_search.ranked_search(docs, items)
    assert Counter(map(tuple, got.collect())) == brute_search([r[:2] for r in rows], [(1, "w1x1 w1x2 long5"), (2, None)])
    assert ranked_search.ranked_search(nothing, items).collect() == []
    assert ranked_search.ranked_search(docs, items.limit(0)).collect() == []
    with pytest.raises(ValueError):
        ranked_search.ranked_search(docs, items, top=0)


def test_masks_are_left_out_safely():
    """Documents that cannot reach the best are not evaluated, and none of the best is lost."""
    rng = np.random.default_rng(3)
    n, width = 1500, 12
    tf = rng.integers(0, 3, (n, width)) * (rng.random((n, width)) < 0.2)
    doc, held = np.nonzero(tf)
    m, weights, numbers = rng.integers(50, 60, n), np.arange(1, width + 1) * 500, np.arange(width)
    block = ranked_search.Block(list(range(n)), m, doc, held, tf[doc, held], width)
    best = ranked_search.Best(10)
    evaluated = block.search(numbers, weights, best)
    scores = ranked_search.contributions(tf, m[:, None], weights).sum(axis=1)
    assert sorted((-s, i) for s, _, i in best.rows) == sorted((scores[i], i) for i in sorted(range(n), key=lambda i: (-scores[i], i))[:10])
    assert evaluated < n / 2


def test_long_products_and_long_texts():
    lengths = np.array([1, 10**7], dtype=np.int64)
    assert ranked_search.damping(lengths, 10**12, 10**14).tolist() == [10 + 90 * 10**12 // 10**14, 10 + 90 * 10**19 // 10**14]
    text = " ".join(f"a{i}" for i in range(400_000))
    assert sum(map(len, ranked_search.terms(text.encode()))) == 400_000
    assert [t for part in ranked_search.terms("A-b_C\x7fé z 9".encode()) for t in part] == [t.encode() for t in brute_terms("A-b_C\x7fé z 9")]


# --- decontamination


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute_decontamination(docs, items):
    windows = {}
    for item, text in items:
        w = brute_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("null" if item is None else str(item))
    found = []
    for i, text in docs:
        w, hit, names = brute_words(text), set(), set()
        for window, owners in windows.items():
            for at in range(len(w) - len(window) + 1):
                if tuple(w[at : at + len(window)]) == window:
                    hit |= set(range(at, at + len(window)))
                    names |= owners
        found.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return Counter(found)


PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards brew the strange potion near the old stone bridge"


@pytest.fixture(scope="module")
def leaks():
    items = [(1, PASSAGE), (2, "a short one"), (3, "single"), (4, PASSAGE.upper()), (10, "x y x y x y x y x y x y"), (None, "null item words"), (5, None), (6, " ,; "), (7, PASSAGE), (7, "rare " + PASSAGE)]
    words = PASSAGE.split()
    docs = [
        (1, "before " + PASSAGE + " after"),
        (2, " ".join(words[3:13])),  # exactly one window
        (3, " ".join(words[3:12])),  # one word short of it
        (4, "A Short, ONE and again a short one; single"),
        (5, "x y " * 30),
        (6, " ".join(words[:8] + ["inserted"] + words[8:])),
        (7, None),
        (8, ""),
        (1, "before " + PASSAGE + " after"),
        (None, "null item words"),
        (9, " ".join(reversed(words))),
        (11, "the " * 3000 + PASSAGE + " the" * 3000),
        (12, (PASSAGE + " ") * 5),
    ]
    return docs, items


def test_hits_are_brute_force(spark, leaks):
    docs, items = leaks
    got = decontamination.decontamination(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS))
    assert Counter(tuple(r)[:6] for r in got.collect()) == brute_decontamination(docs, items)


def test_random_leaks(spark):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(9)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 10, 11, 14])))) for i in range(40)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(100 + i, "u " + items[i][1] + " u " + items[i + 1][1]) for i in range(30)]
    got = decontamination.decontamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert Counter(tuple(r)[:6] for r in got.collect()) == brute_decontamination(docs, items)


def test_proximity(spark):
    """A word put into a passage leaves near windows over the place where it stands."""
    words = PASSAGE.split()
    docs = [(1, " ".join(words[:10] + ["inserted"] + words[10:])), (2, " ".join(words[:5])), (3, PASSAGE)]
    found = decontamination.passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, PASSAGE)], ITEMS)).collect()
    kinds = Counter((r["doc_id"], r["kind"]) for r in found)
    assert kinds[1, "phrase"] == 1 + len(words) - 19 and kinds[1, "proximity"] >= 5 and kinds[3, "phrase"] == len(words) - 9
    assert not any(r["doc_id"] == 2 for r in found)
    assert all(r["n_exact"] == r["size"] for r in found if r["kind"] == "phrase")


def brute_near(docs, items):
    """(doc, item) where some start brings 80% of a window's words within 5 of their places."""
    found = set()
    for (d, text), (item, passage) in itertools.product(docs, items):
        w, p = brute_words(text), brute_words(passage)
        for i in range(max(1, len(p) - 9) if p else 0):
            window = p[i : i + 10]
            for start in range(-len(window) - 5, len(w) + 6):
                n_near = sum(x in w[max(0, start + o - 5) : max(0, start + o + 6)] for o, x in enumerate(window))
                if 100 * n_near >= 80 * len(window) and (len(window) > 1 or window == w[max(0, start) : start + 1]):
                    found.add((d, item))
    return found


def test_proximity_is_brute_force(spark):
    """Words between strangers, lost rare words, other orders and gaps are near all the same."""
    words = PASSAGE.split()
    passage = " ".join(words[:10])
    docs = [
        (1, " ".join(x if i not in (2, 6) else f"new{i}" for i, x in enumerate(words[:10]))),
        (2, " ".join(f"{x} new{i}" if i % 3 == 1 else x for i, x in enumerate(words[:10]))),  # three more words
        (3, " ".join(words[i] for i in (1, 0, 3, 2, 5, 4, 7, 6, 9, 8))),
        (4, " ".join(words[:4] + ["gap"] * 10 + words[4:10])),
        (5, "quick quick " + " ".join(x for x in words[:10] if x not in ("fox", "lazy"))),
        (6, " ".join(f"{x} apart" for x in words[:10])),  # every word between strangers
        (7, " ".join(words[2:10])),
        (8, " ".join(words[:7])),
        (9, "fox " * 50 + passage),
    ]
    rng = random.Random(3)
    few = [f"v{i}" for i in range(14)]
    docs += [(100 + i, " ".join(rng.choice(few) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    items = [(1, passage), (2, "alone"), (3, "fox quick")] + [(10 + i, " ".join(rng.choice(few) for _ in range(rng.choice([1, 2, 5, 10, 13])))) for i in range(12)]
    found = decontamination.passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    right = brute_near(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in found} == right and {(i, 1) for i in (1, 2, 3, 4, 5, 6, 7, 9)} <= right and (8, 1) not in right
    assert len({(r["row"], r["item_id"], r["start"], r["size"], r["n_exact"], r["n_near"]) for r in found if r["doc_id"] < 10}) >= 8


def test_a_match_asks_once(spark):
    """The pairs of leading words of one exact match ask for the same starts; they were tried once for each pair."""
    words = PASSAGE.split()[:10]
    rows = decontamination.word_rows(spark.createDataFrame([(1, "before " * 20 + " ".join(words))], DOCS))
    order = decontamination.ordered_windows(spark.createDataFrame([(7, words)], "wid bigint, words array<string>"), rows)
    lead = {x["off"]: x["term"] for x in order.first()["lead"]}
    keys = dict(order.select(F.inline("lead")).select("term", F.hash("term")).collect())
    met = [(0, 20 + i, keys[lead[i]], keys[lead[j]], j - i) for i, j in itertools.combinations(sorted(lead), 2)]
    frame = spark.createDataFrame(met, "row bigint, pos int, key1 int, key2 int, gap int")
    assert len(met) == 6
    assert [tuple(r) for r in decontamination.asked_starts(frame, decontamination._meetings(order), 5).collect()] == [(0, 7, 15, 25)]


def test_decontamination_awkward_tables(docs, rows, nothing, spark):
    items = spark.createDataFrame([(1, "w1x1 w1x2 w1x3", "clash"), (2, " ".join(f"long{i}" for i in range(10, 30)), "clash")], "item_id bigint, text string, term string")
    got = decontamination.decontamination(docs, items)
    assert Counter(tuple(r)[:6] for r in got.collect()) == brute_decontamination([r[:2] for r in rows], [tuple(r)[:2] for r in items.collect()])
    assert decontamination.decontamination(nothing, items).collect() == []
    clean = decontamination.decontamination(docs, items.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r["contaminated"] for r in clean)


def test_a_third_of_the_rows_holds_one_passage(spark):
    docs = [(i, f"start{i} {PASSAGE} end{i}" if i % 3 == 0 else f"other{i} words the the the") for i in range(900)]
    got = decontamination.decontamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, PASSAGE)], ITEMS)).collect()
    assert {r["doc_id"] for r in got if r["contaminated"]} == set(range(0, 900, 3))
    assert {r["n_hit"] for r in got} == {0, len(PASSAGE.split())}


# --- centroids


def brute_clusters(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for n in range(len(centers)):
            held = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == n]
            if held:
                centers[n] = [sum(x) // len(held) for x in zip(*held, strict=True)]
    own = assign()
    inertia = Counter()
    for d, c in own:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, own, strict=True))


VECTORS = "vec_id bigint, embedding array<float>, label int, cluster string, v string"


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash") for i, v in rows], VECTORS)


def test_clusters_are_brute_force(spark):
    rng = np.random.default_rng(0)
    middles = rng.normal(0, 0.3, (12, 64))
    rows = [(i, [float(x) for x in np.float32(middles[i % 12] + rng.normal(0, 0.1, 64))]) for i in range(300)]
    rows += [(400, None), (401, [0.5] * 63), (402, [float("nan")] * 64), (403, [float("inf")] + [0.0] * 63), (404, [None] + [0.0] * 63), (405, [])]
    rows += [rows[5]] * 40 + [(None, rows[6][1]), (500, rows[7][1])]
    got = centroids.clusters(vector_table(spark, rows).repartition(5))
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows)


def test_few_equal_and_no_vectors(spark):
    rows = [(i, [0.25 * (i % 2)] * 64) for i in range(9)]
    assert Counter(map(tuple, centroids.clusters(vector_table(spark, rows)).collect())) == brute_clusters(rows)
    none = centroids.clusters(vector_table(spark, rows).limit(0))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="beyond"):
        centroids.clusters(vector_table(spark, [(1, [1e9] * 64)])).collect()


def test_bounds_never_drop_the_nearest():
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.normal(0, 40, (500, 64))).astype(np.int64)
    middles = vectors[:40].copy()
    middles[7] = middles[3]  # a tie goes to the smaller number
    exact = ((vectors[:, None] - middles[None]) ** 2).sum(axis=2)
    for pivots in (1, 2, 8, 40):
        simplex = centroids.Simplex(middles, pivots)
        apexes = simplex.apex(vectors).astype(np.float32).astype(np.float64)
        may = centroids.candidates(apexes, simplex.apex(middles))
        assert may[np.arange(500), exact.argmin(axis=1)].all()
        cluster, distance = centroids.nearest(vectors, apexes, middles, simplex.apex(middles))
        assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert may.sum(axis=1).mean() < 5  # all centroids are pivots: hardly any comparison is left
    assert centroids.Simplex(np.zeros((5, 64), np.int64)).pivots.shape == (1, 64)
