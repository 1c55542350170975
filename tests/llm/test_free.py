"""Classifier, packing, repeats, joins, fingerprints and token counts against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crawlq.llm import common, fingerprints, graph, near_join, packing, quality_classifier, substring_dedup, tokens


def spaced(text):
    return text.encode().split()


# --- tokens


@pytest.fixture(scope="module")
def encode():
    return tokens.Encoder()


PIECES = st.sampled_from(
    [" ", "  ", "\n", "\t", "a", "Word", "don't", "'s", "é", "ü", " ", "　", "​", "᠎", "\x1c", "\x85", "12", "½",
     "<|endoftext|>", "<|endof", "日本", "😀", ".", "###", "́", "ɐ"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=12).map("".join))
def test_ids_word_by_word(text):
    encode = tokens.encoder()
    assert encode(text) == encode.whole(text)


def test_full_word_tables_change_nothing(encode, monkeypatch):
    monkeypatch.setattr(tokens, "WORDS_KEPT", 3)
    text = "one two three four five six one two three"
    assert tokens.Encoder()(text) == encode.whole(text)


def test_token_counts(docs, rows, encode):
    got = Counter(map(tuple, tokens.token_counts(docs).collect()))
    n = lambda t: len(encode.whole(t)) // 4
    assert got == Counter((i, len((t or "").encode()), n(t or ""), n(t or "") > 512) for i, t, _, _ in rows)


def test_counts_of_a_content_in_a_third_of_the_rows(spark, encode):
    rows = [(i, "the same text") for i in range(500)] + [(1000 + i, f"text {i}") for i in range(1001)]
    got = Counter(map(tuple, tokens.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    assert got == Counter((i, len(t), len(encode.whole(t)) // 4, False) for i, t in rows)


def test_hot_joins_are_joins(spark):
    rows = [(i, "hot") for i in range(700)] + [(i, f"k{i % 900}") for i in range(1300)] + [(1, None)]
    left = spark.createDataFrame(rows, "n bigint, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("k700", 3), (None, 4), ("none", 5)], "k string, v bigint")
    assert [r[0] for r in common.hot_keys(left, "k").select("k").collect()] == ["hot"]
    assert Counter(map(tuple, common.hot_join(left, right, "k").collect())) == Counter(map(tuple, left.join(right, "k").collect()))


def test_cache_is_used_and_grows(spark, tmp_path):
    folder, version = str(tmp_path / "cache"), tokens.version_digest(tokens.VOCABULARY)
    one = spark.createDataFrame([(1, "first text"), (2, "first text")], "doc_id bigint, text string")
    tokens.token_counts(one, folder).collect()
    assert spark.read.option("recursiveFileLookup", "true").parquet(folder).count() == 1
    # A stored count is believed, so a changed one shows that nothing was encoded again.
    digest = hashlib.sha256(b"stored").hexdigest()
    spark.createDataFrame([(digest, 77)], "digest string, n_tokens bigint").write.parquet(f"{folder}/{version}/by-hand")
    two = spark.createDataFrame([(3, "stored"), (4, "second text"), (5, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(two, folder).collect()}
    assert got == {3: 77, 4: 2, 5: 0}
    assert spark.read.option("recursiveFileLookup", "true").parquet(folder).count() == 4


# --- packing


def check_packed(found, texts, encode, capacity):
    """Every document's ids once, cut right, sequences filled from 0 without gaps."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = Counter()
    for i, text in texts:
        ids = encode.whole(text or "") + b"\0\0\0\0"
        n, at = len(ids) // 4, 0
        first = (n - 1) % capacity + 1
        for k, length in enumerate([first] + [capacity] * ((n - first) // capacity)):
            want[i, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])] += 1
            at += length
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packed_documents(docs, rows, encode):
    found = packing.packed_documents(docs, capacity=64).collect()
    n = check_packed(found, [(i, t) for i, t, _, _ in rows], encode, 64)
    assert n <= 1.1 * -(-sum(r["length"] for r in found) // 64) + 1


def test_sequences_hold_the_ids(spark, encode):
    texts = [(i, f"text number {i} " * (i + 1)) for i in range(12)]
    table = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = packing.sequences(table, capacity=32).collect()
    whole = b"".join(bytes(r["ids"]) for r in sorted(found, key=lambda r: r["sequence_id"]))
    assert Counter(np.frombuffer(whole, "<u4").tolist()) == Counter(
        np.frombuffer(b"".join(encode.whole(t) + b"\0\0\0\0" for _, t in texts), "<u4").tolist()
    )


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=30))
def test_plans_hold_every_length(histogram):
    runs = packing.plan(histogram, 64)
    held = Counter()
    for config, many in runs:
        assert many > 0 and sum(s * n for s, n in config.items()) <= 64
        for s, n in config.items():
            held[s] += n * many
    assert held == Counter(histogram)
    n = sum(many for _, many in runs)
    assert n <= 1.23 * -(-sum(s * k for s, k in histogram.items()) // 64) + sum(k for s, k in histogram.items() if s > 32) + 2


@pytest.mark.parametrize("times, longest", [(1, 2048), (1, 900), (10, 900), (100, 900)])
def test_plans_are_never_worse_than_best_fit(times, longest):
    """Also where nearly every length occurs; and of lengths that fill sequences well the program places a good part itself."""
    rng = np.random.default_rng(5)
    histogram = {k: int(n) * times for k, n in enumerate(rng.integers(1, 9, longest), 1)}
    sizes, left = np.array(sorted(histogram)), np.array([histogram[k] for k in sorted(histogram)])
    fewest = sum(many for _, many in packing.best_fit(sizes, left, 2048))
    found = packing.solved(histogram)
    assert found.bound <= found.sequences <= fewest
    assert found.placed > 0.3 or longest == 2048
    assert found.bound >= -(-sum(k * n for k, n in histogram.items()) // 2048)


def test_token_lengths_reach_the_bound(spark):
    """The pieces of the given documents take hardly more sequences than their tokens need, once and 100 times."""
    pieces = packing.token_pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    found = packing.solved(histogram)
    sizes, left = np.array(sorted(histogram)), np.array([histogram[k] for k in sorted(histogram)])
    assert found.sequences <= min(found.bound + 2, sum(n for _, n in packing.best_fit(sizes, left, 2048))) and found.placed > 0
    many = packing.solved({k: n * 100 for k, n in histogram.items()})
    assert many.sequences <= 1.001 * many.bound


def test_the_bound_comes_from_prices():
    """Pieces of more than half a sequence cannot share one: the tokens alone would promise fewer sequences."""
    found = packing.solved({40: 30, 10: 3}, 64)
    assert found.sequences == 30 and 17 < found.bound <= 30


# --- repeats


def brute_repeats(rows, window):
    words = [spaced(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = Counter()
    for (i, _), w in zip(rows, words):
        gone = {j for a in range(len(w) - window + 1) if seen[tuple(w[a : a + window])] > 1 for j in range(a, a + window)}
        out[i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()] += 1
    return out


def test_repeats(docs, rows):
    found = substring_dedup.repeats(docs)
    got = Counter(map(tuple, found.select("doc_id", "n_words", "n_removed", "kept").collect()))
    assert got == brute_repeats([(i, t) for i, t, _, _ in rows], 35)


def test_repeats_of_very_frequent_rows(spark):
    """A third of the table is one row, another one is short: both are counted, dealt to many batches and returned as often as they came."""
    long, short = " ".join(f"c{i}" for i in range(50)), "just a few"
    rows = [(7, long)] * 60 + [(None, short)] * 45 + [(8, long + " tail"), (9, short)]
    rows += [(100 + i, " ".join(f"d{i}x{j}" for j in range(40))) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.repeats(table).collect())
    assert got == brute_repeats(rows, 35) and got[7, 50, 50, ""] == 60 and got[None, 3, 0, short] == 45
    dealt = substring_dedup._dealt(table, 32).collect()
    assert sum(r["copies"] for r in dealt) == len(rows) and max(r["copies"] for r in dealt) <= 2


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40).map(" ".join), min_size=1, max_size=6))
def test_short_windows(spark, texts):
    rows = list(enumerate(texts))
    found = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), window=5)
    assert Counter(map(tuple, found.select("doc_id", "n_words", "n_removed", "kept").collect())) == brute_repeats(rows, 5)
    for r in found.collect():
        assert sum(s["last"] - s["first"] + 1 for s in r["spans"]) == r["n_removed"]


# --- the join


def brute_join(rows, threshold=0.8):
    def shingles(t):
        w = spaced(t or "")
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    n, parent = len(rows), list(range(len(rows)))
    links = [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    classes = defaultdict(list)
    for k in range(n):
        classes[find(k)].append(rows[k][0])
    least = {root: min((i for i in ids if i is not None), default=None) for root, ids in classes.items()}
    return Counter((rows[k][0], least[find(k)], links[k]) for k in range(n))


def test_join(docs, rows):
    got = near_join.jaccard_join(docs)
    assert Counter(map(tuple, got.select("doc_id", "class_id", "n_links").collect())) == brute_join([(i, t) for i, t, _, _ in rows])


def test_join_of_many_near_copies(spark, monkeypatch):
    """Groups cut into blocks lose no link and count none twice."""
    monkeypatch.setattr(near_join, "GROUP_BLOCK", 4)
    monkeypatch.setattr(near_join, "CLUSTER_BLOCK", 5)
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for k in range(40):
        words = list(base)
        for j in rng.integers(0, 60, rng.integers(0, 3)):
            words[j] = f"c{k}"
        rows.append((k, " ".join(words)))
    got = near_join.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter(map(tuple, got.select("doc_id", "class_id", "n_links").collect())) == brute_join(rows)


def test_verifying_tasks_do_not_grow_with_a_cluster(spark, monkeypatch):
    """However large a cluster or often a row is repeated, a task that holds shingle sets gets two blocks of rows."""
    monkeypatch.setattr(near_join, "CLUSTER_BLOCK", 8)
    dealt, tasks = [], near_join._tasks

    def spied(df, *args, **named):
        grouped = tasks(df, *args, **named)
        if "shingles" in df.columns:
            dealt.append(max(r["count"] for r in grouped.count().collect()))
        return grouped

    monkeypatch.setattr(near_join, "_tasks", spied)
    base = [f"b{i}" for i in range(200)]
    rows = [(k, " ".join([*base, f"c{k}"])) for k in range(400)] + [(0, " ".join([*base, "c0"]))] * 50
    got = near_join.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r["class_id"], r["n_links"]) for r in got.collect()} == {(0, 449)}
    # Blocks of 8 are dealt by hash; 40 is far above two of them, far below the 400 of the cluster.
    assert len(dealt) == 1 and dealt[0] <= 40


def test_pruning_keeps_what_may_reach_the_threshold():
    for h, m in near_join.least_matches():
        assert 0 <= m <= 0.8 * h
    assert near_join.least_matches()[-1][1] > 60


def test_components(spark):
    edges = [(a, a + 1) for a in range(0, 30)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    table = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in graph.components(table).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 102: 100}


# --- fingerprints


def test_windows_are_told_apart_by_both_hashes():
    """Two windows that agree in one hash of 64 bits only are not repeats."""
    u = lambda *v: np.array(v, dtype=np.uint64)
    pairs = [(u(5, 5, 9), u(1, 2, 7)), (u(5, 9), u(2, 8)), (u(4, 9), u(7, 9))]
    many = [np.array(m, dtype=np.uint8) for m in ([0, 0, 0], [0, 0], [1, 0])]
    sent = [substring_dedup._halves(substring_dedup._paired(*p)) for p in pairs]
    assert [f.tolist() for f in substring_dedup._pairs_again(sent, many)] == [[False, True, False], [True, False], [True, False]]
    held = substring_dedup.Held(np.arange(4), u(0, 0, 0, 0), u(3, 3, 3, 4), np.ones(4, bool), u(1, 2, 1, 1))
    assert held.value.tolist() == [3, 3, 4] and held.other.tolist() == [1, 2, 1] and held.many.tolist() == [True, False, False]


def test_fingerprints(docs, rows):
    got = fingerprints.edit_likeness(docs).collect()
    hashed = docs.selectExpr("doc_id", "coalesce(text, '') AS t", "xxhash64(coalesce(text, '')) AS h").collect()
    order = [(r["doc_id"], r["t"]) for r in sorted(hashed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["t"]))]
    prints = dict(zip((t for _, t in order), fingerprints.fingerprints_of([t.encode() for _, t in order])))
    want = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        e = fingerprints.edited(t, after)
        own, there = prints[t], fingerprints.fingerprints_of([e.encode()])[0]
        n_near = None
        if i is not None and i % 50 == 0:
            n_near = sum(fingerprints.likeness(own, prints[x]) >= 1 - fingerprints.RADIUS / 128 for _, x in order) - 1
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), own.hex(), there.hex(), fingerprints.likeness(own, there), fingerprints.likeness(own, prints[after]), n_near] += 1
    assert Counter(map(tuple, got)) == want


def test_search_finds_all_within_the_radius(spark):
    rng = np.random.default_rng(1)
    values = [int.from_bytes(rng.bytes(16)) for _ in range(20)]
    near = [v ^ sum(1 << int(b) for b in rng.choice(128, k, replace=False)) for v in values for k in (0, 1, 2, 3, 4, 15, 16, 17, 18, 19, 20)]
    frame = lambda vs: spark.createDataFrame([(f"{v:032x}",) for v in vs], "fingerprint string")
    for radius in (0, 3, 16, 17):
        found = fingerprints.within(frame(values), frame(near + near), radius).collect()
        assert len(found) == len(set(found))
        got = {(r["query"], r["other"], r["distance"]) for r in found}
        want = {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in values for b in near if (a ^ b).bit_count() <= radius}
        assert got == want


def plain_simhash(text: bytes) -> list:
    """The fingerprint word by word and bit by bit, in plain whole numbers."""
    top = (1 << 64) - 1

    def mixed(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & top
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & top
        return h ^ (h >> 31)

    table = [int(x) for x in np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)]
    polynomial = lambda values, base: sum(v * pow(base, i, 1 << 64) for i, v in enumerate(values)) & top
    parts = [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", text) if w]
    hashes = [mixed(polynomial([table[b] for b in w], table[0] | 1)) for w in parts]
    terms = [(h, min(len(w), 10) / 20) for w, h in zip(parts, hashes)]
    terms += [(mixed((polynomial(hashes[i : i + k], 0x9E3779B97F4A7C15) + k) & top), 1.0) for k in (2, 3) for i in range(len(hashes) - k + 1)]
    votes = [0.0] * 128
    for h, weight in terms:
        data = h.to_bytes(8, "little") + mixed(h ^ 0xA0761D6478BD642F).to_bytes(8, "little")
        for i in range(128):
            votes[i] += weight if data[i // 8] >> (7 - i % 8) & 1 else -weight
    # Votes that add up to nothing but rounding may fall either way.
    return [None if abs(v) < 1e-9 else v > 0 for v in votes]


def test_fingerprints_by_plain_votes():
    texts = ["", " ", "one", "a b", "the quick brown fox jumps over the lazy dog", "ünï cödé \u3000 x " * 5, "\tw\x0bx\x1fy\n" * 3]
    texts += [" ".join(f"w{i * k % 97}" for i in range(60)) for k in (3, 5, 7)]
    data = [t.encode() for t in texts]
    for text, own in zip(data, fingerprints.fingerprints_of(data)):
        bits = np.unpackbits(np.frombuffer(own, np.uint8))
        assert all(want is None or bool(b) == want for want, b in zip(plain_simhash(text), bits)), text
    assert fingerprints.fingerprints_of([b"", b" "]) == [bytes(16)] * 2


def test_radius_finds_edits_of_similarity_08():
    """Of copies with replaced words that keep a 5-word Jaccard of 0.8 to 0.9, nine in ten are within the radius; others are far."""
    rng = np.random.default_rng(3)
    vocabulary = [f"word{i}" for i in range(3000)]
    shingles = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    pairs, far = [], []
    while len(pairs) < 200:
        words = [vocabulary[int(i)] for i in rng.zipf(1.3, int(rng.integers(80, 600))) % 3000]
        changed = list(words)
        for at in rng.choice(len(words), max(1, round(len(words) * rng.uniform(0.005, 0.03))), replace=False):
            changed[at] = vocabulary[int(rng.integers(3000))]
        a, b = shingles(words), shingles(changed)
        if 0.8 <= len(a & b) / len(a | b) <= 0.9:
            pairs.append((" ".join(words).encode(), " ".join(changed).encode()))
    own, there = (fingerprints.fingerprints_of(list(side)) for side in zip(*pairs))
    near = [fingerprints.likeness(a, b) >= 1 - fingerprints.RADIUS / 128 for a, b in zip(own, there)]
    far = [fingerprints.likeness(a, b) >= 1 - fingerprints.RADIUS / 128 for a, b in zip(own, own[1:])]
    assert np.mean(near) >= 0.9 and np.mean(far) <= 0.01


# --- the classifier


def test_chunks_cover_the_text():
    for n in (0, 1, 511, 512, 513, 900, 5000):
        starts = quality_classifier.chunk_starts(n)
        covered = set().union(*(range(s, min(n, s + quality_classifier.CHUNK)) for s in starts.tolist())) if n else set()
        assert covered == set(range(n)) and (n <= 512 or starts[-1] == n - 512)


def test_gradients():
    rng = np.random.default_rng(0)
    net = quality_classifier.fresh(rng)
    texts, labels = [b"some words here " * 50, b"$$$ ### " * 90, b"x"], np.array([1, 0, 1], np.float32)

    def loss():
        p = net.scores(texts)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for value, gradient in zip([net.table, net.filters, net.bias, net.head, net.offset], quality_classifier.gradients(net, texts, labels)):
        k = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        before = value[k]
        value[k] = before + 1e-2
        up = loss()
        value[k] = before - 1e-2
        down = loss()
        value[k] = before
        assert abs((up - down) / 2e-2 - gradient[k]) < 0.1 * abs(gradient[k]) + 1e-3


def test_classifier_learns(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    rows, labels = [], []
    for i in range(240):
        good = i % 4 > 0
        rows.append((i, " ".join(word() + ("" if good else "$$$") for _ in range(60))))
        labels.append((i, int(good)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "x" * 100_000)], "doc_id bigint, text string")
    got = quality_classifier.quality_scores(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, quality int")).collect()
    assert len(got) == 242 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["doc_id"] < 900 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 > 0) for r in held]) > 0.95


@pytest.mark.parametrize(
    "run", [tokens.token_counts, packing.packed_documents, substring_dedup.repeats, near_join.jaccard_join, fingerprints.edit_likeness]
)
def test_empty_tables(nothing, run):
    assert run(nothing).collect() == []


def test_classifier_without_rows(nothing, docs, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality_classifier.quality_scores(nothing, none).collect() == []
    assert {r["score"] for r in quality_classifier.quality_scores(docs, none).collect()} == {0.5}


def test_the_sample_is_whole_texts_and_always_the_same(spark):
    long = "long text " * 20_000
    docs = [(i, f"text {i}") for i in range(30)] + [(100, long), (101, "one"), (101, "two"), (101, "one")]
    labels = spark.createDataFrame([(i, i % 2) for i in (*range(30), 100, 101)], "doc_id bigint, quality int")
    samples = [quality_classifier.training_rows(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(n), labels)[0] for n in (1, 5)]
    assert samples[0] == samples[1] and len(samples[0]) == len(set(samples[0]))
    learned = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(samples[0]) == len(learned) and (100 not in learned or long.encode() in samples[0])


def test_a_score_follows_from_filters_and_chunks():
    """Recomputed byte by byte in plain Python for a short and a long text."""
    rng = np.random.default_rng(8)
    net = quality_classifier.fresh(rng)
    for text in (b"", b"a short one", bytes(rng.integers(0, 256, 1300, dtype=np.uint8))):
        chunks = []
        for start in sorted({*range(0, max(1, len(text) - 512), 448), max(0, len(text) - 512)}) if len(text) > 512 else [0]:
            codes = list(text[start : start + 512]) + [256] * (512 - len(text[start : start + 512]))
            responses = []
            for f in range(32):
                best = max(
                    sum(float(net.table[codes[p + w], e]) * float(net.filters[w * 6 + e, f]) for w in range(8) for e in range(6)) for p in range(0, 505, 4)
                )
                responses.append(max(0.0, best + float(net.bias[f])))
            chunks.append(responses)
        features = [max(c) for c in zip(*chunks)] + [sum(c) / len(chunks) for c in zip(*chunks)] + [min(c) for c in zip(*chunks)] + [min(len(text), 512) / 512]
        z = sum(x * float(w) for x, w in zip(features, net.head)) + float(net.offset[0])
        assert abs(net.scores([text])[0] - 1 / (1 + np.exp(-z))) < 1e-4


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    texts = ["x" * 10] * 300 + ["é" * 3_000_000, "", "y"]
    parts = list(quality_classifier._parts(pa.RecordBatch.from_pydict({"text": texts})))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert max(p.num_rows for p in parts) == 256 and any(p.num_rows == 1 for p in parts)
    assert list(quality_classifier._parts(pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())}))) == []
