"""Quality rules, secrets, licences and mixing against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from crawlq.llm import license_scan, mixing, quality_rules, secrets


def brute_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


# --- quality rules


def rule_counts(text):
    words = brute_words(text)
    lines = [x for x in text.split("\n") if brute_words(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_rule_counts(docs, rows):
    got = quality_rules.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )
    want = Counter((i, *rule_counts(t or "")) for i, t, _, _ in rows)
    assert Counter(map(tuple, got.collect())) == want


def test_rules_keep_clean_and_reject_junk(spark):
    clean = [(i, " ".join(f"w{i}y{j}" for j in range(40)), "en", "a") for i in range(60)]
    junk = [(100 + i, " ".join(f"v{i}y{j}$$$" for j in range(40)), "en", "a") for i in range(8)]
    table = spark.createDataFrame(clean + junk, "doc_id bigint, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality_rules.quality_rules(table).where("kept").collect()}
    assert kept == set(range(60))


def test_sketches_merge(docs):
    counted = quality_rules.counts(docs)
    whole = quality_rules.sketches(counted)
    parts = quality_rules.sketches(counted.where("n_words > 30")).unionByName(
        quality_rules.sketches(counted.where("NOT n_words > 30"))
    )
    again = quality_rules.merged(parts, "lang", "source").select(whole.columns)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, again.collect()))


def test_thin_groups_lean_on_the_language(spark):
    """Long words are the habit of one source; its fence moves to its own value step by step, with no switch at any number of documents."""
    long = lambda i, j: f"w{i}y{j}" + "x" * 40
    rows = [(i, " ".join(f"w{i}y{j}" for j in range(40)), "en", "big") for i in range(60)]
    fences = []
    for thin in (1, 49, 50, 200):
        more = [(100 + i, " ".join(long(i, j) for j in range(40)), "en", "thin") for i in range(thin)]
        table = spark.createDataFrame(rows + more, "doc_id bigint, text string, lang string, source string")
        limits = {r["source"]: r for r in quality_rules.thresholds(quality_rules.sketches(quality_rules.counts(table))).collect()}
        assert limits["thin"]["n_docs"] == thin and limits["big"]["n_docs"] == 60
        fences.append(limits["thin"]["fence_length"])
    assert abs(fences[2] - fences[1]) < 20 and fences[3] > 850


def test_every_feature_follows_its_source(spark):
    """Two sources with habits of their own get limits of their own for all five features, and neither loses its sound documents."""
    plain = [(i, "\n".join(" ".join(f"w{i}y{j}z{n}" for j in range(10)) for n in range(6)), "en", "prose") for i in range(120)]
    def table_like(i):
        line = " ".join(f"v{i}c{j} # | {j % 3} {j % 3}" for j in range(9))
        return (1000 + i, "\n".join([line, line, *(f"head{i}r{n} long{'er' * 9}{n} $ $ x{n} x{n} y" for n in range(40))]), "en", "tables")
    tables = [table_like(i) for i in range(120)]
    table = spark.createDataFrame(plain + tables, "doc_id bigint, text string, lang string, source string")
    judged = quality_rules.quality_rules(table).collect()
    assert all(r["kept"] for r in judged)
    limits = {r["source"]: r for r in quality_rules.thresholds(quality_rules.sketches(quality_rules.counts(table))).collect()}
    assert all(limits["prose"][f"fence_{f}"] != limits["tables"][f"fence_{f}"] for f in quality_rules.FEATURES)


# --- secrets

PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)


def strong(text):
    found = [
        (m.start(), k, kind, m.end())
        for k, (kind, pattern, group, least) in enumerate(PATTERNS)
        for m in re.finditer(pattern, text)
        if len(m[group]) >= least
    ]
    return sorted(found)


def test_strong_spans(spark, docs, rows):
    got = Counter((r["doc_id"], tuple(map(tuple, r["strong"]))) for r in secrets.secrets(docs).collect())
    assert got == Counter((i, tuple(strong(t or ""))) for i, t, _, _ in rows)
    hard = ["token=token:abcdefgh", "é password = 'ab' secret=abcdefg", "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "f" * 23 + "g" + "a" * 24 + "é" + "0" * 30]
    table = spark.createDataFrame(list(enumerate(hard)), "doc_id bigint, text string")
    for r in secrets.secrets(table).collect():
        assert list(map(tuple, r["strong"])) == strong(hard[r["doc_id"]])


def test_weak_parts_need_company(spark):
    token = "aB3dE5gH7jK9mN1pQ3"
    rows = [
        (1, f"user: bob at https://db.example.com/x with {token} end"),
        (2, f"{token} alone"),
        (3, "user: bob alone, https://db.example.com/x"),
        (4, f"user: bob {'. ' * 300} {token}"),  # too far apart
        (5, f"user: bob {'. ' * 60} {token}"),  # in another bin, but near enough
    ]
    found = secrets.secrets(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {r["doc_id"]: [x["kind"] for x in r["linked"]] for r in found.collect()}
    assert got == {1: ["weak_identity", "endpoint", "weak_secret"], 2: [], 3: [], 4: [], 5: ["weak_identity", "weak_secret"]}


def test_redaction(docs, rows):
    found = secrets.secrets(docs)
    out = Counter((r["doc_id"], r["text"]) for r in secrets.redacted(docs, found).collect())
    want = Counter()
    for i, t, _, _ in rows:
        if t:
            for a, _, _, b in reversed(strong(t)):
                t = t[:a] + "[secret]" + t[b:]
        want[i, t] += 1
    assert out == want and secrets.redacted(docs, found).columns == docs.columns


# --- licences


def license_words(text):
    lowered = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def phrase_places(text):
    words = license_words(text)
    places = [
        (i, label) for phrase, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    ]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_phrases(docs, rows):
    got = license_scan.license_scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    want = Counter((i, *phrase_places(t or "")) for i, t, _, _ in rows)
    assert Counter(map(tuple, got.collect())) == want


def test_notices_with_gaps(spark):
    notice = dict(license_scan.NOTICES)["mit"]
    broken = notice.split()
    broken.insert(9, "indeed")
    del broken[-1]
    rows = [(1, "cc by cc by"), (2, " ".join(broken)), (3, " ".join(notice.split()[:6])), (4, f"x {notice} y")]
    got = {r["doc_id"]: (r["labels"], r["score"], r["n_base"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == ("cc-by", 1.0, 2) and got[4] == ("mit", 1.0, 0)
    assert got[2][0] == "mit" and 0.6 <= got[2][1] < 1 and got[3] == ("", 0.0, 0)


def test_versions_are_told_apart(spark):
    gpl = "This is licensed under the GNU General Public License"
    texts = [f"{gpl}, version 2.", f"{gpl}, version 3.", f"{gpl}.", f"{gpl}, version 2.0 or later", "Licensed under the Apache License, Version 1.1"]
    got = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert {r["doc_id"]: r["labels"] for r in got.collect()} == {0: "gpl,gpl-2.0", 1: "gpl,gpl-3.0", 2: "gpl", 3: "gpl,gpl-2.0", 4: ""}


def test_many_templates_find_the_same(spark, docs, monkeypatch):
    """Above the bound for broadcasting nothing is refused and nothing changes."""
    rows = [(100 + i, f"a b {text} c. All rights reserved, cc by {i}") for i, (_, text) in enumerate(license_scan.NOTICES)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = Counter(map(tuple, license_scan.license_scan(table).collect()))
    monkeypatch.setattr(license_scan, "MAX_POSITIONS", 0)
    scan = license_scan.license_scan(table)
    assert Counter(map(tuple, scan.collect())) == want and sum(r[6] != "" for r in want) >= len(rows)
    nothing = license_scan.license_scan(table, templates=(), phrases=())
    assert {(r["labels"], r["n_base"], r["score"]) for r in nothing.collect()} == {("", 0, 0.0)}


def test_weak_parts_inside_strong_ones(spark):
    """Against all pairs of spans, in texts with thousands of them."""
    draw = random.Random(5)
    rows = []
    for doc in range(3):
        starts = sorted(draw.sample(range(60_000), 3000))
        ends = [min(b, a + draw.randint(1, 40)) for a, b in zip(starts, [*starts[1:], 70_000], strict=True)]
        rows += [(doc, doc, a, draw.choice([0, 2]), "strong", b) for a, b in zip(starts, ends, strict=True)]
        rows += [(doc, doc, a, draw.choice([3, 4, 5]), "weak", a + draw.randint(1, 60)) for a in draw.sample(range(60_000), 3000)]
    parts = spark.createDataFrame(rows, "doc_id bigint, text_key bigint, start bigint, rank int, kind string, end bigint")
    got = Counter(map(tuple, secrets.standing_alone(parts).collect()))
    held = defaultdict(list)
    for r in rows:
        if r[3] < 3:
            held[r[0]].append((r[2], r[5]))
    want = Counter(r for r in rows if r[3] < 3 or not any(a < r[5] and r[2] < b for a, b in held[r[0]]))
    assert got == want and 0 < len([r for r in want if r[3] >= 3]) < 9000


# --- mixing


def raked(cells, targets):
    fitted = {c: float(n) for c, n in cells.items()}
    for _ in range(500):
        for d in range(3):
            sums = defaultdict(float)
            for c, v in fitted.items():
                sums[c[d]] += v
            fitted = {c: v * targets[d][c[d]] / sums[c[d]] for c, v in fitted.items()}
    return fitted


def test_raking_meets_targets(spark, monkeypatch):
    cells = {(s, lang, t): 10 + 7 * k for k, (s, lang, t) in enumerate((s, lang, t) for s in ("a", "b", None) for lang in ("en", "de") for t in ("x", "y"))}
    targets = [{"a": 0.2, "b": 0.5, None: 0.3}, {"en": 0.6, "de": 0.4}, {"x": 0.55, "y": 0.45}]
    table = spark.createDataFrame([(*c, n) for c, n in cells.items()], "source string, lang string, topic string, tokens bigint")
    wanted = spark.createDataFrame(
        [(d, v, p) for d, shares in zip(mixing.DIMENSIONS, targets) for v, p in shares.items()], "dimension string, value string, share double"
    )
    got = {(r["source"], r["lang"], r["topic"]): r["fitted"] for r in mixing.raked(table, wanted, tolerance=1e-9).collect()}
    want = raked(cells, targets)
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-6 for c in want)
    # Over several partitions the sums are joined, with the same result round by round.
    one = {tuple(r[:3]): r["fitted"] for r in mixing.raked(table, wanted, max_rounds=2).collect()}
    monkeypatch.setattr(mixing, "PER_PART", 4)
    several = {tuple(r[:3]): r["fitted"] for r in mixing.raked(table, wanted, max_rounds=2).collect()}
    assert several == pytest.approx(one, rel=1e-9)


def test_mixing_rows_and_draws(docs, rows):
    got = mixing.mixed(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in rows)
    assert all(0 <= r["probability"] <= 1 for r in got) and max(r["probability"] for r in got) == 1
    for r in got:
        drawn = int(hashlib.md5(f"17:{r['doc_id']}".encode() if r["doc_id"] is not None else b"17").hexdigest()[:12], 16) / 2**48
        assert r["sampled"] == (drawn < r["probability"])
        assert r["tokens"] >= 1


def plain_topic(text):
    low = re.sub(r"[\x20\x09-\x0D]", " ", text).lower()
    held = {name: sum(low.count(w) * len(w) for w in found) for name, found in mixing.TOPICS.items()}
    return max(held, key=held.get) if max(held.values()) else "other"


def plain_probabilities(weights, fitted, trim):
    """Weight over the trimming point, from bins of equal ratio."""
    bins = defaultdict(list)
    for c, w in weights.items():
        if w > 0:
            bins[math.floor(math.log2(w) * mixing.BINS)].append(c)
    above, point = 0.0, None
    for b in sorted(bins, reverse=True):
        if above <= trim * sum(fitted.values()):
            point = max(weights[c] for c in bins[b])
        above += sum(fitted[c] for c in bins[b])
    return {c: min(1.0, w / point) for c, w in weights.items()}


@pytest.mark.parametrize("trim", [0.0, mixing.TRIM, 0.2])
def test_trimming_point(spark, trim):
    cells = [("a", "en", "x", 900, 0.5), ("b", "en", "x", 60, 0.3), ("c", "en", "x", 39, 0.15), ("d", "en", "x", 2, 0.045), ("e", None, "x", 1, 0.005), ("f", "en", "x", 5, 0.0)]
    table = spark.createDataFrame(cells, "source string, lang string, topic string, tokens bigint, fitted double")
    fitted = {c[0]: c[4] for c in cells}
    want = plain_probabilities({c[0]: c[4] * 1007 / c[3] for c in cells}, fitted, trim)
    got = {r["source"]: r["probability"] for r in mixing.calibrated(table, trim).collect()}
    assert got == pytest.approx(want) and max(got.values()) == 1 and got["f"] == 0
    assert sum(fitted[s] for s, p in got.items() if p == 1) <= trim + 0.3


def test_mixing_from_texts_to_probabilities(spark):
    """Tokens, topics, targets, raking, weights and probabilities, each again in plain Python."""
    fill = [" the house ", " and with\tboth ", " in on\nit ", " is was ", "nothing here"]
    rows = [
        (1000 * a + 100 * b + 10 * c + k, fill[c] * (1 + (a + 2 * b + 3 * c + k) % 7) + "word " * (a * k), "en" if b else None, "ab c"[a])
        for a in range(4)
        for b in range(2)
        for c in range(5)
        for k in range(1 + 3 * (a == 0))
    ]
    rows = [(i, t, lang, None if s == " " else s) for i, t, lang, s in rows]
    cells = Counter()
    for _, t, lang, s in rows:
        cells[s, lang, plain_topic(t)] += len(brute_words(t))
    all_tokens = sum(cells.values())
    targets = []
    for d in range(3):
        sums = Counter()
        for c, n in cells.items():
            sums[c[d]] += n
        lifted = {v: (n / all_tokens) ** mixing.TEMPER for v, n in sums.items()}
        targets.append({v: p / sum(lifted.values()) for v, p in lifted.items()})
    fitted = raked(cells, targets)
    weights = {c: fitted[c] * all_tokens / n for c, n in cells.items()}
    probability = plain_probabilities(weights, fitted, mixing.TRIM)
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _, _ in rows}
    for r in got:
        cell = (r["source"], r["lang"], r["topic"])
        assert r["topic"] == plain_topic(texts[r["doc_id"]]) and r["tokens"] == len(brute_words(texts[r["doc_id"]]))
        assert r["weight"] == pytest.approx(weights[cell], rel=1e-4) and r["gap"] <= mixing.TOLERANCE
        assert r["probability"] == pytest.approx(probability[cell], rel=1e-4)


def test_mixing_by_given_topics_and_tokens(spark):
    rows = [(1, "a b", "en", "x", "law", 30), (2, None, "en", "x", None, None), (3, "c", "en", "y", "law", -4)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, about string, size bigint")
    got = {r["doc_id"]: (r["topic"], r["tokens"]) for r in mixing.mixed(table, topic="about", tokens="size").collect()}
    assert got == {1: ("law", 30), 2: (None, 1), 3: ("law", 1)}


@pytest.mark.parametrize("run", [quality_rules.quality_rules, secrets.secrets, license_scan.license_scan, mixing.mixed])
def test_empty_tables(nothing, run):
    assert run(nothing).collect() == []
