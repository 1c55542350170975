import random

import pytest

from crawlq.operators import extracts, similarity

ITEMS = "page_id bigint, item string, cnt bigint"


def _items(spark, pages):
    rows = [(p, i, bag.count(i)) for p, bag in pages.items() for i in set(bag)]
    return spark.createDataFrame(rows, ITEMS)


def _pairs(spark, *pairs):
    return spark.createDataFrame(list(pairs), "a_id bigint, b_id bigint")


def test_full_mode_is_not_symmetric(spark):
    items = _items(spark, {1: ["x", "x", "y"], 2: ["x"], 3: []})
    rows = similarity.pair_similarity(_pairs(spark, (1, 2), (2, 1), (3, 3), (3, 2)), items).collect()
    got = {(r.a_id, r.b_id): (r.common_ratio_of_min, r.common_count, r.len_a, r.len_b) for r in rows}
    assert got == {(1, 2): (2.0, 2, 3, 1), (2, 1): (1.0, 1, 1, 3), (3, 3): (-1000.0, 0, 0, 0), (3, 2): (0.0, 0, 0, 1)}


def test_scheme_mismatch(spark):
    items = _items(spark, {1: ["x"], 2: ["x"]})
    schemes = spark.createDataFrame([(1, True), (2, False)], "page_id bigint, schemed boolean")
    row = similarity.pair_similarity(_pairs(spark, (1, 2)), items, schemes=schemes).first()
    assert row.status == "scheme_mismatch" and row.common_count is None and row.common_ratio_of_min is None


def test_modes(page):
    df = page("<img src='../i/a.png?x/y'><img src='/i/a.png'><img src='/i/a.png'>")
    items = lambda mode: sorted((r.item, r.cnt) for r in similarity.page_items(df, extracts.img_srcs, mode).collect())
    assert items("full") == [("../i/a.png?x/y", 1), ("/i/a.png", 2)]
    assert items("path_no_query") == [("/i/", 1)]
    assert items("no_filename") == [("h.example/i", 1), ("h.example/i/a.png?x", 1)]
    assert items("filename") == [("a.png", 1), ("y", 1)]
    with pytest.raises(ValueError):
        similarity.page_items(df, extracts.img_srcs, "other")


def test_default_icon(spark, page):
    df = page("none", "none", "<link rel='shortcut icon' href='/favicon.ico'>")
    rows = similarity.same_icon(_pairs(spark, (0, 1), (0, 2)), df).orderBy("b_id").collect()
    assert [(r.same, r.same_with_default, r.n_a, r.n_b, r.icons_a) for r in rows] == [
        (False, True, 0, 0, []),
        (False, True, 0, 1, []),
    ]
    assert rows[1].icons_b == ["h.example/favicon.ico?"]


def _brute(bags, k):
    out = {}
    for a, bag in bags.items():
        scored = []
        for b, other in bags.items():
            common = sum(1 for x in bag if x in other)
            if a != b and common:
                scored.append((-common / max(1, min(len(bag), len(other))), b))
        out[a] = [b for _, b in sorted(scored)[:k]]
    return {a: bs for a, bs in out.items() if bs}


@pytest.mark.parametrize("cap", [0, 3, 1000])
@pytest.mark.parametrize("k", [1, 3])
def test_best_targets_match_brute_force(spark, cap, k):
    rng = random.Random(7)
    bags = {p: [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 6))] for p in range(40)}
    # A third of all pages are copies, and most pages share one word.
    bags |= {p: ["hot", "copy", "copy"] for p in range(40, 60)}
    bags = {p: bag + (["hot"] if p % 3 else []) for p, bag in bags.items()}
    got = similarity.best_target_items(_items(spark, bags), _items(spark, bags), k, cap).collect()
    ranked = {}
    for r in sorted(got, key=lambda r: (r.a_id, r.rank)):
        ranked.setdefault(r.a_id, []).append(r.b_id)
    assert ranked == _brute(bags, k)


@pytest.mark.parametrize("seeds, split_rows", [(0, 7), (40, 10_000)])
def test_every_page_with_its_own_hot_items(spark, seeds, split_rows):
    """No two pages share a class, and every item stands in many pages."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(14)]
    bags = {p: rng.sample(words, rng.randint(1, 8)) + rng.choices(words, k=rng.randint(0, 3)) + [f"own{p}"] for p in range(150)}
    got = similarity.best_target_items(_items(spark, bags), _items(spark, bags), 2, seeds, split_rows).collect()
    ranked = {}
    for r in sorted(got, key=lambda r: (r.a_id, r.rank)):
        ranked.setdefault(r.a_id, []).append(r.b_id)
    assert ranked == _brute(bags, 2)


def test_top_k_is_cut_before_the_shuffle(spark):
    items = _items(spark, {1: ["x"], 2: ["x"]})
    plan = similarity.best_target_items(items, items, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 6
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_one_table_of_items_serves_all_features(spark, page):
    df = page(
        "<title>A b a</title><link rel='stylesheet' href='/c/s.css'><script src='j/a.js'></script><div style='a:1;b:2;c:3'></div><img src='/i/a.png'><img src='/i/b.png'>",
        "<title>b</title><link rel='shortcut icon' href='/f.ico'><img src='/i/z.png'>",
        "",
    )
    names = [f for f in similarity.FEATURES]
    items = similarity.stored_items(df, *names)
    pairs = _pairs(spark, (0, 1), (1, 0), (2, 0))
    jobs = {"title_text": similarity.sim_title_text, "stylesheet": similarity.sim_stylesheet, "script": similarity.sim_script, "img": similarity.sim_img, "div_style": similarity.sim_div_style}
    for feature, job in jobs.items():
        shared = similarity.feature_similarity(pairs, items, feature)
        assert sorted(shared.collect()) == sorted(job(pairs, df).collect())
        plan = shared._jdf.queryExecution().executedPlan().toString()
        assert "regexp" not in plan and "Bucketed: true" in plan
    assert sorted(similarity.icon_similarity(pairs, items).collect()) == sorted(similarity.same_icon(pairs, df).collect())
    # Lengths are counted where the buckets lie.
    plan = similarity.feature_items(items, "img").groupBy("page_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    with pytest.raises(ValueError):
        similarity.item_table(df, "other")


def test_features_agree_with_page_items(spark, page):
    df = page("<base href='http://o.example/x/'><title>A b</title><title>b</title><link rel=stylesheet href='../s.css?q'><script src=a.js></script><img src='i/a.png?x/y'><img src=' '>", "<img src='http://h/a.png'>")
    plain = {"title_text": (extracts.title_words, "full"), "stylesheet": (extracts.stylesheets, "path_no_query"), "script": (extracts.script_srcs, "path_no_query"), "img": (extracts.img_srcs, "no_filename")}
    items = similarity.item_table(df, *plain)
    for feature, (job, mode) in plain.items():
        assert sorted(similarity.feature_items(items, feature).collect()) == sorted(similarity.page_items(df, job, mode).collect())


def test_schemes_come_from_the_pages(spark):
    df = spark.createDataFrame([(0, "http://h/a", "<img src='/i/a.png'>"), (1, "h/a", "<img src='/i/a.png'>")], "page_id bigint, url string, html string")
    for job in (similarity.sim_img, similarity.same_icon):
        rows = {(r.a_id, r.b_id): r.status for r in job(_pairs(spark, (0, 1), (1, 1)), df).collect()}
        assert rows == {(0, 1): "scheme_mismatch", (1, 1): "ok"}


def test_candidates_hold_numbers(spark):
    """Classes and items are numbers in all that is moved per candidate; equal pages are one class, items no target has only count."""
    rows = [(1, "a", 2), (1, "b", 1), (2, "b", 1), (2, "a", 2), (3, "a", 1), (3, "other", 4)]
    items = spark.createDataFrame(rows, "page_id bigint, item string, cnt bigint")
    numbers = spark.createDataFrame([("a", 0), ("b", 1)], "item string, number bigint")
    members, classes = similarity._classes(items, numbers, "a")
    of = {r["id"]: r["class_a"] for r in members.collect()}
    assert of[1] == of[2] != of[3] and dict(classes.dtypes)["class_a"] == "bigint" and dict(classes.dtypes)["items_a"] == "array<bigint>"
    assert sorted((r["len_a"], sorted(r["items_a"]), r["first_a"]) for r in classes.collect()) == [(3, [0, 0, 1], 1), (5, [0], 3)]
