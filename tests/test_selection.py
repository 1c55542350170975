import itertools
import random

import pytest

from crawlq.operators import selection


def _table(spark, groups):
    return spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")


def test_small_cases(spark):
    df = spark.createDataFrame([(v,) for v in (5, 1, 5, 2)], "v int")
    assert selection.kth_smallest(df, "v", 3).first().kth == 5
    equal = spark.createDataFrame([(3,)] * 8, "v int")
    assert selection.kth_smallest(equal, "v", 8).first().kth == 3
    with pytest.raises(ValueError):
        selection.kth_smallest(df, "v", 5)
    with pytest.raises(ValueError):
        selection.kth_smallest(df, "v", 0)


@pytest.mark.parametrize("k", [1, 1500, 4000])
def test_groups_of_every_shape(spark, k):
    rng = random.Random(k)
    groups = {
        "uniform": [rng.random() for _ in range(4000)],
        "ties": [float(rng.randint(0, 3)) for _ in range(4000)],
        "flat": [7.0] * 4000,
        "skew": [rng.random() ** 30 * 1e9 for _ in range(4000)] + [0.0] * 3000,
        "small": [3.0, 1.0, 2.0],
    }
    got = selection.kth_smallest(_table(spark, groups), "v", k, by="g").collect()
    assert {r.g: r.kth for r in got} == {g: sorted(vs)[k - 1] for g, vs in groups.items() if len(vs) >= k}


@pytest.mark.parametrize("kind", ["string", "decimal(38,0)", "date"])
def test_any_type_and_no_single_task(spark, kind):
    rows = spark.range(5000).selectExpr(f"CAST({'date_add(DATE 2000-01-01, CAST(id % 700 AS INT))' if kind == 'date' else 'id % 700'} AS {kind}) AS v".replace("DATE 2000-01-01", "DATE'2000-01-01'"))
    want = sorted(r.v for r in rows.collect())[1233]
    found = selection.kth_smallest(rows, "v", 1234)
    assert found.first().kth == want
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()


def test_nulls_are_not_counted(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "v int")
    assert selection.kth_smallest(df, "v", 2).first().kth == 2


def _combos(spark, prices, chosen, excluded, **band):
    schema = "g string, item string, price double"
    items = spark.createDataFrame([("g", f"i{n}", float(p)) for n, p in enumerate(prices)], schema)
    pick = lambda names: spark.createDataFrame([(n,) for n in names], "item string")
    rows = selection.price_band_combos(items, pick(chosen), pick(excluded), by="g", ordered=True, **band).collect()
    return [(list(r.prices), r.total) for r in rows]


def test_golden_combos(spark):
    got = _combos(spark, [10, 20, 30, 5], ["i3"], [], lo=20, hi=40, max_k=3)
    assert sorted(got) == sorted([([20.0], 25.0), ([10.0, 20.0], 35.0), ([30.0], 35.0)])
    assert [t for _, t in got] == sorted(t for _, t in got)


def test_chosen_alone_and_excluded(spark):
    assert _combos(spark, [10, 20, 50], ["i0"], ["i1"], lo=5, hi=15, max_k=2) == [([], 10.0)]


def test_negative_prices_are_not_pruned(spark):
    got = _combos(spark, [50, -30, 5], [], [], lo=20, hi=26, max_k=3)
    assert sorted(got) == [([-30.0, 5.0, 50.0], 25.0)]


@pytest.mark.parametrize("split_rows", [2, 1000])
def test_split_groups_match_brute_force(spark, split_rows):
    prices = [7, 3, 9, 4, 4, 12, 1]
    got = _combos(spark, prices, [], [], lo=9, hi=17, max_k=3, split_rows=split_rows)
    want = [
        (sorted(map(float, c)), float(sum(c)))
        for size in range(4)
        for c in itertools.combinations(prices, size)
        if 9 < sum(c) < 17
    ]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("in_row", [1, 2, 4, 10])
@pytest.mark.parametrize("max_k", [None, 2])
def test_every_way_to_build_sets_agrees(spark, in_row, max_k):
    """In the row, as halves and size by size, negative prices included."""
    prices = [7, -3, 9, 4, 4.5, 12, 1, -2.25]
    got = _combos(spark, prices, ["i4"], ["i6"], lo=9, hi=17, max_k=max_k, in_row=in_row, split_rows=3)
    free = [p for i, p in enumerate(prices) if i not in (4, 6)]
    want = [
        (sorted(map(float, c)), round(4.5 + sum(c), 2))
        for size in range(len(free) + 1 if max_k is None else max_k + 1)
        for c in itertools.combinations(free, size)
        if 9 < 4.5 + sum(c) < 17
    ]
    assert sorted(got) == sorted(want)


def test_middling_group_as_halves(spark):
    rng = random.Random(1)
    prices = [rng.randint(1, 50) for _ in range(14)]
    got = _combos(spark, prices, [], [], lo=200.5, hi=203)
    want = [(sorted(map(float, c)), float(sum(c))) for n in range(15) for c in itertools.combinations(prices, n) if 200.5 < sum(c) < 203]
    assert sorted(got) == sorted(want) and want


def test_texts_are_narrowed_and_stay_whole(spark):
    """Long common beginnings, texts that begin each other, copies, empty texts and none-ASCII ones; only short keys are counted."""
    rng = random.Random(2)
    base = "common beginning " * 300
    texts = [base + rng.choice(["", "a", "b", "bé", "b\U0001f600", "b\uffee"]) + "".join(rng.choice("abé ") for _ in range(rng.randint(0, 6))) for _ in range(900)]
    texts += [base[:5000]] * 400 + [""] * 50 + ["z" * 5000] * 200
    df = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)] + [(None, "x"), (7, None)], "g int, v string").repartition(6)
    for k in (1, 40, 200, 333, 516):
        want = {g: sorted((t for i, t in enumerate(texts) if i % 3 == g), key=lambda t: t.encode())[k - 1] for g in range(3)}
        got = {r.g: r.kth for r in selection.kth_smallest(df, "v", k, by="g", sorted_at_once=20).collect()}
        assert got == (want | {None: "x"} if k == 1 else want)


@pytest.mark.parametrize("kind", ["tinyint", "bigint", "float", "double", "decimal(38,10)", "date", "timestamp", "timestamp_ntz", "boolean"])
def test_numbers_are_narrowed(spark, kind):
    rng = random.Random(4)
    value = "CAST(x % 100 AS {0})" if kind == "tinyint" else "CAST(x * 1000003 % 999983 AS {0})"
    value = {"date": "date_add(DATE'1900-01-01', CAST(x % 90000 AS INT))", "timestamp": "timestamp_micros(x * 7919)", "timestamp_ntz": "CAST(timestamp_micros(x * 7919) AS timestamp_ntz)", "boolean": "x % 2 = 0"}.get(kind, value).format(kind)
    df = spark.createDataFrame([(rng.randint(0, 3000),) for _ in range(3000)] + [(2999,)] * 1500, "x bigint").selectExpr(f"{value} AS v")
    want = sorted(r.v for r in df.collect())
    for k in (1, 1500, 4400):
        assert selection.kth_smallest(df, "v", k, sorted_at_once=15).first().kth == want[k - 1]


def test_ends_of_the_number_line(spark):
    values = [1.7e308, -1.7e308, 0.0, 5e-324, float("inf"), float("nan")] * 30
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [str(selection.kth_smallest(df, "v", k, sorted_at_once=5).first().kth) for k in (1, 31, 61, 91, 121, 151)] == ["-1.7e+308", "0.0", "5e-324", "1.7e+308", "inf", "nan"]
    finite = df.where("v < double('inf')")
    assert [selection.kth_smallest(finite, "v", k, sorted_at_once=5).first().kth for k in (1, 31, 61, 91)] == [-1.7e308, 0.0, 5e-324, 1.7e308]
