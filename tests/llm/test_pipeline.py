"""The pipeline, stage by stage, against plain Python, and the registered queries."""

from collections import Counter

import pytest
from test_free import brute_join, check_packed
from test_native import rule_counts, strong

import __spark_entry__ as contract
import corpus_pipeline
from crawlq.llm import mixing, registry, tokens


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs.select(*corpus_pipeline.COLUMNS).write.parquet(f"{folder}/documents.parquet")
    return folder


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages(spark, sf_dir, rows):
    docs = registry.documents(spark, sf_dir)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [
        "quality rules", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "best-fit packing"
    ]
    quality, distinct, redact, mix, pack = stages.values()

    kept = quality(spark, docs, sf_dir)
    got = pairs(kept)
    passed = Counter((i, t) for i, t, _, _ in rows if not rule_counts(t or "")[-1])
    assert got <= passed and {i for i, _ in got} >= {1, 2, 3, 9, 12, 50, 100, None} and 11 not in {i for i, _ in got}

    single = distinct(spark, kept, sf_dir)
    held = list(got.elements())
    classes = {}
    for (i, c, _), n in brute_join(held).items():
        classes.setdefault(c, set()).add(i)
    leads = Counter(i for i, _ in pairs(single).elements())
    assert leads == Counter(min((i for i in ids if i is not None), default=None) for ids in classes.values())

    clean = redact(spark, single, sf_dir)
    want = Counter()
    for (i, t), n in pairs(single).items():
        for a, _, _, b in reversed(strong(t)):
            t = t[:a] + "[secret]" + t[b:]
        want[i, t] += n
    assert pairs(clean) == want and all(r["n_chars"] == len(r["text"]) for r in clean.collect())

    drawn = mix(spark, clean, sf_dir)
    sampled = {r["doc_id"] for r in mixing.mixed(clean).where("sampled").collect()}
    assert pairs(drawn) == Counter({k: n for k, n in want.items() if k[0] in sampled}) and sampled

    for stage in (kept, single, clean, drawn):
        assert stage.columns == list(corpus_pipeline.COLUMNS)
    found = pack(spark, drawn, sf_dir).collect()
    check_packed(found, list(pairs(drawn).elements()), tokens.Encoder(), 2048)
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect())) == Counter(
        (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found
    )


def test_no_documents(spark, nothing, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered():
    names = contract.queries().keys()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 14))
    assert names >= registry.QUERIES.keys()


@pytest.mark.parametrize("name", ["op1_quality_classifier", "op4_ngram_jaccard_join", "op9_license_scan", "op12_decontamination"])
def test_queries_return_every_document(spark, name):
    folder = "/root/testdata/sf0.001"
    assert registry.QUERIES[name](spark, folder).count() == registry.documents(spark, folder).count()
