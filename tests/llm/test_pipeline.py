import pytest

import corpus_pipeline
from tesselon.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's output, written and read again."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(str(root / str(k)))
        out.append(spark.read.parquet(str(root / str(k))))
    return out


def test_stages_against_brute_force(spark, stages):
    from tests.llm.test_joins import brute_components, edit_distance_in
    from tesselon.llm import decontaminate

    raw, good, single, clean, mixed, tokens = [s.toPandas() for s in stages]
    columns = list(raw.columns)
    assert all(list(s.columns) == columns for s in (good, single, clean, mixed))
    report = queries.QUERIES["op8_quality"](spark, SF).toPandas()
    assert set(good.doc_id) == set(report[report.kept].doc_id)
    comps = brute_components(dict(zip(good.doc_id, good.text)))
    assert set(single.doc_id) == {i for i, (_, c) in comps.items() if c == i}
    items = {decontaminate.normalise(t) for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text}
    short = {i: decontaminate.normalise(t) for i, t in zip(single.doc_id, single.text) if len(t) < 1500}
    for i, t in short.items():
        dirty = any(len(x) >= 40 and x[: len(x) // 2][:12] in t and edit_distance_in(x, t) <= int(0.07 * len(x)) for x in items)
        assert not (dirty and i in set(clean.doc_id))
    assert set(clean.doc_id) <= set(single.doc_id) and len(clean) > 0.8 * len(single)
    assert set(mixed.doc_id) <= set(clean.doc_id) and mixed.doc_id.value_counts().max() <= 2
    assert sorted(tokens.doc_id) == sorted(mixed.doc_id)
    assert list(tokens.sort_values("start").doc_id) == sorted(mixed.doc_id)


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).toPandas().sort_values("start").reset_index(drop=True)
    assert got.equals(stages[-1].toPandas().sort_values("start").reset_index(drop=True)[list(got.columns)])
