"""The pipeline's stages, each on what the one before kept, and the queries' SQL."""

import random

import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldrail.llm import queries

from .conftest import prose
from .test_dedup import brute_components, brute_removal
from .test_filters import labelled


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Toxic texts, copies, shared passages and benchmark passages among clean ones."""
    r = random.Random(6)
    items = [(k, prose(r, 25)) for k in range(5)]
    passage = prose(r, 70)
    docs = [(i, t) for i, t, _ in labelled(500)]
    docs += [(1000 + k, prose(r, 40)) for k in range(30)]
    docs += [(1100 + k, docs[501 + k][1]) for k in range(5)]
    docs += [(1200 + k, prose(r, 30) + " " + passage + " " + prose(r, 30)) for k in range(4)]
    docs += [(1300 + k, prose(r, 30) + " " + items[k][1] + " " + prose(r, 30)) for k in range(5)]
    docs += [(1400, None), (1401, "")]
    out = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in labelled(500)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return f"file://{out}"


def test_stages(spark, folder, tmp_path):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "sentencepiece":
            assert docs.columns == before.columns
    truth = {i: y for i, _, y in labelled(500)}
    toxic = kept["toxicity"]
    wrong = [i for i, y in truth.items() if (i in toxic) == bool(y)]
    assert len(wrong) <= 15 and all(i in toxic for i in range(1000, 1030))
    rows = [(i, r.text) for i, r in toxic.items()]
    assert set(kept["near_dedup"]) == {i for i, (_, c) in brute_components(rows, 5, 80).items() if i == c}
    assert not any(1100 + k in kept["near_dedup"] and 1001 + k in kept["near_dedup"] for k in range(5))
    rows = [(i, r.text) for i, r in kept["near_dedup"].items()]
    for i, w, gone in brute_removal(rows, 50):
        assert (kept["substring_dedup"][i].text or "").split() == [x for x, y in zip(w, gone) if not y]
    assert sum(i in kept["substring_dedup"] and len(kept["substring_dedup"][i].text.split()) < 70 for i in range(1201, 1204)) == 3
    gone = set(kept["substring_dedup"]) - set(kept["decontamination"])
    assert gone == {1300 + k for k in range(5)} & set(kept["substring_dedup"]) and len(gone) >= 4
    assert set(kept["sentencepiece"]) == set(kept["decontamination"]) and all(r.round_trip for r in kept["sentencepiece"].values())


def test_run_is_the_stages_in_order(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "sentencepiece"]
    out = corpus_pipeline.run(spark, folder)
    assert out.filter(~F.col("round_trip")).count() == 0 and out.count() > 300


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    frame = queries.queries()[name](spark, f"{oracle.DATA}/sf0.001")
    assert not oracle.differences(frame, oracle.duck("sf0.001"), queries.oracle_sql()[name])
