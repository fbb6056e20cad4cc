"""The pipeline's stages against their operators, one after another."""

import re
from pathlib import Path

import pytest

import corpus_pipeline
from tests.llm.helpers import documents, empty, odd_rows
from tidewright.llm import common, language, packing, simhash, toxicity


def test_stages(spark, data, tmp_path):
    docs = documents(spark, data)
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append((name, docs, after))
        docs = after
    assert [n for n, _, _ in seen] == ["toxicity", "language", "near_duplicates", "packing"]
    assert all(after.columns == columns for _, _, after in seen[:-1])
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    _, before, after = seen[0]
    scored = toxicity.toxicity(before, toxicity.train(*toxicity.sample(before, toxicity.labels_of(spark, data))))
    assert ids(after) == ids(scored.where("predicted = 0"))
    _, before, after = seen[1]
    field = language.train(*language.sample(before))
    assert ids(after) == ids(language.predict(before, field).where(f"lang_pred <> 'und' and score >= {corpus_pipeline.LANGUAGE} and known >= {field.least}"))
    _, before, after = seen[2]
    assert ids(after) == ids(simhash.one_of_each_group(before)) and set(ids(after)) <= {r.component_id for r in simhash.near_duplicates(before).collect()}
    _, before, after = seen[3]
    assert sorted({r.doc_id for r in after.collect()}) == ids(before)
    assert after.columns == packing.pack(before, packing.public_tokenizers.path("word_bpe_49k.json")).columns
    shared = Path(re.sub("^file:/*", "/", common.shared_folder(spark)))
    names = lambda: {p.name for p in shared.glob("*-*") if not p.name.startswith("rdd-")}
    common.release(spark)
    before = names()
    assert corpus_pipeline.run(spark, data).count() == after.count()
    assert names() == before  # nothing is left behind


@pytest.mark.parametrize("rows", [odd_rows, empty])
def test_stages_take_odd_and_empty_tables(spark, data, rows):
    """Nulls in any column, empty and very long texts, repeated rows, and extra columns with names that operators use."""
    docs = rows(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
        kept = out.count()
        if rows is empty:
            assert kept == 0
            continue
        field = language.train(*language.sample(docs))
        known = language.predict(docs, field).where(f"lang_pred <> 'und' and known >= {field.least}").count()
        assert kept == {"toxicity": docs.count(), "language": known, "near_duplicates": simhash.one_of_each_group(docs).count()}[name] and 0 < known < docs.count()
    pieces = corpus_pipeline.packed(spark, docs, data).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}


def test_nothing_is_dropped_without_a_model(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a text of its own {i}", None, "s", 5) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.keep_languages(spark, docs, str(tmp_path)).count() == 40
    for k, pairs in enumerate(([], [(i, 1) for i in range(40)], [(i, 0) for i in range(40)], [(1, 1), (2, 0)])):
        spark.createDataFrame(pairs, "doc_id long, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        assert corpus_pipeline.drop_toxic(spark, docs, f"{tmp_path}/{k}").count() == 40


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())


def test_clean_texts_stay_with_many_languages(spark, data):
    text = "one and the same few words in all of these languages"
    docs = spark.createDataFrame([(i, text if i else "12 34 --", f"l{i % 12}") for i in range(120)], "doc_id long, text string, lang string")
    scores = [r.score for r in language.predict(docs, language.train(*language.sample(docs))).where("doc_id > 0").collect()]
    assert max(scores) < 0.2  # below the score that four languages never reach
    assert sorted(r.doc_id for r in corpus_pipeline.keep_languages(spark, docs, data).collect()) == list(range(1, 120))


def test_threads_release_their_own_tables(spark):
    """One thread's release leaves another's tables, which are still to be read."""
    from threading import Thread

    held = []
    before = common.written()
    common.table(spark.range(3), "mine")
    other = Thread(target=lambda: held.append(common.table(spark.range(5), "other")))
    other.start()
    other.join()
    assert common.written() == before + 1
    common.release(spark, before)
    assert common.written() == before and held[0].count() == 5
