"""The pipeline's stages against brute force, each on its own input, and all of them run as one."""

import pytest
from test_text_operators import base_by_regex, base_rules, brute_components, shingles

import corpus_pipeline
from quaybook.llm import entries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, as written Parquet."""
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        found[name] = docs, spark.read.parquet(path)
        docs = found[name][1]
    return found


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("name", ["quality_rules", "toxicity", "ngram_jaccard", "personal_data"])
def test_stages_return_documents(stages, name):
    before, after = stages[name]
    assert after.columns == before.columns
    old, new = by_id(before), by_id(after)
    assert set(new) <= set(old)
    if name != "personal_data":
        assert all(new[i] == old[i] for i in new)


def test_rules_reject_what_fails_the_base(stages):
    before, after = (by_id(x) for x in stages["quality_rules"])
    failed = {i for i, r in before.items() if base_rules(r["text"])[-1]}
    assert not failed & set(after)
    assert len(after) > 0.9 * (len(before) - len(failed) - 40)


def test_toxic_documents_go(spark, stages):
    before, after = (by_id(x) for x in stages["toxicity"])
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i in before if labels.get(i) == 0]
    assert sum(i in after for i in clean) >= 0.97 * len(clean)


def test_one_document_of_each_group_stays(stages):
    before, after = (by_id(x) for x in stages["ngram_jaccard"])
    group = brute_components({i: shingles(r["text"], 5) for i, r in before.items()}, 80)
    assert set(after) == {i for i in before if group[i] == i}


def test_personal_data_is_replaced(stages):
    before, after = (by_id(x) for x in stages["personal_data"])
    assert set(before) == set(after)
    for i, r in before.items():
        text, at, out = r["text"], 0, []
        for a, _, b, k in sorted((a, -b, b, k) for k, a, b in base_by_regex(text)):
            if a >= at:
                out += [text[at:a], f"<{k.upper()}>"]
                at = b
        assert after[i]["text"] == "".join([*out, text[at:]])
        assert after[i]["n_chars"] == len(after[i]["text"])


def test_a_run_gives_what_its_stages_give(spark, stages):
    before, after = stages["packing"]
    run = corpus_pipeline.run(spark, SF)
    place = lambda df: sorted((r["doc_id"], r["doc_tokens"]) for r in df.where("start = 0").collect())
    assert place(run) == place(after)
    assert sum(r["length"] for r in run.collect()) == sum(r["length"] for r in after.collect())
    assert {i for i, _ in place(run)} == {r["doc_id"] for r in before.collect()}


def test_registered_queries():
    names = list(entries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(entries.oracle_sql()) <= set(names)
