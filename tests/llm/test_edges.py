"""Every operator and stage over odd rows, over no rows, and without labels."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quaybook.llm import entries, jaccard, licenses, neighbours, packing, pieces, pii, quality, rules, secrets, toxicity

def first():
    return F.col("doc_id") % 2 == 0


def _quality(d, labels):
    return quality.score(d, quality.train(d, labels, first()))


def _toxicity(d, labels):
    return toxicity.score(d, toxicity.train(d, labels, first()))


def _pieces(d, _):
    import public_tokenizers

    return pieces.encode_documents(d, public_tokenizers.path("piece_bpe_32k.model"))


EACH_ROW = {
    "pii": lambda d, _: pii.find(d),
    "redact": lambda d, _: pii.redact(d),
    "quality": _quality,
    "toxicity": _toxicity,
    "secrets": lambda d, _: secrets.scan(d),
    "jaccard": lambda d, _: jaccard.join(d, jaccard.JoinConfig(4, 85)),
    "rules": lambda d, labels: rules.apply_rules(d, labels)[0],
    "pieces": _pieces,
    "licenses": lambda d, _: licenses.scan(d),
}
SOME_ROWS = {
    "pack": lambda d, _: packing.pack(d, entries.pack_config()),
    "keep_good": lambda d, labels: rules.keep_good(d, labels),
    "reject_toxic": lambda d, labels: toxicity.reject_toxic(d, labels),
    "keep_first": lambda d, _: jaccard.keep_first(d),
}


@pytest.mark.parametrize("name", EACH_ROW)
def test_each_row_gets_one_result(odd, labels, name):
    got = Counter(r["doc_id"] for r in EACH_ROW[name](odd, labels).collect())
    assert got == Counter(r["doc_id"] for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", [*EACH_ROW, *SOME_ROWS])
def test_no_rows_give_no_rows(none, no_labels, labels, name):
    operator = (EACH_ROW | SOME_ROWS)[name]
    assert operator(none, no_labels).isEmpty()
    assert operator(none, labels).isEmpty()


@pytest.mark.parametrize("name", ["quality", "toxicity", "rules", "keep_good", "reject_toxic"])
def test_without_labels(odd, no_labels, name):
    assert (EACH_ROW | SOME_ROWS)[name](odd, no_labels).count() >= 1


@pytest.mark.parametrize("name", ["keep_good", "reject_toxic", "keep_first", "redact"])
def test_stages_keep_all_columns(odd, labels, name):
    kept = (EACH_ROW | SOME_ROWS)[name](odd, labels)
    assert kept.columns == odd.columns
    assert [f.dataType for f in kept.schema] == [f.dataType for f in odd.schema]
    kept.count()


def test_packing_odd_rows_is_exact(odd):
    pieces_ = packing.pack(odd, entries.pack_config(), with_ids=True).collect()
    rows = Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    starts = Counter(p["doc_id"] for p in pieces_ if p["start"] == 0)
    assert starts == rows
    assert sum(p["length"] for p in pieces_ if p["doc_id"] == 1) == 1


def test_components_of_odd_rows(odd):
    got = {(r["doc_id"], r["key"]): (r["n_shingles"], r["component_id"]) for r in jaccard.join(odd, jaccard.JoinConfig(4, 85)).collect()}
    by_id = {}
    for (i, _), v in got.items():
        by_id.setdefault(i, set()).add(v)
    assert by_id[1] == by_id[2] | {(0, 1)} - {(0, 2)} or by_id[1] == {(0, 1)}
    assert by_id[2] == {(0, 2)}
    assert by_id[3] == {(0, 3)}
    assert by_id[4] == {(1, 4)}
    assert by_id[5] == {(4, 5)}
    assert by_id[6] == {(4, 5), (5, 6)}


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.1]), (8, [1.0, 0.1]), (9, [-1.0, 0.0]), (None, [1.0, 1.0]), (50, [1.0, 2.0, 3.0]), (7, [1.0, 0.1])]
    v = spark.createDataFrame([(i, x, "a") for i, x in rows], "vec_id long, embedding array<float>, rank string")
    got = neighbours.search(v).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 7), (0, 2, 8), (0, 3, 9)]
    assert neighbours.search(v.limit(0)).isEmpty()


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "ngram_jaccard", "personal_data", "packing"]
