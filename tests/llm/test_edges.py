"""Every operator takes awkward and empty tables and gives the results that its docstring defines."""

import pytest

from tests.llm.helpers import awkward, empty, frame, words
from tidemark.llm import chat, curriculum, exact_dedup, fertility, jaccard, packing, pseudo_likelihood, quality_gam, substring, toxicity


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "exact_dedup": exact_dedup.exact_dedup,
    "drop_repeats": exact_dedup.drop_repeats,
    "pack": lambda d: packing.pack(d, window_tokens=256),
    "repeated_passages": substring.repeated_passages,
    "score_documents": pseudo_likelihood.score_documents,
    "similar_pairs": jaccard.similar_pairs,
    "keep_one": jaccard.keep_one,
    "fertility": fertility.fertility,
    "keep_natural": fertility.keep_natural,
    "toxicity": lambda d: toxicity.toxicity(d, labels(d.sparkSession, [(1, 1, 0), (10, 0, 1), (10, None, None), (None, 1, 1)])),
    "mix_sources": curriculum.mix_sources,
    "quality": lambda d: quality_gam.quality(d, labels(d.sparkSession, [(1, 1, 0), (10, 0, 1), (10, None, None), (None, 1, 1)])),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](empty(spark)).count() == 0


@pytest.fixture(scope="module")
def results(spark):
    table = awkward(spark)
    return {name: run(table).collect() for name, run in OPERATORS.items()}


def test_exact_dedup(results):
    got = sorted(((r.doc_id, r.winner_id, r.n_rows, r.is_repeat) for r in results["exact_dedup"]), key=repr)
    assert (1, 1, 1, False) in got and (2, 1, 2, True) in got and (None, 1, 1, True) in got
    assert (4, 4, 1, False) in got and (None, None, 1, False) in got
    assert (5, 5, 1, False) in got and (6, 5, 1, True) in got and (11, 10, 1, True) in got and (13, 13, 1, False) in got


def test_drop_repeats_keeps_columns_and_one_of_each(results):
    rows = results["drop_repeats"]
    assert sorted((r.doc_id for r in rows), key=lambda x: (x is None, x)) == [1, 3, 4, 5, 7, 8, 9, 10, 12, 13, 13, None]
    assert all(r["digest"] == "digest" and r["window"] == "window" for r in rows)


def test_pack_places_every_word_once(results, spark):
    placed = {}
    for r in results["pack"]:
        placed[r.doc_id] = placed.get(r.doc_id, 0) + r.n_tokens
    want = {}
    for r in awkward(spark).collect():
        n = len((r.text or "").split())
        if n:
            want[r.doc_id] = want.get(r.doc_id, 0) + n
    assert placed == want


def test_repeated_passages(results):
    got = {r.doc_id: (r.start_word, r.n_words) for r in results["repeated_passages"]}
    assert got == {1: (0, 200), 2: (0, 200), 3: (0, 200), 10: (0, 30_000), 11: (0, 30_000)}


def test_scores(results):
    by = {r.doc_id: r for r in results["score_documents"] if r.doc_id}
    assert len(results["score_documents"]) == 17
    assert by[4].log_prob == 0 and by[4].mean_log_prob is None and by[10].n_tokens == 30_000 and by[10].log_prob < 0


def test_similar_pairs(results):
    got = {(r.doc_a, r.doc_b) for r in results["similar_pairs"]}
    assert got == {(1, 2), (1, 3), (10, 11)}


def test_keep_one(results):
    assert sorted((r.doc_id for r in results["keep_one"]), key=lambda x: (x is None, x)) == [1, 4, 5, 6, 7, 8, 9, 10, 12, 13, 13, None, None]


def test_fertility(results):
    by = {r.doc_id: r for r in results["fertility"] if r.doc_id}
    assert by[4].reason == by[5].reason == by[7].reason == "empty"
    assert by[8].reason is None and by[10].band == "script:latin" and by[12].band == "script:other" and by[12].byte_share > 0
    assert len(results["fertility"]) == 17
    assert all(r["band"] == "band" for r in results["keep_natural"])


def test_classifiers_score_every_row(results):
    assert len(results["toxicity"]) == len(results["quality"]) == 17


def test_mix_keeps_every_row_in_order(results):
    rows = results["mix_sources"]
    assert len(rows) == 17 and [r.position for r in rows] == sorted(r.position for r in rows)
    assert all(r["bucket"] == "bucket" for r in rows)


def test_labels_that_are_all_alike(spark):
    docs = frame(spark, [(i, words(30, i)) for i in range(6)])
    clean = toxicity.toxicity(docs, labels(spark, [(i, 1, 0) for i in range(6)])).collect()
    assert not any(r.is_toxic for r in clean)
    assert all(r.keep for r in quality_gam.quality(docs, labels(spark, [(i, 1, 0) for i in range(6)])).collect())


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, window string"
    rows = [(1, 0, "system", "be kind", "x"), (2, 0, None, None, "x"), (2, None, "user", "hi", "x"), (2, 1, "assistant", "yes", "x"), (2, 1, "assistant", "yes", "x"), (None, 0, "assistant", "alone", "x"), (3, 0, "assistant", "word " * 3000, "x")]
    got = {(r.conv_id, r.window): r for r in chat.chat_windows(spark.createDataFrame(rows, schema)).collect()}
    assert got[1, 0].n_turns == 0 and got[1, 0].targets == []
    assert got[2, 0].n_turns == 4 and len(got[2, 0].targets) == 2 and got[2, 0].text.startswith("<|user|>\nhi")
    assert got[None, 0].n_target_tokens == 1 and got[3, 0].over_budget
    assert chat.chat_windows(spark.createDataFrame([], schema)).count() == 0
