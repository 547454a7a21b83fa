"""The pipeline against a brute-force version, stage by stage, and the SQL of the operators."""

from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import awkward, empty, frame, words
from tests.llm.test_operators import PROSE
from tests.test_oracles import plain
from tidemark.llm import fertility, queries
from tidemark.sources.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.durable(stage(spark, docs, SF))
        out.append(docs.toPandas())
    return out


def test_quality_rules(spark, stages):
    bad = {r.doc_id for r in fertility.fertility(spark.read.parquet(f"{SF}/documents.parquet")).filter("reason IS NOT NULL").collect()}
    assert bad and set(stages[1].doc_id) == set(stages[0].doc_id) - bad


def test_exact_dedup(stages):
    assert sorted(stages[2].doc_id) == sorted(stages[1].groupby("text").doc_id.min())


def test_near_copies(stages):
    sets = {r.doc_id: set(r.text.split()) for r in stages[2].itertuples()}
    group = {d: d for d in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a] & sets[b]) >= corpus_pipeline.jaccard.THRESHOLD * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    assert set(stages[3].doc_id) == {d for d in ids if root(d) == d} and len(stages[3]) < len(stages[2])


def test_mixing_keeps_all_and_columns(stages):
    assert sorted(stages[4].doc_id) == sorted(stages[3].doc_id) and list(stages[4].columns) == list(stages[0].columns)


def test_packing_places_all_words(stages):
    want = {r.doc_id: len(r.text.split()) for r in stages[4].itertuples()}
    got = defaultdict(int)
    for r in stages[5].itertuples():
        got[r.doc_id] += r.n_tokens
    assert got == want


def test_windows_follow_the_schedule(spark, stages, monkeypatch):
    docs = spark.createDataFrame(stages[4])
    monkeypatch.setattr(corpus_pipeline, "WINDOW_TOKENS", 2_000)

    def held(**changes):
        monkeypatch.setattr(corpus_pipeline, "SCHEDULE", {**corpus_pipeline.SCHEDULE, **changes})
        df = corpus_pipeline.windows(spark, docs, SF).toPandas()
        return df.groupby(["window_id", "source"]).n_tokens.sum()

    found = held()
    sources = sorted(stages[4].source.unique())
    weights = [corpus_pipeline.curriculum.WEIGHTS.get(s, corpus_pipeline.curriculum.DEFAULT_WEIGHTS) for s in sources]
    for s, w in zip(sources, weights):  # the first window is at the schedule's start
        assert found[0][s] / 2_000 == pytest.approx(w[0] / sum(x[0] for x in weights), abs=0.02)
    turned = held(weights={k: w[::-1] for k, w in corpus_pipeline.curriculum.WEIGHTS.items()})
    assert found.to_dict() != turned.to_dict()
    level = held(weights={}, default=(1, 1, 1))
    assert found.to_dict() != level.to_dict()


def test_run_is_the_stages_in_turn(spark, stages):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, stages[-1].values.tolist()))


def test_windows_queue_in_the_order_that_mixing_stored(spark, tmp_path):
    rows = [(i, words(30, i), "en", "src1") for i in range(30)]
    for name, order in (("up", "doc_id"), ("down", "-doc_id")):
        frame(spark, rows).orderBy(F.expr(order)).coalesce(1).write.parquet(str(tmp_path / name))
    up, down = ([r.doc_id for r in corpus_pipeline.windows(spark, spark.read.parquet(str(tmp_path / n)), SF).orderBy("window_id", "offset").collect()] for n in ("up", "down"))
    assert up == list(range(30)) and down == up[::-1]


@pytest.mark.parametrize("rows", [awkward, empty], ids=["awkward", "empty"])
def test_stages_take_awkward_tables(spark, rows):
    docs = rows(spark)
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.durable(stage(spark, docs, SF))
        if i < 4:
            assert docs.columns == columns
            for r in docs.collect():  # columns of clashing names keep their values
                assert r["label"] == "label" and r["position"] == "position" and r["n_tokens"] == "n_tokens" and r["row"] == "row"
    if rows is empty:
        assert docs.count() == 0


def test_quality_stage_keeps_real_prose(spark):
    docs = frame(spark, [(i, t, lang, "src0") for i, (lang, t) in enumerate(PROSE.items())])
    assert corpus_pipeline.quality_rules(spark, docs, SF).count() == len(PROSE)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(plain(v) for _, v in sorted(zip(columns, r))) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[x]) for x in sorted(columns)) for r in df.collect()), key=repr) == want
