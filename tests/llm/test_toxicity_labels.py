"""Operator 4's label model: labels that err, voters that say the same, rows that stand for others."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetcases.llm import toxicity

SF = "/root/testdata/sf0.01"


def world(n=4000, voters=12, seed=5):
    """True labels (a tenth toxic) and votes that are independent given the label."""
    rng = np.random.default_rng(seed)
    true = rng.random(n) < 0.1
    votes = rng.random((n, voters)) < np.where(true[:, None], 0.35, 0.02)
    return rng, true, votes


def test_flipped_labels_are_recovered_and_their_accuracy_is_estimated():
    rng, true, votes = world()
    flipped = rng.random(len(true)) < 0.1
    model = toxicity.LabelModel(0.1)
    post = model.fit(votes, (true ^ flipped).astype(float))
    assert ((post > 0.5) == true)[flipped].mean() > 0.85 and ((post > 0.5) == true).mean() > 0.98
    assert model.hit == pytest.approx(0.9, abs=0.05) and model.miss == pytest.approx(0.1, abs=0.03)


def test_right_labels_stay():
    _, true, votes = world()
    model = toxicity.LabelModel(0.1)
    assert ((model.fit(votes, true.astype(float)) > 0.5) == true).mean() > 0.99
    assert model.hit > 0.95 and model.miss < 0.02


def test_copies_of_a_voter_count_as_one():
    _, true, votes = world()
    model = toxicity.LabelModel(0.1)
    model.fit(np.hstack([votes, np.repeat(votes[:, :1], 9, axis=1)]), true.astype(float))
    assert model.share[0] == pytest.approx(0.1, abs=0.01) and model.share[12:] == pytest.approx(model.share[0])
    assert (model.share[1:12] > 0.9).all()


def test_rows_that_stand_for_others_give_the_same_as_those_rows():
    rng, true, votes = world(1500)
    marked = (true ^ (rng.random(len(true)) < 0.05)).astype(float)
    times = np.where(marked > 0, 1, 3)
    whole = toxicity.LabelModel(0.1).fit(np.repeat(votes, times, axis=0), np.repeat(marked, times))
    few = toxicity.LabelModel(0.1).fit(votes, marked, times.astype(float))
    assert np.abs(np.repeat(few, times) - whole).max() < 0.02
    w = toxicity._logistic(votes, few, times.astype(float))
    assert w == pytest.approx(toxicity._logistic(np.repeat(votes, times, axis=0), np.repeat(few, times), np.ones(times.sum())), abs=1e-6)


def test_scores_do_not_follow_the_bound_on_clean_rows(spark, monkeypatch):
    # at sf0.01 a quarter of the clean rows is too few to tell any word by
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))

    def scores():
        return np.array([r.score for r in toxicity.score_toxicity(docs, labels).orderBy("doc_id").collect()])
    free = scores()
    monkeypatch.setattr(toxicity, "MAX_CLEAN", labels.filter("toxic = 0").count() // 4)
    bound = scores()
    assert abs(bound.mean() - free.mean()) < 0.03 and ((bound >= 0.5) == (free >= 0.5)).mean() > 0.95


def test_several_and_null_labels_repeated_rows_and_long_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    # a document of the labels 0, 1 and null is toxic once, however the rows come
    more = labels.unionByName(labels.filter("toxic = 1").withColumn("toxic", F.lit(0))).unionByName(
        labels.withColumn("toxic", F.lit(None).cast("int"))).unionByName(labels)
    again = toxicity.fit(docs, more.repartition(7))
    assert again.keys() == model.keys() and all(again[k] == pytest.approx(model[k], abs=1e-9) for k in model)
    word = max((k for k in model if k and not k.endswith("-") and k.isalpha()), key=lambda k: model[k])
    rows = [(1, None), (2, ""), (3, "plain " * 200_000), (4, "plain " * 200_000 + word), (5, word), (5, word)]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in odd.withColumn("score", toxicity.score_column(odd, model)).collect():
        got.setdefault(r.doc_id, set()).add(r.score)
    assert got[1] == got[2] == got[3] and got[4] == got[5] and max(got[5]) > max(got[1]) and len(got[5]) == 1
