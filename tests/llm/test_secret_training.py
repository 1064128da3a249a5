"""The secret network learns from all findings: weights, calibration and threshold."""

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import secrets


def documents(spark, n):
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    mixed = np.array(list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"))
    rows = []
    for i in range(n):
        words = "".join(rng.choice(letters, 14 + i % 9))
        value = "".join(rng.choice(mixed, 20 + i % 9))
        rows.append((i, f"see {words} for it" if i % 4 else f"the token = {value} is old"))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_the_threshold_leaves_the_held_back_secrets_of_all_findings(spark, monkeypatch):
    docs = documents(spark, 800)
    taken, plain = [], secrets.fit
    monkeypatch.setattr(secrets, "fit", lambda views, labels: taken.append(plain(views, labels)) or taken[-1])
    net = secrets.train(docs, per_class=30, bucket_rows=200)
    every = secrets.every_finding(docs).withColumn("aside", F.pmod(F.xxhash64(F.lit("aside"), "view"), F.lit(5)) == 0).collect()
    assert len(every) == 800
    held = secrets._codes([r.view for r in every if r.aside and r.label])
    p = net.probabilities(secrets._alone(held))
    assert (p >= net.threshold - 1e-12).mean() >= secrets.LEAST_RECALL and (p <= net.threshold + 1e-4).any()
    assert not np.array_equal(net.filters, taken[0].filters)          # the start is not the end
    rest = secrets._codes([r.view for r in every])
    truth = np.array([r.label for r in every])
    answer = net.probabilities(rest)
    assert answer[truth == 1].mean() > 0.9 and answer[truth == 0].mean() < 0.1
    again = secrets.train(docs.repartition(7), per_class=30, bucket_rows=200)
    assert np.array_equal(again.filters, net.filters) and np.array_equal(again.chars, net.chars) and again.threshold == net.threshold


def test_few_findings_are_fitted_at_once(spark):
    docs = documents(spark, 100)
    whole, plain = secrets.train(docs), secrets.fit(*secrets.findings(docs))
    assert np.array_equal(whole.filters, plain.filters) and whole.threshold == plain.threshold
