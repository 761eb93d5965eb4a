"""The factorization machine's score against a double loop over pairs, and repeated labelled rows."""

import math

import numpy as np
import pytest

from factsheet.llm import toxicity
from factsheet.llm.common import stored


def test_score_equals_a_double_loop_over_pairs(monkeypatch):
    rng = np.random.default_rng(8)
    n, rank = 40, 5
    machine = toxicity.Machine(np.arange(n, dtype=np.int32), -0.3, rng.normal(size=n).astype(np.float32), rng.normal(size=(n, rank)).astype(np.float32))
    rows = [set(), {3}, {1, 2}, set(range(0, 40, 3)), set(range(40)), {39}, set()]
    monkeypatch.setattr(toxicity, "AT_ONCE", 9)
    for row, got in zip(rows, machine.score(rows)):
        own = sorted(row)
        x = 1 / math.sqrt(1 + math.log(len(own))) if own else 0.0
        raw = machine.bias + sum(float(machine.weight[i]) * x for i in own)
        raw += sum(float(np.dot(machine.factor[i].astype(float), machine.factor[j].astype(float))) * x * x for i in own for j in own if i < j)
        assert got == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-5)


def test_rows_of_one_labelled_id_count_once(spark):
    docs = [(k, f"good day number word{k % 9}") for k in range(60)] + [(100 + k, f"bad insult word{k % 9}") for k in range(60)]
    flood = [(7, f"good day copy {k}") for k in range(3000)]
    labels = spark.createDataFrame([(k, int(k >= 100)) for k, _ in docs] + [(7, 0)] * 50, "doc_id long, toxic int")
    table = stored(spark.createDataFrame(docs + flood, "doc_id long, text string"), "d")
    sample = toxicity.labelled_sample(table, labels, id_col="doc_id", text_col="text", label_col="toxic",
                                      learn_from=toxicity.F.lit(True), rows=1000)
    assert sample.count() == 120
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(table, toxicity.train(table, labels)).collect()}
    assert all(got[k] == int(k >= 100) for k, _ in docs)
