"""The toxicity model is made where the texts are: in a task, not on the driver."""

import os

import pytest
from pyspark.sql import functions as F

from sylva.llm import toxicity as T
from sylva.llm.queries import held_out, table, toxicity_model


def test_driver_fits_nothing(spark, sf_dir, monkeypatch):
    want = T.fit(T.labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out()))
    assert want.toxic and want.ordinary

    driver, fit = os.getpid(), T.fit

    def elsewhere(rows):
        assert os.getpid() != driver, "texts on the driver"
        return fit(rows)

    monkeypatch.setattr(T, "fit", elsewhere)
    assert toxicity_model(spark, sf_dir) == want


@pytest.mark.parametrize("rows", [[], [("a b", 1)], [("a b", 0), ("", 1), ("é 𝄞", 0)]])
def test_few_rows(spark, rows):
    found = T.fit_rows(spark.createDataFrame(rows, "text string, label int").where(F.col("text").isNotNull()))
    assert found == T.fit(rows)
