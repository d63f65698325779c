"""Checks of inputs and metrics that the queries don't exercise."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import graph, metrics, rate, retrieval, store


def test_token_grouping_refuses_bad_input(spark):
    edges = spark.createDataFrame([(1, 0, 0, 1, 1.0)], "graph_id int, head int, src int, dst int, w double")
    for wrong in ({"rounds": 0}, {"beta": 0.0}, {"beta": 1.5}, {"eps": 0.0}):
        with pytest.raises(ValueError):
            graph.propagate(edges, **wrong)
    for ratio in (0.0, 1.1):
        with pytest.raises(ValueError):
            graph.top_tokens(edges, ratio)


@pytest.mark.parametrize("rows", [[(1, 0, None)], [(1, 0, None), (1, 1, -1)], [(1, 0, None), (1, 1, 5), (1, 2, 5)]])
def test_original_places(spark, rows):
    tokens = spark.createDataFrame(rows, "graph_id int, node int, original int")
    with pytest.raises(PySparkException):
        graph.checked_tokens(tokens).collect()
    good = spark.createDataFrame([(1, 0, None), (1, 1, 5), (1, 2, 0)], "graph_id int, node int, original int")
    assert graph.checked_tokens(good).count() == 3


@pytest.mark.parametrize("kept, tokens", [(0, 4), (5, 4), (1, 0)])
def test_impossible_counts(spark, kept, tokens):
    row = rate.grouping_row(F.lit(kept), F.lit(tokens), F.lit(8), F.lit(8), F.lit(8), F.lit(64))
    with pytest.raises(PySparkException):
        spark.range(1).select(row["total_bpfp"]).collect()


def test_parts(spark):
    rows = [(0, 0), (1, 1), (1, 2), (6, 6), (3, 255)]
    got = metrics.parts_iou(spark.createDataFrame(rows, "pred int, gt int"), "pred", "gt").first().miou
    assert abs(got - 100 * (1 + 0.5 + 0 + 0 + 0 + 0 + 1) / 7) < 1e-9
    assert metrics.metrics_of("human_parts") == ("miou",)
    with pytest.raises(ValueError):
        metrics.metrics_of("weather")


def test_draws_differ_by_seed(spark):
    rows = spark.range(200).selectExpr("id", "id % 4 AS label")
    draw = lambda seed: sorted(r.id for r in retrieval.random_per_class(rows, "label", "id", 5, seed).collect())
    assert draw(1) == draw(1) and draw(1) != draw(2) and len(draw(1)) == 20


def test_tables_go_when_consumed(spark):
    made = store.materialize(spark.range(5), "here")
    assert made.count() == 5
    path = made._tessera_path.removeprefix("file://")
    assert os.path.exists(path)
    store.discard(made, made, spark.range(1))
    assert not os.path.exists(path)
