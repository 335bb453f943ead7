"""What the plans of every query must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from partita.functions.arrays import drop_empty
from partita.operators import sequences as S
from partita.operators.intervals import overlap_join

QUERIES = entry.queries()
#: Their plans are those of the queries they share an operator with, and building them runs jobs.
SAME_PLAN = {"p1_report", "p2_splits", "p4_report", "p4_sample", "p5_key_summary", "p7_leaks", "p7_items", "p8_report", "p8_mixture", "p9_pages", "neighbour_walks", "network_sweep", "stream_runs", "train_logistic"}
#: Queries with a nested-loop join, and why its inner side is small: one row of totals, a band per class, or a vocabulary of 157.
SMALL_LOOPS = {
    "label_durations": "one row", "class_prior": "one row", "class_weights": "one row", "weighted_steps": "one row", "kfold": "one row", "weighted_mux": "one row", "bigram_state": "one row",
    "categorical_draw": "a band per class", "precision_recall": "classes", "score_micro_macro": "one row",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SAME_PLAN))
def test_no_cross_join_of_tables(spark, sf, name):
    """Also the queries of the llm subpackage, if it is there. What ran before a checkpoint is not in the plan."""
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text or name in SMALL_LOOPS


def test_columns_are_pruned(spark, sf):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES["label_durations"](spark, sf)))
    assert schemas and all("props" not in s and "value" not in s for s in schemas)


def test_filters_reach_the_scan(spark, sf):
    pushed = re.findall(r"PushedFilters: \[(.*?)\]", plan(QUERIES["import_labels"](spark, sf)))
    assert any("IsNotNull(time_point)" in p for p in pushed)


def test_store_partitions_are_pruned(spark, tmp_path):
    from partita.sources.annotations import write_stash

    df = spark.range(20).select(F.col("id"), (F.col("id") % 5).alias("fold"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"))
    write_stash(df, str(tmp_path / "s"), "fold", "split")
    text = plan(spark.read.parquet(str(tmp_path / "s")).where("fold = 3 and split = 'test'"))
    assert re.search(r"PartitionFilters: \[.*fold.*split.*\]", text) and "PushedFilters: []" in text


def test_windows_of_cut_keys_are_over_blocks(spark, sf, monkeypatch):
    """With blocks, no window over rows has the key alone; those that have it pass one row per block."""
    monkeypatch.setattr(S, "BLOCK_ROWS", 13)
    windows = re.findall(r"windowspecdefinition\(([^)]*)", plan(QUERIES["run_length"](spark, sf)))
    assert windows and all("__b" in w or "__group" in w for w in windows)


def test_overlaps_join_on_key_and_bucket(spark):
    df = spark.createDataFrame([("k", 0, 5, "x")], "k string, s bigint, e bigint, label string")
    text = plan(overlap_join(df, df, "k", 10))
    assert re.search(r"(SortMerge|BroadcastHash|ShuffledHash)Join \[k#\d+L?, __b#\d+L?\]", text)


def test_drop_empty(spark):
    df = spark.createDataFrame([({"a": "1", "b": None, "c": "", "d": "0"},)], "m map<string,string>")
    assert df.select(drop_empty(F.col("m"))).first()[0] == {"a": "1"}
