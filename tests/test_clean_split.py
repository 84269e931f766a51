import pytest
from pyspark.sql import functions as F

from softgrove.operators import clean
from softgrove.operators.labels import encode_label, minority_share
from softgrove.operators.split import split_quotas, stratified_split


def test_fill_mode_token_takes_part(spark):
    df = spark.createDataFrame([("a",), ("?",), ("?",), ("b",), ("b",), ("?",)], "c string")
    out = [r["c"] for r in clean.fill_mode(df, ["c"], token="?").collect()]
    assert out.count("?") == 3  # token is the mode -> stays
    out = [r["c"] for r in clean.fill_mode(df, ["c"], token="?", exclude_token=True).collect()]
    assert out.count("b") == 5


def test_fill_mode_tie_lowest_and_all_columns(spark):
    df = spark.createDataFrame([(None, 2.0), ("y", None), ("x", 2.0), ("y", 3.0), ("x", 3.0)], "s string, v double")
    out = clean.fill_mode_all(df).collect()
    assert out[0]["s"] == "x" and out[1]["v"] == 2.0


def test_derive_label_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (-1.0,)], "x double")
    assert [r["label"] for r in clean.derive_label(df, F.col("x") > 0).collect()] == [1, 0, 0]
    assert [r["label"] for r in clean.derive_label(df, F.col("x") != 0, null_as=1).collect()] == [1, 1, 1]


def test_split_positions(spark):
    import pytest
    df = spark.createDataFrame([("  GTAC",), ("GT",), (None,)], "s string")
    out = clean.split_positions(df, "s", 4, ["a", "b", "c", "d"]).collect()
    assert [out[0][k] for k in "abcd"] == list("GTAC")
    assert [out[1][k] for k in "abcd"] == ["G", "T", None, None]
    assert [out[2][k] for k in "abcd"] == [None] * 4
    with pytest.raises(Exception, match="more than 3 characters"):
        clean.split_positions(df, "s", 3).collect()


def test_encode_label_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "y string")
    coded, mapping = encode_label(df, "y", keep=True)
    assert {r["y"]: r["label"] for r in coded.collect()} == {"a": 0, "b": 1, "c": 2}


def test_split_exact_sizes_disjoint_and_partition_invariant(spark):
    rows = [(i, i % 3 if i < 140 else 0) for i in range(150)]
    df = spark.createDataFrame(rows, "row_id long, label int")
    a = {r["row_id"]: r["split"] for r in stratified_split(df, seed=5).collect()}
    b = {r["row_id"]: r["split"] for r in stratified_split(df.repartition(7), seed=5).collect()}
    assert a == b
    sizes = {s: sum(1 for v in a.values() if v == s) for s in ("train", "valid", "test")}
    assert sizes == {"test": 30, "valid": 30, "train": 90}
    quotas = split_quotas({0: 57, 1: 47, 2: 46}, 0.2, 0.2)
    for c, (t, v) in quotas.items():
        got_t = sum(1 for k, s in a.items() if s == "test" and rows[k][1] == c)
        got_v = sum(1 for k, s in a.items() if s == "valid" and rows[k][1] == c)
        assert (got_t, got_v) == (t, v)


def test_split_rejects_single_row_class(spark):
    df = spark.createDataFrame([(i, 0) for i in range(10)] + [(99, 1)], "row_id long, label int")
    with pytest.raises(ValueError):
        stratified_split(df)


def test_minority_share(spark):
    df = spark.createDataFrame([(0,)] * 9 + [(1,)], "label int")
    r = minority_share(df, ratio=0.25).first()
    assert r["min_count"] == 1 and r["needs_rebalance"] is True


def test_replace_values_contains_label_and_numeric_coercion(spark):
    df = spark.createDataFrame([("negative.|1",), ("-x",), ("?",), ("12.5",)], "c string")
    assert [r["c"] for r in clean.replace_values(df, "c", ["?", "-x"], "NA").collect()] == ["negative.|1", "NA", "NA", "12.5"]
    lab = [r["label"] for r in clean.derive_label(df, F.col("c").contains("-"), "label").collect()]
    assert lab == [0, 1, 0, 0]
    assert [r["c"] for r in clean.to_numeric(df, ["c"]).collect()] == [None, None, None, 12.5]
    with pytest.raises(Exception):
        clean.to_numeric(df, ["c"], strict=True).collect()


def test_encode_label_of_many_levels_by_distributed_sort(spark, monkeypatch):
    import softgrove.operators.labels as lab
    rows = [(i, (i * 7919) % 500 - 250) for i in range(1000)] + [(1000, None)]
    df = spark.createDataFrame(rows, "row_id long, y int").repartition(6)
    want = {v: k for k, v in enumerate(sorted({y for _, y in rows if y is not None}))} | {None: None}
    few = {r["y"]: r["label"] for r in encode_label(df, "y", keep=True)[0].collect()}
    monkeypatch.setattr(lab, "LEVEL_COLLECT_LIMIT", 3)
    coded, mapping = encode_label(df, "y", keep=True)
    assert few == {r["y"]: r["label"] for r in coded.collect()} == want
    assert coded.columns == ["row_id", "y", "label"] and mapping.count() == 500


def test_stack_tables_keeps_duplicates(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "k int, v string")
    b = spark.createDataFrame([("y", 2), (None, None)], "v string, k int")
    assert sorted(map(str, clean.stack_tables([a, b]).collect())) == sorted(map(str, [*a.collect(), *b.select("k", "v").collect()]))


def test_split_refuses_a_key_that_repeats_across_a_cut(spark):
    import pytest
    df = spark.createDataFrame([(7, k % 2) for k in range(40)], "row_id long, label int")
    with pytest.raises(Exception, match="unique keys"):
        stratified_split(df).collect()
