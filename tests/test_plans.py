"""Physical-plan properties: column pruning at the scan, no Python in the
shallow scoring path."""

from conftest import SF
from softgrove.functions.columns import node_prob, permute
from softgrove.plans import table_queries as tq


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_reads_only_needed_columns(spark):
    plan = _plan(tq.q_stratified_split(spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_shallow_scoring_stays_in_the_jvm(spark):
    plan = _plan(tq.q_soft_tree_score(spark, SF))
    assert "PythonUDF" not in plan and "MapInArrow" not in plan and "MapInPandas" not in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan


def test_node_prob_and_permute(spark):
    from pyspark.sql import functions as F
    r = spark.createDataFrame([([1.0, 2.0, 3.0],)], "f array<double>").select(
        node_prob(F.col("f")[0], 1.0).alias("p"), permute(F.col("f"), [2, 0, 1]).alias("q")).first()
    assert r["p"] == 0.5 and r["q"] == [3.0, 1.0, 2.0]


def test_split_positions_takes_its_width_from_the_names(spark, tmp_path):
    rows = [(1, "  a name of more than sixteen characters "), (2, "short"), (3, None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r[1:] for r in tq.q_split_positions(spark, str(tmp_path)).collect()}
    n = len(rows[0][1].strip())
    assert got == {k: tuple(((name or "").strip() + " " * n)[i] if i < len((name or "").strip()) else None for i in range(n)) for k, name in rows}
    spark.createDataFrame(rows[1:], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/less/part.parquet")
    out = tq.q_split_positions(spark, f"{tmp_path}/less")
    assert out.columns == ["p_partkey", *(f"c{i}" for i in range(tq.NAME_LENGTH))]
