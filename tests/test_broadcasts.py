"""Tables that are small in their files and large in memory are joined by a merge, never broadcast."""

from pyspark.sql import functions as F

from penumbra import session
from penumbra.operators import overlay
from penumbra.plans import walking

SF = "/root/testdata/sf0.001"


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nodes_are_not_broadcast(spark):
    for df in (walking._edges(spark, SF), walking.asked(spark, SF)):
        assert "BroadcastHashJoin" not in joins(df) and "SortMergeJoin" in joins(df)


def test_kept_tables_are_broadcast_only_while_small(spark, monkeypatch):
    big = spark.range(2000)
    assert "BroadcastHashJoin" in joins(big.join(session.keep(spark.range(50)), "id"))
    monkeypatch.setattr(session, "MOST_ROWS", 40)
    kept = session.keep(spark.range(50))
    assert "BroadcastHashJoin" not in joins(big.join(kept, "id")) and big.join(kept, "id").count() == 50
    assert "BroadcastHashJoin" in joins(big.join(session.bounded(kept), "id"))  # who counts may still broadcast


def test_cells_met_are_those_around_and_those_of_ends(spark):
    end = lambda *cells: "array(" + ", ".join(f"named_struct('cell', {c}L, 'node', 1L, 'edge', 1L, 'cost', array(0d))" for c in cells) + ")"
    asked = spark.range(1).select(F.expr("array(1L, 2L)").alias("cells"), F.expr(end(2, 7)).alias("sources"), F.expr(f"cast(null as {overlay._ENDS_IN})").alias("targets"))
    assert sorted(r.cell for r in overlay.cells_met(asked).collect()) == [1, 2, 7]
