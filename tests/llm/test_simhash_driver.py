"""op3: tables of near copies don't go through the driver, however small Spark takes them for."""

from pyspark.sql import functions as F

from fgspark.llm.simhash import near_copies


def test_no_join_is_broadcast(spark):
    """Blocks, rounds of components and the named rows: compressed files and exploded points look small when they are not."""
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("one text that many rows have in common")).otherwise(
            F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(60)), lambda k: F.hash(k, (F.col("id") / 4).cast("int")).cast("string")), F.when(F.col("id") % 2 == 0, F.lit("more")))
        ).alias("text"),
    )
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    rows = near_copies(docs).collect()
    assert len(rows) == 600
    assert {r.component_id for r in rows if r.doc_id % 3 == 0} == {0}
    assert any(r.component_id != r.doc_id for r in rows if r.doc_id % 3)
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    found = store.executionsList(int(before), 1000)
    plans = [found.apply(k).physicalPlanDescription() for k in range(found.size())]
    assert sum("SortMergeJoin" in p for p in plans) >= 4
    assert not [p for p in plans if "BroadcastExchange" in p]
