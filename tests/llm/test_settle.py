"""Executors give free heap back before stages whose Python workers need the memory."""

from graphloom.llm import stages


def collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_packing_begins_with_settled_heaps(spark):
    before = collections(spark)
    out = stages.pack(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "")
    assert collections(spark) > before
    assert {r["doc_id"] for r in out.collect()} == {1}
