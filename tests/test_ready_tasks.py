"""Needs that many tasks share."""

from quillstone.streaming import online


def test_frequent_needs(spark):
    """One met and one unmet need of many rows, rare ones, a null one."""
    tasks = spark.range(12).withColumnRenamed("id", "task")
    needs = [(i, 100) for i in range(12)] + [(i, 200) for i in range(6)] + [(7, 300), (8, 301), (9, None)]
    needs = spark.createDataFrame(needs, "task long, needs long")
    done = spark.createDataFrame([(100,), (300,), (11,)], "task long")
    for many in (3, 1_000):
        assert sorted(r.task for r in online.ready_tasks(tasks, needs, done, many).collect()) == [6, 7, 10]
