"""near_dedup's tables on the way: what they leave in the shared folder, and how many tasks read them."""

import os
import random

import pytest

import corpus_pipeline
from spanloom.llm.cluster import durable, passing, shared_folder
from tests.llm.test_pipeline_stages import kept, table


def copies(spark, groups=30, each=4):
    r = random.Random(5)
    rows = []
    for g in range(groups):
        words = [f"w{r.randint(0, 10**9)}" for _ in range(150)]
        rows += [(1000 * g + k, " ".join([*words, f"end{k}"])) for k in range(each)]
    return table(spark, rows), [(1000 * g, rows[each * g][1]) for g in range(groups)]


def tasks(spark, group):
    t = spark.sparkContext.statusTracker()
    stages = {s for j in t.getJobIdsForGroup(group) for s in t.getJobInfo(j).stageIds}
    return sum(i.numCompletedTasks for s in stages if (i := t.getStageInfo(s)))


def test_near_dedup_of_small_tables_takes_few_tasks(spark):
    docs, first = copies(spark)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few-tasks", "")
        assert kept(corpus_pipeline.near_dedup(spark, docs, "")) == sorted(first, key=repr)
        n = tasks(spark, "few-tasks")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in was.items():
            spark.conf.set(k, v)
    assert n < 1500  # 928; 2352 when every table on the way was a checkpoint


def test_tables_go_with_their_block(spark):
    here = lambda: {x for x in os.listdir(shared_folder(spark).removeprefix("file:")) if x.startswith("tables-")}
    with passing(spark):
        t = durable(spark.range(1000, numPartitions=200).withColumnRenamed("id", "a b.c"))
        assert t.columns == ["a b.c"] and t.count() == 1000 and len(here()) == 1
        assert durable(t.filter("`a b.c` < 0")).isEmpty()
        assert t.rdd.getNumPartitions() < 100  # a checkpoint has 200
    assert not here()
    with pytest.raises(ZeroDivisionError), passing(spark):
        durable(spark.range(3))
        1 / 0
    assert not here()
    assert durable(spark.range(3)).count() == 3 and not here()
