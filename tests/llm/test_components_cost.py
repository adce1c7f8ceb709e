import random

import meltemi.llm.components as module
from meltemi.llm.components import components


def _least(edges):
    comp = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((root(u), root(v)))
            comp[b] = a
    return {x: root(x) for x in comp}


def test_few_tasks(spark):
    """The driver keeps something of each task: a hub, a path and pairs take a few shuffles a turn and few turns."""
    rnd = random.Random(4)
    edges = [(5000, i) for i in range(300)] + [(i, i + 1) for i in range(1000, 1400)] + [(rnd.randint(2000, 2400), rnd.randint(2000, 2400)) for _ in range(300)]
    rnd.shuffle(edges)
    df, sc = spark.createDataFrame(edges, "u long, v long").repartition(8), spark.sparkContext
    # As many tasks a shuffle as at size, where nothing is broadcast.
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("components", "components")
        got = dict(map(tuple, components(df).collect()))
        t = sc.statusTracker()
        stages = {s for j in t.getJobIdsForGroup("components") for s in t.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for i in map(t.getStageInfo, stages) if i)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == _least(edges)
    assert tasks < 600, tasks


def test_chunks_do_not_part_a_larger_end(spark, monkeypatch):
    """Each row its own batch and chunk: edges of one larger end still meet, so the turns come to an end."""
    monkeypatch.setattr(module, "CHUNK", 1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        edges = [(9, i) for i in range(5)] + [(8, 4), (8, 7), (20, 22), (21, 22)]
        assert dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long").repartition(2)).collect())) == _least(edges)
    finally:
        spark.conf.set(key, before)
