"""Rounds over a few edges run in a few tasks, whatever the number of shuffle partitions."""

from __future__ import annotations

import uuid

from tradebook.operators.dedupe import components


def _tasks_of(spark, work) -> int:
    """Tasks of all stages that ``work`` ran."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "counted")
    try:
        work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    track = sc.statusTracker()
    stages = {s for j in track.getJobIdsForGroup(group) for s in track.getJobInfo(j).stageIds}
    return sum(i.numCompletedTasks for i in map(track.getStageInfo, stages) if i)


def test_rounds_over_few_edges_take_few_tasks(spark):
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    edges = [(i, i + 1) for i in range(0, 90, 1) if i % 10 != 9] + [(5, 5), (200, 100), (100, 200)]
    found = []
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame(edges, "src long, dst long").coalesce(1)
        tasks = _tasks_of(spark, lambda: found.extend(components(df).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r["id"], r["component"]) for r in found} == {(i, i - i % 10) for i in range(90)} | {(100, 100), (200, 100)}
    assert len(found) == 92
    assert tasks < 1500  # one per shuffle partition and step made several thousand
