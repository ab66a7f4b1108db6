import random
import time
from pathlib import Path

from helpers import docs, stored

from tidemark.llm import graph
from tidemark.llm import near_dedup as nd
from tidemark.llm.common import prepared


def roots(pairs):
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_few_links_need_few_tasks(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(50, 90)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    links = stored(spark.createDataFrame(pairs, "a long, b long"))
    key, before = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(key, "false")
    try:
        got = graph.components(links)
        assert {r.node: r.comp for r in got.collect()} == roots(pairs) and got.rdd.getNumPartitions() == 1
        monkeypatch.setattr(graph, "TASK_LINKS", 100)
        got = graph.components(links)
        assert {r.node: r.comp for r in got.collect()} == roots(pairs) and got.rdd.getNumPartitions() > 1
        assert graph.components(links.limit(0)).count() == 0
    finally:
        spark.conf.set(key, before)


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in Path(d.getPath()).glob("*/shuffle_*")}


def test_finished_steps_leave_no_shuffle_files(spark):
    prepared(spark)
    df = docs(spark, [f"{' '.join(str(i // 2 * 100 + k) for k in range(60))} {i}" for i in range(40)])
    before = shuffle_files(spark)
    out = nd.near_dedup(df)
    for _ in range(50):  # files are deleted in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert sorted(r.class_id for r in out.collect()) == sorted([i // 2 * 2 for i in range(40)])
