import collections
import random

import pytest

from terraloom.operators.graph import components
from terraloom.operators.scratch import Scratch, scratch_root


def test_components_against_search(spark):
    rnd = random.Random(8)
    chain = list(range(300))
    rnd.shuffle(chain)
    pairs = [(a, b) for a, b in zip(chain[:150], chain[1:150])] + [(chain[200], x) for x in chain[201:260]] + [(400, 401), (401, 402), (402, 400), (5, 5)]
    e = spark.createDataFrame(pairs, "a long, b long")
    got = {r.x: r.p for r in components(e, Scratch(spark, "test")).collect()}
    ahead = collections.defaultdict(set)
    for a, b in pairs:
        if a != b:
            ahead[a].add(b), ahead[b].add(a)
    assert set(got) == set(ahead)
    for v in ahead:
        seen, todo = {v}, [v]
        while todo:
            for w in ahead[todo.pop()] - seen:
                seen.add(w), todo.append(w)
        assert got[v] == min(seen)
    assert components(e.where("false"), Scratch(spark, "test")) is None


def test_scratch_leaves_settings_and_needs_a_shared_folder(spark):
    before = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    scratch = Scratch(spark, "test")
    held = scratch.write(spark.range(10).groupBy("id").count(), "t")
    assert held.count() == 10
    scratch.drop_all_but()
    assert {r["key"]: r["value"] for r in spark.sql("SET").collect()} == before

    class Cluster:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(Cluster)
