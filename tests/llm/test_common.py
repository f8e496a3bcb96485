"""Memory of the driver."""

import re
from pathlib import Path

import numpy as np

from topicwise.llm import common, toxicity

from .helpers import frame


def held():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_a_grown_heap_is_collected_between_stages(spark, monkeypatch):
    jvm = spark.sparkContext._jvm
    unused = lambda: jvm.java.lang.ref.WeakReference(jvm.java.lang.Object())
    monkeypatch.setattr(common, "TIDY_SECONDS", 0)
    monkeypatch.setattr(common, "HEAP_SHARE", 0.0)
    thing = unused()
    assert common.stage(spark.range(3), "three").count() == 3
    assert thing.get() is None
    collected = []
    monkeypatch.setattr(common.gc, "collect", lambda: collected.append(1))
    monkeypatch.setattr(common, "HEAP_SHARE", 1.1)  # never grows so far
    common.stage(spark.range(3), "three")
    monkeypatch.setattr(common, "HEAP_SHARE", 0.0)
    monkeypatch.setattr(common, "TIDY_SECONDS", 1000)  # has just been done
    common.stage(spark.range(3), "three")
    assert not collected


def test_memory_of_the_fit_is_given_back(spark, monkeypatch):
    small = [np.full(600, i % 7, "uint8") for i in range(200_000)]
    before = held()
    del small[:-1]
    common.give_back()
    assert held() < before - 60
    calls = []
    monkeypatch.setattr(toxicity, "give_back", lambda: calls.append(1))
    docs = frame(spark, [(1, "a bad word"), (2, "a good word")])
    toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int"))
    assert calls


def test_bitmap(spark):
    rows = [(h,) for h in (5, -1, 1 << 62, -(1 << 40) + 3)]
    bits = common.bitmap(spark.createDataFrame(rows, "h bigint"))
    assert common.among(bits, np.array([h for h, in rows], "int64").view("uint64")).all()
    assert not common.among(bits, np.array([4, 6, 1 << 25], "uint64")).any()
