"""The driver gives freed native memory back between the queries of a job."""

import re
import sys
from pathlib import Path

import pytest

from loomgraph import runtime


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_freed_memory_of_the_driver_goes_back(spark, monkeypatch):
    monkeypatch.setattr(runtime, "TRIM_EVERY", 0, raising=False)
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    held = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", status.read_text())[1]) / 1024

    runtime.materialize(spark.range(10))  # what a first query loads and compiles isn't counted
    memory, size = jvm.org.apache.spark.unsafe.Platform, 100_000
    before = held()
    blocks = [memory.allocateMemory(size) for _ in range(2_000)]
    for block in blocks[1:]:
        memory.copyMemory(None, blocks[0], None, block, size)  # touches it
    assert held() - before > 150
    pins = blocks[::100]
    for block in set(blocks) - set(pins):  # a block in use here and there keeps the allocator from returning the rest by itself
        memory.freeMemory(block)
    kept = held()
    assert kept - before > 100
    assert runtime.materialize(spark.range(10)).count() == 10
    after = held()
    for block in pins:
        memory.freeMemory(block)
    assert kept - after > 100
