"""Helpers of several operators."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from voxloom.llm import langid, neardup, packing
from voxloom.llm.common import BATCH_SETTING

HELD = """
import re
from voxloom.llm.common import freed
kept = []
def resident():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
def task(batches):
    blocks = [bytes(50_000) for _ in range(6_000)]  # 300 MB
    kept.append(bytes(50_000))  # lies above them and stays
    yield from batches
before = resident()
assert list(freed(task)([1, 2])) == [1, 2]
print(resident() - before)
"""


def test_a_task_gives_its_memory_back():
    out = subprocess.run([sys.executable, "-c", HELD], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True).stdout
    assert float(out) < 60  # the blocks are about 300 without the release


@pytest.mark.parametrize("use", [packing.token_pieces, neardup.near_duplicates, lambda docs: langid.predict(docs, langid.Learned([]))], ids=["packing", "neardup", "langid"])
def test_batches_of_texts_are_small_unless_set(spark, use):
    docs = spark.range(0, 2000, 1, 1).selectExpr("id as doc_id", "repeat(concat(id, ' word '), 600) as text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "n"])

    def seen():
        use(docs)
        return docs.mapInArrow(sizes, "size long, n long").collect()

    try:
        got = seen()
        assert sum(r.n for r in got) == 2000 and max(r.size for r in got) < 4_500_000  # 9 MB in all
        spark.conf.set(BATCH_SETTING, "32m")
        assert len(seen()) == 1
    finally:
        spark.conf.unset(BATCH_SETTING)
