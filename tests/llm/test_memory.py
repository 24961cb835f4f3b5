"""What a Python worker keeps when a task is over."""

import subprocess
import sys

from tallyforge.llm import packing

CODE = """
import re
import pyarrow as pa
import pyarrow.compute as pc
from tallyforge.llm.shared import slices

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    for k in range(6):
        yield pa.RecordBatch.from_pydict({"text": [f"{k} {i} " + "ab " * 1000 for i in range(10000)]})

rows, upper = 0, None
for upper in slices(batches(), "text"):
    upper = pc.utf8_upper(upper.column(0))
    rows += len(upper)
del upper
print(rows, held())
"""


def test_slices_give_memory_back():
    rows, mb = subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True, check=True).stdout.split()
    assert int(rows) == 60000 and float(mb) < 110


def test_small_slices_pack_alike(spark):
    rows = [(i, f"some words {i} and more, of a text. " * (i * 37 % 90)) for i in range(300)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    plain = docs.coalesce(1).sortWithinPartitions("doc_id")
    assert packing.pack(plain, slice_bytes=500).collect() == packing.pack(plain).collect()
