"""What a Python worker keeps after its slices, which the stages of a pipeline share."""

import subprocess
import sys

from quarryline.llm import tokens
from quarryline.llm.tokens import PieceEncoder

SLICES = """
import psutil, pyarrow as pa, pyarrow.compute as pc
from quarryline.llm.batches import slices
rss = lambda: psutil.Process().memory_info().rss >> 20
texts = pa.array([f"{i:07d} " * 1000 for i in range(4000)], pa.string())
batch = pa.RecordBatch.from_arrays([texts], names=["text"])
before = rss()
for part in slices(iter([batch])):
    pc.split_pattern(pc.replace_substring(part.column("text"), "0", " 0"), " ").flatten().dictionary_encode()
print(rss() - before)
"""


def test_slices_leave_no_memory_in_the_pool():
    kept = int(subprocess.run([sys.executable, "-c", SLICES], capture_output=True, text=True, check=True).stdout)
    assert kept < 10, kept


SMALL_OBJECTS = """
import psutil, pyarrow as pa
from quarryline.llm.batches import slices
rss = lambda: psutil.Process().memory_info().rss >> 20
batch = pa.RecordBatch.from_arrays([pa.array(["a"])], names=["text"])
before = rss()
for _ in slices(iter([batch])):
    objects = [bytes(2000) for _ in range(60_000)]
    last = objects[-1]  # stands behind all others, so the heap cannot shrink from its end
    del objects
print(rss() - before)
"""


def test_slices_leave_no_memory_in_the_c_library():
    kept = int(subprocess.run([sys.executable, "-c", SMALL_OBJECTS], capture_output=True, text=True, check=True).stdout)
    assert kept < 30, kept


def test_encoders_can_be_forgotten():
    PieceEncoder._by_path["x"] = None
    tokens.forget()
    assert not PieceEncoder._by_path
