"""Workers return what they have freed before the next task."""

import pyarrow as pa

from sitegraph.llm import common


def _resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_freed_memory_goes_back_before_the_first_slice():
    """Small blocks below one still in use stay with the process unless they are given back."""
    held = [bytes(2000) for _ in range(100_000)]
    del held[:-1]
    before = _resident()
    batch = pa.RecordBatch.from_arrays([pa.array(range(600))], ["n"])
    rows = [part.num_rows for part in common.slices([batch, batch])]
    assert rows == [256, 256, 88] * 2
    assert before - _resident() > 100_000_000 and len(held) == 1
