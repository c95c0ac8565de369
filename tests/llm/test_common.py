import pyarrow as pa

from trackloom.llm.common import recut


def test_slices_are_bounded_and_whole():
    b = pa.record_batch([pa.array(range(1000)), pa.array(["x" * (i % 7 * 1000) for i in range(1000)])], ["i", "t"])
    parts = list(recut([b, b.slice(0, 0), b.slice(3, 1)], 100, 50_000))
    assert all(0 < p.num_rows <= 100 and (p.num_rows == 1 or p.nbytes <= 50_000) for p in parts)
    assert [x for p in parts for x in p.column(0).to_pylist()] == [*range(1000), 3]
    assert [p.num_rows for p in recut([b.slice(0, 2)], 100, 1)] == [1, 1]
