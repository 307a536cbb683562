import numpy as np
import pyarrow as pa

from braidwork.llm import blocks, media


def test_a_batch_of_films_is_read_in_slices():
    film = media.write_avi(np.arange(192 * 500, dtype=np.uint32).astype(np.uint8))
    n = 3 * blocks.SLICE_BYTES // len(film)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([film] * (n - 1) + [None], pa.binary())], ["id", "media"])
    out = list(media._shot_rows(iter([batch])))
    assert len(out) >= 3 and [k for k in dict.fromkeys(x for o in out for x in o.column("id").to_pylist())] == list(range(n - 1))
