import hashlib
import zlib

import numpy as np
from helpers import rows_of

from braidwork.llm import media


def test_round_trip_of_every_kind_of_sample():
    rng = np.random.default_rng(0)
    for payload in (rng.integers(0, 256, 192 * 5, dtype=np.uint8), np.zeros(192, np.uint8), np.full(192 * 2, 255, np.uint8), np.tile([0, 255], 96).astype(np.uint8)):
        step, frames = media.read_avi(media.write_avi(payload))
        assert step == media.MICROSECONDS
        assert media.decode_clip(frames).tobytes() == payload.tobytes()


def test_shots_stand_where_the_picture_changes():
    dark, bright = np.full((20, 12, 16), 20, np.uint8), np.full((15, 12, 16), 200, np.uint8)
    assert media.shots(np.concatenate([dark, bright])) == [(0, 20), (20, 35)]
    assert media.shots(dark[:1]) == [(0, 1)] and media.shots(dark) == [(0, 20)]


def test_query_form_and_edges(frame, odd_texts):
    rows = rows_of(odd_texts) + rows_of(odd_texts)[:2]
    got = media.media_digests(frame(rows)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        raw = (odd_texts[r.doc_id] or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert by_text.setdefault(raw, tuple(r)[1:]) == tuple(r)[1:]
    assert media.media_digests(frame([])).collect() == []


def test_clip_rows(spark, frame):
    files = media.texts_to_avi(frame(rows_of(["a" * 192 * 12 + "~" * 192 * 12, ""])))
    got = media.clip_rows(files.unionByName(spark.createDataFrame([(7, None), (8, bytearray(b"no film"))], files.schema))).collect()
    assert [(r.doc_id, r.clip, r.first_frame, r.n_frames, r.start_ms, r.end_ms) for r in sorted(got)] == [(0, 0, 0, 12, 0, 480), (0, 1, 12, 12, 480, 960), (1, 0, 0, 1, 0, 40)]


def test_films_of_other_frames_give_a_null(spark, frame):
    film = bytes(media.texts_to_avi(frame(rows_of(["a" * 192 * 3]))).collect()[0].media)
    assert film.count(b"\xff\xc3") == 3
    df = spark.createDataFrame([(1, bytearray(film)), (2, bytearray(film.replace(b"\xff\xc3", b"\xff\xc0")))], "doc_id long, media binary")
    got = sorted(media.clip_rows(df).collect())  # the second film's frames are baseline ones without quantisation
    assert [(r.doc_id, r.clip, r.first_frame, r.n_frames, r.start_ms, r.end_ms, r.mean_sample) for r in got] == [(1, 0, 0, 3, 0, 120, 97.0), (2, None, 0, 3, 0, 120, None)]


def test_long_payloads_are_coded_in_runs(monkeypatch):
    monkeypatch.setattr(media, "RUN", 3)
    payload = np.random.default_rng(5).integers(0, 256, 192 * 10, dtype=np.uint8)
    assert media.decode_clip(media.read_avi(media.write_avi(payload))[1]).tobytes() == payload.tobytes()
