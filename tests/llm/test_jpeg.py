"""Frames written by a plain baseline encoder are read back; damaged and other frames are refused."""

import numpy as np
import pytest

from braidwork.llm import jpeg, media


def seg(marker, body):
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def codes_of(table, ac):
    out, code, symbols = {}, 0, iter(jpeg.symbols_of(table, ac))
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out[next(symbols)] = format(code, f"0{length}b")
            code += 1
        code <<= 1
    return out


DC, AC = codes_of(jpeg.DC_LUMINANCE, False), codes_of(jpeg.AC_LUMINANCE, True)
CDC, CAC = codes_of(jpeg.DC_CHROMINANCE, False), codes_of(jpeg.AC_CHROMINANCE, True)


def number(v):
    n = abs(v).bit_length()
    return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""


def code_block(square, before, dc, ac, step):
    c = jpeg.COSINE @ (square.astype(float) - 128) @ jpeg.COSINE.T
    z = np.rint(c.ravel()[jpeg.ZIGZAG] / step).astype(int).tolist()
    n, extra = number(z[0] - before)
    out, run = dc[n] + extra, 0
    last = max((k for k in range(1, 64) if z[k]), default=0)
    for k in range(1, last + 1):
        if not z[k]:
            run += 1
            continue
        while run > 15:
            out, run = out + ac[0xF0], run - 16
        n, extra = number(z[k])
        out, run = out + ac[run << 4 | n] + extra, 0
    return out + (ac[0] if last < 63 else ""), z[0]


def packed(bits):
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b""


def encode(planes, sampling, restart=0, tables=True, step=1):
    """planes: full-size planes; sampling: (h, v) of each."""
    height, width = planes[0].shape
    wide, high = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    grids = []
    for p, (h, v) in zip(planes, sampling, strict=True):
        full = np.pad(p, ((0, down * 8 * high - height), (0, across * 8 * wide - width)), mode="edge")
        grids.append(full[:: high // v, :: wide // h])
    head = b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([step] * 64))
    if tables:
        for kind, t, ac in ((0x00, jpeg.DC_LUMINANCE, False), (0x10, jpeg.AC_LUMINANCE, True), (0x01, jpeg.DC_CHROMINANCE, False), (0x11, jpeg.AC_CHROMINANCE, True)):
            head += seg(0xC4, bytes([kind]) + bytes(t[0]) + bytes(jpeg.symbols_of(t, ac)))
    if restart:
        head += seg(0xDD, restart.to_bytes(2, "big"))
    n = len(planes)
    head += seg(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling)))
    head += seg(0xDA, bytes([n]) + b"".join(bytes([k + 1, 0x11 if k else 0]) for k in range(n)) + bytes([0, 63, 0]))
    body, bits, before, marks = b"", "", [0] * n, 0
    for m in range(across * down):
        if restart and m and m % restart == 0:
            body, bits, before, marks = body + packed(bits) + bytes([0xFF, 0xD0 + marks % 8]), "", [0] * n, marks + 1
        for k, (h, v) in enumerate(sampling):
            for b in range(h * v):
                y, x = (m // across * v + b // h) * 8, (m % across * h + b % h) * 8
                out, before[k] = code_block(grids[k][y : y + 8, x : x + 8], before[k], CDC if k else DC, CAC if k else AC, step)
                bits += out
    return head + body + packed(bits) + b"\xff\xd9"


def picture(height, width, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:height, :width]
    return np.clip(128 + 80 * np.sin(x / 5 + seed) + 40 * np.cos(y / 3) + rng.normal(0, 6, (height, width)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize(("height", "width", "restart", "tables"), [(8, 8, 0, True), (37, 51, 0, True), (24, 40, 2, True), (40, 24, 0, False)])
def test_grey_frames(height, width, restart, tables):
    p = picture(height, width)
    got = jpeg.decode(encode([p], [(1, 1)], restart, tables))
    assert got.shape == p.shape and np.abs(got.astype(int) - p).max() <= 2


@pytest.mark.parametrize("sampling", [[(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1), (1, 1), (1, 1)]])
def test_colour_frames_give_their_luminance(sampling):
    planes = [picture(45, 70, k) for k in range(3)]
    got = jpeg.decode(encode(planes, sampling, restart=3))
    assert np.abs(got.astype(int) - planes[0]).max() <= 2


def test_coarse_steps():
    p = picture(32, 32)
    assert np.abs(jpeg.decode(encode([p], [(1, 1)], step=12)).astype(int) - p).mean() < 6


def test_lossless_frames_of_the_writer():
    rng = np.random.default_rng(1)
    payload = rng.integers(0, 256, 192 * 3, dtype=np.uint8)
    frames = media.read_avi(media.write_avi(payload))[1]
    assert np.concatenate([jpeg.decode(f).ravel() for f in frames]).tobytes() == payload.tobytes()


def test_what_is_refused():
    good = encode([picture(16, 16)], [(1, 1)])
    for bad in (b"", b"\xff\xd8", b"text" * 9, good[:200], good[: len(good) // 2], good.replace(b"\xff\xc0", b"\xff\xc2"), good.replace(b"\xff\xdb", b"\xff\xe0"), good.replace(seg(0xC0, b"")[:2] + b"\x00\x0b\x08", b"\xff\xc0\x00\x0b\x0c")):
        with pytest.raises(jpeg.Unreadable):
            jpeg.decode(bad)


def film(frames, index=True, absolute=False):
    """A plain AVI file of given frames."""
    body, entries = b"movi", []
    for f in frames:
        entries.append((len(body), len(f)))
        body += b"00dc" + len(f).to_bytes(4, "little") + f + b"\0" * (len(f) % 2)
    head = media._chunk(b"LIST", b"hdrl" + media._chunk(b"avih", (20_000).to_bytes(4, "little") + b"\0" * 52))
    base = 12 + len(head) + 8 if absolute else 0
    idx = b"".join(b"00dc" + (0x10).to_bytes(4, "little") + (at + base).to_bytes(4, "little") + n.to_bytes(4, "little") for at, n in entries)
    return media._chunk(b"RIFF", b"AVI " + head + media._chunk(b"LIST", body) + (media._chunk(b"idx1", idx) if index else b""))


@pytest.mark.parametrize(("index", "absolute"), [(True, False), (True, True), (False, False)])
def test_clips_of_a_motion_jpeg_film(spark, index, absolute):
    dark, bright = (picture(24, 32, k) // 4 + b for k, b in ((1, 0), (2, 180)))
    frames = [encode([x], [(1, 1)], tables=False) for x in [dark] * 10 + [bright] * 6]
    good = film(frames, index, absolute)
    rows = [(1, bytearray(good)), (2, bytearray(film([frames[0], frames[1][:150]], index, absolute))), (3, None), (4, bytearray(b"no film")), (5, bytearray(film([], index))), (6, bytearray(good[: len(good) // 2])), (7, bytearray(film([frames[0], encode([picture(8, 8)], [(1, 1)])])))]
    got = sorted(media.clip_rows(spark.createDataFrame(rows, "doc_id long, media binary")).collect(), key=lambda r: (r.doc_id, r.first_frame))
    assert [(r.doc_id, r.clip, r.first_frame, r.n_frames, r.start_ms, r.end_ms) for r in got[:2]] == [(1, 0, 0, 10, 0, 200), (1, 1, 10, 6, 200, 320)]
    assert abs(got[0].mean_sample - dark.mean()) < 1 and abs(got[1].mean_sample - bright.mean()) < 1
    assert [(r.doc_id, r.clip, r.n_frames, r.mean_sample) for r in got[2:] if r.doc_id in (2, 7)] == [(2, None, 2, None), (7, None, 2, None)]
    assert {r.doc_id for r in got} <= {1, 2, 6, 7}
