"""Media: round trips, decoders on small files, area means against a plain version."""

import hashlib
import io
import zlib

import numpy as np
import pytest

from barquet.llm import media as M


def test_netpbm():
    assert M.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 1, 0], [1, 0, 1]]
    assert M.decode(b"P4 3 2\n\xa0\x40").tolist() == [[0, 1, 0], [1, 0, 1]]
    assert M.decode(b"P2 2 2 255 1 2 3 4").tolist() == [[1, 2], [3, 4]]
    assert M.decode(b"P3 1 1 255 9 8 7").tolist() == [[[9, 8, 7]]]
    assert M.decode(b"P5 2 1 255\n\x00\xff").tolist() == [[0, 255]]
    assert M.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    assert M.decode(b"P6 1 2 255\nabcdef").tolist() == [[[97, 98, 99]], [[100, 101, 102]]]


@pytest.mark.parametrize("file", [b"", b"P5", b"P5 2 2 255\n1", b"P5 0 2 255\n", b"P2 x", b"BM", b"GIF89a", b"P5 2 2 99999\n1234", b"P5 1 1 9\n\x0a", b"P2 1 1 255 99999999999999999999999", b"P3 1 1 255 1 -2 3", b"P5 99999999999 99999999999 255\n1", b"P4 9999999999999 9 \n1"])
def test_bad_files(file):
    with pytest.raises(ValueError):
        M.decode(file)


def test_bmp_from_bottom_to_top():
    head = b"BM" + (54 + 16).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (2).to_bytes(4, "little") + b"\x01\x00\x18\x00" + bytes(24)
    rows = bytes([1, 2, 3, 4, 5, 6, 0, 0]) + bytes([7, 8, 9, 10, 11, 12, 0, 0])
    assert M.decode(head + info + rows).tolist() == [[[9, 8, 7], [12, 11, 10]], [[3, 2, 1], [6, 5, 4]]]


@pytest.mark.parametrize("n", [1, 2, 3, 8, 25])
def test_round_trip(n):
    payload = np.random.default_rng(n).integers(0, 256, 576 * n, dtype=np.uint8).tobytes()
    assert M.decode(M.encode(payload)).tobytes() == payload


@pytest.mark.parametrize("shape", [(24, 24), (50, 24), (7, 5), (1, 1), (9, 8, 3)])
def test_area_means(shape):
    image = np.random.default_rng(0).integers(0, 256, shape).astype(float)
    h, w = 8, 9
    big = np.repeat(np.repeat(image, h, 0), w, 1)
    want = big.reshape(h, shape[0], w, shape[1], *shape[2:]).mean((1, 3))
    assert np.allclose(M.resize(image, h, w), want)


def test_tables(spark):
    texts = [None, "", "abc", "é" * 5000, "x" * 576, "x" * 575, "abc"]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id int, text string, feature string")
    out = M.features(M.store(df)).collect()
    assert len(out) == len(texts)
    for r in out:
        body = (texts[r.doc_id] or "").encode()
        payload = body.ljust(max(1, -(-len(body) // 576)) * 576, b"\xff")
        assert (r.n_bytes, r.payload_bytes) == (len(body), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        file = M.encode(payload)
        assert r.media_bytes == len(file) and r.media_sha256 == hashlib.sha256(file).hexdigest() and len(r.feature) == 16
        image = np.frombuffer(payload, np.uint8).reshape(-1, 24).astype(float)
        means = lambda x, h, w: np.repeat(np.repeat(x, h, 0), w, 1).reshape(h, len(x), w, -1).mean((1, 3))
        tile = np.load(io.BytesIO(r.tile))
        assert tile.shape == (16, 16) and np.allclose(tile, means(image, 16, 16))
        small = np.rint(means(tile.astype(float), 8, 9) * 256)
        assert r.feature == np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()
    assert out[2][2:] == out[6][2:]
    assert M.features(M.store(df.limit(0))).count() == 0


def test_files_that_are_none(spark):
    df = spark.createDataFrame([(1, None), (2, b"junk"), (3, b"P5 1 1 255\n\x07")], "id int, media binary")
    got = {r.id: r for r in M.features(df).collect()}
    assert got[1].media_bytes is None and got[2].media_bytes == 4 and got[2].feature is None and got[3].payload_bytes == 1


def bmp(height, bits, colours, samples, size=40):
    palette = bytes(4 * colours)
    head = b"BM" + bytes(8) + (54 + len(palette)).to_bytes(4, "little")
    info = size.to_bytes(4, "little") + (4).to_bytes(4, "little") + height.to_bytes(4, "little", signed=True) + b"\x01\x00" + bits.to_bytes(2, "little") + bytes(16) + colours.to_bytes(4, "little") + bytes(4)
    return head + info + palette + samples


def test_malformed_files_give_nulls(spark):
    rng = np.random.default_rng(7)
    files = [bmp(1, 8, 2, b"\x00\x01\x02\x03"), bmp(-(2**31), 8, 2, b"\x00" * 4), bmp(1, 32, 2, b"\x00" * 3), bmp(1, 8, 200, b"\x00" * 4, size=2**31 - 1)]
    good = [bmp(1, 8, 4, b"\x00\x01\x02\x03"), M.encode(bytes(range(256)) * 9)]
    junk = [b"BM" + rng.bytes(int(n)) for n in rng.integers(0, 200, 150)] + [b"P%d " % (k % 6 + 1) + rng.bytes(int(n)) for k, n in enumerate(rng.integers(0, 60, 300))]
    for file in good:  # one byte after the other is another one
        junk += [file[:i] + bytes([int(rng.integers(256))]) + file[i + 1 :] for i in range(min(len(file), 80))]
    rows = [(i, f) for i, f in enumerate(files + good + junk)]
    got = {r.id: r for r in M.features(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert len(got) == len(rows) and all(got[i].media_bytes == len(f) for i, f in rows)
    assert [got[i].payload_bytes for i in range(6)] == [None] * 4 + [4, 2304]
