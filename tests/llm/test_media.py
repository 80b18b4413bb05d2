import hashlib
import io
import zlib

import numpy as np
import pytest

from tarnwerk.llm import media

from .helpers import SCHEMA, clashing, odd_rows


def image(h, w, depth=1, seed=1):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 256, (h, w) if depth == 1 else (h, w, 3)).astype(np.uint8)


@pytest.mark.parametrize("h, w", [(1, 1), (5, 7), (64, 3), (8, 64)])
def test_bmp_and_pgm_round_trip(h, w):
    grey, colour = image(h, w), image(h, w, 3)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(media.encode_bmp(grey)) == grey).all()
    assert (media.decode(media.encode_bmp(colour)) == colour).all()


def test_netpbm_text_comments_and_colour():
    assert media.decode(b"P2 # c\n# more\n3 1\n255\n1 2 3").tolist() == [[1, 2, 3]]
    assert media.decode(b"P6\n1 2\n255\n" + bytes(range(6))).tolist() == [[[0, 1, 2]], [[3, 4, 5]]]


@pytest.mark.parametrize("data", [None, b"", b"P5", b"P5\n4 4\n255\n123", b"BM", b"GIF89a", b"P5\n2 2\n65535\n12345678", b"P2 2 2 255 1 x", b"P2 1 1 255 300", b"P2 1 1 255 -1", b"P3 1 1 255 1 2 99999999999999999999999", b"P2 2 1 9 9 10", b"P5 2 1 9 \x09\x0a", b"P2 1 1 255 1_0", b"P5 " + b"9" * 5000 + b" 1 255 x"])
def test_broken_images_are_none(data):
    assert media.decode(data) is None


@pytest.mark.parametrize("h, w, th, tw", [(10, 10, 5, 5), (7, 11, 3, 4), (3, 2, 8, 9), (1, 1, 4, 4)])
def test_area_resize_equals_brute_force(h, w, th, tw):
    x = image(h, w, seed=h * w)
    fine = np.repeat(np.repeat(x.astype(float), th, 0), tw, 1)  # every target cell is whole in this grid
    want = fine.reshape(th, h, tw, w).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(x, th, tw), want)


def test_tiles_and_hashes(spark):
    ramp = np.tile(np.arange(90, dtype=np.uint8), (80, 1))
    rows = [(1, media.encode_pgm(ramp)), (2, media.encode_bmp(ramp)), (3, None), (4, b"junk"), (6, b"P2 1 1 255 300"), (7, b"P5 0 5 255 "), (5, media.encode_bmp(image(9, 9, 3)))]
    got = {r["id"]: r for r in media.tiles(spark.createDataFrame(rows, "id long, image binary"), "id", "image", 16, 16).collect()}
    assert got[1]["dhash"] == got[2]["dhash"] == "f" * 16 and got[1]["tile"] == got[2]["tile"]
    assert np.load(io.BytesIO(got[5]["tile"])).shape == (16, 16) and got[5]["channels"] == 3
    assert all(got[i]["tile"] is None and got[i]["dhash"] is None for i in (3, 4, 6, 7))


def means(x, height, width):
    """Area means cell by cell, by exact fractions."""
    from fractions import Fraction as Q

    h, w = x.shape
    share = lambda i, cells, n: {p: min(Q(p + 1), Q((i + 1) * n, cells)) - max(Q(p), Q(i * n, cells)) for p in range(i * n // cells, -(-(i + 1) * n // cells))}
    rows, cols = [share(i, height, h) for i in range(height)], [share(j, width, w) for j in range(width)]
    return [[sum(a * b * int(x[p, q]) for p, a in r.items() for q, b in c.items()) * height * width / Q(h * w) for c in cols] for r in rows]


def feature(pad):
    x = np.frombuffer(pad, np.uint8).reshape(-1, 64)
    if len(x) > 200:  # exact fractions of larger ones take long
        tile = np.clip(np.rint(media.area_resize(x, 64, 64)), 0, 255).astype(np.uint8)
        return f"{media.difference_hash(x)}-{zlib.crc32(media.npy(tile)):08x}"
    small = means(x, 8, 9)
    bits = "".join(str(int(round(float(r[j]), 6) < round(float(r[j + 1]), 6))) for r in small for j in range(8))
    tile = io.BytesIO()
    np.save(tile, np.array([[int(np.rint(float(v))) for v in r] for r in means(x, 64, 64)], np.uint8))
    return f"{int(bits, 2):016x}-{zlib.crc32(tile.getvalue()):08x}"


def test_texts_as_images_equal_brute_force(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(str(v) for v in r) for r in media.texts_as_images(clashing(df)).collect())
    want = []
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        pad = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        stored = media.encode_pgm(np.frombuffer(pad, np.uint8).reshape(-1, 64))
        want.append(tuple(str(v) for v in (doc_id, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(pad))))
    assert got == sorted(want)
    assert media.texts_as_images(df.limit(0)).count() == 0
