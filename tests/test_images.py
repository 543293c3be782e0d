"""Image kernels on drawn images: what is taken out, what is refused, and what stays as it came."""

import zlib

import numpy as np
import pytest
from docweave.functions import images
from docweave.operators import images as ops
from docweave.operators import ledgers


def drawn(logo=True, bars=False, ground=245):
    """A page image with an orange icon and grey lettering near the lower right corner."""
    x = np.full((300, 400, 3), ground, np.uint8)
    if logo:
        y, z = np.mgrid[:300, :400]
        x[(y - 262) ** 2 + (z - 300) ** 2 <= 100] = (240, 120, 20)
        for k in range(4):
            x[256:268, 316 + 9 * k : 321 + 9 * k] = (90, 90, 90)
    if bars:
        for k in range(12):
            x[225:245, 280 + 7 * k : 284 + 7 * k] = (0, 0, 0)
    return x


def test_png():
    r = np.random.default_rng(1)
    rgb, alpha = r.integers(0, 256, (7, 5, 3)).astype(np.uint8), r.integers(0, 256, (7, 5)).astype(np.uint8)
    for a in (None, alpha):
        back, clear = images.decode_png(images.encode_png(rgb, a))
        assert (back == rgb).all() and (clear is None if a is None else (clear == a).all())
    for bad in (b"", b"GIF89a", images.encode_png(rgb)[:-20], images.encode_png(rgb).replace(b"IDAT", b"IDAX")):
        with pytest.raises(images.Unreadable):
            images.decode_png(bad)


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    """Every line filter, applied by its definition, comes back."""
    r = np.random.default_rng(kind)
    x = r.integers(0, 256, (4, 6, 3)).astype(int)
    raw = b""
    for y in range(4):
        line = [kind]
        for i in range(18):
            a = x[y].ravel()[i - 3] if i >= 3 else 0
            b = x[y - 1].ravel()[i] if y else 0
            c = x[y - 1].ravel()[i - 3] if y and i >= 3 else 0
            p = a + b - c
            paeth = min((a, b, c), key=lambda v: (abs(p - v), (a, b, c).index(v)))
            line.append(int(x[y].ravel()[i] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        raw += bytes(line)
    assert (images._unfiltered(raw, 4, 18, 3).reshape(4, 6, 3) == x).all() and zlib.compress(raw)


def test_blobs():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 1]], bool)
    assert sorted(images.blobs(m)) == [((0, 0, 2, 2), 2), ((0, 3, 2, 4), 2), ((3, 0, 4, 2), 2), ((3, 3, 4, 4), 1)]
    u = np.array([[1, 0, 1], [1, 1, 1]], bool)
    assert images.blobs(u) == [((0, 0, 3, 2), 5)]


def test_logo_removed():
    x = drawn()
    new, box, mask, why = images.without_logo(x)
    assert why == "" and box[0] <= 291 and box[2] >= 340 and images.checked(x, new, box, mask) == (True, "ok")
    assert np.abs(new.astype(int) - 245).max() < 40 and (new[~mask] == x[~mask]).all()
    assert images.without_logo(drawn(False))[3] == "no_watermark" and images.without_logo(x[:4])[3] == "too_small" and images.without_logo(x[:, :, 0])[3] == "not_rgb"
    frame = drawn(False)
    frame[200:, 250:] = (240, 120, 20)  # a filled area that runs to the corner is no logo
    assert images.without_logo(frame)[0] is None


def test_logo_in_other_corners():
    for turn in (np.fliplr, np.flipud):
        x = np.ascontiguousarray(turn(drawn()))
        icon = turn(np.pad(np.ones((1, 1)), ((262, 37), (300, 99))))
        y0, x0 = (int(v[0]) for v in np.nonzero(icon))
        new, box, _, _ = images.without_logo(x)
        assert box[0] <= x0 <= box[2] and box[1] <= y0 <= box[3] and abs(int(new[y0, x0, 2]) - 245) < 40


def test_checks():
    x = drawn(bars=True)
    new, box, mask, _ = images.without_logo(x)
    assert images.checked(x, new, box, mask) == (False, "watermark_overlaps_content")
    x = drawn()
    new, box, mask, _ = images.without_logo(x)
    moved = new.copy()
    moved[0, 0] = 0
    assert images.checked(x, moved, box, mask) == (False, "pixels_changed_outside_bbox")
    assert images.checked(x, x, box, mask) == (False, "dewatermark_residual")
    assert images.checked(x, x[1:], box, mask) == (False, "shape_mismatch")


def test_narrowed():
    x = np.arange(8, dtype=np.uint8).reshape(1, 8, 1).repeat(4, 0)
    assert images.narrowed(x, 4)[:, :, 0].tolist() == [[0, 2, 4, 6]] * 2 and images.narrowed(x, 9) is x
    assert abs(float(images.narrowed(drawn(), 130).mean()) - drawn().mean()) < 1


def test_processed(spark):
    logo, plain = images.encode_png(drawn()), images.encode_png(drawn(False))
    alpha = images.encode_png(drawn(), np.full((300, 400), 7, np.uint8))
    rows = [(1, "a", "image/png", logo), (2, "b", "image/png", plain), (3, "c", "image/svg+xml", b"<svg/>"), (4, "d", "image/png", b"broken"), (5, "e", "image/png", images.encode_png(drawn(bars=True))), (6, "f", "image/png", alpha), (7, "g", None, None), (8, "h", "image/jpeg", b"\xff\xd8")]
    done = ops.processed_images(spark.createDataFrame(rows, "page_id bigint, source_id string, mime string, data binary"), 200)
    got = {r["source_id"]: r for r in done.collect()}
    assert got["a"]["dewatermarked"] and got["a"]["width"] == 200 and got["a"]["height"] == 150 and got["a"]["validation_reason"] == "ok"
    assert not got["b"]["dewatermarked"] and got["b"]["validation_reason"] == "no_watermark" and got["b"]["width"] == 200
    assert bytes(got["c"]["data"]) == b"<svg/>" and got["c"]["format_note"] == "passthrough"
    for k, r in (("d", b"broken"), ("e", rows[4][3]), ("h", b"\xff\xd8")):
        assert bytes(got[k]["data"]) == r and got[k]["fallback_to_original"]
    assert got["e"]["validation_reason"] == "watermark_overlaps_content" and not got["e"]["validation_passed"]
    assert (images.decode_png(bytes(got["f"]["data"]))[1] == 7).all() and got["f"]["dewatermarked"]
    ledger = ops.image_ledger(done)
    assert ledgers.image_ledger_errors(ledger, done.select("source_id")).count() == 0
    assert {r["source_id"]: r["reason"] for r in ledger.collect()}["a"] == "corner logo removed"


def test_wide_image_kept_whole():
    out = images.processed(images.encode_png(drawn(False)), "image/png")
    assert out["width"] == 400 and out["data"] == images.encode_png(drawn(False)) and not out["fallback_to_original"]
