"""Images inside packages: corner logos taken out, checked, and made smaller; whatever fails leaves the bytes as they came.

Arrays and PNG are done here with numpy and zlib.  JPEG and WebP need Pillow: where it isn't installed, such images pass unchanged,
and PNG stays PNG.
"""

from __future__ import annotations

import importlib.util
import io
import struct
import zlib

import numpy as np

PASSED = ("image/svg+xml", "image/gif")
MAX_WIDTH, QUALITY = 1600, 82
#: Share of an image's width and height in which a corner logo may lie.
CORNER_W, CORNER_H = 0.42, 0.32
#: A logo's icon is saturated and not dark, of some share of the corner, filled, and about as wide as high.
SATURATED, BRIGHT = 90, 90
ICON_LEAST, ICON_MOST, FILLED, NARROW, WIDE = 0.0004, 0.06, 0.5, 0.55, 1.7
#: Its lettering is dark and grey.
DARK, GREY = 175, 130
EDGE = 0.02
GROWN = 2
#: Limits of the check: contrast that is content, its share around the logo, the ring in logo heights, edges that may stay.
CONTRAST, OVERLAP, RING, RESIDUE = 130, 0.05, 1.5, 0.5

Box = tuple[int, int, int, int]


class Unreadable(ValueError):
    """Not an image that can be decoded here."""


# -- PNG

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        at = y * (stride + 1)
        kind, line = raw[at], np.frombuffer(raw, np.uint8, stride, at + 1)
        if kind == 0:
            row = line.copy()
        elif kind == 1:  # what is left of it: a running sum by channel
            row = np.cumsum(np.pad(line, (0, -stride % step)).reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).ravel()[:stride]
        elif kind == 2:
            row = line + above
        elif kind in (3, 4):
            new, up, own = bytearray(stride), above.tobytes(), line.tobytes()
            for i in range(stride):
                a = new[i - step] if i >= step else 0
                b = up[i]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = up[i - step] if i >= step else 0
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                new[i] = (own[i] + guess) & 255
            row = np.frombuffer(bytes(new), np.uint8)
        else:
            raise Unreadable(f"filter {kind}")
        out[y] = above = row
    return out


def decode_png(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """RGB and, where there is one, the alpha channel; 8 bits a channel, not interlaced."""
    if data[:8] != _SIGNATURE:
        raise Unreadable("not a PNG")
    at, packed, head, palette, clear = 8, b"", None, None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise Unreadable("damaged PNG")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise Unreadable("a kind of PNG that isn't read here")
    width, height, _, colour, *_ = head
    step = _CHANNELS[colour]
    try:
        raw = zlib.decompress(packed)
    except zlib.error as bad:
        raise Unreadable(str(bad)) from bad
    if not width or not height or len(raw) != height * (width * step + 1):
        raise Unreadable("size of the pixels")
    x = _unfiltered(raw, height, width * step, step).reshape(height, width, step)
    if colour == 3:
        if palette is None or x.max() >= len(palette):
            raise Unreadable("palette")
        alpha = None
        if clear is not None:
            table = np.full(len(palette), 255, np.uint8)
            table[: len(clear)] = clear[: len(palette)]
            alpha = table[x[:, :, 0]]
        return palette[x[:, :, 0]], alpha
    rgb = np.repeat(x[:, :, :1], 3, axis=2) if step < 3 else x[:, :, :3]
    return np.ascontiguousarray(rgb), x[:, :, -1].copy() if colour in (4, 6) else None


def encode_png(rgb: np.ndarray, alpha: np.ndarray | None = None) -> bytes:
    x = rgb if alpha is None else np.dstack([rgb, alpha])
    height, width, step = x.shape
    lines = x.reshape(height, -1)
    # Each line as the difference from the one above.
    filtered = np.vstack([lines[:1], lines[1:] - lines[:-1]])
    raw = np.hstack([np.full((height, 1), 2, np.uint8), filtered]).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if step == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 9)) + chunk(b"IEND", b"")


# -- shapes


def blobs(mask: np.ndarray) -> list[tuple[Box, int]]:
    """Box (left, top, right, bottom) and number of pixels of every part whose pixels touch, corners included."""
    root: list[int] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    runs: list[tuple[int, int, int, int]] = []
    before: list[tuple[int, int, int]] = []
    for y, line in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(np.int8), [0]])))
        now = []
        k = 0
        for a, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            name = len(root)
            root.append(name)
            while k < len(before) and before[k][1] < a:
                k += 1
            j = k
            while j < len(before) and before[j][0] <= e:
                p, q = find(before[j][2]), find(name)
                root[max(p, q)] = min(p, q)
                j += 1
            now.append((a, e, name))
            runs.append((y, a, e, name))
        before = now
    found: dict[int, list[int]] = {}
    for y, a, e, name in runs:
        b = found.setdefault(find(name), [a, y, e, y + 1, 0])
        b[0], b[2], b[3] = min(b[0], a), max(b[2], e), y + 1
        b[4] += e - a
    return [((b[0], b[1], b[2], b[3]), b[4]) for b in found.values()]


def _kernel(width: int, height: int, round_: bool) -> np.ndarray:
    if not round_:
        return np.ones((height, width), bool)
    y, x = np.mgrid[:height, :width]
    cy, cx = (height - 1) / 2, (width - 1) / 2
    return ((y - cy) / max(height / 2, 1e-9)) ** 2 + ((x - cx) / max(width / 2, 1e-9)) ** 2 <= 1


def _spread(mask: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    h, w = kernel.shape
    wide = np.pad(mask, ((h // 2, h - 1 - h // 2), (w // 2, w - 1 - w // 2)))
    out = np.zeros_like(mask)
    for y, x in zip(*np.nonzero(kernel[::-1, ::-1]), strict=True):
        out |= wide[y : y + mask.shape[0], x : x + mask.shape[1]]
    return out


def opened(mask: np.ndarray, size: int) -> np.ndarray:
    k = _kernel(size, size, True)
    return _spread(~_spread(~mask, k), k)


def closed(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    k = _kernel(width, height, False)
    return ~_spread(~_spread(mask, k), k)


# -- corner logos


def _tones(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Saturation and value, 0 to 255."""
    x = rgb.astype(np.int32)
    high, low = x.max(2), x.min(2)
    return np.where(high > 0, (high - low) * 255 // np.maximum(high, 1), 0), high


def _icon(coloured: np.ndarray) -> Box | None:
    """The lowest, then rightmost part that is shaped like an icon; where none is, thin lines are cut off first."""
    area = coloured.size
    for size in (3, max(5, round(coloured.shape[0] * 0.025) | 1)):
        fit = []
        for (a, t, e, b), n in blobs(opened(coloured, size)):
            w, h = e - a, b - t
            if area * ICON_LEAST <= n <= area * ICON_MOST and n / (w * h) >= FILLED and NARROW <= w / h <= WIDE:
                fit.append((b, e, a, t))
        if fit:
            b, e, a, t = max(fit)
            return a, t, e, b
    return None


def _tail(coloured: np.ndarray, box: Box) -> int:
    """Bottom of the icon with what is coloured right below it, to half its height at most."""
    a, t, e, b = box
    least, end, gap = max(2, (e - a) // 20), b, 0
    for y in range(b, min(coloured.shape[0], b + max(4, (b - t) // 2))):
        if coloured[y, a:e].sum() >= least:
            end, gap = y + 1, 0
        else:
            gap += 1
            if gap == 2:
                break
    return end


def logo_in(corner: np.ndarray) -> tuple[Box, np.ndarray] | None:
    """Box of a corner's logo, and its pixels in the box."""
    sat, val = _tones(corner)
    coloured, ink = (sat > SATURATED) & (val > BRIGHT), (val < DARK) & (sat < GREY)
    icon = _icon(coloured)
    if icon is None:
        return None
    a, t, e, _ = icon
    b = _tail(coloured, icon)
    high = b - t
    parts = []
    for (x0, y0, x1, y1), _ in blobs(closed(ink, max(3, high // 3), max(3, high // 6))):
        w, h = x1 - x0, y1 - y0
        beside = t - high * 0.4 <= y0 + h / 2 <= b + high * 0.4 and x0 >= e - high * 0.3
        if beside and high * 0.25 <= h <= high * 1.8 and not (w > high * 8 and h < high * 0.4):
            parts.append((x0, y0, x1, y1))
    left, top, right, bottom = a, t, e, b
    for x0, y0, x1, y1 in sorted(parts):
        if x0 - right > high * 1.2:
            break
        left, top, right, bottom = min(left, x0), min(top, y0), max(right, x1), max(bottom, y1)
    return (left, top, right, bottom), (coloured | ink)[top:bottom, left:right]


def painted(rgb: np.ndarray, mask: np.ndarray, radius: int = 3) -> np.ndarray:
    """Pixels of the mask filled layer by layer from what is around them, nearer ones counting more."""
    out, known = rgb.astype(np.float64), ~mask
    steps = [(y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if 0 < y * y + x * x <= radius * radius]
    height, width = mask.shape
    while not known.all() and known.any():
        ys, xs = np.nonzero(~known & _spread(known, np.ones((3, 3), bool)))
        total, weight = np.zeros((len(ys), 3)), np.zeros(len(ys))
        for dy, dx in steps:
            y, x = ys + dy, xs + dx
            ok = (y >= 0) & (y < height) & (x >= 0) & (x < width)
            ok[ok] = known[y[ok], x[ok]]
            w = 1.0 / (dy * dy + dx * dx)
            total[ok] += w * out[y[ok], x[ok]]
            weight[ok] += w
        out[ys, xs] = total / weight[:, None]
        known[ys, xs] = True
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def without_logo(rgb: np.ndarray) -> tuple[np.ndarray | None, Box | None, np.ndarray | None, str]:
    """The image without its corner logo, the logo's box and the pixels that were touched; or None with the reason."""
    if rgb.ndim != 3 or rgb.shape[2] != 3:
        return None, None, None, "not_rgb"
    height, width = rgb.shape[:2]
    if min(height, width) < 8:
        return None, None, None, "too_small"
    w, h = max(1, round(width * CORNER_W)), max(1, round(height * CORNER_H))
    for x0, y0 in ((width - w, height - h), (0, height - h), (width - w, 0), (0, 0)):
        found = logo_in(rgb[y0 : y0 + h, x0 : x0 + w])
        if found is None:
            continue
        (a, t, e, b), own = found
        near_x, near_y = max(1, round(w * EDGE)), max(1, round(h * EDGE))
        at_x = e >= w - near_x if x0 + w >= width else a <= near_x
        at_y = b >= h - near_y if y0 + h >= height else t <= near_y
        if at_x and at_y:  # in the very corner: content that runs to the edge
            continue
        box = (x0 + a, y0 + t, x0 + e, y0 + b)
        mask = np.zeros((height, width), bool)
        mask[box[1] : box[3], box[0] : box[2]] = own
        for _ in range(GROWN):
            mask = _spread(mask, np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]], bool))
        return painted(rgb, mask, max(2, round((b - t) / 12))), box, mask, ""
    return None, None, None, "no_watermark"


def _edges(part: np.ndarray, mask: np.ndarray) -> float:
    grey = part.astype(np.float64).mean(2)
    steep = np.zeros_like(grey)
    steep[1:] += np.abs(np.diff(grey, axis=0))
    steep[:, 1:] += np.abs(np.diff(grey, axis=1))
    return float(steep[mask].mean()) if mask.any() else 0.0


def checked(before: np.ndarray, after: np.ndarray, box: Box, mask: np.ndarray | None = None) -> tuple[bool, str]:
    """Nothing changed outside the mask, no content around the logo, and no edges left where it was."""
    if before.shape != after.shape:
        return False, "shape_mismatch"
    a, t, e, b = box
    height, width = before.shape[:2]
    if mask is None:
        touched = np.zeros((height, width), bool)
        touched[t:b, a:e] = True
    else:
        touched = mask
    if not np.array_equal(before[~touched], after[~touched]):
        return False, "pixels_changed_outside_bbox"
    pad = max(1, round((b - t) * RING))
    y0, y1, x0, x1 = max(0, t - pad), min(height, b + pad), max(0, a - pad), min(width, e + pad)
    if y0 >= y1 or x0 >= x1:
        return False, "empty_bbox"
    ring = np.zeros((height, width), bool)
    ring[max(0, t - 3) : b + 3, max(0, a - 3) : e + 3] = True
    ring[t:b, a:e] = False
    ground = np.median(before[ring], axis=0).astype(int) if ring.any() else np.array([255, 255, 255])
    strong = np.abs(before[y0:y1, x0:x1].astype(int) - ground).max(2) > CONTRAST
    if mask is not None:
        strong &= ~mask[y0:y1, x0:x1]
    if strong.mean() > OVERLAP:
        return False, "watermark_overlaps_content"
    if mask is not None and (own := mask[t:b, a:e]).any():
        had = _edges(before[t:b, a:e], own)
        if had > 0 and _edges(after[t:b, a:e], own) > had * RESIDUE:
            return False, "dewatermark_residual"
    return True, "ok"


# -- size


def narrowed(x: np.ndarray, width: int) -> np.ndarray:
    """No wider than so many pixels, by means over areas; never wider than it was."""
    if x.shape[1] <= width:
        return x
    height = max(1, round(x.shape[0] * width / x.shape[1]))

    def means(v: np.ndarray, n: int) -> np.ndarray:
        edge = np.linspace(0, len(v), n + 1)
        sums = np.concatenate([np.zeros((1, *v.shape[1:])), np.cumsum(v.astype(np.float64), axis=0)])
        lo = np.minimum(edge.astype(int), len(v) - 1)
        at = sums[lo] + v[lo] * (edge - lo).reshape(-1, *[1] * (v.ndim - 1))
        return np.diff(at, axis=0) / (len(v) / n)

    y = means(means(x, height).swapaxes(0, 1), width).swapaxes(0, 1)
    return np.clip(np.rint(y), 0, 255).astype(np.uint8)


def has_pillow() -> bool:
    return importlib.util.find_spec("PIL") is not None


def _decoded(data: bytes, mime: str) -> tuple[np.ndarray, np.ndarray | None]:
    if mime == "image/png":
        return decode_png(data)
    if not has_pillow():
        raise Unreadable("no decoder is installed")
    from PIL import Image

    try:
        with Image.open(io.BytesIO(data)) as im:
            im.load()
            alpha = np.asarray(im.convert("RGBA").getchannel("A")) if im.mode in ("RGBA", "LA") or "transparency" in im.info else None
            return np.asarray(im.convert("RGB")), alpha
    except OSError as bad:
        raise Unreadable(str(bad)) from bad


def _encoded(rgb: np.ndarray, alpha: np.ndarray | None, mime: str, changed: bool, data: bytes) -> tuple[bytes, str, bool, str]:
    """Bytes, type, whether they are smaller on purpose, and why the format stayed."""
    if not has_pillow():
        return (encode_png(rgb, alpha), mime, True, "webp_unavailable") if changed else (data, mime, False, "webp_unavailable")
    from PIL import Image

    im = Image.fromarray(rgb if alpha is None else np.dstack([rgb, alpha]))
    web, own = io.BytesIO(), io.BytesIO()
    im.save(web, format="WEBP", quality=QUALITY, method=6)
    kind = {"image/png": "PNG", "image/jpeg": "JPEG"}.get(mime)
    if kind and not (kind == "JPEG" and alpha is not None):
        im.save(own, format=kind, **({"quality": QUALITY} if kind == "JPEG" else {}))
        if len(web.getvalue()) >= len(own.getvalue()):
            return own.getvalue(), mime, changed, "webp_larger_kept_original"
    return web.getvalue(), "image/webp", True, ""


def processed(data: bytes, mime: str, max_width: int = MAX_WIDTH) -> dict:
    """data and mime as they go into the package, with what was done; on any failure the bytes as they came.  Never raises."""
    out = {"data": data, "mime": mime, "width": 0, "height": 0, "dewatermarked": False, "bbox": None, "validation_passed": True, "validation_reason": "", "compressed": False, "orig_bytes": len(data), "final_bytes": len(data), "format_note": "", "fallback_to_original": False}
    kind = (mime or "").lower()
    if kind in PASSED:
        return out | {"format_note": "passthrough"}
    try:
        rgb, alpha = _decoded(data, kind)
        out |= {"width": rgb.shape[1], "height": rgb.shape[0]}
        new, box, mask, why = without_logo(rgb)
        if new is not None:
            good, why = checked(rgb, new, box, mask)
            out |= {"validation_passed": good, "validation_reason": why}
            if not good:
                return out | {"bbox": list(box), "fallback_to_original": True, "format_note": "dewatermark refused"}
            out |= {"dewatermarked": True, "bbox": list(box)}
            rgb = new
        else:
            out["validation_reason"] = why
        small = narrowed(rgb if alpha is None else np.dstack([rgb, alpha]), max_width)
        changed = new is not None or small.shape[1] != out["width"]
        body, kind, less, note = _encoded(np.ascontiguousarray(small[:, :, :3]), small[:, :, 3].copy() if alpha is not None else None, kind, changed, data)
        return out | {"data": body, "mime": kind, "compressed": less, "final_bytes": len(body), "format_note": note, "width": small.shape[1], "height": small.shape[0]}
    except (Unreadable, ValueError, MemoryError, IndexError) as bad:
        return out | {"fallback_to_original": True, "format_note": f"{type(bad).__name__}: {bad}"}
