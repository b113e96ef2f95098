"""What an image's bytes say before any pixel is decoded: format, size, mode, frames, orientation, colour profile."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType

SCHEMA = StructType()
for _name, _type in (("format", StringType()), ("width", IntegerType()), ("height", IntegerType()), ("mode", StringType()), ("frames", IntegerType()), ("orientation", IntegerType()), ("icc", BooleanType()), ("error", StringType())):
    SCHEMA = SCHEMA.add(_name, _type)
SIGNATURES = ((b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"BM", "bmp"), (b"II*\0", "tiff"), (b"MM\0*", "tiff"), (b"RIFF", "webp"))

# Modes by PNG colour type, JPEG components and BMP depth.
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
BMP_MODES = {1: "1", 4: "P", 8: "P", 16: "RGB", 24: "RGB", 32: "RGB"}


def _png(b: bytes) -> dict:
    at, found = 8, {}
    while at + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, at)
        body = b[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            mode = {1: "1", 16: "I;16"}.get(depth, "L") if colour == 0 else PNG_MODES[colour]
            found |= {"width": width, "height": height, "mode": mode}
        elif kind == b"acTL":
            found["frames"] = struct.unpack_from(">I", body)[0]
        elif kind == b"iCCP":
            found["icc"] = True
        elif kind == b"eXIf":
            found["orientation"] = _directories(body)[0].get(274, 1)
        elif kind in (b"IDAT", b"IEND"):
            break
        at += 12 + size
    return found


def _jpeg(b: bytes) -> dict:
    at, found = 2, {}
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            raise ValueError("no marker")
        marker = b[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        size = struct.unpack_from(">H", b, at + 2)[0]
        body = b[at + 4 : at + 2 + size]
        if marker == 0xE1 and body.startswith(b"Exif\0\0"):
            found["orientation"] = _directories(body[6:])[0].get(274, 1)
        elif marker == 0xE2 and body.startswith(b"ICC_PROFILE\0"):
            found["icc"] = True
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width, parts = struct.unpack_from(">HHB", body, 1)
            return found | {"width": width, "height": height, "mode": JPEG_MODES[parts]}
        elif marker in (0xD9, 0xDA):
            break
        at += 2 + size
    return found


def _bmp(b: bytes) -> dict:
    width, height, _, depth = struct.unpack_from("<iiHH", b, 18)
    return {"width": width, "height": abs(height), "mode": BMP_MODES[depth]}


def _directories(b: bytes) -> list[dict[int, int]]:
    """Every directory of a TIFF structure, first values of its short and long fields by tag; one that points back ends the list."""
    order = "<" if b[:2] == b"II" else ">"
    at, seen, out = struct.unpack_from(order + "I", b, 4)[0], set(), []
    while at and at not in seen:
        seen.add(at)
        fields = {}
        (n,) = struct.unpack_from(order + "H", b, at)
        for entry in range(at + 2, at + 2 + 12 * n, 12):
            tag, kind, count = struct.unpack_from(order + "HHI", b, entry)
            if kind == 3 and count > 2:
                (place,) = struct.unpack_from(order + "I", b, entry + 8)
                (fields[tag],) = struct.unpack_from(order + "H", b, place)
            else:
                (fields[tag],) = struct.unpack_from(order + ("H" if kind == 3 else "I"), b, entry + 8)
        out.append(fields)
        (at,) = struct.unpack_from(order + "I", b, at + 2 + 12 * n)
    return out or [{}]


def _tiff(b: bytes) -> dict:
    pages = _directories(b)
    t = pages[0]
    bands, photometric = t.get(277, 1), t.get(262, 1)
    mode = {2: "RGBA" if bands == 4 else "RGB", 3: "P", 5: "CMYK"}.get(photometric, "1" if t.get(258, 1) == 1 else "L")
    return {"width": t[256], "height": t[257], "mode": mode, "frames": len(pages), "orientation": t.get(274, 1), "icc": 34675 in t}


def _webp(b: bytes) -> dict:
    if b[8:12] != b"WEBP":
        raise ValueError("another RIFF file")
    kind = b[12:16]
    if kind == b"VP8X":
        flags = b[20]
        width, height = (1 + int.from_bytes(b[i : i + 3], "little") for i in (24, 27))
        return {"width": width, "height": height, "mode": "RGBA" if flags & 0x10 else "RGB", "frames": 2 if flags & 0x02 else 1, "icc": bool(flags & 0x20)}
    if kind == b"VP8L":
        bits = int.from_bytes(b[21:25], "little")
        return {"width": 1 + (bits & 0x3FFF), "height": 1 + (bits >> 14 & 0x3FFF), "mode": "RGBA" if bits >> 28 & 1 else "RGB"}
    width, height = struct.unpack_from("<HH", b, 26)
    return {"width": width & 0x3FFF, "height": height & 0x3FFF, "mode": "RGB"}


PARSERS = {"png": _png, "jpeg": _jpeg, "bmp": _bmp, "tiff": _tiff, "webp": _webp}


def probed(b: bytes | None) -> dict:
    """The header of one image; width and height as they are after rotation by the EXIF orientation. Errors: not_an_image (null, empty, unknown or broken headers) and multi_frame."""
    empty = dict.fromkeys(("format", "width", "height", "mode", "frames", "orientation", "icc"))
    kind = next((k for s, k in SIGNATURES if b and b.startswith(s)), None)
    try:
        found = {"frames": 1, "orientation": 1, "icc": False} | PARSERS[kind](b)
        if found["width"] < 1 or found["height"] < 1:
            raise ValueError("no pixels")
    except (KeyError, IndexError, ValueError, struct.error):
        return empty | {"error": "not_an_image"}
    if 5 <= found["orientation"] <= 8:
        found["width"], found["height"] = found["height"], found["width"]
    return empty | found | {"format": kind, "error": "multi_frame" if found["frames"] != 1 else None}


@pandas_udf(SCHEMA)
def probe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """``probed`` of a binary column."""
    for content in batches:
        out = pd.DataFrame([probed(b) for b in content], columns=SCHEMA.names, dtype=object)
        yield out.astype({"width": "Int32", "height": "Int32", "frames": "Int32", "orientation": "Int32", "icc": "boolean"})
