"""Decoders of file bytes: EXIF dates, QuickTime creation times, streamed hashes, thumbnails."""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator
from typing import BinaryIO

#: Bytes of a file's head in which EXIF data is searched where its format doesn't say its place.
HEAD_BYTES = 1 << 20
BLOCK_BYTES = 1 << 17
_EXIF_IFD, _DATE_ORIGINAL = 0x8769, 0x9003
#: A date has 20 bytes; of a longer value no more than these are read.
_DATE_BYTES = 1 << 10


def _at(f: BinaryIO, place: int, n: int) -> bytes:
    f.seek(place)
    return f.read(n)


def _entries(f: BinaryIO, base: int, at: int, order: str) -> dict[int, tuple[int, int, int, int]]:
    """Tag to (type, count, value or offset, place of the value field) of one image file directory."""
    head = _at(f, base + at, 2)
    if len(head) < 2:
        return {}
    (n,) = struct.unpack(order + "H", head)
    data = f.read(12 * n)
    found = {}
    for i in range(len(data) // 12):
        tag, kind, count, value = struct.unpack_from(order + "HHII", data, 12 * i)
        found[tag] = (kind, count, value, at + 10 + 12 * i)
    return found


def _tiff_date(f: BinaryIO, base: int = 0) -> str | None:
    """DateTimeOriginal of the TIFF structure at ``base``; its directories may stand anywhere after it."""
    head = _at(f, base, 8)
    order = {b"II*\x00": "<", b"MM\x00*": ">"}.get(head[:4])
    if order is None or len(head) < 8:
        return None
    top = _entries(f, base, struct.unpack_from(order + "I", head, 4)[0], order)
    inner = _entries(f, base, top[_EXIF_IFD][2], order) if _EXIF_IFD in top else top
    if _DATE_ORIGINAL not in inner:
        return None
    kind, count, value, place = inner[_DATE_ORIGINAL]
    if kind != 2:
        return None
    data = _at(f, base + (place if count <= 4 else value), min(count, _DATE_BYTES))
    return data.split(b"\x00")[0].decode("ascii", "replace").strip() or None


def _jpeg_exif(f: BinaryIO) -> int | None:
    """Place of the TIFF structure in a JPEG's Exif segment, before its image data."""
    at = 2
    while True:
        head = _at(f, at, 10)
        if len(head) < 10 or head[0] != 0xFF or head[1] in (0xD9, 0xDA):
            return None
        if head[1] == 0xFF:  # a fill byte
            at += 1
            continue
        if head[1] == 0xE1 and head[4:] == b"Exif\x00\x00":
            return at + 10
        at += 2 + struct.unpack_from(">H", head, 2)[0]


def _boxes(f: BinaryIO, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start of the content, end) of the ISO boxes between two places."""
    while at + 8 <= end:
        head = _at(f, at, 16)
        if len(head) < 8:
            return
        size, kind = struct.unpack_from(">I4s", head)
        start = at + 8
        if size == 1:
            (size,), start = struct.unpack_from(">Q", head, 8), at + 16
        elif size == 0:
            size = end - at
        if size < start - at:
            return
        yield kind, start, min(at + size, end)
        at += size


def _heif_exif(f: BinaryIO) -> bytes | None:
    """The TIFF structure of the Exif item of a HEIC file, found by the item tables wherever its bytes stand."""
    end = f.seek(0, 2)
    meta = next(((a, b) for kind, a, b in _boxes(f, 0, end) if kind == b"meta"), None)
    if meta is None:
        return None
    parts = {kind: (a, b) for kind, a, b in _boxes(f, meta[0] + 4, meta[1])}
    if b"iinf" not in parts or b"iloc" not in parts:
        return None
    a, b = parts[b"iinf"]
    wanted = None
    for kind, at, _ in _boxes(f, a + (6 if _at(f, a, 1) == b"\x00" else 8), b):
        info = _at(f, at, 14)
        if kind == b"infe" and info[0] >= 2:
            wide = info[0] > 2
            if info[10 if wide else 8 :][:4] == b"Exif":
                wanted = int.from_bytes(info[4 : 8 if wide else 6])
                break
    if wanted is None:
        return None
    a, b = parts[b"iloc"]
    table = io.BytesIO(_at(f, a, b - a))
    number = lambda n: int.from_bytes(table.read(n)) if n else 0
    version = number(4) >> 24
    sizes = number(2)
    offset_size, length_size, base_size, index_size = (sizes >> s & 15 for s in (12, 8, 4, 0))
    for _ in range(number(2 if version < 2 else 4)):
        item = number(2 if version < 2 else 4)
        method = number(2) & 15 if version else 0
        number(2)
        base = number(base_size)
        extents = []
        for _ in range(number(2)):
            number(index_size if version else 0)
            extents.append((number(offset_size), number(length_size)))
        if item == wanted:
            if method > 1 or (method == 1 and b"idat" not in parts):
                return None
            begin, stop = parts[b"idat"] if method else (0, end)
            data = b"".join(_at(f, begin + base + at, n or stop - begin - base - at) for at, n in extents)
            return data[4 + int.from_bytes(data[:4]) :]
    return None


def exif_date(source: bytes | BinaryIO) -> str | None:
    """DateTimeOriginal as it stands in a JPEG, TIFF, DNG, CR2 or HEIC file (or its bytes); None if there is none.

    Places are followed with seeks, so it doesn't matter where in the file the data stands; a
    head is searched where a format has no Exif data in its place.
    """
    f = io.BytesIO(source) if isinstance(source, bytes) else source
    try:
        head = _at(f, 0, 12)
        if head[:4] in (b"II*\x00", b"MM\x00*"):
            return _tiff_date(f)
        if head[:2] == b"\xff\xd8" and (at := _jpeg_exif(f)) is not None:
            return _tiff_date(f, at)
        if head[4:8] == b"ftyp" and (tiff := _heif_exif(f)) is not None:
            return _tiff_date(io.BytesIO(tiff))
    except (struct.error, IndexError, ValueError, OverflowError):
        pass
    try:
        at = _at(f, 0, HEAD_BYTES).find(b"Exif\x00\x00")
        return None if at < 0 else _tiff_date(f, at + 6)
    except (struct.error, IndexError, ValueError, OverflowError):
        return None


def quicktime_seconds(f: BinaryIO) -> int | None:
    """Creation time (seconds since 1904) from a QuickTime file's movie header; None if it can't be read.

    Top-level atoms are skipped by their size until ``moov``, whose first child must be the
    header: a compressed or other one, or a size below a header's, ends the search.
    """
    while True:
        head = f.read(8)
        if len(head) < 8:
            return None
        size, kind = struct.unpack(">I4s", head)
        if kind == b"moov":
            break
        if size < 8:
            return None
        f.seek(size - 8, 1)
    child = f.read(16)
    if len(child) < 16 or child[4:8] != b"mvhd":
        return None
    return struct.unpack_from(">I", child, 12)[0]


def file_hash(f: BinaryIO, algorithm: str = "sha1", limit: int | None = None) -> str:
    """Hex digest of a stream, block by block; ``limit``: of its first bytes only."""
    digest, left = hashlib.new(algorithm), limit
    while block := f.read(BLOCK_BYTES if left is None else min(BLOCK_BYTES, left)):
        digest.update(block)
        left = None if left is None else left - len(block)
        if left == 0:
            break
    return digest.hexdigest()


def thumbnail(content: bytes, side: int = 150) -> bytes | None:
    """JPEG no larger than ``side`` squared; None where the imaging library or a readable image is missing."""
    try:
        from PIL import Image
    except ImportError:
        return None
    try:
        image = Image.open(io.BytesIO(content)).convert("RGB")
    except OSError:
        return None
    image.thumbnail((side, side), Image.LANCZOS)
    out = io.BytesIO()
    image.save(out, "JPEG")
    return out.getvalue()


def image_tag(jpeg: bytes | None) -> str | None:
    """An HTML image element with the JPEG as a data URI."""
    import base64

    return None if jpeg is None else f'<img src="data:image/jpeg;base64,{base64.b64encode(jpeg).decode()}">'
