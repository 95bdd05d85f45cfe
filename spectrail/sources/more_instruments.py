"""OMNIC SPA files, and archives of one-spectrum files."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np

from spectrail.functions.arrays import Refused

from .instruments import FORMATS, Spectrum

#: Bytes that a member of an archive may have once unpacked (a fixed value of the format's reader).
MEMBER_BYTES = 64 << 20


def spa(content: bytes) -> Iterator[Spectrum]:
    """The spectrum's block (key 3) on the axis that its header (key 2) states."""
    points = first = last = where = None
    for at in range(304, len(content) - 16, 16):
        key = content[at]
        offset = struct.unpack_from("<i", content, at + 2)[0]
        if key == 2:
            points = struct.unpack_from("<i", content, offset + 4)[0]
            first, last = struct.unpack_from("<ff", content, offset + 16)
        elif key == 3:
            where = offset, struct.unpack_from("<i", content, at + 6)[0]
        elif key in (0, 1):
            break
    if points is None or where is None:
        raise Refused("no spectrum is listed in the file's directory")
    y = np.frombuffer(content, "<f4", where[1] // 4, where[0]).astype(float)
    if len(y) != points:
        raise Refused(f"{len(y)} ordinates where the header says {points}")
    yield content[30:286].split(b"\0")[0].decode("latin-1"), np.linspace(first, last, points), y


def archive(content: bytes) -> Iterator[Spectrum]:
    """The members of a zip file in the order of their names; any that no reader takes is refused."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in sorted(z.infolist(), key=lambda i: i.filename):
            if info.is_dir():
                continue
            suffix = "." + info.filename.rsplit(".", 1)[-1].lower()
            if suffix not in FORMATS or suffix == ".zip":
                raise Refused(f"{info.filename}: no reader for {suffix}")
            if info.file_size > MEMBER_BYTES:
                raise Refused(f"{info.filename} has {info.file_size} bytes")
            for title, axis, y in FORMATS[suffix](z.read(info)):
                yield title or info.filename, axis, y


FORMATS |= {".spa": spa, ".zip": archive}
