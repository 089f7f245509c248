"""PNG images without an imaging library: grey, colour and palette images of 8 bits, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed values of the format: signature, and samples per pixel of each colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(pixels: np.ndarray) -> bytes:
    """An image (height, width) as grey or (height, width, 3) as colour."""
    pixels = np.ascontiguousarray(pixels, np.uint8)
    height, width = pixels.shape[:2]
    rows = pixels.reshape(height, -1)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()  # each row begins with its filter: none
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


def decode(data: bytes, colours: bool = False) -> np.ndarray:
    """(height, width) values of grey and palette images (of the latter the indexes), (height, width, samples) of others; with
    colours always (height, width, 3). ValueError where data is no such image."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG image")
    at, head, body, palette = 8, None, [], None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        at += n + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
    if head is None or head[2] != 8 or head[3] not in SAMPLES or head[6]:
        raise ValueError("not an 8-bit image without interlace")
    width, height, samples = head[0], head[1], SAMPLES[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * samples)
    except zlib.error as e:
        raise ValueError("damaged image") from e
    out = np.zeros((height, width * samples), np.uint8)
    above = np.zeros(width * samples, np.uint8)
    for y in range(height):
        above = out[y] = _unfiltered(raw[y, 0], raw[y, 1:], above, samples)
    out = out.reshape(height, width, samples)
    if colours and head[3] == 3:
        return palette[out[:, :, 0]]
    if colours:
        return out[:, :, :3] if samples >= 3 else np.repeat(out[:, :, :1], 3, axis=2)
    return out[:, :, 0] if samples == 1 else out


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 1:
        return row.reshape(-1, step).cumsum(axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return row + above
    out, up = row.astype(np.int64), above.astype(np.int64)
    for i in range(len(out)):
        left, corner = (out[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            ahead = left + up[i] - corner
            guess = min((left, up[i], corner), key=lambda v: abs(ahead - v))  # the first of the nearest
        out[i] = (out[i] + guess) & 255
    return out.astype(np.uint8)
