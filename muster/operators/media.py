"""Finishing of images as arrays of height, width and three channels."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame


def look(key: str, seed: int) -> dict[str, float]:
    """Parameters of a key's look, uniform by hash."""
    u = lambda name: int(hashlib.md5(f"{seed}|{key}|{name}".encode()).hexdigest()[:13], 16) / (1 << 52)
    return {"saturation": 0.8 + 0.3 * u("saturation"), "gamma": 0.9 + 0.2 * u("gamma"), "noise": 2 + 4 * u("noise"), "shift": u("shift"), "mush": 0.6 + 0.3 * u("mush")}


def balanced(image: np.ndarray, saturation: float = 1.0, gamma: float = 1.0) -> np.ndarray:
    """Grey-world white balance, then saturation and gamma."""
    x = image.astype(np.float64)
    means = x.mean((0, 1))
    x = np.clip(x * (means.mean() / np.maximum(means, 1e-9)), 0, 255)
    grey = x @ np.array([0.299, 0.587, 0.114])
    x = np.clip(grey[..., None] + (x - grey[..., None]) * saturation, 0, 255)
    return (255 * (x / 255) ** gamma).round().astype(np.uint8)


def cropped(image: np.ndarray, shift: float, ratio: float = 0.8) -> np.ndarray:
    """The largest cut of width to height 4 to 5, moved by shift of 0 to 1."""
    h, w = image.shape[:2]
    if w / h > ratio:
        width = int(h * ratio)
        at = int((w - width) * shift)
        return image[:, at : at + width]
    height = int(w / ratio)
    at = int((h - height) * shift)
    return image[at : at + height]


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """By the mean of the pixels that fall on each other, nearest where there is none."""
    rows, cols = (np.arange(height) * image.shape[0] // height, np.arange(width) * image.shape[1] // width)
    if height >= image.shape[0] or width >= image.shape[1]:
        return image[rows][:, cols]
    tall = np.add.reduceat(image.astype(np.float64), rows, 0) / np.diff(np.append(rows, image.shape[0]))[:, None, None]
    return (np.add.reduceat(tall, cols, 1) / np.diff(np.append(cols, image.shape[1]))[None, :, None]).round().astype(np.uint8)


def finished(image: np.ndarray, key: str, seed: int) -> np.ndarray:
    """Cut, balanced, softened by a smaller copy, with a little noise; the same for a key each time."""
    p = look(key, seed)
    x = cropped(balanced(image, p["saturation"], p["gamma"]), p["shift"])
    h, w = x.shape[:2]
    x = resized(resized(x, max(1, int(h * p["mush"])), max(1, int(w * p["mush"]))), h, w)
    rng = np.random.default_rng(int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:8], 16))
    return np.clip(x + rng.normal(0, p["noise"], x.shape), 0, 255).round().astype(np.uint8)


def read_png(data: bytes) -> np.ndarray:
    """An image of eight bits a channel, grey, RGB or RGBA and not interlaced, as three channels."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, packed, width, height, channels = 8, b"", 0, 0, 0
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", body)
            channels = {0: 1, 2: 3, 6: 4}.get(colour, 0)
            if depth != 8 or not channels or laced:
                raise ValueError("a PNG of another kind")
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height + 1, (width + 1) * channels), np.int64)  # a row and a pixel of nothing before
    for y in range(height):
        how, line, up = int(lines[y, 0]), lines[y, 1:].astype(np.int64), out[y]
        row = out[y + 1]
        if how == 0:
            row[channels:] = line
        elif how == 2:
            row[channels:] = line + up[channels:]
        elif how == 1:
            row[channels:] = np.cumsum(line.reshape(width, channels), 0).ravel()
        else:
            for x in range(channels, len(row)):
                a, b, c = int(row[x - channels]), int(up[x]), int(up[x - channels])
                if how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[x] = (line[x - channels] + guess) & 255
        row &= 255
    image = out[1:, channels:].reshape(height, width, channels).astype(np.uint8)
    return np.repeat(image, 3, 2) if channels == 1 else image[..., :3]


def write_png(image: np.ndarray) -> bytes:
    """RGB without filters."""
    height, width = image.shape[:2]

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = np.zeros((height, 1 + 3 * width), np.uint8)
    lines[:, 1:] = image.reshape(height, -1)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def finish(images: DataFrame, seed: int) -> DataFrame:
    """key, data, error: PNG images (key, data) finished, each by its key alike whenever it is done; what is no such image keeps its bytes and says why."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for key, data in zip(b.column("key").to_pylist(), b.column("data").to_pylist(), strict=True):  # an image at a time
                try:
                    out, error = write_png(finished(read_png(data or b""), key or "", seed)), None
                except (ValueError, zlib.error, struct.error) as e:
                    out, error = data, str(e)
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([out], pa.binary()), pa.array([error], pa.string())], names=["key", "data", "error"])

    return images.select("key", "data").mapInArrow(run, "key string, data binary, error string")
