"""Filmstrips as PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def png(gray: np.ndarray) -> bytes:
    """An 8-bit gray image."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.pad(gray.astype(np.uint8), ((0, 0), (1, 0)))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", gray.shape[1], gray.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def filmstrip(crops: np.ndarray, scale: int = 4) -> bytes:
    """Crops side by side, stretched between the percentiles 1 and 99.5, each pixel ``scale`` wide and high."""
    if not 1 <= scale <= 8:
        raise ValueError("scale must be from 1 to 8")
    lo, hi = np.percentile(crops, (1, 99.5))
    strip = np.clip((crops - lo) / max(hi - lo, 1e-6), 0, 1).transpose(1, 0, 2).reshape(crops.shape[1], -1)
    return png((strip * 255).astype(np.uint8).repeat(scale, axis=0).repeat(scale, axis=1))
