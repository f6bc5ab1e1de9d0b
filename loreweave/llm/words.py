"""Hashes of the words of a text, computed over its bytes at once."""

from __future__ import annotations

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LONG = 256


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * ODD
    return x ^ (x >> np.uint64(32))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each run of `[^\\x20\\x09-\\x0D]+`, byte at which it starts). Eight bytes of all words are mixed
    in at a time; words of more than 256 bytes are hashed on their own."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gap = _SPACE[np.frombuffer(text, np.uint8)]
    flips = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    flips = np.concatenate([[0] if not gap[0] else [], flips, [len(gap)] if not gap[-1] else []]).astype(np.int64)
    starts, sizes = flips[0::2], flips[1::2] - flips[0::2]
    eights = np.ndarray((len(text) + 1,), "<u8", text + bytes(8), 0, (1,))
    out = sizes.astype(np.uint64)
    live, done = np.flatnonzero(sizes <= _LONG), 0
    while len(live):
        left = sizes[live] - done
        part = eights[starts[live] + done]
        short = np.maximum(0, 8 - left).astype(np.uint64) * np.uint64(8)
        part = (part << short) >> short
        out[live] = mixed(out[live] * ODD + part + MIX)
        live, done = live[left > 8], done + 8
    for i in np.flatnonzero(sizes > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(text[starts[i] : starts[i] + sizes[i]])
    return out, starts
