"""Vectorised 64-bit hashes of the words of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed in one go: bounds memory, whatever the batch holds.
PIECE = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
BYTE[BLANK] = 0
_P = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    out[1:] = base
    return np.multiply.accumulate(out)


POWER_LOW = _powers(_P, 1 << 12)
POWER_HIGH = _powers(pow(_P, 1 << 12, 1 << 64), 1 << 12)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_block(blob: bytes, blank: np.ndarray = BLANK, byte: np.ndarray = BYTE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of blob."""
    a = np.frombuffer(blob, np.uint8)
    off = blank[a]
    first = ~off
    first[1:] &= off[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    at = np.zeros(len(a), np.int64)
    at[starts] = starts
    at[: starts[0]] = 0
    at = np.arange(len(a)) - np.maximum.accumulate(at)
    power = POWER_LOW[at & 4095]
    if at.max() > 4095:
        power = power * POWER_HIGH[(at >> 12) & 4095]
    return starts, mixed(np.add.reduceat(byte[a] * power, starts))


def word_hashes(texts: list[bytes], blank: np.ndarray = BLANK, byte: np.ndarray = BYTE) -> Iterator[np.ndarray]:
    """The word hashes of each text; words end at bytes where blank holds (byte is 0 there)."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > PIECE:
            yield _long(texts[i], blank, byte)
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and size + len(texts[j]) <= PIECE:
            size += len(texts[j]) + 1
            j += 1
        starts, hashes = _hash_block(b"\n".join(texts[i:j]), blank, byte)
        ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
        cuts = np.searchsorted(starts, ends)
        low = 0
        for c in cuts:
            yield hashes[low:c]
            low = c
        i = j


def _long(text: bytes, blank: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A text beyond PIECE, in pieces that end at blanks; a word without end is one piece."""
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and not blank[text[end]]:
            hop = np.flatnonzero(blank[np.frombuffer(text, np.uint8, min(65536, len(text) - end), end)])
            end = end + int(hop[0]) if len(hop) else min(len(text), end + 65536)
        parts.append(_hash_block(text[at:end], blank, byte)[1])
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)
