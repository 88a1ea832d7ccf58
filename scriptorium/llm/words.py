"""64-bit hashes of the words of a text, all at once."""

from __future__ import annotations

import functools

import numpy as np

MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); wraps around on purpose."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes hashed at a time: what a worker holds does not grow with its longest text.
CHUNK = 1 << 18


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """MULT to the powers 0 to CHUNK, and their inverses modulo 2 ** 64."""
    found = []
    with np.errstate(over="ignore"):
        for base in (int(MULT), pow(int(MULT), -1, 1 << 64)):
            steps = np.full(CHUNK + 1, base, np.uint64)
            steps[0] = 1
            found.append(np.multiply.accumulate(steps))
    return found[0], found[1]


#: A random 64-bit number for each byte, and the same with A to Z as a to z.
_BYTE, _LOWER = (mix(np.frombuffer(x, np.uint8).astype(np.uint64) + np.uint64(0x51ED2701)) for x in (bytes(range(256)), bytes(range(256)).lower()))
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_hashes(text: str | bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and where it starts and ends in the UTF-8 bytes.

    Hashes are differences of one polynomial over the bytes, so that no word is cut out. Long texts are worked on in chunks
    that end between words."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text, np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.intp), np.empty(0, np.intp)
    edges = np.flatnonzero(np.diff(_SPACE[data].view(np.int8), prepend=1, append=1))
    starts, ends = edges[::2], edges[1::2]
    found, at = [], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        found.append(_hashed(data, starts[at:to], ends[at:to], _LOWER if lower else _BYTE))
        at = to
    return np.concatenate(found) if found else np.empty(0, np.uint64), starts, ends


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    up, down = _powers()
    first = starts[0]
    with np.errstate(over="ignore"):
        if ends[-1] - first > CHUNK:  # one word alone
            total = np.zeros(1, np.uint64)
            for at in range(first, ends[0], CHUNK):
                part = table[data[at : min(at + CHUNK, ends[0])]]
                total += (part * up[: len(part)]).sum() * np.uint64(pow(int(MULT), int(at - first), 1 << 64))
            return mix(total + (ends - starts).astype(np.uint64))
        span = table[data[first : ends[-1]]]
        total = np.zeros(len(span) + 1, np.uint64)
        np.cumsum(span * up[: len(span)], out=total[1:])
        return mix((total[ends - first] - total[starts - first]) * down[starts - first] + (ends - starts).astype(np.uint64))
