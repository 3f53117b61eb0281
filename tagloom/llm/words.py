"""Words of many texts at once, as arrays."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.full(max(n, 1), _BASE)) if n else np.ones(1, np.uint64)


_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True


def run_hashes(buf: np.ndarray, inside: np.ndarray, begins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, length) of each run of bytes where ``inside`` holds; ``begins`` marks further starts within runs."""
    if not len(buf) or not inside.any():
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), e, e
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = inside & ~before
    if begins is not None:
        first |= inside & begins
    at = np.flatnonzero(inside)
    start = np.flatnonzero(first[at])
    length = np.diff(np.append(start, len(at)))
    pos = np.arange(len(at)) - np.repeat(start, length)
    with np.errstate(over="ignore"):
        h = np.add.reduceat((buf[at].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()))[pos], start)
    return mix64(h + length.astype(np.uint64)), at[start], length


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other with a newline between, and their starts."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
    return np.frombuffer(b"\n".join(raw) + b"\n", np.uint8), starts


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each word: the runs of a-z and 0-9 after lower-casing."""
    buf, starts = joined([t.lower() if t else t for t in texts])
    h, at, _ = run_hashes(buf, _PLAIN[buf])
    return h, np.searchsorted(starts, at, side="right") - 1
