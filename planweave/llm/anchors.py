"""Anchors of byte strings: a position that any window of WINDOW bytes picks from its own content."""

from __future__ import annotations

import numpy as np

GRAM = 24
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE_BITS = np.uint64(24)
_PLACES = np.uint64((1 << 24) - 1)
#: Bytes that are handled at a time; twice as many still have places that fit into their bits.
_STRETCH = 1 << 20


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hashes of all ``gram``-byte strings of a byte array, by doubling."""
    n = len(data) - gram + 1
    power, width, h, factor = {}, 1, _BYTES[data], int(_MULTIPLIER)
    while width <= gram:
        power[width] = (h, factor)
        if 2 * width > gram:
            break
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % (1 << 64), 2 * width
    out, at = np.zeros(n, np.uint64), 0
    for width in sorted(power, reverse=True):
        if gram & width:
            h, factor = power[width]
            out = out * np.uint64(factor) + h[at : at + n]
            at += width
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minima of all stretches of ``width`` keys."""
    done, m = 1, keys
    while 2 * done <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    if done < width:
        m = np.minimum(m[: len(keys) - width + 1], m[width - done : width - done + len(keys) - width + 1])
    return m


def anchors(texts: list[bytes], window: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: number of the text, gram hash at the anchor, first window, number of windows, anchor behind the first.

    A window's anchor is the leftmost of its grams with the smallest hash, so equal windows have their anchors at equal offsets. Texts are
    handled side by side, long ones in stretches; a window never leaves its text.
    """
    parts, held, size = [], [], 0
    for number, text in enumerate(texts):
        for at in range(0, max(len(text) - window + 1, 0), _STRETCH):
            piece = text[at : at + _STRETCH + window - 1]
            held.append((number, at, piece))
            size += len(piece)
            if size >= _STRETCH:
                parts.append(_anchors(held, window, gram))
                held, size = [], 0
    if held:
        parts.append(_anchors(held, window, gram))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _anchors(pieces: list[tuple[int, int, bytes]], window: int, gram: int) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    lengths = np.array([len(p) for _, _, p in pieces])
    begin = np.cumsum(lengths) - lengths
    h = gram_hashes(raw, gram)
    low = sliding_min((h & ~_PLACES) | np.arange(len(h), dtype=np.uint64), window - gram + 1) & _PLACES
    inside = np.zeros(len(low) + 1, np.int8)
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + lengths - window + 1, -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    change = low[1:] != low[:-1]
    first = np.flatnonzero(inside & np.concatenate([[True], change | ~inside[:-1]]))
    last = np.flatnonzero(inside & np.concatenate([change | ~inside[1:], [True]]))
    which = np.searchsorted(begin, first, side="right") - 1
    place = low[first].astype(np.int64)
    number = np.array([n for n, _, _ in pieces])[which]
    at = np.array([a for _, a, _ in pieces])[which]
    return number, h[place], first - begin[which] + at, last - first + 1, place - first
