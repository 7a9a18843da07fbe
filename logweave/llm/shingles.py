"""Word-shingle sets as sorted 64-bit hashes, made by array code for many texts at once."""

from __future__ import annotations

import numpy as np

from .common import mix64, randoms

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = randoms(256, 11)


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and how many words precede each text; words end at ASCII white space, A-Z lower-cased."""
    base, raw = offs[0], raw[offs[0] : offs[-1]]
    word = ~_SPACE[raw]
    start = word.copy()
    start[1:] &= ~word[:-1]
    inner = offs[1:-1] - base
    inner = inner[inner < len(raw)]
    start[inner] = word[inner]
    at = np.flatnonzero(start)
    first = np.searchsorted(at, offs - base)
    if not len(at):
        return np.zeros(0, np.uint64), first
    place = np.arange(len(raw)) - np.repeat(at, np.diff(np.append(at, len(raw))), axis=0) if at[0] == 0 else np.concatenate([np.zeros(at[0], np.int64), np.arange(at[0], len(raw)) - np.repeat(at, np.diff(np.append(at, len(raw))))])
    factor = randoms(int(place.max()) + 1, 23)
    value = _BYTE[_LOWER[raw]] * factor[place]
    value[~word] = 0
    return mix64(np.add.reduceat(value, at)), first


def shingle_sets(raw: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words the whole sequence is one, without words there is none."""
    words, first = word_hashes(raw, offs)
    mult = randoms(width, 37)
    n = len(words) - width + 1
    full = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        full += words[k : k + max(n, 0)] * mult[k]
    full = mix64(full)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            out.append(mix64((words[a:b] * mult[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(full[:0])
    return out
