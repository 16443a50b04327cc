"""Word shingles as 64-bit hashes, computed for a whole batch of texts at once."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240229)
#: A random number for each byte value at each of 64 places of a word.
_PLACE = _RANDOM.integers(0, 1 << 64, (64, 256), np.uint64).ravel()
_ODD = _RANDOM.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACES = b" \t\n\x0b\x0c\r"
_IS_WORD = bytes(b not in _SPACES for b in range(256))
_LOWER = bytes(range(256)).lower()


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all others; one to one."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and where each text's words begin.

    The second array has one entry more than there are texts.
    """
    data = b" ".join([*texts, b""]) if texts else b""
    word = np.frombuffer(data.translate(_IS_WORD), bool)
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edges = np.concatenate([[0], edges])
    starts, stops = edges[::2], edges[1::2]  # the last byte is a space
    lengths = stops - starts
    letters = np.frombuffer(data.translate(_LOWER, _SPACES), np.uint8)
    first = np.cumsum(lengths) - lengths
    at = np.arange(0, 256 * len(letters), 256)  # 256 times the place in the word, then also the byte
    at -= np.repeat(256 * first, lengths)
    most = int(lengths.max()) if len(lengths) else 0
    turns = (at >> 14).astype(np.uint64) * np.uint64(2) + np.uint64(1) if most > 64 else None
    if most > 64:
        at &= 0x3FFF
    at |= letters
    value = _PLACE[at]
    if turns is not None:
        value *= turns
    hashes = np.add.reduceat(value, first) if len(first) else np.zeros(0, np.uint64)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, int)
    return mix(hashes + lengths.astype(np.uint64)), np.concatenate([[0], np.searchsorted(starts, ends)])


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of every text's ``size``-word shingles.

    Fewer words make one shingle of all of them; no words make an empty set.
    """
    words, bounds = word_hashes(texts)
    n = len(words) - size + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for j in range(size):
        rolled += words[j:j + len(rolled)] * _ODD[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a:b - size + 1]))
        elif b > a:
            short = (words[a:b] * _ODD[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
