"""Ids of many texts at once: Arrow finds the distinct chunks, and each of them is asked for once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of chunks and ids that are remembered in each of two generations.
HELD_BYTES = 96 << 20
#: What a remembered chunk takes beside its characters and ids.
ENTRY_BYTES = 200
#: A NUL, white space other than single spaces and single line ends: texts with these are not split at spaces.
UNEVEN = ("[ \\n][ \\n]|[\\x00\\t\\x0b-\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}"
          "\\x{202f}\\x{205f}\\x{3000}]")


class Generations(dict):
    """A memory of bounded size: when full, what was not used since the last time goes.

    New entries and those that are used again are in the dictionary itself; the
    generation before it is ``older``.  What is in neither is asked for.
    """

    def __init__(self, most_bytes: int, ask):
        super().__init__()
        self.older: dict = {}
        self.most, self.size, self.ask = most_bytes, 0, ask

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.ask(key)
        self[key] = value
        self.size += len(key) + len(value) + ENTRY_BYTES
        if self.size > self.most:
            self.older = self.copy_out()
        return value

    def copy_out(self) -> dict:
        out = dict(self)
        self.clear()
        self.size = 0
        return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(other)) for b in range(256)]


def even(texts: pa.Array, other: str = "") -> np.ndarray:
    """Whether a text can be split at its spaces and line ends; ``other`` is a pattern that it must not match either."""
    return ~pc.match_substring_regex(texts, f"{UNEVEN}|{other}" if other else UNEVEN).to_numpy(zero_copy_only=False)


def split_at_spaces(texts: pa.Array) -> pa.ListArray:
    """Chunks of even texts: words with the space before them, and line ends."""
    return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 "), "\0")


def encode_lists(lists: pa.ListArray, ids_of: Callable[[str], bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of lists of chunks, and where each list's begin; no chunk is asked for twice, the empty one never."""
    coded = lists.flatten().dictionary_encode()
    told = [ids_of(w) if w else b"" for w in coded.dictionary.to_pylist()]
    sizes = np.array([len(b) // 4 for b in told], np.int64)
    ids, ends = ragged(np.frombuffer(b"".join(told), "<u4"), sizes, coded.indices.to_numpy())
    bounds = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()), dtype=np.int64)])
    return ids, np.concatenate([[0], ends])[bounds]


def with_others(ids: np.ndarray, starts: np.ndarray, others: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The same after the ids of some texts are put in."""
    if not others:
        return ids, starts
    parts = np.split(ids, starts[1:-1])
    for i, own in others.items():
        parts[i] = own
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def ragged(values: np.ndarray, sizes: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``take`` of lists that lie one after the other in ``values``, and where each of them ends."""
    first = np.cumsum(sizes) - sizes
    own = sizes[take]
    ends = np.cumsum(own)
    places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[take] - (ends - own), own)
    return values[places], ends
