"""Byte-level BPE as a finite-state transducer, and a streaming decoder.

A token sequence is the BPE encoding of its bytes exactly when every pair of
neighbours is what the merges make of the two tokens' bytes alone.  So the
merges compile into a nondeterministic transducer: a configuration is a
place in the token trie and the token before it.  It is determinised lazily,
one set of live configurations per state; each move tells the last token of
what has been read, and a token is certain once all live configurations descend
from it, which takes at most the length of the longest token.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .chunk_ids import HELD_BYTES, Generations, encode_lists, even, split_at_spaces, with_others
from .common import documents, in_worker, python_ready

#: States of the lazy automaton and token pairs; beyond these they are dropped and built anew.
MAX_STATES, MAX_PAIRS = 120_000, 250_000
#: Bytes of a piece after which certain tokens are taken out; more than any token's length.
LOOKAHEAD = 1024
INFINITE = float("inf")
#: Ids that the decoder takes at a time.
DECODE_IDS = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Encodes one piece (a match of the pre-tokenizer's pattern) at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.depth: list[int] = [0]
        self.size = {rank: len(text) for text, rank in ranks.items()}
        #: tokens that the merges never reach; they stand only for a piece that equals them
        self.whole: dict[bytes, tuple[int, ...]] = {}
        #: per token, the tokens that in turn stood at its left and at its right edge while it
        #: was merged, each with the rank of the merge that took it up
        self.left_edge: dict[int, list[tuple[bytes, float]]] = {}
        self.right_edge: dict[int, list[tuple[bytes, float]]] = {}
        for text, rank in sorted(ranks.items(), key=lambda x: x[1]):
            halves = self._halves(text)
            if halves is None:
                self.whole[text] = (rank,)
                continue
            self._add_edges(text, rank, halves)
            node = 0
            for b in text:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = self.children[node][b]
            self.token[node] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self._clear()

    def merge(self, text: bytes, down_to: int = 1) -> list[bytes]:
        """Plain merging, lowest rank first; also the tests' twin."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > down_to:
            ranked = [(self.ranks.get(a + b, INFINITE), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == INFINITE:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _halves(self, text: bytes) -> tuple[bytes, ...] | None:
        """The two parts of a token's last merge, none for a byte; null if the merges miss the token."""
        parts = self.merge(text, 2)
        return () if len(text) == 1 else tuple(parts) if len(parts) == 2 else None

    def _add_edges(self, text: bytes, rank: int, halves: tuple[bytes, ...]) -> None:
        left = right = []
        if halves:
            first, last = (self.ranks[h] for h in halves)
            if max(first, last) > rank:
                raise ValueError(f"token {rank} has a lower rank than its parts")
            left = [*self.left_edge[first][:-1], (halves[0], rank)]
            right = [*self.right_edge[last][:-1], (halves[1], rank)]
        self.left_edge[rank] = [*left, (text, INFINITE)]
        self.right_edge[rank] = [*right, (text, INFINITE)]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stand next to each other in an encoding.

        They don't if some merge across their border comes before the merges
        that take up the tokens on both its sides.  Of equal ranks the
        leftmost goes first.
        """
        key = (left, right)
        told = self.pairs.get(key)
        if told is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            told = self.pairs[key] = self._never_crossed(self.right_edge[left], self.left_edge[right])
        return told

    def _never_crossed(self, ending: list, starting: list) -> bool:
        i = j = 0
        while True:
            (a, a_taken), (b, b_taken) = ending[i], starting[j]
            across = self.ranks.get(a + b, INFINITE)
            if across < a_taken and across <= b_taken and across < INFINITE:
                return False
            if a_taken == b_taken == INFINITE:
                return True
            if a_taken <= b_taken:
                i += 1
            else:
                j += 1

    def _clear(self) -> None:
        """Back to the start state alone; its number is 0."""
        self.number: dict[tuple, int] = {}
        self.configs: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self._state(((0, -1),))

    def _state(self, configs: tuple) -> int:
        known = self.number.get(configs)
        if known is None:
            known = self.number[configs] = len(self.configs)
            self.configs.append(configs)
            self.moves.append({})
        return known

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """The next state, and the last token of what has been read so far.

        Every prefix has one encoding, so of the configurations that complete
        a token here only one has a left neighbour that fits.
        """
        after, last = [], -1
        for node, before in self.configs[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            token = self.token[child]
            if token >= 0 and last < 0 and (before < 0 or self.fits(before, token)):
                last = token
            if self.children[child]:
                after.append((child, before))
        after.append((0, last))
        move = self.moves[state][byte] = (self._state(tuple(after)), last)
        return move

    def _path(self, ends: list[int], start: int, stop: int) -> list[int]:
        """Tokens from ``start`` to ``stop``, by the last token of every prefix."""
        out = []
        while stop > start:
            out.append(ends[stop - 1])
            stop -= self.size[out[-1]]
        return out[::-1]

    def _settle(self, ends: list[int], state: int, start: int) -> int:
        """The last place at which all live configurations have a token end."""
        agreed: set[int] | None = None
        for node, _ in self.configs[state]:
            stop, places = len(ends) - self.depth[node], {start}
            while stop > start:
                places.add(stop)
                stop -= self.size[ends[stop - 1]]
            agreed = places if agreed is None else agreed & places
        return max(agreed)

    def encode(self, piece: bytes) -> list[int]:
        """Tokens become certain after at most a longest token's length; in a long piece they
        are taken out every LOOKAHEAD bytes, and at its end the rest."""
        if piece in self.whole:
            return list(self.whole[piece])
        if len(self.configs) > MAX_STATES:
            self._clear()
        state, moves, ends, out, start = 0, self.moves, [], [], 0
        for byte in piece:
            state, last = moves[state].get(byte) or self._move(state, byte)
            ends.append(last)
            if len(ends) - start >= LOOKAHEAD:
                sure = self._settle(ends, state, start)
                out += self._path(ends, start, sure)
                start = sure
        return out + self._path(ends, start, len(ends))


def pack(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()


class Encoder:
    """Texts to ids.  Pieces, the matches of the pattern, are remembered.

    Before a space that follows no white space, and around a line end between
    two characters that are none, the pattern always starts a new match; so in
    a text without two white-space characters in a row, chunks can be encoded
    on their own, each distinct one of a batch once.  Other texts are matched as a whole.
    """

    def __init__(self, pattern: str, encode_piece, held_bytes: int = HELD_BYTES):
        self.pieces = regex.compile(pattern).findall
        self.known = Generations(held_bytes, lambda piece: pack(encode_piece(piece.encode())))

    def _ids(self, chunk: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.pieces(chunk)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin; nulls have none."""
        texts = pc.fill_null(texts, "")
        fit = even(texts)
        ids, starts = encode_lists(split_at_spaces(pc.if_else(pa.array(fit), texts, "")), self._ids)
        return with_others(ids, starts, {
            i: np.frombuffer(self._ids(texts[i].as_py()), "<u4") for i in np.flatnonzero(~fit).tolist()})


class Utf8Stream:
    """Incremental UTF-8: bytes in, text out; an unfinished character waits for its rest.

    The machine's state is how many bytes are missing and what the next may
    be.  Bytes that can't be UTF-8 become U+FFFD, one per maximal wrong part.
    """

    # Fixed values of UTF-8: first bytes, how many follow, and the bounds of the second byte.
    LEADS = (
        (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF),
        (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF),
        (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F),
    )
    START = {b: (n, low, high) for lo, hi, n, low, high in LEADS for b in range(lo, hi + 1)}

    def __init__(self) -> None:
        self.waiting = b""

    def _open(self, data: bytes) -> int:
        """How many bytes at the end are the start of a character that may still come."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead in self.START:
                missing, low, high = self.START[lead]
                for b in data[len(data) - back + 1:]:
                    if not low <= b <= high:
                        return 0
                    missing, low, high = missing - 1, 0x80, 0xBF
                return back if missing > 0 else 0
            if not 0x80 <= lead <= 0xBF:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        keep = len(data) - self._open(data)
        self.waiting = data[keep:]
        return data[:keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, held_bytes: int = HELD_BYTES):
        self.encoder = Encoder(pattern, Transducer(ranks).encode, held_bytes)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for text, rank in ranks.items():
            self.bytes_of[rank] = text

    def encode(self, text: str | None) -> np.ndarray:
        return self.encoder.encode(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder.encode(texts)

    def decode(self, ids: list[int]) -> Iterator[str]:
        """The text in parts, whatever its length."""
        stream, lookup = Utf8Stream(), self.bytes_of.__getitem__
        for at in range(0, len(ids), DECODE_IDS):
            yield stream.feed(b"".join(map(lookup, ids[at:at + DECODE_IDS])))
        yield stream.finish()


def _mapped(docs: DataFrame, text_col: str, ranks_path: str, pattern: str, schema: str, names: list[str], work) -> DataFrame:
    """All columns of ``docs`` beside what ``work(codec, column)`` makes of one column."""
    spark = docs.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    names_kept = [c for c in docs.columns if c not in names]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names_kept]).alias("row"), F.col(text_col).alias("__in"))
    kind = packed.schema["row"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = in_worker(("bpe", ranks_path, pattern), lambda: Codec(shared.value, pattern))
        for batch in batches:
            yield pa.record_batch([batch["row"], *work(own, batch["__in"])], names=["row", *names])

    return packed.mapInArrow(run, f"row {kind}, {schema}").select("row.*", *names)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int).

    Null and empty texts have no ids; repeated rows equal ids; no rows give no
    rows.  A column that was called ``ids`` is replaced.
    """
    def work(own: Codec, texts: pa.Array) -> list[pa.Array]:
        ids, starts = own.encode_all(texts)
        return [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))]

    return _mapped(docs, text_col, ranks_path, pattern, "ids array<int>", ["ids"], work)


def decode_documents(docs: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``decoded`` (string); null ids give an empty string."""
    def work(own: Codec, ids: pa.Array) -> list[pa.Array]:
        return [pa.array(["".join(own.decode(x or [])) for x in ids.to_pylist()], pa.string())]

    return _mapped(docs, ids_col, ranks_path, pattern, "decoded string", ["decoded"], work)


def digest_round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256: encoded, then decoded from the ids.

    One pass: neither ids nor decoded texts leave their task.  Null and empty
    texts have no ids and the digests of nothing; repeated rows equal digests; no rows give no rows.
    Columns of ``docs`` with these names are replaced.
    """
    def work(own: Codec, texts: pa.Array) -> list[pa.Array]:
        counts, ids_sha, text_sha = [], [], []
        decimal = [str(i) for i in range(len(own.bytes_of))].__getitem__
        flat, starts = own.encode_all(texts)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            ids = flat[a:b].tolist()
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
            told = hashlib.sha256()
            for part in own.decode(ids):
                told.update(part.encode())
            text_sha.append(told.hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return _mapped(docs, text_col, ranks_path, pattern,
                   "n_tokens bigint, ids_sha256 string, decoded_sha256 string", names, work)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_round_trip(
        documents(spark, sf_dir).select("doc_id", "text"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
    ).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
