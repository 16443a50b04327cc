"""Scores of a gated recurrent language model with a class-factored softmax.

Every count is over all training texts.  The model knows the most frequent
words, the more the more tokens there are; any other is its word for "rare", times the word's smoothed share of
the rare ones.  It is trained by truncated backpropagation in numpy: tasks
train on their own blocks of texts, their weights are averaged after each
round.  A text is scored as a whole: its state is carried from window to window.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.store import materialize
from .blocks import NO_ID, pack_blocks, unpack
from .common import buckets, documents, python_ready
from .shingles import mix, word_hashes

#: Size of the state, fewest known words, steps of a window, lanes, rounds of averaging.
STATE, WORDS, WINDOW, LANES, ROUNDS = 16, 1024, 32, 512, 2
#: Targets of one class that are multiplied together, and from how many a class is multiplied by itself.
PACK, ALONE = 8, 64
#: Rows of logits, and numbers of a table, worked on at a time: they stay in a core's cache.
CHUNK, CACHED = 1024, 1 << 15
#: Bytes of text whose words are hashed at a time, for the same reason.
HASHED = 1 << 17
#: Targets scored together; more of a class meet, so fewer places of packs stay empty.
SCORED = 1 << 17
#: The bias of places of no word, and the sums of exponentials between which no logit needs to be shifted.
NEVER, LEAST, MOST = -1e4, 1e-15, 1e15
#: Known words for each root of the number of training tokens.
WORDS_BY_ROOT = 4
#: Learning rate, and bytes of text that are brought into lanes at a time.
RATE, GROUP_BYTES = 0.02, 24 << 20
#: Beside the size of a mean gradient: weights that hardly any text moves stay where they are.
SMALL = 1e-4
#: Numbers of the end of a text and of any rare word.
END, RARE = 0, 1
END_HASH = np.uint64(0)
#: Counts from which a word is offered as a known one.
OFFERED = 4
SLICES = 8


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same as ``word_hashes``, HASHED bytes or one long text at a time."""
    told, size, begin = [], 0, 0
    for i, text in enumerate(texts, 1):
        size += len(text)
        if size >= HASHED or i == len(texts):
            told.append(word_hashes(texts[begin:i]))
            size, begin = 0, i
    if not told:
        return word_hashes(texts)
    counts = np.concatenate([np.diff(bounds) for _, bounds in told])
    return np.concatenate([words for words, _ in told]), np.concatenate([[0], np.cumsum(counts)])


class Tokens:
    """Words of a block as hashes, each text closed by its end; with ``training``, of its training texts alone."""

    def __init__(self, ids: list[int], sizes: list[int], blob: bytes, training: bool = False):
        raw = unpack(blob, sum(sizes))
        self.ids = [None if i == NO_ID else i for i in ids]
        texts = [raw[b - n:b] for n, b in zip(sizes, np.cumsum(sizes).tolist())]
        if training:
            own = [j for j, i in enumerate(self.ids) if not held_out(i)]
            self.ids, texts = [self.ids[j] for j in own], [texts[j] for j in own]
        words, bounds = _hashed(texts)
        words = np.maximum(words, np.uint64(1))  # 0 is the end's
        self.hashes = np.insert(words, bounds[1:], END_HASH)
        self.bounds = bounds + np.arange(len(bounds))
        self.trained = np.array([not held_out(i) for i in self.ids], bool)
        self.lengths = np.diff(self.bounds)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes, and each token's place among them."""
        return np.unique(self.hashes, return_inverse=True)


class Vocabulary:
    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, types: int):
        """Known words, most frequent first; ``tokens`` and ``types`` are those of all training texts."""
        self.tokens, self.types = tokens, types
        self.counts = np.concatenate([[max(1, tokens - int(counts.sum()))], counts]).astype(np.float64)
        where = {int(h): i for i, h in enumerate(hashes)}
        end = where.get(int(END_HASH))
        order = [i for i in range(len(hashes)) if i != end]
        self.counts = np.concatenate([[max(1, counts[end] if end is not None else 1)], self.counts[:1], counts[order]])
        known = np.concatenate([[END_HASH], hashes[order]]).astype(np.uint64)
        number = np.concatenate([[END], np.arange(2, len(order) + 2)])
        by = np.argsort(known)
        self.known, self.number = known[by], number[by].astype(np.int32)
        # where the hashes of each beginning start: of mixed hashes hardly two begin alike
        bits = max(8, len(known).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.known >> self.shift, np.arange((1 << bits) + 1)).astype(np.int32)
        self.rare_tokens = max(0, tokens - int(counts.sum()))
        self.rare_types = max(0, types - len(hashes))

    def __len__(self) -> int:
        return len(self.counts)

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        begins = (hashes >> self.shift).astype(np.intp)
        at, end = self.starts.take(begins), self.starts.take(begins + 1)
        found = self.known.take(at, mode="clip") == hashes
        rest = np.flatnonzero(~found & (end - at > 1))
        at[rest] = np.searchsorted(self.known, hashes[rest])
        found[rest] = self.known.take(at[rest], mode="clip") == hashes[rest]
        return np.where(found, self.number.take(at, mode="clip"), np.int32(RARE))

    def rare_log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.rare_tokens + 0.5 * (self.rare_types + 1)))


def _rows(x: np.ndarray) -> np.ndarray:
    """(steps, width, lanes) as one row for each step and lane."""
    return x.transpose(0, 2, 1).reshape(-1, x.shape[1])


def _room(steps: int, width: int, lanes: int, dtype) -> np.ndarray:
    """(steps, width, lanes) that is soon turned: lanes of a power of two would share few places of the cache."""
    return np.empty((steps, width, lanes + 16), dtype)[:, :, :lanes]


def _sorted(words: np.ndarray) -> np.ndarray:
    """The stable order of numbers below 2 ** 32, by halves: these are dealt by value, not compared."""
    by = np.argsort((words & 0xFFFF).astype(np.uint16), kind="stable")
    high = (words >> 16).astype(np.uint16)
    return by[np.argsort(high[by], kind="stable")] if high.any() else by


def _runs(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at ``first``: the next row of all runs at once, the rest of a long one as a product."""
    flat = rows.reshape(len(rows), -1)
    size = np.diff(np.append(first, len(flat)))
    by = np.argsort(-size, kind="stable")
    size, at = size[by], first[by]
    sums, done = flat.take(at, axis=0), 1
    while (live := int(np.searchsorted(-size, -done))) > 32:
        sums[:live] += flat.take(at[:live] + done, axis=0)
        done += 1
    for i in range(live):
        sums[i] += np.ones(size[i] - done, flat.dtype) @ flat[at[i] + done:at[i] + size[i]]
    back = np.empty_like(by)
    back[by] = np.arange(len(by))
    return sums.take(back, axis=0).reshape(len(first), *rows.shape[1:])


def _choices(table: np.ndarray, states: np.ndarray, parts: tuple, picks: tuple, sums: np.ndarray, shift: bool, learn: bool) -> tuple:
    """Logits of one pick from each part of a table's rows, a softmax each, by states; ``sums`` takes those of their exponentials.

    With ``learn`` also the gradients of the picks' negative log probability by the table and by the states.
    ``shift`` takes the largest off first.
    """
    e = table @ states.T
    if shift:
        for part in parts:
            e[part] -= e[part].max(axis=0)
    flat, m = e.reshape(-1), len(states)
    places = [pick * m + np.arange(part.start * m, part.start * m + m) for part, pick in zip(parts, picks)]
    logits = flat.take(places[0])
    for place in places[1:]:
        logits += flat.take(place)
    np.exp(e, out=e)
    for part, total in zip(parts, sums):
        np.add.reduce(e[part], axis=0, out=total)
    if not learn:
        return logits, None, None
    for part, place, total in zip(parts, places, sums):
        e[part] *= 1 / total
        flat[place] -= 1
    return logits, e @ states, e.T @ table[:, :-1]


def _biases(counts: np.ndarray, dtype) -> np.ndarray:
    """Logarithms of counts; places of no word get no share."""
    return np.where(counts > 0, np.log(np.maximum(counts, 1)) - np.log(counts.max()), NEVER).astype(dtype)


class Model:
    """Weights: input table (word to gates), state matrix, and outputs for groups, their classes and their words.

    Words by frequency are cut into classes, classes into groups, all about as wide as the cube root of the
    number of words: a word's probability is its group's, times its class's there, times its own there.
    """

    def __init__(self, vocabulary: Vocabulary, dtype=np.float32, state: int = STATE):
        words = len(vocabulary)
        self.size = max(2, int(np.ceil(np.cbrt(words))))
        classes = -(-words // self.size)
        self.wide = int(np.ceil(np.sqrt(classes)))
        groups = -(-classes // self.wide)
        self.class_of = np.arange(words) // self.size
        counts = np.zeros((groups, self.wide, self.size))
        counts.reshape(-1)[:words] = vocabulary.counts
        rng = np.random.default_rng(1)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(dtype)
        # the biases, last in a row, start as the words' own frequencies, so training starts at the unigram model
        ended = lambda rows, biases: np.concatenate([rows * dtype(0.1), biases[..., None]], axis=-1)
        self.weights = {
            "input": draw(words, 3 * state), "state": draw(state, 3 * state) * dtype(3),
            "group": ended(draw(state, groups).T, _biases(counts.sum(axis=(1, 2)), dtype)),
            "class": ended(draw(groups, self.wide, state), _biases(counts.sum(axis=2), dtype)),
            "word": ended(draw(groups * self.wide, self.size, state), _biases(counts, dtype).reshape(-1, self.size)),
        }
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        self.steps = 0

    def run(self, inputs: np.ndarray, h: np.ndarray, learn: bool = True) -> tuple[np.ndarray, ...]:
        """States of a window of inputs (steps, lanes); the state is cleared where a text begins.

        ``h`` is (lanes, state).  Arrays (steps, ..., lanes), lanes side by side in memory: state before, both
        gates, the candidate's part from the state, the candidate, and the state after; without ``learn`` the
        others than the last are of one step.
        """
        w, n = self.weights, h.shape[1]
        steps, lanes = inputs.shape
        stays = (inputs != END).astype(h.dtype)[:, None, :]
        turn = np.ascontiguousarray(w["state"].T)
        h = np.ascontiguousarray(h.T)
        kept = steps if learn else 1
        before, part, new = (np.empty((kept, n, lanes), h.dtype) for _ in range(3))
        after, gates = np.empty((steps, n, lanes), h.dtype), np.empty((kept, 2 * n, lanes), h.dtype)
        own, given = np.empty((3 * n, lanes), h.dtype), np.empty((3 * n, lanes), h.dtype)
        for t in range(steps):
            k = t % kept
            np.copyto(given, w["input"].take(inputs[t], axis=0).T)
            np.multiply(h, stays[t], out=before[k])
            np.matmul(turn, before[k], out=own)
            zr = np.add(own[:2 * n], given[:2 * n], out=gates[k])
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            part[k] = own[2 * n:]
            np.multiply(zr[n:], part[k], out=new[k])
            new[k] += given[2 * n:]
            np.tanh(new[k], out=new[k])
            h = np.subtract(before[k], new[k], out=after[t])
            h *= zr[:n]
            h += new[k]
        return before, gates, part, new, after

    @np.errstate(over="ignore", divide="ignore", invalid="ignore")
    def _outputs(self, states: np.ndarray, targets: np.ndarray, grads: dict | None, shift: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probabilities of the targets; with ``grads``, also the gradient of their negative sum by the states.

        Targets are sorted once: a group's and a class's are then runs.  A group and its classes are chosen from
        together; so are the words of a class with many targets, and those of all other classes in packs.
        Only where a sum of exponentials leaves the range in which floats keep their digits, all is done
        again with ``shift``: the largest logit is taken off each.
        """
        w, n, learn = self.weights, states.shape[1], grads is not None
        by = _sorted(targets)
        words = targets.take(by)
        s = np.ones((len(by), n + 1), states.dtype)  # the last are the biases'
        s[:, :n] = states.take(by, axis=0)
        classes = words // self.size
        slot = words - classes * self.size
        logs, sums = np.empty(len(by), s.dtype), np.empty((3, len(by)), s.dtype)
        back = np.empty((len(by), n), s.dtype) if learn else None
        groups, wide = w["class"].shape[:2]
        by_group, by_class = np.zeros_like(w["group"]), np.zeros_like(w["class"])
        cuts = np.searchsorted(classes, np.arange(groups + 1) * wide).tolist()
        for g, (begin, end) in enumerate(zip(cuts, cuts[1:])):
            table = np.concatenate([w["group"], w["class"][g]])
            for lo in range(begin, end, CHUNK):
                own = slice(lo, min(lo + CHUNK, end))
                logs[own], by_table, by_state = _choices(
                    table, s[own], (slice(0, groups), slice(groups, groups + wide)), (g, classes[own] - g * wide), sums[:2, own], shift, learn)
                if learn:
                    back[own] = by_state
                    by_group += by_table[:groups]
                    by_class[g] += by_table[groups:]
        first = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))[:len(classes)]
        count = np.diff(np.append(first, len(classes)))
        hit = classes[first]
        by_word = np.zeros((len(hit), *w["word"].shape[1:]), s.dtype) if learn else None
        for i in np.flatnonzero(count >= ALONE).tolist():
            end = first[i] + count[i]
            for lo in range(first[i], end, CHUNK):
                own = slice(lo, min(lo + CHUNK, end))
                found, by_table, by_state = _choices(
                    w["word"][hit[i]], s[own], (slice(0, self.size),), (slot[own],), sums[2:, own], shift, learn)
                logs[own] += found
                if learn:
                    back[own] += by_state
                    by_word[i] += by_table
        few = count < ALONE
        if few.any():
            place, found, totals, by_state, by_few = self._packed(s, slot, hit[few], first[few], count[few], shift, learn)
            logs[place] += found
            sums[2, place] = totals
            if learn:
                back[place] += by_state
                by_word[few] = by_few
        if not shift and len(by) and not (LEAST < sums.min() and sums.max() < MOST):
            return self._outputs(states, targets, grads, True)
        logs -= np.log(sums).sum(axis=0)
        if learn:
            grads["group"], grads["class"], grads["word"] = (slice(None), by_group), (slice(None), by_class), (hit, by_word)
        at = np.empty_like(by)
        at[by] = np.arange(len(by))
        return logs.take(at), back.take(at, axis=0) if learn else None

    def _packed(self, s: np.ndarray, slot: np.ndarray, hit: np.ndarray, first: np.ndarray, count: np.ndarray,
                shift: bool, learn: bool) -> tuple:
        """The words of classes ``hit`` in packs of PACK targets, which are the sorted ones from ``first``.

        Returns the targets' places, logits and sums, and with ``learn`` gradients by their states and by the classes' words.
        """
        n, packs, before = s.shape[1] - 1, -(-count // PACK), np.cumsum(count) - count
        start, every = np.cumsum(packs) - packs, np.arange(int(count.sum()))
        place, at = every + np.repeat(first - before, count), every + np.repeat(start * PACK - before, count)
        own = np.repeat(hit, packs)
        packed = np.zeros((len(own) * PACK, n + 1), s.dtype)
        packed[at] = s.take(place, axis=0)
        packed = packed.reshape(-1, PACK, n + 1)
        pick = np.arange(len(own) * PACK) % CHUNK * self.size  # within its chunk
        pick[at] += slot[place]
        logits, sums, ones = np.empty(len(pick), s.dtype), np.empty(len(pick), s.dtype), np.ones(self.size, s.dtype)
        if learn:
            by_state, by_pack = np.empty((len(pick), n), s.dtype), np.empty((len(own), self.size, n + 1), s.dtype)
        for a in range(0, len(own), CHUNK // PACK):
            part = slice(a, min(a + CHUNK // PACK, len(own)))
            rows = slice(part.start * PACK, part.stop * PACK)
            table = self.weights["word"].take(own[part], axis=0)
            e = packed[part] @ table.transpose(0, 2, 1)
            if shift:
                e -= e.max(axis=2, keepdims=True)
            flat = e.reshape(-1, self.size)
            logits[rows] = flat.take(pick[rows])
            np.exp(e, out=e)
            np.matmul(flat, ones, out=sums[rows])
            if learn:
                flat *= (1 / sums[rows])[:, None]
                flat.reshape(-1)[pick[rows]] -= 1
                by_state[rows] = (e @ table[:, :, :n]).reshape(-1, n)
                np.matmul(e.transpose(0, 2, 1), packed[part], out=by_pack[part])
        told = place, logits.take(at), sums.take(at)
        return *told, *((by_state.take(at, axis=0), _runs(by_pack, start)) if learn else (None, None))

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, valid: np.ndarray, h: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Negative log likelihood of the valid targets of a window, its gradients in full, and the last state."""
        loss, grads, last = self._gradients(inputs, targets, valid, h)
        full = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for k, (rows, g) in grads.items():
            full[k][rows] = g
        return loss, full, last

    def _gradients(self, inputs: np.ndarray, targets: np.ndarray, valid: np.ndarray, h: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """The same, each gradient as rows of its table that the window reaches, and their values."""
        w, n = self.weights, h.shape[1]
        grads: dict[str, tuple] = {}
        before, gates, part, new, after = self.run(inputs, h)
        rows, y, flat = _rows(after), targets.ravel(), valid.ravel()
        if flat.all():
            logs, rows = self._outputs(rows, y, grads)
        else:
            logs, found = self._outputs(rows[flat], y[flat], grads)
            rows = np.zeros_like(rows)
            rows[flat] = found
        back = _room(len(inputs), n, inputs.shape[1], h.dtype)
        back[:] = rows.reshape(*inputs.shape, n).transpose(0, 2, 1)
        z, r = gates[:, :n], gates[:, n:]
        # what each gate's gradient is of the state's, for all steps at once
        by_new = (1 - z) * (1 - new * new)
        by_z = (before - new) * z * (1 - z)
        by_r = part * r * (1 - r)
        stays = (inputs != END).astype(h.dtype)[:, None, :]
        later = np.zeros_like(after[0])
        via = _room(len(inputs), 3 * n, inputs.shape[1], h.dtype)  # gradients by what the state gives to the gates
        dnew = np.empty_like(after)
        for t in range(len(inputs) - 1, -1, -1):
            dh = np.add(back[t], later, out=back[t])
            np.multiply(dh, by_new[t], out=dnew[t])
            np.multiply(dh, by_z[t], out=via[t, :n])
            np.multiply(dnew[t], by_r[t], out=via[t, n:2 * n])
            np.multiply(dnew[t], r[t], out=via[t, 2 * n:])
            np.matmul(w["state"], via[t], out=later)
            later += dh * z[t]
            later *= stays[t]
        grads["state"] = slice(None), (before @ via.transpose(0, 2, 1)).sum(axis=0)
        via[:, 2 * n:] = dnew
        x = inputs.ravel()
        by = _sorted(x)
        x = x.take(by)
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        grads["input"] = x[first], _runs(_rows(via).take(by, axis=0), first)
        return -float(logs.sum()), grads, after[-1].T

    def update(self, grads: dict, count: int, rate: float) -> None:
        """One Adam step on the mean gradient, the smaller the fewer targets it rests on:
        a single long text that outlasts the other lanes must not turn the model to itself."""
        self.steps += 1
        scale = rate * min(1.0, count / (WINDOW * LANES)) * np.sqrt(1 - 0.999 ** self.steps) / (1 - 0.9 ** self.steps)
        for k, (rows, every) in grads.items():  # the rest of a table stays, its moments too
            table, (first, second), whole = self.weights[k], self.moments[k], isinstance(rows, slice)
            size = max(1, CACHED * len(table) // table.size)
            for a in range(0, len(every), size):
                own = slice(a, a + size) if whole else rows[a:a + size]
                g = every[a:a + size] / every.dtype.type(count)
                m, v = (x[own] if whole else x.take(own, axis=0) for x in (first, second))
                m += (g - m) * g.dtype.type(0.1)
                g *= g
                g -= v
                g *= g.dtype.type(0.001)
                v += g
                step = np.sqrt(v)
                step += g.dtype.type(SMALL)
                np.divide(m, step, out=step)
                step *= g.dtype.type(scale)
                if whole:
                    table[own] -= step
                else:
                    for x, y in ((first, m), (second, v), (table, table.take(own, axis=0) - step)):
                        x.reshape(len(x), -1)[own] = y.reshape(len(y), -1)

    def train(self, texts: list[np.ndarray], rate: float = RATE) -> None:
        for inputs, targets, valid, _, h, keep in windows(texts, self.weights["state"].shape[0], self.weights["state"].dtype, True):
            _, grads, last = self._gradients(inputs, targets, valid, h)
            self.update(grads, max(1, int(valid.sum())), rate)
            keep(last)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log likelihood of each text, its state carried over all its windows."""
        total, held, size = np.zeros(len(texts)), [], 0

        def settle() -> None:
            states, targets, owners = (np.concatenate(x) for x in zip(*held))
            total[:] += np.bincount(owners, weights=self._outputs(states, targets, None)[0], minlength=len(texts))
            held.clear()

        for inputs, targets, valid, owner, h, keep in windows(texts, self.weights["state"].shape[0], self.weights["state"].dtype):
            after = self.run(inputs, h, learn=False)[-1]
            keep(after[-1].T)
            flat = np.flatnonzero(valid)
            held.append((_rows(after).take(flat, axis=0), targets.ravel().take(flat), owner.ravel().take(flat)))
            size += len(held[-1][0])
            if size >= SCORED:
                settle()
                size = 0
        if held:
            settle()
        return total

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights[k].ravel() for k in sorted(self.weights)])

    def load(self, flat: np.ndarray) -> "Model":
        at = 0
        for k in sorted(self.weights):
            size = self.weights[k].size
            self.weights[k] = flat[at:at + size].reshape(self.weights[k].shape).astype(self.weights[k].dtype)
            at += size
        return self


def _lanes(texts: list[np.ndarray]) -> tuple[list[int], np.ndarray]:
    """Whole texts dealt to lanes of about equal length: their order, and the lanes' lengths, longest first."""
    lanes: list[list[int]] = [[] for _ in range(min(LANES, len(texts)))]
    heap = [(0, i) for i in range(len(lanes))]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        size, lane = heap[0]
        heapq.heapreplace(heap, (size + len(texts[i]), lane))
        lanes[lane].append(i)
    dealt = sorted(((sum(len(texts[i]) for i in own), own) for own in lanes), reverse=True)
    return [i for _, own in dealt for i in own], np.array([size for size, _ in dealt if size])


def windows(texts: list[np.ndarray], state: int, dtype, cut: bool = False) -> Iterator[tuple]:
    """Texts (each closed by END) end to end in lanes, WINDOW steps at a time.

    Yields inputs, targets, valid and owner (steps, lanes), the state before, and a function that
    takes the state after.  Lanes hold whole texts, and leave when they are used up; the fewer are left, the
    more steps a window has.  With ``cut``, for training, lanes are equal cuts of all texts end to end, so that
    a long text fills all lanes instead of outlasting the others.
    """
    total = sum(map(len, texts))
    if not total:
        return
    if cut:
        order, starts = range(len(texts)), np.arange(0, total, -(-total // min(LANES, len(texts))))
        lengths = np.diff(np.append(starts, total))
    else:
        order, lengths = _lanes(texts)
        starts = np.cumsum(lengths) - lengths
    every = np.concatenate([texts[i] for i in order]).astype(np.int32)
    owners = np.repeat(np.array(order), [len(texts[i]) for i in order])
    given = np.concatenate([[END], every[:-1]]).astype(np.int32)
    h, held, at = np.zeros((len(lengths), state), dtype), {}, 0
    while at < lengths[0]:
        n = int((lengths > at).sum())
        most = WINDOW if cut else max(WINDOW, WINDOW * LANES // n)
        step = np.arange(at, min(at + most, lengths[0]))[:, None]
        at += most
        valid = step < lengths[:n]
        place = (starts[:n] + step) * valid
        x, y, own = (v.take(place) * valid for v in (given, every, owners))
        yield x, y, valid, own, h[:n], lambda last: held.__setitem__("h", last)
        h = held["h"]


def word_parts(blocks: DataFrame, parts: int) -> DataFrame:
    """(part, block, hashes, counts): each block's distinct words and their training counts, 0 included."""
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                told = Tokens(*(batch[c][i].as_py() for c in ("ids", "sizes", "blob")))
                words, at = told.distinct()
                count = np.bincount(at[np.repeat(told.trained, told.lengths)], minlength=len(words))
                part, by, ends = _parted(words, parts)
                full = [p for p in range(parts) if ends[p] < ends[p + 1]]
                yield pa.record_batch([
                    pa.array(full, pa.int32()), pa.array([batch["block"][i].as_py()] * len(full), pa.int64()),
                    *[pa.array([x[by[ends[p]:ends[p + 1]]].tobytes() for p in full], pa.binary())
                      for x in (words, count.astype(np.uint32))]], names=["part", "block", "hashes", "counts"])

    return blocks.mapInArrow(cut, "part int, block bigint, hashes binary, counts binary")


def _parted(words: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = (mix(words) % np.uint64(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    return part, by, np.searchsorted(part[by], np.arange(parts + 1))


def count_words(shares: DataFrame, parts: int) -> DataFrame:
    """Answers (block, part, counts): the corpus counts of a block's share of words; and one
    row for each part (block -1) with its types, tokens, and the words offered as known."""
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for part, block, hashes, counts in zip(*(batch[c].to_pylist() for c in ("part", "block", "hashes", "counts"))):
                held.setdefault(part, []).append((block, np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.uint32)))
        for part in sorted(held):
            rows = held.pop(part)
            words, at = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
            count = np.zeros(len(words), np.int64)
            np.add.at(count, at, np.concatenate([r[2] for r in rows]))
            own = np.split(count[at], np.cumsum([len(r[1]) for r in rows])[:-1])
            some = count >= OFFERED
            n = len(rows) + 1
            yield pa.record_batch([
                pa.array([r[0] for r in rows] + [-1], pa.int64()), pa.array([part] * n, pa.int32()),
                pa.array([c.tobytes() for c in own] + [count[some].tobytes()], pa.binary()),
                pa.array([None] * len(rows) + [words[some].tobytes()], pa.binary()),
                pa.array([None] * len(rows) + [int((count > 0).sum())], pa.int64()),
                pa.array([None] * len(rows) + [int(count.sum())], pa.int64())],
                names=["block", "part", "counts", "offered", "types", "tokens"])

    return shares.repartition(parts, "part").mapInArrow(
        add, "block bigint, part int, counts binary, offered binary, types bigint, tokens bigint")


def _level(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of 64 steps for each doubling: a bounded number of values at any size."""
    return np.floor(np.log2(np.maximum(counts, 1)) * 64).astype(np.int64)


def known_words(tokens: int) -> int:
    """How many words the model knows: the table stays small beside the texts, but grows with them."""
    return max(WORDS, int(WORDS_BY_ROOT * np.sqrt(tokens)))


def _step(words: np.ndarray) -> np.ndarray:
    """A step of 65,536 by a word's hash, by which equally frequent words are parted."""
    return (mix(words ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def learn_vocabulary(answers: DataFrame, most: int | None = None) -> Vocabulary:
    """The ``most`` most frequent words; of those that tie at the bound, some by their hash."""
    offers = answers.where("block = -1")
    size = offers.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    most = known_words(size["tokens"] or 0) if most is None else most

    def counted(key, at: int | None) -> dict[int, int]:
        """How many offered words there are by ``key`` of words and counts, of all levels or one."""
        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for counts, words in zip(batch["counts"].to_pylist(), batch["offered"].to_pylist()):
                    counts, words = np.frombuffer(counts, np.int64), np.frombuffer(words, np.uint64)
                    some = slice(None) if at is None else _level(counts) == at
                    found, n = np.unique(key(words[some], counts[some]), return_counts=True)
                    yield pa.record_batch([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["at", "n"])

        rows = offers.select("counts", "offered").mapInArrow(add, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
        return {r["at"]: r["n"] for r in rows.collect()}

    least, total, cut, below = 1 << 60, 0, -1, 0
    for level, n in sorted(counted(lambda words, counts: _level(counts), None).items(), reverse=True):
        if total + n > most:
            cut = level
            break
        total, least = total + n, level
    if cut >= 0:
        for step, n in sorted(counted(lambda words, counts: _step(words), cut).items()):
            if total + n > most:
                break
            total, below = total + n, step + 1

    def chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts, words in zip(batch["counts"].to_pylist(), batch["offered"].to_pylist()):
                counts, words = np.frombuffer(counts, np.int64), np.frombuffer(words, np.uint64)
                level = _level(counts)
                some = (level >= least) | (level == cut) & (_step(words) < below)
                yield pa.record_batch([pa.array(words[some].view(np.int64)), pa.array(counts[some])], names=["word", "n"])

    rows = offers.select("counts", "offered").mapInArrow(chosen, "word bigint, n bigint").orderBy(F.desc("n"), "word").toArrow()
    return Vocabulary(rows["word"].to_numpy().astype(np.int64).view(np.uint64), rows["n"].to_numpy().astype(np.int64),
                      size["tokens"] or 0, size["types"] or 0)


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of blocks, about GROUP_BYTES of text together, so that long texts share their steps with others."""
    held, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            held.append(row)
            size += sum(row["sizes"])
            if size >= GROUP_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def train_round(blocks: DataFrame, vocabulary, flat, number: int, rounds: int) -> np.ndarray | None:
    """The token-weighted mean of the weights that all tasks reach on their training texts of this round."""
    spark = blocks.sparkSession

    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        model, seen = Model(words).load(flat.value), 0
        for rows in _grouped(batches):
            texts = []
            for row in rows:
                told = Tokens(row["ids"], row["sizes"], row["blob"], training=True)
                coded = words.encode(told.hashes)
                texts += [coded[a:b] for a, b in zip(told.bounds[:-1], told.bounds[1:])]
            model.train(texts)
            seen += sum(map(len, texts))
        if seen:
            parts = np.array_split(model.flat() * np.float32(seen), SLICES)
            yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array([float(seen)] * SLICES),
                                   pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "weight", "values"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for s, weight, values in zip(*(batch[c].to_pylist() for c in ("slice", "weight", "values"))):
                own = sums.setdefault(s, [0.0, 0.0])
                own[0] += weight
                own[1] = own[1] + np.frombuffer(values, np.float32).astype(np.float64)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([w for w, _ in sums.values()], pa.float64()),
                               pa.array([v.astype(np.float32).tobytes() for _, v in sums.values()], pa.binary())], names=["slice", "weight", "values"])

    kind = "slice int, weight double, values binary"
    own = blocks.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == number)
    spread = F.pmod(F.xxhash64("values"), F.lit(16))
    first = own.mapInArrow(train, kind).repartition(buckets(spark), "slice", spread).mapInArrow(add, kind)
    merged = sorted(first.repartition(SLICES, "slice").mapInArrow(add, kind).collect(), key=lambda r: r["slice"])
    if not merged:
        return None
    return np.concatenate([np.frombuffer(r["values"], np.float32) / np.float32(r["weight"]) for r in merged])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose id's crc32 leaves 1 modulo 5 are held out; a null id counts as
    an empty one.  Null and empty texts are one end token.  Words are told apart by
    64-bit hashes.  Without training texts both scores rest on the smoothing alone.
    Repeated rows each count and each give a row; no rows give no rows.  Base scores rest
    on counts alone; ``score`` also on which texts share a block and a task, so it moves a
    little (1 % or so) with the partitions of ``docs``.
    """
    spark = docs.sparkSession
    python_ready(spark)
    parts = buckets(spark)
    blocks = materialize(pack_blocks(docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))), "blocks")
    answers = materialize(count_words(word_parts(blocks, parts), parts), "counts")
    words = learn_vocabulary(answers)
    vocabulary = spark.sparkContext.broadcast(words)
    flat = Model(words).flat()
    for number in range(rounds):
        found = train_round(blocks, vocabulary, spark.sparkContext.broadcast(flat), number, rounds)
        flat = flat if found is None else found
    weights = spark.sparkContext.broadcast(flat.astype(np.float32))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        model = Model(known).load(weights.value)
        norm = known.tokens + 0.5 * (known.types + 1)
        for rows in _grouped(batches):
            texts, out = [], []
            for row in rows:
                told = Tokens(row["ids"], row["sizes"], row["blob"])
                own, at = told.distinct()
                _, by, ends = _parted(own, parts)
                count = np.zeros(len(own), np.int64)
                for answer in row["answers"]:
                    p = answer["part"]
                    count[by[ends[p]:ends[p + 1]]] = np.frombuffer(answer["counts"], np.int64)
                coded, first = known.encode(own), told.bounds[:-1]
                sums = lambda x: np.add.reduceat(x.take(at), first) if len(first) else np.zeros(0)
                base = sums(np.log10((count + 0.5) / norm))
                rare = sums(np.where(coded == RARE, known.rare_log10(count), 0.0))
                seen = sums((count > 0).astype(np.int64))
                tokens = coded.take(at)
                texts += [tokens[a:b] for a, b in zip(told.bounds[:-1], told.bounds[1:])]
                out += list(zip(told.ids, (~told.trained).tolist(), told.lengths.tolist(), seen.tolist(), base.tolist(), rare.tolist()))
            logs = model.score(texts) / np.log(10)
            yield pa.record_batch([
                pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out]), pa.array([o[2] for o in out], pa.int64()),
                pa.array([o[3] for o in out], pa.int64()), pa.array([known.tokens] * len(out), pa.int64()),
                pa.array([o[4] for o in out], pa.float64()), pa.array([o[5] + s for o, s in zip(out, logs.tolist())], pa.float64())],
                names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    given = answers.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("part", "counts")).alias("answers"))
    return blocks.join(given, "block").select("ids", "sizes", "blob", "answers").mapInArrow(
        score, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    ).withColumnRenamed("id", id_col)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


QUERIES = {"op5_lm_scores": op5_lm_scores}
