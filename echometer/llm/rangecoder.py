"""Adaptive range coder for token ids, many independent blocks side by side.

A block starts from a fresh model. For each id, the ids that last followed its two and its one predecessors
are predicted; whether a prediction holds has a probability that mixes two adaptive estimates, one for the
confidence of each prediction, and both answers are coded as one symbol of three: the longer, the shorter or none.
An id that no prediction meets is coded as four half-bytes, each from an adaptive distribution for the half-bytes
before it (order 0), two of them at a time. All symbols go through one range coder with a range of 32 to 48 bits,
16-bit words and carries. Blocks don't depend on each other, so numpy codes one id of every block at a time; encoder
and decoder run the same model. The more blocks are given at once, the less a step costs each, up to ``LANES``.

In every table the lanes lie side by side, so a step reads neighbouring memory, and items are as narrow as they can
be. Lanes whose id was predicted code their half-bytes from an idle row with one symbol of probability one.
"""

from __future__ import annotations

import numpy as np

#: Ids of a block; the last block of a run has fewer.
BLOCK = 4096
#: Blocks coded side by side at most.
LANES = 3072

_BITS = 15
_ONE = 1 << _BITS
#: A range below this bound grows by a word of 16 bits.
_LEAST, _WORD = 32, 16
_BOUND = float(1 << _LEAST)
#: Contexts of a prediction, as bits of a hash.
_CONTEXTS = 11
_RATE = 5
#: Confidences: none yet, then 1 to 8.
_SURES = 9
#: Targets of a probability of a prediction; their distance from 0 and 1 leaves every symbol a part of the range.
_UNLIKELY, _LIKELY = 256, _ONE - 256
#: A row has the lower bounds of 16 half-bytes. First row of each half-byte; the last has its rows by a hash.
_ROW_STARTS = (0, 1, 17, 273)
_HASHED = 10
#: The idle row, whose number has all bits of any row's.
_IDLE = (1 << 11) - 1
_FRESH = (np.arange(16) * (_ONE // 16)).astype(np.int16)
#: What a row moves to after each half-byte.
_TARGETS = (np.where(np.arange(16) > np.arange(16)[:, None], _ONE - 16, 0) + np.arange(16)).astype(np.int16)
#: Rows are read and written as single items of their 32 bytes.
_ROW = np.dtype("V32")
#: Next confidence, above an id's 16 bits, after a wrong and a right prediction.
_WRONG, _RIGHT = ([max(1, s + 1 >> 1) for s in range(_SURES)], [min(s + 1, _SURES - 1) for s in range(_SURES)])
_NEXT = np.array(_WRONG + _RIGHT, np.uint32) << 16
#: Targets of both estimates and which of them move, by the coded symbol and whether the predictions differ.
_GOALS = [[_LIKELY, _UNLIKELY], [_UNLIKELY, _LIKELY], [_UNLIKELY, _UNLIKELY]] * 2
_GOALS = np.array(_GOALS, np.int16).view(np.uint32).ravel()
_MOVES = np.array([[-1, 0]] * 3 + [[-1, 0], [-1, -1], [-1, -1]], np.int16).view(np.uint32).ravel()


class _Coder:
    """What encoder and decoder share: the model of all lanes and its steps. Ranges are whole numbers below
    2 ** 49 in floats, so that all arithmetic on them is exact."""

    def __init__(self, lanes: int) -> None:
        self.lanes = lanes
        rows = np.empty((_IDLE + 1, lanes, 16), np.int16)
        rows[: _ROW_STARTS[3] + (1 << _HASHED)] = _FRESH
        rows[_IDLE] = 0
        self.rows = rows.reshape(-1).view(_ROW)
        self.targets = _TARGETS.reshape(-1).view(_ROW)
        # Predicted id (16 bits) and confidence of each context: of two ids, then of one.
        self.known = np.zeros((2 << _CONTEXTS) * lanes, np.uint32)
        # Both predictions' estimates, by the confidence of the longer, then of the shorter context.
        self.chances = np.full((2 * _SURES * lanes, 2), _ONE // 4, np.int16).view(np.uint32).ravel()
        self.range = np.full(lanes, _BOUND * (1 << _WORD))
        self.last = np.zeros(lanes, np.uint16)
        self.older = np.zeros(lanes, np.uint16)
        self.narrow_to(lanes)

    def narrow_to(self, lanes: int) -> None:
        """Go on with the first lanes alone; the others have ended."""
        self.live = lanes
        self.range, self.last, self.older = self.range[:lanes], self.last[:lanes], self.older[:lanes]
        self.own = np.arange(lanes)
        # Bounds of one half-byte, with a zero after the last row, as the next row would start.
        self.bounds = np.zeros(lanes * 16 + 16, np.int16)
        self.row = self.bounds[:-16].view(_ROW)
        self.moved = np.empty(lanes, _ROW)
        self.places = np.arange(lanes) * 16
        self.cuts = np.zeros((4, lanes))
        self.cuts[3] = _ONE
        self.of_known = self.own + np.array([[0], [self.lanes << _CONTEXTS]])
        self.of_chance = self.own + np.array([[0], [_SURES * self.lanes]])
        self.hashes = np.empty((2, lanes), np.uint16)

    def predict(self) -> None:
        """Predictions, their confidence, and the bounds of the symbol that says which one holds."""
        hashes = self.hashes
        np.multiply(self.older, 40_503, out=hashes[0])
        hashes[0] += self.last * np.uint16(30_011)
        np.multiply(self.last, 25_717, out=hashes[1])
        hashes >>= 16 - _CONTEXTS
        self.at = hashes * np.int64(self.lanes)
        self.at += self.of_known
        self.entries = self.known.take(self.at)
        parts = self.entries.view(np.uint16).reshape(2, self.live, 2)
        self.predicted, self.sure = parts[:, :, 0], parts[:, :, 1]
        self.chance_at = self.sure * np.int64(self.lanes)
        self.chance_at += self.of_chance
        self.chance = self.chances.take(self.chance_at).view(np.int16).reshape(2, -1)
        mixed = self.chance >> 1
        mixed = mixed[0] + mixed[1]
        self.differ = self.predicted[0] != self.predicted[1]
        cuts = self.cuts
        cuts[1] = mixed[::2]
        rest = _ONE - cuts[1]
        rest *= mixed[1::2]
        rest *= 1 / _ONE
        np.floor(rest, out=rest)
        # The shorter one is not asked where it predicts the same id.
        rest *= self.differ
        np.add(cuts[1], rest, out=cuts[2])

    def part(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each lane's symbol of three."""
        at = symbol * np.int64(self.live)
        at += self.own
        start = self.cuts.take(at)
        at += self.live
        return start, self.cuts.take(at) - start

    def learn(self, symbol: np.ndarray, ids: np.ndarray) -> None:
        """Move estimates and known ids."""
        case = (symbol + self.differ.view(np.uint8) * np.uint8(3)).astype(np.int64)
        step = _GOALS.take(case).view(np.int16) - self.chance
        step >>= _RATE
        step &= _MOVES.take(case).view(np.int16)
        step += self.chance
        self.chances[self.chance_at] = step.view(np.uint32)
        case = (self.predicted == ids) * np.uint16(_SURES)
        case += self.sure
        entries = self.entries
        entries &= 0xFFFF
        entries |= _NEXT.take(case)
        # A prediction is replaced once nothing speaks for it.
        np.copyto(entries, ids | np.uint32(1 << 16), where=case <= 2)
        self.known[self.at] = entries
        self.older, self.last = self.last, ids

    def read_row(self, row: np.ndarray) -> np.ndarray:
        """Read each lane's row for a half-byte; its place in the table."""
        at = row * np.int64(self.lanes)
        at += self.own
        self.rows.take(at, out=self.row, mode="clip")
        return at

    def part_of_row(self, symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each lane's half-byte in its row, which then moves to it."""
        places = self.places + symbol
        start = self.bounds.take(places)
        places += 1
        size = self.bounds.take(places)
        size -= start
        size -= 1
        size &= _ONE - 1
        self.targets.take(symbol, out=self.moved, mode="clip")
        step, bounds = self.moved.view(np.int16), self.bounds[:-16]
        step -= bounds
        step >>= _RATE
        step += bounds
        np.put(self.rows, at, self.moved)
        return start.astype(np.float64), size + 1.0


def _hashed(prefix: np.ndarray) -> np.ndarray:
    """Row of the last half-byte, by the three before it."""
    return (prefix * np.uint16(40_503) >> 16 - _HASHED) + np.uint16(_ROW_STARTS[3])


class _Encoder(_Coder):
    def __init__(self, lanes: int, words: int) -> None:
        super().__init__(lanes)
        # Words with their carries, which reach the words before only in the end.
        self.out = np.zeros((words, lanes), np.uint32)
        self.flat = self.out.reshape(-1)
        self.low = np.zeros(lanes)
        self.next = np.arange(lanes)

    def _narrow(self, start: np.ndarray, size: np.ndarray, bits: int) -> None:
        live = self.live
        unit = self.range * 0.5**bits
        np.floor(unit, out=unit)
        low = self.low[:live]
        np.multiply(unit, size, out=self.range)
        unit *= start
        low += unit
        full = np.flatnonzero(self.range < _BOUND)
        while len(full):
            leaving = low[full].astype(np.int64)
            at = self.next[full]
            self.flat[at] = (leaving >> _LEAST).astype(np.uint32)
            at += self.lanes
            self.next[full] = at
            leaving &= (1 << _LEAST) - 1
            leaving <<= _WORD
            low[full] = leaving
            grown = self.range[full] * (1 << _WORD)
            self.range[full] = grown
            full = full[grown < _BOUND]

    def step(self, ids: np.ndarray) -> None:
        """Code the next id of every live lane."""
        self.predict()
        right = self.predicted == ids
        hit = right[0] | right[1]
        symbol = np.uint8(2) - hit.view(np.uint8) - right[0].view(np.uint8)
        self._narrow(*self.part(symbol), _BITS)
        idle = hit * np.uint16(_IDLE)
        # All half-bytes are 15 where a prediction holds.
        coded = ids | -hit.astype(np.uint16)
        rows = [(ids >> (16 - 4 * k)) + np.uint16(_ROW_STARTS[k]) for k in (1, 2)]
        rows = (idle, *rows, _hashed(ids >> 4))
        for half in (0, 2):
            parts = []
            for k in (half, half + 1):
                at = self.read_row(rows[k] | idle)
                parts += self.part_of_row((coded >> (12 - 4 * k) & 15).astype(np.int64), at)
            start, size, inner, own = parts
            start *= _ONE
            inner *= size
            start += inner
            size *= own
            self._narrow(start, size, 2 * _BITS)
        self.learn(symbol, ids)

    def finish(self) -> list[bytes]:
        low = self.low.astype(np.int64)
        for shift in (_LEAST, _WORD, 0):
            self.flat[self.next] = low >> shift
            self.next += self.lanes
            low &= (1 << shift) - 1
        ends = self.next // self.lanes
        out = self.out[: ends.max()]
        while (carry := out >> _WORD).any():
            out &= (1 << _WORD) - 1
            out[:-1] += carry[1:]
        words = np.ascontiguousarray(out.T, "<u2")
        return [row[:end].tobytes() for row, end in zip(words, ends)]


class _Decoder(_Coder):
    def __init__(self, data: list[bytes]) -> None:
        super().__init__(len(data))
        longest = max(len(d) for d in data) // 2 + 1
        words = np.zeros((len(data), longest), np.uint16)
        for row, d in zip(words, data):
            row[: len(d) // 2] = np.frombuffer(d, "<u2")
        self.code = words[:, :3] @ np.array([1 << 32, 1 << 16, 1.0])
        self.words = np.ascontiguousarray(words.T).reshape(-1)
        self.next = np.arange(len(data)) + 3 * len(data)

    def _narrow(self, unit: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        code = self.code[: self.live]
        np.multiply(unit, size, out=self.range)
        unit *= start
        code -= unit
        full = np.flatnonzero(self.range < _BOUND)
        while len(full):
            at = self.next[full]
            code[full] = code[full] * (1 << _WORD) + self.words.take(at, mode="clip")
            at += self.lanes
            self.next[full] = at
            grown = self.range[full] * (1 << _WORD)
            self.range[full] = grown
            full = full[grown < _BOUND]

    def _reached(self, place: np.ndarray) -> np.ndarray:
        """The half-byte of each lane whose part of its row holds ``place``."""
        wanted = place.astype(np.int64)
        wanted *= 0x0001000100010001
        reached = self.bounds[:-16] <= np.repeat(wanted, 4).view(np.int16)
        counts = np.bitwise_count(reached.view(np.uint64))
        symbol = np.add(counts[::2], counts[1::2], dtype=np.int64)
        symbol -= 1
        return symbol

    def step(self) -> np.ndarray:
        """The next id of every live lane."""
        self.predict()
        code = self.code[: self.live]
        unit = self.range * 0.5**_BITS
        np.floor(unit, out=unit)
        hit = code < unit * self.cuts[2]
        first = code < unit * self.cuts[1]
        symbol = np.uint8(2) - hit.view(np.uint8) - first.view(np.uint8)
        self._narrow(unit, *self.part(symbol))
        idle = hit * np.uint16(_IDLE)
        value = np.zeros(self.live, np.uint16)
        for half in (0, 2):
            unit = self.range * 0.5 ** (2 * _BITS)
            np.floor(unit, out=unit)
            # Whole numbers below 2 ** 49: a rounded quotient never reaches the next whole number.
            place = code / unit
            np.floor(place, out=place)
            np.minimum(place, _ONE * _ONE - 1, out=place)
            row = value + np.uint16(_ROW_STARTS[half])
            at = self.read_row(row | idle)
            upper = self._reached(place * (1 / _ONE))
            start, size = self.part_of_row(upper, at)
            start *= _ONE
            place -= start
            place /= size
            value <<= 4
            value |= upper.astype(np.uint16)
            row = _hashed(value) if half else value + np.uint16(_ROW_STARTS[1])
            at = self.read_row(row | idle)
            lower = self._reached(place)
            inner, own = self.part_of_row(lower, at)
            inner *= size
            start += inner
            size *= own
            value <<= 4
            value |= lower.astype(np.uint16)
            self._narrow(unit, start, size)
        ids = np.where(hit, np.where(first, self.predicted[0], self.predicted[1]), value)
        self.learn(symbol, ids)
        return ids


def _groups(lengths: np.ndarray) -> list[np.ndarray]:
    """Numbers of the blocks that are coded side by side, longest first."""
    order = np.argsort(-lengths, kind="stable")
    return [order[first : first + LANES] for first in range(0, len(order), LANES)]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Coded bytes of each block of ids below 2 ** 16."""
    out: list[bytes] = [b""] * len(blocks)
    lengths = np.array([len(b) for b in blocks], np.int64)
    for group in _groups(lengths):
        sizes = lengths[group]
        # Five symbols of at most 15 bits each per id, and the last state.
        coder = _Encoder(len(group), 5 * int(sizes[0]) + 4)
        ids = np.zeros((len(group), int(sizes[0])), np.uint16)
        for row, block in zip(ids, group):
            row[: lengths[block]] = blocks[block]
        ids = np.ascontiguousarray(ids.T)
        for t, live in enumerate(np.searchsorted(-sizes, -np.arange(sizes[0]), side="left").tolist()):
            if live < coder.live:
                coder.narrow_to(live)
            coder.step(ids[t, :live])
        for block, coded in zip(group, coder.finish()):
            out[block] = coded
    return out


def decode_blocks(data: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """Ids of each coded block of the given length."""
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(data)
    every = np.array(lengths, np.int64)
    for group in _groups(every):
        sizes = every[group]
        coder = _Decoder([data[k] for k in group])
        ids = np.zeros((int(sizes[0]), len(group)), np.uint16)
        for t, live in enumerate(np.searchsorted(-sizes, -np.arange(sizes[0]), side="left").tolist()):
            if live < coder.live:
                coder.narrow_to(live)
            ids[t, :live] = coder.step()
        for row, block in zip(np.ascontiguousarray(ids.T), group):
            out[block] = row[: every[block]]
    return out
