"""Adaptive context-mixing range coder for sequences of ids.

Ids are cut into blocks that are coded independently: every block starts with an empty
model, names its own alphabet (its distinct ids, ascending) and carries a checksum of its
ids.  Within a block an id is its place in that alphabet, which keeps every table small.
The model mixes three predictions of the next id: order 2 and order 1 name the id that last
followed the same context, with a confidence; order 0 is the distribution of the ids seen
so far in the block.  Each has a weight, its probability of a hit as counted so far in the
block, for each pair of confidences and by whether the two agree.  The three weighted
predictions share out the range of one arithmetic coding step,

    [ w2: order 2's id | w1: order 1's id | w0: order 0 over all ids ]

and an id is coded by the first share that predicts it.  Counts adapt at fixed steps, the
named ids at every step.  All arithmetic is in integers, so that any machine decodes what
any other has encoded.  Many blocks are coded in lockstep, one vector lane for each; what a
lane does depends on its own block alone.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 8192
LANES = 2048
MAGIC = b"TLB2"
_HEADER = struct.Struct("<4sIIII")  # magic, ids, distinct ids, checksum of the ids, bytes of alphabet and payload

_MIX = 12  # bits of a weight
_PAIRS = 4096  # slots of the order-2 table
_STATES = 32  # pairs of confidences, and whether the two guesses agree
_REFRESH = (32, 64, 128, 256, 512, 1024, 1536, 2048, 3072, 4096, 6144)  # steps at which weights and order 0 are brought up to date
_GAP = max(b - a for a, b in zip((0, *_REFRESH), _REFRESH))
_SCALE, _WIDE = 13, 15  # bits of order 0's total: for blocks of at most 1 << 11 distinct ids, for others
_WORD, _LEAST = np.uint64(32), np.uint64(1 << 32)
_U = np.uint64
# what is taken for granted before the first id: tries and hits of each state
_AGREE, _SURE1, _SURE2 = np.arange(_STATES) & 1, np.arange(_STATES) >> 1 & 3, np.arange(_STATES) >> 3
_TRIES = 12
_HITS2 = np.array([1, 4, 8, 10])[_SURE2] + _AGREE
_HITS1 = np.array([1, 3, 5, 7])[_SURE1]


class _Model:
    """The models of many blocks; a lane for each, whose alphabet has ``sizes[lane]`` ids.

    ``lookup`` keeps the table from places in order 0 to ids, which decoding alone needs.
    """

    def __init__(self, sizes: np.ndarray, lookup: bool) -> None:
        lanes = len(sizes)
        row = np.arange(lanes, dtype=np.int64)
        self.sizes, self.bits = sizes, np.where(sizes <= 1 << 11, _SCALE, _WIDE).astype(np.int32)
        self.base = np.cumsum(sizes) - sizes  # of a lane's alphabet in the flat tables
        self.places = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(self.base, sizes)
        self.counts = np.zeros(len(self.places), dtype=np.uint16)
        totals = 1 << self.bits.astype(np.int64)
        self.slot_base = np.cumsum(totals) - totals
        self.one_base, self.pair_base, self.state_base = self.base + row, row * _PAIRS, row * _STATES
        # an entry is (guess << 2) | confidence; order 1 has one more context, the start
        self.one = np.zeros(len(self.places) + lanes, dtype=np.uint16)
        self.pair = np.zeros(lanes * _PAIRS, dtype=np.uint16)
        self.tries = np.full(lanes * _STATES, _TRIES, dtype=np.int64)
        self.hits2, self.hits1 = (np.tile(h, lanes).astype(np.int64) for h in (_HITS2, _HITS1))
        self.last, self.before = sizes.astype(np.int64), sizes.astype(np.int64)
        self.shown = np.zeros(len(self.places), dtype=np.uint32)
        self.weigh()
        self.refresh(lanes, 0, lookup)

    def refresh(self, n: int, step: int, lookup: bool) -> None:
        """Order 0 of the first ``n`` lanes after ``step`` ids: every id of the alphabet keeps a share, the total is a power of two."""
        sizes, held = self.sizes[:n], int(self.sizes[:n].sum())
        places = self.places[:held]
        room = np.repeat((1 << self.bits[:n].astype(np.int64)) - sizes, sizes)
        # before the first id all are alike
        seen = np.cumsum(self.counts[:held], dtype=np.int64) - np.repeat(np.arange(n, dtype=np.int64) * step, sizes) if step else places + 1
        upper = places + 1 + seen * room // (step or np.repeat(sizes, sizes))
        lower = np.zeros(held, dtype=np.int64)
        lower[1:] = upper[:-1]
        lower[self.base[:n]] = 0
        self.shown[:held] = lower << 16 | (upper - lower)  # (cumulative, frequency)
        if lookup:
            self.lookup = np.repeat(places.astype(np.uint16), upper - lower)

    def weigh(self) -> None:
        """The shares of both guesses and order 0's weight for each lane and state; where both agree there is one guess."""
        w2 = ((self.hits2 << _MIX) // self.tries).clip(1, (1 << _MIX) - 32)
        # order 1 is asked where order 2 missed, besides the tries taken for granted
        missed = self.tries - self.hits2 + np.tile(_HITS2, len(self.sizes))
        w1 = (((1 << _MIX) - w2) * self.hits1 // missed).clip(1) * np.tile(1 - _AGREE, len(self.sizes))
        bits = np.repeat(self.bits, _STATES).astype(np.int64)
        self.share2, self.both = (w2 << bits).astype(np.uint32), ((w2 + w1) << bits).astype(np.uint32)
        self.rest = ((1 << _MIX) - w2 - w1).astype(np.uint32)

    def predict(self, n: int) -> None:
        """Guesses and shares of the first ``n`` lanes."""
        last = self.last[:n]
        self.slot1 = self.one_base[:n] + last
        self.slot2 = self.pair_base[:n] + (self.before[:n] * 61 + last & (_PAIRS - 1))
        self.entry1, self.entry2 = self.one.take(self.slot1), self.pair.take(self.slot2)
        self.guess1, self.guess2 = self.entry1 >> 2, self.entry2 >> 2
        self.sure1, self.sure2 = self.entry1 & 3, self.entry2 & 3
        self.state = self.state_base[:n] + (self.sure2 << 3 | self.sure1 << 1 | (self.guess1 == self.guess2))
        self.upto2, self.upto1, self.w0 = self.share2.take(self.state), self.both.take(self.state), self.rest.take(self.state)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cumulative, frequency) of each lane's id."""
        self.right2, self.same1 = ids == self.guess2, ids == self.guess1
        return self._edges(ids, self.same1 & ~self.right2)

    def find(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id in whose share each lane's target lies, and its interval."""
        other = self.lookup.take((target - self.upto1) // self.w0 + self.slot_base[: len(target)], mode="clip")
        self.right2 = target < self.upto2
        right1 = (target < self.upto1) ^ self.right2
        ids = np.where(self.right2, self.guess2, np.where(right1, self.guess1, other)).astype(np.int64)
        self.same1 = ids == self.guess1
        return ids, *self._edges(ids, right1)

    def _edges(self, ids: np.ndarray, right1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.shown.take(self.base[: len(ids)] + ids, mode="clip")
        start, width = self.upto1 + self.w0 * (own >> 16), self.w0 * (own & 0xFFFF)
        np.copyto(start, self.upto2, where=right1)
        np.copyto(width, self.upto1 - self.upto2, where=right1)
        np.copyto(start, 0, where=self.right2)
        np.copyto(width, self.upto2, where=self.right2)
        return start.astype(np.uint64), width.astype(np.uint64)

    def update(self, ids: np.ndarray) -> None:
        entry = ids.astype(np.uint16) << 2
        self.pair[self.slot2] = np.where(self.right2, self.entry2 + (self.sure2 < 3), entry)
        self.one[self.slot1] = np.where(self.same1, self.entry1 + (self.sure1 < 3), entry)
        self.before, self.last = self.last, ids

    def learn(self, ids: np.ndarray, marks: np.ndarray, step: int, lookup: bool) -> None:
        """Brings weights and order 0 up to date after ``step`` ids.

        ``ids`` and ``marks`` (steps x lanes) are those since it was last; a mark is (state << 2) | same as order 1's | same as order 2's.
        """
        n = ids.shape[1]
        self.counts += np.bincount((self.base[:n] + ids).ravel(), minlength=len(self.counts)).astype(np.uint16)
        seen = np.bincount(marks.ravel(), minlength=4 * len(self.tries)).reshape(-1, 4)
        self.tries += seen.sum(axis=1)
        self.hits2 += seen[:, 1] + seen[:, 3]
        self.hits1 += seen[:, 2]
        self.weigh()
        self.refresh(n, step, lookup)

    def mark(self) -> np.ndarray:
        return self.state << 2 | self.same1 << 1 | self.right2


def _running(lengths: np.ndarray) -> list[int]:
    """For each step the number of lanes that still run; lengths never grow."""
    return np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left").tolist()


def _encode_lanes(ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """``ids`` (lanes x longest, places in the lanes' alphabets) with lengths that never grow from lane to lane."""
    lanes = len(lengths)
    model = _Model(sizes, lookup=False)
    shift = (model.bits + _MIX).astype(np.uint64)
    low, reach = np.zeros(lanes, dtype=np.uint64), np.full(lanes, ~_U(0), dtype=np.uint64)
    # a step adds a word at most
    out = np.zeros((lanes, 2304), dtype=np.uint32)
    size = np.zeros(lanes, dtype=np.int64)
    columns = np.ascontiguousarray(ids.T)
    marks, last = np.zeros((_GAP, lanes), dtype=np.int32), 0
    for step, n in enumerate(_running(lengths)):
        if not step % 256 and int(size.max()) + 260 > out.shape[1]:
            out = np.concatenate([out, np.zeros((lanes, 1024), dtype=np.uint32)], axis=1)
        if step in _REFRESH:
            model.learn(columns[last:step, :n], marks[: step - last, :n], step, False)
            last = step
        now = columns[step, :n].astype(np.int64)
        model.predict(n)
        start, width = model.interval(now)
        unit = reach[:n] >> shift[:n]
        moved = low[:n] + start * unit
        over = np.flatnonzero(moved < low[:n])
        if len(over):
            _carry(out, over, size[over] - 1)
        low[:n] = moved
        reach[:n] = width * unit
        go = np.flatnonzero(reach[:n] < _LEAST)
        if len(go):
            held = low[go]
            out[go, size[go]] = held >> _WORD
            size[go] += 1
            low[go] = held << _WORD
            reach[go] <<= _WORD
        if step < _REFRESH[-1]:
            marks[step - last, :n] = model.mark()
        model.update(now)
    for k in (32, 0):
        out[np.arange(lanes), size] = (low >> _U(k)) & _U(0xFFFFFFFF)
        size += 1
    return [out[i, : size[i]].astype("<u4").tobytes() for i in range(lanes)]


def _carry(out: np.ndarray, lanes: np.ndarray, at: np.ndarray) -> None:
    """Adds one to a lane's last word, and to those before it as long as a word was full."""
    while len(lanes):
        out[lanes, at] += np.uint32(1)
        full = out[lanes, at] == 0
        lanes, at = lanes[full], at[full] - 1


def _decode_lanes(payloads: list[bytes], lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    lanes = len(lengths)
    stride = max(len(p) for p in payloads) // 4 + 3
    words = np.zeros((lanes, stride), dtype=np.uint64)
    for i, p in enumerate(payloads):
        words[i, : len(p) // 4] = np.frombuffer(p, dtype="<u4", count=len(p) // 4)
    model = _Model(sizes, lookup=True)
    shift = (model.bits + _MIX).astype(np.uint64)
    most = (_U(1) << shift) - _U(1)
    # the target's distance from the lower end of the interval
    code, reach = words[:, 0] << _WORD | words[:, 1], np.full(lanes, ~_U(0), dtype=np.uint64)
    at, ends = np.arange(lanes, dtype=np.int64) * stride + 2, np.arange(1, lanes + 1, dtype=np.int64) * stride - 1
    flat = words.ravel()
    ids = np.zeros((int(lengths[0]), lanes), dtype=np.uint16)
    marks, last = np.zeros((_GAP, lanes), dtype=np.int32), 0
    for step, n in enumerate(_running(lengths)):
        if step in _REFRESH:
            model.learn(ids[last:step, :n], marks[: step - last, :n], step, True)
            last = step
        model.predict(n)
        unit = reach[:n] >> shift[:n]
        now, start, width = model.find(np.minimum(code[:n] // unit, most[:n]).astype(np.uint32))
        ids[step, :n] = now
        code[:n] -= start * unit
        reach[:n] = width * unit
        go = np.flatnonzero(reach[:n] < _LEAST)
        if len(go):
            place = at[go]
            code[go] = code[go] << _WORD | flat[np.minimum(place, ends[go])]
            at[go] = place + 1
            reach[go] <<= _WORD
        if step < _REFRESH[-1]:
            marks[step - last, :n] = model.mark()
        model.update(now)
    return ids.T


def _pack_alphabet(ids: np.ndarray) -> bytes:
    """Ascending distinct ids as differences, seven bits to a byte, the last byte of each without its high bit."""
    gaps = np.diff(ids.astype(np.int64), prepend=0)
    parts = np.stack([gaps >> 7 * k & 0x7F for k in range(5)], axis=1)
    more = np.stack([gaps >> 7 * (k + 1) > 0 for k in range(5)], axis=1)
    used = np.concatenate([np.ones((len(gaps), 1), dtype=bool), more[:, :4]], axis=1)
    return (parts | more << 7)[used].astype(np.uint8).tobytes()


def _unpack_alphabet(data: bytes, count: int) -> tuple[np.ndarray, int]:
    """The ids and the bytes they take; ValueError if there are not ``count``."""
    raw = np.frombuffer(data, dtype=np.uint8, count=min(len(data), 5 * count)).astype(np.int64)
    ends = np.flatnonzero(raw < 0x80)[:count]
    if len(ends) < count or not count:
        if count:
            raise ValueError("a block's alphabet is cut short")
        return np.zeros(0, dtype=np.int64), 0
    raw = raw[: ends[-1] + 1]
    first = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, ends - first + 1)
    return np.cumsum(np.add.reduceat((raw & 0x7F) << 7 * np.minimum(place, 5), first)), len(raw)


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """Blocks of ``ids`` (each under ``vocabulary``), one after another."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError("an id is not in the vocabulary")
    out = []
    for first in range(0, len(ids), BLOCK * LANES):
        part = ids[first : first + BLOCK * LANES]
        blocks = [part[s : s + BLOCK] for s in range(0, len(part), BLOCK)]
        table = np.zeros((len(blocks), BLOCK), dtype=np.uint16)
        alphabets = []
        # which ids a block holds, and their places, by a table over the vocabulary: no sorting
        place = np.zeros(vocabulary, dtype=np.uint16)
        for i, own in enumerate(blocks):
            seen = np.zeros(vocabulary, dtype=bool)
            seen[own] = True
            alphabets.append(np.flatnonzero(seen))
            place[alphabets[-1]] = np.arange(len(alphabets[-1]), dtype=np.uint16)
            table[i, : len(own)] = place[own]
        lengths = np.array([len(b) for b in blocks], dtype=np.int64)
        sizes = np.array([len(a) for a in alphabets], dtype=np.int64)
        for own, alphabet, payload in zip(blocks, alphabets, _encode_lanes(table[:, : int(lengths[0])], lengths, sizes), strict=True):
            names = _pack_alphabet(alphabet)
            out += [_HEADER.pack(MAGIC, len(own), len(alphabet), zlib.crc32(own.tobytes()), len(names) + len(payload)), names, payload]
    return b"".join(out)


def decode(data: bytes) -> np.ndarray:
    """The ids (uint32) of blocks as ``encode`` made them; ValueError if a block is damaged."""
    blocks, at = [], 0
    while at < len(data):
        if len(data) - at < _HEADER.size or data[at : at + 4] != MAGIC:
            raise ValueError("not a block")
        _, n, distinct, check, size = _HEADER.unpack_from(data, at)
        at += _HEADER.size
        if not 0 < distinct <= n <= BLOCK or len(data) - at < size:
            raise ValueError("a block's header does not hold")
        alphabet, used = _unpack_alphabet(data[at : at + size], distinct)
        blocks.append((n, alphabet, check, data[at + used : at + size]))
        at += size
    out = []
    for first in range(0, len(blocks), LANES):
        group = blocks[first : first + LANES]
        order = sorted(range(len(group)), key=lambda i: -group[i][0])
        table = _decode_lanes([group[i][3] for i in order], np.array([group[i][0] for i in order], dtype=np.int64), np.array([len(group[i][1]) for i in order], dtype=np.int64))
        back = {i: k for k, i in enumerate(order)}
        for i, (n, alphabet, check, _) in enumerate(group):
            own = alphabet[np.minimum(table[back[i], :n], len(alphabet) - 1)].astype("<u4")
            if zlib.crc32(own.tobytes()) != check:
                raise ValueError(f"checksum of block {first + i} does not match")
            out.append(own)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)
