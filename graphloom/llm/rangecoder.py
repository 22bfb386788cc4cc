"""Adaptive context-mixing range coder for token ids, over many blocks in step.

A block is coded on its own: all models start anew, so blocks can be read in any
order and a damaged one harms no other. Its ids are cut into STREAMS stretches,
which are coded side by side and share the block's models. Each id is foretold by
three orders:

* order 2: two ids that followed the last two ids, each with a count;
* order 1: two ids that followed the last id, each with a count;
* order 0: frequencies of the ids that no other order foretold; ids that are new
  to the block are spelled out.

Each order is a distribution over its ids, and the coded probabilities are those
of their mixture: sum of weight(order) * p(order, id), so an id that two orders
foretell gets the mass of both. The weights are kept for each pair of states (the
counts of order 2 and of order 1) and learned by expectation maximisation: each
coded id adds to the orders that foretold it in proportion to their mass.

Candidates of order 2 and order 1 are brought up to date at every step, weights and
order 0 after some steps (an epoch). A step codes one id of each stretch, of all
stretches of a group of blocks, with whole numpy arrays; writing and reading do
the same, and what is known of an id is narrowed to in one go: the interval of its
order and, within it, the one of order 0.

The coder has a 64-bit low and range and emits 16-bit words, so that a range never
falls below 2^48; a carry is added to the word before and ripples at the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

#: Ids of a block at most, stretches of a block at most and least ids of one, blocks coded in step.
BLOCK, STREAMS, LEAST, GROUP = 65536, 64, 256, 128
#: log2 of the slots of order 2 and order 1, and of the totals of the mixture and of order 0. A block has fewer ids than half of the last.
SLOTS2, SLOTS1, MIX, TOTAL0 = 15, 13, 16, 17
#: Steps of an epoch: half of all before, within these.
EPOCH = (2, 128)
#: Levels of an id in a slot, 3 at most.
LEVELS = 2
#: Ids that the weights of a pair of states remember.
MEMORY = 600.0
MAGIC = b"GLCM\x03"

_ID = (1 << 24) - 1
#: Marks of missing candidates: the first and second of order 2, and of order 1. None equals another or an id.
_MISSING = [(_ID, _ID - 1), (_ID - 2, _ID - 3)]
#: An interval of order 0 lies in one of the mixture.
_BOTH, _TOTAL0, _LOW16, _LOW32 = np.uint64(MIX + TOTAL0), np.uint64(TOTAL0), np.uint64(0xFFFF), np.uint64(0xFFFFFFFF)
_16, _32, _48 = np.uint64(16), np.uint64(32), np.uint64(48)
_FOUR = np.uint64(0x0001000100010001)
_FULL = np.uint64(1 << 48)
_1 = np.uint64(1)


def _states() -> tuple[int, np.ndarray, np.ndarray]:
    """States of a slot, and what a slot is combined with by exclusive or: what changes of its state and, as a mask, of its ids, for each right candidate (a bit each: the first and second of order 2, and of order 1) and each state.

    0 is an empty slot; other states are the levels of the two ids, 1 to LEVELS and
    0 (no second id) to LEVELS. A right id rises, the other falls, to 2 at least if
    it has more. If neither is right, the lesser falls, or makes room for the new
    id from 1.
    """
    state = lambda a, b: 1 + (a - 1) * (LEVELS + 1) + b
    first, second = _ID, _ID << 24
    change = np.zeros((3, 16), np.int64)  # the first is right, the second, neither
    change[2, 0] = state(1, 0) << 48 | first
    for a in range(1, LEVELS + 1):
        for b in range(LEVELS + 1):
            s, low = state(a, b), lambda x: x - (x > 2)
            lesser = (low(a), b - 1, 0) if 1 < b <= a else (a - 1, low(b), 0) if 1 < a < b else (low(a), 1, second) if b <= a else (1, low(b), first)
            for outcome, (c, d, mask) in enumerate([(min(LEVELS, a + 1), low(b), 0), (low(a), min(LEVELS, b + 1), 0), lesser]):
                change[outcome, s] = (s ^ state(c, d)) << 48 | mask
    of = lambda yes, no: change[[0 if c & yes else 1 if c & no else 2 for c in range(16)]].reshape(-1)
    return state(LEVELS, LEVELS) + 1, of(1, 2), of(4, 8)


STATES, _CHANGE2, _CHANGE1 = _states()
_STATE = -1 << 48
#: Patterns of the mixture: for each candidate of order 1, whether it is the first or second of order 2; both can't be the same one.
#: For each of the 9 and each of the four candidates, the candidate whose interval holds its mass.
_HOLDER = {3 * r + q: [0, 1, {0: 2, 1: 0, 2: 1}[r], {0: 3, 1: 0, 2: 1}[q]] for r in range(3) for q in range(3) if not r or r != q}
#: The first of the four candidates that is right, by a bit for each; 4: none. And the bits, times 16, by that one and the pattern.
_FIRST = np.array([next((k for k in range(4) if c >> k & 1), 4) for c in range(16)])
_RIGHT = np.array([[16 * sum(1 << k for k in range(4) if p in _HOLDER and _HOLDER[p][k] == slot) for p in range(9)] for slot in range(5)]).reshape(-1)


def epochs(steps: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < steps:
        end = min(steps, at + min(EPOCH[1], max(EPOCH[0], at // 2)))
        yield at, end
        at = end


def _of(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """table[at], without a check of `at`."""
    return table.take(at, mode="clip")


class Models:
    """The models of all blocks of a group.

    A slot of order 2 or order 1 is its state, the second id and the first id (24
    bits each); contexts are hashed to slots. Order 0 has two ids of its own: one
    stands for all that are new to the block, one takes the whole interval.
    """

    def __init__(self, block: np.ndarray, vocabulary: int, reads: bool):
        if not 0 < vocabulary < _ID - 3:
            raise ValueError(f"a vocabulary of {vocabulary} isn't within 1 to {_ID - 4}")
        self.blocks, self.vocabulary, self.reads = int(block[-1]) + 1, vocabulary, reads
        self.every = block
        self.order2, self.order1 = (np.full(self.blocks << n, a | b << 24, np.int64) for n, (a, b) in zip((SLOTS2, SLOTS1), _MISSING))
        # of each pair of states the mass of the two candidates of order 2, the two of order 1, and order 0
        self.rows = self.blocks * STATES * STATES
        self.weight = np.repeat(np.array([2.0, 1.0, 1.0, 0.5, 3.0]), self.rows).reshape(5, self.rows)
        # start and size of each interval (16 bits each), and the four edges between them
        self.interval, self.edges = np.zeros((5, 9, self.rows), np.uint32), np.zeros((9, self.rows), np.uint64)
        self.mix()
        # order 0: counts; start and size in 2^TOTAL0 (32 bits each), 0: new to the block
        self.new, self.whole = vocabulary, vocabulary + 1
        self.count = np.zeros((self.blocks, vocabulary + 2), np.int64)
        self.place0 = np.zeros((self.blocks, vocabulary + 2), np.uint64)
        self.place0[:, self.new :] = 1 << TOTAL0 + 32
        if reads:
            self.holder = np.full((self.blocks, 1 << TOTAL0), self.new, np.uint16 if vocabulary < 1 << 16 else np.int32)
        self.novel, self.spelled = np.ones(self.blocks), np.ones(self.blocks)

    def begin(self, live: int) -> None:
        """An epoch of the first `live` stretches."""
        self.block = self.every[:live]
        self.base2, self.base1 = self.block << SLOTS2, self.block << SLOTS1
        self.base, self.base0, self.based = self.block * (STATES * STATES), self.block * (self.vocabulary + 2), self.block << TOTAL0
        # the four candidates, and room for the id that order 0 tells
        self.five = np.zeros((5, live), np.int64)
        self.slots, self.ids, self.fresh = [], [], []

    def foretell(self, last: np.ndarray, before: np.ndarray) -> None:
        """Candidates for the ids that follow, and their pairs of states and patterns."""
        key = last * 0x9E3779B1
        at1 = key >> 16
        at1 &= (1 << SLOTS1) - 1
        at1 += self.base1
        key += before * 0x2545F491
        key >>= 12
        key &= (1 << SLOTS2) - 1
        key += self.base2
        self.at2, self.at1 = key, at1
        self.g2, self.g1 = g2, g1 = _of(self.order2, key), _of(self.order1, at1)
        a2, b2, a1, b1, _ = self.five
        np.bitwise_and(g2, _ID, out=a2)
        np.bitwise_and(g1, _ID, out=a1)
        np.right_shift(g2, 24, out=b2)
        np.right_shift(g1, 24, out=b1)
        self.state2, self.state1 = b2 >> 24, b1 >> 24
        b2 &= _ID
        b1 &= _ID
        same = (a1 == b2).view(np.int8)
        same += same
        same += (a1 == a2).view(np.int8)
        same *= 3
        same += (b1 == a2).view(np.int8)
        second = (b1 == b2).view(np.int8)
        same += second
        same += second
        self.same = same.astype(np.int64)
        self.pair = self.same * self.rows
        row = self.state2 * STATES
        row += self.state1
        row += self.base
        self.pair += row

    def right(self, x: np.ndarray) -> np.ndarray:
        """Which candidates are x, a bit each."""
        a2, b2, a1, b1, _ = self.five
        bits = (b1 == x).view(np.int8)
        for c in (a1, b2, a2):
            bits += bits
            bits += (c == x).view(np.int8)
        return bits.astype(np.int64)

    def place(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the intervals of the mixture that are candidates 0 to 3 or order 0; start in totals of order 0."""
        at = slot * (9 * self.rows)
        at += self.pair
        self.slots.append(at)
        size = _of(self.interval.reshape(-1), at).astype(np.uint64)
        start = size & _LOW16
        start <<= _TOTAL0
        size >>= _16
        return start, size

    def follow(self, x: np.ndarray, right: np.ndarray) -> None:
        """Learn that x followed; right: which candidates are x, a bit each, times 16. Of several ids of one slot the last counts, as numpy assigns in order."""
        x = x * (1 << 24 | 1)
        for slots, at, seen, state, change in ((self.order2, self.at2, self.g2, self.state2, _CHANGE2), (self.order1, self.at1, self.g1, self.state1, _CHANGE1)):
            state += right
            new = seen ^ x
            new |= _STATE
            new &= _of(change, state)
            new ^= seen
            slots[at] = new

    def mix(self) -> None:
        """The intervals of all pairs of states from their weights."""
        # masses are whole numbers; a candidate that has its own interval gets 1 at least
        mass = (self.weight[:4] * (((1 << MIX) - 5) / self.weight.sum(axis=0))).astype(np.uint32) + np.uint32(1)
        for p, holder in _HOLDER.items():
            size = [mass[0], mass[1], mass[2], mass[3]]
            for k in (2, 3):
                if holder[k] != k:
                    size[holder[k]] = size[holder[k]] + size[k]
                    size[k] = np.zeros_like(mass[k])
            end = np.zeros(self.rows, np.uint32)
            edges = self.edges[p]
            edges[:] = 0
            for k in range(4):
                self.interval[k, p] = size[k] << np.uint32(16) | end
                end = end + size[k]
                edges |= end.astype(np.uint64) << np.uint64(16 * k)
            self.interval[4, p] = (np.uint32(1 << MIX) - end) << np.uint32(16) | end

    def refresh0(self) -> None:
        """The intervals of order 0 from the counts."""
        total = 1 << TOTAL0
        for b in range(self.blocks):
            seen = np.flatnonzero(self.count[b])
            c = self.count[b, seen]
            # a share for new ids, by how many of those spelled lately were new
            share = min(0.95, self.novel[b] / self.spelled[b])
            room = max(64, int((total - len(seen)) * (1 - share)))
            size = 1 + c * min(room, total - len(seen) - 64) // max(1, int(c.sum()))
            upto = np.cumsum(size)
            known = int(upto[-1]) if len(seen) else 0
            self.place0[b, seen] = upto - size + (size << 32)
            self.place0[b, self.new] = known + (total - known << 32)
            if self.reads:
                self.holder[b, :known] = np.repeat(seen.astype(self.holder.dtype), size)
                self.holder[b, known:] = self.new
        self.novel, self.spelled = self.novel * 0.5 + 0.1, self.spelled * 0.5 + 0.1

    def learn(self) -> None:
        """Learn weights and counts from the ids of the epoch."""
        n = np.bincount(np.concatenate(self.slots), minlength=45 * self.rows).reshape(5, 9, self.rows)
        w = self.weight
        spelled = n[4].sum(axis=0)
        more = np.zeros_like(w)
        more[4] = spelled
        for p, holder in _HOLDER.items():
            some = [k for k in range(4) if holder[k] == k]
            held = {h: sum(w[k] for k in range(4) if holder[k] == h) for h in some}
            part = {h: n[h, p] / held[h] for h in some}
            for k in range(4):
                more[k] += part[holder[k]] * w[k]
        seen = n.any(axis=(0, 1))
        more += w
        more *= np.minimum(1, MEMORY / more.sum(axis=0))
        more += 0.001
        np.copyto(w, more, where=seen)
        self.mix()
        ids = np.concatenate(self.ids)
        if self.count.size < len(ids):
            self.count += np.bincount(ids, minlength=self.count.size).reshape(self.count.shape)
        else:
            np.add.at(self.count.reshape(-1), ids, 1)
        self.count[:, self.new :] = 0
        self.novel += np.bincount(np.concatenate(self.fresh), minlength=self.blocks)
        self.spelled += spelled.reshape(self.blocks, -1).sum(axis=1)


def _apart(n: int) -> int:
    """n or a few more 32-bit numbers, so that rows of them don't fall on the same lines of a processor's cache."""
    return (-(-n // 16) | 1) * 16


class Encoder:
    def __init__(self, lanes: int, room: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.lanes = np.arange(lanes)
        # words of each stretch, and carries not yet passed on; where the next one goes
        self.room = _apart(room)
        self.out, self.at = np.zeros(lanes * self.room, np.int32), self.lanes * self.room
        self.spare = self.room

    def narrow(self, lane: np.ndarray | slice, r: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        low = r * start
        low += self.low[lane]
        over = np.flatnonzero(low < self.low[lane])
        if len(over):
            self.out[self.at[over if isinstance(lane, slice) else lane[over]] - 1] += 1
        rng = r * size
        self.low[lane], self.range[lane] = low, rng
        who = np.flatnonzero(rng < _FULL)
        low, rng = low[who], rng[who]
        if not isinstance(lane, slice):
            who = lane[who]
        while len(who):
            self.emit(who, low)
            low <<= _16
            rng <<= _16
            self.low[who], self.range[who] = low, rng
            more = np.flatnonzero(rng < _FULL)
            who, low, rng = who[more], low[more], rng[more]

    def emit(self, who: np.ndarray, low: np.ndarray) -> None:
        self.spare -= 1
        if self.spare < 1:
            used = self.at - self.lanes * self.room
            if int(used.max()) + 1 >= self.room:
                room = _apart(2 * self.room)
                out = np.zeros((len(self.low), room), np.int32)
                out[:, : self.room] = self.out.reshape(-1, self.room)
                self.out, self.room, self.at = out.reshape(-1), room, self.lanes * room + used
            self.spare = self.room - int(used.max())
        at = self.at[who]
        self.out[at] = low >> _48
        at += 1
        self.at[who] = at

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """(the words of all stretches, one after the other; how many each has)."""
        # the least multiple of 2^48 in the range; words beyond the end are read as 0
        up = self.low + (_FULL - _1)
        self.out[self.at[up < self.low] - 1] += 1
        self.emit(self.lanes, up)
        # no carry leaves a stretch: its first word never overflows
        while len(over := np.flatnonzero(self.out > 0xFFFF)):
            self.out[over] &= 0xFFFF
            self.out[over - 1] += 1
        used = self.at - self.lanes * self.room
        out = self.out.reshape(-1, self.room).astype("<u2")
        return np.concatenate([out[i, :n] for i, n in enumerate(used.tolist())]), used


class Decoder:
    """code: the number read, less the low end of the range."""

    def __init__(self, words: np.ndarray, size: np.ndarray):
        # 4 words are read ahead, so 3 zeros at most beyond the end of a stretch
        start = np.cumsum(size + 3) - (size + 3)
        self.words = np.zeros(len(words) + 3 * len(size), np.uint64)
        self.words[np.arange(len(words)) + np.repeat(3 * np.arange(len(size)), size)] = words
        self.range = np.full(len(size), 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.code = np.zeros(len(size), np.uint64)
        for k in range(4):
            self.code = self.code << _16 | self.words.take(start + k)
        self.pos = start + 4

    def narrow(self, lane: np.ndarray | slice, r: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        code = self.code[lane] - r * start
        rng = r * size
        self.code[lane], self.range[lane] = code, rng
        who = np.flatnonzero(rng < _FULL)
        code, rng = code[who], rng[who]
        if not isinstance(lane, slice):
            who = lane[who]
        while len(who):
            at = self.pos[who]
            code <<= _16
            # only damaged words are read beyond the end
            code |= _of(self.words, at)
            rng <<= _16
            at += 1
            self.code[who], self.range[who], self.pos[who] = code, rng, at
            more = np.flatnonzero(rng < _FULL)
            who, code, rng = who[more], code[more], rng[more]


def _grown(steps: int, since: int) -> bool:
    """Whether order 0 is to be brought up to date."""
    return steps >= since + max(EPOCH[0], since // 2)


def _plan(n: np.ndarray) -> tuple[int, list[tuple[int, int, int]]]:
    """Steps, and epochs (first step, end, stretches that have these steps); lengths of stretches fall by at most 1."""
    least, steps = int(n[-1]), int(n[0])
    plan = [(a, b, len(n)) for a, b in epochs(least)]
    return steps, plan + ([(least, steps, int((n > least).sum()))] if steps > least else [])


def _turned(x: np.ndarray, out: np.ndarray) -> None:
    """out = x.T, some rows of out at a time, which a processor's cache holds."""
    for i in range(0, len(out), 64):
        out[i : i + 64] = x[:, i : i + 64].T


def _columns(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Stretches that stand one after the other as columns; lengths as in _plan()."""
    steps, long = int(n[0]), int((n == n[0]).sum())
    out = np.zeros((steps, _apart(len(n))), np.int32)[:, : len(n)]
    for i in range(0, long, 64):
        j = min(long, i + 64)
        out[:, i:j] = x[i * steps : j * steps].reshape(j - i, steps).T
    for i in range(long, len(n), 64):
        j, at = min(len(n), i + 64), steps * long - long * (steps - 1)
        out[:-1, i:j] = x[at + i * (steps - 1) : at + j * (steps - 1)].reshape(j - i, steps - 1).T
    return out


def encode_group(x: np.ndarray, n: np.ndarray, streams: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of all stretches, which stand in x one after the other, and how many each has; every `streams` of them are a block."""
    steps, plan = _plan(n)
    m, coder = Models(np.arange(len(n)) // streams, vocabulary, False), Encoder(len(n), 3 * steps // 4 + 16)
    ids = _columns(x, n)
    place0 = m.place0.reshape(-1)
    last, before = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    since = 0
    for a, b, live in plan:
        if _grown(a, since):
            m.refresh0()
            since = a
        m.begin(live)
        every = slice(0, live)
        for t in range(a, b):
            x = ids[t, :live].astype(np.int64)
            m.foretell(last[:live], before[:live])
            right = m.right(x)
            slot = _of(_FIRST, right)
            start, size = m.place(slot)
            here = np.where(slot == 4, x, m.whole)
            here += m.base0
            place = _of(place0, here)
            fresh = np.flatnonzero(place == 0)
            place[fresh] = place0[m.base0[fresh] + m.new]
            start += size * (place & _LOW32)
            size *= place >> _32
            coder.narrow(every, coder.range[:live] >> _BOTH, start, size)
            if len(fresh):
                coder.narrow(fresh, coder.range[fresh] // np.uint64(vocabulary), x[fresh].astype(np.uint64), _1)
            m.ids.append(here)
            m.fresh.append(m.block[fresh])
            right *= 16
            m.follow(x, right)
            last, before = x, last
        m.learn()
    return coder.finish()


def decode_group(words: np.ndarray, size: np.ndarray, n: np.ndarray, streams: int, vocabulary: int) -> np.ndarray:
    """The ids of all stretches, of the given lengths, one after the other."""
    steps, plan = _plan(n)
    m, coder = Models(np.arange(len(n)) // streams, vocabulary, True), Decoder(words, size)
    ids = np.zeros((steps, _apart(len(n))), np.int32)[:, : len(n)]
    edges, place0, holder = m.edges.reshape(-1), m.place0.reshape(-1), m.holder.reshape(-1)
    most, most0, lanes = np.uint64((1 << MIX + TOTAL0) - 1), (1 << TOTAL0) - 1, np.arange(len(n))
    last, before = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    since = 0
    for a, b, live in plan:
        if _grown(a, since):
            m.refresh0()
            since = a
        m.begin(live)
        every = slice(0, live)
        for t in range(a, b):
            m.foretell(last[:live], before[:live])
            r = coder.range[:live] >> _BOTH
            target = coder.code[:live] // r
            np.minimum(target, most, out=target)
            # how many of the four edges, 16 bits each, aren't beyond the target
            reached = ((target >> _TOTAL0) * _FOUR).view(np.uint16) >= _of(edges, m.pair).view(np.uint16)
            slot = (reached.view(np.uint32) * np.uint32(0x01010101) >> np.uint32(24)).astype(np.int64)
            start, size = m.place(slot)
            target -= start
            # exact: numbers below 2^33 by numbers below 2^16
            inside = (target.view(np.int64) / size.view(np.int64)).astype(np.int64)
            np.minimum(inside, most0, out=inside)
            inside += m.based
            y = m.five[4]
            y[:] = _of(holder, inside)
            here = np.where(slot == 4, y, m.whole)
            fresh = np.flatnonzero(here == m.new)
            here += m.base0
            place = _of(place0, here)
            start += size * (place & _LOW32)
            size *= place >> _32
            coder.narrow(every, r, start, size)
            if len(fresh):
                r = coder.range[fresh] // np.uint64(vocabulary)
                spelt = np.minimum(coder.code[fresh] // r, np.uint64(vocabulary - 1))
                coder.narrow(fresh, r, spelt, _1)
                y[fresh] = spelt.astype(np.int64)
                here[fresh] = m.base0[fresh] + y[fresh]
            x = _of(m.five.reshape(-1), slot * live + lanes[:live])
            np.minimum(x, vocabulary - 1, out=x)  # only damaged words give more
            ids[t, :live] = x
            m.ids.append(here)
            m.fresh.append(m.block[fresh])
            slot *= 9
            slot += m.same
            m.follow(x, _of(_RIGHT, slot))
            last, before = x, last
        m.learn()
    long = int((n == steps).sum())
    out = np.zeros(int(n.sum()), np.int32)
    _turned(ids[:, :long], out[: long * steps].reshape(long, steps))
    _turned(ids[:-1, long:], out[long * steps :].reshape(len(n) - long, steps - 1))
    return out


def _lengths(n: int, lanes: int) -> np.ndarray:
    """n ids in stretches whose lengths differ by at most 1, longer ones first."""
    return n // lanes + (np.arange(lanes) < n % lanes)


def _crc(ids: np.ndarray, words: np.ndarray) -> int:
    """crc32 of a block's ids as little-endian u32 and of its words."""
    return zlib.crc32(words.astype("<u2").tobytes(), zlib.crc32(ids.astype("<u4").tobytes()))


def _upto(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def write_file(lengths: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    """A file image: header, the lengths of its documents, a directory of blocks, and the blocks.

    Ids, below `vocabulary`, are renumbered by the file's alphabet, the ids that
    occur in it. magic; u32 ids of the alphabet, documents, blocks, stretches of a
    block, bytes of the packed alphabet; u64 ids; the alphabet (differences of
    rising ids as u32, packed by zlib); u32 length of each document; for each block
    u32 crc32 of its ids and words; for each stretch u32 words; u32 crc32
    of all before; then the words, u16 each.
    """
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError(f"id {ids.max()} isn't below {vocabulary}")
    alphabet = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
    number = np.zeros(int(alphabet[-1]) + 1 if len(ids) else 1, np.int32)
    number[alphabet] = np.arange(len(alphabet))
    blocks = -(-len(ids) // BLOCK)
    streams = min(STREAMS, max(1, len(ids) // max(1, blocks * LEAST)))
    n = _lengths(len(ids), blocks * streams) if blocks else np.zeros(0, np.int64)
    edge, numbers = _upto(n), number[ids]
    words, sizes = [np.zeros(0, "<u2")], [np.zeros(0, np.int64)]
    for i in range(0, len(n), GROUP * streams):
        j = min(len(n), i + GROUP * streams)
        coded = encode_group(numbers[edge[i] : edge[j]], n[i:j], streams, len(alphabet))
        words.append(coded[0])
        sizes.append(coded[1])
    coded, size = np.concatenate(words), np.concatenate(sizes)
    at = _upto(size)
    crc = [_crc(ids[edge[i] : edge[i + streams]], coded[at[i] : at[i + streams]]) for i in range(0, len(n), streams)]
    packed = zlib.compress(np.diff(alphabet, prepend=0).astype("<u4").tobytes(), 9)
    head = MAGIC + np.array([len(alphabet), len(lengths), blocks, streams, len(packed)], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes() + packed
    head += np.asarray(lengths, "<u4").tobytes() + np.array(crc, "<u4").tobytes() + size.astype("<u4").tobytes()
    return b"".join([head, np.array([zlib.crc32(head)], "<u4").tobytes(), coded.astype("<u2").tobytes()])


def read_file(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of its documents, all ids); ValueError if a checksum fails."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not such a file")
    at = len(MAGIC)
    kinds, docs, blocks, streams, packed = (int(x) for x in np.frombuffer(data, "<u4", 5, at))
    total = int(np.frombuffer(data, "<u8", 1, at + 20)[0])
    at += 28 + packed
    end = at + 4 * (docs + blocks + blocks * streams)
    if end + 4 > len(data) or np.frombuffer(data, "<u4", 1, end)[0] != zlib.crc32(data[:end]):
        raise ValueError("the header's checksum doesn't match")
    alphabet = np.cumsum(np.frombuffer(zlib.decompress(data[at - packed : at]), "<u4").astype(np.int64)).astype(np.uint32)
    lengths = np.frombuffer(data, "<u4", docs, at)
    crc = np.frombuffer(data, "<u4", blocks, at + 4 * docs)
    size = np.frombuffer(data, "<u4", blocks * streams, at + 4 * (docs + blocks)).astype(np.int64)
    start = _upto(size)
    if end + 4 + 2 * start[-1] != len(data):
        raise ValueError("the file has another size than its directory says")
    n = _lengths(total, blocks * streams) if blocks else np.zeros(0, np.int64)
    edge, coded = _upto(n), np.frombuffer(data, "<u2", int(start[-1]), end + 4)
    ids = np.zeros(total, np.uint32)
    for i in range(0, len(n), GROUP * streams):
        j = min(len(n), i + GROUP * streams)
        ids[edge[i] : edge[j]] = alphabet[decode_group(coded[start[i] : start[j]], size[i:j], n[i:j], streams, kinds)]
    for k in range(blocks):
        i, j = k * streams, (k + 1) * streams
        if _crc(ids[edge[i] : edge[j]], coded[start[i] : start[j]]) != crc[k]:
            raise ValueError(f"the checksum of block {k} doesn't match")
    return lengths, ids
