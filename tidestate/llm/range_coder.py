"""Adaptive context-mixing range coder for token ids: a block's lanes in step, with one model.

A block is coded on its own: its model starts anew. Its ids are dealt to lanes, one run of ids each, and a step
codes the next id of every lane; the model is the same for all lanes and learns from all of them after each step, so that it has
seen the whole block by its end, though thousands of ids are coded at a time.

Three predictions are mixed for each id. Order 2: the ids that followed the two before, with counts (SLOTS2 of them, by a hash of
the two). Order 1: the ids that followed the one before (SLOTS1). Order 0: the counts of all ids of the vocabulary. An id's
probability is w2 * p2 + w1 * p1 + w0 * p0, the weights being learned for each state of evidence: how much orders 2 and 1 have seen here, and
which of them was right last in this lane. An id in the slots of order 2 or 1 is coded by the sum of its first two terms, any other by the rest and
then by its count of order 0. A carryless range coder of each lane turns the intervals into 16-bit words. All
arithmetic is in integers, so decoding repeats encoding exactly.
"""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
#: Ids of a block, lanes of a block, and ids of a lane from which there are more lanes.
BLOCK = 1 << 21
LANES = 8192
LEAST_STEPS = 256
SLOTS2, SLOTS1 = 2, 3
SLOTS = SLOTS2 + SLOTS1
BITS2 = 16
#: A slot is an id and, in the bits above it, its count.
ID_BITS = 21
ID, ONE = (1 << ID_BITS) - 1, 1 << ID_BITS
SETTLED, LEAST = U(1 << 48), U(1 << 40)
U1, U16, FIELD = U(1), U(16), U(0xFFFF)
#: Bits of the weights and of the shares in a context; a mixture has both.
SHARE = 12
WHOLE = 1 << SHARE
TOTAL = 2 * SHARE
#: A context's counts are halved when one exceeds MOST; those of order 0 when all exceed MOST0.
MOST = 250
MOST0 = 1 << 22
#: What an occurrence adds to a count of order 0 (each id begins with 1).
STEP0 = 24
#: Steps between two sums of what is learned for all lanes (counts of order 0, weights), after the first ones.
SUMS = 8
LEVELS = 6
#: Levels of evidence by the sum of a context's counts, times what the state has it times.
LEVEL2 = (np.minimum(np.ceil(np.log2(np.arange(SLOTS2 * (MOST + 2)) + 1)), LEVELS - 1) * 3 * LEVELS).astype(np.int64)
LEVEL1 = (np.minimum((np.log2(np.arange(SLOTS1 * (MOST + 2)) + 1) * 0.8 + 0.99).astype(np.int64), LEVELS - 1) * 3).astype(np.int64)
#: WHOLE * 16 over a count.
INVERSE = (16 * WHOLE // np.maximum(np.arange(SLOTS1 * (MOST + 2)), 1)).astype(np.int32)
M1, M2 = 0x9E3779B1, 0x85EBCA6B
#: A slot's place among the three columns of the weights: order 1, order 2, order 0.
COLUMN = np.array([1] * SLOTS2 + [0] * SLOTS1 + [2])
RIGHT = np.array([2] * SLOTS2 + [1] * SLOTS1 + [0])


class Model:
    """The predictions of a block."""

    def __init__(self, lanes: int, vocabulary: int) -> None:
        if vocabulary > ID - SLOTS:
            raise ValueError(f"ids of more than {ID_BITS} bits")
        # a row a context, of slots; empty ones have ids that are none
        self.t2 = np.tile(ID - np.arange(SLOTS2, dtype=np.int32), (1 << BITS2, 1))
        self.t1 = np.tile(ID - np.arange(SLOTS1, dtype=np.int32), (vocabulary, 1))
        self.count, self.seen = np.ones(vocabulary, np.int64), []
        self.hits, self.states = np.tile(np.array([2, 2, 4]), (LEVELS * LEVELS * 3, 1)), []  # by state: found by order 1, order 2, order 0
        self.last, self.before, self.right = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.steps = 0
        self.learn()

    def learn(self) -> None:
        """Sums up what was seen since the last time: the counts of order 0, and the weights."""
        if self.seen:
            self.count += STEP0 * np.bincount(np.concatenate(self.seen), minlength=len(self.count))
            self.hits += np.bincount(np.concatenate(self.states), minlength=self.hits.size).reshape(self.hits.shape)
            self.seen.clear()
            self.states.clear()
            big = self.hits.sum(1) > 1 << 16
            self.hits[big] = (self.hits[big] >> 1) + 1
            if self.count.sum() > MOST0:
                self.count = (self.count >> 1) + 1
        self.below = np.zeros(len(self.count) + 1, np.int64)
        np.cumsum(self.count, out=self.below[1:])
        self.all = int(self.below[-1])
        w = np.maximum((self.hits[:, :2] << SHARE) // self.hits.sum(1, keepdims=True), 1)
        self.w1 = np.minimum(w[:, 0], WHOLE - 64).astype(np.int32)
        self.w2 = np.minimum(w[:, 1], WHOLE - 1 - self.w1).astype(np.int32)

    def shrink(self, k: int) -> None:
        """From now on only the first k lanes have ids."""
        self.last, self.before, self.right = self.last[:k], self.before[:k], self.right[:k]

    def predict(self) -> None:
        """By slot and lane: ids, mass (an interval's length among 2**TOTAL) and to (its end). What lies behind the last is order 0's."""
        self.i2 = ((self.last * M1 + self.before * M2) >> 7) & ((1 << BITS2) - 1)
        slots = self.slots = np.empty((SLOTS, len(self.last)), np.int32)
        slots[:SLOTS2] = self.t2.take(self.i2, 0).T
        slots[SLOTS2:] = self.t1.take(self.last, 0).T
        c = slots >> ID_BITS
        ids = self.ids = slots & ID
        n2, n1 = functools.reduce(np.add, c[:SLOTS2]), functools.reduce(np.add, c[SLOTS2:])
        self.state = LEVEL2.take(n2) + LEVEL1.take(n1) + self.right
        c[:SLOTS2] *= INVERSE.take(n2)
        c[SLOTS2:] *= INVERSE.take(n1)
        c >>= 4
        c[:SLOTS2] *= self.w2.take(self.state)
        c[SLOTS2:] *= self.w1.take(self.state)
        # an id of both orders has the sum, at its place of order 2
        for s in range(SLOTS2):
            same = c[SLOTS2:] * (ids[SLOTS2:] == ids[s])
            same *= c[s] > 0
            c[s] += functools.reduce(np.add, same)
            c[SLOTS2:] -= same
        self.mass, self.to = c, c.cumsum(0, dtype=np.int32)

    def narrow(self, low: np.ndarray, rng: np.ndarray, place: np.ndarray, lane: np.ndarray) -> np.ndarray:
        """In place: the intervals of the slots at place; the lanes whose ids are in none."""
        at = np.minimum(place, SLOTS - 1) * len(lane) + lane
        end, mass = self.to.ravel().take(at).astype(np.int64), self.mass.ravel().take(at).astype(np.int64)
        deep = np.flatnonzero(place == SLOTS)
        mass[deep] = 0
        r = rng >> U(TOTAL)
        low += r * (end - mass).view(U)
        mass[deep] = (1 << TOTAL) - end.take(deep)
        np.multiply(r, mass.view(U), out=rng)
        return deep

    def update(self, x: np.ndarray, place: np.ndarray) -> None:
        """Learns the lanes' ids. place: the slot of each, SLOTS if it is in none."""
        self.states.append(self.state * 3 + COLUMN.take(place))
        self.seen.append(x)
        p, one = self.slots, x.astype(np.int32)
        hit = self.ids == one
        p += hit.view(np.int8) * np.int32(ONE)
        one += ONE
        # an id that is in no slot takes the last; one of more counts than that before it moves up
        for first, end in ((0, SLOTS2), (SLOTS2, SLOTS)):
            known = hit[first]
            for s in range(first + 1, end):
                known = known | hit[s]
            p[end - 1] = np.where(known, p[end - 1], one)
            for s in range(end - 1, first, -1):
                a, b = p[s - 1], p[s]
                p[s - 1], p[s] = np.maximum(a, b), np.minimum(a, b)
        over = np.flatnonzero(np.maximum(p[0], p[SLOTS2]) > (MOST << ID_BITS))
        if len(over):
            p[:, over] = ((p[:, over] >> (ID_BITS + 1)) << ID_BITS) | (p[:, over] & ID)
        self.t2[self.i2] = p[:SLOTS2].T
        self.t1[self.last] = p[SLOTS2:].T
        self.steps += 1
        if self.steps < 2 * SUMS or self.steps % SUMS == 0:
            self.learn()
        self.before, self.last, self.right = self.last, x, RIGHT.take(place)


def layout(n: int) -> np.ndarray:
    """Where the lanes of n ids begin, and n: the first lanes have one more than the others."""
    lanes = max(1, min(LANES, n // LEAST_STEPS))
    each, more = divmod(n, lanes)
    return np.concatenate([[0], np.cumsum(np.full(lanes, each) + (np.arange(lanes) < more))])


def shifted(low: np.ndarray, rng: np.ndarray, todo: np.ndarray, settled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In place: the lanes of todo pass on a word; those that have more to pass on, and which are settled."""
    lo, ra = low.take(todo), rng.take(todo)
    ra = np.where(settled, ra, (~lo + U1) & (LEAST - U1)) << U16
    lo <<= U16
    low[todo], rng[todo] = lo, ra
    settled = (lo ^ (lo + ra)) < SETTLED
    more = settled | (ra < LEAST)
    return todo[more], settled[more]


def unsettled(low: np.ndarray, rng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lanes that have words to pass on, and which are settled."""
    settled = (low ^ (low + rng)) < SETTLED
    todo = np.flatnonzero(settled | (rng < LEAST))
    return todo, settled.take(todo)


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """The code of a block of ids: lengths of the lanes' words (u32), then the words."""
    at = layout(len(ids))
    n, steps = len(at) - 1, int(at[1])
    grid = np.zeros((steps, n), np.int64)
    for i in range(n):
        grid[: at[i + 1] - at[i], i] = ids[at[i] : at[i + 1]]
    short = int((np.diff(at) == steps).sum())  # lanes that have an id in the last step
    m = Model(n, vocabulary)
    low, rng = np.zeros(n, U), np.full(n, (1 << 64) - 1, U)
    width = 4 * steps + 8
    words, pos = np.zeros(n * width, np.uint16), np.arange(n) * width
    lanes = np.arange(n)
    for t in range(steps):
        k = n if t < steps - 1 else short
        if k < n:
            m.shrink(k)
        x = grid[t, :k]
        m.predict()
        held = (m.ids == x.astype(np.int32)) & (m.mass > 0)
        place = np.full(k, SLOTS)
        for s in range(SLOTS):
            np.putmask(place, held[s], s)
        lo, ra = low[:k], rng[:k]
        deep = m.narrow(lo, ra, place, lanes[:k])
        if len(deep):
            y = x.take(deep)
            r = ra.take(deep) // U(m.all)
            lo[deep] += r * m.below.take(y).view(U)
            ra[deep] = r * (m.below.take(y + 1) - m.below.take(y)).view(U)
        m.update(x, place)
        todo, settled = unsettled(lo, ra)
        while len(todo):
            p = pos.take(todo)
            words[p] = low.take(todo) >> U(48)
            pos[todo] = p + 1
            todo, settled = shifted(low, rng, todo, settled)
    # two words more that lie within every lane's interval, whatever is read behind them
    end = low + (LEAST >> U1)
    for i in range(2):
        words[pos] = (end >> U(48 - 16 * i)) & FIELD
        pos += 1
    size = pos - np.arange(n) * width
    keep = np.arange(width) < size[:, None]
    return size.astype("<u4").tobytes() + words.reshape(n, width)[keep].astype("<u2").tobytes()


def decode(code: bytes, count: int, vocabulary: int) -> np.ndarray:
    """The ids of a block of `count` ids."""
    at = layout(count)
    n, steps = len(at) - 1, int(at[1])
    size = np.frombuffer(code, "<u4", n).astype(np.int64)
    words = np.concatenate([np.frombuffer(code, "<u2", int(size.sum()), 4 * n), np.zeros(8, np.uint16)])
    pos = np.cumsum(size) - size
    stop = pos + size
    short = int((np.diff(at) == steps).sum())
    m = Model(n, vocabulary)
    low, rng, value = np.zeros(n, U), np.full(n, (1 << 64) - 1, U), np.zeros(n, U)

    def fed(lane: np.ndarray) -> np.ndarray:
        """The next word of each lane; 0 behind its end."""
        p = pos.take(lane)
        w = np.where(p < stop.take(lane), words.take(np.minimum(p, len(words) - 1)), 0).astype(U)
        pos[lane] = p + 1
        return w

    lanes = np.arange(n)
    for _ in range(4):
        value = (value << U16) | fed(lanes)
    grid = np.zeros((steps, n), np.int64)
    for t in range(steps):
        k = n if t < steps - 1 else short
        if k < n:
            m.shrink(k)
        m.predict()
        lo, ra = low[:k], rng[:k]
        r = ra >> U(TOTAL)
        v = np.minimum((value[:k] - lo) // r, U((1 << TOTAL) - 1)).view(np.int64)
        behind = m.to <= v.astype(np.int32)
        place = np.zeros(k, np.int64)
        for s in range(SLOTS):
            place += behind[s]
        x = m.ids.ravel().take(np.minimum(place, SLOTS - 1) * k + lanes[:k]).astype(np.int64)
        deep = m.narrow(lo, ra, place, lanes[:k])
        if len(deep):
            r = ra.take(deep) // U(m.all)
            v = np.minimum((value.take(deep) - lo.take(deep)) // r, U(m.all - 1)).view(np.int64)
            y = np.searchsorted(m.below, v, "right") - 1
            x[deep] = y
            lo[deep] += r * m.below.take(y).view(U)
            ra[deep] = r * (m.below.take(y + 1) - m.below.take(y)).view(U)
        grid[t, :k] = x
        m.update(x, place)
        todo, settled = unsettled(lo, ra)
        while len(todo):
            value[todo] = (value.take(todo) << U16) | fed(todo)
            todo, settled = shifted(low, rng, todo, settled)
    out = np.zeros(count, np.int64)
    for i in range(n):
        out[at[i] : at[i + 1]] = grid[: at[i + 1] - at[i], i]
    return out
