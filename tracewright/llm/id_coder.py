"""A context-mixing range coder for token ids.

A block of ids is coded on its own, from fresh tables. Order 0 predicts ids by how often the block has had them:
at growing steps the ids seen so far are ranked by their counts, and an id is named by its rank; one not ranked yet,
by RANKED and itself. Order 1 and order 2 predict the id that last followed the same one or two ids; a table holds it
and how often that held lately. One symbol tells which of the two is right, or else the octave of the name, whose
ids are about equally frequent; the place inside the octave follows as plain bits.

The symbol's probability mixes three adaptive frequency rows: one of the block; one for the last symbol and the
order-1 table's record; one for both tables' records and whether they agree. They are added up by weights that
follow how well each row has predicted, a set of weights for each pair of records. All goes into one range coder with
64-bit low and range and 32-bit output words. Weights are updated by single IEEE operations in a stated order, the
rest is integers, so every machine computes the same.

Blocks are coded in step, one numpy lane each, so the Python cost of a step is shared by all of them.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
#: Names below this are ranks; a block cannot have more different ids.
RANKED = BLOCK
#: Ids must be below this.
ID_LIMIT = (1 << 18) - 1 - RANKED
SYMBOLS = 20
_SLOT_BITS = 12
#: Ids are ranked anew when their number has grown from _FIRST by a quarter, again and again.
_FIRST = 64
#: A row's weight moves by 1/32 of the way, within bounds; it is used in parts of 16.
_PACE, _LEAST, _MOST, _PARTS = 1 / 32, 1 / 8, 8.0, 16
#: A row's sum stays below 2 x 16 x 512 plus what it starts with, so that of three rows fits 16 bits.
_GAIN = 16
_HALVE_EVERY = 512
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_WORD = np.uint64(32)
_LOW = np.uint64(1 << 32)
_OCTAVE = np.zeros(1 << 18, np.int64)
for _i in range(18):
    _OCTAVE[1 << _i :] = _i


def _rankings() -> list[int]:
    """The numbers of ids after which a block is ranked anew."""
    out, n = [], _FIRST
    while n < BLOCK:
        out.append(n)
        n += n // 4
    return out


def _ranking(ids: np.ndarray) -> np.ndarray:
    """The distinct ids, the most frequent ones first, smaller ones first among equally frequent ones."""
    distinct, counts = np.unique(ids, return_counts=True)
    return distinct[np.argsort(-counts, kind="stable")]


class _Model:
    """The tables of many blocks; calls take the number of lanes still at work, always the first ones."""

    def __init__(self, lanes: int):
        self.n = lanes
        self.lane = np.arange(lanes)
        self.slot = self.lane << _SLOT_BITS
        # Ids plus 1, times 4, plus how often they held.
        self.after1 = np.zeros(lanes << _SLOT_BITS, np.int32)
        self.after2 = np.zeros(lanes << _SLOT_BITS, np.int32)
        self.rows = (np.full((lanes, SYMBOLS), 4, np.uint32), np.ones((lanes * SYMBOLS * 4, SYMBOLS), np.uint32), np.ones((lanes * 32, SYMBOLS), np.uint32))
        self.sums = [r.sum(axis=1, dtype=np.int64) for r in self.rows]
        self.weights = np.ones((3, 16 * lanes))
        self.last1 = np.zeros(lanes, np.int64)
        self.last2 = np.zeros(lanes, np.int64)
        self.symbol = np.zeros(lanes, np.int64)
        self.steps = 0

    def predict(self, k: int) -> np.ndarray:
        """The cumulative frequencies of the next symbol, a row a lane."""
        a, b, lane = self.last1[:k], self.last2[:k], self.lane[:k]
        self.at1 = self.slot[:k] + ((a * 40503 >> 4) & ((1 << _SLOT_BITS) - 1))
        self.at2 = self.slot[:k] + ((a * 40503 + b * 60493 >> 5) & ((1 << _SLOT_BITS) - 1))
        self.s1, self.s2 = self.after1[self.at1], self.after2[self.at2]
        c1, c2 = self.s1 & 3, self.s2 & 3
        self.guess1, self.guess2 = self.s1 >> 2, self.s2 >> 2
        self.at = (
            lane,
            (self.symbol[:k] * 4 + c1) * self.n + lane,
            (c2 * 8 + c1 * 2 + (self.guess1 == self.guess2)).astype(np.int64) * self.n + lane,
        )
        self.set = (c2 * 4 + c1).astype(np.int64) * self.n + lane
        self.weight = self.weights.take(self.set, axis=1)
        parts = (self.weight * _PARTS).astype(np.uint32)
        mix = self.rows[0][:k] * parts[0][:, None]
        for n in (1, 2):
            mix += self.rows[n].take(self.at[n], axis=0) * parts[n][:, None]
        return np.cumsum(mix, axis=1, dtype=np.uint32)

    def learn(self, k: int, symbol: np.ndarray, ids: np.ndarray, share: np.ndarray, whole: np.ndarray) -> None:
        """ids: the ids plus 1; share: the symbol's frequency; whole: that of all symbols."""
        scale = _PACE * whole.astype(np.float64) / share
        for n, (rows, sums, at) in enumerate(zip(self.rows, self.sums, self.at)):
            spot = at * SYMBOLS + symbol
            flat = rows.reshape(-1)
            had = flat.take(spot)
            self.weight[n] *= (1 - _PACE) + had * scale / sums.take(at)
            flat[spot] = had + np.uint32(_GAIN)
            sums[at] += _GAIN
            self.weights[n][self.set] = np.minimum(np.maximum(self.weight[n], _LEAST), _MOST)
        for table, at, slot, guess in ((self.after1, self.at1, self.s1, self.guess1), (self.after2, self.at2, self.s2, self.guess2)):
            table[at] = np.where(guess == ids, slot + ((slot & 3) < 3), ids << 2)
        self.last2[:k], self.last1[:k] = self.last1[:k], ids
        self.symbol[:k] = symbol
        self.steps += 1
        if self.steps % _HALVE_EVERY == 0:
            for row in self.rows:
                row -= row >> 1
            self.sums = [r.sum(axis=1, dtype=np.int64) for r in self.rows]


def _part(total: np.ndarray, lane: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The frequency of all symbols, of those before each lane's symbol and of the symbol."""
    flat, spot = total.reshape(-1), lane * SYMBOLS + symbol
    below = np.where(symbol > 0, flat.take(spot - 1, mode="clip"), 0).astype(np.uint64)
    return total[:, -1].astype(np.uint64), below, flat.take(spot).astype(np.uint64) - below


def _names(ids: np.ndarray) -> np.ndarray:
    """The names plus 1 of a block's ids."""
    out = ids.astype(np.int32) + (RANKED + 1)
    at = _rankings()
    rank = np.full(int(ids.max(initial=0)) + 1, -1, np.int32)
    for begin, end in zip(at, [*at[1:], BLOCK]):
        if begin >= len(ids):
            break
        ranked = _ranking(ids[:begin])
        rank[ranked] = np.arange(len(ranked))
        mine = rank[ids[begin:end]]
        out[begin:end] = np.where(mine >= 0, mine + 1, out[begin:end])
    return out


def encode(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """The 32-bit words of each block of ids."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lanes, longest = len(blocks), max(map(len, blocks))
    if longest > BLOCK:
        raise ValueError(f"a block has {BLOCK} ids at most")
    if max((int(b.max()) for b in blocks if len(b)), default=0) >= ID_LIMIT:
        raise ValueError(f"ids must be below {ID_LIMIT}")
    ids, names = np.zeros((longest, lanes), np.int32), np.zeros((longest, lanes), np.int32)
    sizes = np.array([len(blocks[i]) for i in order], np.int64)
    for lane, i in enumerate(order):
        ids[: len(blocks[i]), lane] = blocks[i]
        names[: len(blocks[i]), lane] = _names(blocks[i])
    model = _Model(lanes)
    # A carry out of low belongs to the word written last; it is counted here and added at the end.
    words, carries = np.zeros((longest + 4) * lanes, np.uint32), np.zeros((longest + 4) * lanes, np.uint8)
    place = np.arange(lanes)
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, _FULL)
    for t in range(longest):
        k = int(np.searchsorted(-sizes, -t, "left"))
        total = model.predict(k)
        own, code = ids[t, :k] + 1, names[t, :k].astype(np.int64)
        octave = _OCTAVE[code]
        hit2, hit1 = model.guess2 == own, model.guess1 == own
        symbol = np.where(hit2, 0, np.where(hit1, 1, octave + 2))
        lane = model.lane[:k]
        whole, below, share = _part(total, lane, symbol)
        bits = np.where(hit2 | hit1, 0, octave).astype(np.uint64)
        rest = np.where(hit2 | hit1, 0, code - (1 << octave)).astype(np.uint64)
        unit = wide[:k] // whole
        inner = unit * share >> bits
        new = low[:k] + (unit * below + inner * rest)
        carries[place[:k]] += new < low[:k]
        full = inner < _LOW
        words[place[:k]] = np.where(full, new >> _WORD, 0)
        low[:k] = np.where(full, new << _WORD, new)
        wide[:k] = np.where(full, inner << _WORD, inner)
        place[:k] += full * lanes
        model.learn(k, symbol, own, share, whole)
    for _ in range(2):
        words[place] = low >> _WORD
        low <<= _WORD
        place += lanes
    words, carries = words.reshape(-1, lanes), carries.reshape(-1, lanes)
    over = np.zeros(lanes, np.uint64)
    for t in range(len(words) - 1, 0, -1):
        over = words[t - 1] + (over + carries[t])
        words[t - 1] = over & np.uint64(0xFFFFFFFF)
        over >>= _WORD
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * lanes
    for lane, i in enumerate(order):
        out[i] = words[: place[lane] // lanes, lane].copy()
    return out


def decode(coded: list[np.ndarray], lengths: list[int]) -> list[np.ndarray]:
    """The ids of each block, of the given number, from its words."""
    if not coded:
        return []
    order = sorted(range(len(coded)), key=lambda i: -lengths[i])
    lanes, longest = len(coded), max(lengths)
    sizes = np.array([lengths[i] for i in order], np.int64)
    words = np.zeros((max(map(len, coded)) + 1, lanes), np.uint64)
    for lane, i in enumerate(order):
        words[: len(coded[i]), lane] = coded[i]
    ids = np.zeros((longest, lanes), np.int32)
    # The ids of the ranks, a row a lane.
    ranked, rankings = np.zeros((lanes, RANKED), np.int32), set(_rankings())
    model = _Model(lanes)
    value = (words[0] << _WORD) | words[1] if longest else None
    wide, place, last = np.full(lanes, _FULL), np.arange(lanes) + 2 * lanes, words.size - 1
    words = words.ravel()
    for t in range(longest):
        k = int(np.searchsorted(-sizes, -t, "left"))
        total = model.predict(k)
        lane = model.lane[:k]
        all_ = total[:, -1].astype(np.uint64)
        unit = wide[:k] // all_
        aim = np.minimum(value[:k] // unit, all_ - np.uint64(1)).astype(np.uint32)
        symbol = np.argmax(total > aim[:, None], axis=1)
        _, below, share = _part(total, lane, symbol)
        octave = np.maximum(symbol - 2, 0).astype(np.uint64)
        inner = unit * share >> octave
        left = value[:k] - unit * below
        rest = np.minimum(left // inner, (np.uint64(1) << octave) - np.uint64(1))
        left -= rest * inner
        # A damaged block may decode to anything; the checksum tells, so keep the tables' indices valid.
        name = np.minimum(((np.uint64(1) << octave) + rest).astype(np.int64), ID_LIMIT + RANKED) - 1
        named = np.where(name < RANKED, ranked[lane, np.minimum(name, RANKED - 1)], name - RANKED)
        guess = np.where(symbol == 0, model.guess2, model.guess1) - 1
        whole = np.where(symbol < 2, np.clip(guess, 0, ID_LIMIT - 1), named)
        full = inner < _LOW
        value[:k] = np.where(full, (left << _WORD) | words[np.minimum(place[:k], last)], left)
        wide[:k] = np.where(full, inner << _WORD, inner)
        place[:k] += full * lanes
        ids[t, :k] = whole
        model.learn(k, symbol, (whole + 1).astype(np.int32), share, all_)
        if t + 1 in rankings:
            for own in range(int(np.searchsorted(-sizes, -t - 1, "left"))):
                first = _ranking(ids[: t + 1, own])
                ranked[own, : len(first)] = first
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * lanes
    for lane, i in enumerate(order):
        out[i] = ids[: lengths[i], lane].astype("<u4")
    return out
