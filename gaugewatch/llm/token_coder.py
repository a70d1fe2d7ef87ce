"""A context-mixing range coder for token ids, in numpy.

A block of ids is cut into equal lanes that are coded side by side, so one numpy call codes one
id of every lane. The lanes share a model that starts empty in every block. It knows

* order 2: the id that last followed the same two ids, and how often in a row (0 to 3 times more),
* order 1: the id that last followed the same id, and how often in a row,
* order 0: how often each id came that neither of them foresaw.

Their predictions are mixed: the weights of the three are the shares in which each was right
so far in the same state (both counts, and whether they agree). A range coder first narrows
its range to the order that foresaw the id, then, for order 0, to the id's own share. Encoder
and decoder update the model from the same ids in the same order, so the weights agree.
"""

from __future__ import annotations

import numpy as np

#: Lanes of a block and ids of a lane at most; shorter blocks have lanes of at least ``LANE_LEAST`` ids.
LANES, LANE_IDS, LANE_LEAST = 8192, 256, 128
BLOCK_IDS = LANES * LANE_IDS
#: Bits of the hash of two ids, of the mixing weights' total, and of the order-0 total.
PAIR_BITS, MIX_BITS, ID_BITS = 20, 15, 20
#: States of the mixer, three outcomes each; what one id adds to its order-0 count.
STATES, GAIN = 32, 32
#: Ids that order 0 gathers before its shares are made anew: so many, and this part of all so far.
FRESH, FRESH_PART = 16_384, 8
#: Below this the range is too small, and 32 bits leave the coder.
LEAST = np.uint64(1 << 32)
SHIFT = np.uint64(32)
#: Ids of every lane after which the mixing weights are made anew.
MIX_STEPS = 4
#: The hash of two ids.
SPREAD, PAIR_TURN, PAIR_DROP = np.uint32(0x9E3779B1), np.uint32(9), np.uint32(32 - PAIR_BITS)


class Mixer:
    """The shared model of a block: predictions, their mixing weights and the order-0 shares."""

    def __init__(self, ids: int, lanes: int):
        self.ids = ids
        # id * 4 + surety
        self.after_one = np.zeros(ids, np.int32)
        self.after_two = np.zeros(1 << PAIR_BITS, np.int32)
        # The last id of each lane, and the spread code of the one before.
        self.one = np.zeros(lanes, np.int64)
        self.code = np.zeros(lanes, np.uint32)
        self.right = np.ones((STATES, 3), np.int64)
        self.counts = np.ones(ids, np.int64)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_counted = self.steps = 0
        self._mix()
        self._share()

    def _mix(self) -> None:
        """Mixing weights of every state, at least one each, as whole parts of 2**MIX_BITS."""
        total = self.right.sum(1)
        if total.max() > 1 << 24:
            self.right = (self.right >> 1) + 1
            total = self.right.sum(1)
        parts = 1 + self.right * ((1 << MIX_BITS) - 3) // total[:, None]
        parts[:, 2] += (1 << MIX_BITS) - parts.sum(1)
        ends = np.cumsum(parts, 1)
        self.weight = parts.astype(np.uint64).ravel()
        self.weight_from = (ends - parts).astype(np.uint64).ravel()
        self.first_end, self.second_end = ends[:, 0].copy(), ends[:, 1].copy()

    def _share(self) -> None:
        """Order-0 shares of all ids, at least one each, as whole parts of 2**ID_BITS."""
        if self.waiting:
            self.counts += GAIN * np.bincount(np.concatenate(self.waiting), minlength=self.ids)
            self.n_counted += self.n_waiting
            self.waiting, self.n_waiting = [], 0
        parts = 1 + self.counts * ((1 << ID_BITS) - self.ids) // self.counts.sum()
        parts[parts.argmax()] += (1 << ID_BITS) - parts.sum()
        self.share = parts.astype(np.uint64)
        self.share_from = (np.cumsum(parts) - parts).astype(np.uint64)
        self._owners = None

    @property
    def owners(self) -> np.ndarray:
        """The id that owns each part, for the decoder."""
        if self._owners is None:
            self._owners = np.repeat(np.arange(self.ids, dtype=np.int32), self.share.astype(np.int64))
        return self._owners

    def predict(self, n: int) -> np.ndarray:
        """Looks up both predictions of the first ``n`` lanes; gives the states of the mixer."""
        self.now_code = self.one[:n].astype(np.uint32) * SPREAD
        self.pair = (((self.code[:n] >> PAIR_TURN) ^ self.now_code) >> PAIR_DROP).astype(np.int64)
        self.guess_one = self.after_one.take(self.one[:n], mode="clip")
        self.guess_two = self.after_two.take(self.pair, mode="clip")
        self.sure_one, self.sure_two = self.guess_one & 3, self.guess_two & 3
        self.first, self.second = self.guess_two >> 2, self.guess_one >> 2
        state = self.sure_two << 2
        state |= self.sure_one
        state <<= 1
        state += self.first == self.second
        return state

    def learn(self, ids: np.ndarray, slots: np.ndarray, new: np.ndarray) -> None:
        """Takes over the coded ids, the outcomes (state * 3 + order) and the ids no order foresaw."""
        n = len(ids)
        narrow = ids.astype(np.int32)
        fresh = narrow << 2
        # The newest id is the next prediction, surer for every time that it came in a row.
        for table, at, sure, said in (
            (self.after_one, self.one[:n], self.sure_one, self.second),
            (self.after_two, self.pair, self.sure_two, self.first),
        ):
            sure += 1
            np.minimum(sure, 3, out=sure)
            sure *= said == narrow
            sure += fresh
            table[at] = sure
        self.code[:n] = self.now_code
        self.one[:n] = ids
        self.right += np.bincount(slots, minlength=3 * STATES).reshape(STATES, 3)
        self.steps += 1
        if self.steps % MIX_STEPS == 0 or self.steps < MIX_STEPS:
            self._mix()
        if len(new):
            self.waiting.append(new)
            self.n_waiting += len(new)
            if self.n_waiting >= FRESH and self.n_waiting * FRESH_PART >= self.n_counted:
                self._share()


def lanes_of(n: int) -> tuple[int, int]:
    """Lanes of a block of ``n`` ids and ids of a lane; the last lanes may be one id shorter than the first."""
    lanes = min(LANES, max(1, n // LANE_LEAST))
    return lanes, -(-n // lanes)


def _lengths(n: int, lanes: int) -> np.ndarray:
    return n // lanes + (np.arange(lanes) < n % lanes)


def encode(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit digits of each lane (how many, then all in lane order) for up to ``BLOCK_IDS`` ids."""
    lanes, steps = lanes_of(len(ids))
    lengths = _lengths(len(ids), lanes)
    starts = np.cumsum(lengths) - lengths
    mixer = Mixer(vocabulary, lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    given = np.zeros(lanes, np.int64)
    out_lanes: list[np.ndarray] = []
    out: list[np.ndarray] = []
    carried: list[tuple[np.ndarray, np.ndarray]] = []

    def narrow(at, begin: np.ndarray, share: np.ndarray, bits: int) -> None:
        """Narrow the ranges of lanes ``at``, then pass on digits that are settled."""
        part = span[at] >> np.uint64(bits)
        moved = part * begin
        low[at] += moved
        span[at] = part * share
        over = low[at] < moved
        if over.any():
            hit = np.flatnonzero(over) if isinstance(at, slice) else at[over]
            carried.append((hit, given[hit] - 1))
        ready = np.flatnonzero(span < LEAST)
        if len(ready):
            out_lanes.append(ready)
            out.append(low[ready] >> SHIFT)
            low[ready] <<= SHIFT
            span[ready] <<= SHIFT
            given[ready] += 1

    for step in range(steps):
        # Longer lanes come first.
        n = int(np.count_nonzero(lengths > step))
        now = ids[starts[:n] + step].astype(np.int64)
        state = mixer.predict(n)
        order = 2 - (now == mixer.second)
        order[now == mixer.first] = 0
        slots = state * 3 + order
        narrow(slice(0, n), mixer.weight_from.take(slots, mode="clip"), mixer.weight.take(slots, mode="clip"), MIX_BITS)
        new = np.flatnonzero(order == 2)
        fresh = now.take(new)
        if len(new):
            narrow(new, mixer.share_from.take(fresh, mode="clip"), mixer.share.take(fresh, mode="clip"), ID_BITS)
        mixer.learn(now, slots, fresh)
    every = np.arange(lanes)
    out_lanes += [every, every]
    out += [low >> SHIFT, low & np.uint64(0xFFFFFFFF)]
    lane, digits = np.concatenate(out_lanes), np.concatenate(out)
    counts = given + 2
    digits = digits[np.argsort(lane, kind="stable")]
    first = np.cumsum(counts) - counts
    if carried:
        places = np.concatenate([first[hit] + at for hit, at in carried])
        np.add.at(digits, places, np.uint64(1))
    # A carry may run on to the digit before.
    while len(full := np.flatnonzero(digits >> SHIFT)):
        digits[full] &= np.uint64(0xFFFFFFFF)
        np.add.at(digits, full - 1, np.uint64(1))
    return counts, digits.astype(np.uint32)


def decode(counts: np.ndarray, digits: np.ndarray, n_ids: int, vocabulary: int) -> np.ndarray:
    """The ``n_ids`` ids of a block."""
    lanes, steps = lanes_of(n_ids)
    lengths = _lengths(n_ids, lanes)
    starts = np.cumsum(lengths) - lengths
    mixer = Mixer(vocabulary, lanes)
    counts = np.asarray(counts, np.int64)
    # Lanes read zeros after their end.
    digits = np.concatenate([digits, np.zeros(2, digits.dtype)]).astype(np.uint64)
    at = np.cumsum(counts) - counts
    value = digits[at] << SHIFT | digits[at + 1]
    at += 2
    span = np.full(lanes, 2**64 - 1, np.uint64)
    found = np.empty(n_ids, np.uint32)

    def refill() -> None:
        ready = np.flatnonzero(span < LEAST)
        if len(ready):
            value[ready] = value[ready] << SHIFT | digits[at[ready]]
            span[ready] <<= SHIFT
            at[ready] += 1

    for step in range(steps):
        n = int(np.count_nonzero(lengths > step))
        state = mixer.predict(n)
        part = span[:n] >> np.uint64(MIX_BITS)
        seen = np.minimum(value[:n] // part, np.uint64((1 << MIX_BITS) - 1)).astype(np.int64)
        order = (seen >= mixer.first_end.take(state)).astype(np.int64)
        order += seen >= mixer.second_end.take(state)
        slots = state * 3 + order
        value[:n] -= part * mixer.weight_from.take(slots)
        span[:n] = part * mixer.weight.take(slots)
        refill()
        now = np.where(order == 0, mixer.first, mixer.second).astype(np.int64)
        new = np.flatnonzero(order == 2)
        if len(new):
            part = span.take(new) >> np.uint64(ID_BITS)
            left = value.take(new)
            seen = np.minimum(left // part, np.uint64((1 << ID_BITS) - 1))
            owner = mixer.owners.take(seen.astype(np.int64)).astype(np.int64)
            now[new] = owner
            value[new] = left - part * mixer.share_from.take(owner)
            span[new] = part * mixer.share.take(owner)
            refill()
        found[starts[:n] + step] = now
        mixer.learn(now, slots, now.take(new))
    return found
