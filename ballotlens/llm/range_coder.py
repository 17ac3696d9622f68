"""An adaptive context-mixing range coder for token ids, many lanes abreast.

Each block of at most ``BLOCK_IDS`` ids is coded on its own, from a fresh
model.  A block is cut into lanes of some ``LANE_IDS`` ids, each with a range
coder of its own, which lie side by side in numpy arrays: every step codes the
next id of each lane, under one model that learns from all of them.  All
arithmetic is in integers, so any machine decodes what another wrote.

The model of a block, for each id:

* the last id seen after the two ids before (order 2) and after the one before
  (order 1), each with a count of how often it held; the one that held more
  often, order 2's if equal, is the candidate;
* the probability that the candidate is the next id mixes four inputs in the
  logistic domain: both orders' log odds by those counts, order 0's log
  probability of the candidate, and the log odds by which candidates in that
  situation (counts, agreement, order 0's level) were right so far.  The
  weights, a set for each of order 2's counts, learn from every outcome, some
  steps at once;
* an id that isn't the candidate is coded under its order-0 frequency in the
  block, brought up to date every few steps; ids that are new there, or too
  rare, follow an escape as they are.

Ids take two bytes, or three where one of a sequence is over 65,535.  The range
coder is carryless with 64-bit state and moves out 32 bits at a time; a step
shrinks the range by 28 bits at most, an escaped id by 24 more after that.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK_IDS = 1 << 21
LANES = 4096                  # lanes of a block at most
LANE_IDS = 512                # ids of a lane, where the block has enough of them
MAGIC, VERSION = b"IDRC", 3   # a block starts with these, its ids' bytes, its ids, and crc32 of its ids
HEADER = 14
BITS = {2: 16, 3: 24}         # an escaped id, by the bytes of an id
KNOWN = {2: 16, 3: 18}        # bits of the ids that order 0 counts
SHARES = 16                   # order-0 frequencies add up to 2 to this
REFRESH, RECOUNT = 16, 128    # steps between updates of the mix and of order 0

_U = np.uint64
_WORD = _U(32)
_FULL = _U(1 << 32)
#: log odds (256: one nat) that a guess holds which has held so often; the first: no guess
_ODDS = np.array([-256, 0, 300, 500, 650, 800, 950, 1100], np.int64)
_SQUASH = np.clip(np.rint(4096 / (1 + np.exp(-(np.arange(4096) - 2048) / 256))), 1, 4095).astype(np.int32)
_LOG = np.rint(32 * np.log(np.maximum(np.arange((1 << SHARES) + 1), 1))).astype(np.int32)    # 32: one nat
_TALLY = np.rint(256 * np.log(np.arange(1 << 14) + 0.5)).astype(np.int64)
_NONE = 1 << 24               # ids lie below
_SITUATIONS = np.arange(2048)                                  # order 2's count, order 1's, whether they agree, order 0's level
_TWO, _ONE, _AGREE, _LEVEL = _SITUATIONS >> 8, _SITUATIONS >> 5 & 7, _SITUATIONS >> 4 & 1, _SITUATIONS & 15
_FIXED = np.stack([np.where((_AGREE > 0) | (_TWO >= _ONE), _ODDS[_TWO], -256), np.where((_AGREE > 0) | (_TWO < _ONE), _ODDS[_ONE], -256), (_LEVEL - 15) * 192])


class _Model:
    """The model of a block of ids that take ``width`` bytes."""

    def __init__(self, lanes: int, width: int):
        self.known, self.mask = 1 << KNOWN[width], np.uint32((1 << KNOWN[width]) - 1)
        self.seen = np.zeros(1 << 18, np.uint32), np.zeros(self.known, np.uint32)    # id times 8, and how often it held
        self.weight = np.repeat(np.array([[20000], [20000], [3000], [30000]], np.int64), 8, 1)    # 16 bits: 1.0 is 65536
        self.tried, self.right = np.zeros((2, 2048), np.int64)
        self.counts, self.n = np.zeros(self.known, np.int64), 0
        self.one, self.two = np.zeros((2, lanes), np.uint32)        # the ids before
        self.outcomes: list[np.ndarray] = []
        self.mix()
        self.recount(np.empty(0, np.uint32))

    def mix(self) -> None:
        """The outcomes since the last time teach the weights and the tallies."""
        if self.outcomes:
            found = np.bincount(np.concatenate(self.outcomes), minlength=4096).reshape(2048, 2)
            self.outcomes = []
            tried, right = found.sum(1), found[:, 1]
            error = (right * 4096 - tried * self.p).reshape(8, 256)
            slope = (self.inputs.reshape(4, 8, 256) * error).sum(2)
            self.weight += slope // np.maximum(tried.reshape(8, 256).sum(1), 1) >> 9
            self.tried += tried
            self.right += right
            old = self.tried > 8000
            while old.any():
                self.tried[old] >>= 1
                self.right[old] >>= 1
                old = self.tried > 8000
        tally = _TALLY[self.right] - _TALLY[self.tried - self.right]
        self.inputs = np.concatenate((_FIXED, tally[None]))
        dot = (self.inputs.reshape(4, 8, 256) * self.weight[:, :, None]).sum(0).reshape(-1) >> 16
        self.p = _SQUASH[np.minimum(np.maximum(dot, -2048), 2047) + 2048]

    def recount(self, ids: np.ndarray) -> None:
        """Order 0's frequencies with these ids, too."""
        ids = ids[ids < self.known]
        self.counts += np.bincount(ids, minlength=self.known)
        self.n += len(ids)
        total, at = 1 << SHARES, np.flatnonzero(self.counts)
        share = np.zeros(self.known, np.int32)
        if self.n:
            share[at] = self.counts[at] * (total * self.n // (self.n + len(at))) // self.n
        at = np.flatnonzero(share)
        sizes = share[at]
        ends = np.cumsum(sizes, dtype=np.int32)
        rest = int(ends[-1]) if len(at) else 0                      # where the escape begins
        self.start, self.width = np.full(self.known + 1, rest, np.int32), np.full(self.known + 1, total - rest, np.int32)
        self.start[at], self.width[at] = ends - sizes, sizes
        self.new = np.ones(self.known + 1, bool)
        self.new[at] = False
        self.id_at = np.full(total, self.known, np.uint32)
        self.id_at[:rest] = np.repeat(at, sizes)
        self.level = np.minimum(np.maximum(15 + (_LOG[share] - _LOG[total]) // 24, 0), 15).astype(np.uint32)

    def look(self) -> tuple[np.ndarray, np.ndarray]:
        """The candidate and the probability of 4096 that it's next."""
        a, b = self.one, self.two
        self.at = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B) >> np.uint32(14)).astype(np.intp), (a & self.mask).astype(np.intp)
        two, one = self.found = self.seen[0].take(self.at[0]), self.seen[1].take(self.at[1])
        n_two, n_one = self.held = two & 7, one & 7
        candidate = np.where(n_two >= n_one, two, one) >> 3
        level = self.level.take(candidate & self.mask)
        self.situation = (n_two << 8 | n_one << 5 | ((two ^ one) < 8).astype(np.uint32) << 4 | level).astype(np.intp)
        return candidate, self.p.take(self.situation)

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        self.outcomes.append(self.situation * 2 + hit)
        fresh = ids << 3 | 1
        for seen, at, entry, held in zip(self.seen, self.at, self.found, self.held):
            seen[at] = np.where(entry >> 3 == ids, entry + (held < 7), np.where(held > 1, entry - held + (held >> 1), fresh))
        self.two, self.one = self.one, ids

    def refresh(self, table: np.ndarray, step: int, counted: int) -> int:
        """After a step; gives up to which step order 0 has counted."""
        done = step + 1
        if done < len(table) and (done % REFRESH == 0 or done & step == 0):
            self.mix()
            if done % RECOUNT == 0 or done & step == 0:
                self.recount(table[counted:done].reshape(-1))
                return done
        return counted


def _settle(low, rng, shift, at=None) -> None:
    """Moves the top word out of the states whose range is below a word."""
    at = np.flatnonzero(rng < _FULL) if at is None else at[rng[at] < _FULL]
    if len(at):
        lo, r = low[at], rng[at]
        apart = (lo ^ lo + r) >= _FULL
        r = np.where(apart, (_U(0) - lo) & (_FULL - _U(1)), r)
        shift(at, lo)
        low[at], rng[at] = lo << _WORD, r << _WORD


def _shape(n: int) -> tuple[int, int]:
    """Steps and lanes of a block of n ids."""
    lanes = min(LANES, -(-n // LANE_IDS))
    return -(-n // lanes), lanes


def _encode_block(block: np.ndarray, width: int) -> bytes:
    steps, n = _shape(len(block))
    table = np.zeros(steps * n, np.uint32)
    table[:len(block)] = block
    table = np.ascontiguousarray(table.reshape(n, steps).T)
    model, bits = _Model(n, width), _U(BITS[width])
    low, rng = np.zeros(n, _U), np.full(n, ~_U(0), _U)
    most = 2 * steps + 1
    out, pos, first = np.zeros(n * most, "<u4"), np.zeros(n, np.int64), np.arange(n) * most

    def shift(at, lo):
        out[first[at] + pos[at]] = lo >> _WORD
        pos[at] += 1

    counted = 0
    for step in range(steps):
        ids = table[step]
        candidate, p = model.look()
        hit = candidate == ids
        symbol = np.minimum(ids, model.known)
        edge, rest = p << SHARES, 4096 - p
        r = rng >> _U(12 + SHARES)
        low += r * np.where(hit, 0, edge + rest * model.start.take(symbol)).astype(_U)
        rng = r * np.where(hit, edge, rest * model.width.take(symbol)).astype(_U)
        _settle(low, rng, shift)
        at = np.flatnonzero(model.new.take(symbol) & ~hit)
        if len(at):
            r = rng[at] >> bits
            low[at] += r * ids[at]
            rng[at] = r
            _settle(low, rng, shift, at)
        model.learn(ids, hit)
        counted = model.refresh(table, step, counted)
    shift(np.arange(n), low + (_FULL - _U(1)))        # a word is enough, as ranges are no less
    kept = np.arange(most) < pos[:, None]
    return pos.astype("<u2").tobytes() + out.reshape(n, most)[kept].tobytes()


def _decode_block(payload: bytes, length: int, width: int) -> np.ndarray:
    steps, n = _shape(length)
    sizes = np.frombuffer(payload, "<u2", min(n, len(payload) // 2)).astype(np.int64)
    if len(sizes) < n or 2 * n + 4 * int(sizes.sum()) != len(payload):
        raise ValueError("a block's lanes don't fill it")
    most = int(sizes.max()) + 2
    data = np.zeros((n, most), _U)
    data[np.arange(most) < sizes[:, None]] = np.frombuffer(payload, "<u4", offset=2 * n)
    code, data, first = data[:, 0] << _WORD | data[:, 1], data.reshape(-1), np.arange(n) * most
    model, bits = _Model(n, width), _U(BITS[width])
    low, rng, pos = np.zeros(n, _U), np.full(n, ~_U(0), _U), np.full(n, 2)
    table = np.zeros((steps, n), np.uint32)
    last = _U((1 << 12 + SHARES) - 1)

    def shift(at, lo):
        code[at] = code[at] << _WORD | data[first[at] + np.minimum(pos[at], most - 1)]      # a damaged block may run on
        pos[at] += 1

    counted = 0
    for step in range(steps):
        candidate, p = model.look()
        edge, rest = p << SHARES, 4096 - p
        r = rng >> _U(12 + SHARES)
        value = np.minimum((code - low) // r, last).astype(np.int32)
        hit = value < edge
        symbol = model.id_at.take(np.where(hit, 0, value - edge) // rest)
        low += r * np.where(hit, 0, edge + rest * model.start.take(symbol)).astype(_U)
        rng = r * np.where(hit, edge, rest * model.width.take(symbol)).astype(_U)
        _settle(low, rng, shift)
        ids = np.where(hit, candidate, symbol)
        at = np.flatnonzero((symbol == model.known) & ~hit)
        if len(at):
            r = rng[at] >> bits
            x = np.minimum((code[at] - low[at]) // r, (_U(1) << bits) - _U(1))
            low[at] += r * x
            rng[at] = r
            ids[at] = x
            _settle(low, rng, shift, at)
        table[step] = ids
        model.learn(ids, hit)
        counted = model.refresh(table, step, counted)
    return table.T.reshape(-1)[:length]


def encode(ids: np.ndarray) -> list[bytes]:
    """A sequence of ids below 2 to the 24th as independent blocks."""
    if len(ids) and (int(ids.max()) >= _NONE or int(ids.min()) < 0):
        raise ValueError("ids take 24 bits")
    width = 3 if len(ids) and int(ids.max()) > 0xFFFF else 2
    out = []
    for k in range(0, len(ids), BLOCK_IDS):
        b = np.ascontiguousarray(ids[k:k + BLOCK_IDS], "<u4")
        out.append(MAGIC + bytes([VERSION, width]) + len(b).to_bytes(4, "little") + zlib.crc32(b.tobytes()).to_bytes(4, "little") + _encode_block(b, width))
    return out


def decode(blocks: list[bytes]) -> np.ndarray:
    """The ids of blocks, which may come from anywhere in a file; a damaged
    block raises ValueError."""
    found = []
    for b in blocks:
        if len(b) < HEADER or b[:5] != MAGIC + bytes([VERSION]) or b[5] not in BITS or not 0 < int.from_bytes(b[6:10], "little") <= BLOCK_IDS:
            raise ValueError("not a block of token ids")
        ids = _decode_block(b[HEADER:], int.from_bytes(b[6:10], "little"), b[5])
        if zlib.crc32(ids.astype("<u4").tobytes()) != int.from_bytes(b[10:14], "little"):
            raise ValueError("a block's checksum differs")
        found.append(ids)
    return np.concatenate(found) if found else np.empty(0, np.uint32)
