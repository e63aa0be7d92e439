"""Static range asymmetric numeral system over numpy lanes.

A block of ids is dealt to LANES interleaved lanes, id t * LANES + j to step t of lane j; all lanes of all given
blocks advance together. States stay in [2^31, 2^63), one 32-bit word at most leaves or enters a lane a step, and words
lie in the order in which a decoder wants them. Every CHECKPOINT steps the states and the word count are recorded, so
a block can be decoded from several places at once.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

LANES = 64
CHECKPOINT = 256
SCALE = 20
_LOW = np.uint64(1 << 31)


@dataclass
class Table:
    """Shared frequencies of all ids, scaled to sum to 2^SCALE, none of them 0."""

    freq: np.ndarray
    start: np.ndarray
    slot: np.ndarray
    crc: int

    @classmethod
    def of(cls, freq: np.ndarray) -> Table:
        freq = np.asarray(freq, np.uint64)
        start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        return cls(freq, start, np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64)), zlib.crc32(freq.astype("<u8").tobytes()))

    @classmethod
    def from_counts(cls, counts: np.ndarray, scale: int = SCALE) -> Table:
        """Each id gets 1, and the rest of 2^scale is shared in proportion to the counts."""
        total, room = int(counts.sum()), (1 << scale) - len(counts)
        if room < 0:
            raise ValueError("more ids than the scale has slots")
        share = (counts.astype(np.float64) * (room / total) if total else np.zeros(len(counts))).astype(np.int64)
        freq = share + 1
        freq[int(np.argmax(counts)) if len(counts) else 0] += (1 << scale) - int(freq.sum())
        return cls.of(freq)


@dataclass
class Block:
    n: int
    words: bytes
    states: bytes  # of each checkpoint: LANES states
    at: list[int]  # words before each checkpoint
    crc: int  # of all of it and of the frequency table


def _crc(n: int, words: bytes, states: bytes, at: list[int], table: Table) -> int:
    return zlib.crc32(np.array([n, table.crc, *at], "<i8").tobytes(), zlib.crc32(states, zlib.crc32(words)))


def encode(blocks: list[np.ndarray], table: Table) -> list[Block]:
    if not blocks:
        return []
    steps = [-(-len(b) // LANES) for b in blocks]
    most, n = max([*steps, 1]), len(blocks)
    ids = np.zeros((most, n * LANES), np.int64)
    live = np.zeros((most, n * LANES), bool)
    for k, b in enumerate(blocks):
        full = np.zeros(steps[k] * LANES, np.int64)
        full[: len(b)] = b
        ids[: steps[k], k * LANES : (k + 1) * LANES] = full.reshape(steps[k], LANES)
        flags = np.zeros(steps[k] * LANES, bool)
        flags[: len(b)] = True
        live[: steps[k], k * LANES : (k + 1) * LANES] = flags.reshape(steps[k], LANES)
    x = np.full(n * LANES, _LOW, np.uint64)
    sent = np.zeros((most, n * LANES), bool)
    words = np.zeros((most, n * LANES), np.uint32)
    marks: dict[int, np.ndarray] = {}
    for t in range(most - 1, -1, -1):
        f, s, go = table.freq[ids[t]], table.start[ids[t]], live[t]
        full = go & ((x >> np.uint64(63 - SCALE)) >= f)
        words[t] = x.astype(np.uint32)
        sent[t] = full
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = np.where(go, (q << np.uint64(SCALE)) + (x - q * f) + s, x)
        if t % CHECKPOINT == 0:
            marks[t] = x.copy()
    out = []
    for k, b in enumerate(blocks):
        lanes = slice(k * LANES, (k + 1) * LANES)
        mine = sent[: steps[k], lanes]
        per_step = np.concatenate([[0], np.cumsum(mine.sum(axis=1))])
        places = range(0, max(steps[k], 1), CHECKPOINT)
        payload = words[: steps[k], lanes][mine].tobytes()
        states = b"".join(marks[t][lanes].tobytes() for t in places)
        at = [int(per_step[t]) for t in places]
        out.append(Block(len(b), payload, states, at, _crc(len(b), payload, states, at, table)))
    return out


def decode(blocks: list[Block], table: Table) -> list[np.ndarray]:
    """The ids of each block; every checkpoint of every block is decoded as a lane group of its own."""
    jobs = []
    for k, b in enumerate(blocks):
        if _crc(b.n, b.words, b.states, b.at, table) != b.crc:
            raise ValueError(f"block {k}: the checksum doesn't match")
        states = np.frombuffer(b.states, np.uint64).reshape(-1, LANES)
        for c, at in enumerate(b.at):
            left = b.n - c * CHECKPOINT * LANES
            jobs.append((k, states[c], at, max(0, min(left, CHECKPOINT * LANES))))
    base = np.concatenate([[0], np.cumsum([len(b.words) // 4 for b in blocks])]).astype(np.int64)
    stream = np.concatenate([np.frombuffer(b.words, np.uint32) for b in blocks] + [np.zeros(1, np.uint32)]).astype(np.uint64)
    if not jobs:
        return []
    x = np.concatenate([j[1] for j in jobs])
    at = np.array([base[j[0]] + j[2] for j in jobs], np.int64)
    n = np.array([j[3] for j in jobs], np.int64)
    lane = np.arange(LANES)
    most = int(-(-n.max() // LANES)) if len(n) else 0
    ids = np.zeros((most, len(x)), np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    for t in range(most):
        go = (t * LANES + lane[None, :] < n[:, None]).ravel()
        low = x & mask
        s = table.slot[low.astype(np.int64)]
        ids[t] = s
        x = np.where(go, table.freq[s] * (x >> np.uint64(SCALE)) + low - table.start[s], x)
        need = (go & (x < _LOW)).reshape(-1, LANES)
        rank = np.cumsum(need, axis=1) - need
        word = stream[np.minimum((at[:, None] + rank).ravel(), len(stream) - 1)]
        x = np.where(need.ravel(), (x << np.uint64(32)) | word, x)
        at += need.sum(axis=1)
    parts: list[list[np.ndarray]] = [[] for _ in blocks]
    for g, (k, _, _, count) in enumerate(jobs):
        parts[k].append(ids[:, g * LANES : (g + 1) * LANES].ravel()[:count])
    return [np.concatenate(p) for p in parts]
