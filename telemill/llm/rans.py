"""Static range asymmetric numeral system for token ids.

One frequency table serves all blocks.  A block holds up to ``BLOCK`` ids dealt over ``LANES`` interleaved
states, stands alone, and is checked by a CRC of its ids.  Every ``INTERVAL`` steps it has a checkpoint
(the states and the position in the word stream), so sections of one block decode in parallel too.
All blocks and sections of one call run in lockstep, one numpy operation for each step.

Block layout, little-endian: magic ``RANS``, version, lanes and interval (16 bits each), a pad, number of ids,
of checkpoints and of words, CRC of the ids, CRC of the table (32 bits each); then the checkpoints' word
positions (32 bits), their states (64 bits a lane) and the words (32 bits).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20
LANES = 32
BLOCK = 16384
INTERVAL = 128
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sHHHHIIIII")
_U32 = np.uint64(32)


class Table:
    """Frequencies scaled to ``2 ** SCALE``; every id that occurs gets at least one slot."""

    def __init__(self, freqs: np.ndarray):
        self.freqs = freqs.astype(np.uint64)
        self.starts = np.cumsum(self.freqs) - self.freqs
        self.crc = zlib.crc32(freqs.astype("<u4").tobytes())
        self._symbols: np.ndarray | None = None

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        counts = np.asarray(counts, np.float64)
        seen = counts > 0
        n = int(seen.sum())
        if not n:
            return cls(np.zeros(len(counts), np.int64))
        if n > 1 << SCALE:
            raise ValueError("more distinct ids than slots")
        room = (1 << SCALE) - n
        freqs = np.where(seen, 1 + np.floor(counts / counts.sum() * room), 0).astype(np.int64)
        freqs[np.argmax(counts)] += (1 << SCALE) - freqs.sum()
        return cls(freqs)

    @property
    def symbols(self) -> np.ndarray:
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.freqs), dtype=np.uint32), self.freqs.astype(np.int64))
        return self._symbols


def encode(ids: np.ndarray, table: Table) -> list[bytes]:
    """The blocks of a run of ids."""
    n = len(ids)
    if not n:
        return []
    blocks = -(-n // BLOCK)
    steps = -(-n // LANES) if blocks == 1 else BLOCK // LANES
    sizes = np.full(blocks, BLOCK, np.int64)
    sizes[-1] = n - (blocks - 1) * BLOCK
    # Places after the end take all slots from 0: coding them changes nothing.
    room = blocks * steps * LANES
    freqs, starts = np.full(room, 1 << SCALE, np.uint64), np.zeros(room, np.uint64)
    freqs[:n], starts[:n] = table.freqs[ids], table.starts[ids]
    by_step = lambda x: np.ascontiguousarray(x.reshape(blocks, steps, LANES).transpose(1, 0, 2)).reshape(steps, -1)
    freqs, starts = by_step(freqs), by_step(starts)
    limits = freqs << np.uint64(63 - SCALE)
    state = np.full(blocks * LANES, _LOW, np.uint64)
    out, where = [], []
    emitted, counted = np.zeros(blocks, np.int64), 0
    marks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    scale = np.uint64(SCALE)
    for t in range(steps - 1, -1, -1):
        freq = freqs[t]
        full = np.nonzero(state >= limits[t])[0]
        top = state[full]
        out.append(top.astype(np.uint32))
        where.append(full)
        state[full] = top >> _U32
        quotient = state // freq
        state = (quotient << scale) + (state - quotient * freq) + starts[t]
        if t % INTERVAL == 0:
            new = np.concatenate(where[counted:]) // LANES
            counted = len(where)
            emitted = emitted + np.bincount(new, minlength=blocks)
            marks[t] = (state.reshape(blocks, LANES).copy(), emitted)
    words, of = np.concatenate(out[::-1]), np.concatenate(where[::-1]) // LANES
    order = np.argsort(of.astype(np.uint16 if blocks <= 1 << 16 else np.int64), kind="stable")
    words, cuts = words[order], np.concatenate([[0], np.cumsum(emitted)])
    frames = []
    for b in range(blocks):
        own = [t for t in sorted(marks) if t * LANES < sizes[b]]
        at = np.array([emitted[b] - marks[t][1][b] for t in own], "<u4")
        states = np.stack([marks[t][0][b] for t in own]).astype("<u8")
        mine = words[cuts[b]:cuts[b + 1]].astype("<u4")
        part = ids[b * BLOCK:b * BLOCK + sizes[b]].astype("<u4")
        frames.append(_HEAD.pack(b"RANS", 1, LANES, INTERVAL, 0, len(part), len(own), len(mine),
                                 zlib.crc32(part.tobytes()), table.crc)
                      + at.tobytes() + states.tobytes() + mine.tobytes())
    return frames


def decode(frames: list[bytes], table: Table) -> np.ndarray:
    """The ids of some blocks in turn; raises ``ValueError`` on a damaged block or another table."""
    states, places, counts, words, heads, base = [], [], [], [], [], 0
    for frame in frames:
        magic, version, lanes, interval, _, n, marks, size, crc, table_crc = _HEAD.unpack_from(frame)
        if (magic, version, lanes, interval) != (b"RANS", 1, LANES, INTERVAL) or table_crc != table.crc:
            raise ValueError("not a block of this table")
        if len(frame) != _HEAD.size + marks * 4 + marks * lanes * 8 + size * 4:
            raise ValueError("a block is cut short")
        at = _HEAD.size
        places.append(base + np.frombuffer(frame, "<u4", marks, at).astype(np.int64))
        at += 4 * marks
        states.append(np.frombuffer(frame, "<u8", marks * lanes, at).reshape(marks, lanes))
        at += 8 * marks * lanes
        words.append(np.frombuffer(frame, "<u4", size, at))
        counts.append(np.minimum(interval * lanes, n - np.arange(marks) * interval * lanes))
        heads.append((n, crc))
        base += size
    if not frames:
        return np.zeros(0, np.uint32)
    state, place, count = np.concatenate(states).astype(np.uint64), np.concatenate(places), np.concatenate(counts)
    stream = np.concatenate([*words, np.zeros(LANES, np.uint32)]).astype(np.uint64)
    lane = np.arange(LANES)
    steps = -(-int(count.max()) // LANES)
    out = np.zeros((len(count), steps, LANES), np.uint32)
    scale, mask = np.uint64(SCALE), np.uint64((1 << SCALE) - 1)
    always = int(count.min()) // LANES  # steps in which every lane of every section is live
    for t in range(steps):
        slot = state & mask
        symbol = table.symbols[slot.astype(np.int64)]
        out[:, t] = symbol
        new = table.freqs[symbol] * (state >> scale) + slot - table.starts[symbol]
        if t < always:
            state = new
            empty = state < _LOW
        else:
            live = t * LANES + lane < count[:, None]
            state = np.where(live, new, state)
            empty = live & (state < _LOW)
        section, k = np.nonzero(empty)
        sizes = np.bincount(section, minlength=len(count))
        ends = np.cumsum(sizes)
        got = stream[place[section] + np.arange(len(section)) - (ends - sizes)[section]]
        state[section, k] = (state[section, k] << _U32) | got
        place = place + sizes
    last = np.cumsum([len(s) for s in states]) - 1
    if (state[last] != _LOW).any():
        raise ValueError("a block does not end where it began")
    flat = out.reshape(len(count), -1)
    ids = np.concatenate([row[:n] for row, n in zip(flat, count)])
    at = 0
    for n, crc in heads:
        if zlib.crc32(ids[at:at + n].astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum differs")
        at += n
    return ids
