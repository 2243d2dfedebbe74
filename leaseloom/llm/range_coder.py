"""A context-mixing range coder for token ids that runs many independent blocks side by side in numpy.

In each block three contexts predict the next id: what followed the last two ids, what followed the last id, and the id that holds the
majority so far. The highest context that knows something names a candidate; how often each context has been right at its present
confidence is mixed, with weights that learn, into the chance that the candidate comes next. That yes or no is range coded, and an id
that was not foreseen follows as it is. Everything is integer arithmetic, so a reader repeats the writer's steps exactly."""

from __future__ import annotations

import math
import zlib

import numpy as np

#: Ids of a block. A block starts with empty contexts and has its own checksum.
BLOCK_IDS = 512
#: Blocks of a page.
LANES = 8192
#: Blocks that are coded side by side, few enough for their contexts to stay in the processor's cache; more follow in further groups.
SIDE_BY_SIDE = 4096
_SLOTS = 256
_LIMIT = 15
_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
_16, _48, _LOWEST = np.uint64(16), np.uint64(48), np.uint64((1 << 32) - 1)
_SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2048, 2048)], np.int32)
_STRETCH = np.array([max(-2047, min(2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)], np.int32)

#: What a cell's confidence changes by: half of it is lost after another id, one is gained after the same one.
_STEP = np.array([*((s >> 1) - s for s in range(16)), *(int(s < _LIMIT) for s in range(16))], np.int32)


class _Model:
    """The contexts of all blocks, one lane a block. A context's cell holds its id times 16 and how sure it is of it."""

    def __init__(self, lanes: int):
        #: Cells of the contexts one after the other: two ids, one id, the majority.
        self.cells = np.zeros(lanes * (2 * _SLOTS + 1), np.int32)
        self.right = np.full(3 * lanes * (_LIMIT + 1), 32768, np.int32)
        self.weight = np.full((3, lanes), 28000, np.int32)
        self.slots = np.arange(2 * lanes, dtype=np.int32).reshape(2, lanes) * np.int32(_SLOTS)
        self.rows = np.arange(3 * lanes, dtype=np.int32).reshape(3, lanes) * np.int32(_LIMIT + 1)
        self.at = np.empty((3, lanes), np.intp)
        self.at[2] = np.arange(2 * lanes * _SLOTS, len(self.cells))
        self.last = np.zeros(lanes, np.int32)
        self.before = np.zeros(lanes, np.int32)

    def shrink(self, lanes: int) -> None:
        """Only the first lanes go on."""
        self.last, self.before = self.last[:lanes], self.before[:lanes]
        self.weight, self.slots, self.rows, self.at = (np.ascontiguousarray(x[:, :lanes]) for x in (self.weight, self.slots, self.rows, self.at))

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The candidate of each lane and its chance in 65536ths."""
        mixed = self.last * np.int32(40_503)
        both = np.stack([mixed + self.before * np.int32(30_011), mixed])
        self.at[:2] = ((both >> 4) & (_SLOTS - 1)) + self.slots
        self.cell = self.cells.take(self.at)
        self.found, self.sure = self.cell >> 4, self.cell & _LIMIT
        known = self.sure > 0
        self.candidate = np.where(known[0], self.found[0], np.where(known[1], self.found[1], self.found[2]))
        self.place = (self.rows + self.sure).astype(np.intp)
        self.rate = self.right.take(self.place)
        # another id speaks against the candidate, an empty cell says nothing
        sign = ((self.found == self.candidate).view(np.int8) * np.int8(2) - np.int8(1)) * known.view(np.int8)
        self.input = _STRETCH.take(self.rate >> 4) * sign
        said = (self.input * self.weight) >> 16
        self.chance = _SQUASH.take(said[0] + said[1] + said[2] + 2048, mode="clip")
        return self.candidate, np.minimum(np.maximum(self.chance << 4, 128), 65408)

    def update(self, ids: np.ndarray) -> None:
        error = ((ids == self.candidate) * np.int32(4095) - self.chance) * np.int32(6)
        self.weight += (self.input * error + 0x2000) >> 14
        right, sure = self.found == ids, self.sure
        self.right[self.place] = self.rate + ((right * np.int32(65520) - self.rate) >> 4)
        # surer by one after the same id; half as sure after another one, which takes the cell once nothing is left
        step = _STEP.take((right << 4) + sure)
        self.cells[self.at] = np.where(right | (sure > 1), self.cell + step, (ids << 4) + 1)
        self.before, self.last = self.last, ids


class _Coder:
    """Low end and width of what is still possible, 64 bits each; 16 bits leave whenever they are settled."""

    def __init__(self, lanes: int):
        self.low, self.width = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)

    def settle(self, low: np.ndarray, width: np.ndarray) -> None:
        """Go on from these ends and widths of the first lanes, and let settled bits leave."""
        lanes = len(low)
        same = (low ^ (low + width)) < _TOP
        due = same | (width < _BOTTOM)
        # the first bits still open but the width used up: the width is cut so that they are settled
        cut = np.flatnonzero(due > same)
        width[cut] = (~low[cut] + np.uint64(1)) & _LOWEST
        # most lanes are due once for each id, few of them more often
        self.move_due(due, low)
        shift = due * _16
        low, width = low << shift, width << shift
        same = (low ^ (low + width)) < _TOP
        live = np.flatnonzero(due & (same | (width < _BOTTOM)))
        while len(live):
            own, own_width = low[live], np.where(same[live], width[live], (~low[live] + np.uint64(1)) & _LOWEST)
            self.move(live, own)
            own, own_width = own << _16, own_width << _16
            low[live], width[live] = own, own_width
            again = (own ^ (own + own_width)) < _TOP
            same[live] = again
            live = live[again | (own_width < _BOTTOM)]
        self.low[:lanes], self.width[:lanes] = low, width


class _Writer(_Coder):
    def __init__(self, lanes: int):
        super().__init__(lanes)
        #: 16 bits of all lanes at a time, and which lanes they are of.
        self.bits: list[np.ndarray] = []
        self.owned: list[np.ndarray] = []

    def move_due(self, due: np.ndarray, low: np.ndarray) -> None:
        more = len(self.low) - len(due)
        bits = (low >> _48).astype(np.uint16)
        self.bits.append(np.pad(bits, (0, more)) if more else bits)
        self.owned.append(np.pad(due, (0, more)) if more else due)

    def move(self, live: np.ndarray, low: np.ndarray) -> None:
        bits, due = np.zeros(len(self.low), np.uint16), np.zeros(len(self.low), bool)
        bits[live], due[live] = low >> _48, True
        self.bits.append(bits)
        self.owned.append(due)

    def bytes(self) -> list[bytes]:
        for k in range(4):
            self.move_due(np.ones(len(self.low), bool), self.low << np.uint64(16 * k))
        owned = np.stack(self.owned, axis=1)
        ends = 2 * np.cumsum(owned.sum(axis=1))
        data = np.stack(self.bits, axis=1)[owned].astype(">u2").tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class _Reader(_Coder):
    def __init__(self, blocks: list[bytes]):
        super().__init__(len(blocks))
        sizes = np.array([len(b) // 2 for b in blocks], np.int64)
        self.data = np.concatenate([np.frombuffer(b"".join(blocks), ">u2"), np.zeros(8, ">u2")]).astype(np.uint64)
        self.at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.value = np.zeros(len(blocks), np.uint64)
        for _ in range(4):
            self.value = (self.value << _16) | self.data[self.at]
            self.at += 1

    def move_due(self, due: np.ndarray, low: np.ndarray) -> None:
        value, at = self.value[:len(due)], self.at[:len(due)]
        value[:] = np.where(due, (value << _16) | self.data.take(at, mode="clip"), value)
        at += due

    def move(self, live: np.ndarray, low: np.ndarray) -> None:
        # a damaged block may ask for more than there is; its checksum tells
        self.value[live] = (self.value[live] << _16) | self.data[np.minimum(self.at[live], len(self.data) - 1)]
        self.at[live] += 1

    def target(self, low: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The 65536th of the width, parts of it `part` wide from `low` on, that the value lies in."""
        return np.minimum((self.value[:len(low)] - low) // part, np.uint64(65535)).astype(np.int32)


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode_blocks(ids: np.ndarray, length: int = BLOCK_IDS) -> tuple[list[bytes], list[int]]:
    """The coded blocks of at most `length` ids each, all but the last one full, and their checksums. Ids are below 2^27."""
    ids = ids.astype(np.int32)
    wide = bool((ids > 0xFFFF).any())
    blocks, sums = [], [checksum(ids[at:at + length]) for at in range(0, len(ids), length)]
    for at in range(0, len(ids), SIDE_BY_SIDE * length):
        blocks += _encode(ids[at:at + SIDE_BY_SIDE * length], length, wide)
    return blocks, sums


def _encode(ids: np.ndarray, length: int, wide: bool) -> list[bytes]:
    count = -(-len(ids) // length)
    table = np.zeros(count * length, np.int32)
    table[:len(ids)] = ids
    table = np.ascontiguousarray(table.reshape(count, length).T)
    short = len(ids) - (count - 1) * length
    model, writer = _Model(count), _Writer(count)
    for t in range(length):
        lanes = count if t < short else count - 1
        if not lanes:
            break
        if lanes < len(model.last):
            model.shrink(lanes)
        now = table[t, :lanes]
        candidate, chance = model.predict()
        miss = candidate != now
        part = writer.width[:lanes] >> _16
        width = part * chance.astype(np.uint64)
        low = writer.low[:lanes] + width * miss
        width = np.where(miss, (part << _16) - width, width)
        # an id that was not foreseen: its halves, each one in 65536
        for bits in (16, 0) if wide else (0,):
            half = (((now >> bits) & 0xFFFF) * miss).astype(np.uint64)
            if wide and not bits:
                writer.settle(low, width)
                low, width = writer.low[:lanes].copy(), writer.width[:lanes].copy()
            width = width >> (miss * _16)
            low = low + half * width
        writer.settle(low, width)
        model.update(now)
    return writer.bytes()


def decode_blocks(blocks: list[bytes], checksums: list[int], total: int, wide: bool, length: int = BLOCK_IDS) -> np.ndarray:
    """The `total` ids of the blocks; a block that does not give its checksum is an error."""
    parts = [np.zeros(0, np.int32)]
    for at in range(0, len(blocks), SIDE_BY_SIDE):
        parts.append(_decode(blocks[at:at + SIDE_BY_SIDE], min(total - at * length, SIDE_BY_SIDE * length), wide, length))
    ids = np.concatenate(parts)
    for k, want in enumerate(checksums):
        if checksum(ids[k * length:(k + 1) * length]) != want:
            raise ValueError(f"block {k} of {len(blocks)} is damaged")
    return ids


def _decode(blocks: list[bytes], total: int, wide: bool, length: int) -> np.ndarray:
    count = len(blocks)
    table = np.zeros((length, count), np.int32)
    short = total - (count - 1) * length
    model, reader = _Model(count), _Reader(blocks)
    for t in range(length):
        lanes = count if t < short else count - 1
        if not lanes:
            break
        if lanes < len(model.last):
            model.shrink(lanes)
        candidate, chance = model.predict()
        low, part = reader.low[:lanes].copy(), reader.width[:lanes] >> _16
        miss = reader.target(low, part) >= chance
        width = part * chance.astype(np.uint64)
        low += width * miss
        width = np.where(miss, (part << _16) - width, width)
        now = np.where(miss, 0, candidate)
        for bits in (16, 0) if wide else (0,):
            if wide and not bits:
                reader.settle(low, width)
                low, width = reader.low[:lanes].copy(), reader.width[:lanes].copy()
            part = width >> (miss * _16)
            half = reader.target(low, part) * miss
            now |= half << bits
            low += half.astype(np.uint64) * part
            width = part
        reader.settle(low, width)
        table[t, :lanes] = now
        model.update(now)
    return table.T.reshape(-1)[:total]
