"""Lossless WebP (VP8L) in numpy: a decoder of the whole format and an encoder of
8-bit samples.

Pixels are uint32 ARGB.  The decoder reads prefix codes (simple and coded, with
meta groups), back-references and the colour cache, and inverts the predictor,
cross-colour, subtract-green and palette transforms.  Streams in which only
green differs, such as the encoder writes, are decoded without a loop over
pixels: the place after the symbols that start at a bit is found for every bit at
once.  The encoder writes prefix codes, back-references, palettes,
subtract-green and, where it pays, one predictor for the whole image.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np

#: Fixed values of the format.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
LEFT, TOP = 1, 2
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
CACHE_FACTOR = 0x1E35A7BD
MOST_SIDE = 1 << 14
#: Bits of the longest code that the encoder writes for samples (the format has 15): short
#: codes keep the tables of a small image small.
LONGEST = 11
#: Samples of the shortest back-reference that the encoder writes, and of the longest one of the format.
SHORTEST, FURTHEST = 6, 4096
#: Bits that a back-reference takes, about, and the share of all bits that they must save to be written.
REFERENCE, PAYING = 26, 0.25
#: Near places of distance codes 1 .. 120: by distance, then columns away, the right side first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


class Bits:
    """A reader of numbers whose lowest bit comes first."""

    def __init__(self, data: bytes):
        self.data, self.at = data + b"\0" * 8, 0
        self.end = 8 * len(data)

    def peek(self, n: int) -> int:
        k = self.at >> 3
        return (int.from_bytes(self.data[k : k + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return value


class BitWriter:
    """Numbers with the lowest bit first, for headers."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


@lru_cache(maxsize=1)
def _reversed15() -> np.ndarray:
    """Each 15-bit number with its bits the other way round."""
    v, out = np.arange(1 << 15, dtype=np.uint32), np.zeros(1 << 15, np.uint32)
    for _ in range(15):
        out, v = (out << np.uint32(1)) | (v & np.uint32(1)), v >> np.uint32(1)
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols by length and then number, and their codes with the first bit lowest."""
    symbols = np.nonzero(lengths)[0]
    symbols = symbols[np.argsort(lengths[symbols], kind="stable")]
    size = lengths[symbols].astype(np.int64)
    step = np.int64(1) << (15 - size)
    start = np.cumsum(step) - step
    if len(symbols) > 1 and int(step.sum()) != 1 << 15:
        raise ValueError("a prefix code is not complete")
    return symbols, _reversed15()[start]


class PrefixCode:
    """A table over the next ``bits`` bits: symbol and length."""

    def __init__(self, lengths: np.ndarray, only: int | None = None):
        used = np.nonzero(lengths)[0] if only is None else [only]
        if len(used) <= 1:
            self.bits, self.only = 0, int(used[0]) if len(used) else 0
            self.symbol, self.length = np.array([self.only], np.uint16), np.zeros(1, np.intp)
            return
        self.only = None
        symbols, codes = canonical(lengths)
        size = lengths[symbols]
        self.bits = int(size.max())
        # in code order (first bit highest) each symbol fills a row of places
        fill = np.repeat(np.arange(len(symbols)), np.int64(1) << (self.bits - size.astype(np.int64)))
        place = _reversed15()[np.arange(1 << self.bits, dtype=np.int64) << (15 - self.bits)]
        self.symbol, self.length = np.empty(1 << self.bits, np.uint16), np.empty(1 << self.bits, np.intp)
        self.symbol[place], self.length[place] = symbols[fill], size[fill]

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        k = bits.peek(self.bits)
        bits.at += int(self.length[k])
        return int(self.symbol[k])


def read_code(bits: Bits, alphabet: int) -> PrefixCode:
    lengths = np.zeros(alphabet, np.uint8)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        if not two:
            return PrefixCode(lengths, first)
        lengths[[first, bits.read(8)]] = 1
        return PrefixCode(lengths)
    inner = np.zeros(19, np.uint8)
    for k in CODE_ORDER[: 4 + bits.read(4)]:
        inner[k] = bits.read(3)
    code = PrefixCode(inner)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    symbols, sizes, mask = code.symbol.tolist(), code.length.tolist(), (1 << code.bits) - 1
    # a length takes 14 bits at most
    value, used = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 2 * alphabet + 16], "little") >> (bits.at & 7), 0
    found: list[int] = []
    before = 8
    while len(found) < alphabet and left:
        left -= 1
        k = (value >> used) & mask
        s = symbols[k]
        used += sizes[k]
        if s < 16:
            found.append(s)
            before = s or before
        else:
            more, least = ((2, 3), (3, 3), (7, 11))[s - 16]
            found += [before if s == 16 else 0] * (least + ((value >> used) & ((1 << more) - 1)))
            used += more
    bits.at += used
    if len(found) > alphabet or bits.at > bits.end:
        raise ValueError("code lengths pass the alphabet")
    lengths[: len(found)] = found
    return PrefixCode(lengths)


def _number(bits: Bits, code: int) -> int:
    """The value of a length or distance code with its further bits."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _words(data: bytes, first: int, n: int) -> np.ndarray:
    """The 24 bits from each of ``n`` bytes on."""
    b = np.frombuffer(data, np.uint8, min(len(data) - first, n + 2), first).astype(np.int32)
    b = np.concatenate((b, np.zeros(n + 2 - len(b), np.int32)))
    return b[:-2] | b[1:-1] << 8 | b[2:] << 16


def _wide(data: bytes, at: np.ndarray) -> np.ndarray:
    """The 56 bits and more from each bit of ``at`` on."""
    whole = np.frombuffer(data + b"\0" * 32, np.uint8)
    k = at >> 3
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out |= whole[k + i].astype(np.uint64) << np.uint64(8 * i)
    return out >> (at & 7).astype(np.uint64)


def _extra(symbols: np.ndarray) -> np.ndarray:
    """Further bits of length and distance symbols."""
    return np.maximum(0, (symbols - 2) >> 1)


def _value(symbols: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Lengths and distance codes by symbols and the bits behind them."""
    extra = _extra(symbols)
    more = (bits & ((np.uint64(1) << extra.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
    return np.where(symbols < 4, symbols + 1, ((2 + (symbols & 1)) << extra) + more + 1)


def _green_stream(bits: Bits, green: PrefixCode, far: PrefixCode, width: int, n: int) -> np.ndarray:
    """``n`` green samples of literals and back-references.

    For every bit the step over the symbols that start there is found at once;
    eight steps are joined to one, and only every eighth start is walked to."""
    copies = bool(int(green.symbol.max()) >= LITERALS)
    if green.only is not None and not copies:
        return np.full(n, green.only, np.uint8)
    first, whole = bits.at >> 3, bits.end >> 3
    word = _words(bits.data, first, whole - first + 8)
    windows = np.empty((len(word), 8), np.int32)
    for k in range(8):
        np.right_shift(word, k, out=windows[:, k])
    windows = windows.ravel()
    last = len(windows) - 1
    here = windows & ((1 << green.bits) - 1)
    one = np.arange(len(windows), dtype=np.int32)
    step, ahead = green.length.astype(np.int32), np.ones(len(green.symbol), np.int32)
    if copies:
        symbol = green.symbol.astype(np.int32)
        step = step + np.where(symbol >= LITERALS, _extra(symbol - LITERALS), 0)
        ahead[symbol >= LITERALS] = 0
    one += step.take(here)
    if copies:
        spots = np.flatnonzero(ahead.take(here) == 0)
        behind = np.minimum(one[spots], last)
        there = windows.take(behind) & ((1 << far.bits) - 1)
        one[spots] += (far.length.astype(np.int32) + _extra(far.symbol.astype(np.int32))).take(there)
    np.minimum(one, last, out=one)
    two = one.take(one)
    four = two.take(two)
    eight = memoryview(four.take(four))
    if copies:  # a start of symbols makes at least one sample; most have made enough long before n starts
        made = np.ones(len(windows), np.int32)
        code = symbol.take(here[spots]) - LITERALS
        made[spots] = _value(code, _wide(bits.data, 8 * first + spots + green.length.take(here[spots])))
        far_made = made + made.take(one)
        far_made += far_made.take(two)
        far_made += far_made.take(four)
        gain = memoryview(far_made)
    at, starts, done = bits.at & 7, [], 0
    if copies:
        while done < n:
            starts.append(at)
            done += gain[at]
            at = eight[at]
            if at >= last:
                break
    else:
        for _ in range(-(-n // 8)):
            starts.append(at)
            at = eight[at]
    flat = np.empty((len(starts), 8), np.int32)
    flat[:, 0] = starts
    flat[:, 4] = four.take(flat[:, 0])
    flat[:, 2::4] = two.take(flat[:, ::4])
    flat[:, 1::2] = one.take(flat[:, ::2])
    flat = flat.ravel()
    if not copies:
        flat = flat[:n]
        bits.at = 8 * first + int(flat[-1]) + int(green.length[here[flat[-1]]])
        if bits.at > bits.end:
            raise ValueError("the stream ends early")
        return green.symbol.take(here.take(flat)).astype(np.uint8)
    ends = np.cumsum(made.take(flat), dtype=np.int64)
    flat = flat[: int(np.searchsorted(ends, n)) + 1]
    if len(flat) > len(ends) or ends[len(flat) - 1] != n:
        raise ValueError("a back-reference leaves the image")
    bits.at = 8 * first + int(one[flat[-1]])
    if bits.at > bits.end:
        raise ValueError("the stream ends early")
    symbols = symbol.take(here.take(flat))
    to = ends[: len(flat)] - made.take(flat)
    out = np.zeros(n, np.uint8)
    literal = symbols < LITERALS
    out[to[literal]] = symbols[literal]
    copy = np.flatnonzero(~literal)
    at = flat[copy] + green.length.take(here.take(flat[copy])) + _extra(symbols[copy] - LITERALS)
    far_at = windows.take(at) & ((1 << far.bits) - 1)
    code = _value(far.symbol.astype(np.int64).take(far_at), _wide(bits.data, 8 * first + at + far.length.take(far_at)))
    near = np.array([max(1, x + y * width) for x, y in NEAR])
    distance = np.where(code > len(NEAR), code - len(NEAR), near[np.minimum(code, len(NEAR)) - 1])
    if (distance > to[copy]).any():
        raise ValueError("a back-reference leaves the image")
    whole = bytearray(out)
    for o, size, d in zip(to[copy].tolist(), made.take(flat[copy]).tolist(), distance.tolist()):
        if d >= size:
            whole[o : o + size] = whole[o - d : o - d + size]
        else:
            whole[o : o + size] = (whole[o - d : o] * (size // d + 1))[:size]
    return np.frombuffer(whole, np.uint8)


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """A spatially coded image of width * height pixels."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    cache_size = 1 << cache_bits if cache_bits else 0
    groups_of, block = None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        map_ = _image(bits, across, (height + (1 << block) - 1) >> block, False)
        groups_of = ((map_ >> np.uint32(8)) & np.uint32(0xFFFF)).astype(np.int64)
    count = int(groups_of.max()) + 1 if groups_of is not None else 1
    sizes = (LITERALS + LENGTHS + cache_size, LITERALS, LITERALS, LITERALS, DISTANCES)
    groups = [[read_code(bits, s) for s in sizes] for _ in range(count)]
    n = width * height
    green, red, blue, alpha, far = groups[0]
    if count == 1 and not cache_size and None not in (red.only, blue.only, alpha.only):
        return np.uint32(alpha.only << 24 | red.only << 16 | blue.only) | _green_stream(bits, green, far, width, n).astype(np.uint32) << np.uint32(8)
    out, cache, seen = [0] * n, [0] * cache_size, 0
    shift = 32 - cache_bits

    def note(upto: int) -> None:
        nonlocal seen
        if cache_size:
            for p in out[seen:upto]:
                cache[((CACHE_FACTOR * p) & 0xFFFFFFFF) >> shift] = p
        seen = upto

    at = 0
    while at < n:
        if groups_of is not None:
            green, red, blue, alpha, far = groups[groups_of[(at // width >> block) * across + (at % width >> block)]]
        s = green.read(bits)
        if s < LITERALS:
            r = red.read(bits)
            b = blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < LITERALS + LENGTHS:
            length = _number(bits, s - LITERALS)
            code = _number(bits, far.read(bits))
            if code > len(NEAR):
                distance = code - len(NEAR)
            else:
                x, y = NEAR[code - 1]
                distance = max(1, x + y * width)
            if distance > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            for k in range(at, at + length):
                out[k] = out[k - distance]
            at += length
        else:
            note(at)
            out[at] = cache[s - LITERALS - LENGTHS]
            at += 1
        if bits.at > bits.end:
            raise ValueError("the stream ends early")
    return np.array(out, np.uint32)


def _channels(p: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(p, "<u4").view(np.uint8).reshape(*p.shape, 4)


def _half(a, b):
    return (a.astype(np.int32) + b) >> 1


def _predict(mode: int, left, top, corner, right) -> np.ndarray:
    """The prediction of one pixel's four channels from its neighbours."""
    if mode in (0, 14, 15):
        return np.array([0, 0, 0, 255], np.int32)
    simple = {1: left, 2: top, 3: right, 4: corner}
    if mode in simple:
        return simple[mode].astype(np.int32)
    if mode == 5:
        return _half(_half(left, right), top)
    if mode in (6, 7, 8, 9):
        return _half(*{6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right)}[mode])
    if mode == 10:
        return _half(_half(left, corner), _half(top, right))
    l, t, c = (x.astype(np.int32) for x in (left, top, corner))
    if mode == 11:
        return l if abs(t - c).sum() < abs(l - c).sum() else t
    if mode == 12:
        return np.clip(l + t - c, 0, 255)
    mean = (l + t) >> 1
    diff = mean - c
    return np.clip(mean + np.where(diff < 0, -((-diff) >> 1), diff >> 1), 0, 255)


def unpredict(p: np.ndarray, width: int, modes: np.ndarray, bits: int) -> np.ndarray:
    """Inverse of the predictor transform; modes are the green of the block image."""
    px = _channels(p.reshape(-1, width)).copy()
    height = px.shape[0]
    mode = ((modes >> np.uint32(8)) & np.uint32(15)).reshape(-1, (width + (1 << bits) - 1) >> bits)
    px[0, 0] += np.array([0, 0, 0, 255], np.uint8)
    if (mode == mode.flat[0]).all() and int(mode.flat[0]) in (LEFT, TOP):
        px[0] = np.cumsum(px[0], axis=0, dtype=np.uint8)
        if int(mode.flat[0]) == LEFT:
            px[:, 0] = np.cumsum(px[:, 0], axis=0, dtype=np.uint8)
            px[1:] = np.cumsum(px[1:], axis=1, dtype=np.uint8)
        else:
            px = np.cumsum(px, axis=0, dtype=np.uint8)
        return np.ascontiguousarray(px).view("<u4").reshape(-1)
    px[0] = np.cumsum(px[0].astype(np.uint32), axis=0).astype(np.uint8)
    for y in range(1, height):
        row, above = px[y], px[y - 1]
        row[0] += above[0]
        kinds = mode[y >> bits]
        for x in range(1, width):
            right = above[x + 1] if x + 1 < width else row[0]
            row[x] += _predict(int(kinds[x >> bits]), row[x - 1], above[x], above[x - 1], right).astype(np.uint8)
    return px.view("<u4").reshape(-1)


def uncross(p: np.ndarray, width: int, factors: np.ndarray, bits: int) -> np.ndarray:
    """Inverse of the cross-colour transform."""
    px = _channels(p.reshape(-1, width)).copy()
    height = px.shape[0]
    f = _channels(factors.reshape(-1, (width + (1 << bits) - 1) >> bits)).view(np.int8).astype(np.int32)
    f = np.repeat(np.repeat(f, 1 << bits, 0)[:height], 1 << bits, 1)[:, :width]
    green = px[..., 1].view(np.int8).astype(np.int32)
    red = (px[..., 2] + ((f[..., 0] * green) >> 5)).astype(np.uint8)
    blue = px[..., 0] + ((f[..., 1] * green) >> 5) + ((f[..., 2] * red.view(np.int8).astype(np.int32)) >> 5)
    px[..., 2], px[..., 0] = red, blue.astype(np.uint8)
    return px.view("<u4").reshape(-1)


def add_green(p: np.ndarray) -> np.ndarray:
    """Inverse of the subtract-green transform."""
    px = _channels(p).copy()
    px[:, 0] += px[:, 1]
    px[:, 2] += px[:, 1]
    return px.view("<u4").reshape(-1)


def unindex(p: np.ndarray, width: int, table: np.ndarray, bits: int) -> np.ndarray:
    """Inverse of the palette transform; small palettes have several pixels in one."""
    green = ((p >> np.uint32(8)) & np.uint32(255)).reshape(-1, (width + (1 << bits) - 1) >> bits)
    if bits:
        each = 8 >> bits
        parts = (green[..., None] >> (np.arange(1 << bits, dtype=np.uint32) * np.uint32(each))) & np.uint32((1 << each) - 1)
        green = parts.reshape(len(green), -1)[:, :width]
    whole = np.zeros(256, np.uint32)
    whole[: len(table)] = table
    return whole[green.reshape(-1)]


def decode_vp8l(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and pixels of a VP8L stream."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    transforms, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOR):
            block = bits.read(3) + 2
            extra = _image(bits, (across + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
            transforms.append((unpredict if kind == PREDICTOR else uncross, across, extra, block))
        elif kind == PALETTE:
            size = bits.read(8) + 1
            deltas = _channels(_image(bits, size, 1, False)).astype(np.uint32)
            table = np.cumsum(deltas, axis=0).astype(np.uint8).view("<u4").reshape(-1)
            block = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            transforms.append((unindex, across, table, block))
            across = (across + (1 << block) - 1) >> block
        else:
            transforms.append((add_green, None, None, None))
    p = _image(bits, across, height, True)
    for f, w, extra, block in reversed(transforms):
        p = f(p) if w is None else f(p, w, extra, block)
    return width, height, p


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and pixels of a lossless WebP file."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at, end = 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return decode_vp8l(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code for ``counts``, none over ``most``.  Where the
    best code is longer, small counts are raised until it fits."""
    used = np.nonzero(counts)[0].tolist()
    out = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        out[used[0]] = 1
        return out
    weights, least = counts[used].tolist(), 1
    while True:
        heap = [(max(w, least), i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = [0] * (2 * len(used) - 1)
        top = len(used)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = top
            heapq.heapreplace(heap, (a + b, top))
            top += 1
        depth = [0] * top
        for i in range(top - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(used)]) <= most:
            out[used] = depth[: len(used)]
            return out
        least = 2 * least + sum(weights) // (1 << most)


def put_code(out: BitWriter, lengths: np.ndarray) -> None:
    """Write a prefix code: simple for one symbol below 256, else by its lengths."""
    used = np.nonzero(lengths)[0]
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        out.put(1, 1)
        out.put(0, 1)
        out.put(1, 1)
        out.put(int(used[0]) if len(used) else 0, 8)
        return
    tokens: list[tuple[int, int, int]] = []
    at, values = 0, lengths.tolist()
    end = int(used[-1]) + 1
    while at < end:
        if values[at]:
            tokens.append((values[at], 0, 0))
            at += 1
            continue
        n = 1
        while n < 138 and at + n < end and not values[at + n]:
            n += 1
        tokens += [(0, 0, 0)] * n if n < 3 else [(17, n - 3, 3)] if n < 11 else [(18, n - 11, 7)]
        at += n
    inner = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    out.put(0, 1)
    upto = max(4, max(i for i, k in enumerate(CODE_ORDER) if inner[k]) + 1)
    out.put(upto - 4, 4)
    for k in CODE_ORDER[:upto]:
        out.put(int(inner[k]), 3)
    if len(tokens) >= 2 and end < len(values):
        out.put(1, 1)
        out.put(4, 3)
        out.put(len(tokens) - 2, 10)
    else:
        tokens += [(0, 0, 0)] * (len(values) - end)
        out.put(0, 1)
    symbols, codes = canonical(inner)
    words = {s: (c, 0 if len(symbols) == 1 else k) for s, c, k in zip(symbols.tolist(), codes.tolist(), inner[symbols].tolist())}
    value, at = 0, 0
    for s, extra, n in tokens:
        c, k = words[s]
        value |= (c | extra << k) << at
        at += k + n
    out.put(value, at)


def _codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and bits of each symbol; the only symbol of a code takes no bits."""
    code, size = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.int64)
    if np.count_nonzero(lengths) > 1:
        symbols, found = canonical(lengths)
        code[symbols], size[symbols] = found, lengths[symbols]
    return code, size


def put_numbers(out: BitWriter, values: np.ndarray, sizes: np.ndarray) -> bytes:
    """The header in ``out`` and then ``values`` of ``sizes`` bits (48 at most), as bytes."""
    head, n = out.value, out.n
    lead = head.to_bytes(-(-n // 8), "little")
    ends = np.cumsum(sizes)
    total = int(ends[-1]) + (n & 7) if len(ends) else 0
    if not total:
        return lead
    start = ends - sizes + (n & 7)
    place, moved = start >> 4, values << (start & 15).astype(np.uint64)
    words = (total >> 4) + 1
    body = np.zeros(words + 4)
    for k in range(4 if int(sizes.max()) > 33 else 3 if int(sizes.max()) > 17 else 2):
        body[k : k + words] += np.bincount(place, ((moved >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.float64), words)
    body = bytearray(body.astype("<u2").tobytes()[: -(-total // 8)])
    if n & 7:
        body[0] |= lead[-1]
        lead = lead[:-1]
    return lead + bytes(body)


def repeats(samples: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each sample how many from there on stand alike before it, within the
    same ``owner``, and how far back: found by the last place of equal
    SHORTEST samples, and longer as far as the next samples have it equally
    far.  Owners stand one behind the other."""
    n = len(samples) - SHORTEST + 1
    size, back = np.zeros(len(samples), np.int32), np.zeros(len(samples), np.int32)
    if n < 2:
        return size, back
    two = samples[:-1] | samples[1:].astype(np.uint64) << np.uint64(8)
    key = two[:n] | two[2 : n + 2] << np.uint64(16) | two[4 : n + 4] << np.uint64(32)  # SHORTEST samples
    order = np.argsort(key.astype(np.uint16), kind="stable")  # by 16 bits at a time, which numpy sorts by counts
    for k in (16, 32):
        order = order.take(np.argsort((key >> np.uint64(k)).astype(np.uint16).take(order), kind="stable"))
    sorted_key = key.take(order)
    alike = np.flatnonzero(sorted_key[1:] == sorted_key[:-1])
    here, before = order.take(alike + 1), order.take(alike)
    own = owner.take(here + SHORTEST - 1) == owner.take(before)
    here, before = here[own], before[own]
    back[here] = here - before
    # runs of places equally far back
    edge = np.flatnonzero(np.concatenate((back[1:] != back[:-1], [True])))
    far = np.flatnonzero(back[edge])
    runs = np.diff(edge, prepend=-1)
    long = runs.take(far)
    inside = np.repeat(edge.take(far), long) - np.arange(long.sum()) + np.repeat(np.cumsum(long) - long, long)
    size[np.sort(inside)] = np.arange(long.sum(), 0, -1) - np.repeat(long.sum() - np.cumsum(long), long) + SHORTEST - 1
    return size, back


def _symbols_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, further bits and their number of lengths and distance codes."""
    n = values - 1
    high = np.zeros(len(n), np.int64)
    for k in (16, 8, 4, 2, 1):
        up = (n >> (high + k)) > 0
        high[up] += k
    extra = np.maximum(high - 1, 0)
    symbols = np.where(n < 4, n, 2 * high + ((n >> extra) & 1))
    extra[n < 4] = 0
    return symbols, n & ((1 << extra) - 1), extra


@lru_cache(maxsize=4)
def _near(width: int) -> np.ndarray:
    """The code of each small distance: that of its nearest place, or the distance and 120."""
    table = np.arange(8 * width + 16) + len(NEAR)
    for k in range(len(NEAR), 0, -1):
        x, y = NEAR[k - 1]
        table[max(1, x + y * width)] = k
    return table


def _bits_each(*counts: np.ndarray) -> list[float]:
    """Entropies of counts, in bits a sample."""
    c = np.array(counts, np.float64)
    n = c.sum(axis=1)
    return (np.log2(n) - (c * np.log2(np.maximum(c, 1))).sum(axis=1) / n).tolist()


def _parse(size: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the back-references taken from left to right, and the lengths and distances."""
    some = np.flatnonzero(size)
    at, starts, sizes = 0, [], []
    if len(some):
        follow = memoryview(np.append(some, len(size)).take(np.searchsorted(some, np.arange(len(size) + 1))))
        lengths = memoryview(size)
        while (at := follow[at]) < len(size):
            n = min(lengths[at], FURTHEST)
            starts.append(at)
            sizes.append(n)
            at = at + n
    starts = np.array(starts, np.int64)
    return starts, np.array(sizes, np.int64), back[starts].astype(np.int64)


def _put_literals(out: BitWriter, samples: np.ndarray, counts: np.ndarray, alpha: int) -> bytes:
    """The image data: green samples as literals only."""
    lengths = code_lengths(np.concatenate((counts, np.zeros(LENGTHS, counts.dtype))), LONGEST)
    put_code(out, lengths)
    for value in (0, 0, alpha, 0):
        out.put(5 | value << 3, 11)
    code, bits = _codes(lengths)
    return put_numbers(out, code.take(samples), bits.take(samples))


def _pays(size: np.ndarray, back: np.ndarray, each: float) -> bool:
    """Whether back-references save a share of PAYING of the bits: a sample that
    begins or continues one saves its own bits, and each run costs some."""
    inside = np.flatnonzero(size)
    if not len(inside):
        return False
    runs = 1 + np.count_nonzero(np.diff(inside) > 1) + np.count_nonzero(np.diff(back[inside]))
    return (len(inside) + runs * (SHORTEST - 1)) * each - runs * REFERENCE > PAYING * each * len(size)


def _put_samples(out: BitWriter, samples: np.ndarray, width: int, alpha: int, found: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The image data: green samples as literals and back-references."""
    starts, sizes, distances = _parse(*found)
    far = _near(width)
    far = np.where(distances < len(far), far[np.minimum(distances, len(far) - 1)], distances + len(NEAR))
    depth = np.zeros(len(samples) + 1, np.int32)
    depth[starts] += 1
    depth[starts + sizes] -= 1
    literal = np.flatnonzero(np.cumsum(depth)[:-1] == 0)
    a, a_more, a_bits = _symbols_of(sizes)
    b, b_more, b_bits = _symbols_of(far)
    counts = np.bincount(samples[literal], minlength=LITERALS + LENGTHS) + np.bincount(a + LITERALS, minlength=LITERALS + LENGTHS)
    lengths = code_lengths(counts, LONGEST)
    far_lengths = code_lengths(np.bincount(b, minlength=DISTANCES), LONGEST)
    put_code(out, lengths)
    for value in (0, 0, alpha):
        out.put(5 | value << 3, 11)
    put_code(out, far_lengths)
    code, bits = _codes(lengths)
    far_code, far_bits = _codes(far_lengths)
    places = np.concatenate((literal, starts))
    head = np.concatenate((samples[literal].astype(np.int64), a + LITERALS))
    rank = np.argsort(places, kind="stable")
    values = np.zeros((2, len(places)), np.uint64)
    widths = np.zeros((2, len(places)), np.int64)
    values[0], widths[0] = code[head], bits[head]
    m = slice(len(literal), None)
    values[0, m] |= a_more.astype(np.uint64) << widths[0, m].astype(np.uint64)
    widths[0, m] += a_bits
    values[1, m] = far_code[b] | b_more.astype(np.uint64) << far_bits[b].astype(np.uint64)
    widths[1, m] = far_bits[b] + b_bits
    values, widths = values[:, rank].T.ravel(), widths[:, rank].T.ravel()
    used = widths > 0
    return put_numbers(out, values[used], widths[used])


def riff(stream: bytes) -> bytes:
    """A WebP file around a VP8L stream."""
    padded = stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + padded


def encode_samples(samples: np.ndarray, width: int, found: tuple[np.ndarray, np.ndarray] | None = None) -> bytes:
    """A lossless WebP file of 8-bit grey samples in rows of ``width``.

    Up to 16 different samples become a palette with several pixels in one;
    others go through subtract-green, after which only green differs, and
    through a predictor first if the differences to the left or upper sample
    take fewer bits.  ``found`` are the ``repeats`` of the samples where they
    are known."""
    height = len(samples) // width
    if width * height != len(samples) or not 0 < height <= MOST_SIDE or width > MOST_SIDE:
        raise ValueError("not an image of that width")
    out = BitWriter()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 4)
    counts = np.bincount(samples, minlength=256)
    used = np.nonzero(counts)[0]
    green, alpha, across = samples, 255, width
    if len(used) <= 16:
        bits = 3 if len(used) <= 2 else 2 if len(used) <= 4 else 1
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(used) - 1, 8)
        _put_palette(out, used)
        index = np.zeros(256, np.uint8)
        index[used] = np.arange(len(used))
        rows = index[samples].reshape(height, width)
        rows = np.pad(rows, ((0, 0), (0, -width % (1 << bits)))).reshape(height, -1, 1 << bits)
        green = np.bitwise_or.reduce(rows << (np.arange(1 << bits, dtype=np.uint8) * np.uint8(8 >> bits)), axis=2).ravel()
        counts, alpha, found, across = np.bincount(green, minlength=256), 0, None, -(-width // (1 << bits))
    else:
        rest = {mode: _residual(samples, width, mode) for mode in (LEFT, TOP)}
        plain, *cost = _bits_each(counts, *(np.bincount(r, minlength=256) for r in rest.values()))
        mode = LEFT if cost[0] <= cost[1] else TOP
        if min(cost) < 0.9 * plain:
            out.put(1, 1)
            out.put(PREDICTOR, 2)
            out.put(7, 3)
            out.put(0, 1)
            for value in (mode, 0, 0, 255, 0):
                out.put(5 | value << 3, 11)
            green, alpha, found = rest[mode], 0, None
            counts = np.bincount(green, minlength=256)
        out.put(1, 1)
        out.put(SUBTRACT_GREEN, 2)
    out.put(0, 1)
    out.put(0, 1)
    out.put(0, 1)
    (each,) = _bits_each(counts)
    if found is None:
        found = repeats(green, np.zeros(len(green), np.int8))
    if _pays(*found, each):
        return riff(_put_samples(out, green, across, alpha, found))
    return riff(_put_literals(out, green, counts, alpha))


def _residual(samples: np.ndarray, width: int, mode: int) -> np.ndarray:
    """Samples less their left or upper neighbours; the first row has left ones and the first column upper ones."""
    rows = samples.reshape(-1, width)
    out = rows.copy()
    if mode == LEFT:
        out[:, 1:] -= rows[:, :-1]
        out[1:, 0] -= rows[:-1, 0]
    else:
        out[1:] -= rows[:-1]
        out[0, 1:] -= rows[0, :-1]
    return out.ravel()


def _put_palette(out: BitWriter, used: np.ndarray) -> None:
    """The colours as a row of differences: grey, so one value for three channels."""
    deltas = np.diff(used, prepend=0)
    out.put(0, 1)
    counts = np.bincount(deltas, minlength=LITERALS + LENGTHS)
    lengths = code_lengths(counts, 15)
    alpha = np.zeros(256, np.uint8)
    alpha[[255, 0] if len(used) > 1 else [255]] = 1
    grey = lengths[:256]
    for code in (lengths, grey, grey, alpha, np.eye(1, DISTANCES, dtype=np.uint8)[0]):
        put_code(out, code)
    symbols, codes = canonical(lengths)
    words = {int(s): (int(c), int(lengths[s]) if len(symbols) > 1 else 0) for s, c in zip(symbols, codes)}
    for i, d in enumerate(deltas.tolist()):
        for _ in range(3):
            out.put(*words[d])
        if len(used) > 1:
            out.put(0 if i else 1, 1)
