"""Lossless WebP (the published VP8L bitstream), one file at a time: decoder and encoder.

The decoder reads every feature of the format: simple and normal prefix codes,
meta prefix groups, back-references, colour cache, and the predictor,
cross-colour, subtract-green and palette transforms; entropy-coded pixels are read
one by one through tables. The encoder finds back-references and cache hits by
sorting and packs bits as arrays. webp_lanes.py does many files at a time.
Pixels are (height, width, 4) arrays in the order red, green, blue, alpha.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Fixed values of the format: offsets (x, y) of distance codes 1 to 120.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
_BYTE = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], np.int64)
REVERSED = (_BYTE[:, None] + (_BYTE << 8)).ravel()  # of 16 bits
_WINDOW = 1 << 14  # bytes of a stream whose bits are laid out at a time
_HASH = 0x1E35A7BD


class _Bits:
    """Bits of a stream, low bit of each byte first."""

    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, 8 * at

    def read(self, n: int) -> int:
        if not n:
            return 0
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.raw):
            raise ValueError("the stream ends early")
        out = int.from_bytes(self.raw[first:last], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return out

    def peek(self) -> int:
        first = self.at >> 3
        if first > len(self.raw):
            raise ValueError("the stream ends early")
        return int.from_bytes(self.raw[first : first + 3], "little") >> (self.at & 7)

    def windows(self) -> tuple[memoryview, int, int]:
        """(the 25 or more bits from each bit on, first bit, last bit at which to begin) near ``at``; zeros follow the end."""
        first = self.at >> 3
        raw = np.frombuffer(self.raw, np.uint8, min(_WINDOW + 24, max(0, len(self.raw) - first)), min(first, len(self.raw)))
        part = np.zeros(len(raw) + 24, np.uint32)
        part[: len(raw)] = raw
        word = part[:-3] | part[1:-2] << 8 | part[2:-1] << 16 | part[3:] << 24
        return memoryview((word[:, None] >> np.arange(8, dtype=np.uint32)).ravel()), 8 * first, 8 * min(_WINDOW, len(raw))


class _Writer:
    def __init__(self):
        self.values, self.sizes, self.parts = [], [], []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Fields of at most 63 bits each."""
        self.parts.append((np.array(self.values, np.uint64), np.array(self.sizes, np.int64)))
        self.values, self.sizes = [], []
        self.parts.append((values, sizes))

    def raw(self) -> bytes:
        self.put_all(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        value, size = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        end = np.cumsum(size)
        at = end - size
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        total = int(end[-1]) if len(end) else 0
        out = np.zeros(total // 64 + 2, np.uint64)
        if total:
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] = np.bitwise_or.reduceat(value << shift, first)
            over = np.flatnonzero((at & 63) + size > 64)  # one field at most crosses into a word
            out[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
        return out.astype("<u8").tobytes()[: (total + 7) // 8]


class PrefixCode:
    """A canonical prefix code from its code lengths."""

    def __init__(self, lengths):
        self.lengths = np.asarray(lengths, np.int64)
        used = np.flatnonzero(self.lengths)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        self.single = int(used[0]) if len(used) == 1 else None
        self.order = used[np.argsort(self.lengths[used], kind="stable")]
        self.longest = 0 if self.single is not None else int(self.lengths[self.order[-1]])
        if self.single is None and int((1 << (self.longest - self.lengths[used])).sum()) != 1 << self.longest:
            raise ValueError("an incomplete prefix code")

    def lookup(self) -> tuple[list[int], int]:
        """(table, mask): symbol << 4 | length by the next bits."""
        if self.single is not None:
            return [self.single << 4], 0
        n = self.lengths[self.order]
        by_code = np.repeat(self.order << 4 | n, 1 << (self.longest - n))
        return by_code[REVERSED[: 1 << self.longest] >> (16 - self.longest)].tolist(), (1 << self.longest) - 1

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """(bits, their number) by symbol."""
        code, size = np.zeros(len(self.lengths), np.uint64), np.zeros(len(self.lengths), np.int64)
        if self.single is None:
            n = self.lengths[self.order]
            step = 1 << (16 - n)
            code[self.order] = REVERSED[np.cumsum(step) - step]
            size[self.order] = n
        return code, size

    def write(self, out: _Writer, symbol: int) -> None:
        code, size = self.codes()
        out.put(int(code[symbol]), int(size[symbol]))


def _read_lengths(bits: _Bits, size: int) -> list[int] | np.ndarray:
    lengths = [0] * size
    if bits.read(1):
        n, wide = bits.read(1) + 1, bits.read(1)
        symbols = [bits.read(8 if wide else 1)]
        if n == 2:
            symbols.append(bits.read(8))
        of_one = np.zeros(max(256, size), np.int64)
        of_one[symbols] = 1
        return of_one
    of_lengths = [0] * 19
    for k in range(4 + bits.read(4)):
        of_lengths[CODE_LENGTH_ORDER[k]] = bits.read(3)
    code = PrefixCode(of_lengths)
    table, mask = code.lookup()
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    if code.single is not None and code.single < 16:
        lengths[: min(left, size)] = [code.single] * min(left, size)
        return lengths
    at, before = 0, 8
    while at < size and left:
        left -= 1
        t = table[bits.peek() & mask]
        bits.at += t & 15
        s = t >> 4
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
        else:
            value, times = (before, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
            if at + times > size:
                raise ValueError("too many code lengths")
            lengths[at : at + times] = [value] * times
            at += times
    return lengths


def _value(prefix: int, bits: _Bits) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _image(bits: _Bits, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image as uint32 ARGB, row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups_at, block = None, 0
    if top and bits.read(1):
        block = bits.read(3) + 2
        groups_at = (_image(bits, -(-width // (1 << block)), -(-height // (1 << block)), False) >> 8) & 0xFFFF
        across = -(-width // (1 << block))
    n_groups = int(groups_at.max()) + 1 if groups_at is not None else 1
    sizes = (256 + 24 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    groups = [[x for n in sizes for x in PrefixCode(_read_lengths(bits, n)).lookup()] for _ in range(n_groups)]
    total = width * height
    out: list[int] = []
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    green, m_green, red, m_red, blue, m_blue, alpha, m_alpha, far, m_far = groups[0]
    view, base, edge = bits.windows()
    p = bits.at - base
    end = 8 * len(bits.raw)
    while (at := len(out)) < total:
        if p >= edge:
            bits.at = base + p
            if bits.at > end:
                raise ValueError("the stream ends early")
            view, base, edge = bits.windows()
            p = bits.at - base
            if not edge:  # codes of no bits may go on at the end
                edge = 1
        if groups_at is not None:
            green, m_green, red, m_red, blue, m_blue, alpha, m_alpha, far, m_far = groups[int(groups_at[(at // width >> block) * across + (at % width >> block)])]
        g = green[view[p] & m_green]
        p += g & 15
        s = g >> 4
        if s < 256:
            r = red[view[p] & m_red]
            p += r & 15
            b = blue[view[p] & m_blue]
            p += b & 15
            a = alpha[view[p] & m_alpha]
            p += a & 15
            color = (a >> 4) << 24 | (r >> 4) << 16 | s << 8 | b >> 4
            out.append(color)
            if cache_bits:
                cache[(_HASH * color & 0xFFFFFFFF) >> shift] = color
        elif s < 280:
            bits.at = base + p
            length = _value(s - 256, bits)
            d = far[bits.peek() & m_far]
            bits.at += d & 15
            d = _value(d >> 4, bits)
            p = bits.at - base
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            new = out[at - d : at - d + length] if d >= length else (out[at - d :] * (length // d + 1))[:length]
            out += new
            if cache_bits:
                for color in new:
                    cache[(_HASH * color & 0xFFFFFFFF) >> shift] = color
        else:
            out.append(cache[s - 280])  # it stays in its slot
    bits.at = base + p
    if bits.at > end:
        raise ValueError("the stream ends early")
    return np.array(out, np.uint32)


def _channels(argb: np.ndarray) -> np.ndarray:
    """(n, 4) int: alpha, red, green, blue."""
    return np.stack([argb >> s & 255 for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def _average(a, b):
    return tuple((x + y) >> 1 for x, y in zip(a, b))


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _predict(mode: int, left, up, up_left, up_right):
    if mode == 0:
        return (255, 0, 0, 0)
    if mode in (1, 2, 3, 4):
        return (left, up, up_right, up_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, up_right), up)
    if mode in (6, 7, 8, 9):
        return _average(*((left, up_left), (left, up), (up_left, up), (up, up_right))[mode - 6])
    if mode == 10:
        return _average(_average(left, up_left), _average(up, up_right))
    if mode == 11:
        guess = [a + b - c for a, b, c in zip(left, up, up_left)]
        to_left = sum(abs(g - a) for g, a in zip(guess, left))
        to_up = sum(abs(g - b) for g, b in zip(guess, up))
        return left if to_left < to_up else up
    if mode == 12:
        return tuple(_clamp(a + b - c) for a, b, c in zip(left, up, up_left))
    half = _average(left, up)
    return tuple(_clamp(a + int((a - c) / 2)) for a, c in zip(half, up_left))


def _predictor(pixels: np.ndarray, width: int, modes: np.ndarray, block: int, inverse: bool) -> np.ndarray:
    """Adds (or takes off) the prediction of every pixel; left or upper pixels everywhere go as arrays."""
    height, across = len(pixels) // width, -(-width // (1 << block))
    if len(modes) and modes[0] in (1, 2) and (modes == modes[0]).all():
        p = pixels.reshape(height, width, 4)
        rest, line = (p, p[:, 0]) if modes[0] == 1 else (p.transpose(1, 0, 2), p[0])
        if inverse:
            rest = rest.copy()
            rest[:, 0] = np.cumsum(line, axis=0) + (255, 0, 0, 0)
            # The first row has left pixels and the first column upper ones in either mode.
            out = np.cumsum(rest, axis=1) & 255
        else:
            out = np.diff(rest, axis=1, prepend=0)
            out[:, 0] = np.diff(line, axis=0, prepend=np.array([[255, 0, 0, 0]]))
            out &= 255
        return (out if modes[0] == 1 else out.transpose(1, 0, 2)).reshape(-1, 4)
    given = [tuple(p) for p in pixels.tolist()]
    out = list(given)
    seen = out if inverse else given
    for y in range(height):
        for x in range(width):
            k = y * width + x
            if not k:
                guess = (255, 0, 0, 0)
            elif not y:
                guess = seen[k - 1]
            elif not x:
                guess = seen[k - width]
            else:
                guess = _predict(int(modes[(y >> block) * across + (x >> block)]), seen[k - 1], seen[k - width], seen[k - width - 1], seen[k - width + 1])
            out[k] = tuple(((a + b) if inverse else (a - b)) & 255 for a, b in zip(given[k], guess))
    return np.array(out, np.int64).reshape(-1, 4)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x + 128 & 255) - 128


def _cross_color(pixels: np.ndarray, width: int, elements: np.ndarray, block: int, inverse: bool) -> np.ndarray:
    k = np.arange(len(pixels))
    e = elements[(k // width >> block) * -(-width // (1 << block)) + (k % width >> block)]
    delta = lambda t, c: _signed(t) * _signed(c) >> 5
    out, sign = pixels.copy(), 1 if inverse else -1
    out[:, 1] = pixels[:, 1] + sign * delta(e[:, 3], pixels[:, 2]) & 255
    red = out[:, 1] if inverse else pixels[:, 1]
    out[:, 3] = pixels[:, 3] + sign * (delta(e[:, 2], pixels[:, 2]) + delta(e[:, 1], red)) & 255
    return out


def _bundle(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def decode(raw: bytes) -> np.ndarray:
    """The pixels of one lossless WebP file, (height, width, 4) of red, green, blue, alpha."""
    if raw[:4] != b"RIFF" or raw[8:16] != b"WEBPVP8L" or raw[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = _Bits(raw, 21)
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise ValueError("an unknown version")
    undo, wide = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            block = bits.read(3) + 2
            part = _channels(_image(bits, -(-wide // (1 << block)), -(-height // (1 << block)), False))
            undo.append((kind, wide, block, part))
        elif kind == 2:
            undo.append((2, wide, 0, None))
        else:
            size = bits.read(8) + 1
            colors = np.cumsum(_channels(_image(bits, size, 1, False)), axis=0) & 255
            undo.append((3, wide, _bundle(size), colors))
            wide = -(-wide // (1 << _bundle(size)))
    pixels = _image(bits, wide, height, True)
    if not undo:
        return np.stack([pixels >> s & 255 for s in (16, 8, 0, 24)], axis=-1).astype(np.uint8).reshape(height, width, 4)
    pixels = _channels(pixels)
    for kind, wide, block, part in reversed(undo):
        if kind == 0:
            pixels = _predictor(pixels, wide, part[:, 2] & 15, block, True)
        elif kind == 1:
            pixels = _cross_color(pixels, wide, part, block, True)
        elif kind == 2:
            pixels[:, 1] = pixels[:, 1] + pixels[:, 2] & 255
            pixels[:, 3] = pixels[:, 3] + pixels[:, 2] & 255
        else:
            each = 8 >> block
            packed = -(-wide // (1 << block))
            x = np.arange(wide)
            index = pixels[:, 2].reshape(height, packed)[:, x >> block] >> (x & (1 << block) - 1) * each & (1 << each) - 1
            table = np.zeros((256, 4), np.int64)
            table[: len(part)] = part
            pixels = table[index.ravel()]
    return pixels[:, [1, 2, 3, 0]].astype(np.uint8).reshape(height, width, 4)


def _put_single(out: _Writer, symbol: int) -> None:
    out.put(1, 1)
    out.put(0, 1)
    out.put(int(symbol > 1), 1)
    out.put(symbol, 8 if symbol > 1 else 1)


def _huffman(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Code lengths of at most ``most`` by merging the two least counts."""
    order = np.argsort(counts, kind="stable")
    leaves, n, floor = counts[order].tolist(), len(counts), 0
    if n == 1:
        return np.ones(1, np.int64)
    while True:
        leaf = [max(x, floor) for x in leaves]
        inner: list[int] = []
        above = [0] * (2 * n - 1)
        i = j = 0
        for k in range(n - 1):
            both = 0
            for _ in (0, 1):
                if j >= k or (i < n and leaf[i] <= inner[j]):
                    both += leaf[i]
                    above[i] = n + k
                    i += 1
                else:
                    both += inner[j]
                    above[n + j] = n + k
                    j += 1
            inner.append(both)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        if depth[0] <= most:
            lengths = np.empty(n, np.int64)
            lengths[order] = depth[:n]
            return lengths
        floor = 2 * floor + 1


def _put_code(out: _Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes the prefix code of the counts; returns each symbol's bits and their number."""
    used = np.flatnonzero(counts)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        _put_single(out, int(used[0]) if len(used) else 0)
        return np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.int64)
    lengths = np.zeros(len(counts), np.int64)
    lengths[used] = _huffman(counts[used])
    if len(used) == 1:
        lengths[0] = 1
    # Runs of lengths: 16 repeats the one before, 17 and 18 are zeros.
    tokens: list[tuple[int, int, int]] = []
    first = [0, *(np.flatnonzero(lengths[1:] != lengths[:-1]) + 1).tolist()]
    for value, run in zip(lengths[first].tolist(), (b - a for a, b in zip(first, [*first[1:], len(lengths)]))):
        if value:
            tokens.append((value, 0, 0))
            run -= 1
        while run >= 3:
            kind, least, most, n = (16, 3, 6, 2) if value else (18, 11, 138, 7) if run >= 11 else (17, 3, 10, 3)
            tokens.append((kind, min(run, most) - least, n))
            run -= min(run, most)
        tokens += [(value, 0, 0)] * run
    of_counts = np.bincount([t[0] for t in tokens], minlength=19)
    of_lengths, kinds = np.zeros(19, np.int64), np.flatnonzero(of_counts)
    of_lengths[kinds] = _huffman(of_counts[kinds], 7)
    n = max(4, 1 + max(k for k, x in enumerate(CODE_LENGTH_ORDER) if of_lengths[x]))
    out.put(0, 1)
    out.put(n - 4, 4)
    for k in CODE_LENGTH_ORDER[:n]:
        out.put(int(of_lengths[k]), 3)
    out.put(0, 1)
    code, size = (x.tolist() for x in PrefixCode(of_lengths).codes())
    for kind, extra, n in tokens:
        out.put(code[kind] | extra << size[kind], size[kind] + n)
    return PrefixCode(lengths).codes()


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits, their number) of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    extra = top - 1
    return 2 * top + second, v & ((1 << extra) - 1), extra


@lru_cache(64)
def _near(width: int) -> dict[int, int]:
    """Distance codes up to 120, by distance."""
    return {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}


def _before(key: np.ndarray) -> np.ndarray:
    """The last earlier place of each place's key, or -1."""
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    out = np.full(len(key), -1)
    out[order[same + 1]] = order[same]
    return out


def _copies(argb: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of greedy back-references of 3 pixels or more."""
    if len(argb) < 4:
        return []
    key = argb[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ argb[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ argb[2:] * np.uint64(0x165667B19E3779F9)
    before = _before(key)
    places = np.flatnonzero((before >= 0) & (np.arange(len(before)) - before <= (1 << 20) - 120))
    found, at, n = [], 0, len(argb)
    if not len(places):
        return found
    pixels, before = argb.tolist(), before.tolist()
    for i in places.tolist():
        if i < at:
            continue
        j, k, most = before[i], 0, min(4096, n - i)
        while k < most and pixels[i + k] == pixels[j + k]:
            k += 1
        if k >= 3:
            found.append((i, k, i - j))
            at = i + k
    return found


def _put_image(out: _Writer, argb: np.ndarray, width: int, top: bool, cache_bits: int = 0, references: bool = False) -> None:
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if top:
        out.put(0, 1)
    argb = argb.astype(np.uint64)
    copies = _copies(argb) if references else []
    alone = np.ones(len(argb), bool)
    for at, length, _ in copies:
        alone[at : at + length] = False
    symbol = (argb >> np.uint64(8) & np.uint64(255)).astype(np.int64)
    pixel = alone
    if cache_bits:
        slot = ((argb * np.uint64(_HASH) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).astype(np.int64)
        before = _before(slot)
        hit = alone & (before >= 0) & (argb[before] == argb)
        symbol[hit] = 280 + slot[hit]
        pixel = alone & ~hit
    coded = [(*_prefix(length), *_prefix(_near(width).get(d, d + 120))) for _, length, d in copies]
    places = [c[0] for c in copies]
    symbol[places] = [256 + c[0] for c in coded]
    begins = alone.copy()
    begins[places] = True
    parts = [(argb[pixel] >> np.uint64(k) & np.uint64(255)).astype(np.int64) for k in (16, 0, 24)]
    green, *codes = (
        _put_code(out, np.bincount(given, minlength=n))
        for given, n in ((symbol[begins], 280 + ((1 << cache_bits) if cache_bits else 0)), *((x, 256) for x in parts), (np.array([c[3] for c in coded], np.int64), 40))
    )
    bits, size = green[0][symbol], green[1][symbol]
    value, n = bits[pixel], size[pixel]
    for part, (code, length) in zip(parts, codes):
        value |= code[part] << n.astype(np.uint64)
        n = n + length[part]
    bits[pixel], size[pixel] = value, n
    for at, (_, extra, wide, far, more, far_wide) in zip(places, coded):
        value, n = int(bits[at]), int(size[at])
        value |= extra << n
        value |= int(codes[3][0][far]) << (n := n + wide)
        value |= more << (n := n + int(codes[3][1][far]))
        bits[at], size[at] = value, n + far_wide
    out.put_all(bits[begins], size[begins])


def _wrap(body: bytes) -> bytes:
    body += b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


def _head(out: _Writer, width: int, height: int) -> None:
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)


def encode(pixels: np.ndarray, transforms: tuple[str, ...] = (), mode: int = 11, cross: tuple[int, int, int] = (0, 0, 0), cache_bits: int = 0, references: bool = False, block: int = 3) -> bytes:
    """A lossless WebP file with Huffman codes and the features asked for.

    ``transforms``, in the order in which they are applied: predictor, cross,
    green, palette (which must come first and needs 256 colours at most).
    """
    height, width = pixels.shape[:2]
    p = pixels.reshape(-1, 4).astype(np.int64)[:, [3, 0, 1, 2]]
    out = _Writer()
    _head(out, width, height)
    as_argb = lambda c: (c[:, 0] << 24 | c[:, 1] << 16 | c[:, 2] << 8 | c[:, 3]).astype(np.uint32)
    for name in transforms:
        out.put(1, 1)
        out.put(("predictor", "cross", "green", "palette").index(name), 2)
        if name == "predictor":
            out.put(block - 2, 3)
            across = -(-width // (1 << block))
            blocks = across * -(-height // (1 << block))
            _put_image(out, np.full(blocks, 0xFF000000 | mode << 8, np.uint32), across, False)
            p = _predictor(p, width, np.full(blocks, mode), block, False)
        elif name == "cross":
            out.put(block - 2, 3)
            across = -(-width // (1 << block))
            blocks = across * -(-height // (1 << block))
            element = np.array([[255, *(x & 255 for x in cross)]] * blocks)
            _put_image(out, as_argb(element), across, False)
            p = _cross_color(p, width, element, block, False)
        elif name == "green":
            p[:, 1] = p[:, 1] - p[:, 2] & 255
            p[:, 3] = p[:, 3] - p[:, 2] & 255
        else:
            colors, index = np.unique(as_argb(p), return_inverse=True)
            out.put(len(colors) - 1, 8)
            table = _channels(colors)
            _put_image(out, as_argb(np.diff(table, axis=0, prepend=np.zeros((1, 4), np.int64)) & 255), len(colors), False)
            fold = _bundle(len(colors))
            packed = -(-width // (1 << fold))
            wide = np.zeros((height, packed << fold), np.int64)
            wide[:, :width] = index.reshape(height, width)
            green = (wide.reshape(height, packed, 1 << fold) << np.arange(1 << fold) * (8 >> fold)).sum(axis=2).ravel()
            p = np.stack([np.full(len(green), 255), 0 * green, green, 0 * green], axis=1)
            width = packed
    out.put(0, 1)
    _put_image(out, as_argb(p), width, True, cache_bits, references)
    return _wrap(out.raw())


#: Multipliers tried for cross-colour: one takes red off blue in full, the others move channels by a few steps.
CROSS = ((0, 0, 32), (-1, 0, 0), (0, -1, 0))
