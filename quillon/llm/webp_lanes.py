"""Many lossless WebP files at a time: numpy arrays with one lane per file.

webp.py reads and writes one file symbol by symbol. Here the files of a batch are
written as arrays of bit fields, and read in step: each step reads the next symbol
of every file that is not at its end. A batch is bounded in files and pixels, so
memory does not depend on the length of a payload; a payload is stored as files of
at most ``STRIP`` rows. Every file has Huffman codes, back-references, a colour
cache and the transform that leaves the least entropy. What a file holds depends
on its own pixels alone, never on its batch.

Files with features that are not written here (meta prefix groups, several
transforms, other predictor modes) are read by webp.decode().
"""

from __future__ import annotations

import struct

import numpy as np

from quillon.llm import webp
from quillon.llm._text import U64

STRIP = 8  # rows of a file
LANES = 4096
PIXELS = 1 << 20
_INDEX = 21  # bits of a pixel's place in a batch
_MASK = U64((1 << _INDEX) - 1)
CACHE = 10
_PLAIN, _CROSS, _PREDICTOR, _PALETTE = 0, 1, 4, 6  # numbers of choices: green; three of cross; modes 1 and 2; palette

_EXTRA = np.array([0, 0, 0, 0, *((p - 2) >> 1 for p in range(4, 40))], np.int64)
_FIRST = np.array([1, 2, 3, 4, *(((2 + (p & 1)) << ((p - 2) >> 1)) + 1 for p in range(4, 40))], np.int64)
_NEAR = np.array([(0, 0), *webp.NEAR], np.int64)
_ORDER = np.array(webp.CODE_LENGTH_ORDER)


def _ends(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    end = np.cumsum(sizes)
    return end - sizes, end


def _within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place in the owner) of the items of runs of the given sizes."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]


# --- codes


def _huffman(code: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """Code lengths of entries that are sorted by code, by merging the two least counts in all codes at a time."""
    lengths = np.zeros(len(code), np.int64)
    if not len(code):
        return lengths
    first = np.flatnonzero(np.diff(code, prepend=-1))
    sizes = np.diff(np.append(first, len(code)))
    lengths[first[sizes == 1]] = 1
    floor = np.zeros(len(first), np.int64)
    left = np.flatnonzero(sizes > 1)
    while len(left):
        again = []
        by_size = left[np.argsort(-sizes[left], kind="stable")]
        # Codes of alike sizes go together, so that no step serves few and no table is mostly empty.
        cuts = np.flatnonzero(np.diff(np.frexp(sizes[by_size])[1], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(by_size)]):
            for c in range(a, b, 4096):
                group = by_size[c : min(b, c + 4096)]
                owner, k = _within(sizes[group])
                at = first[group][owner] + k
                depth = _merge(sizes[group], owner, np.maximum(count[at], floor[group][owner]))
                lengths[at] = depth
                deep = np.zeros(len(group), bool)
                deep[owner[depth > most]] = True
                again.append(group[deep])
        left = np.concatenate(again)
        floor[left] = 2 * floor[left] + 1
    return lengths


def _merge(m: np.ndarray, owner: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Depths of the leaves; codes are sorted by their number of leaves, most first."""
    n, wide = len(m), int(m[0])
    order = np.lexsort((count, owner))
    row, col = _within(m)
    none = 1 << 50
    leaf = np.full((n, wide + 1), none)
    leaf[row, col] = count[order]
    inner = np.full((n, wide + 1), none)
    above = np.zeros((n, 2 * (wide + 1)), np.int64)  # leaves, then inner nodes
    i, j = np.zeros(n, np.int64), np.zeros(n, np.int64)
    every = np.arange(n)
    flat_leaf, flat_inner, flat_above = leaf.ravel(), inner.ravel(), above.ravel()
    base, base2 = every * (wide + 1), every * 2 * (wide + 1)
    active = np.searchsorted(-m, -np.arange(1, wide + 1), "left")  # codes with more than k + 1 leaves
    for k in range(wide - 1):
        a = int(active[k])
        x, y, lb, ab = i[:a], j[:a], base[:a], base2[:a]
        both = 0
        for _ in (0, 1):
            one, two = flat_leaf[lb + x], flat_inner[lb + y]
            is_leaf = one <= two
            both = both + np.where(is_leaf, one, two)
            flat_above[ab + np.where(is_leaf, x, wide + 1 + y)] = k
            x += is_leaf
            y += ~is_leaf
        flat_inner[lb + k] = both
    depth = np.zeros((n, wide + 1), np.int64)
    flat_depth = depth.ravel()
    for k in range(wide - 3, -1, -1):
        a = int(active[k + 1])  # the root of a code of k + 2 leaves is its node k
        up = flat_above[base2[:a] + wide + 1 + k]
        flat_depth[base[:a] + k] = flat_depth[base[:a] + up] + 1
    out = np.empty(len(count), np.int64)
    out[order] = depth[row, above[row, col]] + 1
    return out


def _canonical(code: np.ndarray, symbol: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bits of entries sorted by code; a code of one entry has none."""
    order = np.argsort((code << 16) | (length << 12) | symbol, kind="stable")
    step = 1 << (16 - length[order])
    end = np.cumsum(step)
    first = np.diff(code[order], prepend=-1) != 0
    base = (end - step)[first][np.cumsum(first) - 1]
    bits = np.empty(len(code), np.int64)
    bits[order] = webp.REVERSED[(end - step - base) & 0xFFFF]
    return bits


# --- writing


class _Fields:
    """Bit fields of many lanes; ``slot`` orders the fields of a lane."""

    def __init__(self):
        self.parts = []

    def put(self, lane, slot, value, size) -> None:
        lane = np.asarray(lane, np.int64)
        self.parts.append((lane * 16 + slot, np.broadcast_to(np.asarray(value), lane.shape).astype(U64), np.broadcast_to(np.asarray(size, np.int64), lane.shape)))

    def raw(self, lanes: int) -> list[bytes]:
        key, value, size = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        order = np.argsort(key, kind="stable")
        lane, value, size = key[order] >> 4, value[order], size[order]
        total = np.bincount(lane, weights=size, minlength=lanes).astype(np.int64)
        n_bytes = (total + 7) // 8
        start, stop = _ends(n_bytes)
        end = np.cumsum(size)
        before = np.cumsum(total) - total
        at = end - size - before[lane] + 8 * start[lane]
        word, shift = at >> 6, (at & 63).astype(U64)
        out = np.zeros(int(stop[-1]) // 8 + 2, U64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(value << shift, first)
        over = np.flatnonzero((at & 63) + size > 64)
        np.bitwise_or.at(out, word[over] + 1, value[over] >> (U64(64) - shift[over]))
        raw = out.astype("<u8").tobytes()
        return [raw[a:b] for a, b in zip(start.tolist(), stop.tolist())]


def _put_singles(fields: _Fields, lane, slot, symbol) -> None:
    """Prefix codes of one symbol below 256."""
    wide = symbol > 1
    fields.put(lane, slot, 1 | wide << 2 | symbol << 3, np.where(wide, 11, 4))


def _put_codes(fields: _Fields, lane: np.ndarray, slot: int, of: np.ndarray, symbol: np.ndarray, count: np.ndarray, size: np.ndarray):
    """Writes one prefix code a lane; ``of`` is the entries' place in ``lane``, ``size`` the alphabets'.

    Returns the bits and the number of bits of a symbol, as tables of one row a lane.
    """
    wide = int(size.max())
    used = np.bincount(of, minlength=len(lane))
    single = np.zeros(len(lane), np.int64)
    alone = used[of] == 1
    single[of[alone]] = symbol[alone]
    # A lone symbol above 255 has no simple code: symbol 0 joins it.
    lone = np.flatnonzero((used == 1) & (single > 255))
    if len(lone):
        of, symbol, count = (np.concatenate(x) for x in ((of, lone), (symbol, 0 * lone), (count, 0 * lone + 1)))
        order = np.argsort(of << 16 | symbol, kind="stable")
        of, symbol, count = of[order], symbol[order], count[order]
        used[lone] = 2
    simple = used < 2
    _put_singles(fields, lane[simple], slot, single[simple])
    bits, length = np.zeros((len(lane), wide), U64), np.zeros((len(lane), wide), np.int64)
    keep = ~simple[of]
    of, symbol, count = of[keep], symbol[keep], count[keep]
    if not len(of):
        return bits, length
    n = _huffman(of, count, 15)
    bits[of, symbol], length[of, symbol] = _canonical(of, symbol, n).astype(U64), n
    # Runs of code lengths over the whole alphabets.
    rows = np.flatnonzero(~simple)
    number = np.full(len(lane), -1)
    number[rows] = np.arange(len(rows))
    start, end = _ends(size[rows])
    dense = np.zeros(int(end[-1]), np.uint8)
    dense[start[number[of]] + symbol] = n
    new = np.empty(len(dense), bool)
    new[1:] = dense[1:] != dense[:-1]
    new[start] = True
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(dense)))
    value = dense[first].astype(np.int64)
    run_of = np.searchsorted(start, first, "right") - 1
    # Tokens of a run: the value itself, full repeats, one repeat of the rest, or the rest as values.
    lead = (value > 0).astype(np.int64)
    rest = run - lead
    full = np.where(lead, 6, 138)
    times, rest = rest // full, rest % full
    some = (rest >= 3).astype(np.int64)
    plain = np.where(some, 0, rest)
    owner, k = _within(lead + times + some + plain)
    k = k - lead[owner]
    repeat = (k >= 0) & (k < (times + some)[owner])
    amount = np.where(k < times[owner], full[owner], rest[owner])
    of_zero = value[owner] == 0
    kind = np.where(repeat, np.where(of_zero, np.where(amount >= 11, 18, 17), 16), value[owner])
    extra = np.where(repeat, amount - np.where(kind == 18, 11, 3), 0)
    extra_bits = np.where(repeat, np.where(kind == 18, 7, np.where(kind == 17, 3, 2)), 0)
    token_of = run_of[owner]
    counts = np.bincount(token_of * 19 + kind, minlength=19 * len(rows))
    at = np.flatnonzero(counts)
    lengths = np.zeros(19 * len(rows), np.int64)
    lengths[at] = _huffman(at // 19, counts[at], 7)
    codes = np.zeros(19 * len(rows), np.int64)
    codes[at] = _canonical(at // 19, at % 19, lengths[at])
    lengths = lengths.reshape(-1, 19)
    inked = lengths[:, _ORDER] > 0
    n_codes = np.maximum(4, 19 - inked[:, ::-1].argmax(axis=1))
    fields.put(lane[rows], slot, (n_codes - 4) << 1, 5)
    fields.put(lane[rows], slot, (lengths[:, _ORDER].astype(U64) << (U64(3) * np.arange(19, dtype=U64))).sum(axis=1, dtype=U64), 3 * n_codes)
    fields.put(lane[rows], slot, 0, 1)
    one = np.bincount(at // 19, minlength=len(rows)) == 1
    token_bits = np.where(one[token_of], 0, lengths.ravel()[token_of * 19 + kind])
    token = np.where(one[token_of], 0, codes[token_of * 19 + kind])
    fields.put(lane[rows][token_of], slot, token | extra << token_bits, token_bits + extra_bits)
    return bits, length


def _earlier(key: np.ndarray) -> np.ndarray:
    """The last earlier place with the same key (of 43 bits), or -1."""
    packed = np.sort(key.astype(U64) << U64(_INDEX) | np.arange(len(key), dtype=U64))
    place = (packed & _MASK).astype(np.int64)
    same = np.flatnonzero((packed[1:] >> U64(_INDEX)) == (packed[:-1] >> U64(_INDEX)))
    out = np.full(len(key), -1)
    out[place[same + 1]] = place[same]
    return out


def _copies(argb: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, distance) of back-references of 3 pixels or more inside the lanes."""
    n = len(argb)
    if n < 4:
        return (np.zeros(0, np.int64),) * 3
    wide = argb.astype(U64)
    key = wide[:-2] * U64(0x9E3779B97F4A7C15) ^ wide[1:-1] * U64(0xC2B2AE3D27D4EB4F) ^ wide[2:] * U64(0x165667B19E3779F9)
    inside = of[:-2] == of[2:]
    before = np.full(n, -1)
    before[:-2] = np.where(inside, _earlier(of[:-2].astype(U64) << U64(30) | (key ^ key >> U64(29)) >> U64(34)), -1)
    at = np.flatnonzero(before >= 0)
    b = before[at]
    true = (argb[at] == argb[b]) & (argb[at + 1] == argb[b + 1]) & (argb[at + 2] == argb[b + 2]) & (of[b] == of[at])
    away = np.zeros(n + 1, np.int64)
    away[at[true]] = (at - b)[true]
    # Places in a row of one distance are one copy, which reaches two pixels beyond them.
    prior = np.concatenate([[0], away[:-1]])
    first = np.flatnonzero((away > 0) & (away != prior))
    stop = np.flatnonzero((away[:-1] > 0) & (away[:-1] != away[1:])) + 1
    shift = np.maximum(0, np.concatenate([[0], stop[:-1] + 2]) - first)[: len(first)]  # the copy before it holds these
    length = stop - first + 2 - shift
    good = length >= 3
    return (first + shift)[good], length[good], away[first][good]


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, extra bits, their number) of lengths or distance codes."""
    p = np.searchsorted(_FIRST, value, "right") - 1
    return p, value - _FIRST[p], _EXTRA[p]


def _put_images(fields: _Fields, lane: np.ndarray, slot: int, argb: np.ndarray, sizes: np.ndarray, widths: np.ndarray | None) -> None:
    """Entropy-coded images, one a lane; with ``widths`` main images, with cache and back-references."""
    of = np.repeat(np.arange(len(lane)), sizes)
    n = len(argb)
    symbol = (argb >> 8 & 255).astype(np.int64)
    pixel = begins = np.ones(n, bool)
    alphabet = np.full(len(lane), 280)
    at = length = d = np.zeros(0, np.int64)
    if widths is None:
        fields.put(lane, slot, 0, 1)
    else:
        cache = np.clip(np.frexp(sizes)[1] - 2, 1, CACHE).astype(np.int64)
        fields.put(lane, slot, 1 | cache << 1, 6)  # and no meta prefix groups
        alphabet = alphabet + (1 << cache)
        at, length, d = _copies(argb, of)
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + length, -1)
        alone = np.cumsum(step[:-1]) == 0
        place = ((argb.astype(U64) * U64(webp._HASH) & U64(0xFFFFFFFF)) >> (32 - cache).astype(U64)[of]).astype(np.int64)
        before = _earlier(of << CACHE | place)
        hit = alone & (before >= 0) & (argb[before] == argb)
        symbol[hit] = 280 + place[hit]
        pixel = alone & ~hit
        begins = alone.copy()
        begins[at] = True
    p, extra, extra_bits = _prefixes(length)
    symbol[at] = 256 + p
    if len(at):
        # Near distances have codes of their own; the least code of a distance is taken.
        w = widths[of[at]]
        codes = d + 120
        for k in range(120, 0, -1):
            codes[np.maximum(1, _NEAR[k, 0] + _NEAR[k, 1] * w) == d] = k
        far, more, more_bits = _prefixes(codes)
    else:
        far = more = more_bits = np.zeros(0, np.int64)
    tables = []
    wide = int(alphabet.max())
    for k, (owner, given, width, size) in enumerate(
        (
            (of[begins], symbol[begins], wide, alphabet),
            *((of[pixel], (argb[pixel] >> s & 255).astype(np.int64), 256, np.full(len(lane), 256)) for s in (16, 0, 24)),
            (of[at], far, 40, np.full(len(lane), 40)),
        )
    ):
        counts = np.bincount(owner * width + given, minlength=width * len(lane))
        entry = np.flatnonzero(counts)
        tables.append((*_put_codes(fields, lane, slot + 1 + k, entry // width, entry % width, counts[entry], size), owner, given))
    value, size = np.zeros(n, U64), np.zeros(n, np.int64)
    bits, length_of, owner, given = tables[0]
    value[begins], size[begins] = bits[owner, given], length_of[owner, given]
    v, m = value[pixel], size[pixel]
    for bits, length_of, owner, given in tables[1:4]:
        v |= bits[owner, given] << m.astype(U64)
        m = m + length_of[owner, given]
    value[pixel], size[pixel] = v, m
    if len(at):
        v, m = value[at], size[at]
        bits, length_of, owner, given = tables[4]
        for x, y in ((extra, extra_bits), (bits[owner, given], length_of[owner, given]), (more, more_bits)):
            v |= x.astype(U64) << m.astype(U64)
            m = m + y
        value[at], size[at] = v, m
    fields.put(lane[of[begins]], slot + 6, value[begins], size[begins])


def _argb(p: np.ndarray) -> np.ndarray:
    """uint32 of samples (..., red green blue alpha)."""
    q = p.astype(np.uint32)
    return q[..., 3] << 24 | q[..., 0] << 16 | q[..., 1] << 8 | q[..., 2]


def _samples(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> s & 255 for s in (16, 8, 0, 24)], axis=-1).astype(np.uint8)


def _cross(p: np.ndarray, cross, sign: int) -> np.ndarray:
    """Takes off (-1) or adds (1) the cross-colour parts; ``cross`` has red to blue, green to blue, green to red a row."""
    delta = lambda t, c: (t.astype(np.int8).astype(np.int32)[:, None] * c.view(np.int8) >> 5).astype(np.uint8)
    out = p.copy()
    green = np.ascontiguousarray(p[..., 1])
    move = delta(cross[:, 2], green)
    out[..., 0] = p[..., 0] + move if sign > 0 else p[..., 0] - move
    red = np.ascontiguousarray(out[..., 0] if sign > 0 else p[..., 0])
    move = delta(cross[:, 1], green) + delta(cross[:, 0], red)
    out[..., 2] = p[..., 2] + move if sign > 0 else p[..., 2] - move
    return out


def _residual(p: np.ndarray, top: np.ndarray, mode: int) -> np.ndarray:
    """Differences to left (1) or upper (2) pixels; ``top`` marks the first rows of files."""
    out = np.empty_like(p)
    left = lambda: np.diff(p[:, :, :], axis=1)
    above = np.concatenate([p[:1] * 0, p[:-1]])
    if mode == 1:
        out[:, 1:] = left()
        out[:, 0] = p[:, 0] - above[:, 0]
    else:
        out[:] = p - above
        out[top, 1:] = np.diff(p[top], axis=1)
    out[top, 0] = p[top, 0] - np.array([0, 0, 0, 255], np.uint8)
    return out


def _restore(r: np.ndarray, top: np.ndarray, mode: int) -> np.ndarray:
    r = r.copy()
    r[top, 0] += np.array([0, 0, 0, 255], np.uint8)
    first = np.flatnonzero(top)
    owner = np.cumsum(top) - 1

    def down(x):  # running sums that begin anew at each file
        total = np.cumsum(x, axis=0, dtype=np.uint8)
        before = (total[first] - x[first])[owner]
        return total - before

    if mode == 1:
        r[:, 0] = down(r[:, 0])
        return np.cumsum(r, axis=1, dtype=np.uint8)
    r[top] = np.cumsum(r[top], axis=1, dtype=np.uint8)
    return down(r)


def _entropies(p: np.ndarray, lane: np.ndarray, n: int) -> np.ndarray:
    """Bits of each lane's four channels by themselves; ``lane`` is the rows'."""
    out = np.zeros(n)
    for a in range(0, n, 1024):  # bounds the table of counts
        i, j = np.searchsorted(lane, (a, min(n, a + 1024)))
        key = ((lane[i:j, None, None] - a) * 1024 + np.arange(4) * 256) + p[i:j]
        counts = np.bincount(key.ravel(), minlength=1024 * min(1024, n - a)).reshape(-1, 1024)
        weight = _LOGS[np.minimum(counts, len(_LOGS) - 1)].sum(axis=1)
        total = counts.sum(axis=1) / 4
        out[a : a + 1024] = 4 * total * np.log2(np.maximum(total, 1)) - weight
    return out


_LOGS = np.arange(STRIP * 1024 + 1.0)
_LOGS[1:] *= np.log2(_LOGS[1:])


def encode_many(rows: np.ndarray, heights: np.ndarray) -> list[bytes]:
    """One file for each run of ``heights`` rows of samples, (rows, width, 4) of red, green, blue, alpha.

    The width must be a multiple of 8, and a file at most 8,192 pixels. At most
    LANES files and PIXELS pixels in all.
    """
    n, width = len(heights), rows.shape[1]
    lane = np.repeat(np.arange(n), heights)
    top = np.diff(lane, prepend=-1) != 0
    cross = np.array(webp.CROSS)
    given = _argb(rows)
    tried = [rows.copy()]
    tried[0][..., 0] -= rows[..., 1]
    tried[0][..., 2] -= rows[..., 1]
    tried += [_cross(rows, np.broadcast_to(c, (len(rows), 3)), -1) for c in cross]
    tried += [_residual(rows, top, mode) for mode in (1, 2)]
    bits = [_entropies(p, lane, n) for p in tried]
    colors, where, counts = np.unique(lane[:, None].astype(U64) << U64(32) | given, return_inverse=True, return_counts=True)
    color_lane = (colors >> U64(32)).astype(np.int64)
    n_colors = np.bincount(color_lane, minlength=n)
    pixels = heights * width
    spread = pixels * np.log2(pixels) - np.bincount(color_lane, weights=_LOGS[counts], minlength=n)
    bits.append(np.where(n_colors <= 256, spread + 26 * n_colors + 400, np.inf))
    choice = np.argmin(bits, axis=0)
    fields = _Fields()
    every = np.arange(n)
    fields.put(every, 0, 0x2F | (width - 1) << 8 | (heights.astype(np.int64) - 1) << 22 | 1 << 36, 40)
    fields.put(every, 0, 1 | np.choose(choice, (2, 1, 1, 1, 0, 0, 3)) << 1, 3)
    final = given.copy()
    for k, p in enumerate(tried):
        mine = choice[lane] == k
        final[mine] = _argb(p[mine])
    # Cross-colour and predictor data: one block of 2 ** 9 pixels, an image of one pixel.
    block = np.flatnonzero((choice >= _CROSS) & (choice < _PALETTE))
    element = np.zeros((n, 4), np.int64)  # red, green, blue, alpha
    element[:, 3] = 255
    is_cross = choice[block] < _PREDICTOR
    element[block[is_cross], :3] = cross[choice[block[is_cross]] - _CROSS] & 255
    element[block[~is_cross], 1] = choice[block[~is_cross]] - _PREDICTOR + 1
    fields.put(block, 0, 7, 3)
    fields.put(block, 0, 0, 1)
    for k in (1, 0, 2, 3):
        _put_singles(fields, block, 0, element[block, k])
    _put_singles(fields, block, 0, 0 * block)
    # Palettes.
    widths = np.full(n, width)
    flat, sizes = final.ravel(), pixels
    some = np.flatnonzero(choice == _PALETTE)
    if len(some):
        fields.put(some, 0, n_colors[some] - 1, 8)
        table = _samples((colors & U64(0xFFFFFFFF)).astype(np.uint32))
        steps = np.diff(table, axis=0, prepend=table[:1] * 0)
        first_color = np.cumsum(n_colors) - n_colors
        steps[first_color] = table[first_color]
        mine = np.isin(color_lane, some)
        _put_images(fields, some, 1, _argb(steps[mine]), n_colors[some], None)
        fold = np.zeros(n, np.int64)
        fold[some] = np.select([n_colors[some] <= 2, n_colors[some] <= 4, n_colors[some] <= 16], [3, 2, 1], 0)
        widths = width >> fold
        index = (where.reshape(given.shape) - first_color[lane][:, None]).astype(np.int64)
        parts = [None] * n
        keep = np.ones(len(rows), bool)
        for f in range(4):
            mine = (choice[lane] == _PALETTE) & (fold[lane] == f)
            if mine.any():
                green = (index[mine].reshape(int(mine.sum()), width >> f, 1 << f) << np.arange(1 << f) * (8 >> f)).sum(axis=2)
                packed = (0xFF000000 | green << 8).astype(np.uint32)
                cut = np.flatnonzero(top[mine])[1:]
                for k, part in zip(lane[mine][top[mine]].tolist(), np.split(packed, cut)):
                    parts[k] = part.ravel()
                keep &= ~mine
        others = final[keep]
        cut = np.flatnonzero(top[keep])
        for k, a, b in zip(lane[keep][top[keep]].tolist(), cut, [*cut[1:], len(others)]):
            parts[k] = others[a:b].ravel()
        flat, sizes = np.concatenate(parts), heights * widths
    fields.put(every, 8, 0, 1)
    _put_images(fields, every, 8, flat, sizes, widths)
    return [webp._wrap(body) for body in fields.raw(n)]


# --- reading


class _Lanes:
    """The bits of many streams, one after another in one buffer."""

    def __init__(self, raw: list[bytes], skip: int):
        size = np.array([len(r) for r in raw], np.int64)
        start, end = _ends(size)
        buffer = b"".join(raw) + bytes(16)
        self.words = np.ndarray((len(buffer) - 8,), "<u8", buffer, 0, (1,)).astype(U64)
        self.at, self.end = 8 * (start + skip), 8 * end

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The 57 or more bits from each place on."""
        return self.words.take(at >> 3, mode="clip") >> (at & 7).astype(U64)

    def read(self, lanes, n) -> np.ndarray:
        out = self.peek(self.at[lanes]) & ((U64(1) << np.asarray(n).astype(U64)) - U64(1))
        self.at[lanes] += n
        return out.astype(np.int64)


def _lookup(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table, first place, mask) by lane of code lengths (lanes, symbols): symbol << 4 | length by the next bits."""
    lane, symbol = np.nonzero(lengths)
    n = lengths[lane, symbol].astype(np.int64)
    used = np.bincount(lane, minlength=len(lengths))
    if (used == 0).any():
        raise ValueError("a prefix code without symbols")
    longest = lengths.max(axis=1).astype(np.int64)
    longest[used == 1] = 0
    n[used[lane] == 1] = 0
    order = np.argsort(lane << 16 | n << 12 | symbol, kind="stable")
    lane, symbol, n = lane[order], symbol[order], n[order]
    times = 1 << (longest[lane] - n)
    start, end = _ends(1 << longest)
    if (np.bincount(lane, weights=times, minlength=len(lengths)) != 1 << longest).any():
        raise ValueError("an incomplete prefix code")
    by_code = np.repeat((symbol << 4 | n).astype(np.uint16), times)
    owner, k = _within(1 << longest)
    table = by_code[start[owner] + (webp.REVERSED[k] >> (16 - longest[owner]))]
    return table, start, (1 << longest) - 1


def _read_lengths(bits: _Lanes, lanes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lanes), max(256, int(sizes.max()))), np.uint8)
    simple = bits.read(lanes, 1) == 1
    s = np.flatnonzero(simple)
    if len(s):
        two, wide = bits.read(lanes[s], 1), bits.read(lanes[s], 1)
        out[s, bits.read(lanes[s], np.where(wide, 8, 1))] = 1
        two = s[two == 1]
        out[two, bits.read(lanes[two], 8)] = 1
    normal = np.flatnonzero(~simple)
    if not len(normal):
        return out
    mine = lanes[normal]
    n_codes = 4 + bits.read(mine, 4)
    window = bits.peek(bits.at[mine])
    of_lengths = np.zeros((len(mine), 19), np.uint8)
    of_lengths[:, _ORDER] = ((window[:, None] >> (U64(3) * np.arange(19, dtype=U64))) & U64(7)) * (np.arange(19) < n_codes[:, None])
    bits.at[mine] += 3 * n_codes
    table, start, mask = _lookup(of_lengths)
    mask = mask.astype(U64)
    limited = bits.read(mine, 1) == 1
    left = sizes[normal].copy()
    some = np.flatnonzero(limited)
    if len(some):
        left[some] = 2 + bits.read(mine[some], 2 + 2 * bits.read(mine[some], 3))
    pos, at, before = bits.at[mine], np.zeros(len(mine), np.int64), np.full(len(mine), 8)
    size, flat = sizes[normal], out.ravel()
    base = normal * out.shape[1]
    live = np.arange(len(mine))
    while len(live):
        window = bits.peek(pos[live])
        t = table[start[live] + (window & mask[live]).astype(np.int64)].astype(np.int64)
        used = t & 15
        s = t >> 4
        plain = s < 16
        now = live[plain]
        flat[base[now] + at[now]] = s[plain]
        before[now] = np.where(s[plain] > 0, s[plain], before[now])
        times = np.ones(len(live), np.int64)
        again = np.flatnonzero(~plain)
        if len(again):
            kind = s[again] - 16
            extra = np.array([2, 3, 7])[kind]
            times[again] = np.array([3, 3, 11])[kind] + ((window[again] >> used[again].astype(U64)).astype(np.int64) & ((1 << extra) - 1))
            used[again] += extra
            if (at[live[again]] + times[again] > size[live[again]]).any():
                raise ValueError("too many code lengths")
            same = again[kind == 0]
            if len(same):
                owner, k = _within(times[same])
                who = live[same][owner]
                flat[base[who] + at[who] + k] = before[who]
        pos[live] += used
        at[live] += times
        left[live] -= 1
        live = live[(at[live] < size[live]) & (left[live] > 0)]
    bits.at[mine] = pos
    return out


def _read_images(bits: _Lanes, lanes: np.ndarray, widths: np.ndarray, totals: np.ndarray, cache_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pixels as uint32 ARGB of all lanes in a row, first pixel of each), in step."""
    tables, starts, masks, held = [], [], [], 0
    for k in range(5):
        sizes = np.full(len(lanes), (280, 256, 256, 256, 40)[k])
        if k == 0:
            sizes += np.where(cache_bits > 0, 1 << cache_bits, 0)
        table, start, mask = _lookup(_read_lengths(bits, lanes, sizes))
        tables.append(table)
        starts.append(start + held)
        masks.append(mask.astype(U64))
        held += len(table)
    table = np.concatenate([*tables, np.zeros(1, np.uint16)]).astype(np.int64)  # the last entry: symbol 0, no bits
    first, end = _ends(totals)
    out = np.zeros(int(end[-1]) + 1, U64)  # the last pixel is waste
    cache_first, cache_end = _ends(1 << cache_bits)
    cache = np.zeros(int(cache_end[-1]) + 1, U64)
    place, stop, pos = first.copy(), end.copy(), bits.at[lanes]
    who, width, shift, slots = np.arange(len(lanes)), widths.copy(), (32 - cache_bits).astype(U64), cache_first.copy()
    state = [place, stop, pos, who, width, shift, slots, *starts, *masks]
    hash_, low, eight, byte = U64(webp._HASH), U64(0xFFFFFFFF), U64(8), U64(16)
    idle = 0
    final = np.zeros(len(lanes), np.int64)
    one = totals == 0
    if one.any():
        raise ValueError("an image without pixels")
    while len(state[0]):
        place, stop, pos, who, width, shift, slots, green, red, blue, alpha, far, m_green, m_red, m_blue, m_alpha, m_far = state
        live = len(place)
        for _ in range(64):
            w = bits.peek(pos)
            e = table.take(green + (w & m_green).astype(np.int64))
            s, used = e >> 4, e & 15
            step = np.ones(live, np.int64)
            literal = np.flatnonzero(s < 256)
            if len(literal):
                x = w[literal] >> used[literal].astype(U64)
                r = table.take(red[literal] + (x & m_red[literal]).astype(np.int64))
                x >>= (r & 15).astype(U64)
                b = table.take(blue[literal] + (x & m_blue[literal]).astype(np.int64))
                n = used[literal] + (r & 15) + (b & 15)
                x = bits.peek(pos[literal] + n)
                a = table.take(alpha[literal] + (x & m_alpha[literal]).astype(np.int64))
                used[literal] = n + (a & 15)
                color = ((a >> 4) << 24 | (r >> 4) << 16 | s[literal] << 8 | b >> 4).astype(U64)
                out[place[literal]] = color
                cache[slots[literal] + ((hash_ * color & low) >> shift[literal]).astype(np.int64)] = color
            if len(literal) < live:
                other = np.flatnonzero(s >= 256)
                hit = other[s[other] >= 280]
                out[place[hit]] = cache[slots[hit] + s[hit] - 280]
                c = other[s[other] < 280]
                if len(c):
                    p = s[c] - 256
                    n = used[c]
                    length = _FIRST[p] + ((w[c] >> n.astype(U64)).astype(np.int64) & ((1 << _EXTRA[p]) - 1))
                    n = n + _EXTRA[p]
                    x = bits.peek(pos[c] + n)
                    f = table.take(far[c] + (x & m_far[c]).astype(np.int64))
                    x >>= (f & 15).astype(U64)
                    p = f >> 4
                    n = n + (f & 15) + _EXTRA[p]
                    d = _FIRST[p] + (x.astype(np.int64) & ((1 << _EXTRA[p]) - 1))
                    near = _NEAR[np.minimum(d, 120)]
                    d = np.where(d > 120, d - 120, np.maximum(1, near[:, 0] + near[:, 1] * width[c]))
                    if (d > place[c] - first[who[c]]).any() or (place[c] + length > stop[c]).any():
                        raise ValueError("a back-reference leaves the image")
                    owner, k = _within(length)
                    to = place[c][owner]
                    color = out[to - d[owner] + k % d[owner]]
                    out[to + k] = color
                    cache[slots[c][owner] + ((hash_ * color & low) >> shift[c][owner]).astype(np.int64)] = color
                    used[c] = n
                    step[c] = length
            pos += used
            place += step
            done = np.flatnonzero(place == stop)
            if len(done):
                # A finished lane reads symbol 0 of no bits and writes to the waste pixel until lanes are dropped.
                final[who[done]] = pos[done]
                place[done], stop[done], slots[done], shift[done] = len(out) - 1, -1, len(cache) - 1, U64(32)
                for base, mask in zip((green, red, blue, alpha), (m_green, m_red, m_blue, m_alpha)):
                    base[done], mask[done] = len(table) - 1, U64(0)
                idle += len(done)
            place[stop < 0] = len(out) - 1
            if 8 * idle > live:
                break
        if idle:
            keep = stop >= 0
            state = [x[keep] for x in state]
            idle = 0
    if (final > bits.end[lanes]).any():
        raise ValueError("the stream ends early")
    bits.at[lanes] = final
    return out[:-1].astype(np.uint32), first


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of each file, (height, width, 4) of red, green, blue, alpha."""
    for raw in files:
        if raw[:4] != b"RIFF" or raw[8:16] != b"WEBPVP8L" or raw[20] != 0x2F:
            raise ValueError("not a lossless WebP file")
    n = len(files)
    if not n:
        return []
    bits = _Lanes(files, 21)
    every = np.arange(n)
    width, height = bits.read(every, 14) + 1, bits.read(every, 14) + 1
    bits.read(every, 1)
    whole = (bits.read(every, 3) == 0) & (width == width[0])  # decoded here
    w0 = int(width[0])
    kind = np.where(bits.read(every, 1), bits.read(every, 2), 4)  # 4: no transform, and the bits went unread
    bits.at[kind == 4] -= 2
    whole &= w0 % 8 == 0 if w0 % 8 else True
    element, fold, n_colors, colors = np.zeros((n, 4), np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64), {}
    block = np.flatnonzero(whole & (kind < 2))
    if len(block):
        size = bits.read(block, 3) + 2
        one = (width[block] <= 1 << size) & (height[block] <= 1 << size)
        plain = bits.read(block, 1) == 0
        whole[block[~(one & plain)]] = False
        block = block[one & plain]
    if len(block):
        got, _ = _read_images(bits, block, 0 * block + 1, 0 * block + 1, 0 * block)
        element[block] = _samples(got)
        mode = element[block, 1] & 15
        whole[block[(kind[block] == 0) & (mode != 1) & (mode != 2)]] = False
    some = np.flatnonzero(whole & (kind == 3))
    if len(some):
        n_colors[some] = bits.read(some, 8) + 1
        fold[some] = np.select([n_colors[some] <= 2, n_colors[some] <= 4, n_colors[some] <= 16], [3, 2, 1], 0)
        plain = (bits.read(some, 1) == 0) & (w0 % 8 == 0)
        whole[some[~plain]] = False
        some = some[plain]
    if len(some):
        got, first = _read_images(bits, some, n_colors[some], n_colors[some], 0 * some)
        table = np.zeros((n, 256, 4), np.uint8)
        for k, a in zip(some.tolist(), first.tolist()):
            table[k, : n_colors[k]] = np.cumsum(_samples(got[a : a + n_colors[k]]), axis=0, dtype=np.uint8)
    some = np.flatnonzero(whole & (kind < 4))
    if len(some):
        whole[some[bits.read(some, 1) == 1]] = False  # a second transform
    main = np.flatnonzero(whole)
    cache = np.zeros(n, np.int64)
    if len(main):
        has = main[bits.read(main, 1) == 1]
        cache[has] = bits.read(has, 4)
        whole[main[bits.read(main, 1) == 1]] = False  # meta prefix groups
        main = np.flatnonzero(whole)
    out: list = [None] * n
    for k in np.flatnonzero(~whole).tolist():
        out[k] = webp.decode(files[k])
    if not len(main):
        return out
    wide = w0 >> fold[main]
    got, first = _read_images(bits, main, wide, wide * height[main], cache[main])
    # Undo the transforms, for all rows of a kind at a time.
    for f in range(4):
        for what in ((3,) if f else (0, 1, 2, 3, 4)):
            pick = np.flatnonzero((kind[main] == what) & (fold[main] == f))
            if not len(pick):
                continue
            owner, k = _within((wide * height[main])[pick])
            p = got[first[pick][owner] + k].reshape(-1, w0 >> f)
            mine = main[pick]
            row, y = _within(height[mine])
            if what == 3:
                x = np.arange(w0)
                index = (p >> 8 & 255)[:, x >> f] >> (x & (1 << f) - 1) * (8 >> f) & (1 << (8 >> f)) - 1
                q = table[mine[row][:, None], index]
            else:
                q = _samples(p)
                if what == 2:
                    q[..., 0] += q[..., 1]
                    q[..., 2] += q[..., 1]
                elif what == 1:
                    q = _cross(q, element[mine[row]][:, :3], 1)
                elif what == 0:
                    for mode in (1, 2):
                        these = (element[mine[row], 1] & 15) == mode
                        if these.any():
                            q[these] = _restore(q[these], (y == 0)[these], mode)
            for m, part in zip(mine.tolist(), np.split(q, np.cumsum(height[mine])[:-1])):
                out[m] = part
    return out


# --- payloads


def encode_payloads(payloads: list[bytes], width: int = 144) -> list[bytes]:
    """Each payload, a multiple of 4 * width bytes, as files of at most STRIP rows in a row."""
    row = 4 * width
    heights: list[int] = []
    owner: list[int] = []
    for k, payload in enumerate(payloads):
        rows = len(payload) // row
        for at in range(0, rows, STRIP):
            heights.append(min(STRIP, rows - at))
            owner.append(k)
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, width, 4)
    out: list[list[bytes]] = [[] for _ in payloads]
    starts = np.concatenate([[0], np.cumsum(heights)]).astype(np.int64)
    a = 0
    while a < len(heights):
        b = min(a + LANES, int(np.searchsorted(starts, starts[a] + PIXELS // width, "right")) - 1)
        b = max(b, a + 1)
        files = encode_many(data[starts[a] : starts[b]], np.array(heights[a:b], np.int64))
        for k, f in zip(owner[a:b], files):
            out[k].append(f)
        a = b
    return [b"".join(x) for x in out]


def split_files(stored: bytes) -> list[bytes]:
    files, at = [], 0
    while at < len(stored):
        size = 8 + struct.unpack_from("<I", stored, at + 4)[0]
        files.append(stored[at : at + size])
        at += size
    return files


def decode_payloads(stored: list[bytes]) -> list[np.ndarray]:
    """The samples of each stored payload, as rows of pixels."""
    files, owner = [], []
    for k, s in enumerate(stored):
        mine = split_files(s)
        files += mine
        owner += [k] * len(mine)
    # Files alike in size go together, so that few wait for the longest of their batch.
    order = sorted(range(len(files)), key=lambda k: -_pixels(files[k]))
    parts: list = [None] * len(files)
    a = 0
    while a < len(order):
        b, held = a, 0
        while b < len(order) and b - a < LANES and (b == a or held + _pixels(files[order[b]]) <= PIXELS):
            held += _pixels(files[order[b]])
            b += 1
        for k, p in zip(order[a:b], decode_many([files[k] for k in order[a:b]])):
            parts[k] = p
        a = b
    out: list[list] = [[] for _ in stored]
    for k, p in zip(owner, parts):
        out[k].append(p)
    return [np.concatenate(x) for x in out]


def _pixels(raw: bytes) -> int:
    size = int.from_bytes(raw[21:25], "little")
    return ((size & 0x3FFF) + 1) * ((size >> 14 & 0x3FFF) + 1)
