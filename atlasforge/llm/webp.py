"""Lossless WebP columns: a decoder for the whole format, and an encoder for byte payloads that uses all of it but meta codes.

The decoder reads prefix codes (simple and normal, with meta prefix images), back-references with the
distance map, the colour cache, and inverts the predictor, cross-colour, subtract-green and colour-indexing
transforms, in any allowed order.

The encoder stores four payload bytes to a pixel, as alpha, red, green and blue, WIDTH pixels to a row (wider where a payload
needs more than MAX_SIDE rows). Images of at most 256 colours, and half as many as pixels, get a palette, up to eight indexes to a pixel. The others get
the transforms that make them smallest by the entropy of their channels: none, predictor, cross-colour (with subtract-green), or predictor and then
cross-colour. All images have
canonical prefix codes made for their own counts, and a colour cache and back-references to the latest equal run of three
pixels or more, where these stand for an eighth of the pixels. Payloads of more than a whole image (a gigabyte) are split into several files.

Images are encoded together, as one tall image whose rows have owners: each step of numpy works on all images of up to BATCH_PIXELS pixels in all.
A file depends on its payload alone. Only the lengths of a code's symbols are worked out one code at a time.

Files of a batch are decoded side by side: each step reads the next pixel of LANES images at once, and an image that ends makes room for the
next. Images much longer than the others' mean, and those with meta codes, are read alone.

Defined results: a null text is empty; a payload is padded with bytes 255 to a positive multiple of 576; texts with equal
bytes have equal media and features; nothing is dropped, however long the text. Rows keep their doc_id, null or repeated.
Columns besides the id and text columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD, WIDTH, MAX_SIDE = 576, 144, 16384
CACHE_BITS, BLOCK_BITS, MODES = 7, 5, (2, 7, 9, 10)

# Fixed values of the format: order of code-length codes, and (dx, dy) of the short distance codes.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
DISTANCE_MAP = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, INDEXING = range(4)


class Bits:
    """Reads little-endian bit fields."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.end = 8 * len(data)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the stream ends early")
        at = self.at
        self.at = at + n
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 9], "little") >> (at & 7)) & ((1 << n) - 1)

    def span(self, at: int, n: int) -> int:
        """Any number of bits from a place, as one number."""
        return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        i, s = divmod(self.at, 8)
        return (int.from_bytes(self.data[i : i + 4], "little") >> s) & ((1 << n) - 1)


REVERSED = [np.array([int(format(i, f"0{n}b")[::-1], 2) if n else 0 for i in range(1 << n)], dtype=np.int64) for n in range(16)]


class PrefixCode:
    """A canonical prefix code."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        self.symbols = np.flatnonzero(lengths)
        n = len(self.symbols)
        self.single = int(self.symbols[0]) if n == 1 else (0 if n == 0 else None)
        self.longest = 0
        if self.single is not None:
            return
        sizes = lengths[self.symbols]
        self.longest = int(sizes.max())
        if int((1 << (self.longest - sizes)).sum()) != 1 << self.longest:
            raise ValueError("the prefix code is not complete")

    @cached_property
    def table(self) -> list[int]:
        return self.entries().tolist()

    def entries(self) -> np.ndarray:
        """32 * symbol + length for each value of the next `longest` bits."""
        if self.single is not None:
            return np.array([self.single << 5], dtype=np.int32)
        by = self.symbols[np.argsort(self.lengths[self.symbols], kind="stable")]
        sizes = self.lengths[by].astype(np.int64)
        # canonical codes divide the values, most significant bit first, into ranges
        return np.repeat((by << 5 | sizes).astype(np.int32), 1 << (self.longest - sizes))[REVERSED[self.longest]]

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        found = self.table[bits.peek(self.longest)]
        bits.at += found & 31
        if bits.at > bits.end:
            raise ValueError("the stream ends early")
        return found >> 5


@lru_cache(maxsize=1024)
def _lengths_code(head: int, n: int) -> PrefixCode:
    """The code for code lengths whose first n kinds have the lengths in head, three bits each."""
    kinds = np.zeros(19, dtype=np.int64)
    kinds[list(CODE_ORDER[:n])] = [head >> 3 * i & 7 for i in range(n)]
    return PrefixCode(kinds)


@lru_cache(maxsize=2048)
def _one_symbol(symbol: int, alphabet: int) -> PrefixCode:
    lengths = np.zeros(alphabet, dtype=np.int64)
    lengths[symbol] = 1
    return PrefixCode(lengths)


@lru_cache(maxsize=1 << 16)
def _word(code: PrefixCode, w: int) -> tuple[tuple[int, ...], int, int]:
    """The code lengths that 16 bits say for sure, how many of the bits these take, and the last length that is not 0 (or 0)."""
    found: list[int] = []
    at = last = 0
    mask = (1 << code.longest) - 1
    while True:
        step = code.table[w >> at & mask]
        n, size = step >> 5, step & 31
        least, extra = ((1, 0), (3, 2), (3, 3), (11, 7))[max(0, n - 15)]
        if at + size + extra > 16 or (n == 16 and not last):
            return tuple(found), at, last
        last = n if 0 < n < 16 else last
        found += [n if n < 16 else last if n == 16 else 0] * (least + (w >> (at + size) & ((1 << extra) - 1)))
        at += size + extra


def _read_code(bits: Bits, alphabet: int) -> PrefixCode:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        if not two:
            return _one_symbol(first, alphabet)
        lengths = np.zeros(alphabet, dtype=np.int64)
        lengths[[first, bits.read(8)]] = 1
        return PrefixCode(lengths)
    n = 4 + bits.read(4)
    code = _lengths_code(bits.read(3 * n), n)
    left, words = alphabet, code.single is None
    if bits.read(1):
        left, words = min(alphabet, 2 + bits.read(2 + 2 * bits.read(3))), False
    lengths = np.zeros(alphabet, dtype=np.int64)
    table, mask, data, at, end = code.table, (1 << code.longest) - 1, bits.data, bits.at, bits.end
    found: list[int] = []
    before = 8
    while len(found) < alphabet and left > 0:
        w = int.from_bytes(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)
        if words:  # some lengths at a time, but for the last ones
            several, size, last = _word(code, w & 0xFFFF)
            if several and len(found) + len(several) <= alphabet:
                found += several
                at += size
                before = last or before
                continue
        left -= 1
        step = table[w & mask]
        n, size = step >> 5, step & 31
        if code.single is not None:
            size = 0
        at += size
        if n < 16:
            found.append(n)
            before = n or before
            continue
        value, least, extra = ((before, 3, 2), (0, 3, 3), (0, 11, 7))[n - 16]
        found += [value] * (least + (w >> size & ((1 << extra) - 1)))
        at += extra
    if at > end:
        raise ValueError("the stream ends early")
    if len(found) > alphabet:
        raise ValueError("code lengths run over")
    bits.at = at
    lengths[: len(found)] = found
    return PrefixCode(lengths)


def _read_codes(bits: Bits, alphabets: tuple[int, ...]) -> list[PrefixCode]:
    """The codes of one group. A description that repeats the bits of the one before it is not parsed again."""
    out: list[PrefixCode] = []
    size = value = 0
    for k, alphabet in enumerate(alphabets):
        start = bits.at
        if k and alphabet == alphabets[k - 1] and start + size <= bits.end and bits.span(start, size) == value:
            out.append(out[-1])
            bits.at += size
            continue
        out.append(_read_code(bits, alphabet))
        size = bits.at - start
        value = bits.span(start, size)
    return out


def _number(bits: Bits, prefix: int) -> int:
    """The length or distance of a prefix symbol with its extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _cells(n: int, block_bits: int) -> int:
    return (n + (1 << block_bits) - 1) >> block_bits


class Coded:
    """What comes before an image's pixels: the colour cache's bits, the meta codes' image, and the groups of prefix codes."""

    def __init__(self, bits: Bits, width: int, height: int, top: bool):
        self.cache_bits = bits.read(4) if bits.read(1) else 0
        if self.cache_bits > 11:
            raise ValueError("colour cache too large")
        self.meta, groups, self.meta_bits = None, 1, 0
        if top and bits.read(1):
            self.meta_bits = bits.read(3) + 2
            self.meta = (_image(bits, _cells(width, self.meta_bits), _cells(height, self.meta_bits), False) >> 8) & 0xFFFF
            groups = int(self.meta.max()) + 1
        cache_size = 1 << self.cache_bits if self.cache_bits else 0
        self.codes = [_read_codes(bits, (256 + 24 + cache_size, 256, 256, 256, 40)) for _ in range(groups)]
        # one group, whose literals fit into one 64-bit window of the stream
        self.plain = groups == 1 and sum(c.longest for c in self.codes[0][:4]) <= 56


def _image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """Entropy-coded pixels as unsigned ARGB numbers."""
    return _pixels_of(bits, Coded(bits, width, height, top), width, height)


def _pixels_of(bits: Bits, coded: Coded, width: int, height: int) -> np.ndarray:
    cache_bits, meta, meta_bits, codes = coded.cache_bits, coded.meta, coded.meta_bits, coded.codes
    cache_size = 1 << cache_bits if cache_bits else 0
    total = width * height
    if coded.plain:
        return _one_group(bits, codes[0], width, total, cache_bits)
    out = [0] * total
    cache = [0] * cache_size
    at, seen, shift = 0, 0, 32 - cache_bits

    def remember(upto: int) -> int:
        if cache_size:
            for k in range(seen, upto):
                cache[((0x1E35A7BD * out[k]) & 0xFFFFFFFF) >> shift] = out[k]
        return upto

    while at < total:
        group = codes[int(meta[(at // width >> meta_bits) * _cells(width, meta_bits) + (at % width >> meta_bits)])] if meta is not None else codes[0]
        s = group[0].read(bits)
        if s < 256:
            red, blue = group[1].read(bits), group[2].read(bits)
            out[at] = (group[3].read(bits) << 24) | (red << 16) | (s << 8) | blue
            at += 1
        elif s < 280:
            length = _number(bits, s - 256)
            d = _number(bits, group[4].read(bits))
            if d > 120:
                d -= 120
            else:
                dx, dy = DISTANCE_MAP[d - 1]
                d = max(1, dx + dy * width)
            if d > at or at + length > total:
                raise ValueError("back-reference out of the image")
            for _ in range(length):
                out[at] = out[at - d]
                at += 1
        else:
            seen = remember(at)
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, dtype=np.uint32)


def _one_group(bits: Bits, codes: list[PrefixCode], width: int, total: int, cache_bits: int) -> np.ndarray:
    """The pixels of an image with one group of codes. Each literal is read from one 64-bit window of the stream."""
    raw = np.zeros(len(bits.data) + 16, dtype=np.uint8)
    raw[: len(bits.data)] = np.frombuffer(bits.data, dtype=np.uint8)
    base = bits.at >> 3
    most = min(len(bits.data) - base + 8, ((sum(c.longest for c in codes) + 28) * total >> 3) + 8)  # bytes that the image can take
    window = np.ndarray((most,), "<u8", buffer=raw, offset=base, strides=(1,)).tolist()
    green, red, blue, alpha = (c.table for c in codes[:4])
    m_green, m_red, m_blue, m_alpha = ((1 << c.longest) - 1 for c in codes[:4])
    pos, end = bits.at - 8 * base, bits.end - 8 * base
    out: list[int] = []
    add = out.append
    cache, shift, seen = [0] * (1 << cache_bits), 32 - cache_bits, 0
    while len(out) < total:
        if pos > end:
            raise ValueError("the stream ends early")
        w = window[pos >> 3] >> (pos & 7)
        g = green[w & m_green]
        n = g & 31
        if g < 8192:  # a literal
            w >>= n
            r = red[w & m_red]
            k = r & 31
            w >>= k
            b = blue[w & m_blue]
            j = b & 31
            a = alpha[(w >> j) & m_alpha]
            pos += n + k + j + (a & 31)
            add((a >> 5) << 24 | (r >> 5) << 16 | (g >> 5) << 8 | b >> 5)
        elif g < 8960:
            at, bits.at = len(out), pos + n + 8 * base
            length = _number(bits, (g >> 5) - 256)
            d = _number(bits, codes[4].read(bits))
            pos = bits.at - 8 * base
            if d > 120:
                d -= 120
            else:
                dx, dy = DISTANCE_MAP[d - 1]
                d = max(1, dx + dy * width)
            if d > at or at + length > total:
                raise ValueError("back-reference out of the image")
            run = out[at - d : at - d + min(d, length)]
            out += (run * (length // len(run) + 1))[:length]
        else:
            for x in out[seen:]:
                cache[((0x1E35A7BD * x) & 0xFFFFFFFF) >> shift] = x
            seen = len(out)
            add(cache[(g >> 5) - 280])
            pos += n
    if pos > end:
        raise ValueError("the stream ends early")
    bits.at = pos + 8 * base
    return np.array(out, dtype=np.uint32)


# ---------------------------------------------------------------- many images side by side

LANES = 1024
_NEAR = np.array(DISTANCE_MAP)
_LOW = np.uint64(0xFFFFFFFF)


class Stream:
    """A lossless stream read up to its pixels: bits, coded, steps (transforms), width and height of the coded image."""

    def __init__(self, data: bytes):
        self.bits = bits = Bits(data)
        if bits.read(8) != 0x2F:
            raise ValueError("wrong signature")
        width, self.height = bits.read(14) + 1, bits.read(14) + 1
        self.has_alpha = bits.read(1)
        if bits.read(3):
            raise ValueError("unknown version")
        self.steps: list[tuple] = []
        self.full = width
        while bits.read(1):
            kind = bits.read(2)
            if kind in {s[0] for s in self.steps}:
                raise ValueError("a transform occurs twice")
            if kind in (PREDICTOR, CROSS_COLOUR):
                block = bits.read(3) + 2
                across = _cells(width, block)
                self.steps.append((kind, width, _channels(_image(bits, across, _cells(self.height, block), False), across), block))
            elif kind == SUBTRACT_GREEN:
                self.steps.append((kind, width))
            else:
                size = bits.read(8) + 1
                palette = np.cumsum(_channels(_image(bits, size, 1, False), size)[0].astype(np.int64), axis=0) & 255
                pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
                self.steps.append((kind, width, palette.astype(np.uint8), pack))
                width = _cells(width, pack)
        self.width = width
        self.coded = Coded(bits, width, self.height, True)
        self.total = width * self.height

    def pixels(self) -> np.ndarray:
        return _pixels_of(self.bits, self.coded, self.width, self.height)

    def finished(self, px: np.ndarray) -> np.ndarray:
        """The image of the coded pixels, after the inverse transforms: uint8 (height, width, ARGB)."""
        img = _channels(px, self.width)
        for kind, w, *x in reversed(self.steps):
            if kind == PREDICTOR:
                img = _unpredict(img, x[0][..., 2] & 15, x[1])
            elif kind == CROSS_COLOUR:
                img = _uncross(img, *x)
            elif kind == SUBTRACT_GREEN:
                img = img.copy()
                img[..., 1] += img[..., 2]
                img[..., 3] += img[..., 2]
            else:
                img = _unindex(img, x[0], w, x[1])
        assert img.shape == (self.height, self.full, 4)
        if not self.has_alpha:
            img[..., 0] = 255
        return img


def _extra(w: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances of prefix symbols whose extra bits begin a window, and how many bits these are."""
    extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + (w & ((1 << extra) - 1)) + 1), extra


def side_by_side(streams: list[Stream], lanes: int = LANES) -> list[np.ndarray]:
    """The coded pixels of plain streams, each step one pixel of up to `lanes` of them."""
    n = len(streams)
    order = sorted(range(n), key=lambda i: -streams[i].total)
    raw = np.frombuffer(b"".join(s.bits.data + bytes(16) for s in streams) + bytes(16), dtype=np.uint8)
    eight = np.ndarray((len(raw) - 8,), "<i8", buffer=raw, strides=(1,))  # a sign fills bits that no literal or number reaches
    begin = np.cumsum([0] + [len(s.bits.data) + 16 for s in streams])[:-1]
    base = np.cumsum([0] + [s.total for s in streams])
    out = np.zeros(int(base[-1]), dtype=np.int64)
    # per image: position and end in bits, place and end of its pixels, and where its tables and cache lie
    known: dict[int, int] = {}
    table = np.zeros(sum(1 << c.longest for c in {id(c): c for s in streams for c in s.coded.codes[0]}.values()), dtype=np.int32)
    filled = 0
    place, mask = np.zeros((5, n), dtype=np.int64), np.zeros((5, n), dtype=np.int64)
    for i, s in enumerate(streams):
        for k, c in enumerate(s.coded.codes[0]):
            at = known.get(id(c))
            if at is None:
                at = known[id(c)] = filled
                filled += 1 << c.longest
                table[at:filled] = c.entries()
            place[k, i], mask[k, i] = at, (1 << c.longest) - 1
    bits = np.array([s.coded.cache_bits for s in streams])
    room = np.cumsum([0] + [1 << b for b in bits.tolist()])
    cache = np.zeros(int(room[-1]) + 1, dtype=np.int64)
    shift = 32 - bits
    position = begin * 8 + np.array([s.bits.at for s in streams])
    end = begin * 8 + np.array([s.bits.end for s in streams])
    widths = np.array([s.width for s in streams])

    who = np.array(order[:lanes])
    waiting = order[lanes:][::-1]
    left, away = np.zeros(len(who), dtype=np.int64), np.zeros(len(who), dtype=np.int64)
    at, pos, stop = base[who].copy(), position[who].copy(), base[who + 1]
    some_copy, some_cache = False, bool(bits.any())
    top = len(eight) - 1
    g0, g1, g2, g3, g4 = place[:, who]
    m0, m1, m2, m3, m4 = mask[:, who]
    c0, sh = room[who], shift[who]
    until = int((stop - at).min()) if len(who) else 0
    while len(who):
        for _ in range(until):
            w = eight[np.minimum(pos >> 3, top)] >> (pos & 7)
            g = table.take(g0 + (w & m0))
            w1 = w >> (g & 31)
            r = table.take(g1 + (w1 & m1))
            w2 = w1 >> (r & 31)
            b = table.take(g2 + (w2 & m2))
            a = table.take(g3 + ((w2 >> (b & 31)) & m3))
            px = (a >> 5).astype(np.int64) << 24 | (r >> 5 << 16 | g >> 5 << 8 | b >> 5)
            step = (g & 31) + (r & 31) + (b & 31) + (a & 31)
            if some_copy or int(g.max()) >= 256 << 5:
                odd = np.flatnonzero((g >= 256 << 5) | (left > 0))
                going = left[odd] > 0
                symbol, n0 = g[odd] >> 5, g[odd] & 31
                step[odd] = np.where(going, 0, n0)
                hit = ~going & (symbol >= 280)
                px[odd[hit]] = cache[c0[odd[hit]] + symbol[hit] - 280]
                fresh = ~going & (symbol < 280)
                new = odd[fresh]
                if len(new):
                    length, used = _extra(w1[new], (symbol[fresh] - 256).astype(np.int64))
                    used += n0[fresh]
                    there = pos[new] + used
                    v = eight[np.minimum(there >> 3, top)] >> (there & 7)
                    d = table[g4[new] + (v & m4[new])]
                    v >>= d & 31
                    far, more = _extra(v, (d >> 5).astype(np.int64))
                    step[new] = used + (d & 31) + more
                    near = _NEAR[np.minimum(far, 120) - 1]
                    far = np.where(far > 120, far - 120, np.maximum(1, near[:, 0] + near[:, 1] * widths[who[new]]))
                    if (far > at[new] - base[who[new]]).any() or (at[new] + length > stop[new]).any():
                        raise ValueError("back-reference out of the image")
                    left[new], away[new] = length, far
                copied = odd[left[odd] > 0]
                px[copied] = out[at[copied] - away[copied]]
                left[copied] -= 1
                some_copy = bool(left.any())
            out[at] = px
            if some_cache:
                cache[c0 + ((px * 0x1E35A7BD & 0xFFFFFFFF) >> sh)] = px
            pos += step
            at += 1
        ended = np.flatnonzero(at == stop)
        if (pos[ended] > end[who[ended]]).any():
            raise ValueError("the stream ends early")
        fresh = [waiting.pop() for _ in range(min(len(ended), len(waiting)))]
        keep = np.ones(len(who), dtype=bool)
        if fresh:
            lane = ended[: len(fresh)]
            who[lane] = fresh
            at[lane], pos[lane] = base[fresh], position[fresh]
        keep[ended[len(fresh) :]] = False
        who, at, pos, left, away = (x[keep] for x in (who, at, pos, left, away))
        stop, c0, sh = base[who + 1], room[who], shift[who]
        g0, g1, g2, g3, g4 = place[:, who]
        m0, m1, m2, m3, m4 = mask[:, who]
        until = int((stop - at).min()) if len(who) else 0
    return [out[base[i] : base[i + 1]].astype(np.uint32) for i in range(n)]


def decode_many(files: list[bytes], lanes: int = LANES) -> list[np.ndarray]:
    """Pixels of lossless WebP files, as decode() gives them."""
    streams = [Stream(_lossless(f)) for f in files]
    found: list[np.ndarray | None] = [None] * len(files)
    mean = sum(s.total for s in streams) / lanes
    plain = [i for i, s in enumerate(streams) if s.coded.plain and s.total <= 2 * mean]
    if len(plain) >= lanes // 8:  # a step costs about as much as a few pixels that are read alone
        for i, px in zip(plain, side_by_side([streams[i] for i in plain], lanes), strict=True):
            found[i] = px
    return [s.finished(s.pixels() if px is None else px) for s, px in zip(streams, found, strict=True)]


# ---------------------------------------------------------------- inverse transforms, on uint8 (height, width, ARGB)


def _channels(px: np.ndarray, width: int) -> np.ndarray:
    return px.astype(">u4").view(np.uint8).reshape(-1, width, 4).copy()


def _average(a: int, b: int) -> int:
    """Channel by channel: (a + b) // 2 of two ARGB numbers."""
    return (a & b) + (((a ^ b) & 0xFEFEFEFE) >> 1)


def _select(left: int, top: int, corner: int) -> int:
    """The neighbour nearer to left + top - corner: left is as far from it as top from corner, and the other way round."""
    to_left = to_top = 0
    for k in (0, 8, 16, 24):
        x, y, c = (left >> k) & 255, (top >> k) & 255, (corner >> k) & 255
        to_left += abs(y - c)
        to_top += abs(x - c)
    return left if to_left < to_top else top


def _full(left: int, top: int, corner: int) -> int:
    out = 0
    for k in (0, 8, 16, 24):
        v = ((left >> k) & 255) + ((top >> k) & 255) - ((corner >> k) & 255)
        out |= (0 if v < 0 else 255 if v > 255 else v) << k
    return out


def _half(mean: int, corner: int) -> int:
    out = 0
    for k in (0, 8, 16, 24):
        v = (mean >> k) & 255
        d = v - ((corner >> k) & 255)
        v += d >> 1 if d >= 0 else -(-d >> 1)
        out |= (0 if v < 0 else 255 if v > 255 else v) << k
    return out


#: Each mode's prediction from the left, top, top-left and top-right pixels as ARGB numbers.
_PREDICT = (
    lambda left, top, corner, right: 0xFF000000,
    lambda left, top, corner, right: left,
    lambda left, top, corner, right: top,
    lambda left, top, corner, right: right,
    lambda left, top, corner, right: corner,
    lambda left, top, corner, right: _average(_average(left, right), top),
    lambda left, top, corner, right: _average(left, corner),
    lambda left, top, corner, right: _average(left, top),
    lambda left, top, corner, right: _average(corner, top),
    lambda left, top, corner, right: _average(top, right),
    lambda left, top, corner, right: _average(_average(left, corner), _average(top, right)),
    lambda left, top, corner, right: _select(left, top, corner),
    lambda left, top, corner, right: _full(left, top, corner),
    lambda left, top, corner, right: _half(_average(left, top), corner),
    lambda left, top, corner, right: 0xFF000000,
    lambda left, top, corner, right: 0xFF000000,
)


def _unpredict(img: np.ndarray, modes: np.ndarray, block_bits: int) -> np.ndarray:
    """Pixels as ARGB numbers; the sum of two works on two channels at a time."""
    h, w, _ = img.shape
    rest = _packed(img).reshape(-1).tolist()
    out = [0] * (h * w)
    even, odd = 0x00FF00FF, 0xFF00FF00
    last = 0xFF000000
    for x in range(w):
        v = rest[x]
        out[x] = last = ((v & even) + (last & even)) & even | ((v & odd) + (last & odd)) & odd
    for y in range(1, h):
        at, row = y * w, modes[y >> block_bits].tolist()
        v, p = rest[at], out[at - w]
        out[at] = last = ((v & even) + (p & even)) & even | ((v & odd) + (p & odd)) & odd
        for b in range(len(row)):
            predict = _PREDICT[row[b] & 15]
            for i in range(at + max(1, b << block_bits), at + min(w, (b + 1) << block_bits)):
                v, p = rest[i], predict(last, out[i - w], out[i - w - 1], out[i - w + 1])
                out[i] = last = ((v & even) + (p & even)) & even | ((v & odd) + (p & odd)) & odd
    return np.array(out, dtype=np.uint32).astype(">u4").view(np.uint8).reshape(h, w, 4)


def _packed(img: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(img).view(">u4").reshape(img.shape[:2]).astype(np.uint32)


def _uncross(img: np.ndarray, data: np.ndarray, block_bits: int) -> np.ndarray:
    h, w, _ = img.shape
    m = data[np.arange(h)[:, None] >> block_bits, np.arange(w)[None, :] >> block_bits].view(np.int8).astype(np.int64)
    red_to_blue, green_to_blue, green_to_red = m[..., 1], m[..., 2], m[..., 3]
    out = img.copy()
    green = img[..., 2].view(np.int8).astype(np.int64)
    red = (img[..., 1].astype(np.int64) + ((green_to_red * green) >> 5)) & 255
    signed = red.astype(np.uint8).view(np.int8).astype(np.int64)
    out[..., 1] = red
    out[..., 3] = (img[..., 3].astype(np.int64) + ((green_to_blue * green) >> 5) + ((red_to_blue * signed) >> 5)) & 255
    return out


def _unindex(img: np.ndarray, palette: np.ndarray, width: int, width_bits: int) -> np.ndarray:
    index = img[..., 2]
    if width_bits:
        per, n = 1 << width_bits, 8 >> width_bits
        index = ((index[..., None] >> (np.arange(per) * n)) & ((1 << n) - 1)).reshape(len(index), -1)[:, :width]
    table = np.zeros((256, 4), dtype=np.uint8)
    table[: len(palette)] = palette
    return table[index]


def _lossless(media: bytes) -> bytes:
    """The lossless stream in a WebP file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, end = 12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0])
    while at + 8 <= end:
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"VP8L":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def decode(media: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file: uint8 (height, width, 4) in the order A, R, G, B."""
    return _decode_stream(_lossless(media))


def _decode_stream(data: bytes) -> np.ndarray:
    stream = Stream(data)
    return stream.finished(stream.pixels())


# ---------------------------------------------------------------- encoder: many images at a time


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(length)
    return np.arange(int(length.sum())) + np.repeat(start - ends + length, length)


class Fields:
    """Bit fields of up to 60 bits of n streams, low bits first; each stream's in the order in which they are put."""

    def __init__(self, n: int):
        self.n = n
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def put(self, who: np.ndarray, value: np.ndarray | int, size: np.ndarray | int) -> None:
        """One field for each of the streams named in `who`, which may name a stream more than once."""
        self.parts.append((who, np.broadcast_to(np.asarray(value).astype(np.uint64), who.shape), np.broadcast_to(np.asarray(size, dtype=np.int64), who.shape)))

    def in_order(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        who, value, size = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        by = np.argsort(who.astype(np.uint16) if self.n < 1 << 16 else who, kind="stable")
        return who[by], value[by], size[by]

    def streams(self) -> list[bytes]:
        who, value, size = self.in_order()
        total = np.bincount(who, weights=size, minlength=self.n).astype(np.int64)
        words = (total + 63) >> 6
        base = np.cumsum(words) - words
        start = np.cumsum(size) - size + (64 * base - np.cumsum(total) + total)[who]
        word, shift = start >> 6, (start & 63).astype(np.uint64)
        edges = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out = np.zeros(int(words.sum()) + 1, dtype="<u8")
        out[word[edges]] = np.bitwise_or.reduceat(value << shift, edges)
        over = np.flatnonzero((start & 63) + size > 64)  # the last field of a word may go on in the next
        out[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
        raw = out.tobytes()
        return [raw[8 * b : 8 * b + (n + 7) // 8] for b, n in zip(base.tolist(), total.tolist(), strict=True)]


def code_lengths(counts: list[int], limit: int) -> list[int]:
    """Lengths of a complete prefix code for symbols of these (positive) counts, at most `limit`; two symbols or more."""
    n, least = len(counts), 1
    order = sorted(range(n), key=counts.__getitem__)
    far = 1 << 60
    while True:
        weight = [counts[i] if counts[i] > least else least for i in order] + [far] * n
        parent = [0] * (2 * n - 1)
        leaf, node, new = 0, n, n  # the two queues of the merge: single symbols, and pairs already made
        one, pair = weight[0], far
        while new < 2 * n - 1:
            total = 0
            for _ in (0, 1):
                if leaf < n and one <= pair:
                    total += one
                    parent[leaf] = new
                    leaf += 1
                    one = weight[leaf] if leaf < n else far
                else:
                    total += pair
                    parent[node] = new
                    node += 1
                    pair = weight[node]
            weight[new] = total
            if node == new:
                pair = total
            new += 1
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if depth[0] <= limit and max(depth[:n]) <= limit:
            out = [0] * n
            for i, d in zip(order, depth, strict=False):
                out[i] = d
            return out
        least = 2 * least + 1  # raise the rarest counts until the tree is flat enough


#: The code for code lengths: 4 bits for the kinds that are common, 5 for six rare ones.
_LENGTHS_SIZE = np.array([5 if k in (1, 2, 13, 14, 15, 16) else 4 for k in range(19)])


def canonical(row: np.ndarray, symbol: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The codes, low bit first, of complete codes' symbols (ordered by row and symbol) with lengths up to 15."""
    by = np.argsort(row * 16 + lengths, kind="stable")
    room = 1 << (15 - lengths[by])  # those of a row fill 1 << 15
    code = np.empty(len(by), dtype=np.uint64)
    code[by] = REVERSED[15][(np.cumsum(room) - room) & 32767]
    return code


_LENGTHS_CODE = canonical(np.zeros(19, np.int64), np.arange(19), _LENGTHS_SIZE)
_LENGTHS_HEAD = sum(int(_LENGTHS_SIZE[k]) << 3 * i for i, k in enumerate(CODE_ORDER))


class Codes:
    """Prefix codes for the rows of counts, whose first `alphabet` symbols may occur: 16 * code + length by row and symbol, and descriptions."""

    def __init__(self, counts: np.ndarray, alphabet: np.ndarray):
        n, self.across = counts.shape
        row, symbol = np.nonzero(counts)
        many = np.bincount(row, minlength=n)
        first = np.cumsum(many) - many
        last = np.zeros(n, dtype=np.int64)
        last[many > 0] = symbol[(first + many - 1)[many > 0]]
        size = np.zeros((n, self.across), dtype=np.int64)
        code = np.zeros((n, self.across), dtype=np.uint64)
        fields = Fields(n)
        one, two = (many < 2) & (last < 256), (many == 2) & (last < 256)
        rich = ~one & ~two
        s = last[one]
        fields.put(np.flatnonzero(one), np.where(s > 1, 5, 1) | s << 3, np.where(s > 1, 11, 4))
        k = np.flatnonzero(two)
        fields.put(k, 7 | symbol[first[k]] << 3 | last[k] << 11, 19)
        code[k, last[k]] = 1
        size[k, last[k]] = size[k, symbol[first[k]]] = 1
        k = np.flatnonzero(rich)
        here = rich[row]
        row, symbol = row[here], symbol[here]
        some, lengths, at = counts[row, symbol].tolist(), [], 0
        for m in many[k].tolist():
            lengths += code_lengths(some[at : at + m], 15)
            at += m
        size[row, symbol] = lengths
        code[row, symbol] = canonical(row, symbol, np.array(lengths, dtype=np.int64))
        # lengths are written with one fixed code, which the reader keeps
        fields.put(k, (19 - 4) << 1, 5)
        fields.put(k, _LENGTHS_HEAD, 3 * 19)
        fields.put(k, 0, 1)
        self._put_lengths(fields, size.reshape(-1)[_ranges(k * self.across, alphabet[k])], np.repeat(k, alphabet[k]))
        self.pairs = (code << np.uint64(4) | size.astype(np.uint64)).reshape(-1)
        who, self.value, self.size = fields.in_order()
        self.many = np.bincount(who, minlength=n)
        self.first = np.cumsum(self.many) - self.many

    @staticmethod
    def _put_lengths(fields: Fields, size: np.ndarray, row: np.ndarray) -> None:
        """Lengths as runs: 16 repeats a length, 17 and 18 skip symbols without a code."""
        edges = np.flatnonzero(np.append(True, (size[1:] != size[:-1]) | (row[1:] != row[:-1]))[: len(size)])
        value, run = size[edges], np.diff(np.append(edges, len(size)))
        none = value == 0
        left = run - ~none  # a length is written once before it is repeated
        most = np.where(none, 138, 6)
        full, tail = left // most, left % most
        part = tail >= 3
        few = none & (tail < 11)
        # of each run in order: the length itself, full repeats, a repeat of the rest, single lengths
        times = np.stack([~none, full, part, np.where(part, 0, tail)], axis=1)
        nothing = np.zeros_like(value)
        columns = (
            (value, np.where(none, 18, 16), np.where(few, 17, np.where(none, 18, 16)), value),
            (nothing, np.where(none, 127, 3), tail - np.where(none & ~few, 11, 3), nothing),
            (nothing, np.where(none, 7, 2), np.where(few, 3, np.where(none, 7, 2)), nothing),
        )
        steps, extra, wide = (np.repeat(np.stack(c, axis=1).reshape(-1), times.reshape(-1)) for c in columns)
        n = _LENGTHS_SIZE[steps]
        fields.put(np.repeat(row[edges], times.sum(axis=1)), _LENGTHS_CODE[steps] | extra.astype(np.uint64) << n.astype(np.uint64), n + wide)

    def describe(self, out: Fields, who: np.ndarray, rows: np.ndarray) -> None:
        """Write the description of one row to each stream."""
        at = _ranges(self.first[rows], self.many[rows])
        out.put(np.repeat(who, self.many[rows]), self.value[at], self.size[at])

    def of(self, rows: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols' codes in these rows, and their lengths."""
        pairs = self.pairs[rows * self.across + symbols]
        return pairs >> np.uint64(4), (pairs & np.uint64(15)).astype(np.int64)


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, number of extra bits and their value, of lengths or distance codes from 1 on."""
    v = v.astype(np.int64) - 1
    high = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    extra = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + ((v >> np.maximum(high - 1, 0)) & 1)), extra, v & ((1 << extra) - 1)


@lru_cache(maxsize=64)
def _near_codes(width: int) -> dict[int, int]:
    """Short distance code of each distance that has one."""
    out: dict[int, int] = {}
    for k, (dx, dy) in enumerate(DISTANCE_MAP):
        out.setdefault(max(1, dx + dy * width), k + 1)
    return out


def copies(px: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Back-references (at, length, distance) in order and apart: runs equal to those at the image's latest place with the same three pixels."""
    nothing = (np.zeros(0, dtype=np.int64),) * 3
    if len(px) < 6:
        return nothing
    key = (px[:-2].astype(np.uint64) | px[1:-1].astype(np.uint64) << np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) ^ px[2:].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    order = np.argsort(key, kind="stable")
    order = order[owner[order] == owner[order + 2]]
    twin = (key[order[1:]] == key[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    here, there = order[1:][twin], order[:-1][twin]
    enough = (24 * np.bincount(owner[here], minlength=len(sizes)) >= sizes) & (sizes >= 6)  # each makes three equal pixels at most
    same = enough[owner[here]] & (px[here] == px[there]) & (px[here + 1] == px[there + 1]) & (px[here + 2] == px[there + 2]) & (here - there <= (1 << 20) - 120)
    if not same.any():
        return nothing
    away = np.zeros(len(px) - 2, dtype=np.int64)  # 0 in the last two places of an image, so no run leaves it
    away[here[same]] = (here - there)[same]
    edges = np.flatnonzero(np.append(True, away[1:] != away[:-1]))
    size = np.diff(np.append(edges, len(away)))
    out, free = [], 0
    found = away[edges] > 0
    for at, length, d in zip(edges[found].tolist(), (size[found] + 2).tolist(), away[edges[found]].tolist(), strict=True):
        end = at + length
        at = max(at, free)
        while end - at >= 3:
            now = min(end - at, 4096)
            out.append((at, now, d))
            at += now
            free = at
    return tuple(np.array(out, dtype=np.int64).T)


def _put_images(out: Fields, who: np.ndarray, px: np.ndarray, sizes: np.ndarray, widths: np.ndarray | None = None) -> None:
    """Entropy-coded pixels of images that follow each other in px, to the streams `who`; with widths top images, which have a colour cache and back-references."""
    m, n, top = len(sizes), len(px), widths is not None
    owner = np.repeat(np.arange(m), sizes)
    single, cached, cache = np.ones(n, dtype=bool), np.zeros(n, dtype=bool), np.zeros(m, dtype=bool)
    start = hits = slot = np.zeros(0, dtype=np.int64)
    if top:
        start, length, away = copies(px, owner, sizes)
        keep = (8 * np.bincount(owner[start], weights=length, minlength=m) >= sizes)[owner[start]]  # too few do not pay for a distance code
        start, length, away = start[keep], length[keep], away[keep]
        single[_ranges(start, length)] = False
        slot = ((px * np.uint32(0x1E35A7BD)) >> np.uint32(32 - CACHE_BITS)).astype(np.int64)
        key = owner << CACHE_BITS | slot
        by = np.argsort(key.astype(np.uint16) if m << CACHE_BITS <= 1 << 16 else key, kind="stable")
        again = (key[by[1:]] == key[by[:-1]]) & (px[by[1:]] == px[by[:-1]])
        hits = by[1:][again]
        hits = hits[single[hits]]
        cache = (sizes > 64) & (8 * np.bincount(owner[hits], minlength=m) >= sizes)  # few hits do not pay for a larger green code
        hits = hits[cache[owner[hits]]]
        cached[hits] = True
    out.put(who, np.where(cache, 1 | CACHE_BITS << 1, 0), np.where(cache, 5, 1))
    if top:
        out.put(who, 0, 1)  # one group of codes
    plain = np.flatnonzero(single & ~cached)
    whose = owner[plain]
    channels = [((px[plain] >> np.uint32(k)) & np.uint32(255)).astype(np.int64) for k in (8, 16, 0, 24)]
    across = 280 + (1 << CACHE_BITS)
    counts = np.zeros((6, m, across), dtype=np.int64)  # green, red and blue and alpha together, each of them, distances

    def count(kind: int, images: np.ndarray, symbols: np.ndarray) -> None:
        counts[kind] += np.bincount(images * across + symbols, minlength=m * across).reshape(m, across)

    for kind, x in zip((0, 2, 3, 4), channels, strict=True):
        count(kind, whose, x)
    if len(hits):
        hits = np.sort(hits)
        count(0, owner[hits], 280 + slot[hits])
    if len(start):
        long = _prefix(length)
        near = [_near_codes(w).get(d, d + 120) for w, d in zip(widths[owner[start]].tolist(), away.tolist(), strict=True)]
        dist = _prefix(np.array(near))
        count(0, owner[start], 256 + long[0])
        count(5, owner[start], dist[0])
    # channels of more than two values share a code for all their counts, which is made once
    rich = np.count_nonzero(counts[2:5], axis=2) > 2
    rich &= rich.sum(axis=0) > 1
    counts[1] = (counts[2:5] * rich[..., None]).sum(axis=0)
    each = np.arange(m)
    rows = np.stack([each, *(np.where(r, m + each, (k + 2) * m + each) for k, r in enumerate(rich)), 5 * m + each])
    used, rows = np.unique(rows, return_inverse=True)
    rows = rows.reshape(5, m)
    alphabet = np.array([280, 256, 256, 256, 256, 40])[used // m]
    alphabet[(used < m) & cache[used % m]] = across
    codes = Codes(counts.reshape(-1, across)[used], alphabet)
    for k in range(5):
        codes.describe(out, who, rows[k])
    value, size = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int64)

    def join(at: np.ndarray, fields: list[tuple[np.ndarray, np.ndarray]]) -> None:
        v, bits = fields[0]
        for more, wide in fields[1:]:
            v = v | more << bits.astype(np.uint64)
            bits = bits + wide
        value[at], size[at] = v, bits

    join(plain, [codes.of(r[whose], x) for r, x in zip(rows, channels, strict=False)])
    if len(hits):
        join(hits, [codes.of(rows[0][owner[hits]], 280 + slot[hits])])
    if len(start):
        i = owner[start]
        join(start, [codes.of(rows[0][i], 256 + long[0]), (long[2].astype(np.uint64), long[1]), codes.of(rows[4][i], dist[0]), (dist[2].astype(np.uint64), dist[1])])
        single[start] = True
        value, size, owner = value[single], size[single], owner[single]
    out.put(who[owner], value, size)


def _predictions(img: np.ndarray, mode: int) -> np.ndarray:
    """Prediction of every pixel below the first row and right of the first column, from its true neighbours."""
    x = img.astype(np.int32)
    left, top, corner = x[1:, :-1], x[:-1, 1:], x[:-1, :-1]
    right = np.concatenate([x[:-1, 2:], x[1:, :1]], axis=1)  # the last pixel of a row has the first of its own row there
    if mode == 2:
        return top
    if mode == 7:
        return (left + top) >> 1
    if mode == 9:
        return (top + right) >> 1
    return (((left + corner) >> 1) + ((top + right) >> 1)) >> 1


def _by_block(x: np.ndarray, block_bits: int) -> np.ndarray:
    """Sums over square blocks of a (height, width) array."""
    h, w = x.shape
    return np.add.reduceat(np.add.reduceat(x, np.arange(0, h, 1 << block_bits), axis=0), np.arange(0, w, 1 << block_bits), axis=1)


def _predicted(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each block's best of MODES, and the residuals."""
    h, w, _ = img.shape
    rest = np.empty((len(MODES), h, w, 4), dtype=np.uint8)
    for k, mode in enumerate(MODES):
        rest[k, 1:, 1:] = img[1:, 1:] - _predictions(img, mode).astype(np.uint8)
    rest[:, 0, 0] = img[0, 0] - np.array([255, 0, 0, 0], np.uint8)
    rest[:, 0, 1:] = img[0, 1:] - img[0, :-1]
    rest[:, 1:, 0] = img[1:, 0] - img[:-1, 0]
    cost = np.abs(rest.view(np.int8).astype(np.int16)).sum(axis=3, dtype=np.int32)
    best = np.stack([_by_block(c, BLOCK_BITS) for c in cost]).argmin(axis=0)
    each = best[np.arange(h)[:, None] >> BLOCK_BITS, np.arange(w)[None, :] >> BLOCK_BITS]
    return best, np.take_along_axis(rest, each[None, :, :, None], axis=0)[0]


def _modes_image(best: np.ndarray) -> np.ndarray:
    img = np.zeros((*best.shape, 4), dtype=np.uint8)
    img[..., 0], img[..., 2] = 255, np.array(MODES)[best]
    return img


def _put_blocks(out: Fields, who: np.ndarray, kind: int, images: list[np.ndarray]) -> None:
    """A predictor's or cross-colour's images, one a stream."""
    out.put(who, 1 | kind << 1 | (BLOCK_BITS - 2) << 3, 6)
    _put_images(out, who, np.concatenate([_packed(x).reshape(-1) for x in images]), np.array([x.shape[0] * x.shape[1] for x in images]))


def _crossed(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each block's least-squares multipliers, and what is left of red and blue."""
    h, w, _ = img.shape
    red, green, blue = (img[..., k].view(np.int8).astype(np.int64) for k in (1, 2, 3))
    power = np.maximum(_by_block(green * green, BLOCK_BITS), 1)
    to_red = np.clip(32 * _by_block(red * green, BLOCK_BITS) // power, -128, 127)
    to_blue = np.clip(16 * _by_block(blue * green, BLOCK_BITS) // power, -128, 127)
    from_red = np.clip(16 * _by_block(blue * red, BLOCK_BITS) // np.maximum(_by_block(red * red, BLOCK_BITS), 1), -128, 127)
    data = np.full((*to_red.shape, 4), 255, dtype=np.uint8)
    for k, m in ((1, from_red), (2, to_blue), (3, to_red)):
        data[..., k] = (m & 255).astype(np.uint8)
    at = (np.arange(h)[:, None] >> BLOCK_BITS, np.arange(w)[None, :] >> BLOCK_BITS)
    left = img.copy()
    left[..., 1] -= (((to_red[at] * green) >> 5) & 255).astype(np.uint8)
    left[..., 3] -= ((((to_blue[at] * green) >> 5) + ((from_red[at] * red) >> 5)) & 255).astype(np.uint8)
    return data, left


def _without_green(img: np.ndarray) -> np.ndarray:
    img = img.copy()
    img[..., 1] -= img[..., 2]
    img[..., 3] -= img[..., 2]
    return img


def _bits_of(img: np.ndarray, owner: np.ndarray | None = None, m: int = 1) -> np.ndarray:
    """Bits that the channels of m images would take in codes made for their own counts, and about the codes themselves. owner: each row's image."""
    key = img.astype(np.int64) + (np.arange(4) << 8)
    if owner is not None:
        key += (owner << 10)[:, None, None]
    c = np.bincount(key.reshape(-1), minlength=m << 10).reshape(4 * m, 256)
    total = c.sum(axis=1)
    bits = total * np.log2(np.maximum(total, 1)) - (c * np.log2(np.maximum(c, 1))).sum(axis=1) + 5 * np.count_nonzero(c, axis=1)
    return bits.reshape(m, 4).sum(axis=1)


def _stay_plain(img: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
    """Whether neither differences from the pixel above, nor from the one on the left, nor from the green channel save a bit; by image."""
    bits, rows = _bits_of(img, owner, m), np.bincount(owner, minlength=m)
    inner = owner[1:] == owner[:-1]
    down = _bits_of((img[1:] - img[:-1])[inner], owner[1:][inner], m)
    right = _bits_of(img[:, 1:] - img[:, :-1], owner, m)
    w = img.shape[1]
    return (down * rows >= bits * (rows - 1)) & (right * w >= bits * (w - 1)) & (_bits_of(_without_green(img), owner, m) >= bits)


def cheapest(img: np.ndarray) -> int:
    """The style with the fewest bits: 0 none, 1 predictor, 2 cross-colour and subtract-green, 3 predictor and cross-colour.

    Plain differences from the pixel above, the one on the left and the green channel stand for the transforms first: where none of them
    saves a bit, as in texts, none is worked out.
    """
    return 0 if _stay_plain(img, np.zeros(len(img), dtype=np.int64), 1)[0] else _best_style(img)


def _best_style(img: np.ndarray) -> int:
    best, residual = _predicted(img)
    data, left = _crossed(img)
    costs = [_bits_of(img)[0], _bits_of(residual)[0] + 4 * best.size, _bits_of(_without_green(left))[0] + 16 * data[..., 0].size]
    style = int(np.argmin(costs))
    if costs[1] < costs[0]:
        data, left = _crossed(residual)
        if _bits_of(left)[0] + 4 * best.size + 16 * data[..., 0].size < costs[style]:
            return 3
    return style


def _put_palettes(out: Fields, who: np.ndarray, colours: np.ndarray, many: np.ndarray) -> None:
    """Palettes of `many` colours each, one after another, to the streams `who`."""
    palette = _channels(colours, len(colours))[0]
    step = np.diff(palette, axis=0, prepend=np.zeros((1, 4), np.uint8))
    first = np.cumsum(many) - many
    step[first] = palette[first]
    out.put(who, 1 | INDEXING << 1 | (many - 1) << 3, 11)
    _put_images(out, who, _packed(step[None]).reshape(-1), many)


def _indexes(index: np.ndarray, width: int, many: int) -> tuple[np.ndarray, int]:
    """Pixels of an image's indexes into a palette of `many` colours, packed in green, and their width."""
    index = index.reshape(-1, width)
    pack = 3 if many <= 2 else 2 if many <= 4 else 1 if many <= 16 else 0
    if pack:
        per, bits = 1 << pack, 8 >> pack
        across = _cells(width, pack)
        full = np.zeros((len(index), across * per), dtype=np.int64)
        full[:, :width] = index
        index = (full.reshape(len(index), across, per) << (np.arange(per) * bits)).sum(axis=2)
    return (index.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)).reshape(-1), index.shape[1]


def _encode_batch(payloads: list[np.ndarray], heights: list[int], width: int, style: int | None) -> list[bytes]:
    """Images of one width, worked on as one tall image whose rows have owners."""
    m, rows = len(payloads), np.array(heights)
    img = np.zeros((int(rows.sum()), width, 4), dtype=np.uint8)
    flat, at = img.reshape(-1), 0
    for p, h in zip(payloads, heights, strict=True):
        flat[at : at + len(p)] = p
        at += 4 * width * h
    px, sizes, end = _packed(img).reshape(-1), rows * width, np.cumsum(rows)
    out, each, row_owner = Fields(m), np.arange(m), np.repeat(np.arange(m), rows)
    out.put(each, 0x2F | (width - 1) << 8 | (rows - 1) << 22 | 1 << 36, 40)  # with alpha, version 0
    key = np.repeat(np.arange(m, dtype=np.uint64) << np.uint64(32), sizes) | px
    seen = np.sort(key)
    seen = seen[np.append(True, seen[1:] != seen[:-1])]
    many = np.bincount((seen >> np.uint64(32)).astype(np.int64), minlength=m)
    few = (many <= 256) & (2 * many <= sizes)
    coded, widths = np.split(px, np.cumsum(sizes)[:-1]), np.full(m, width)
    some = np.flatnonzero(few)
    if len(some):
        mine = seen[few[(seen >> np.uint64(32)).astype(np.int64)]]
        _put_palettes(out, some, (mine & _LOW).astype(np.uint32), many[some])
        first = np.cumsum(many[some]) - many[some]
        index = np.searchsorted(mine, key[np.repeat(few, sizes)]) - np.repeat(first, sizes[some])
        for i, x in zip(some.tolist(), np.split(index, np.cumsum(sizes[some])[:-1]), strict=True):
            coded[i], widths[i] = _indexes(x, width, int(many[i]))
    one = {i: img[end[i] - rows[i] : end[i]] for i in np.flatnonzero(~few).tolist()}
    if style is None:
        wide = np.flatnonzero(~few)
        plain = _stay_plain(img[~few[row_owner]], np.repeat(np.arange(len(wide)), rows[wide]), len(wide)) if len(wide) else few
        styles = {i: _best_style(one[i]) for i in wide[~plain].tolist()} if len(wide) else {}
    else:
        styles = dict.fromkeys(one, style)
    for kind, chosen in ((PREDICTOR, [i for i, s in styles.items() if s & 1]), (CROSS_COLOUR, [i for i, s in styles.items() if s & 2])):
        blocks = []
        for i in chosen:
            b, one[i] = _predicted(one[i]) if kind == PREDICTOR else _crossed(one[i])
            blocks.append(_modes_image(b) if kind == PREDICTOR else b)
        if chosen:
            _put_blocks(out, np.array(chosen), kind, blocks)
    for i, s in styles.items():
        if s == 2:
            out.put(np.array([i]), 1 | SUBTRACT_GREEN << 1, 3)
            one[i] = _without_green(one[i])
        coded[i] = _packed(one[i]).reshape(-1)
    out.put(each, 0, 1)
    _put_images(out, each, np.concatenate(coded), np.array([len(x) for x in coded]), widths)
    files = []
    for stream in out.streams():
        chunk = b"VP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
        files.append(b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk)
    return files


BATCH_PIXELS, BATCH_IMAGES = 1 << 17, 512


def encode_many(payloads: list[np.ndarray], style: int | None = None) -> list[bytes]:
    """One image of each payload, whose length is a multiple of PAD. style: 0 to 3, the cheapest() where it is not given.

    A file depends on its payload alone; images that are worked on together have at most BATCH_PIXELS, or there is but one.
    """
    files: list[bytes] = []
    batch, heights, held, across = [], [], 0, WIDTH
    for p in payloads:
        n = len(p) // 4
        width = WIDTH * max(1, -(-n // (WIDTH * MAX_SIDE)))
        if batch and (width != across or held + n > BATCH_PIXELS or len(batch) == BATCH_IMAGES):
            files += _encode_batch(batch, heights, across, style)
            batch, heights, held = [], [], 0
        batch.append(p)
        heights.append(-(-n // width))
        held += n
        across = width
    return files + _encode_batch(batch, heights, across, style) if batch else files


def encode(payload: np.ndarray, style: int | None = None) -> bytes:
    """The image of one payload."""
    return encode_many([payload], style)[0]


MOST_BYTES = 4 * (MAX_SIDE // WIDTH) * WIDTH * MAX_SIDE


def encode_payloads(payloads: list[np.ndarray]) -> list[list[bytes]]:
    """Each payload's files: one of up to MOST_BYTES bytes, and more where it is longer."""
    parts = [[p[k : k + MOST_BYTES] for k in range(0, len(p), MOST_BYTES)] for p in payloads]
    files = iter(encode_many([x for p in parts for x in p]))
    return [[next(files) for _ in p] for p in parts]


def encode_payload(payload: np.ndarray) -> list[bytes]:
    return encode_payloads([payload])[0]


def decode_payload(images: list[np.ndarray], n_bytes: int) -> np.ndarray:
    """The payload of n_bytes text bytes from its images' pixels."""
    return np.concatenate([x.reshape(-1) for x in images])[: padded(n_bytes)]


def padded(n_bytes: int) -> int:
    return max(1, -(-n_bytes // PAD)) * PAD


# ---------------------------------------------------------------- columns


def _padded_texts(texts: pa.Array) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """UTF-8 lengths and payloads, up to about 4 BATCH_PIXELS bytes at a time."""
    sizes: list[int] = []
    payloads: list[np.ndarray] = []
    held = 0
    for t in texts:
        raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
        payload = np.full(padded(len(raw)), 255, dtype=np.uint8)
        payload[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
        if payloads and held + len(payload) > 4 * BATCH_PIXELS:
            yield sizes, payloads
            sizes, payloads, held = [], [], 0
        sizes.append(len(raw))
        payloads.append(payload)
        held += len(payload)
    if payloads:
        yield sizes, payloads


def _store_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for sizes, payloads in _padded_texts(batch.column(1)):
            ids = batch.column(0).slice(at, len(sizes))
            at += len(sizes)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(encode_payloads(payloads), pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "media"])


STORED = "doc_id long, n_bytes long, media array<binary>"


def store_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write doc_id, n_bytes (unpadded) and media (lossless WebP files, nearly always one) of every text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(_store_batches, STORED).write.option("compression", "zstd").parquet(path)


IMAGES = "images array<struct<height:int,width:int,pixels:binary>>"


def _described(x: np.ndarray) -> dict:
    return {"height": x.shape[0], "width": x.shape[1], "pixels": x.tobytes()}


def _parts(batch: pa.RecordBatch, at: int, most_rows: int = 4 * LANES, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of rows and, but for a single row, of bytes in its column of files."""
    sizes = [sum(map(len, f or [])) for f in batch.column(at).to_pylist()]
    k = 0
    while k < len(sizes):
        n, held = 1, sizes[k]
        while k + n < len(sizes) and n < most_rows and held + sizes[k + n] <= most_bytes:
            held += sizes[k + n]
            n += 1
        yield batch.slice(k, n)
        k += n


def decode_images(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, media, and `images`: height, width and pixels (bytes A, R, G, B by row) of each lossless WebP file.

    media_col is one file or an array of files a row; null has no images.
    """
    kind = df.schema[media_col].dataType.typeName()
    files = F.col(media_col) if kind == "array" else F.when(F.col(media_col).isNotNull(), F.array(media_col))
    rows = df.select(*keep, files.alias("media"))
    struct_type = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("pixels", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(keep)
        for batch in batches:
            for part in _parts(batch, at):
                files = [f or [] for f in part.column(at).to_pylist()]
                images = iter(decode_many([x for f in files for x in f]))
                found = [[_described(next(images)) for _ in f] for f in files]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(struct_type))], names=[*part.schema.names, "images"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{types}, {IMAGES}")


def feature(pixels: np.ndarray) -> str:
    """Counts, mean, deviation and a 64-bit mean hash of the levels' 64 block means."""
    n = len(pixels)
    level = pixels.astype(np.float64)
    means = np.add.reduceat(level, np.arange(64) * n // 64) / np.diff(np.append(np.arange(64) * n // 64, n))
    bits = np.packbits(means > means.mean()).tobytes().hex()
    return f"{n}|{level.mean():.4f}|{level.std():.4f}|{bits}"


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            rows = []
            for n, files, images in zip(part.column(1), part.column(2), part.column(3), strict=True):
                px = decode_payload([np.frombuffer(x["pixels"].as_py(), np.uint8) for x in images], n.as_py())
                raw, media = px.tobytes(), b"".join(files.as_py())
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(px)))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )


def media_digests(stored: DataFrame) -> DataFrame:
    """Each text's payload, read from the pixels of its stored files, and the files described."""
    return decode_images(stored, keep=("doc_id", "n_bytes")).mapInArrow(_digest_batches, DIGESTS)
