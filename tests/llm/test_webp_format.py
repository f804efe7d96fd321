"""The lossless WebP decoder against an encoder of its own here, which uses every transform, meta codes, references and the cache."""

import base64
import heapq
import random
import struct

import numpy as np
import pytest

from atlasforge.llm import webp as W


class Out:
    def __init__(self):
        self.v, self.n = 0, 0

    def put(self, value, bits):
        self.v |= value << self.n
        self.n += bits

    def bytes(self):
        return self.v.to_bytes((self.n + 7) // 8, "little")


def lengths_of(freq):
    """Huffman code lengths; 0 for symbols that do not occur."""
    out = [0] * len(freq)
    heap = [(f, i, (i,)) for i, f in enumerate(freq) if f]
    heapq.heapify(heap)
    if len(heap) == 1:
        out[heap[0][1]] = 1
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            out[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return out


def canonical(lengths):
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    code, last, out = 0, 0, {}
    for n, s in used:
        code <<= n - last
        last = n
        out[s] = (int(format(code, f"0{n}b")[::-1], 2), n)
        code += 1
    return out


def put_code(o, freq, repeats):
    lengths = lengths_of(freq)
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and used and max(used) < 256 and not repeats:  # the simple form
        o.put(1, 1)
        o.put(len(used) - 1, 1)
        o.put(1, 1)
        for s in used:
            o.put(s, 8)
        if len(used) == 2:
            lengths = [1 if s in used else 0 for s in range(len(freq))]
        return canonical(lengths)
    o.put(0, 1)
    steps, i = [], 0
    while i < len(lengths):
        run = next((j for j in range(i, len(lengths)) if lengths[j] != lengths[i]), len(lengths)) - i
        if repeats and lengths[i] == 0 and run >= 11:
            run = min(run, 138)
            steps.append((18, run - 11, 7))
        elif repeats and lengths[i] == 0 and run >= 3:
            run = min(run, 10)
            steps.append((17, run - 3, 3))
        elif repeats and i and lengths[i - 1] and lengths[i] == lengths[i - 1] and run >= 3:
            run = min(run, 6)
            steps.append((16, run - 3, 2))
        else:
            run = 1
            steps.append((lengths[i], 0, 0))
        i += run
    kinds = [0] * 19
    for s, _, _ in steps:
        kinds[s] += 1
    klen = lengths_of(kinds)
    while max(klen) > 7:
        kinds = [k and k // 2 + 1 for k in kinds]
        klen = lengths_of(kinds)
    o.put(19 - 4, 4)
    for s in W.CODE_ORDER:
        o.put(klen[s], 3)
    o.put(0, 1)
    kcode = canonical(klen)
    for s, extra, bits in steps:
        o.put(*kcode[s])
        o.put(extra, bits)
    return canonical(lengths)


def prefix(v):
    for p in range(40):
        extra = 0 if p < 4 else (p - 2) >> 1
        base = p + 1 if p < 4 else ((2 + (p & 1)) << extra) + 1
        if base <= v < base + (1 << extra):
            return p, v - base, extra
    raise AssertionError


def put_image(o, px, width, r, top, cache_bits=0, meta_bits=0, repeats=False):
    height, total = len(px) // width, len(px)
    o.put(1 if cache_bits else 0, 1)
    if cache_bits:
        o.put(cache_bits, 4)
    groups, group_of = 1, lambda i: 0
    if top:
        o.put(1 if meta_bits else 0, 1)
        if meta_bits:
            o.put(meta_bits - 2, 3)
            mw, mh = (width + (1 << meta_bits) - 1) >> meta_bits, (height + (1 << meta_bits) - 1) >> meta_bits
            ids = [r.randrange(3) for _ in range(mw * mh)]
            ids[0] = 2
            groups = 3
            group_of = lambda i: ids[(i // width >> meta_bits) * mw + (i % width >> meta_bits)]
            put_image(o, [g << 8 for g in ids], mw, r, False)
    cache, tokens, i = [0] * (1 << cache_bits), [], 0
    key = lambda p: ((0x1E35A7BD * p) & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < total:
        best = 0
        for d in {1, width, width + 1, r.randint(1, max(1, i))}:
            n = 0
            while d <= i and i + n < total and px[i + n] == px[i + n - d] and n < 40:
                n += 1
            if n > best:
                best, dist = n, d
        if best >= 2 and r.random() < 0.8:
            near = [k for k, (dx, dy) in enumerate(W.DISTANCE_MAP) if max(1, dx + dy * width) == dist]
            code = (near[0] + 1) if near and r.random() < 0.7 else dist + 120
            tokens.append((i, "ref", best, code))
            step = best
        elif cache_bits and cache[key(px[i])] == px[i]:
            tokens.append((i, "cache", key(px[i]), 0))
            step = 1
        else:
            tokens.append((i, "lit", px[i], 0))
            step = 1
        for k in range(i, i + step):
            if cache_bits:
                cache[key(px[k])] = px[k]
        i += step
    sizes = [280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40]
    freq = [[[0] * s for s in sizes] for _ in range(groups)]
    for i, kind, a, b in tokens:
        f = freq[group_of(i)]
        if kind == "lit":
            for c, v in enumerate(((a >> 8) & 255, (a >> 16) & 255, a & 255, a >> 24)):
                f[c][v] += 1
        elif kind == "ref":
            f[0][256 + prefix(a)[0]] += 1
            f[4][prefix(b)[0]] += 1
        else:
            f[0][280 + a] += 1
    codes = []
    for f in freq:
        for x in f:
            if not any(x):
                x[0] = 1
        codes.append([put_code(o, x, repeats) for x in f])
    for i, kind, a, b in tokens:
        c = codes[group_of(i)]
        if kind == "lit":
            for code, v in zip(c, ((a >> 8) & 255, (a >> 16) & 255, a & 255, a >> 24), strict=False):
                o.put(*code[v])
        elif kind == "ref":
            for code, v, base in ((c[0], a, 256), (c[4], b, 0)):
                p, extra, bits = prefix(v)
                o.put(*code[base + p])
                o.put(extra, bits)
        else:
            o.put(*c[0][280 + a])


def predicted(img, x, y, w, mode):
    g = lambda dx, dy: img[(y + dy) * w + x + dx]
    if y == 0:
        return (255, 0, 0, 0) if x == 0 else g(-1, 0)
    if x == 0:
        return g(0, -1)
    left, top, corner = g(-1, 0), g(0, -1), g(-1, -1)
    right = g(1, -1) if x + 1 < w else img[y * w]
    avg = lambda a, b: tuple((p + q) // 2 for p, q in zip(a, b, strict=True))
    clip = lambda v: max(0, min(255, v))
    if mode == 11:
        pl = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        pt = sum(abs(lf - c) for lf, c in zip(left, corner, strict=True))
        return left if pl < pt else top
    if mode == 12:
        return tuple(clip(a + b - c) for a, b, c in zip(left, top, corner, strict=True))
    if mode == 13:
        return tuple(clip(a + int((a - c) / 2)) for a, c in zip(avg(left, top), corner, strict=True))
    return {
        0: (255, 0, 0, 0), 1: left, 2: top, 3: right, 4: corner, 5: avg(avg(left, right), top), 6: avg(left, corner), 7: avg(left, top), 8: avg(corner, top), 9: avg(top, right), 10: avg(avg(left, corner), avg(top, right)),
    }[mode]


def pack_argb(p):
    return (p[0] << 24) | (p[1] << 16) | (p[2] << 8) | p[3]


def signed(v):
    return v - 256 if v > 127 else v


def encode(img, w, h, r, steps, **options):
    """img: list of (a, r, g, b); steps: transforms in writing order."""
    o = Out()
    o.put(0x2F, 8)
    o.put(w - 1, 14)
    o.put(h - 1, 14)
    o.put(1, 1)
    o.put(0, 3)
    cur, cw = list(img), w
    for s in steps:
        o.put(1, 1)
        o.put({"predict": 0, "cross": 1, "green": 2, "index": 3}[s], 2)
        if s in ("predict", "cross"):
            bits = r.choice([2, 3])
            o.put(bits - 2, 3)
            bw, bh = (cw + (1 << bits) - 1) >> bits, (h + (1 << bits) - 1) >> bits
            block = lambda i: (i // cw >> bits) * bw + (i % cw >> bits)  # noqa: E731, B023
            if s == "predict":
                modes = [r.randrange(14) for _ in range(bw * bh)]
                put_image(o, [m << 8 for m in modes], bw, r, False)
                cur = [tuple((a - b) & 255 for a, b in zip(cur[i], predicted(cur, i % cw, i // cw, cw, modes[block(i)]), strict=True)) for i in range(len(cur))]
            else:
                ms = [(r.randrange(256), r.randrange(256), r.randrange(256)) for _ in range(bw * bh)]  # red to blue, green to blue, green to red
                put_image(o, [(255 << 24) | (a << 16) | (b << 8) | c for a, b, c in ms], bw, r, False)
                nxt = []
                for i, (a, red, g, b) in enumerate(cur):
                    rb, gb, gr = (signed(v) for v in ms[block(i)])
                    nxt.append((a, (red - ((gr * signed(g)) >> 5)) & 255, g, (b - ((gb * signed(g)) >> 5) - ((rb * signed(red)) >> 5)) & 255))
                cur = nxt
        elif s == "green":
            cur = [(a, (red - g) & 255, g, (b - g) & 255) for a, red, g, b in cur]
        else:
            table = sorted(set(cur))
            o.put(len(table) - 1, 8)
            diff = [table[0], *[tuple((p - q) & 255 for p, q in zip(x, y, strict=True)) for x, y in zip(table[1:], table, strict=False)]]
            put_image(o, [pack_argb(p) for p in diff], len(table), r, False)
            per = 8 if len(table) <= 2 else 4 if len(table) <= 4 else 2 if len(table) <= 16 else 1
            index, nw, nxt = [table.index(p) for p in cur], (cw + per - 1) // per, []
            for y in range(h):
                for x in range(nw):
                    v = sum(index[y * cw + x * per + k] << (k * 8 // per) for k in range(per) if x * per + k < cw)
                    nxt.append((255, 0, v, 0))
            cur, cw = nxt, nw
    o.put(0, 1)
    put_image(o, [pack_argb(p) for p in cur], cw, r, True, **options)
    data = o.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def picture(r, w, h, colours):
    table = [tuple(r.randrange(256) for _ in range(4)) for _ in range(colours)]
    out = []
    for i in range(w * h):
        out.append(out[i - w] if i >= w and r.random() < 0.5 else out[-1] if out and r.random() < 0.4 else r.choice(table))
    return out


STEPS = [(), ("predict",), ("cross",), ("green",), ("index",), ("predict", "cross", "green"), ("green", "cross", "predict"), ("index", "predict"), ("cross", "index")]


@pytest.mark.parametrize("steps", STEPS, ids="-".join)
@pytest.mark.parametrize("options", [{}, {"cache_bits": 4}, {"meta_bits": 2}, {"cache_bits": 7, "meta_bits": 3, "repeats": True}], ids=str)
def test_every_transform_and_code(steps, options):
    for seed in range(3):
        r = random.Random(f"{seed}{steps}{sorted(options)}")
        w, h = r.randint(1, 23), r.randint(1, 17)
        img = picture(r, w, h, r.choice([1, 2, 4, 15, 60]))
        if "cross" in steps and "index" in steps:
            img = img[:1] * len(img) if seed == 0 else picture(r, w, h, 3)
        try:
            media = encode(img, w, h, r, steps, **options)
        except (OverflowError, ValueError) as e:  # more than 256 colours after another transform
            pytest.skip(str(e))
        assert W.decode(media).reshape(-1, 4).tolist() == [list(p) for p in img]


def test_known_file_and_broken_ones():
    tiny = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert W.decode(tiny).shape == (1, 1, 4)
    for bad in (b"", b"RIFF0000WEBP", tiny[:24], tiny.replace(b"VP8L", b"VP8 ")):
        with pytest.raises((ValueError, struct.error)):
            W.decode(bad)


def test_fast_and_slow_paths_agree(monkeypatch):
    rng = np.random.default_rng(1)
    media = [W.encode(rng.choice(rng.integers(0, 256, k).astype(np.uint8), W.WIDTH * 3)) for k in (1, 2, 3, 9, 40, 100, 256)]
    fast = [W.decode(m) for m in media]
    init = W.PrefixCode.__init__

    def slow(self, lengths):
        init(self, lengths)
        self.uniform = 0

    W._lengths_code.cache_clear()
    W._one_symbol.cache_clear()
    monkeypatch.setattr(W.PrefixCode, "__init__", slow)
    for m, f in zip(media, fast, strict=True):
        assert np.array_equal(W.decode(m), f)
    W._lengths_code.cache_clear()


@pytest.mark.parametrize("lanes", [1, 3, 64])
def test_files_read_side_by_side(lanes):
    """Images of all kinds and sizes, more than there are lanes, give what they give alone."""
    files, rng = [], np.random.default_rng(3)
    for steps in STEPS:
        for options in ({}, {"cache_bits": 4}, {"meta_bits": 2}, {"cache_bits": 7, "repeats": True}):
            r = random.Random(f"{steps}{sorted(options)}")
            w, h = r.randint(1, 23), r.randint(1, 17)
            try:
                files.append(encode(picture(r, w, h, r.choice([1, 2, 4, 15])), w, h, r, steps, **options))
            except (OverflowError, ValueError):
                continue
    words = [b"alpha ", b"beta, ", b"gamma\n", b"the same again and again. ", bytes(range(256))]
    for n in (1, 2, 40, 300, 3000):
        for style in range(4):
            raw = b"".join(words[int(k)] for k in rng.integers(0, 5, n))
            payload = np.full(W.padded(len(raw)), 255, np.uint8)
            payload[: len(raw)] = np.frombuffer(raw, np.uint8)
            files.append(W.encode(payload, style))
    alone = [W.decode(f) for f in files]
    streams = [W.Stream(W._lossless(f)) for f in files]
    plain = [i for i, s in enumerate(streams) if s.coded.plain]
    assert len(plain) > 30
    for i, px in zip(plain, W.side_by_side([streams[i] for i in plain], lanes), strict=True):
        assert np.array_equal(streams[i].finished(px), alone[i]), i
    assert all(np.array_equal(a, b) for a, b in zip(W.decode_many(files, lanes), alone, strict=True))
    cut = files[plain[-1]]
    cut = cut[:16] + struct.pack("<I", len(cut) // 2) + cut[20 : 20 + len(cut) // 2]
    with pytest.raises(ValueError):
        W.decode(cut)
    with pytest.raises(ValueError):
        W.side_by_side([W.Stream(W._lossless(cut))], lanes)
    assert W.decode_many([]) == []


def test_transforms_are_chosen_by_their_cost():
    """A picture with gradients takes the predictor, correlated channels cross-colour, and text neither; whatever the payload's bytes sum to."""
    rng = np.random.default_rng(0)
    y, x = np.mgrid[0:64, 0 : W.WIDTH]
    smooth = np.stack([(x * 2 + y * 3) & 255, (x + y * 2) & 255, (x * 3 + y) & 255, (x + y) & 255], axis=2) + rng.integers(0, 2, (64, W.WIDTH, 4))
    noise = rng.integers(0, 256, (64, W.WIDTH, 1))
    linked = np.concatenate([np.full_like(noise, 255), noise, noise, noise], axis=2)
    words = "plain words in many orders as texts have them with commas, stops. and the odd longer expression".split()
    text = np.frombuffer(" ".join(rng.choice(words, 20_000)).encode()[: 64 * W.WIDTH * 4], np.uint8).reshape(64, W.WIDTH, 4)
    for img, styles in ((smooth, {1, 3}), (linked, {2, 3}), (text, {0})):
        img = (img & 255).astype(np.uint8)
        assert W.cheapest(img) in styles
        sizes = [len(W.encode(img.reshape(-1), s)) for s in range(4)]
        assert len(W.encode(img.reshape(-1))) <= 1.1 * min(sizes)
        assert all(np.array_equal(W.decode(W.encode(img.reshape(-1), s)), img) for s in range(4))


def test_images_encoded_together(monkeypatch):
    """A batch's files are those that each payload gives alone, in any order and company; codes are made in a few steps a batch, not for each image."""
    rng = np.random.default_rng(7)
    words = [b"alpha ", b"beta, ", b"gamma\n", b"the same again and again. ", bytes(range(256))]
    payloads = []
    for n in (1, 2, 40, 300):
        for kinds in (1, 2, 4, 16, 60, 256):
            payloads.append(rng.integers(0, kinds, W.PAD * (1 + n // 40), dtype=np.uint8))
        for _ in range(20):
            raw = b"".join(words[int(k)] for k in rng.integers(0, 5, n))
            payload = np.full(W.padded(len(raw)), 255, np.uint8)
            payload[: len(raw)] = np.frombuffer(raw, np.uint8)
            payloads.append(payload)
    y, x = np.mgrid[0:64, 0 : W.WIDTH]
    smooth = np.stack([x * 2 + y * 3, x + y * 2, x * 3 + y, x + y], axis=2)
    noise = rng.integers(0, 256, (64, W.WIDTH))
    payloads += [(img & 255).astype(np.uint8).reshape(-1) for img in (smooth, np.stack([np.full_like(noise, 255), noise, noise, noise], axis=2))]
    alone = [W.encode(p) for p in payloads]
    assert all(np.array_equal(i.reshape(-1), p) for i, p in zip(W.decode_many(alone), payloads, strict=True))
    made = []
    init = W.Codes.__init__
    monkeypatch.setattr(W.Codes, "__init__", lambda self, *a: (made.append(1), init(self, *a))[1])
    assert W.encode_many(payloads) == alone
    pixels = sum(map(len, payloads)) // 4
    assert len(made) <= 4 * (2 + 2 * pixels // W.BATCH_PIXELS) < len(payloads)  # palettes, predictors, cross-colours and pixels
    order = rng.permutation(len(payloads)).tolist()
    monkeypatch.setattr(W, "BATCH_PIXELS", 5000)
    assert W.encode_many([payloads[i] for i in order]) == [alone[i] for i in order]
    assert W.encode_payloads([]) == [] and W.encode_many([]) == []


def test_code_lengths_are_read_several_at_a_time(monkeypatch):
    """Sixteen bits give all lengths that they hold for sure, repeats too; the codes are those read length by length, and cut ones raise."""
    r = random.Random(11)
    streams = []
    for case in range(60):
        counts = [0] * 280
        for k in r.sample(range(280), r.choice([3, 20, 90, 270])):
            counts[k] = r.choice([1, 1, 7, 1 << r.randint(0, 5)])
        out = Out()
        out.put(r.randrange(1 << case % 6), case % 6)
        assert max(lengths_of(counts)) < 16
        put_code(out, counts, case % 2 == 0)
        end = out.n
        fields = W.Fields(1)
        codes = W.Codes(np.array([counts]), np.array([280]))
        codes.describe(fields, np.array([0]), np.array([0]))
        streams += [(out.bytes(), case % 6, end), (fields.streams()[0], 0, int(codes.size.sum()))]

    def read():
        found = []
        for data, skip, end in streams:
            bits = W.Bits(data)
            bits.read(skip)
            code = W._read_code(bits, 280)
            assert bits.at == end
            found.append(code.lengths.tolist())
        return found

    calls = []
    span = W._word
    monkeypatch.setattr(W, "_word", lambda code, w: (calls.append(1), span(code, w))[1])
    several = read()
    assert len(calls) < 0.75 * sum(len(x) - x.count(0) for x in several)
    monkeypatch.setattr(W, "_word", lambda code, w: ((), 0, 0))
    assert read() == several
    monkeypatch.undo()
    with pytest.raises(ValueError):
        W._read_code(W.Bits(streams[0][0][: len(streams[0][0]) // 2]), 280)
