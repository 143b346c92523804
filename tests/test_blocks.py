import heapq
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.functions.samples import LUMINANCE
from rasterlake.operators import blocks, entropy


def cosine8():
    k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    m = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    m[0] /= np.sqrt(2)
    return m


def test_cosine_transform_of_8(spark):
    rng = np.random.default_rng(0)
    b = rng.integers(-128, 128, (200, 8, 8))
    rows = [(i, x.ravel().tolist()) for i, x in enumerate(b)] + [(900, None), (901, [1] * 63), (902, [None] * 64)]
    df = spark.createDataFrame(rows, "i int, s array<int>").repartition(3)
    out = {r.i: r for r in df.select("i", blocks.transformed(F.col("s"), "dct8").alias("d")).select("i", "d", blocks.transformed(F.col("d"), "idct8").alias("back")).collect()}
    m = cosine8()
    for i, x in enumerate(b):
        assert np.allclose(np.array(out[i].d).reshape(8, 8), m @ x @ m.T, atol=1e-2)
        assert np.allclose(np.array(out[i].back).reshape(8, 8), x, atol=1e-2)
    assert all(out[i].d is None and out[i].back is None for i in (900, 901, 902))


def vp8_step(v, c1=20091, c2=35468):
    a, b = v[0] + v[2], v[0] - v[2]
    c, d = (v[1] * c2 >> 16) - (v[3] + (v[3] * c1 >> 16)), v[1] + (v[1] * c1 >> 16) + (v[3] * c2 >> 16)
    return a + d, b + c, b - c, a - d


def test_integer_transforms(spark):
    rng = np.random.default_rng(1)
    b = np.concatenate([rng.integers(-255, 256, (300, 16)), rng.integers(-2, 3, (100, 16)), np.zeros((1, 16), dtype=int), np.full((1, 16), 255)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(b)], "i int, s array<int>")
    shown = df.select("i", *[blocks.transformed(F.col("s"), k).alias(k) for k in ("dct4", "idct4", "wht4", "iwht4")])
    again = shown.select("*", blocks.transformed(F.col("dct4"), "idct4").alias("back"))
    for r in again.collect():
        x = b[r.i].reshape(4, 4)
        assert np.abs(np.array(r.back).reshape(4, 4) - x).max() <= 2
        columns = np.array([vp8_step([int(x[k, i]) for k in range(4)]) for i in range(4)]).T
        assert r.idct4 == [(int(v) + 4) >> 3 for row in columns for v in vp8_step([int(y) for y in row])]
        h = np.array([[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, -1, 1], [1, -1, 1, -1]])
        assert r.iwht4 == ((h.T @ x @ h + 3) >> 3).ravel().tolist()
        want = h @ x @ h.T
        assert r.wht4 == [(int(v) + 1) // 2 if v > 0 else -(-int(v) // 2) for v in want.ravel()]


def test_blocks_of_frames(spark):
    px = np.random.default_rng(2).integers(0, 256, (9, 17, 4), dtype=np.uint8)
    rows = [(1, 0, 17, 9, px.tobytes()), (2, 0, 4, 4, b"short"), (3, 0, 4, 4, None)]
    df = spark.createDataFrame(rows, "image_id long, frame_idx int, width int, height int, rgba binary")
    got = blocks.frame_blocks(df, "g").orderBy("n").collect()
    assert [(r.n, r.by, r.bx) for r in got] == [(k, k // 3, k % 3) for k in range(6)]
    full = np.pad(px[..., 1], ((0, 7), (0, 7)), mode="edge")
    for r in got:
        assert r.samples == full[r.by * 8 : r.by * 8 + 8, r.bx * 8 : r.bx * 8 + 8].ravel().tolist()
    assert blocks.frame_blocks(df.where("image_id > 1")).count() == 0
    assert blocks.zigzag_order()[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and blocks.zigzag_order()[-3:] == [55, 62, 63]


def huffman_cost(counts):
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


def least_cost(counts, longest):
    """By trying every choice of lengths that a prefix code may have."""
    return min(sum(a * b for a, b in zip(counts, lengths, strict=True)) for lengths in itertools.product(range(1, longest + 1), repeat=len(counts)) if sum(2 ** (longest - x) for x in lengths) <= 2**longest)


def test_code_lengths():
    rng = np.random.default_rng(3)
    for n in (2, 3, 4, 5):
        for longest in range(int(np.ceil(np.log2(n))), 5):
            for _ in range(6):
                counts = rng.integers(1, [3, 100][n % 2], n).tolist()
                lengths, codes = entropy.canonical(counts, longest, False)
                assert max(lengths) <= longest and sum(a * b for a, b in zip(counts, lengths, strict=True)) == least_cost(counts, longest)
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(sum(fibonacci[-2:]))
    lengths, _ = entropy.canonical(fibonacci, 16, True)
    assert max(lengths) == 16 and sum(2.0**-x for x in lengths) < 1
    for counts in ([5], [7, 7], rng.integers(1, 1000, 256).tolist(), [1] * 255):
        lengths, codes = entropy.canonical(counts, 16, True)
        assert sum(a * b for a, b in zip(counts, lengths, strict=True)) == huffman_cost([*counts, 0])
        texts = [f"{c:0{x}b}" for c, x in zip(codes, lengths, strict=True)]
        assert all("0" in t for t in texts) and not any(b.startswith(a) for a, b in itertools.pairwise(sorted(texts)))
    with pytest.raises(ValueError, match="symbols"):
        entropy.canonical([1] * 4, 2, True)


def test_prefix_codes(spark):
    rows = [("a", 1, 5), ("a", 2, 5), ("a", 3, 0), ("a", 4, None), ("a", 1, 2), ("b", 9, 1), (None, 3, 4), (None, 5, 9)]
    out = entropy.prefix_codes(spark.createDataFrame(rows, "g string, symbol int, n long"), ["g"])
    got = {(r.g, r.symbol): (r.n, r.length, r.code) for r in out.collect()}
    assert got == {("a", 1): (7, 1, 0), ("a", 2): (5, 2, 2), ("b", 9): (1, 1, 0), (None, 3): (4, 2, 2), (None, 5): (9, 1, 0)}


def stuffed(bits):
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))
    return data.replace(b"\xff", b"\xff\0")


def test_bit_streams(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for image in range(30):
        n = int(rng.integers(1, 400)) if image < 29 else 20_000
        sizes = rng.integers(0, 28, n)
        codes = [int(rng.integers(1 << 40)) if rng.random() < 0.5 else (1 << 40) - 1 for _ in range(n)]
        rows += [(image, k // 7, k % 7, c, int(s)) for k, (c, s) in enumerate(zip(codes, sizes, strict=True))]
        bits = "".join(f"{c & (1 << int(s)) - 1:0{s}b}" for c, s in zip(codes, sizes, strict=True) if s)
        if bits:
            want[image] = (len(bits), stuffed(bits))
    df = spark.createDataFrame([*rows, (77, 0, 0, 5, None), (78, 0, 0, 5, 0)], "image int, n int, k int, code long, length int").repartition(5)
    got = {r.image: (r.n_bits, bytes(r.content)) for r in entropy.bit_streams(df, ["image"], ["n", "k"]).collect()}
    assert got == want
    plain = entropy.bit_streams(df.where("image = 3"), ["image"], ["n", "k"], stuff=False).first()
    assert bytes(plain.content) == want[3][1].replace(b"\xff\0", b"\xff")
    assert entropy.bit_streams(df.limit(0), ["image"], ["n", "k"]).count() == 0


def decoded(content, codes, n_blocks):
    """Reads a scan one bit after the other."""
    bits = iter("".join(f"{b:08b}" for b in content.replace(b"\xff\0", b"\xff")))
    known = {(c.ac, f"{c.code:0{c.length}b}"): c.symbol for c in codes}

    def symbol(ac):
        text = ""
        while (ac, text) not in known:
            text += next(bits)
        return known[ac, text]

    def number(size):
        v = int("0" + "".join(next(bits) for _ in range(size)), 2)
        return v if not size or v >> size - 1 else v - (1 << size) + 1

    out, dc = [], 0
    for _ in range(n_blocks):
        dc += number(symbol(False))
        q, k = [dc] + [0] * 63, 1
        while k < 64:
            s = symbol(True)
            if s == 0:
                break
            k += s >> 4
            if s & 15:
                q[k] = number(s & 15)
            k += 1
        out.append(q)
    return out


def test_scans_are_read_back(spark):
    rng = np.random.default_rng(5)
    y, x = np.mgrid[:40, :56]
    smooth = (128 + 100 * np.sin(y / 9) * np.cos(x / 7)).astype(np.uint8)
    frames = []
    for i, gray in enumerate((smooth, rng.integers(0, 256, (16, 24), dtype=np.uint8), np.full((8, 8), 7, dtype=np.uint8))):
        frames.append((i, 0, gray.shape[1], gray.shape[0], np.repeat(gray[..., None], 4, axis=2).tobytes()))
    q = blocks.jpeg_blocks(spark.createDataFrame(frames, "image_id long, frame_idx int, width int, height int, rgba binary"), LUMINANCE)
    long_runs = [[5] + [0] * 40 + [1] + [0] * 21 + [-9], [5] + [0] * 63, [-300] + [0] * 16 + [1] + [0] * 46, [0] * 63 + [1023]]
    q = q.unionByName(spark.createDataFrame([(9, 1, n, b) for n, b in enumerate(long_runs)], "image_id long, frame_idx int, n int, q array<int>"))
    scans, codes = entropy.baseline_scans(q)
    want, tables = {}, {}
    for r in q.orderBy("n").collect():
        want.setdefault(r.image_id, []).append(r.q)
    for r in codes.collect():
        tables.setdefault(r.image_id, []).append(r)
    got = {r.image_id: decoded(bytes(r.content), tables[r.image_id], len(want[r.image_id])) for r in scans.collect()}
    assert got == want
