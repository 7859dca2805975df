import random

import numpy as np
from xxhash import xxh64_intdigest

from tidewheel.llm.components import connected_components
from tidewheel.llm.simhash import bit_planes, simhash_components, simhash_text, within


def plain(text, words=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=2, words=3):
    fps = [plain(t, words) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, f"{fps[k]:016x}", least.get(find(k))) for k, (i, *_) in enumerate(rows)), key=repr)


def test_bit_planes():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    f[50:120] = f[0] ^ (np.uint64(1) << rng.integers(0, 64, 70, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 70, dtype=np.uint64))
    for radius in (0, 1, 2, 3, 5, 9):
        a, b = within(f, bit_planes(f), len(f), radius)
        want = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius)
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*(x.tolist() for x in want), strict=True))


def test_fingerprint(odd):
    for _, text, *_ in odd:
        for words in (3, 5):
            assert simhash_text((text or "").encode(), words) == plain(text, words)


def test_components_match_brute_force(make, odd):
    rnd = random.Random(2)
    base = [f"w{rnd.randint(0, 900)}" for _ in range(300)]
    near = [(100 + k, " ".join(base[: 299 - k % 7] + [f"edit{k}"])) for k in range(150)]
    rows = [*odd, *near, *[(1000 + k, " ".join(rnd.choices(base, k=12))) for k in range(60)]]
    docs = make(rows)
    for kind in ({}, {"cap": 3}, {"radius": 3}, {"radius": 3, "cap": 4}):
        got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_components(docs, **kind).collect()]
        assert sorted(got, key=repr) == brute(rows, kind.get("radius", 2))
    assert simhash_components(make([])).count() == 0


def test_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (200, 100), (100, 200)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}
