import random
import time
import tracemalloc

from gatherum.operators import joins as J


def length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def check(a, b, n=None):
    got = J.align_words(a, b)
    assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    assert len(got) == (length(a, b) if n is None else n)


def test_longest_common_sequences(monkeypatch):
    rng = random.Random(9)
    for cells in (1 << 14, 4, 1):
        monkeypatch.setattr(J, "_TABLE_CELLS", cells)
        for _ in range(300):
            letters = rng.choice(["ab", "abcdefgh"])
            check([rng.choice(letters) for _ in range(rng.randrange(40))], [rng.choice(letters) for _ in range(rng.randrange(40))])
    check([], []), check(["a"], []), check(["a"] * 30, ["a"] * 20)


def test_fifty_thousand_words():
    rng = random.Random(2)
    common = [f"w{rng.randrange(3000)}" for _ in range(50_000)]
    other = [w for w in common if rng.random() > 0.01]
    tracemalloc.start()
    began = time.perf_counter()
    check(common, other, len(other))
    assert tracemalloc.get_traced_memory()[1] < 200 << 20 and time.perf_counter() - began < 120
    tracemalloc.stop()
