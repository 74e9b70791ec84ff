"""Embedding whitening, periodic runs and SimHash near-dedup against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from fleetlife.llm import periods, queries, simhash, whitening

PATH = "/root/testdata/sf0.001"


# ---- whitening ---------------------------------------------------------------------------------

def _whitened(vectors, components=16):
    """Brute force in whole numbers: {id: (deviation, [absolute whitened values])}, n and explained shares."""
    left = {i: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for i, v in vectors
            if v and all(c is not None and np.isfinite(c) for c in v)}
    fit = [list(t) for t in sorted({tuple(x) for x in left.values()})]
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    cov = [[Fraction(sum((n * x[a] - s[a]) * (n * x[b] - s[b]) for x in fit), n ** 3) for b in range(d)] for a in range(d)]
    e, v = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    e, v = e[::-1], v[:, ::-1]
    e, v = e[:components], v[:, :components]
    rows = {}
    for i, x in left.items():
        y = [n * x[k] - s[k] for k in range(d)]
        rows[i] = (sum(t * t for t in y), np.abs((np.array(y, float) / n) @ v / np.sqrt(e)))
    return rows, n, e / float(sum(cov[k][k] for k in range(d)))


def _check_whitening(got, vectors, components=16):
    want, n, explained = _whitened(vectors, components)
    rows = {}
    for r in got:
        rows.setdefault(r[0], {})[r.component] = r
    assert set(rows) == set(want)
    for i, (deviation, values) in want.items():
        assert sorted(rows[i]) == list(range(1, len(values) + 1))
        for k, value in enumerate(values, 1):
            r = rows[i][k]
            assert r.n == n and r.deviation == deviation and abs(abs(r.whitened) - value) < 1e-6
            assert abs(r.explained / explained[k - 1] - 1) < 1e-9 and 0 <= r.identity_error < 1e-6


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet(f"{PATH}/embeddings.parquet").collect()
    _check_whitening(queries.op11_embedding_whitening(spark, PATH).collect(), [(r.vec_id, r.embedding) for r in rows])


def test_whitening_leaves_out_broken_rows(spark):
    rng = random.Random(2)
    good = [(i, [rng.gauss(0, 3), rng.gauss(5, 1), rng.gauss(-400, 20)]) for i in range(60)]
    nan, inf = float("nan"), float("inf")
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, nan, 2.0]), (104, [inf, 0.0, 0.0]), (105, [1.0, 2.0])]
    rows = good + good[:20] + [(None, good[3][1])] + odd
    frame = spark.createDataFrame([(i, v, 1, "k") for i, v in rows], "vec_id long, embedding array<double>, n int, x string")
    got = whitening.whiten(frame, "vec_id", "embedding").collect()
    assert len(got) == 3 * 81
    _check_whitening(got, [r for r in rows if r[0] not in (105,)])


def test_whitening_of_huge_entries_is_exact(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.gauss(0, 1e9), rng.gauss(0, 1e12)]) for i in range(30)]
    fit = whitening.whole(spark.createDataFrame(vectors, "k long, v array<double>"), "k", "v")
    n, sums = whitening.column_sums(fit)
    xs = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in vectors]
    assert n == 30 and sums == [sum(x[k] for x in xs) for k in range(2)]
    got = whitening.squares(fit, [7, -7])
    z = [[x[0] - 7, x[1] + 7] for x in xs]
    assert got == {(0, 0): sum(a * a for a, _ in z), (1, 1): sum(b * b for _, b in z), (0, 1): sum((a + b) ** 2 for a, b in z)}
    far = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])]
    got = whitening.whiten(spark.createDataFrame(far, "k long, v array<double>"), "k", "v").collect()
    assert {r.k for r in got} == {1, 2, 3} and all(np.isfinite(r.whitened) for r in got)
    assert any(r.deviation is None for r in got)  # no long holds it


def test_whitening_without_variance(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "k long, v array<float>"), "k", "v")
    assert make([]).count() == 0 and make([(1, [1.0, 2.0])] * 3).count() == 0
    got = make([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [4.0, 5.0])]).collect()
    assert {(r.k, r.component) for r in got} == {(1, 1), (2, 1), (3, 1)} and abs(got[0].explained - 1) < 1e-12


# ---- periodic runs -----------------------------------------------------------------------------

def _runs(w, least=6, times=4):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e, q) for (s, e), q in found.items())


def _described(words):
    runs = sorted((s, e - s, q) for s, e, q in _runs(words))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(words), len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def _random_text(rng):
    out = []
    for _ in range(rng.randint(0, 6)):
        if rng.random() < 0.6:
            part = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 7))]
            out += (part * rng.randint(1, 9))[:-rng.randint(1, 3)]
        else:
            out += [rng.randint(0, rng.choice([2, 50])) for _ in range(rng.randint(0, 12))]
    return out


def test_runs_as_by_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        texts = [_random_text(rng) for _ in range(rng.randint(1, 5))]
        flat = np.array([x for t in texts for x in t], "int64")
        got = periods.runs(flat, np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
        want, at = [], 0
        for t in texts:
            want += [(s + at, e + at, q) for s, e, q in _runs(t)]
            at += len(t)
        assert sorted(tuple(map(int, r)) for r in got) == sorted(want)


@pytest.mark.parametrize("words", [[7] * 5000, [1, 2] * 3000, list(range(900)) * 5, [0, 1, 0, 0, 1] * 400 + [9] + [0, 1] * 5])
def test_long_runs_are_whole(words):
    got = periods.runs(np.array(words), np.zeros(len(words), int))
    assert [tuple(map(int, r)) for r in got] == _runs(words)


def test_grammar_derives_its_text():
    rng = random.Random(8)
    text = np.array([rng.randint(0, 3) for _ in range(300)] + [1, 2, 3] * 50)
    rule, place, half, whole = periods.grammar(text, np.repeat([0, 1], [200, 250]))
    derived = {}
    for r, p, h, n in zip(rule, place, half, whole):
        assert 0 < h < n and not p < 200 < p + n
        assert derived.setdefault(r, (h, tuple(text[p:p + n]))) == (h, tuple(text[p:p + n]))
    assert max(whole) == 250


def test_run_detection_of_the_table(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_run_detection(spark, PATH).collect()}
    assert len(got) == len(docs)
    changed = 0
    for r in docs:
        words = [w.decode() for w in (r.text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            changed += 1
        if n < 1500 or h % 10 == 0:
            assert got[r.doc_id] == _described(words), r.doc_id
    assert changed > 5 and any(v[1] for v in got.values())


def test_run_detection_of_odd_rows(odd, none, docs):
    assert periods.detect(none).count() == 0
    want = sorted(map(repr, ((r.doc_id, *_described((r.text or "").split())) for r in odd.collect())))
    assert sorted(repr(tuple(r)) for r in periods.detect(odd).collect()) == want
    words = "a b " * 40_000 + "end"
    long = periods.detect(docs({1: words})).first()
    assert (long.start, long.length, long.period, long.exponent_milli) == (0, 80_000, 2, 40_000_000)


# ---- SimHash -----------------------------------------------------------------------------------

def _fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _near(fps, ids):
    """Brute force: the smallest id reached by links."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(fps))]


def test_golay_code_is_perfect():
    code = simhash.Golay(3)
    assert (code.reach[:, 0] == 1).all() and code.syndrome(np.array([0xC75, 0xC75 << 11, 0]))[:3].max() == 0
    assert code.reach[:, 3].sum() == 145_499


@pytest.mark.parametrize("blocks", [1, 2])
def test_close_words_meet_at_home(blocks):
    rng, code = random.Random(blocks), simhash.Golay(3)
    for _ in range(60):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        row, anchor, home = simhash.anchors(np.array([x, y], "<u8"), code, blocks, 3)
        assert set(anchor[(row == 0) & home]) <= set(anchor[row == 1]) and home[row == 0].sum() == 1


@pytest.mark.parametrize("blocks,group", [(1, 1 << 18), (2, 1 << 18), (1, 40)])
def test_links_as_by_brute_force(spark, blocks, group):
    rng = random.Random(6)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(160):  # chains and dense groups
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    a, b = zip(*[(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), blocks, 3, group).collect()])
    mask = (1 << 64) - 1
    assert all(bin((x ^ y) & mask).count("1") > 0 for x, y in zip(a, b))
    edges = simhash.Forest(len(fps))
    place = {f: i for i, f in enumerate(signed)}
    edges.merge(np.array([place[x] for x in a]), np.array([place[x] for x in b]))
    want = _near(fps, range(len(fps)))
    groups = {}
    for i, w in enumerate(want):
        groups.setdefault(w, set()).add(int(edges.parent[i]))
    assert all(len(v) == 1 for v in groups.values()) and len({tuple(v) for v in groups.values()}) == len(groups)


def test_simhash_of_the_table(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").collect()
    fps = [_fingerprint(r.text) for r in docs]
    want = {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(docs, fps, _near(fps, [r.doc_id for r in docs]))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op13_simhash_near_dedup(spark, PATH).collect()} == want
    assert len({c for _, c in want.values()}) < len(docs)


def test_simhash_of_odd_rows(odd, none):
    assert simhash.join(none).count() == 0
    rows = odd.collect()
    fps = [_fingerprint(r.text) for r in rows]
    want = sorted(repr((r.doc_id, f"{f:016x}", c)) for r, f, c in zip(rows, fps, _near(fps, [r.doc_id for r in rows])))
    assert sorted(repr(tuple(r)) for r in simhash.join(odd).collect()) == want
