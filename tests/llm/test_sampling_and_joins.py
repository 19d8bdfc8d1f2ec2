"""Importance resampling, the Jaccard join and hard negatives against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lumenframe.llm import jaccard, negatives, resampling

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# -- 11 ----------------------------------------------------------------------------------------------------------------
def runs_of(text, most):
    w = TOKEN.findall(lower(text))
    return w, [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute_ranks(rows, target, percent, least, seed, most, buckets):
    place = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(place(g) for text in texts for g in runs_of(text, most)[1]) for texts in ([r[1] for r in rows], target))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets))))
    out = []
    for i, text, *_ in rows:
        w, g = runs_of(text, most)
        weight = sum(gain(place(x)) for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    asked = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], LAST if r[0] is None else r[0], -r[3], -r[2]))
    for place_, r in enumerate(asked[: percent * len(asked) // 100]):
        r[5] = place_ + 1
    return out


@pytest.mark.parametrize("most, buckets, percent", [(1, 10000, 10), (3, 50, 40)])
def test_resampling(spark, docs, rows, empty, most, buckets, percent):
    texts = [r[1] for r in rows[:5]] + ["River STONE river", None, ""]
    target = spark.createDataFrame([(t,) for t in texts], "text string")
    got = resampling.ranked_weights(docs, target, percent, 20, 7, most, buckets)
    want = brute_ranks(rows, texts, percent, 20, 7, most, buckets)
    assert sorted(map(repr, map(tuple, got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()))) == sorted(map(repr, map(tuple, want)))
    drawn = resampling.resample(docs, target, percent, 20, 7, most, buckets)
    assert drawn.columns == docs.columns
    assert sorted(str(r.doc_id) for r in drawn.collect()) == sorted(str(r[0]) for r in want if r[5])
    assert resampling.ranked_weights(empty, target).count() == 0 and resampling.resample(empty, target).count() == 0
    assert resampling.ranked_weights(docs, target.limit(0)).where("rank IS NOT NULL").count() > 0


def test_repeated_rows_are_drawn_each(spark):
    rows = [(1, "a b c d")] * 10
    docs, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("a",)], "text string")
    assert sorted(r.rank for r in resampling.ranked_weights(docs, target, 30, 1).where("rank IS NOT NULL").collect()) == [1, 2, 3]
    assert resampling.resample(docs, target, 30, 1).count() == 3


def test_hash_and_table(monkeypatch):
    rng = random.Random(1)
    runs = [bytes(rng.randrange(97, 100) for _ in range(n)) for n in range(1, 45) for _ in range(40)]
    data = np.frombuffer(b"".join(runs) + b" " * 8, np.uint8).copy()
    length = np.array([len(r) for r in runs])
    start = np.cumsum(length) - length
    assert resampling.xxhash64(data, start, length).tolist() == [xxhash.xxh64_intdigest(r, 42) for r in runs]

    def fill():
        table, slots = resampling.Interned(data, 10, bits=2), np.zeros(0, np.int64)
        for a in range(0, len(runs), 100):
            some = slice(a, a + 100)
            moved = table.grow(len(runs[some]))
            slots = np.concatenate([slots if moved is None else moved[slots], table.intern(start[some], length[some])])
        groups = defaultdict(set)
        for r, s in zip(runs, slots.tolist()):
            groups[s].add(r)
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(runs)) == table.taken
        n = Counter(runs)
        assert all(table.count[s] == n[r] and table.bucket[s] == zlib.crc32(r) % 10 for r, s in zip(runs, slots.tolist()))

    fill()
    monkeypatch.setattr(resampling, "xxhash64", lambda data, start, length: np.full(len(start), 5, np.uint64))
    fill()  # keys that all collide are told apart by their bytes


# -- 12 ----------------------------------------------------------------------------------------------------------------
def brute_components(rows, k, percent):
    sets = []
    for _, t, *_ in rows:
        w = PLAIN.findall(lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and 100 * shared >= percent * (len(a) + len(sets[j]) - shared) and sets[j]:
                links += 1
                up[root(i)] = root(j)
    low = {}
    for i, (id_, *_) in enumerate(rows):
        if id_ is not None:
            low[root(i)] = min(low.get(root(i), id_), id_)
    return [(r[0], len(s), low.get(root(i))) for i, (r, s) in enumerate(zip(rows, sets))], links


def near_copies():
    """Families of near copies around the threshold, documents that share a long passage, and short ones."""
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows, n = [], 0
    passage = say(60)
    for size in (6, 15, 30, 60, 120):
        for _ in range(3):
            base = say(size)
            for edits in (0, 0, 1, 1, 1, 2, 3, 4, 6):
                w = list(base)
                for _ in range(edits):
                    at, kind = rng.randrange(len(w)), rng.randrange(3)
                    w[at : at + (kind != 1)] = [] if kind == 0 else say(1)
                rows.append((n, " ".join(w)))
                n += 1
    for extra in (8, 9, 10, 11, 12, 13, 14, 40):
        for _ in range(6):
            rows.append((n, " ".join(passage + say(extra))))
            n += 1
    chain = say(80)
    for i in range(12):  # each is similar to the next, the ends are not
        rows.append((n, " ".join(chain[3 * i :] + say(3 * i))))
        n += 1
    rows += [(n, "one two"), (n + 1, "ONE two"), (n + 2, "one"), (n + 3, None), (n + 4, " \n"), (None, "one two"), (None, None), rows[0]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("slice_", [2048, 3])
def test_jaccard(spark, docs, rows, empty, monkeypatch, slice_):
    monkeypatch.setattr(jaccard, "SLICE", slice_)
    made = near_copies()
    cases = [(spark.createDataFrame(made, "doc_id long, text string").repartition(3), made, 4, 85)]
    if slice_ > 3:
        cases.append((docs, rows, 3, 60))
    for df, its, k, percent in cases:
        want, links = brute_components(its, k, percent)
        got = jaccard.jaccard_groups(df, k, percent)
        assert sorted(map(repr, map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()))) == sorted(map(repr, want))
        assert links > 10
    assert jaccard.jaccard_groups(empty).count() == 0


def test_jaccard_ends_when_all_that_meet_are_joined(spark, monkeypatch):
    asked = []
    plain = jaccard.unjoined
    monkeypatch.setattr(jaccard, "unjoined", lambda *args: asked.append(1) or plain(*args))
    texts = [" ".join(f"w{10 * i + j}" for j in range(30)) for i in range(0, 40, 4)]
    rows = [(10 * i + j, t + (" more" if j == 2 else "")) for i, t in enumerate(texts) for j in range(3)]
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(n, n - n % 10) for n, _ in rows}
    assert not asked


def test_prefix_length():
    for percent in (60, 85, 100):
        for n in range(1, 200):
            need = -(-percent * n // 100)
            assert jaccard.prefix_length(np.array([n]), percent)[0] == n - need + 1


# -- 13 ----------------------------------------------------------------------------------------------------------------
def brute_negatives(rows, every, positives, negatives, low, high):
    one = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and None not in v and (i not in one or (label, v) < one[i]):
            one[i] = (label, v)
    d = max([len(v) for _, v in one.values()], default=0)
    one = {i: (label, v + [0] * (d - len(v))) for i, (label, v) in one.items()}
    out = []
    for a, (label, v) in one.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in one.items() if i != a)
        for s, p, _ in [x for x in scores if x[2] == label][:positives]:
            fit = [x for x in scores if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, p, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit)]
    return out


@pytest.mark.parametrize("d, scale", [(64, 256), (3, 4), (70, 1 << 24)])
def test_hard_negatives(spark, monkeypatch, d, scale):
    rng = np.random.default_rng(d)
    v = rng.normal(size=(400, d)) + 2 * rng.normal(size=(7, d))[rng.integers(0, 7, 400)]
    v = np.floor(scale * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)
    v[50:60] = v[40]  # ties
    rows = [(i, int(i % 4), v[i].tolist()) for i in range(400)]
    rows += [(3, 1, v[7].tolist()), rows[9], (401, None, v[1].tolist()), (402, 1, None), (403, 1, [None] * d), (None, 1, v[2].tolist()), (404, 2, []), (405, 2, v[0].tolist()[: d // 2])]
    monkeypatch.setattr(negatives, "ROWS", 150)
    monkeypatch.setattr(negatives, "ANCHORS", 30)
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>").repartition(3)
    got = negatives.mine_hard_negatives(df, every=5, low=50)
    want = brute_negatives(rows, 5, 5, 5, 50, 100)
    assert len(want) > 20 and sorted(map(tuple, got.collect())) == sorted(want)
    assert negatives.mine_hard_negatives(df.limit(0)).count() == 0


def test_bounds_hold_and_exclude():
    rng = np.random.default_rng(0)
    v = np.floor(256 * rng.normal(size=(3000, 64)) / 8).astype(np.int64)
    code, along, across = negatives.encode(v, 42)
    for i in range(5):
        low, high = negatives.Anchor(v[i], 42).bounds(code, along, across)
        true = v @ v[i]
        assert (low <= true).all() and (true <= high).all()
        assert (high >= np.sort(true)[-6]).mean() < 0.3
    assert (np.diff([negatives.encode(v[:50], 42, n)[2].mean() for n in (1, 2, 3, 4)]) < 0).all()


def test_integer_rows(spark):
    rows = [(7, 9, [0.5, -0.001]), (8, 3, [float("nan"), 1.0]), (9, 3, [float("inf"), 1.0]), (10, None, [1.0, 1.0]), (11, 1, None), (12, 1, [None, 1.0])]
    got = negatives.integer_rows(spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>")).collect()
    assert [tuple(r) for r in got] == [(7, 0, [128, -1])]
