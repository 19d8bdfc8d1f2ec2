"""The operators on a small hostile corpus against brute force."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenframe.llm import _blocks, brown, chat, decontaminate, exact_bytes, langid, lines, mixing, passages, quality, simhash
from lumenframe.llm._shared import forget, stash
from lumenframe.llm.suffix import Scratch, TupleQueue, suffix_order

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NO_ID = 2**63 - 1


def words(t):
    return WORD.findall(t or "")


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def same(df, want, *columns):
    got = sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted(want, key=repr)


# -- 1 -----------------------------------------------------------------------------------------------------------------
def test_quality(docs, rows, empty):
    norm = lambda x: re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.lower().strip(quality.SPACES)))
    holders = defaultdict(set)
    for i, t, _, s, *_ in rows:
        for x in (t or "").split("\n"):
            if norm(x):
                holders[s, norm(x)].add((i, t))
    want = []
    for i, t, _, s, *_ in rows:
        w = words(t)
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        repeated = {j + k for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(5)}
        own = [x for x in (t or "").split("\n") if words(x)]
        total = sum(len(words(x)) for x in own)
        gone = sum(len(words(x)) for x in own if len(holders[s, norm(x)]) > 5)
        left = len(w) * (total - gone) // total if total else 0
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(own) - len(set(own)), len(repeated), left, failed, not failed and left >= 10 and left >= 0.3 * len(w)))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_left", "base_failed", "kept")
    out = quality.quality_rules(docs, most_docs=5)
    same(out, want, *columns)
    assert any(r.n_left < r.n_words for r in out.collect())
    assert quality.quality_rules(empty).count() == 0
    clean = quality.apply_quality_rules(docs, most_docs=5)
    texts = []
    for i, t, _, s, *_ in rows:
        own = "\n".join(x for x in (t or "").split("\n") if not norm(x) or len(holders[s, norm(x)]) <= 5) if t is not None else None
        if len(words(own)) >= 10 and len(words(own)) >= 0.3 * len(words(t)):
            texts.append((i, own))
    assert clean.columns == docs.columns
    same(clean, texts, "doc_id", "text")
    assert any(t not in {r[1] for r in rows} for _, t in texts) and quality.apply_quality_rules(empty).count() == 0


def test_quality_of_one_document_on_two_hosts(spark):
    """Copies of one row on two hosts are two documents: a line is frequent on one and not on the other."""
    line, own = "a line that is on every page of this host", "ten words of its own that no other page has here"
    rows = [(1, f"{line}\n{own}", "a"), (1, f"{line}\n{own}", "b"), *((i, line, "a") for i in range(2, 20))]
    out = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(r.n_left for r in out.where("doc_id = 1").collect()) == [11, 21]


def test_quality_is_native(docs):
    plan = quality.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- 2 -----------------------------------------------------------------------------------------------------------------
def targets_by_rounds(sizes):
    """Sharing and resharing, source by source, until none is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3.0 * sizes[s] if over else left * weight[s] / total
        if not over:
            break
        left -= sum(3.0 * sizes[s] for s in over)
        open_ -= over
    return target


def test_mixing(docs, rows, empty):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += len(words(t))
    want = targets_by_rounds(sizes)
    copies, expect = defaultdict(int), {}
    for r in out:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in out) == Counter((r.doc_id, r.size, r.taken) for r in again)
    assert mixing.mix_sources(empty).count() == 0 and mixing.emit_mix(empty).count() == 0
    assert mixing.mix_sources(docs).columns == [c for c in docs.columns if c != "target"] + ["size", "source_size", "target", "taken"]
    drawn = mixing.emit_mix(docs)
    assert drawn.columns == [*docs.columns, "copy"]
    assert Counter((r.doc_id, r.text) for r in drawn.collect()) == +sum((Counter({(r.doc_id, r.text): r.taken // r.size}) for r in out if r.size), Counter())
    assert all(r["my col"] == "spaced" and r["a.b"] == 10 and r._salt == "clash" and r.tags == {"a": 1} for r in drawn.collect())


def test_mixing_comes_near(spark):
    rows = [(i, f"s{i % 4}" if i % 2 else "s0", "w " * (1 + i * 7919 % 97)) for i in range(4000)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 0.01 * r.target + 100


# -- 3 -----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("window,block", [(20, 10), (6, 3)])
def test_passages(docs, rows, empty, window, block):
    first, want = {}, []
    key = lambda i: NO_ID if i is None else i
    texts = [(i, words(t)) for i, t, *_ in rows]
    for i, w in texts:
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, (NO_ID + 1, 0)), (key(i), j))
    for i, w in texts:
        gone = {j + k for j in range(len(w) - window + 1) if first[tuple(w[j : j + window])] < (key(i), j) for k in range(window)}
        want.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    out = passages.remove_repeated_passages(docs, window, block)
    same(out, want, "doc_id", "n_words", "n_removed", "kept_sha256")
    assert all(sha(r.kept) == r.kept_sha256 for r in out.collect())
    assert passages.remove_repeated_passages(empty).count() == 0


# -- 4 -----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("length,anchor,crowd", [(200, 100, None), (40, 20, None), (40, 20, 2)])
def test_bytes(docs, rows, empty, monkeypatch, length, anchor, crowd):
    """crowd 2: every anchor that repeats is split by its windows."""
    if crowd:
        monkeypatch.setattr(exact_bytes, "CROWD", crowd)
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[j : j + length] for _, b in data for j in range(len(b) - length + 1))
    want = []
    for i, b in data:
        mask = np.zeros(len(b) + 1, int)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                mask[j] += 1
                mask[j + length] -= 1
        gone = np.cumsum(mask)[:-1] > 0
        want.append((i, len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    same(exact_bytes.remove_repeated_bytes(docs, length, anchor), want, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert exact_bytes.remove_repeated_bytes(empty).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(1)
    for case in range(200):
        t = rng.integers(0, rng.integers(1, 6), rng.integers(1, 90))
        if case % 3 == 0:
            t = np.tile(t[: max(1, len(t) // 5)], 6)
        if case % 7 == 0:
            t = np.repeat(t, rng.integers(1, 20, len(t)))
        own = [t[i:].tolist() for i in range(len(t))]
        order = sorted(range(len(t)), key=lambda i: own[i])
        common = [0] + [next((k for k, (a, b) in enumerate(zip(own[x], own[y])) if a != b), min(len(own[x]), len(own[y]))) for x, y in zip(order, order[1:])]
        for scratch in (None, Scratch(16) if case % 5 == 0 else Scratch(64)):  # in memory, and through files
            got = suffix_order(t, 50, scratch)
            assert list(got[0]) == order and list(got[1]) == [min(c, 50) for c in common]
            assert scratch is None or len(t) <= scratch.limit or scratch.files


def test_suffix_order_of_a_shard_larger_than_memory():
    """Ten and twenty times as many bytes as may be held at once: the same order, and memory that doesn't grow along."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    text = np.frombuffer(" ".join(rng.choice(vocabulary) for _ in range(80_000)).encode()[: 20 << 14], np.uint8).astype(np.int64)
    text[5000:9000] = text[100_000:104_000]
    for times in (10, 20):
        t = text[: times << 14]
        want, scratch = suffix_order(t, 200, Scratch(1 << 30)), Scratch(1 << 14)
        tracemalloc.start()
        got = suffix_order(t, 200, scratch)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and scratch.files > 20
        assert peak < 40 * 8 * scratch.limit


def test_tuples_leave_the_queue_in_order():
    rng = np.random.default_rng(5)
    for limit in (7, 50, 10_000):
        for kinds in (1, 3, 1000):
            queue, a, b = TupleQueue(Scratch(limit)), rng.integers(0, kinds, 700), rng.integers(0, 3, 700)
            for i in range(0, 700, 31):
                queue.push(a[i : i + 31], b[i : i + 31], np.arange(i, min(700, i + 31)))
            got = [np.concatenate(c) for c in zip(*queue.pop())]
            by = np.lexsort((np.arange(700), b, a))
            assert (got[2] == by).all() and (got[0] == a[by]).all()


# -- 5 -----------------------------------------------------------------------------------------------------------------
MESSAGES = "conv_id long, node_id long, parent_id long, role string, text string, score double, turn int"


def test_chat_tree(spark):
    tree = [
        (1, 1, None, "user", "hi", 0.0, 9), (1, 2, 1, "assistant", "a <s>b</s> \\[INST] [/INST]", 2.0, 9), (1, 3, 1, "assistant", None, 1.0, 9), (1, 4, 2, "user", "x", None, 9),
        (1, 5, 3, "user", "y", 5.0, 9), (2, 1, 99, "system", "<<SYS>>", 0.0, 9), (3, 1, 2, "user", "round", 0.0, 9), (3, 2, 1, "user", "and round", 0.0, 9), (None, 1, None, None, "no tree id", 0.0, 9),
    ]
    df = spark.createDataFrame(tree, MESSAGES)
    out = {(r.conv_id, r.leaf): r for r in chat.read_back(chat.format_conversations(df, branches=5)).collect()}
    assert set(out) == {(1, 4), (1, 5), (2, 1), (None, 1)}  # a cycle has no root
    assert [tuple(t) for t in out[1, 4].turns] == [("user", "hi"), ("assistant", "a <s>b</s> \\[INST] [/INST]"), ("user", "x")]
    assert out[1, 4].loss_text == "a <s>b</s> \\[INST] [/INST]" and out[1, 5].loss_text == "" and out[1, 5].score == 6.0
    best = {r.conv_id: r.leaf for r in chat.format_conversations(df).collect()}
    assert best == {1: 5, 2: 1, None: 1}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_controls_never_survive(spark):
    hostile = ["".join(p) for p in __import__("itertools").product(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "[", "<"], repeat=2)]
    df = spark.createDataFrame([(i, 1, None, "user", t, 0.0, 0) for i, t in enumerate(hostile)], MESSAGES)
    out = chat.read_back(chat.format_conversations(df)).collect()
    assert {r.conv_id: r.turns[0].text for r in out} == dict(enumerate(hostile))
    assert all(r.formatted.count("[INST]") == 1 and r.formatted.count("<s>") == 1 and r.formatted.count("</s>") == 1 for r in out)


def test_chat_rows_without_conversation(spark):
    """Rows without conv_id are conversations of their own, however many."""
    rows = [(None, t, "assistant", f"said {t}") for t in range(50)] + [(1, 0, "user", "hi"), (None, 3, "assistant", "said 3")]
    out = chat.read_back(chat.format_conversations(chat.chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()
    assert len(out) == 52 and sorted(r.loss_text for r in out if r.conv_id is None) == sorted(r[3] for r in rows if r[0] is None)
    assert all(r.n_turns == 1 for r in out)


def test_chat_long_chain(spark):
    rows = [(7, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)] + [(7, 3, "assistant", "turn 3"), (7, None, "user", None)]
    c = chat.chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat.read_back(chat.format_conversations(c)).first()
    assert out.n_turns == 302 and out.turns[0].text == "" and out.turns[1].text == "turn 0"
    assert out.loss_text == "".join(f"turn {t}" * (2 if t == 3 else 1) for t in range(1, 300, 2))


# -- 6 -----------------------------------------------------------------------------------------------------------------
def test_brown(docs, rows, empty):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    tokens = [(i, words((t or "").translate(lower)) + [None]) for i, t, *_ in rows]
    out_ = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(x for i, w in tokens if not out_(i) for x in w)
    n, v = sum(c.values()), len(c)
    want = [(i, out_(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in tokens]
    out = brown.score_documents(docs).cache()
    same(out.withColumn("base", F.round("base_score", 6)), want, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base")
    sums = out.where("not held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1] and out.where("score >= 0").count() == 0
    assert brown.score_documents(empty).count() == 0
    alone = brown.score_documents(docs.where("doc_id is null")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in alone)


def test_brown_probabilities_sum_to_one():
    rng, k = np.random.default_rng(0), brown.CLASSES
    m, kinds = rng.integers(0, 50, (k, k)).astype(float), rng.integers(1, 9, k)
    context = brown.log_context(m, kinds, int(m.sum()), int(kinds.sum()))
    # known words have count + 1, and each class one unknown word
    class_part = (10**context - (1 - brown.MIX) / (m.sum() + kinds.sum() + 1)) * (m.sum(axis=0) + kinds + 1)
    assert np.allclose(class_part.sum(axis=1) / brown.MIX, 1)


def test_brown_scores_against_plain_loops(spark, docs, rows, monkeypatch):
    """From the classes that the fit found: class bigrams, likelihood, and each document's score, word by word."""
    seen = {}
    fit = brown.fit
    monkeypatch.setattr(brown, "fit", lambda blocks, *a: seen.setdefault("fit", (blocks, fit(blocks, *a)))[1])
    spark.conf.set("spark.lumenframe.block.bytes", "1500")
    try:
        got = brown.score_documents(docs).collect()
        blocks, (turns, m, kinds, said) = seen["fit"]
        state, columns = brown._state(blocks, turns)
        classes, texts = {}, []
        lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
        by_id = defaultdict(list)
        for i, t, *_ in rows:
            by_id[i].append(words((t or "").translate(lower)) + [None])
        for r in state.collect():
            t = brown.Tokens(_blocks.from_ipc(bytes(r.payload)))
            cls = t.classes(brown._of_turn(columns, [_blocks.codes_of([bytes(x) for x in r[c]] if r[c] else None) for c in columns]))[t.ids]
            for j, i in enumerate(t.doc_id.to_pylist()):
                own = cls[t.first[j] : t.first[j] + t.sizes[j]].tolist()
                text = next(w for w in by_id[i] if len(w) == len(own))
                for w, c in zip(text, own):
                    assert classes.setdefault(w, c) == c
                texts.append((i, text, bool(t.held[j])))
    finally:
        spark.conf.unset("spark.lumenframe.block.bytes")
    assert len(texts) == len(rows) and blocks.count() > 10 and classes[None] == 0
    count = Counter(w for _, t, held in texts if not held for w in t)
    pairs, size = Counter(), Counter()
    for _, t, held in texts:
        for a, b in zip([None, *t], t):
            if not held:
                pairs[classes[a], classes[b]] += 1
                size[classes[b]] += 1
    assert all(m[a, b] == pairs[a, b] for a in range(64) for b in range(64))
    f = lambda x: x * math.log(max(x, 1))
    assert math.isclose(said[-1], sum(map(f, pairs.values())) - 2 * sum(map(f, size.values())), rel_tol=1e-9)
    assert said == sorted(said) and said[-1] > said[0]
    n, v = sum(count.values()), len(count)
    of_class = Counter(classes[w] for w in count)
    assert all(kinds[c] == of_class[c] for c in range(64))
    before = Counter()
    for (a, _), x in pairs.items():
        before[a] += x

    def p(a, b, w):
        step = (pairs[a, b] + brown.PRIOR * (size[b] + 1) / (n + 64)) / (before[a] + brown.PRIOR)
        return brown.MIX * step * (count[w] + 1) / (size[b] + of_class[b] + 1) + (1 - brown.MIX) * (count[w] + 1) / (n + v + 1)

    want = sorted((repr(i), round(sum(math.log10(p(classes[a], classes[w], w)) for a, w in zip([None, *t], t)), 6)) for i, t, _ in texts)
    assert [(a, pytest.approx(b, abs=1e-5)) for a, b in want] == sorted((repr(r.doc_id), round(r.score, 6)) for r in got)


def test_words_move_to_their_best_class():
    """exchange against every class tried for one word alone, from the same counts."""
    rng, n, k = np.random.default_rng(3), 40, brown.CLASSES
    text = rng.integers(0, n, 3000)
    for w in range(n):
        text[1:][text[:-1] == w] = np.where(rng.random((text[:-1] == w).sum()) < 0.7, (w * 7 + 1) % n, text[1:][text[:-1] == w])
    own = 1 + rng.integers(0, k - 1, n)
    count = np.bincount(text, minlength=n).astype(float)
    pairs = np.zeros((n, n))
    np.add.at(pairs, (text[:-1], text[1:]), 1)
    onehot = np.eye(k)[own]
    right, left = pairs @ onehot, pairs.T @ onehot
    m, size = onehot.T @ pairs @ onehot, onehot.T @ count
    cells = [(w, side * brown.AFTER + c, x[w, c]) for w in range(n) for side, x in ((0, left), (1, right)) for c in range(k) if x[w, c]]
    word, code, many = map(np.array, zip(*cells))
    got = brown.exchange(word, code, many, own, count, m, size)
    f = lambda x: x * np.log(np.maximum(x, 1))
    for w in range(n):
        a, m1, s1 = own[w], m.copy(), size.copy()
        m1[a] -= right[w]
        m1[:, a] -= left[w]
        m1, s1[a] = np.maximum(m1, 0), s1[a] - count[w]
        gain = (f(m1 + right[w]) - f(m1)).sum(axis=1) + (f(m1 + left[w][:, None]) - f(m1)).sum(axis=0) - 2 * (f(s1 + count[w]) - f(s1))
        assert gain[got[w]] >= gain[1:].max() - 1e-6
    assert (got != own).sum() > n // 4


def test_every_training_word_is_clustered(spark):
    """Frequent and rare words of one shape, in different places, don't stay in one class; texts that were held out gain, too."""
    rng = random.Random(2)
    pick = lambda kind: f"{kind}{rng.randint(10, 59)}zz"
    df = spark.createDataFrame([(i, " ".join(f"the {pick('a')} of {pick('b')}" for _ in range(40))) for i in range(60)], "doc_id long, text string")
    score = [{r.held_out: r.s for r in brown.score_documents(df, rounds=n).groupBy("held_out").agg(F.sum("score").alias("s")).collect()} for n in (0, brown.ROUNDS)]
    held = sum(zlib.crc32(str(i).encode()) % 7 == 2 for i in range(60))
    assert score[1][True] - score[0][True] > 0.03 * held * 161 and score[1][False] - score[0][False] > 0.03 * (60 - held) * 161


# -- 7 -----------------------------------------------------------------------------------------------------------------
def slow_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(fps, radius):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash(docs, rows, empty):
    fps = [(i, slow_fingerprint(t)) for i, t, *_ in rows]
    root = reach({f for _, f in fps}, 4)
    low = defaultdict(lambda: None)
    for i, f in fps:
        if i is not None:
            low[root[f]] = i if low[root[f]] is None else min(i, low[root[f]])
    out = simhash.near_duplicate_groups(docs).withColumn("hex", F.lpad(F.lower(F.hex("fp")), 16, "0"))
    same(out, [(i, f"{f:016x}", low[root[f]]) for i, f in fps], "doc_id", "hex", "component_id")
    assert simhash.near_duplicate_groups(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def shingles(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept_of_groups(texts, similarity=0.8):
    """The smallest id of each group that pairs of this Jaccard similarity connect."""
    sets = sorted(set(map(shingles, texts.values())), key=lambda s: (len(s), repr(sorted(s))))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    at, low = {s: find(i) for i, s in enumerate(sets)}, {}
    for i, t in sorted(texts.items()):
        low.setdefault(at[shingles(t)], i)
    return set(low.values())


def test_near_duplicates(docs, rows):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    texts = {NO_ID - (0 if i else 1) if i is None else i: t for i, t, *_ in reversed(rows)}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(i for i in kept_of_groups(texts) if i < NO_ID - 5)
    assert all(r["n-words"] == 9 and r._id == 11 and r.tags == {"a": 1} for r in kept.collect())


def test_near_duplicates_recall(spark):
    """Pairs of a similarity around 0.8 and above, each alone: nearly all are found, and no other pair is joined."""
    rng, texts = random.Random(11), {}
    for i in range(300):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 200))]
        texts[2 * i] = " ".join(w)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = "other"
        texts[2 * i + 1] = " ".join(w)
    want = kept_of_groups(texts)
    got = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert want <= got and len(got - want) <= 0.1 * (600 - len(want)) and len(want) < 500


@pytest.mark.parametrize("pairs", [12, 60])
def test_all_that_share_a_variant_are_compared(spark, monkeypatch, pairs):
    """Texts whose fingerprints all meet, in a small group and in a crowd: only pairs are similar, and every one is joined."""
    rng, texts = random.Random(4), {}
    for i in range(pairs):
        w = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        texts[i], texts[pairs + i] = " ".join(w), " ".join([*w[:-1], "other"])
    monkeypatch.setattr(simhash, "plan_tables", lambda *a: (4, 1))
    got = simhash.drop_near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(pairs))


def test_candidates_are_all_pairs_within_the_radius(monkeypatch):
    """Parts of a run of variants each: pairs of a few that meet at once, of a crowd those of different roots afterwards."""
    rng, bits, b = np.random.default_rng(6), 16, 6
    x = np.concatenate([rng.integers(0, 2**bits, 300), np.repeat(rng.integers(0, 2**bits, 4), 40)]).astype(np.uint64)
    node, root = np.arange(len(x)), rng.integers(0, 5, len(x))
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", 1 << 8)
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 100)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)) if i < j}

    def met(make, *more):
        out = []
        for q in range(1 << b):
            mine = np.bitwise_count((x >> np.uint64(bits - b)) ^ np.uint64(q)) <= 2
            out += [p for u, v in make(x[mine], node[mine], *[m[mine] for m in more], q, b, bits, 2) for p in zip(u.tolist(), v.tolist())]
        return out

    found = met(simhash._paired)
    crowd = {u for u, v in found if u == v}
    assert 0 < len(crowd) < len(x) and {p for p in found if p[0] != p[1]} <= want
    assert {p for p in want if not set(p) <= crowd} <= set(found)
    apart = met(simhash._crossed, root)
    assert sorted(apart) == sorted(p for p in want if root[p[0]] != root[p[1]])  # each once
    monkeypatch.setattr(simhash, "FEW", len(x))
    assert sorted(met(simhash._paired)) == sorted(want)


def test_fingerprints_as_links_need():
    for n in (10, 10**5, 10**7, 10**10):
        bits, tables = simhash.plan_tables(n)
        met = n * sum(math.comb(bits, j) for j in range(5)) / 2**bits
        assert bits <= 64 and met <= 1 and 0.9 <= 1 - (1 - sum(math.comb(bits, j) * 0.1517**j * 0.8483 ** (bits - j) for j in range(5))) ** tables


def test_crowded_fingerprints_are_dealt_by_more_bits(spark, monkeypatch):
    fps = [5 << 40 | i for i in range(300)]
    df = spark.createDataFrame([(0, f, f) for f in fps], "tab int, fp long, node long")
    want = {frozenset(map(int, p)) for p in simhash.components(simhash.links(df)).select("node", "root").collect()}
    monkeypatch.setattr(simhash, "PART_ROWS", 64)
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", 1 << 12)
    assert simhash._prefix_bits(df, 300, 64, 2) > simhash.PREFIX
    assert {frozenset(map(int, p)) for p in simhash.components(simhash.links(df)).select("node", "root").collect()} == want


def test_links_of_random_balls(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for c in centres for k in (0, 1, 2, 3, 4, 5, 6) for _ in range(3)}
    df = spark.createDataFrame([(0, x, x) for x in (int(np.uint64(f).view(np.int64)) for f in fps)], "tab int, fp long, node long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = reach(fps, 4)
    groups = defaultdict(set)
    for f in fps:
        x = int(np.uint64(f).view(np.int64))
        groups[want[f]].add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "u long, v long")
    assert {r.node: r.root for r in simhash.components(edges).collect()} == dict.fromkeys(range(201), 0) | {1000: 1000, 1001: 1000}


def test_components_of_random_graphs(spark, monkeypatch):
    rng = random.Random(8)
    for n, m, at_once in ((400, 300, 1 << 20), (400, 380, 40), (50, 200, 8), (400, 300, 300)):
        monkeypatch.setattr(simhash, "EDGES_AT_ONCE", at_once)
        names = [rng.getrandbits(63) - 2**62 for _ in range(n)]
        edges = [(names[rng.randrange(n)], names[rng.randrange(n)]) for _ in range(m)]
        up = {x: x for e in edges for x in e}
        for _ in range(n):
            for u, v in edges:
                up[u] = up[v] = min(up[u], up[v])
        got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
        loops = {u for u, v in edges if u == v} - {x for u, v in edges if u != v for x in (u, v)}
        assert got == {x: y for x, y in up.items() if x not in loops}


def test_few_edges_need_no_round(spark, monkeypatch):
    wrote = []
    monkeypatch.setattr(simhash, "stash", lambda df, **more: wrote.append(1) or stash(df, **more))
    edges = spark.createDataFrame([(i, 7 * (i % 3)) for i in range(30, 90)] + [(100 + i, 101 + i) for i in range(40)], "u long, v long").repartition(7)
    assert {r.root for r in simhash.components(edges).collect()} == {0, 7, 14, 100}
    assert len(wrote) == 2


# -- 8 -----------------------------------------------------------------------------------------------------------------
def test_decontamination(spark, docs, rows, empty):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    own = [(i, pattern.findall((t or "").translate(lower))) for i, t, *_ in rows]
    items = [("7", " ".join(own[5][1][-40:-10])), ("7", "the of"), ("8", "Short One"), ("10", None), ("11", "!!"), (None, " ".join(own[11][1][2:13])), ("12", "loop " * 12), ("13", " ".join(own[20][1][:9] + ["never"]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = defaultdict(set)
    for k, t in items:
        w = pattern.findall((t or "").translate(lower))
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add("null" if k is None else k)
    want = []
    for i, w in own:
        hit, met = set(), set()
        for k, names in windows.items():
            for j in range(len(w) - len(k) + 1):
                if tuple(w[j : j + len(k)]) == k:
                    hit |= set(range(j, j + len(k)))
                    met |= names
        want.append((i, len(w), len(hit), len(met), sha(",".join(sorted(met))), bool(hit)))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sum(w[5] for w in want) > 5
    same(decontaminate.contamination(docs, bench), want, *columns)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(decontaminate, "ITEMS_AT_ONCE", 1)  # each text in several rows
        same(decontaminate.contamination(docs, bench), want, *columns)
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not w[5] for w in want)
    assert all(r["my col"] == "spaced" and r.tags == {"a": 1} for r in clean.collect())
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.drop_contaminated(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


# -- 9 -----------------------------------------------------------------------------------------------------------------
def test_language_gradients():
    net = langid.ByteGRU(["a", "b", "c"], hidden=3, seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 5, (6, 4)), np.array([0, 1, 2, 1])
    _, grads = net.gradients(x, y)
    for name, g in grads.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in g.shape)
            keep, e = net.w[name][at], 1e-4
            sides = []
            for d in (e, -e):
                net.w[name][at] = keep + d
                sides.append(net.gradients(x, y)[0])
            net.w[name][at] = keep
            assert abs((sides[0] - sides[1]) / (2 * e) - g[at]) < 1e-3


def test_language_scoring_covers_every_position():
    net = langid.ByteGRU(["a", "b"], seed=3)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 122, n, dtype=np.uint8)) for n in (0, 1, 127, 128, 129, 700)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    p = net.pooled(data, offsets)
    assert np.allclose(p.sum(axis=1), [0, 1, 1, 1, 1, 1], atol=1e-5)
    x = np.frombuffer(texts[3], np.uint8).astype(np.intp)[:, None]
    assert np.allclose(p[3], net.positions(x).mean(axis=(0, 2)), atol=1e-5)


def test_language_sample_counts_usable_rows(spark):
    """Rows without a letter thin nothing out; a language that has none with one is not learned."""
    rows = [(i, "some words" if i < 100 else "12345", "xx" if i < 20_000 else "yy") for i in range(60_000)]
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {(r.lang, r["count"]) for r in got.groupBy("lang").count().collect()} == {("xx", 100)}


def test_language_sample_keeps_every_language(spark):
    rows = [(i, "some words", f"l{i % 500}") for i in range(5000)]
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), total=1000).groupBy("lang").count().collect()
    assert len(got) == 500 and all(1 <= r["count"] <= 2 for r in got)


def test_language_scores_against_plain_loops():
    net = langid.ByteGRU(["a", "b", "c"], hidden=4, seed=5)
    rng = np.random.default_rng(2)
    for d in "fb":
        net.w[f"b{d}"] = rng.standard_normal(4).astype(np.float32)
    net.w["c"] = rng.standard_normal(3).astype(np.float32)
    text = bytes(rng.integers(97, 122, langid.SPAN, dtype=np.uint8))
    sigmoid = lambda v: 1 / (1 + math.exp(-v))

    def run(d, order):
        h, out = [0.0] * 4, {}
        for t in order:
            e = net.w[f"e{d}"][text[t]]
            rec = [sum(h[i] * float(net.w[f"u{d}"][i, j]) for i in range(4)) for j in range(12)]
            z = [sigmoid(e[j] + rec[j]) for j in range(4)]
            r = [sigmoid(e[4 + j] + rec[4 + j]) for j in range(4)]
            c = [math.tanh(e[8 + j] + r[j] * (rec[8 + j] + float(net.w[f"b{d}"][j]))) for j in range(4)]
            h = [z[j] * h[j] + (1 - z[j]) * c[j] for j in range(4)]
            out[t] = h
        return out

    f, b, total = run("f", range(langid.SPAN)), run("b", reversed(range(langid.SPAN))), np.zeros(3)
    for t in range(langid.SPAN):
        logits = [sum(x * float(net.w["v"][i, k]) for i, x in enumerate(f[t] + b[t])) + float(net.w["c"][k]) for k in range(3)]
        e = np.exp(np.array(logits) - max(logits))
        total += e / e.sum()
    assert np.allclose(net.pooled(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0], total / langid.SPAN, atol=1e-4)


def test_language(docs, rows, empty):
    out = langid.identify(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    by = defaultdict(set)
    for r in out:
        by[r.doc_id].add(r.lang_pred)
    assert by[130] == by[131] == by[132] == by[133] == {"und"} and len({tuple(by[i]) for i in (4, 100, 101, 102, 103)}) == 1
    good = [r.lang_pred == rows[r.doc_id - 1][2] for r in out if r.doc_id is not None and r.doc_id < 70 and r.held_out]
    assert np.mean(good) > 0.9
    kept = langid.reject_unknown_language(docs)
    assert kept.columns == docs.columns and not {130, 131, 132, 133} & {r.doc_id for r in kept.collect()}
    assert all(r["my col"] == "spaced" and r.score == "clash" and r.tags == {"a": 1} for r in kept.collect())
    assert langid.identify(empty).count() == 0 and langid.reject_unknown_language(empty).count() == 0


# -- 10 ----------------------------------------------------------------------------------------------------------------
def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_lines(docs, rows, empty):
    every = sorted((NO_ID if i is None else i, n, tuple(words(x))) for i, t, *_ in rows for n, x in enumerate((t or "").split("\n")))
    every = [x for x in every if x[2]]
    gone = set()
    for k, (i, n, w) in enumerate(every):
        for j, m, v in every[:k]:
            if (j, m) < (i, n) and (v == w or (max(len(v), len(w)) >= 5 and abs(len(v) - len(w)) < 2 and edits(v, w) <= 1)):
                gone.add((i, n))
                break
    want = []
    for i, t, *_ in rows:
        own = [] if t is None else t.split("\n")
        left = [x for n, x in enumerate(own) if (NO_ID if i is None else i, n) not in gone]
        want.append((i, len(own), len(own) - len(left), sha("\n".join(left))))
    assert len(gone) > 20
    same(lines.dedup_lines(docs), want, "doc_id", "n_lines", "n_removed", "kept_sha256")
    kept = lines.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.score == "clash" and r.n_words == -1 and r["a.b"] == 10 for r in kept.collect())
    assert lines.dedup_lines(empty).count() == 0 and lines.drop_repeated_lines(empty).count() == 0


def test_lines_of_every_length_against_all_pairs(spark):
    """Random lines of 1 to 12 words over few words, with equal ones and ones an edit or two away: each decision is right."""
    rng, rows = random.Random(9), []
    for i in range(120):
        w = [rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 12))]
        rows.append(list(w))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w)) :][:1] = rng.choice([[], ["z"], ["y", "z"]]) or []
            if rng.random() < 0.5:
                w.insert(rng.randrange(len(w) + 1), rng.choice("abcz"))
            else:
                del w[rng.randrange(len(w))]
            if w:
                rows.append(list(w))
            else:
                break
    want = [any(v == w or (max(len(v), len(w)) >= 5 and edits(v, w) <= 1) for v in rows[:k]) for k, w in enumerate(rows)]
    got = lines.dedup_lines(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [bool(r.n_removed) for r in got] == want and 30 < sum(want) < len(rows) - 30
    pairs = [(v, w) for v in rows[:80] for w in rows[:80]]
    assert all(lines.within_an_edit(v, w) == (edits(v, w) <= 1) for v, w in pairs)


def test_lines_edit_kinds(spark):
    base = "one two three four five six seven eight nine ten eleven"
    near = [base.replace("five", "5"), base.replace("one ", ""), base + " twelve", "zero " + base, base.replace("six", "six six")]
    far = [base.replace("one", "1").replace("ten", "10"), " ".join(reversed(base.split())), base.replace("two three", "three two")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([base, *near, *far])], "doc_id long, text string")
    assert [r.n_removed for r in lines.dedup_lines(df).orderBy("doc_id").collect()] == [0] + [1] * len(near) + [0] * len(far)


# -- blocks ------------------------------------------------------------------------------------------------------------
def test_blocks_keep_every_row(docs, rows):
    blocks = _blocks.to_blocks(docs, limit=2000)
    assert blocks.count() > 10 and blocks.select("block_id").distinct().count() == blocks.count()
    got = [tuple(r) for p in blocks.collect() for r in zip(*_blocks.from_ipc(bytes(p.payload)).to_pydict().values())]
    assert Counter(got) == Counter((i, t) for i, t, *_ in rows)


def test_stashes_can_be_dropped(spark):
    df = stash(spark.range(3))
    assert df.count() == 3 and forget(spark) >= 1 and forget(spark) == 0
    with pytest.raises(Exception):
        df.count()


def test_packing():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**64, 100, dtype=np.uint64))
    col = np.arange(100, dtype=np.uint16)
    k, (c,) = _blocks.unpack(_blocks.pack(keys, [col]), ["u2"])
    assert (k == keys).all() and (c == col).all()


def test_shards_of_small_groups_need_no_files():
    from lumenframe.llm.exact_bytes import _shards
    from lumenframe.llm.suffix import IN_MEMORY

    sizes, group = [1000] * 3000, np.arange(3000) // 2
    shards = list(_shards(np.arange(3000), group, sizes))
    assert sorted(sum(shards, [])) == list(range(3000)) and all(a % 2 == 0 for a, *_ in shards)
    assert max(sum(sizes[i] + 1 for i in some) for some in shards) <= IN_MEMORY
