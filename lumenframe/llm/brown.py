"""LM scoring with a class-based bigram model (Brown et al.), its classes found by exchange."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from ._blocks import BLOCK_BYTES, _cut, _to_ipc, by_block, codes_of, deal, distinct, finish, from_ipc, pack, part_of_keys, parts_of, send_keys, squeeze, unpack, with_answers
from ._shared import stash, table
from ._text import U64, Words, release

#: Class 0 holds the end of a text alone.
CLASSES = 64
#: In a round, half of the words may move; two rounds give each word a turn.
ROUNDS = 4
#: In a round, words move in so many runs; each run sees what the runs before it changed.
WAVES = 16
#: Weight of the class model against the add-one unigram.
MIX = 0.8
PRIOR = 5.0
END = np.uint64(1)
#: Of an entry of a word: up to 63 the class before it, up to 127 the class after it, then its own class.
AFTER, OWN = 64, 128
#: Entries whose gains are weighed at once.
AT_ONCE = 1 << 13


def _held_out(table_: pa.Table, remainder: int, modulus: int) -> np.ndarray:
    return np.array([x is None or zlib.crc32(str(x).encode()) % modulus == remainder for x in table_["doc_id"].to_pylist()], dtype=bool)


def _shrink(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes())


def _grow(blob: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def first_class(last_byte: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The class in which a word starts, by its shape. Words that were not learned stay there."""
    return (1 + (last_byte.astype(np.int64) * 7 + np.minimum(length, 12)) % (CLASSES - 1)).astype(np.uint8)


def _encode(batches, limit: int, remainder: int, modulus: int):
    """Blocks of texts as tokens: the distinct keys of a block, each token as the number of its key, and where texts start.

    Tokens are the words with A-Z lower-cased, then one end for each text.
    """
    for b in _cut(batches, limit):
        t = from_ipc(b.column("payload")[0].as_py())
        w = Words(t["text"], lower=True)
        n, rows = len(w), len(w.first) - 1
        first = w.first[:-1] + np.arange(rows)
        hashes, start = np.full(n + rows, END), np.zeros(n + rows, np.uint8)
        at = np.arange(n) + w.row
        hashes[at] = w.hash
        if n:
            start[at] = first_class(w.data[w.end - 1], w.end - w.start)
        one, ids = distinct(hashes)
        cells = {
            "keys": pack(hashes[one], [start[one]]),
            "ids": _shrink(ids.astype(np.uint32)),
            "first": _shrink(first.astype(np.uint32)),
            "held": _shrink(_held_out(t, remainder, modulus).astype(np.uint8)),
            "doc_id": _to_ipc(t.select(["doc_id"])),
        }
        yield pa.RecordBatch.from_arrays([b.column("block_id"), pa.array([_to_ipc(pa.table({k: pa.array([v], pa.binary()) for k, v in cells.items()}))], pa.binary())], names=["block_id", "payload"])
        release()


class Tokens:
    """What _encode wrote of a block, and later the words' global numbers (leading bits: the part) and counts."""

    def __init__(self, t: pa.Table):
        get = lambda name, dtype: _grow(t[name][0].as_py(), dtype)
        self.keys, (self.start, *more) = unpack(t["keys"][0].as_py(), ["u1", "u4"] if "counted" in t.column_names else ["u1"])
        self.count = more[0] if more else None
        self.ids, self.first = get("ids", np.uint32).astype(np.int64), get("first", np.uint32).astype(np.int64)
        self.held, self.doc_id = get("held", np.uint8) > 0, from_ipc(t["doc_id"][0].as_py())["doc_id"]
        self.sizes = np.diff(np.append(self.first, len(self.ids)))
        self.train = ~np.repeat(self.held, self.sizes)

    def classes(self, turns: list[np.ndarray]) -> np.ndarray:
        """The class of each key: that of its last turn, or the one in which it starts; turns: of even and of odd words."""
        out = self.start.copy()
        for parity, codes in enumerate(turns):
            if len(codes):
                out[np.flatnonzero((self.keys & U64(1)) == parity)] = codes
        return out

    def training(self, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the training tokens: key, class, and the class before."""
        ids = self.ids[self.train]
        own = cls[ids].astype(np.int64)
        return ids, own, np.concatenate([[0], own[:-1]])[: len(own)]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(m: np.ndarray) -> float:
    """What the classes add to the log likelihood of the texts, but for a constant; m: class bigrams."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(axis=1)).sum() - _xlogx(m.sum(axis=0)).sum())


def exchange(word: np.ndarray, code: np.ndarray, n: np.ndarray, own: np.ndarray, count: np.ndarray, m: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The class of each word that raises the likelihood of the class bigrams ``m`` most, all other words staying.

    word, code, n: how often each word (ascending) has a class before it (code: the class) or after it (AFTER + class).
    own, count: class and tokens of each word. size: tokens of each class.
    """
    out, k = own.copy(), CLASSES
    first = np.searchsorted(word, np.arange(len(own) + 1))
    lo = 0
    while lo < len(own):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + AT_ONCE, side="right")) - 1)
        e = slice(first[lo], first[hi])
        w, c, r = word[e] - lo, code[e] % AFTER, n[e].astype(np.float64)
        after = code[e] >= AFTER
        a = own[lo:hi]
        x = np.where(after[:, None], m.T[c], m[c])
        x[np.arange(len(w)), a[w]] -= r
        # neighbours in the word's own class: their column or row has lost the word, too
        some, at = np.unique(w[c == a[w]], return_inverse=True)
        if len(some):
            place = np.full(hi - lo, -1)
            place[some] = np.arange(len(some))
            dense = np.zeros((len(some), 2, k))
            has = place[w] >= 0
            dense[place[w[has]], after[has].astype(int), c[has]] = r[has]
            here = np.flatnonzero(c == a[w])
            x[here] -= dense[at, 1 - after[here].astype(int)]
        np.maximum(x, 0, out=x)
        gain = np.zeros((hi - lo, k))
        if len(w):
            starts = np.flatnonzero(np.diff(w, prepend=-1))
            gain[w[starts]] = np.add.reduceat(_xlogx(x + r[:, None]) - _xlogx(x), starts)
        left = np.repeat(size[None, :], hi - lo, axis=0)
        left[np.arange(hi - lo), a] = np.maximum(size[a] - count[lo:hi], 0)
        gain -= 2 * (_xlogx(left + count[lo:hi, None]) - _xlogx(left))
        best = np.argmax(gain[:, 1:], axis=1) + 1
        rows = np.arange(hi - lo)
        out[lo:hi] = np.where(gain[rows, best] > gain[rows, a] + 1e-9, best, a)
        lo = hi
    return out


def move(cell: np.ndarray, many: np.ndarray, own: np.ndarray, count: np.ndarray, m: np.ndarray, parts: int) -> np.ndarray:
    """New classes of the words of one part: WAVES runs of exchange, each from the class bigrams that the runs before it left.

    cell: word * OWN + code (ascending), many: how often. The words of a part are drawn by hash: what the rarer ones
    change, all parts together change in about the same way, so it counts ``parts`` times; what a frequent one does, it
    does alone.
    """
    new, m = own.copy(), m.copy()
    size = m.sum(axis=0)
    total = size.sum()
    has = np.zeros(len(own), dtype=bool)
    has[cell // OWN] = True
    for wave in range(WAVES):
        some = np.flatnonzero(has & (np.arange(len(own)) % WAVES == wave))
        e = np.flatnonzero((cell // OWN) % WAVES == wave)
        w, c, r = np.searchsorted(some, cell[e] // OWN), cell[e] % OWN, many[e].astype(np.float64)
        new[some] = exchange(w, c, r, own[some], count[some], m, size)
        scale = np.clip(total / (100 * np.maximum(count[some], 1)), 1, parts)
        ahead = c >= AFTER
        for cls, sign in ((own[some], -scale), (new[some], scale)):
            np.add.at(m, (cls[w[ahead]], c[ahead] - AFTER), (sign[w] * r)[ahead])
            np.add.at(m, (c[~ahead], cls[w[~ahead]]), (sign[w] * r)[~ahead])
            size += np.bincount(cls, weights=sign * count[some], minlength=CLASSES)
        np.maximum(m, 0, out=m)
        np.maximum(size, 0, out=size)
    return new


def log_context(m: np.ndarray, kinds: np.ndarray, tokens: int, words: int) -> np.ndarray:
    """(class before, class): log10 of the factor that a word's count + 1 has in its probability.

    p(class | class before), smoothed by the classes' shares, times the add-one estimate of the word within its class,
    mixed with the add-one unigram. kinds: words of each class; tokens, words: of the training texts.
    """
    size = m.sum(axis=0)
    prior = (size + 1) / (size.sum() + CLASSES)
    step = (m + PRIOR * prior) / (m.sum(axis=1, keepdims=True) + PRIOR)
    return np.log10(MIX * step / (size + kinds + 1) + (1 - MIX) / (tokens + words + 1))


def _state(blocks: DataFrame, turns: list[DataFrame | None]) -> tuple[DataFrame, list[str]]:
    """The blocks with the classes that were found: columns of even and odd words, as far as there are."""
    known = [(f"turn{i}", t) for i, t in enumerate(turns) if t is not None]
    return with_answers(blocks, *[t for _, t in known]), [c for c, _ in known]


def _of_turn(columns: list[str], codes) -> list[np.ndarray]:
    by = dict(zip(columns, codes))
    return [by.get(f"turn{i}", np.zeros(0, np.uint8)) for i in range(2)]


def _bigrams(blocks: DataFrame, turns: list) -> np.ndarray:
    """The class bigrams of all training texts: a small matrix from each task, summed by Spark in two levels."""
    state, columns = _state(blocks, turns)

    def count(batches):
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                t = Tokens(from_ipc(b.column("payload")[i].as_py()))
                _, own, before = t.training(t.classes(_of_turn(columns, [codes_of(b.column(c)[i].as_py()) for c in columns])))
                total += np.bincount(before * CLASSES + own, minlength=CLASSES * CLASSES)
                release()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["cell", "n"])

    out = np.zeros(CLASSES * CLASSES)
    for r in state.select("payload", *columns).mapInArrow(count, "cell int, n long").groupBy("cell").sum("n").collect():  # at most CLASSES ** 2
        out[r[0]] = r[1]
    return out.reshape(CLASSES, CLASSES)


def _move(blocks: DataFrame, turns: list, parity: int, m: np.ndarray, parts: int) -> tuple[DataFrame, np.ndarray]:
    """A round: (block_id, turn) of the words of this parity, and how many words each class has then.

    Each part of the key space gets the (word, neighbour class) counts of its words from all blocks, and chooses their
    classes from the class bigrams ``m``.
    """
    state, columns = _state(blocks, turns)

    def emit(t: pa.Table, *codes):
        tokens = Tokens(t)
        cls = tokens.classes(_of_turn(columns, codes))
        ids, own, before = tokens.training(cls)
        moves = (tokens.keys & U64(1)) == parity
        here, ahead = moves[ids], moves[ids[:-1]]
        seen, n = np.unique(np.concatenate([ids[here] * 256 + before[here], ids[:-1][ahead] * 256 + AFTER + own[1:][ahead]]), return_counts=True)
        mine = np.flatnonzero(moves)
        seen = np.concatenate([seen, mine * 256 + OWN + cls[mine]])
        n = np.concatenate([n, np.bincount(ids, minlength=len(cls))[mine]])
        by = np.argsort(seen, kind="stable")
        return tokens.keys[seen[by] >> 8], [(seen[by] & 255).astype(np.uint8), n[by].astype(np.uint32)]

    def answer(group: pa.Table) -> pa.Table:
        keys, (code, n), sizes = part_of_keys(group, ["u1", "u4"])
        _, word = distinct(keys)
        mine = code >= OWN
        words = int(word.max()) + 1 if len(word) else 0
        own = np.zeros(words, np.int64)
        own[word[mine]] = code[mine].astype(np.int64) - OWN
        count = np.bincount(word[mine], weights=n[mine], minlength=words)
        free = own[word] > 0  # the end stays alone
        cell, at = np.unique(word[~mine & free] * OWN + code[~mine & free], return_inverse=True)
        new = move(cell, np.bincount(at, weights=n[~mine & free], minlength=len(cell)), own, count, m, parts)
        cuts = np.cumsum([0, *sizes])
        blobs = [squeeze(new[word[a:b][mine[a:b]]].astype(np.uint8)) for a, b in zip(cuts, cuts[1:])]
        kinds = np.bincount(new[count > 0], minlength=CLASSES).astype(np.int64)
        part = group["part"][0].as_py()
        release()
        return pa.table({"block_id": pa.array([*group["block_id"].to_pylist(), -1], pa.int64()), "part": pa.array([part] * (len(blobs) + 1), pa.int32()), "blob": pa.array([*blobs, kinds.tobytes()], pa.binary())})

    replies = deal(send_keys(state, emit, parts, columns), parts).applyInArrow(answer, "block_id long, part int, blob binary")
    both = by_block(replies, f"turn{parity}")
    kinds = sum((np.frombuffer(bytes(x), np.int64) for r in both.where("block_id < 0").collect() for x in r[1]), np.zeros(CLASSES, np.int64))
    return both.where("block_id >= 0"), kinds


def _counted(blocks: DataFrame, parts: int) -> tuple[DataFrame, int, int, np.ndarray]:
    """The blocks with words as global numbers and counts; training tokens, words, and words of each class by parity."""
    shift = U64(64 - parts.bit_length() + 1)

    def emit(t: pa.Table):
        tokens = Tokens(t)
        n = np.bincount(tokens.ids[tokens.train], minlength=len(tokens.keys)).astype(np.uint32)
        return tokens.keys, [n, np.where(tokens.keys == END, 0, tokens.start).astype(np.uint8)]

    def number(group: pa.Table) -> pa.Table:
        keys, (n, start), sizes = part_of_keys(group, ["u4", "u1"])
        first, word = distinct(keys)
        total = np.bincount(word, weights=n, minlength=len(first)).astype(np.int64)
        cuts = np.cumsum([0, *sizes])
        blobs = [pack(word[a:b].astype(np.uint64), [np.minimum(total[word[a:b]], 2**32 - 1).astype(np.uint32)]) for a, b in zip(cuts, cuts[1:])]
        learned = total > 0
        kinds = np.bincount(np.arange(len(first))[learned] % 2 * CLASSES + start[first[learned]], minlength=2 * CLASSES)
        sums = np.concatenate([[total.sum(), learned.sum()], kinds]).astype(np.int64)
        part = group["part"][0].as_py()
        release()
        return pa.table({"block_id": pa.array([*group["block_id"].to_pylist(), -1], pa.int64()), "part": pa.array([part] * (len(blobs) + 1), pa.int32()), "blob": pa.array([*blobs, sums.tobytes()], pa.binary())})

    replies = by_block(deal(send_keys(blocks, emit, parts), parts).applyInArrow(number, "block_id long, part int, blob binary"), "words")
    sums = sum((np.frombuffer(bytes(x), np.int64) for r in replies.where("block_id < 0").collect() for x in r[1]), np.zeros(2 + 2 * CLASSES, np.int64))

    def renumber(batches):
        for b in batches:
            for block, payload, words in zip(b.column("block_id"), b.column("payload"), b.column("words")):
                t = from_ipc(payload.as_py())
                keys, (start,) = unpack(t["keys"][0].as_py(), ["u1"])
                got = [unpack(x.as_py(), ["u4"]) for x in words]
                numbers = np.concatenate([k for k, _ in got]) + (keys >> shift << shift if parts > 1 else U64(0))
                start = np.where(keys == END, 0, start).astype(np.uint8)
                cells = {c: t[c] for c in t.column_names} | {"keys": pa.array([pack(numbers, [start, np.concatenate([c for _, (c,) in got])])], pa.binary()), "counted": pa.array([b""], pa.binary())}
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([_to_ipc(pa.table(cells))], pa.binary())], names=["block_id", "payload"])
                release()

    out = stash(with_answers(blocks, replies.where("block_id >= 0")).mapInArrow(renumber, "block_id long, payload binary"), replaces=blocks, by="block_id")
    return out, int(sums[0]), int(sums[1]), sums[2:].reshape(2, CLASSES)


def fit(blocks: DataFrame, parts: int, rounds: int, kinds: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, list[float]]:
    """Classes (of even and odd words), class bigrams, words of each class, and the likelihood after each round.

    A round in which the likelihood fell, as words that move side by side don't see each other, is taken back.
    """
    turns, kinds = [None, None], list(kinds)
    m = _bigrams(blocks, turns)
    said = [likelihood(m)]
    for step in range(rounds):
        parity = step % 2
        turn, of_turn = _move(blocks, turns, parity, m, parts)
        tried = [turn if i == parity else t for i, t in enumerate(turns)]
        new = _bigrams(blocks, tried)
        if likelihood(new) > said[-1]:
            turns, m, kinds[parity] = tried, new, of_turn
        said.append(likelihood(m))
    return turns, m, kinds[0] + kinds[1], said


def score_documents(docs: DataFrame, remainder: int = 2, modulus: int = 7, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text).

    Learns from the rows whose crc32(doc_id as text) mod ``modulus`` is not ``remainder``. Tokens: words
    [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end. Words are counted over all training texts. Every training word,
    frequent or rare, gets its class by exchange: in ``rounds`` rounds half of the words, by turns, go to the class that
    raises the likelihood of the class bigrams of all training texts most; words start in classes by their shape (last
    byte, length), and words that were not learned stay there. A token's probability mixes p(class | class before) *
    p(word | class), add-one within each class, with the add-one unigram of the base; score sums its log10.

    Null or empty text: only the end. Null doc_id: held out. Repeated rows: each counts and gets a row. Very long texts
    are read whole. Empty table: no rows. Without training tokens every count is 0. Other columns are not read. Words are
    told apart by 64-bit hashes.
    """
    limit = int(docs.sparkSession.conf.get("spark.lumenframe.block.bytes", str(BLOCK_BYTES)))
    narrow = docs.selectExpr("CAST(doc_id AS long) AS doc_id", "CAST(text AS string) AS text")
    blocks = stash(narrow.mapInArrow(lambda it: _encode(it, limit, remainder, modulus), "block_id long, payload binary"), by="block_id")
    parts = parts_of(blocks)
    blocks, tokens, words, kinds = _counted(blocks, parts)
    turns, m, kinds, _ = fit(blocks, parts, rounds if tokens else 0, kinds)
    context = log_context(m, kinds, tokens, words)
    state, columns = _state(blocks, turns)

    def make(t: pa.Table, *codes) -> pa.RecordBatch:
        own = Tokens(t)
        cls = own.classes(_of_turn(columns, codes))[own.ids].astype(np.int64)
        c = own.count[own.ids].astype(np.float64)
        before = np.concatenate([[0], cls[:-1]])[: len(cls)]
        before[own.first] = 0
        rows = len(own.first)
        per_text = lambda x: np.add.reduceat(x, own.first) if rows else np.zeros(0)
        emitted = per_text(np.log10(c + 1))
        base = emitted - own.sizes * np.log10(tokens + words + 1)
        score = emitted + per_text(context[before, cls])
        columns_ = [own.doc_id.combine_chunks() if isinstance(own.doc_id, pa.ChunkedArray) else own.doc_id, pa.array(own.held), pa.array(own.sizes, pa.int64()), pa.array(per_text((c > 0).astype(np.int64)), pa.int64()), pa.array(np.full(rows, tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
        return pa.RecordBatch.from_arrays(columns_, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return finish(state, make, schema, columns)


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_documents of documents, a row each; nulls, ties and repeated rows as stated there."""
    return score_documents(table(spark, sf_dir, "documents"))
