"""Language ID: a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import aside, quoted, restored, small_batches, table, with_fields
from ._text import release, slices, string_bytes

HIDDEN = 8
#: Positions that the network runs over at once; texts are cut into so long pieces, every position belongs to one.
SPAN = 128
PIECES = 512
#: The fit sees at most so many texts a language, so many in all (one a language at least), and so many characters of each,
#: from a place drawn by its hash.
SAMPLE_TEXTS = 400
SAMPLE_TOTAL = 100_000
SAMPLE_CHARS = 1000
#: The counts of up to so many languages go to every task; more are joined.
MOST_BROADCAST = 10_000
UNKNOWN = "und"


class ByteGRU:
    """Weights: input tables e (256 x 3H), recurrent u (H x 3H), candidate's bias b, for both directions; output v, c."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden

        def init(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.w = {"v": init(2 * hidden, len(labels), scale=0.3), "c": np.zeros(len(labels), np.float32)}
        for d in "fb":
            self.w |= {f"e{d}": init(256, 3 * hidden, scale=0.3), f"u{d}": init(hidden, 3 * hidden, scale=0.3), f"b{d}": np.zeros(hidden, np.float32)}

    # -- forward, for scoring: arrays lie as (units, pieces), so that every step runs over contiguous rows -----------
    def _halved(self, d: str):
        """sigmoid(a) = (1 + tanh(a / 2)) / 2: the halves are taken from the weights once."""
        scale = np.concatenate([np.full(2 * self.hidden, 0.5, np.float32), np.ones(self.hidden, np.float32)])
        return np.ascontiguousarray((self.w[f"e{d}"] * scale).T), np.ascontiguousarray((self.w[f"u{d}"] * scale).T), self.w[f"b{d}"][:, None]

    def _run(self, x: np.ndarray, d: str) -> np.ndarray:
        """(span, hidden, n): states of every position of x (span, n)."""
        span, n = x.shape
        k = self.hidden
        e, u, b = self._halved(d)
        out = np.empty((span, k, n), np.float32)
        h, a, g = np.zeros((k, n), np.float32), np.empty((3 * k, n), np.float32), np.empty((3 * k, n), np.float32)
        z, r, q = a[:k], a[k : 2 * k], a[2 * k :]
        for t in range(span) if d == "f" else range(span - 1, -1, -1):
            np.matmul(u, h, out=a)
            np.take(e, x[t], axis=1, out=g, mode="clip")
            zr = a[: 2 * k]
            zr += g[: 2 * k]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            q += b
            q *= r
            q += g[2 * k :]
            np.tanh(q, out=q)
            new = out[t]
            np.subtract(h, q, out=new)
            new *= z
            new += q
            h = new
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """(span, labels, n): probabilities of every position of x (span, n)."""
        k = self.hidden
        logits = np.matmul(np.ascontiguousarray(self.w["v"][:k].T), self._run(x, "f"))
        logits += np.matmul(np.ascontiguousarray(self.w["v"][k:].T), self._run(x, "b"))
        logits += self.w["c"][None, :, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities over all byte positions of each text (zeros for an empty one)."""
        length = np.diff(offsets)
        pieces = -(-length // SPAN)
        doc = np.repeat(np.arange(len(length)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        own = nth * SPAN
        # the last piece of a long text reaches back into the one before; its positions there don't count twice
        start = np.minimum(own, np.maximum(length[doc] - SPAN, 0))
        sums = np.zeros((len(length), len(self.labels)))
        padded = np.concatenate([data, np.full(SPAN, 0x20, np.uint8)])
        step = np.arange(SPAN)
        for a in range(0, len(doc), PIECES):
            i = slice(a, a + PIECES)
            at = start[i][:, None] + step[None, :]
            inside = at < length[doc[i]][:, None]
            x = np.where(inside, padded[offsets[doc[i]][:, None] + at], np.uint8(0x20))
            p = self.positions(np.ascontiguousarray(x.T).astype(np.intp))
            counts = inside & (at >= own[i][:, None])
            np.add.at(sums, doc[i], (p * counts.T.astype(np.float32)[:, None, :]).sum(axis=0).T)
        return sums / np.maximum(length, 1)[:, None]

    # -- backpropagation through time ----------------------------------------------------------------------------
    def _forward(self, x, d):
        k, (span, n) = self.hidden, x.shape
        e, u, b = self.w[f"e{d}"], self.w[f"u{d}"], self.w[f"b{d}"]
        h, steps = np.zeros((n, k), np.float32), {}
        for t in range(span) if d == "f" else range(span - 1, -1, -1):
            rec, g = h @ u, e[x[t]]
            zr = 1 / (1 + np.exp(-(g[:, : 2 * k] + rec[:, : 2 * k])))
            q = rec[:, 2 * k :] + b
            c = np.tanh(g[:, 2 * k :] + zr[:, k:] * q)
            new = c + zr[:, :k] * (h - c)
            steps[t] = (h, zr, q, c)
            h = new
            steps[t] += (h,)
        return steps

    def _backward(self, x, d, steps, grad_h):
        k, (span, n) = self.hidden, x.shape
        u = self.w[f"u{d}"]
        gu, gb, ge = np.zeros_like(u), np.zeros(k, np.float32), np.empty((span, n, 3 * k), np.float32)
        carry = np.zeros((n, k), np.float32)
        for t in range(span - 1, -1, -1) if d == "f" else range(span):
            h, zr, q, c, _ = steps[t]
            z, r = zr[:, :k], zr[:, k:]
            dh = grad_h[t] + carry
            da = ge[t]
            da[:, 2 * k :] = dh * (1 - z) * (1 - c * c)
            da[:, :k] = dh * (h - c) * z * (1 - z)
            da[:, k : 2 * k] = da[:, 2 * k :] * q * r * (1 - r)
            rec = np.concatenate([da[:, : 2 * k], da[:, 2 * k :] * r], axis=1)
            gu += h.T @ rec
            gb += rec[:, 2 * k :].sum(axis=0)
            carry = dh * z + rec @ u.T
        flat = x.reshape(-1)
        by = np.argsort(flat, kind="stable")
        values, first = np.unique(flat[by], return_index=True)
        table_ = np.zeros_like(self.w[f"e{d}"])
        table_[values] = np.add.reduceat(ge.reshape(-1, 3 * k)[by], first)
        return {f"e{d}": table_, f"u{d}": gu, f"b{d}": gb}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions of x (span, n) with labels y (n), and its gradients."""
        k, (span, n) = self.hidden, x.shape
        f, b = self._forward(x, "f"), self._forward(x, "b")
        h = np.stack([np.concatenate([f[t][4], b[t][4]], axis=1) for t in range(span)])
        logits = h @ self.w["v"] + self.w["c"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        loss = float(-np.log(p[:, np.arange(n), y] + 1e-12).mean())
        p[:, np.arange(n), y] -= 1
        p /= span * n
        grads = {"v": np.einsum("tnh,tnl->hl", h, p), "c": p.sum(axis=(0, 1))}
        back = p @ self.w["v"].T
        return loss, grads | self._backward(x, "f", f, back[:, :, :k]) | self._backward(x, "b", b, back[:, :, k:])

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int = 250, batch: int = 64, span: int = 64, rate: float = 0.02, seed: int = 42) -> "ByteGRU":
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(texts), batch)
            x = np.full((span, batch), 0x20, np.intp)
            for j, r in enumerate(rows):
                own = texts[r]
                at = int(rng.integers(0, max(1, len(own) - span + 1)))
                cut = np.frombuffer(own[at : at + span], np.uint8)
                x[: len(cut), j] = cut
            _, grads = self.gradients(x, y[rows])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * (1 - step / (steps + 1))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (size + 1e-12))
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                self.w[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def sample(docs: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS, total: int = SAMPLE_TOTAL) -> DataFrame:
    """(lang, draw, doc_id, piece): a bounded sample for the fit, of every lang that has a row with a letter.

    At most ``texts`` rows of each language in the order of a hash, fewer if that made over ``total`` rows; of each text
    ``chars`` characters from a drawn place. Rows without lang or without a letter are not sampled and count nowhere.
    """
    draw = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = usable.groupBy("lang").agg(F.count("*").alias("rows")).collect()  # one row a language
    if not rows:
        return usable.select("lang", draw.alias("draw"), "doc_id", F.col("text").alias("piece"))
    texts = max(1, min(texts, total // len(rows)))
    # from Arrow: rows of Python would start Python workers of another kind in every executor
    known = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array([r["lang"] for r in rows], pa.string()), "rows": pa.array([r["rows"] for r in rows], pa.int64())}))
    at = F.lit(1) + F.pmod(draw, F.greatest(F.char_length("text") - chars, F.lit(1))).cast("int")
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "piece")
    # a language with many usable rows is thinned by the same hash first, so that few of its rows are shuffled
    unit = (F.col("draw") / F.lit(float(1 << 64))) + 0.5
    thin = usable.select("doc_id", "lang", draw.alias("draw"), F.col("text").substr(at, F.lit(chars)).alias("piece")).join(F.broadcast(known) if len(rows) <= MOST_BROADCAST else known, "lang").where(unit * F.col("rows") <= 8 * texts + 8)
    return thin.withColumn("n", F.row_number().over(order)).where(F.col("n") <= texts).select("lang", "draw", "doc_id", "piece")


def fit(docs: DataFrame, **parameters) -> ByteGRU | None:
    """A network fitted on sample(docs), which is all that reaches the driver; None if there is nothing to learn from."""
    rows = sorted((tuple(r) for r in sample(docs).collect()), key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[3]))
    labels = sorted({r[0] for r in rows})
    if not labels:
        return None
    index = {x: i for i, x in enumerate(labels)}
    return ByteGRU(labels).fit([r[3].encode() for r in rows], np.array([index[r[0]] for r in rows]), **parameters)


def predict(docs: DataFrame, model: ByteGRU | None, carry: tuple = ()) -> DataFrame:
    """The columns ``carry`` of docs, lang_pred and score (text is read, never lang, source or ids).

    lang_pred: the label of the highest mean probability over all byte positions of the whole text (of equals the first
    by name), score: that mean; ``und`` and 0 if the text is null or has no letter, or if there was nothing to learn
    from. Very long texts are read whole, in spans. Empty table: no rows. Repeated rows: a row each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net = shared.value
        for b in (part for batch in batches for part in slices(batch)):
            has = np.asarray(b.column("_letter").to_numpy(zero_copy_only=False), dtype=bool)
            names, scores = np.full(b.num_rows, UNKNOWN, dtype=object), np.zeros(b.num_rows)
            if net is not None and has.any():
                p = net.pooled(*string_bytes(b.column("text").filter(pa.array(has))))
                names[has] = np.array(net.labels, dtype=object)[p.argmax(axis=1)]
                scores[has] = np.round(np.clip(p.max(axis=1), 0, 1), 6)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], pa.array(names, pa.string()), pa.array(scores)], names=[*carry, "lang_pred", "score"])
        release()

    narrow = docs.select(*map(quoted, carry), *([] if "text" in carry else ["text"]), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    return narrow.mapInArrow(run, with_fields("", narrow, carry, "lang_pred string, score double"))


def held_out(doc_id, remainder: int = 1, modulus: int = 3):
    """Whether crc32(doc_id as text) mod ``modulus`` is ``remainder``; a row without doc_id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def identify(docs: DataFrame, carry: tuple = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` of docs (doc_id, text, lang), held_out, lang_pred and score of every row.

    Fits on the rows that are not held out. Null doc_id: held out. Null lang: not learned from. Null or wordless text:
    ``und``. Repeated rows: each may be drawn for the sample, and gets a row. Empty table: no rows. Columns that are not
    in ``carry`` are not read, so their names don't matter; those in it keep theirs.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), *[quoted(c) for c in carry if c not in ("doc_id", "text", "lang")], held_out("doc_id").alias("held_out"))
    model = fit(marked.select("doc_id", "text", "lang", "held_out").where("not held_out"))
    return predict(marked, model, (*carry, "held_out"))


def reject_unknown_language(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """docs without rows whose language is unknown (null or without a letter) or whose score is below ``least``.

    Other columns come along whatever their names; nulls in them don't matter. Repeated rows share their fate. Without
    any labelled row all rows are unknown. Empty table: no rows. The session's Arrow batches stay small from here on:
    whole rows go through Python when the caller reads the result.
    """
    small_batches(docs.sparkSession)
    kept = identify(aside(docs).withColumn("lang", F.col("_others.lang")), ("text", "_others")).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return restored(kept, docs.columns)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of documents; nulls, ties and repeated rows as in identify."""
    return identify(table(spark, sf_dir, "documents"))
