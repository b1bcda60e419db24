"""Language identification by a bidirectional gated recurrent network over UTF-8 bytes.

The network is trained here, in numpy, by backpropagation through time: two gated recurrent layers (one reads
forwards, one backwards) and a linear layer that labels every byte position. A document's probability of a
language is the mean over all its positions. Prediction cuts the whole text into segments of `SEGMENT` bytes
and runs thousands of segments side by side, each step a few small matrix products.

Training reads a bounded sample of the labelled rows: about `per_lang` documents of each language, chosen by
the hash of the id, one excerpt of `excerpt` characters from a place in the text chosen by that hash. Languages are
counted over all labelled rows, and the `max_langs` most frequent of them are learnt, so that dirty labels make
neither the sample nor the network unbounded. Weights are a few thousand floats and travel with the task.

Cases: null texts and texts without a letter get `und` and score 0; rows with a null label are not learnt
from; without any labelled row everything is `und`; repeated rows are returned one by one; an empty table
gives an empty result; other columns are not read, and lang, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.batches import parts
from lexmill.llm.common import hash_share, pick
from lexmill.session import table

HIDDEN = 12
SEGMENT = 128
BLOCK = 1024
PER_LANG = 400
MAX_LANGS = 500
EXCERPT = 400
EPOCHS = 5
SEED = 7
FOLDS = 4
HELD_OUT = 2
UNDETERMINED = "und"


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


# --- the network -------------------------------------------------------------------------------------------


class BiGru:
    """Weights of two directions (w: byte to gates, u: state to gates, b: bias; gates r, z, n) and the output."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        put = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.classes, self.hidden = classes, hidden
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"] = put(3, 256, hidden, scale=0.3)
            self.p[f"u{d}"] = put(3, hidden, hidden, scale=hidden**-0.5)
            self.p[f"b{d}"] = np.zeros((1, hidden), np.float32)  # of the candidate's state part
        self.p["o"] = put(2 * hidden, len(classes), scale=hidden**-0.5)
        self.p["ob"] = np.zeros(len(classes), np.float32)

    def _states(self, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """x: (steps, rows) bytes as int64, in reading order. The states after each step."""
        w, u, b = self.p[f"w{d}"], self.p[f"u{d}"], self.p[f"b{d}"]
        steps, rows = x.shape
        out = np.empty((steps, rows, self.hidden), np.float32)
        h = np.zeros((rows, self.hidden), np.float32)
        r, z, n, t = (np.empty_like(h) for _ in range(4))
        tape = []
        for i in range(steps):
            for gate, k in ((r, 0), (z, 1)):
                np.take(w[k], x[i], axis=0, out=gate, mode="clip")
                np.matmul(h, u[k], out=t)
                gate += t
                gate *= 0.5
                np.tanh(gate, out=gate)  # the logistic function, by tanh
                gate += 1.0
                gate *= 0.5
            np.matmul(h, u[2], out=t)
            t += b
            if keep:
                state = t.copy()
            t *= r
            np.take(w[2], x[i], axis=0, out=n, mode="clip")
            n += t
            np.tanh(n, out=n)
            if keep:
                tape.append((h, r.copy(), z.copy(), n.copy(), state))
            np.subtract(h, n, out=t)
            t *= z
            np.add(n, t, out=out[i])
            h = out[i]
        return out, tape

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(steps, rows, classes) for segments x (steps, rows)."""
        forward, _ = self._states("f", x, False)
        backward, _ = self._states("b", x[::-1], False)
        h = self.hidden
        logits = forward.reshape(-1, h) @ self.p["o"][:h]
        logits += backward[::-1].reshape(-1, h) @ self.p["o"][h:]
        logits += self.p["ob"]
        np.exp(np.clip(logits, -30, 30, out=logits), out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.reshape(*x.shape, -1)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of the mean cross entropy over positions. y: class of each row, weight: (steps, rows)."""
        h, grads = self.hidden, {k: np.zeros_like(v) for k, v in self.p.items()}
        forward, tape_f = self._states("f", x, True)
        backward, tape_b = self._states("b", x[::-1], True)
        joined = np.concatenate([forward, backward[::-1]], axis=2).reshape(-1, 2 * h)
        logits = joined @ self.p["o"] + self.p["ob"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        flat, w = np.tile(y, x.shape[0]), weight.reshape(-1) / max(weight.sum(), 1)
        loss = float(-(np.log(p[np.arange(len(flat)), flat] + 1e-9) * w).sum())
        p[np.arange(len(flat)), flat] -= 1
        p *= w[:, None].astype(np.float32)
        grads["o"], grads["ob"] = joined.T @ p, p.sum(axis=0)
        back = (p @ self.p["o"].T).reshape(*x.shape, 2 * h)
        for d, tape, steps, g_out in (("f", tape_f, x, back[:, :, :h]), ("b", tape_b, x[::-1], back[::-1, :, h:])):
            u = self.p[f"u{d}"]
            gw, gu, gb = grads[f"w{d}"], grads[f"u{d}"], grads[f"b{d}"]
            carried = np.zeros((x.shape[1], h), np.float32)
            for i in range(len(steps) - 1, -1, -1):
                before, r, z, n, state = tape[i]
                g = g_out[i] + carried
                g_n = g * (1 - z) * (1 - n * n)
                g_z = g * (before - n) * z * (1 - z)
                g_r = g_n * state * r * (1 - r)
                g_s = g_n * r
                carried = g * z + g_r @ u[0].T + g_z @ u[1].T + g_s @ u[2].T
                for k, part, into_state in ((0, g_r, g_r), (1, g_z, g_z), (2, g_n, g_s)):
                    np.add.at(gw[k], steps[i], part)
                    gu[k] += before.T @ into_state
                gb += g_s.sum(axis=0, keepdims=True)
        return loss, grads


def segments(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int = SEGMENT) -> np.ndarray:
    """(size, rows) of int64: bytes of each segment, padded with 0."""
    step = np.arange(size)[:, None]
    at = starts[None, :] + step
    x = np.take(data, at, mode="clip").astype(np.int64)
    x[step >= lengths[None, :]] = 0
    return x


def cuts(lengths: np.ndarray, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each segment: its text, its offset in the text and its length. All bytes are in one segment."""
    count = -(-lengths // size)
    owner = np.repeat(np.arange(len(lengths)), count)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else count
    offset = (np.arange(len(owner)) - np.repeat(first, count)) * size
    return owner, offset, np.minimum(lengths[owner] - offset, size)


def train(texts: list[str], labels: list[str], classes: list[str], epochs: int = EPOCHS, batch: int = 256, rate: float = 0.02) -> BiGru:
    """Adam over segments of the texts, in an order that depends on the seed only."""
    net = BiGru(classes)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
    sizes = np.array([len(t) for t in raw], np.int64)
    owner, offset, lengths = cuts(sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])[owner] + offset if len(sizes) else offset
    y = np.array([classes.index(v) for v in labels], np.int64)[owner] if len(labels) else owner
    rng = np.random.default_rng(SEED)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    done, total = 0, max(1, epochs * -(-len(begin) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(begin))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x = segments(data, begin[rows], lengths[rows])
            weight = (np.arange(SEGMENT)[:, None] < lengths[rows][None, :]).astype(np.float32)
            _, grads = net.gradients(x, y[rows], weight)
            norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads.values())))
            done += 1
            lr = rate * min(1.0, 1.2 - done / total)
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.99 * v2[k] + 0.01 * g * g
                net.p[k] = (net.p[k] - lr * (m[k] / (1 - 0.9**done)) / (np.sqrt(v2[k] / (1 - 0.99**done)) + 1e-7)).astype(np.float32)
    return net


def pooled(net: BiGru, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(texts, classes): the mean of the positions' probabilities."""
    sums = np.zeros((len(lengths), len(net.classes)))
    owner, offset, size = cuts(lengths)
    begin = starts[owner] + offset
    for at in range(0, len(owner), BLOCK):
        rows = slice(at, at + BLOCK)
        p = net.probabilities(segments(data, begin[rows], size[rows]))
        p[np.arange(SEGMENT)[:, None] >= size[rows][None, :]] = 0
        per_segment = p.sum(axis=0, dtype=np.float64)
        for c in range(per_segment.shape[1]):
            sums[:, c] += np.bincount(owner[rows], per_segment[:, c], len(lengths))
    return sums / np.maximum(lengths, 1)[:, None]


# --- over tables -------------------------------------------------------------------------------------------


def fit(docs: DataFrame, per_lang: int = PER_LANG, excerpt: int = EXCERPT, max_langs: int = MAX_LANGS) -> BiGru | None:
    """Trains on rows of docs (doc_id, text, lang) outside the held-out fold."""
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    common = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    counts = {r["lang"]: r["n"] for r in common.collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_lang / n))])
    place = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.greatest(F.length("text") - excerpt, F.lit(1)).cast("long")).cast("int") + 1
    sample = (
        known.filter((hash_share(F.col("doc_id")) < F.coalesce(share[F.col("lang")], F.lit(0.0))) & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
        .select("doc_id", "lang", F.substr("text", place, F.lit(excerpt)).alias("t"))
        .limit(4 * per_lang * len(counts))  # a bound; the share above gives a quarter of it
        .toPandas()
        .sort_values(["doc_id", "t"], kind="stable")
    )
    return train(list(sample["t"]), list(sample["lang"]), sorted(counts))


def _judged(net: BiGru, texts: pa.Array, has: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language and score of each text; texts without letters (has) are undetermined."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"\0", np.uint8) if len(texts) and offsets[-1] > 0 else np.zeros(1, np.uint8)
    p = pooled(net, data, offsets[:-1], np.where(has, np.diff(offsets), 0))
    named = [net.classes[b] if ok else UNDETERMINED for b, ok in zip(p.argmax(axis=1), has, strict=True)]
    return named, np.where(has, np.clip(p.max(axis=1), 0, 1), 0.0)


def _predictor(net: BiGru):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            named, score = _judged(net, part.column("text"), np.array(part.column("letters").to_pylist(), bool))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(named, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, net: BiGru | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per document."""
    kind = dict(docs.dtypes)["doc_id"]
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) if net else F.lit(False)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"), letters.alias("letters"))
    return rows.mapInArrow(_predictor(net or BiGru([UNDETERMINED])), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, **options) -> DataFrame:
    """Trains on the labelled rows outside the held-out fold and predicts all rows."""
    docs = pick(docs, doc_id="doc_id", text="text", lang="lang")
    return predict(docs, fit(docs, **options))


def keep_identified(docs: DataFrame, min_score: float = 0.3, **options) -> DataFrame:
    """The documents with all their columns, without those that get no language or hardly any certainty. The
    verdict is found in the row's own task, so rows with the same id are judged one by one. Without any labelled row
    there is nothing to judge by, and all documents stay."""
    net = fit(pick(docs, doc_id="doc_id", text="text", lang="lang"), **options)
    if net is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            texts = ["" if t is None else t for t in part.column("text").to_pylist()]
            has = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            named, score = _judged(net, pa.array(texts, pa.string()), has)
            yield part.filter(pa.array([lang != UNDETERMINED and s >= min_score for lang, s in zip(named, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
