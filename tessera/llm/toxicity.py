"""Toxicity by subword bags: embeddings of character n-grams, averaged over a text, under a linear softmax.

Embeddings and softmax are trained together in numpy on a bounded sample of labelled rows. Vectors go to the n-grams that
occur in more toxic than clean texts of the sample, or the other way round, by LEAST_Z standard errors: some thousand.
Tasks count n-grams and make the bags; what comes to the driver are the counts, a row for each bucket at most, and the
bags of the chosen n-grams, whatever the length of a text. An unseen misspelling shares most of its n-grams with the word
it comes from, and so its vectors. As averaging and the last layer are linear, the trained model is one number for each
n-gram bucket; scoring a text averages those numbers, over all of the text. A fifth of the sample is kept from training,
to calibrate the scores on.

Defined results: null, empty and letterless texts score as the model's bias alone. Every row gets a score from its text
only; equal texts score alike. Labels of null, and ids with both labels, are not learned. Without labelled rows of both
kinds all texts score 0. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, fresh, text_pass, written

BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4, 5, 6)
#: Most labelled rows that the model is fitted on, the rows with the least hash; and passes over them.
SAMPLE = 6000
EPOCHS = 14
#: Texts that an n-gram must occur in to have a vector; standard errors between toxic and clean; and n-grams at least.
LEAST_TEXTS, LEAST_Z, LEAST_GRAMS = 3, 4.0, 512
#: Least number of gradient steps, so that a small sample is fitted as well.
STEPS = 400
THRESHOLD = 0.3
#: Characters handled at a time; longer texts are cut with an overlap, so that no n-gram is lost or counted twice.
SPAN = 1 << 18

_word: np.ndarray | None = None


def _is_word() -> np.ndarray:
    """For each code point: whether it belongs to words."""
    global _word
    if _word is None:
        _word = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return _word


def codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, with one space before and after and for each character outside of words."""
    x = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_is_word()[x], x, np.uint32(32))


def grams(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: start of each n-gram that has spaces at its ends only, and its bucket."""
    word = x != 32
    h = x * np.uint32(2654435761)
    inner = np.ones(len(x), bool)
    for n in range(2, max(GRAMS) + 1):
        m = len(x) - n + 1
        if m <= 0:
            return
        if n > 2:
            inner = inner[:m] & word[n - 2 : n - 2 + m]
        h = (h[:m] ^ x[n - 1 :]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        if n in GRAMS:
            at = np.flatnonzero(inner[:m])
            yield at, h[at] & np.uint32(BUCKETS - 1)


def counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and how often each occurs; long texts are counted span by span."""
    over = max(GRAMS) - 1
    if len(x) <= SPAN + over:
        got = [b for _, b in grams(x)]
        return np.unique(np.concatenate(got), return_counts=True) if got else (np.empty(0, np.uint32), np.empty(0, np.int64))
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(x) - over, SPAN):
        own = x[at : at + SPAN + over]
        last = at + SPAN >= len(x) - over
        for start, b in grams(own):
            total += np.bincount(b if last else b[: np.searchsorted(start, SPAN)], minlength=BUCKETS)
    ids = np.flatnonzero(total)
    return ids, total[ids]


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and their weights in the mean: the root of their count, so that no word repeated
    over and over makes up the whole text."""
    ids, n = counts(codes(text))
    w = np.sqrt(n)
    return ids, (w / max(1e-9, w.sum())).astype(np.float32)


def odds(text: str | None, numbers: np.ndarray) -> float:
    """The weighted mean of the numbers of a text's n-grams."""
    ids, w = bag(text)
    return float((numbers[ids] * w).sum(dtype=np.float64))


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make log-odds of rows not trained on fit their labels, drawn towards 1 and 0 by a prior."""
    at = np.array([1.0, 0.0])

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y == 1, -1, 1) * (v[0] * z + v[1])).sum() + 0.5 * ((v[0] - 1) ** 2 + 0.1 * v[1] ** 2))

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at[0] * z + at[1], -40, 40)))
        w = p * (1 - p)
        g = np.array([((p - y) * z).sum() + at[0] - 1, (p - y).sum() + 0.1 * at[1]])
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        while loss(at - step) > loss(at) and abs(step).max() > 1e-9:
            step /= 2
        at = at - step
        if abs(step).max() < 1e-9:
            break
    return float(max(at[0], 0.01)), float(at[1])


def chosen(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Buckets that get vectors, from the number of toxic and clean texts with each bucket, and of such texts in all."""
    seen = toxic + clean
    share = seen / max(1, n_toxic + n_clean)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / max(1, n_toxic) + 1 / max(1, n_clean)))
    z = np.abs(toxic / max(1, n_toxic) - clean / max(1, n_clean)) / error
    z[seen < LEAST_TEXTS] = 0
    n = max(LEAST_GRAMS, int((z >= LEAST_Z).sum()))
    best = np.argsort(-z, kind="stable")[:n]
    return np.sort(best[z[best] > 0])


class Bags:
    """The bags of many texts: places of n-grams among the chosen, and their weights; text i has starts[i] to starts[i + 1]."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, starts: np.ndarray):
        self.ids, self.weights, self.starts = ids, weights, starts

    def __len__(self) -> int:
        return len(self.starts) - 1

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bags of some texts one after another, and where each begins."""
        sizes = (self.starts[1:] - self.starts[:-1])[rows]
        first = np.append(0, np.cumsum(sizes[:-1]))
        at = np.repeat(self.starts[rows] - first, sizes) + np.arange(sizes.sum())
        return self.ids[at], self.weights[at], first


def gradients(embed: np.ndarray, soft: np.ndarray, bias: np.ndarray, ids: np.ndarray, weights: np.ndarray, first: np.ndarray, onehot: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean cross-entropy of a batch, and its gradients by embeddings, softmax and bias. No bag is empty."""
    mean = np.add.reduceat(embed[ids] * weights[:, None], first, axis=0)
    z = mean @ soft + bias
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    g = (p - onehot) / len(onehot)
    back = g @ soft.T
    rows = np.repeat(np.arange(len(first)), np.diff([*first, len(ids)]))
    by_embed = np.stack([np.bincount(ids, weights * back[rows, d], len(embed)) for d in range(embed.shape[1])], axis=1)
    return float(-np.log(np.maximum((p * onehot).sum(axis=1), 1e-30)).mean()), by_embed, mean.T @ g, g.sum(axis=0)


def train(bags: Bags, toxic: np.ndarray, grams: int, dim: int = DIM, epochs: int = EPOCHS, seed: int = 7, step: int = 128, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """The number of each of ``grams`` n-grams, and the bias: log-odds of toxic are bias + the weighted numbers of a text."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.001, (grams, dim)).astype(np.float32)
    soft = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    share = float(np.clip(toxic.mean(), 1e-3, 1 - 1e-3))
    bias = np.log(np.array([1 - share, share], np.float32))
    memory = [np.full(grams, 1e-8, np.float32), np.full(soft.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)]
    scale = np.float32(40.0)  # means of many vectors are small; one scale for all texts
    epochs = max(epochs, -(-STEPS // max(1, -(-len(bags) // step))))
    onehot = np.eye(2, dtype=np.float32)[toxic]
    filled = np.flatnonzero(np.diff(bags.starts))
    for epoch in range(epochs):
        order = rng.permutation(filled)
        lr = np.float32(rate * (1 - epoch / epochs))
        for at in range(0, len(order), step):
            own = order[at : at + step]
            ids, weights, first = bags.of(own)
            _, by_embed, by_soft, by_bias = gradients(embed, soft, bias, ids, weights * scale, first, onehot[own])
            memory[0] += (by_embed**2).mean(axis=1)
            memory[1] += by_soft**2
            memory[2] += by_bias**2
            embed -= lr * (by_embed / np.sqrt(memory[0])[:, None]).astype(np.float32)
            soft -= lr * by_soft / np.sqrt(memory[1])
            bias -= lr * by_bias / np.sqrt(memory[2])
    return embed @ (soft[:, 1] - soft[:, 0]) * scale, float(bias[1] - bias[0])


def sampled(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """h (a hash of the row), y, text: at most ``bound`` labelled ids, those of the least hash, and as many of their rows.

    Rows that agree in id and text count once, so that no number of them passes the bound.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("_y")).filter("y = _y")
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("y") > 0).cast("int").alias("y"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.dropDuplicates(["doc_id", "text"])
    rows = written(rows.select(F.xxhash64("doc_id", "text").alias("h"), "y", "text"), "toxicity-sample")
    last = rows.select("h").orderBy("h").limit(bound).agg(F.max("h")).first()[0]  # ids that repeat may have more rows
    return rows.filter(F.col("h") <= F.lit(last))


COUNTS = pa.schema([("bucket", pa.int32()), ("toxic", pa.int64()), ("clean", pa.int64())])
BAGS = pa.schema([("h", pa.int64()), ("y", pa.int32()), ("ids", pa.list_(pa.int32())), ("weights", pa.list_(pa.float32()))])


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> tuple[np.ndarray, float] | None:
    """Trains on four fifths of a sample and calibrates on the rest: the number of each bucket, and the bias; None if
    one of the labels is missing."""
    rows = sampled(docs, labels, bound)
    kept = lambda h: h % 5 == 0

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in it:
            for h, y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if not kept(h):
                    total[y, counts(codes(text.as_py()))[0]] += 1
        at = np.flatnonzero(total.any(axis=0))
        yield batch(COUNTS, bucket=at.astype(np.int32), toxic=total[1, at], clean=total[0, at])

    columns = [F.col("h"), F.col("y"), F.col("text")]
    sizes = {(r.kept, r.y): r.n for r in rows.groupBy((F.pmod("h", F.lit(5)) == 0).alias("kept"), "y").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows at most
    if not sizes.get((False, 0)) or not sizes.get((False, 1)):
        return None
    got = text_pass(rows, columns, spread, "bucket int, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    total = np.zeros((2, BUCKETS), np.int64)
    for i, name in enumerate(("clean", "toxic")):
        total[i, got.column("bucket").to_numpy()] = got.column(name).to_numpy()
    picked = chosen(total[1], total[0], sizes[False, 1], sizes[False, 0])

    def bags(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, weights = [], []
            for text in b.column(2):
                all_, w = bag(text.as_py())
                at = np.searchsorted(picked, all_)
                own = (at < len(picked)) & (picked[np.minimum(at, len(picked) - 1)] == all_) if len(picked) else np.zeros(len(at), bool)
                ids.append(at[own].astype(np.int32))
                weights.append(w[own])
            yield batch(BAGS, h=b.column(0), y=b.column(1), ids=ids, weights=weights)

    t = text_pass(rows, columns, bags, "h long, y int, ids array<int>, weights array<float>").toArrow().combine_chunks()
    t = t.take(np.argsort(t.column("h").to_numpy(), kind="stable")).combine_chunks()  # the same order in each run
    flat = lambda name: t.column(name).combine_chunks().flatten().to_numpy()
    starts = np.append(0, np.cumsum([len(x) for x in t.column("ids")])).astype(np.int64)
    held, y = t.column("h").to_numpy() % 5 == 0, t.column("y").to_numpy().astype(np.int64)
    whole = Bags(flat("ids"), flat("weights"), starts)

    def part(rows: np.ndarray) -> Bags:
        ids, weights, first = whole.of(rows)
        return Bags(ids, weights, np.append(first, len(ids)) if len(rows) else np.zeros(1, np.int64))

    numbers, bias = train(part(np.flatnonzero(~held)), y[~held], len(picked))
    z = np.array([float((numbers[whole.ids[a:b]] * whole.weights[a:b]).sum(dtype=np.float64)) + bias for a, b, h in zip(starts, starts[1:], held) if h])
    slope, shift = calibrated(z, y[held])
    out = np.zeros(BUCKETS, np.float32)
    out[picked] = numbers * slope
    return out, float(bias * slope + shift)


def scores(docs: DataFrame, model: tuple[np.ndarray, float] | None, columns: list[str]) -> DataFrame:
    """The named columns of docs and ``score``, in one pass without a shuffle."""
    kept = docs.select(*columns).schema
    name, text = fresh("score", columns), fresh("_text", columns)
    schema = type(kept)([*kept.fields]).add(name, "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for b in it:
            if found is None:
                values = [0.0] * len(b)
            else:
                values = [float(1 / (1 + np.exp(-np.clip(odds(t.as_py(), found[0]) + found[1], -50, 50)))) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(values, pa.float64())], names=[*columns, name])

    return text_pass(docs, [*[F.col(c) for c in columns], F.col("text").cast("string").alias(text)], run, schema)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = SAMPLE) -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns."""
    scored = scores(docs, fit(docs, labels, bound), docs.columns)
    return scored.filter(F.col(scored.columns[-1]) < threshold).select(docs.columns)
