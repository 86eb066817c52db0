"""Language identification by mixtures: expectation-maximisation over character n-gram likelihoods.

Each language has a smoothed distribution over hashed character trigrams, counted over all labelled rows. A text is a
mixture of languages: EM estimates the proportions from the likelihoods of its trigrams, then nested sets of the
languages with the largest proportions are refitted, and the set with the best likelihood less a penalty of
half a logarithm of the trigrams for each proportion is chosen (BIC). The language of the largest proportion is the prediction.

Defined results: null texts, texts without a letter, and all texts where nothing was learned are ``und`` with score 0.
Ties go to the first language in order. Rows are judged one by one; extra columns are not read. Texts are worked on so many
at a time that a matrix of trigrams by languages has CELLS cells at most, or is one text's; more than LANGS languages are
refused, as the model is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, text_pass

BUCKETS = 1 << 16
SMOOTHING = 0.5
#: EM rounds over all languages, and over each nested set.
ROUNDS, REFIT = 8, 6
#: Characters that a pass holds at a time; texts are counted in pieces of this length with an overlap of two.
SPAN = 1 << 17

#: Cells of a matrix of trigrams by languages; and languages that a model may have.
CELLS, LANGS = 1 << 21, 256

_kind: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point: whether it is a letter."""
    global _kind
    if _kind is None:
        _kind = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _kind


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a text's lower-cased trigrams of letters, words fenced by single spaces."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found: list[np.ndarray] = []
    low = text.lower()
    for at in range(0, len(low), SPAN):
        x = np.frombuffer((" " * (at == 0) + low[max(0, at - 2) : at + SPAN] + " " * (at + SPAN >= len(low))).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[x]
        x = np.where(letter, x, np.uint32(32))
        keep = letter | np.append(True, letter[:-1])  # one space for any run of others
        x = x[keep]
        if len(x) < 3:
            continue
        h = ((x[:-2] * np.uint32(2654435761) ^ x[1:-1]) * np.uint32(2246822519) ^ x[2:]) * np.uint32(3266489917)
        found.append((h >> np.uint32(16))[x[1:-1] != 32])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ids, n = np.unique(np.concatenate(found), return_counts=True)
    return ids.astype(np.int64), n


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the logarithms of their trigram distributions (languages x buckets).

    Counts are gathered in each task and summed by bucket; what comes to the driver is bounded by languages x buckets.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in it:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids, n = trigrams(text.as_py())
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))[ids] += n
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield batch(COUNTS, lang=[lang] * len(at), bucket=at.astype(np.int32), n=counts[at])

    seen = docs.filter("lang is not null and text is not null")
    if seen.select("lang").distinct().limit(LANGS + 1).count() > LANGS:
        raise ValueError(f"more than {LANGS} languages")
    got = text_pass(seen, [F.col("lang").cast("string"), F.col("text").cast("string")], run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(langs), BUCKETS))
    place = {lang: i for i, lang in enumerate(langs)}
    counts[[place[x] for x in got.column("lang").to_pylist()], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    counts += SMOOTHING
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _em(like: np.ndarray, n: np.ndarray, first: np.ndarray, owner: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text after some rounds, and its log-likelihood (less the offset taken out of ``like``)."""
    total = np.add.reduceat(n, first)
    for _ in range(rounds):
        part = share[owner] * like
        part *= (n / part.sum(axis=1))[:, None]
        share = np.add.reduceat(part, first, axis=0) / total[:, None]
    fit = np.log((share[owner] * like).sum(axis=1)) * n
    return share, np.add.reduceat(fit, first)


def mixtures(bags: list[tuple[np.ndarray, np.ndarray]], logs: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Proportions (texts x languages) under the chosen language set of each text; every bag holds something."""
    ends = np.cumsum([len(b[0]) for b in bags]) * len(logs) // cells  # texts whose trigrams end in the same stretch go together
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(bags)]
    return np.concatenate([_mixtures(bags[a:b], logs) for a, b in zip(cuts, cuts[1:])])


def _mixtures(bags: list[tuple[np.ndarray, np.ndarray]], logs: np.ndarray) -> np.ndarray:
    langs = len(logs)
    out = np.zeros((len(bags), langs))
    ids = np.concatenate([b[0] for b in bags])
    n = np.concatenate([b[1] for b in bags]).astype(np.float64)
    sizes = np.array([len(b[0]) for b in bags])
    first, owner = np.append(0, np.cumsum(sizes[:-1])), np.repeat(np.arange(len(bags)), sizes)
    raw = logs[:, ids].T.astype(np.float64)
    like = np.exp(raw - raw.max(axis=1, keepdims=True))
    share, _ = _em(like, n, first, owner, np.full((len(bags), langs), 1 / langs), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    price = 0.5 * np.log(np.add.reduceat(n, first))
    best = np.add.reduceat(np.log(like) * n[:, None], first, axis=0)  # each language alone
    top = np.argmax(best, axis=1)
    score = best[np.arange(len(bags)), top]
    out[np.arange(len(bags)), top] = 1
    live = np.arange(len(bags))
    for k in range(2, langs + 1):  # texts for which the last set was better go on to one more language
        inside = np.isin(owner, live)
        renumber = np.full(len(bags), -1)
        renumber[live] = np.arange(len(live))
        own = renumber[owner[inside]]
        chosen = order[live, :k]
        start = np.maximum(np.take_along_axis(share[live], chosen, 1), 1e-6)
        got, fit = _em(np.take_along_axis(like[inside], chosen[own], 1), n[inside], np.append(0, np.cumsum(sizes[live][:-1])), own, start / start.sum(axis=1, keepdims=True), REFIT)
        fit = fit - price[live] * (k - 1)
        better = fit > score[live]
        for_out = np.zeros((len(live), langs))
        np.put_along_axis(for_out, chosen, got, 1)
        out[live[better]], score[live[better]] = for_out[better], fit[better]
        live = live[better]
        if not len(live):
            break
    return out


ARROW = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.string())])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score, and languages: the chosen set with its proportions, for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = shared.value
        for b in it:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                texts = part.column(1).to_pylist()
                bags = [trigrams(t) if langs and has_letter(t) else None for t in texts]
                known = [i for i, x in enumerate(bags) if x and len(x[0])]
                shares = dict(zip(known, mixtures([bags[i] for i in known], logs))) if known else {}
                pred, score, said = [], [], []
                for i in range(len(texts)):
                    s = shares.get(i)
                    k = -1 if s is None else int(s.argmax())
                    pred.append("und" if s is None else langs[k])
                    score.append(0.0 if s is None else float(min(1.0, s[k])))
                    said.append("" if s is None else " ".join(f"{langs[j]}:{s[j]:.3f}" for j in np.argsort(-s, kind="stable") if s[j] > 0))
                yield batch(ARROW, doc_id=part.column(0).to_pylist(), lang_pred=pred, score=score, languages=said)

    return text_pass(docs, [F.col("doc_id").cast("long"), F.col("text").cast("string")], run, "doc_id long, lang_pred string, score double, languages string")
