"""Periodic runs of words, and texts with their repeats collapsed.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends. Each text is scanned
right to left with a stack of suffixes, once under an order of its words and once under the reverse order: the stack gives
the longest Lyndon word at each place, and the root of every run of three periods is among them. Suffixes are compared, and
roots extended both ways, by their longest common extension: a binary search over prefix hashes, whose answer is then
verified word by word (and found word by word, should the hashes have lied). There is no suffix array.

Only sections that can hold a run are scanned: a run has a window of words that comes again one period later, so it lies
within places that repeated windows cover without a gap. Windows are found for many texts at a time by a sort.

Defined results: null text is a text without words. Each row is worked on by itself, whatever its id, so that null or
repeated ids do no harm, and other columns are not read. A text is held whole by its task, with some 100 bytes a word of the
sections that repeat; texts are worked on WORDS words at a time, or one at a time where they are longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_pass

#: Words that a run has at least, and its least length in periods (3 or more; the scan counts on that).
LENGTH, PERIODS = 24, 3
#: Words of a window, and words of texts that are worked on together.
WINDOW, WORDS = 8, 1 << 18
PRIME, BASE = (1 << 61) - 1, 1_186_212_674_399_541_217


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Section:
    """Words as numbers, with prefix hashes; answers how far two places agree."""

    def __init__(self, words: np.ndarray, prime: int = PRIME):
        self.a, self.n, self.prime = words.tolist(), len(words), prime
        self.raw = words.astype(np.uint32).tobytes()
        h, at, shift, power = [0], 0, [1], 1
        for x in self.a:
            at = (at * BASE + x + 1) % prime
            power = power * BASE % prime
            h.append(at)
            shift.append(power)
        self.h, self.shift = h, shift

    def same(self, i: int, j: int, n: int) -> bool:
        h, s = self.h, self.shift[n]
        return (h[i + n] - h[i] * s - h[j + n] + h[j] * s) % self.prime == 0

    def verified(self, i: int, j: int, n: int) -> bool:
        return self.raw[4 * i : 4 * (i + n)] == self.raw[4 * j : 4 * (j + n)]

    def after(self, i: int, j: int) -> int:
        """Words for which the places i < j agree from there on."""
        top, n, step = self.n - j, 0, 4
        while n + step <= top and self.same(i + n, j + n, step):
            n += step
            step *= 2
        low, high = n, min(top, n + step - 1)
        while low < high:
            mid = (low + high + 1) // 2
            if self.same(i + n, j + n, mid - n):
                low = mid
            else:
                high = mid - 1
        if not self.verified(i, j, low) or (low < top and self.a[i + low] == self.a[j + low]):
            low = 0  # equal hashes of unequal words
            while low < top and self.a[i + low] == self.a[j + low]:
                low += 1
        return low

    def before(self, i: int, j: int) -> int:
        """Words for which the places i < j agree up to there."""
        n, step = 0, 4
        while n + step <= i and self.same(i - n - step, j - n - step, step):
            n += step
            step *= 2
        low, high = n, min(i, n + step - 1)
        while low < high:
            mid = (low + high + 1) // 2
            if self.same(i - mid, j - mid, mid - n):
                low = mid
            else:
                high = mid - 1
        if not self.verified(i - low, j - low, low) or (low < i and self.a[i - low - 1] == self.a[j - low - 1]):
            low = 0
            while low < i and self.a[i - low - 1] == self.a[j - low - 1]:
                low += 1
        return low

    def runs(self, length: int = LENGTH, periods: int = PERIODS) -> set[tuple[int, int, int]]:
        """(start, length, period) of all runs of at least so many words and periods."""
        found: dict[tuple[int, int, int], None] = {}
        for a in (self.a, [-x for x in self.a]):
            self._scan(a, length, periods, found)
        return set(found)

    def _scan(self, a: list[int], length: int, periods: int, found: dict) -> None:
        n, stack = self.n, []
        start = end = 0
        period = 1  # the run that was found last
        for i in range(n - 1, -1, -1):
            x = a[i]
            while stack:
                j = stack[-1]
                y = a[j]
                if x == y:
                    if start <= i and j < end and (j - i) % period == 0:
                        m = end - j  # both in one run, a multiple of its period apart
                        if j + m < n and a[i + m] == a[j + m]:
                            m = self.after(i, j)
                    else:
                        m = self.after(i, j)
                    if j + m == n or a[i + m] > a[j + m]:
                        break
                elif x > y:
                    break
                stack.pop()
            j = stack[-1] if stack else n
            stack.append(i)
            p = j - i  # words of the longest Lyndon word here
            if j + p > n or x != a[j] or a[j - 1] != a[j + p - 1] or (p == period and start <= i and j + p <= end) or not self.same(i, j, p):
                continue
            s, e = i - self.before(i, j), j + self.after(i, j)
            if e - s >= max(length, periods * p):
                found[s, e - s, p] = None
            if e - s >= 2 * p:
                start, end, period = s, e, p


def sections(ids: np.ndarray, owner: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Stretches [a, b) that repeated windows of words of one text cover without a gap. owner: the text of each word, in order."""
    n = len(ids) - window + 1
    if n < 2:
        return []
    h = owner[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    words = ids.astype(np.uint64) + np.uint64(1)
    for k in range(window):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[k : k + n]
    at = np.flatnonzero(owner[:n] == owner[window - 1 :])
    order = at[np.argsort(h[at], kind="stable")]
    twin = h[order[1:]] == h[order[:-1]]
    first, last = order[:-1][twin], order[1:][twin] + window
    if not len(first):
        return []
    by = np.argsort(first, kind="stable")
    first, last = first[by], np.maximum.accumulate(last[by])
    cut = np.flatnonzero(first[1:] >= last[:-1]) + 1
    return list(zip(first[np.append(0, cut)].tolist(), last[np.append(cut - 1, len(last) - 1)].tolist()))


def runs_of(texts: list[list[bytes]], length: int = LENGTH, periods: int = PERIODS) -> list[list[tuple[int, int, int]]]:
    """The runs of each text of words, by start and period."""
    number, out = _Ids(), [[] for _ in texts]
    ids = np.fromiter((number[w] for t in texts for w in t), np.int64, sum(map(len, texts)))
    firsts = np.cumsum([0, *map(len, texts)])
    owner = np.repeat(np.arange(len(texts)), np.diff(firsts))
    window = max(1, min(WINDOW, length - -(-length // periods)))  # what a run has of words that come again a period later
    for a, b in sections(ids, owner, window):
        k = int(owner[a])
        out[k] += [(int(a - firsts[k]) + s, m, p) for s, m, p in Section(ids[a:b]).runs(length, periods)]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for s, m, p in runs:
        drop[s + p] += 1
        drop[s + m] -= 1
    return [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, length: int = LENGTH, periods: int = PERIODS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the text less the repeats, of each row."""
    if periods < 3 or length < 2:
        raise ValueError("runs of three periods or more, of two words or more")

    def made(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(texts, length, periods)
        rows = [[{"start": s, "length": m, "period": p} for s, m, p in r] for r in found]
        kept = [b" ".join(collapsed(t, r)).decode("utf-8", "surrogatepass") for t, r in zip(texts, found)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(rows, pa.list_(RUN)), pa.array(kept, pa.string())], schema=ARROW)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, texts, size = [], [], 0
            for i, text in zip(b.column(0), b.column(1)):
                ids.append(i.as_py())
                texts.append((text.as_py() or "").encode("utf-8", "surrogatepass").split())
                size += len(texts[-1])
                if size >= WORDS:
                    yield made(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield made(ids, texts)

    return text_pass(docs, [F.col("doc_id").cast("long"), F.col("text").cast("string")], run, SCHEMA)


def with_period(doc_id: str, text: str) -> Column:
    """The text; in one of ten, by the CRC-32 of the id, a stretch at the end repeats instead of going on."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))

    def planted(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    words = F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1))
    return F.when((h % 10 == 0) & F.col(text).rlike(WORD), F.transform(F.array(words), planted)[0]).otherwise(F.col(text))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest length over period (least start, then period, of equals) and the digests."""
    best = F.expr("aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start"),
        F.col("_best.length"),
        F.col("_best.period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
