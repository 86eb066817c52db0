"""Phrases whose words come together more often than their parts explain, mined by count tries.

Each task grows count tries of bounded size over its texts, level by level down to the longest phrase, and serialises each in
the order of its paths, cut into ranges. The runs of a range are merged some at a time, and a walk of the merged trie gives
each phrase the counts of its first words (its ancestors). A suffix link, from a phrase to the same without its first word,
gives the counts of its last words: links are followed level by level as joins of counted nodes.

Words are counted first, which is the tries' first level; ranges of paths are cut by these counts, those of a frequent word
by its second words. That pass also counts adjacent words: counters, each of them the sum of the pairs that fall to it, are
shuffled by parts and added up there. A sketch has the bits of the counters that come to the least count, so that a pair
without its bit can't be part of any phrase that is counted. Tries grow only along pairs that the sketch leaves. It is of fixed
size and never drops a phrase that counts.

Defined results: null texts are empty, null languages are ``und``. Each row counts, equal ones too, and whatever its id.
Words are bytes of UTF-8 between delimiters, with A-Z lower-cased; scores are exact, as decimals of 38 digits. Texts are
worked on in blocks of some SIZES.block bytes that end at a delimiter; a task holds a block, the words it has met, which are
let go at SIZES.held, and a trie of SIZES.run words; a range's
merged nodes are held by one task. A longer text without any delimiter is held whole.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.plumbing import removed, skew_join
from .common import batch, folded, text_pass, written



class Sizes(NamedTuple):
    """What a task holds at most; results are the same with any."""

    #: Bytes of a block, distinct words that a task remembers, and words (with breaks) that one trie counts.
    block: int = 1 << 22
    held: int = 400_000
    run: int = 1 << 20
    #: Bits of the sketch that the second pass reads, parts in which it is added up, counters of each part, and pairs of
    #: neighbours that a task counts at a time.
    slots: int = 1 << 26
    parts: int = 256
    counters: int = 1 << 24
    pairs: int = 1 << 22
    #: Ranges at most, occurrences of words that a range has, and runs that are merged at a time.
    ranges: int = 1 << 16
    mass: int = 1 << 21
    ways: int = 64


SIZES = Sizes()
#: A counter adds up to this at most.
FULL = np.uint32(0xFFFFFFFF)
#: Where a language's phrases are ranked in parts.
SALTS = 64
STOP = b"."
_BREAKS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", b".........." )


class Words:
    """Numbers of the words of a language as a task meets them, 0 for the breaks between pieces; and their hashes."""

    def __init__(self, lang: str):
        self.lang, self.salt = lang, np.uint64(xxhash.xxh64_intdigest(lang.encode()))
        self.number: dict[bytes, int] = _Numbers()
        self.counts = np.zeros(1024, np.int64)
        self._hashes = np.zeros(0, np.uint64)

    def of(self, text: bytes) -> np.ndarray:
        """Numbers of a text's words, with breaks."""
        words = text.split()
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def hashes(self) -> np.ndarray:
        if len(self._hashes) < len(self.number):
            new = list(self.number)[len(self._hashes) :]
            self._hashes = np.append(self._hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new)))
        return self._hashes

    def count(self, ids: np.ndarray) -> None:
        if len(self.counts) < len(self.number):
            self.counts = np.append(self.counts, np.zeros(max(len(self.counts), len(self.number)), np.int64))
        self.counts += np.bincount(ids, minlength=len(self.counts))

    def hashed(self, ids: np.ndarray) -> np.ndarray:
        """A hash of each pair of neighbours."""
        h = self.hashes()[ids]
        x = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + self.salt)
        return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def slots_of(hashed: np.ndarray, sizes: Sizes) -> np.ndarray:
    """The counter of each hash, by number over all parts."""
    return (hashed >> np.uint64(24)) % np.uint64(sizes.parts * sizes.counters)


def bits_of(hashed: np.ndarray, sizes: Sizes) -> np.ndarray:
    """The bit of each hash in the sketch: within its part's share, by its counter."""
    slots, wide = slots_of(hashed, sizes), np.uint64(sizes.slots // sizes.parts)
    return slots // np.uint64(sizes.counters) * wide + slots % np.uint64(sizes.counters) % wide


class _Numbers(dict):
    def __init__(self):
        super().__init__()
        self[STOP] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks(it: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, bytes]]:
    """(language, text) with each delimiter as a word STOP, in blocks that hold whole pieces of one language."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def whole() -> Iterator[tuple[str, bytes]]:
        for lang, parts in held.items():
            yield lang, b" . ".join(parts).replace(STOP, b" . ")
        held.clear()

    for b in it:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            t = folded(text.as_py()).translate(_BREAKS)
            while t:
                at = len(t) if size + len(t) <= limit else t.find(STOP, max(0, limit - size))
                part, t = (t, b"") if at < 0 else (t[:at], t[at + 1 :])
                held.setdefault(lang, []).append(part)
                size += len(part)
                if size >= limit:
                    yield from whole()
                    size = 0
    yield from whole()


COUNTED = pa.schema([("lang", pa.string()), ("word", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("slots", pa.binary())])


def _first_pass(sizes: Sizes):
    """Rows (lang, word, n), and rows (part, slots): counters of one part that the task's pairs are in, with their counts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Words] = {}
        waiting: list[np.ndarray] = []

        def counted() -> Iterator[pa.RecordBatch]:
            for w in known.values():
                words, n = list(w.number)[1:], w.counts[1 : len(w.number)]
                for at in range(0, len(words), 1 << 16):
                    part = [x.decode("utf-8", "surrogatepass") for x in words[at : at + (1 << 16)]]
                    yield batch(COUNTED, lang=[w.lang] * len(part), word=part, part=[None] * len(part), n=n[at : at + (1 << 16)], slots=[None] * len(part))
            known.clear()

        def sketched() -> Iterator[pa.RecordBatch]:
            if waiting:
                slots, n = np.unique(np.concatenate(waiting), return_counts=True)
                waiting.clear()
                ends = np.searchsorted(slots, np.arange(sizes.parts + 1, dtype=np.uint64) * np.uint64(sizes.counters))
                full = [(k, a, b) for k, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
                packed = [_some(slots[a:b] - np.uint64(k * sizes.counters), n[a:b]) for k, a, b in full]
                yield batch(COUNTED, lang=[None] * len(full), word=[None] * len(full), part=[k for k, _, _ in full], n=[None] * len(full), slots=packed)

        for lang, text in blocks(it, sizes.block):
            w = known.setdefault(lang, Words(lang))
            ids = w.of(text)
            w.count(ids)
            if len(ids) > 1:
                waiting.append(slots_of(w.hashed(ids)[(ids[:-1] > 0) & (ids[1:] > 0)], sizes))
            if sum(map(len, waiting)) >= sizes.pairs:
                yield from sketched()
            if sum(len(x.number) for x in known.values()) > sizes.held:
                yield from counted()
        yield from sketched()
        yield from counted()

    return run


def _some(slots: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted slots and their counts: distances and counts, packed behind their number."""
    raw = np.concatenate([np.diff(slots, prepend=np.uint64(0)).astype(np.uint32), n.astype(np.uint32)]).tobytes()
    return len(n).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _read_some(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = int.from_bytes(packed[:8], "little")
    both = np.frombuffer(pa.decompress(packed[8:], 8 * m, "zstd", asbytes=True), np.uint32)
    return np.cumsum(both[:m], dtype=np.int64), both[m:]


def open_slots(counted: DataFrame, least: int, sizes: Sizes) -> np.ndarray:
    """Bits of the sketch that counters of ``least`` or more fall to: an eighth of their number in bytes, whatever the input.

    There are so many counters that pairs seldom share one, however long the texts are; those of a part are added up where it lies.
    """
    sketch = counted.filter("part is not null").select("part", "slots").repartition(sizes.parts, "part").sortWithinPartitions("part")
    wide = sizes.slots // sizes.parts

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        sums = np.zeros(0, np.uint32)

        def bits() -> pa.RecordBatch:
            found = np.zeros(wide, bool)
            found[np.flatnonzero(sums >= least) % wide] = True
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(found).tobytes()], pa.binary())], names=["part", "slots"])

        for b in it:
            for part, some in zip(b.column(0).to_pylist(), b.column(1)):
                if part != at:
                    if at is not None:
                        yield bits()
                    at, sums = part, np.zeros(sizes.counters, np.uint32)
                slots, n = _read_some(some.as_py())
                sums[slots] += np.minimum(n, FULL - sums[slots])
        if at is not None:
            yield bits()

    full = np.zeros(sizes.slots, bool)
    for row in sketch.mapInArrow(run, "part int, slots binary").collect():
        full[row.part * wide : (row.part + 1) * wide] = np.unpackbits(np.frombuffer(row.slots, np.uint8), count=wide)
    return np.packbits(full)


def trie(ids: np.ndarray, open_pairs: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels 2 to ``longest`` of a trie over words numbered in order: (parent, word, count) of the nodes, sorted.

    open_pairs: for each place, whether the trie goes on from its word to the next. Parents of level 2 are words, of others
    places in the level above.
    """
    at, node, levels = np.flatnonzero(open_pairs), None, []
    node = ids[at]
    wide = int(ids.max()) + 1 if len(ids) else 1
    for m in range(2, longest + 1):
        if m > 2:
            on = (at + m - 2 < len(open_pairs)) & open_pairs[np.minimum(at + m - 2, len(open_pairs) - 1)]
            at, node = at[on], node[on]
        if not len(at):
            break
        keys, node, n = np.unique(node * wide + ids[at + m - 1], return_inverse=True, return_counts=True)
        levels.append((keys // wide, keys % wide, n))
    return levels


RUNS = pa.schema([("range", pa.int32()), ("nodes", pa.binary())])
#: Between the words of a path; words have it, and the byte after it, escaped, so that paths are in order as bytes.
BETWEEN = b"\x00"


def escaped(word: bytes) -> bytes:
    return word.replace(b"\x01", b"\x01\x02").replace(BETWEEN, b"\x01\x01")


def words_of(path: bytes) -> list[str]:
    return [w.replace(b"\x01\x01", BETWEEN).replace(b"\x01\x02", b"\x01").decode("utf-8", "surrogatepass") for w in path.split(BETWEEN)]


class Ranges:
    """Ranges of paths, over all languages: (language, path) is in the range of the last cut that isn't behind it.

    Cuts are paths of one or two words, so that what goes on from two words is never divided.
    """

    def __init__(self, cuts: list[tuple[str, bytes]]):
        self.first: dict[str, int] = {}
        self.cuts: dict[str, list[bytes]] = {}
        for i, (lang, path) in enumerate(sorted(set(cuts))):
            self.first.setdefault(lang, i + 1)
            self.cuts.setdefault(lang, []).append(path)

    def of(self, lang: str, path: bytes) -> int:
        if lang not in self.cuts:  # languages without a cut
            return -(zlib.crc32(lang.encode()) % 1024) - 1
        return self.first[lang] + bisect.bisect_right(self.cuts[lang], path) - 1

    def pieces(self, lang: str, paths: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(range, from, to) of sorted paths."""
        at = [0, *(bisect.bisect_left(paths, c) for c in self.cuts.get(lang, [])), len(paths)]
        for a, b in zip(at, at[1:]):
            if a < b:
                yield self.of(lang, paths[a]), a, b


class _Looked:
    """An array's values, each made when it is looked at: cuts are found by some of them."""

    def __init__(self, values: pa.Array):
        self.values = values

    def __len__(self) -> int:
        return len(self.values)

    def __getitem__(self, i: int) -> bytes:
        return self.values[i].as_py()


def packed(range_: int, lang: str, paths: pa.Array, n: pa.Array) -> pa.RecordBatch:
    """A row of RUNS: sorted nodes of one language in one range."""
    out = pa.BufferOutputStream()
    nodes = pa.RecordBatch.from_arrays([paths, n], names=["path", "n"]).replace_schema_metadata({"lang": lang})
    with pa.ipc.new_stream(out, nodes.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(nodes)
    return pa.RecordBatch.from_arrays([pa.array([range_], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], schema=RUNS)


def unpacked(nodes: bytes) -> tuple[str, pa.Table]:
    with pa.ipc.open_stream(nodes) as r:
        t = r.read_all()
    return t.schema.metadata[b"lang"].decode(), t.replace_schema_metadata(None)


def serialised(words: list[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[pa.Array, pa.Array]:
    """The paths of a trie's nodes, sorted, and their counts; words are escaped and in order."""
    paths: list[np.ndarray] = []  # words of each node, by level
    for parent, word, _ in levels:
        paths.append(np.column_stack([paths[-1][parent] if paths else parent[:, None], word]))
    flat = np.full((sum(map(len, paths)), len(levels) + 1), -1, np.int64)
    at = 0
    for p in paths:
        flat[at : at + len(p), : p.shape[1]] = p
        at += len(p)
    order = np.lexsort(flat.T[::-1])
    flat, n = flat[order], np.concatenate([np.zeros(0, np.int64), *(x[2] for x in levels)])[order]
    there = flat >= 0
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(there.sum(axis=1))).astype(np.int32)), pa.array(words, pa.binary()).take(pa.array(flat[there])))
    return pc.binary_join(lists, BETWEEN), pa.array(n, pa.int64())


def _second_pass(bits: bytes, longest: int, sizes: Sizes, ranges: Ranges):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave = np.frombuffer(bits, np.uint8)
        known: dict[str, Words] = {}
        waiting: dict[str, list[np.ndarray]] = {}

        def grown(lang: str) -> Iterator[pa.RecordBatch]:
            w, ids = known[lang], np.concatenate(waiting.pop(lang))
            if len(ids) < 2:
                return
            slot = bits_of(w.hashed(ids), sizes)
            go = (ids[:-1] > 0) & (ids[1:] > 0) & ((leave[slot >> np.uint64(3)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)
            used = np.unique(np.concatenate([ids[:-1][go], ids[1:][go]]))
            if not len(used):
                return
            every = list(w.number)
            names = [escaped(every[i]) for i in used.tolist()]
            order = sorted(range(len(names)), key=names.__getitem__)
            rank = np.zeros(len(every), np.int64)
            rank[used[order]] = np.arange(len(names))  # numbers in the order of the words' bytes
            paths, n = serialised([names[i] for i in order], trie(rank[ids], go, longest))
            for r, a, b in ranges.pieces(lang, _Looked(paths)):
                yield packed(r, lang, paths[a:b], n[a:b])

        for lang, text in blocks(it, sizes.block):
            w = known.setdefault(lang, Words(lang))
            waiting.setdefault(lang, []).extend([w.of(text), np.zeros(1, np.int64)])
            if sum(map(len, waiting[lang])) >= sizes.run:
                yield from grown(lang)
            if sum(len(x.number) for x in known.values()) > sizes.held:
                for other in list(waiting):
                    yield from grown(other)
                known.clear()
        for lang in list(waiting):
            yield from grown(lang)

    return run


def _first_level(ranges: Ranges):
    """The counted words (lang, word, n) as tries of one level. A word whose phrases are in several ranges goes to each of
    them: with its count to the first, and to the others as one below zero, which is an ancestor there and nothing else."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found: dict[tuple[int, str], list[tuple[bytes, int]]] = {}
            for lang, word, n in zip(*(c.to_pylist() for c in b.columns)):
                path = escaped(word.encode("utf-8", "surrogatepass"))
                first, last = ranges.of(lang, path), ranges.of(lang, path + BETWEEN + b"\xff")
                for r in range(first, last + 1):
                    found.setdefault((r, lang), []).append((path, n if r == first else -n))
            for (r, lang), rows in found.items():
                rows.sort()
                yield packed(r, lang, pa.array([x for x, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64()))

    return run


def cuts(words: DataFrame, n_ranges: int) -> list[tuple[str, bytes]]:
    """Cuts between ranges: where as many ranges of words begin, and within words that have more than a range's share."""
    total = words.agg(F.sum("n")).first()[0]
    if not total:
        return []
    at = words.repartitionByRange(n_ranges, "lang", "word").select("lang", "word", F.spark_partition_id().alias("p")).groupBy("p").agg(F.min(F.struct("lang", "word")).alias("w"))
    found = [(r.w.lang, escaped(r.w.word.encode())) for r in at.collect()]  # a row for each range
    even: dict[str, list[bytes]] = {}
    hot = [(r.lang, escaped(r.word.encode()), r.n) for r in words.filter(F.col("n") * n_ranges > total).collect()]  # fewer than ranges
    for lang, path in sorted(set(found) | {(la, p) for la, p, _ in hot}):
        even.setdefault(lang, []).append(path)
    for lang, path, n in hot:
        parts = -(-n * n_ranges // total)
        seconds = even[lang]
        found += [(lang, path), *((lang, path + BETWEEN + seconds[i * len(seconds) // parts]) for i in range(1, parts) if seconds)]
    return found


NODES = pa.schema([("lang", pa.string()), ("path", pa.list_(pa.string())), ("f", pa.int64()), ("lefts", pa.list_(pa.int64()))])


def added(runs: list[pa.Table]) -> pa.Table:
    """Nodes (path, n) of several runs as one, in no order, with the counts of equal paths added up."""
    return pa.concat_tables(runs).group_by("path", use_threads=False).aggregate([("n", "sum")]).select(["path", "n_sum"]).rename_columns(["path", "n"])


def merged(runs: list[list[tuple[bytes, int]]]) -> list[tuple[bytes, int]]:
    """The same for pairs (path, n), in order."""
    t = added([pa.table({"path": pa.array([p for p, _ in r], pa.binary()), "n": pa.array([n for _, n in r], pa.int64())}) for r in runs]).sort_by("path")
    return list(zip(t.column("path").to_pylist(), t.column("n").to_pylist()))


def _merged(least: int, ways: int):
    """Nodes of ``least`` occurrences from RUNS, dealt and sorted by range: runs are merged ``ways`` at a time, then walked."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walked(runs: dict[str, list]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for lang, own in runs.items():
                nodes = added(own)
                nodes = nodes.filter(pc.greater_equal(pc.abs(nodes.column("n")), least)).sort_by("path")  # few are left to walk
                stack: list[tuple[bytes, int]] = []  # ancestors of the path at hand
                for path, n in zip(nodes.column("path").to_pylist(), nodes.column("n").to_pylist()):
                    while stack and not path.startswith(stack[-1][0]):
                        stack.pop()
                    if n > 0:
                        out.append((lang, words_of(path), n, [f for _, f in stack]))
                    stack.append((path + BETWEEN, abs(n)))
                    if len(out) >= 1 << 14:
                        yield rows(out)
            if out:
                yield rows(out)

        def rows(out: list[tuple]) -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), NODES)], schema=NODES)
            out.clear()
            return got

        at: int | None = None
        runs: dict[str, list] = {}
        for b in it:
            for r, nodes in zip(b.column(0).to_pylist(), b.column(1)):
                if r != at:
                    yield from walked(runs)
                    at, runs = r, {}
                lang, found = unpacked(nodes.as_py())
                own = runs.setdefault(lang, [])
                own.append(found)
                if len(own) >= ways:
                    runs[lang] = [added(own)]
        yield from walked(runs)

    return run


def counted_nodes(docs: DataFrame, longest: int, least: int, sizes: Sizes = SIZES) -> tuple[DataFrame, DataFrame]:
    """(nodes, totals): words and phrases of at least ``least`` occurrences as (lang, path, f, lefts), where lefts are the counts
    of the path's first words; and n, the words of each language."""
    cols = [F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.col("text").cast("string")]
    counted = written(text_pass(docs, cols, _first_pass(sizes), "lang string, word string, part int, n long, slots binary"), "colloc-words")
    bits = open_slots(counted, least, sizes).tobytes()
    words = written(counted.filter("part is null").groupBy("lang", "word").agg(F.sum("n").alias("n")), "colloc-counts")
    removed(counted)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    often = words.filter(F.col("n") >= least).select("lang", "word", "n")
    mass = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = Ranges(cuts(often, min(sizes.ranges, max(docs.sparkSession.sparkContext.defaultParallelism, -(-mass // sizes.mass)))))
    shape = "range int, nodes binary"
    levels = text_pass(docs, cols, _second_pass(bits, longest, sizes, ranges), shape).unionByName(text_pass(often, [F.col(c) for c in often.columns], _first_level(ranges), shape))
    runs = written(levels, "colloc-runs")
    dealt = runs.repartition("range").sortWithinPartitions("range")
    nodes = written(dealt.mapInArrow(_merged(least, sizes.ways), "lang string, path array<string>, f long, lefts array<long>"), "colloc-nodes")
    removed(runs)
    return nodes, totals


def linked(nodes: DataFrame, longest: int) -> DataFrame:
    """Phrases with ``rights``, the counts of the path's last words from the longest down: those of the suffix link, and its."""
    done = nodes.filter(F.size("path") == 1).select("lang", "path", "f", "lefts", F.array().cast("array<long>").alias("rights"))
    phrases = []
    for m in range(2, longest + 1):
        level = nodes.filter(F.size("path") == m).withColumn("_link", F.slice("path", 2, m - 1))
        uses = level.groupBy("lang", "_link").agg(F.count(F.lit(1)).alias("_uses"))
        target = done.select("lang", F.col("path").alias("_link"), F.concat(F.array("f"), "rights").alias("rights"))
        level = skew_join(level, target.join(uses, ["lang", "_link"]), ["lang", "_link"], "_uses", 1 << max(10, level.count().bit_length()), F.col("path"), "inner")
        done = written(level.select("lang", "path", "f", "lefts", "rights"), "colloc-linked")
        phrases.append(done)
    out = phrases[0]
    for p in phrases[1:]:
        out = out.unionByName(p)
    return out


def mined(docs: DataFrame, longest: int = 5, least: int = 100, covered: int = 100, top: int | None = None, sizes: Sizes = SIZES) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each phrase of 2 to ``longest`` words with ``least`` occurrences, but those that a longer
    one covers in ``covered`` per cent of them; with ``top`` only each language's first, and their rank.

    l and r are the counts of the two parts at the cut of the least score (the shortest first part of equal ones).
    """
    if not 2 <= longest or least < 1 or not 0 < covered <= 100:
        raise ValueError("phrases of two words or more, a count of 1 or more, a share of 1 to 100")
    nodes, totals = counted_nodes(docs, longest, least, sizes)
    found = linked(nodes, longest)
    # what a longer phrase covers is covered to the same share by one of one word more, as its count lies in between
    longer = found.filter(F.size("path") > 2)
    covers = longer.select("lang", "f", F.explode(F.array(F.slice("path", F.lit(1), F.size("path") - 1), F.slice("path", F.lit(2), F.size("path") - 1))).alias("path"))
    covers = covers.groupBy("lang", "path").agg(F.max("f").alias("_longer"))
    left = found.join(covers, ["lang", "path"], "left").filter(F.coalesce(100 * F.col("_longer") < F.lit(covered) * F.col("f"), F.lit(True)))
    wide = lambda c: c.cast("decimal(18,0)")
    part = lambda l, k: F.struct(_quotient(wide(F.col("f")), wide(F.col("n")), wide(l), wide(F.get("rights", k))).alias("score"), (k + 1).alias("k"), l.alias("l"), F.get("rights", k).alias("r"))
    scored = left.join(totals, "lang").withColumn("_cut", F.array_min(F.transform("lefts", part)))
    out = scored.select("lang", F.array_join("path", " ").alias("phrase"), F.col("f").alias("a"), F.col("_cut.l"), F.col("_cut.r"), "n", F.col("_cut.score"))
    return out if top is None else _first(out, top)


def _quotient(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 * a * n / (l * r)), by whole numbers: products have up to 40 digits where counts have 18, and all
    quotients that fit a long are right up to 38 digits; beyond those the session fails rather than round."""
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * a * n, l * r)


def _first(found: DataFrame, top: int) -> DataFrame:
    """Each language's first phrases with their rank; a language is first cut down in SALTS parts."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = found.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("rank") <= top).drop("_salt", "rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
