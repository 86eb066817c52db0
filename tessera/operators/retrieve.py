"""Retrieval for batches of queries: BM25 over postings, vectors, fusion, gate, graph expansion and peers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text, verdicts
from ..functions.values import band
from .plumbing import maybe_broadcast, ship, written


@dataclass(frozen=True)
class Pipeline:
    """What a retrieval pipeline runs; a reranking model is a seam that is used only where one is supplied."""

    dense: bool = True
    bm25: bool = True
    rerank: bool = False
    graph: bool = False
    gate: bool = True
    retrieval: bool = True
    label: str = ""


PIPELINES = {
    "hybrid_ce": Pipeline(rerank=True, label="vectors and BM25, fused, reranked"),
    "hybrid_rrf": Pipeline(label="vectors and BM25, fused"),
    "dense": Pipeline(bm25=False, gate=False, label="vectors only"),
    "bm25": Pipeline(dense=False, gate=False, label="BM25 only"),
    "graph_expand": Pipeline(rerank=True, graph=True, label="fused, with co-cited neighbours"),
    "llm_only": Pipeline(dense=False, bm25=False, gate=False, retrieval=False, label="no retrieval"),
}


def statistics(docs: DataFrame, content: str, tokens=text.tokens) -> DataFrame:
    """term, n (documents that have it), length: one pass; the row of no term has the number of documents and of all tokens.

    Each document counts a term once; the counts combine on the map side to one row for each term and task.
    """
    t = docs.select(tokens(F.col(content)).alias("t"))
    each = t.select(F.size("t").alias("length"), F.explode(F.array_append(F.array_distinct("t"), F.lit(None).cast("string"))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("term").isNull(), F.col("length"))).alias("length"))


def bm25(queries: DataFrame, q_key: str, q_text: str, docs: DataFrame, key: str, content: str, k: int = fixed.FUSE_DEPTH, tokens=text.tokens) -> DataFrame:
    """query, doc, score, rank of the k best documents of each query; a query's repeated terms count each time.

    One pass counts terms. Another keeps the tokens that occur in queries, deals them by document, and scores each
    document where it is, so that neither a common term nor a query meets in one task; each task keeps its own k best of
    a query. Query terms and weights are broadcast if their counted number is small. A negative weight becomes a share of
    the mean over all terms. Ties go by document.
    """
    stats = written(statistics(docs, content, tokens), "bm25-terms")
    n, length = stats.filter("term is null").select("n", "length").first() or (0, 0)
    raw = F.log((F.lit(n) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    known = stats.filter("term is not null").select("term", raw.alias("raw"))
    mean = known.agg(F.avg("raw")).first()[0] or 0.0
    q = queries.select(F.col(q_key).alias("query"), F.explode(tokens(F.col(q_text))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qf"))
    idf = F.when(F.col("raw") < 0, fixed.BM25_EPSILON * mean).otherwise(F.col("raw"))
    q = written(q.join(known, "term").select("query", "term", "qf", idf.alias("idf")), "bm25-queries")
    small = lambda df: maybe_broadcast(df, q.count(), 64)
    words = docs.select(F.col(key).alias("doc"), tokens(F.col(content)).alias("t")).select("doc", F.size("t").alias("length"), F.explode("t").alias("term"))
    used = words.join(small(q.select("term").distinct()), "term", "left_semi").repartition("doc").groupBy("doc", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    k1, b = fixed.BM25_K1, fixed.BM25_B
    norm = k1 * (1 - b + b * F.col("length") / F.lit(length / n if n else 1.0))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    scored = used.join(small(q), "term").groupBy("doc", "query").agg(F.round(F.sum(part), 6).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "doc", "score", "rank")


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Bytes of query vectors that are broadcast at a time; rows of a block of vectors, of which two are compared at once.
VECTOR_BYTES = 32 << 20
BLOCK = 1024
#: Scores as near as this may round to the same.
SLACK = 2e-6


def _packed(it):
    """Blocks of rows (id, vector), each as the bytes of an Arrow stream."""
    import pyarrow as pa

    for rows in it:
        for at in range(0, rows.num_rows, BLOCK):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, rows.schema) as w:
                w.write_batch(rows.slice(at, BLOCK))
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["block"])


def _unpacked(block: bytes):
    """ids, and for each length of vectors the rows and the matrix of those that are whole."""
    import numpy as np
    import pyarrow as pa

    with pa.ipc.open_stream(block) as r:
        t = r.read_all().combine_chunks()
    ids = t.column(0).to_numpy()
    rows: dict[int, list[int]] = {}
    vectors = []
    for v in t.column(1):
        x = v.values
        vectors.append(None if x is None or x.null_count else x.to_numpy(zero_copy_only=False).astype(np.float64))
    for i, x in enumerate(vectors):
        if x is not None:
            rows.setdefault(len(x), []).append(i)
    return ids, {n: (np.array(at), np.stack([vectors[i] for i in at])) for n, at in rows.items()}


class _Tops:
    """What a block of queries has found so far: of each query the k first documents by rounded score, and what rounds near the last."""

    def __init__(self, block: bytes, k: int):
        import numpy as np

        self.k, (self.ids, self.groups) = k, _unpacked(block)
        self.floor = np.full(len(self.ids), -np.inf)
        self.held: list[tuple] = []
        self.n = 0

    def add(self, query, doc, score, null) -> None:
        other = self.ids[query] != doc
        self.held.append((query[other], doc[other], score[other], null[other]))
        self.n += int(other.sum())

    def meet(self, ids, groups: dict) -> None:
        import numpy as np

        most = np.unique(ids, return_counts=True)[1].max() if len(ids) else 0
        lengths = np.full(len(ids), -1)
        for n, (at, _) in groups.items():
            lengths[at] = n
        apart = np.full(len(self.ids), -2)
        for n, (at, _) in self.groups.items():
            apart[at] = n
        for n in np.unique(apart):  # pairs without a score go last, by document
            rest, asking = np.sort(ids[lengths != n])[: self.k + 1], np.flatnonzero((apart == n) & (self.floor == -np.inf))
            if len(rest) and len(asking):
                self.add(np.repeat(asking, len(rest)), np.tile(rest, len(asking)), np.full(len(rest) * len(asking), -np.inf), np.ones(len(rest) * len(asking), bool))
        for n, (mine, q) in self.groups.items():
            if n not in groups:
                continue
            at, v = groups[n]
            with np.errstate(all="ignore"):
                s = q @ v.T
            s[np.isnan(s)] = np.inf
            floor = self.floor[mine]
            place = len(at) - self.k - most  # some of them may be the query itself
            if place >= 0 and np.isneginf(floor).any():
                floor = np.maximum(floor, np.partition(s, place, axis=1)[:, place])
            i, j = np.nonzero(s >= (floor - SLACK - 1e-9 * np.abs(np.where(np.isfinite(floor), floor, 0)))[:, None])
            for x in range(0, len(i), 1 << 15):
                a, b = i[x : x + (1 << 15)], j[x : x + (1 << 15)]
                exact = np.zeros(len(a))
                with np.errstate(all="ignore"):
                    for d in range(n):  # in the order of the places, as any fold of the products has it
                        exact += q[a, d] * v[b, d]
                self.add(mine[a], ids[at[b]], exact, np.zeros(len(a), bool))
        if self.n > 4 * self.k * len(self.ids):
            self.settle()

    def settle(self) -> tuple:
        import numpy as np

        if not self.held:
            return self.ids[:0], self.ids[:0], np.zeros(0), np.zeros(0, bool)
        query, doc, score, null = (np.concatenate(x) for x in zip(*self.held))
        rounded = np.where(np.isnan(score), np.inf, np.round(score, 6))
        order = np.lexsort((np.unique(doc, return_inverse=True)[1], -rounded, query))
        query, doc, score, null, rounded = (x[order] for x in (query, doc, score, null, rounded))
        start = np.append(True, query[1:] != query[:-1])
        place = np.arange(len(query)) - np.maximum.accumulate(np.where(start, np.arange(len(query)), 0))
        last = place == self.k - 1
        self.floor[query[last]] = rounded[last]
        equal = start | np.append(True, rounded[1:] != rounded[:-1])
        among = np.arange(len(query)) - np.maximum.accumulate(np.where(equal, np.arange(len(query)), 0))
        keep = (among < self.k) & ((rounded >= self.floor[query] - SLACK) | (place < self.k))
        self.held, self.n = [(query[keep], doc[keep], score[keep], null[keep])], int(keep.sum())
        return self.ids[query[keep]], doc[keep], score[keep], null[keep]


def compared(queries: DataFrame, q_key: str, vectors: DataFrame, key: str, vector: str, query_rows: int | None = None, dims: int = 1024, k: int = fixed.FUSE_DEPTH) -> list[DataFrame]:
    """query, doc, score of a stated set of queries against all rows but themselves, where a task keeps those of a query that can
    be among its k first: a frame for each part of the queries, whose vectors (of ``dims`` numbers at most) fit a broadcast.

    Every query meets every row. Queries and rows are packed into blocks, and two blocks are one product of matrices; scores of
    what is kept are added up in the order of the places. Vectors of other lengths, or with gaps, have no score and go last.
    """
    import pyarrow as pa

    ship(vectors.sparkSession)
    q = queries.filter(F.col(q_key).isNotNull()).select(F.col(q_key).alias("query"), F.col(vector).alias("_q"))
    n = q.count() if query_rows is None else query_rows
    parts = max(1, -(-n * dims * 4 // VECTOR_BYTES))
    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.col(vector).alias("_v")).mapInArrow(_packed, "block binary").withColumnRenamed("block", "_v")
    kinds = [queries.schema[q_key].dataType.simpleString(), vectors.schema[key].dataType.simpleString()]

    def run(it):
        tops: dict[int, _Tops] = {}
        seen, block = None, None
        for b in it:
            for number, mine, other in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                if number not in tops:
                    tops[number] = _Tops(mine.as_py(), k)
                if other != seen:  # the pairs of a block of rows come one after another
                    seen, block = other, _unpacked(other)
                tops[number].meet(*block)
        for found in tops.values():
            query, doc, score, null = found.settle()
            for at in range(0, len(query), 10_000):
                to = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(query[to]), pa.array(doc[to]), pa.array(score[to], pa.float64(), mask=null[to])], names=["query", "doc", "score"])

    out = []
    for i in range(parts):
        side = q if parts == 1 else q.filter(F.pmod(F.xxhash64("query"), F.lit(parts)) == i)
        side = side.repartition(max(1, -(-n // parts // BLOCK))).mapInArrow(_packed, "block binary").select(F.monotonically_increasing_id().alias("_n"), F.col("block").alias("_q"))
        found = rows.crossJoin(F.broadcast(side)).select("_n", "_q", "_v").mapInArrow(run, f"query {kinds[0]}, doc {kinds[1]}, score double")
        out.append(found.withColumn("score", F.round("score", 6)))
    return out


def leading(queries: DataFrame, q_key: str, vectors: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """query, doc, rank: the k first rows but the query itself by an order of ``doc`` that no query has a part in. These are
    among the k + 1 first documents, whoever asks."""
    docs = vectors.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc")).agg(F.count(F.lit(1)).alias("_n"))
    few = docs.orderBy(*order).limit(k + 1).select("doc", F.explode(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(k)).cast("int"))).alias("_n")).drop("_n")
    pairs = queries.select(F.col(q_key).alias("query")).join(F.broadcast(few), F.col("query") != F.col("doc"))
    return best([pairs], order, k)


def best(scored: list[DataFrame], order: list, k: int) -> DataFrame:
    """The k first documents of each query, with their rank; each task keeps its own k best before the shuffle."""
    tops = [s.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k) for s in scored]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def nearest(queries: DataFrame, q_key: str, vectors: DataFrame, key: str, vector: str, k: int = fixed.FUSE_DEPTH, query_rows: int | None = None) -> DataFrame:
    """query, doc, score, rank by the dot product of unit vectors, without the query itself."""
    return best(compared(queries, q_key, vectors, key, vector, query_rows, k=k), [F.desc("score"), "doc"], k)


def matched(ranked: DataFrame, k: int = fixed.MATCHES) -> DataFrame:
    """query, matches (doc and score of the k best, in order), confidence (the band of the best) and whether to route the query on."""
    top = ranked.filter(F.col("rank") <= k).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "doc", F.round("score", 4).alias("score")))).alias("matches"))
    confidence = band(F.get("matches", 0)["score"])
    return top.select("query", "matches", confidence.alias("confidence"), (confidence == "Low").alias("routed"))


def fuse(rankings: list[DataFrame], depth: int = fixed.FUSE_DEPTH, k: int = fixed.SHORTLIST) -> DataFrame:
    """query, doc, rrf, rank: the sum of 1 / (60 + rank) over the rankings a document is in."""
    votes = None
    for r in rankings:
        v = r.filter(F.col("rank") <= depth).select("query", "doc", (1.0 / (fixed.RRF_K + F.col("rank"))).alias("vote"))
        votes = v if votes is None else votes.unionByName(v)
    w = Window.partitionBy("query").orderBy(F.desc("rrf"), "doc")
    return votes.groupBy("query", "doc").agg(F.round(F.sum("vote"), 9).alias("rrf")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def gated(scored: DataFrame, score: str = "score", tied: str | None = None) -> DataFrame:
    """One row per query: top document, its score, the margin, decision and reason. Candidates come with ``rank``."""
    w = Window.partitionBy("query").orderBy("rank")
    two = scored.withColumn("_second", F.lead(score).over(w)).filter("rank = 1")
    g = verdicts.gate(F.col(score), F.col("_second"), F.col(tied) if tied else None)
    return two.withColumn("_g", g).select("query", "doc", F.col(score).alias("top"), F.round(F.col(score) - F.coalesce("_second", F.lit(0.0)), 6).alias("margin"), "_g.decision", "_g.reason")


def expanded(shortlist: DataFrame, edges: DataFrame, from_top: int = fixed.EXPAND_FROM, each: int = fixed.EXPAND_EACH) -> DataFrame:
    """The shortlist, and co-cited neighbours of its top that it lacks, behind it with no fused evidence."""
    strong = edges.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("co"), "dst"))).filter(F.col("_r") <= each)
    near = shortlist.filter(F.col("rank") <= from_top).join(strong, F.col("doc") == F.col("src")).groupBy("query", F.col("dst").alias("doc")).agg(F.min(F.struct("rank", "_r")).alias("o"))
    fresh = near.join(shortlist.select("query", "doc"), ["query", "doc"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query").orderBy("o", "doc"))
    last = shortlist.groupBy("query").agg(F.max("rank").alias("_last"))
    added = fresh.withColumn("_p", place).join(last, "query").select("query", "doc", F.lit(0.0).alias("rrf"), (F.col("_last") + F.col("_p")).alias("rank"))
    return shortlist.select("query", "doc", "rrf", "rank").unionByName(added)


def peers(ranked: DataFrame, depth: int = fixed.PEER_DEPTH, part: float = fixed.PEER_SHARE, least: int = fixed.PEER_LEAST) -> DataFrame:
    """Documents of a query that score a fair share of its best; queries with too few of them have none."""
    w = Window.partitionBy("query")
    near = ranked.filter((F.col("rank") <= depth) & (F.col("score") > 0)).withColumn("_best", F.max("score").over(w)).filter(F.col("score") >= part * F.col("_best"))
    return near.withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_n") >= least).drop("_best", "_n")


def search(queries: DataFrame, q_key: str, q_text: str, docs: DataFrame, key: str, content: str, pipeline: str = "bm25", dense: DataFrame | None = None, edges: DataFrame | None = None, more: list[DataFrame] = ()) -> DataFrame:
    """query, doc, rank, rrf, score for a registered pipeline. dense: a ranking made by ``nearest``, where there are vectors;
    more: further rankings (query, doc, rank) to fuse."""
    cfg = PIPELINES[pipeline]
    if not cfg.retrieval:
        raise ValueError(f"{pipeline} retrieves nothing")
    rankings = [r for r in (dense if cfg.dense else None, bm25(queries, q_key, q_text, docs, key, content) if cfg.bm25 else None, *more) if r is not None]
    out = fuse(rankings)
    if cfg.graph and edges is not None:
        out = expanded(out, edges)
    if len(rankings) > 1:
        return out.withColumn("score", verdicts.fused_score(F.col("rrf"), len(rankings)))
    own = rankings[0].select("query", "doc", (verdicts.lexical_score(F.col("score")) if cfg.bm25 else verdicts.dense_score(F.col("score"))).alias("score"))
    return out.join(own, ["query", "doc"], "left").fillna(0.0, ["score"])
