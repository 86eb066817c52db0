"""The co-citation graph: mining from baskets, serving, paths and layout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, ids, verdicts
from .components import components as connected
from .plumbing import maybe_broadcast, over_tasks, own_folder, written


#: Items of a basket whose pairs one task makes; larger baskets are cut into tiles.
BASKET = 4096


def basket_pairs(b: DataFrame, large: int = BASKET) -> DataFrame:
    """a, b (a < b): the pairs of each basket of b (doc, item; dealt by doc), one row for each basket they are in.

    Baskets up to ``large`` are joined where they lie. Those above are cut into parts by item, and each pair of parts
    is a tile dealt by itself, so that no task squares a large basket; no pair is left out.
    """
    sized = b.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc")))
    few, many = sized.filter(F.col("n") <= large), sized.filter(F.col("n") > large)
    near = few.alias("x").join(few.alias("y"), (F.col("x.doc") == F.col("y.doc")) & (F.col("x.item") < F.col("y.item")))
    return near.select(F.col("x.item").alias("a"), F.col("y.item").alias("b")).unionByName(far_pairs(many, large))


def far_pairs(many: DataFrame, large: int, dealt: int | None = None) -> DataFrame:
    """a, b (a < b): the pairs of large baskets (doc, item, n: the items of doc), by tiles of two parts."""
    parts = F.ceil(F.col("n") / max(large // 2, 1)).cast("int")
    tiles = many.withColumn("part", F.pmod(F.xxhash64("item"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    tiles = tiles.select("doc", "item", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    ordered = F.col("x.item") < F.col("y.item")
    once = (F.col("x.part") != F.col("y.part")) | (F.col("x.i") == F.col("x.j"))  # pairs within a part meet in its own tile only
    tiles = tiles if dealt is None else tiles.repartition(dealt, "doc", "i", "j")
    far = tiles.alias("x").join(tiles.alias("y"), (F.col("x.doc") == F.col("y.doc")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & ordered & once)
    return far.select(F.col("x.item").alias("a"), F.col("y.item").alias("b"))


#: Citations of the bridge, and pairs, that one task of mining holds; tables of more get more tasks.
ROWS, PAIRS = 250_000, 1_000_000


def tasks(spark: SparkSession, n: int, each: int) -> int:
    """Tasks of ``each`` of n rows, as many as there are cores at least."""
    return max(-(-n // each), spark.sparkContext.defaultParallelism)


def dealt_pairs(bridge: DataFrame, large: int = BASKET, rows: int = ROWS, most: int = PAIRS) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """a, b (a < b), co of a bridge (doc, item; rows may repeat); documents by item (item, n); their number (n_docs, one row); tasks.

    Documents are dealt over as many tasks as their citations and pairs take, so that a task's part doesn't grow with the
    table. A task counts the pairs and items of its own documents; these counts are dealt by pair and by item, over tasks of
    bounded size again.
    """
    spark = bridge.sparkSession
    parts = tasks(spark, bridge.count(), rows)
    sizes = bridge.filter("doc is not null").repartition(parts, "doc").groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
    parts = max(parts, tasks(spark, total, most))
    b = bridge.withColumn("g", F.pmod(F.xxhash64("doc"), F.lit(parts)).cast("int")).repartitionById(parts, F.col("g")).distinct()
    sized = b.filter("doc is not null and item is not null").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g", "doc")))
    few = sized.filter(F.col("n") <= large).groupBy("g", "doc").agg(F.array_sort(F.collect_list("item")).alias("items"))
    first = few.select("g", "items", F.posexplode("items").alias("at", "a"))
    near = first.select("g", "a", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("b"))
    near = near.groupBy("g", "a", "b").agg(F.count(F.lit(1)).alias("co")).select("a", "b", "co")  # where the documents lie
    far = far_pairs(sized.filter(F.col("n") > large).drop("g"), large, parts).groupBy("a", "b").agg(F.count(F.lit(1)).alias("co"))
    pairs = near.unionByName(far).repartition(parts, "a", "b").groupBy("a", "b").agg(F.sum("co").alias("co"))
    docs = b.filter("doc is not null").select("g", "doc").distinct().agg(F.count(F.lit(1)).alias("n_docs"))
    items = b.groupBy("g", "item").agg(F.count(F.lit(1)).alias("n")).repartition(parts, "item").groupBy("item").agg(F.sum("n").alias("n"))
    return pairs, items, docs, parts


def co_citation(bridge: DataFrame, doc: str, item: str, least_co: int = 1, least_confidence: float = 0.0, least_source: int = 1, places: int = 3, large: int = BASKET, dealt: bool = False) -> DataFrame:
    """Directed edges: src, dst, n_src, n_dst, co, confidence, lift; thresholds are tested before rounding.

    Pairs are made within documents, in one direction only; the other is its mirror, so that half the pairs are shuffled.
    The counts combine on the map side. Citations without document or item make no pair.
    """
    if dealt:
        b = bridge.select(F.col(doc).alias("doc"), F.col(item).alias("item")).distinct()  # stored in buckets of the document
        pairs = basket_pairs(b, large).groupBy("a", "b").agg(F.count(F.lit(1)).alias("co"))
        n, docs, parts = b.groupBy("item").agg(F.count(F.lit(1)).alias("n")), b.agg(F.count_distinct("doc").alias("n_docs")), None
    else:
        pairs, n, docs, parts = dealt_pairs(bridge.select(F.col(doc).alias("doc"), F.col(item).alias("item")), large)
    return directed(pairs.filter(F.col("co") >= least_co), n, docs, least_confidence, least_source, places, parts)


def directed(pairs: DataFrame, n: DataFrame, total: DataFrame, least_confidence: float, least_source: int, places: int, parts: int | None = None) -> DataFrame:
    """Both directions of pairs (a, b, co) with the counts of their ends (item, n) and of documents (n_docs, one row).

    parts: over how many tasks edges are dealt to meet the counts, by src at last, in place of the session's number.
    """
    both = pairs.withColumn("e", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))).select("e.src", "e.dst", "co")
    e = over_tasks(both, parts, "dst").join(n.select(F.col("item").alias("dst"), F.col("n").alias("n_dst")), "dst")
    e = over_tasks(e, parts, "src").join(n.select(F.col("item").alias("src"), F.col("n").alias("n_src")), "src").crossJoin(F.broadcast(total))  # total is one row
    conf = F.col("co") / F.col("n_src")
    lift = (F.col("co") / F.col("n_docs")) / ((F.col("n_src") / F.col("n_docs")) * (F.col("n_dst") / F.col("n_docs")))
    return e.filter((F.col("n_src") >= least_source) & (conf >= least_confidence)).select("src", "dst", "n_src", "n_dst", "co", F.round(conf, places).alias("confidence"), F.round(lift, places).alias("lift"))


def evidence_statement(src: Column, dst: Column, co: Column, n_src: Column) -> Column:
    return F.format_string("%s of %s documents that cite %s also cite %s", co.cast("string"), n_src.cast("string"), src.cast("string"), dst.cast("string"))


def undirected(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """One row for each unordered pair, a < b, in its direction of higher confidence (the source's order on a tie)."""
    pair = F.array_sort(F.array("src", "dst"))
    ends = over_tasks(edges.select(pair[0].alias("a"), pair[1].alias("b"), "src", "dst", "co", "confidence", "lift"), parts, "a", "b")
    best = ends.groupBy("a", "b").agg(F.max_by(F.struct("src", "dst", "co", "confidence", "lift"), F.struct(F.col("confidence"), F.col("src") < F.col("dst"))).alias("e"))
    return best.select("a", "b", "e.src", "e.dst", "e.co", "e.confidence", "e.lift")


def edge_cap(pairs: DataFrame, cap: int, parts: int | None = None) -> DataFrame:
    """Keeps an edge (one row for each pair) that is among the first ``cap`` of either end, strongest first.

    That is what a greedy pass keeps that drops an edge only if both ends are full: the first cap edges at a node are
    always kept, and a node is full from then on.
    """
    rank = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("co"), "a", "b", "_end"))
    ends = over_tasks(pairs.select("*", F.explode(F.array("a", "b")).alias("_end")), parts, "_end").withColumn("_rank", rank("_end"))
    return over_tasks(ends.filter(F.col("_rank") <= cap).select(pairs.columns), parts, "a", "b").distinct()  # a pair that both ends keep is there twice


def degrees(edges: DataFrame, a: str = "src", b: str = "dst", parts: int | None = None) -> DataFrame:
    return over_tasks(edges.select(F.explode(F.array(a, b)).alias("node")), parts, "node").groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def densest(edges: DataFrame, nodes: int, a: str = "src", b: str = "dst", parts: int | None = None) -> DataFrame:
    """Edges with both ends among the ``nodes`` nodes of highest degree."""
    top = maybe_broadcast(degrees(edges, a, b, parts).orderBy(F.desc("degree"), "node").limit(nodes).select("node"), nodes, 64)
    return edges.join(top.withColumnRenamed("node", a), a, "left_semi").join(top.withColumnRenamed("node", b), b, "left_semi")


def by_role(related_: DataFrame, source: str, key: str, title: str, confidence: str) -> DataFrame:
    """One row for each source: groups (role, n, members by confidence) in the order of roles, total, and the few members that
    are likely normative, most confident first."""
    place = F.create_map(*[F.lit(x) for i, (k, _, _) in enumerate(fixed.ROLES) for x in (k, i)])
    r = related_.select(source, F.col(key).alias("key"), F.col(confidence).alias("confidence"), verdicts.role(F.col(title)).alias("role"))
    r = r.withColumn("place", F.coalesce(F.element_at(place, F.col("role")), F.lit(len(fixed.ROLES))))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("o"), "key", "confidence", (F.col("confidence") >= fixed.NORMATIVE).alias("likely"))))
    groups = r.groupBy(source, "place", "role").agg(ordered.alias("members"))
    out = groups.groupBy(source).agg(F.array_sort(F.collect_list(F.struct("place", "role", F.size("members").alias("n"), "members"))).alias("groups"))
    all_ = F.array_sort(F.flatten(F.transform("groups", lambda g: F.filter(g["members"], lambda m: m["likely"]))))
    return out.select(source, "groups", F.aggregate("groups", F.lit(0), lambda n, g: n + g["n"]).alias("total"), F.slice(all_, 1, fixed.NORMATIVE_MOST).alias("likely"))


def related_or_by_digits(sources: DataFrame, number: str, edges: DataFrame, k: int, most: int = fixed.MOST_DIGITS) -> DataFrame:
    """source, dst, confidence, rank: neighbours by designation or its base; where there are none, by the digits of both.

    most: digits of the longest number there can be."""
    s = sources.select(F.col(number).alias("source"))
    keys = s.select("source", F.explode(F.array_distinct(F.array(F.col("source"), ids.base_with_year(F.col("source"))))).alias("src"))
    near = keys.join(edges, "src").groupBy("source", "dst").agg(F.max("confidence").alias("confidence"))
    rest = s.join(near.select("source"), "source", "left_anti").withColumn("_d", ids.number(F.col("source"), most)).filter("_d != ''")
    wide = edges.withColumn("_d", F.regexp_replace(F.regexp_replace(ids.base_with_year(F.col("src")), "IS ", ""), " ", ""))
    far = rest.join(wide, "_d").groupBy("source", "dst").agg(F.max("confidence").alias("confidence"))
    w = Window.partitionBy("source").orderBy(F.desc("confidence"), "dst")
    return near.unionByName(far).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def related(sources: DataFrame, key: Column, exact_edges: DataFrame, broad: Column, k: int) -> DataFrame:
    """Neighbours of each source by exact or broad key, as a union of two equi-joins; the k most confident of each."""
    s = sources.select(F.col(sources.columns[0]).alias("source"), key.alias("_exact"), broad.alias("_broad"))
    hits = s.select("source", F.explode(F.array_distinct(F.array("_exact", "_broad"))).alias("src")).join(exact_edges, "src")
    best = hits.groupBy("source", "dst").agg(F.max("confidence").alias("confidence"), F.max("co").alias("co"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("confidence"), F.desc("co"), "dst"))).filter(F.col("rank") <= k)


def neighbourhood(edges: DataFrame, root: object, hops: int = 2, each: int = 40, base: Callable[[Column], Column] | None = None) -> DataFrame:
    """node, hop of what lies within one or two hops of the root, by the ``each`` most confident edges of a node.

    With ``base``, edges that leave a node's base count as its own.
    """
    hops = min(max(hops, 1), 2)
    best = [F.desc("confidence"), F.desc("co"), "dst", "src"]
    strong = edges.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy(*best))).filter(F.col("_r") <= each).drop("_r")
    seen = edges.sparkSession.createDataFrame([(root, 0)], edges.select(F.col("src").alias("node"), F.lit(0).alias("hop")).schema)
    frontier = seen
    for hop in range(1, hops + 1):
        keys = F.array(F.col("node")) if base is None else F.array_distinct(F.array(F.col("node"), base(F.col("node"))))
        near = frontier.select("node", F.explode(keys).alias("src")).join(strong, "src")
        if base is not None:
            near = near.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy(*best))).filter(F.col("_r") <= each)
        frontier = near.select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(pairs: DataFrame, start: object, end: object, a: str = "a", b: str = "b") -> DataFrame:
    """One row: hops and the path of least text among the shortest, however long; hops is null if there is none.

    Each round moves a frontier of nodes with their best path by one equi-join and drops nodes already reached, until the
    end is reached or the frontier is empty.
    """
    spark = pairs.sparkSession
    steps = settled(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(pairs.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct())
    kind = pairs.schema[a].dataType.simpleString()
    frontier = spark.createDataFrame([(start, [start])], f"node {kind}, path array<{kind}>")
    seen, hops, found = frontier.select("node"), 0, [start] if start == end else None
    while found is None:
        hops += 1
        ahead = frontier.join(steps, F.col("node") == F.col("u")).select(F.col("v").alias("node"), F.concat("path", F.array("v")).alias("path"))
        frontier = settled(ahead.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        hit = frontier.filter(F.col("node") == F.lit(end)).limit(1).collect()  # one row at most
        if hit:
            found = hit[0].path
        elif frontier.isEmpty():
            hops = None
            break
        seen = settled(seen.unionByName(frontier.select("node")))
    return spark.createDataFrame([(hops, found)], f"hops int, path array<{kind}>")


def settled_folder(spark) -> str:
    """The application's folder in the store that driver and executors share."""
    return own_folder(spark)


def settled(df: DataFrame) -> DataFrame:
    """Cuts the lineage of an iterative plan through the folder that all executors share."""
    return written(df, "graph")


def components(links: DataFrame, a: str, b: str, rounds: int = 100, parts: int | None = None) -> DataFrame:
    """node, component (least node) of the nodes of links; see ``components`` for the method."""
    return connected(links.select(F.col(a).alias("a"), F.col(b).alias("b")), "a", "b", rounds, tasks=parts)


def stored(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Edges, mined once, as a table; and tasks of a bounded size (``ROWS``) for what comes after them, over which the nodes
    that they meet are dealt as well."""
    e = settled(edges)
    return e, tasks(e.sparkSession, max(e.count(), nodes.count() if nodes else 0), ROWS)


def ego(pairs: DataFrame, node: object) -> DataFrame:
    """The edges at a node, and its neighbours as ``other``."""
    return pairs.filter((F.col("a") == F.lit(node)) | (F.col("b") == F.lit(node))).withColumn("other", F.when(F.col("a") == F.lit(node), F.col("b")).otherwise(F.col("a")))


def family_shares(nodes: DataFrame, family: str, degree: str, key: str, parts: int | None = None) -> DataFrame:
    """Nodes in the order of a ring: by family (none last), then degree; with each family's share of the circle.

    Places are counted over ranges of the ring, so that no task holds a family whole, and those of the families before are taken off."""
    from .lookup import places

    ring = places(nodes, [F.col(family).asc_nulls_last(), F.desc(degree), F.col(key)], "_ring", parts)
    before = Window.orderBy(F.col("_family").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)  # one row for each family: few
    grouped = ring.groupBy(F.col(family).alias("_family")).agg(F.count(F.lit(1)).alias("n"))
    grouped = grouped.select("_family", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("share"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    out = ring.join(F.broadcast(grouped), F.col(family).eqNullSafe(F.col("_family")))
    out = out.repartitionByRange(parts, "_ring").sortWithinPartitions("_ring") if parts else out.orderBy("_ring")
    return out.select(*nodes.columns, (F.col("_ring") - F.col("_before")).cast("int").alias("place"), "n", "share")


def layout(pairs: DataFrame, width: float = 1040.0, height: float = 660.0, pad: float = 26.0, weight: str = "confidence", most: int = 5000, seed: int = 7) -> DataFrame:
    """node, x, y of a graph to be drawn: two eigenvectors of the normalised Laplacian, spread by rank, then pushed apart.

    A picture holds a few thousand nodes; above ``most`` the graph is refused (cut it with ``densest`` first), as one task
    holds a matrix of nodes by nodes. Nodes closer than a share of their ideal spacing are pushed apart in each pass.
    """
    import numpy as np
    import pandas as pd

    n_nodes = degrees(pairs, "a", "b").count()
    if n_nodes > most:
        raise ValueError(f"a layout of {n_nodes} nodes; {most} at most")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {n: i for i, n in enumerate(names)}
        n = len(names)
        if n < 3:
            return pd.DataFrame({"node": names, "x": width / 2, "y": height / 2})
        w = np.zeros((n, n))
        i, j = pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy()
        np.maximum.at(w, (i, j), pdf[weight].to_numpy(float))
        w = np.maximum(w, w.T)
        d = 1 / np.sqrt(np.maximum(w.sum(axis=1), 1e-9))
        _, vectors = np.linalg.eigh(np.eye(n) - d[:, None] * w * d[None, :])
        axes = vectors[:, 1:3] * d[:, None]
        spread = np.argsort(np.argsort(axes, axis=0, kind="stable"), axis=0, kind="stable") / (n - 1) - 0.5
        frame = np.array([width - 2 * pad, height - 2 * pad])
        xy = (spread + np.random.default_rng(seed).normal(0, fixed.TIE_NOISE, spread.shape)) * frame
        ideal = np.sqrt(width * height / n)
        for _ in range(fixed.SEPARATION_STEPS):
            push, near = np.zeros_like(xy), False
            for s in range(0, n, 512):  # rows in blocks: memory stays n x 512
                gap = xy[s : s + 512, None, :] - xy[None, :, :]
                length = np.sqrt((gap**2).sum(axis=2))
                length[np.arange(len(gap)), s + np.arange(len(gap))] = np.inf
                close = length < ideal * fixed.SEPARATION_RADIUS
                near |= bool(close.any())
                push[s : s + 512] = np.where(close[:, :, None], gap / np.maximum(length, 1e-6)[:, :, None], 0.0).sum(axis=1)
            if not near:
                break
            xy += push * ideal * fixed.SEPARATION_PUSH
        low, high = xy.min(axis=0), xy.max(axis=0)
        unit = (xy - low) / np.maximum(high - low, 1e-6)
        return pd.DataFrame({"node": names, "x": pad + unit[:, 0] * frame[0], "y": pad + unit[:, 1] * frame[1]})

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.select("a", "b", weight).groupBy(F.lit(1).alias("_all")).applyInPandas(lambda pdf: place(pdf), f"node {kind}, x double, y double")


def layout_quality(places: DataFrame) -> DataFrame:
    """Spread of the middle half of each axis, and the median distance to the nearest node."""
    q = places.agg(F.round(F.expr("percentile(x, 0.75) - percentile(x, 0.25)"), 3).alias("spread_x"), F.round(F.expr("percentile(y, 0.75) - percentile(y, 0.25)"), 3).alias("spread_y"))
    gap = nearest_gaps(places).agg(F.round(F.expr("percentile(gap, 0.5, n)"), 3).alias("median_gap"))
    return q.crossJoin(gap)  # two single rows


#: Side of the cells in which a node's neighbours are sought, with the cells around; spots of one cell that are compared.
CELL, CROWD = 40.0, 32


def cell_sides(spots: DataFrame, cell: float = CELL, crowd: int = CROWD) -> list[float]:
    """Sides of cells from ``cell`` down, each half of the last, until no cell holds more than ``crowd`` spots (x, y)."""
    sides = [cell]
    while sides[-1] > cell * 2**-40:
        held = spots.groupBy(F.floor(F.col("x") / sides[-1]), F.floor(F.col("y") / sides[-1])).agg(F.count(F.lit(1)).alias("n"))
        if (held.agg(F.max("n")).first()[0] or 0) <= crowd:
            break
        sides.append(sides[-1] / 2)
    return sides


def nearest_gaps(places: DataFrame, cell: float = CELL, crowd: int = CROWD) -> DataFrame:
    """gap, n: for each spot with a neighbour its distance to the nearest other node in its cell or those around it, and its nodes.

    Nodes of one spot are 0 apart. All others look in the finest cells first; a neighbour nearer than a cell's side is the
    nearest there is, and spots without one look again in cells twice as wide. Those left over lie further than half a
    side from each other, so a cell holds few of them, and pairs grow with the spots however they crowd.
    """
    spots = written(places.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), "graph-spots")
    done, rest = spots.filter("n > 1").select(F.lit(0.0).alias("gap"), "n"), spots.filter("n = 1").select("x", "y")
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(cx + i as cx, cy + j as cy))))"))
    for side in reversed(cell_sides(spots, cell, crowd)):
        cells = {"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)}
        others = spots.withColumns(cells).select(F.col("x").alias("ox"), F.col("y").alias("oy"), "cx", "cy")
        asked = rest.withColumns(cells).select("x", "y", around.alias("c")).select("x", "y", "c.cx", "c.cy")
        apart = F.when((F.col("x") != F.col("ox")) | (F.col("y") != F.col("oy")), F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2))
        found = written(asked.join(others, ["cx", "cy"], "left").groupBy("x", "y").agg(F.min(apart).alias("gap")), "graph-gaps")
        settled_ = F.col("gap").isNotNull() & (F.lit(side == cell) | (F.col("gap") < side * (1 - 1e-9)))  # a side as doubles divide it
        done = done.unionByName(found.filter(settled_).select("gap", F.lit(1).cast("long").alias("n")))
        rest = found.filter(~settled_).select("x", "y")
    return done


def visible(edges: DataFrame, nodes: DataFrame, least: int, family: str | None = None, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges of a count at least, and nodes that are of the family and, above a count of 1, still have an edge."""
    e = edges.filter(F.col("co") >= least)
    n = nodes if family is None else nodes.filter(F.col("family") == family)
    if least > 1:
        n = over_tasks(n, parts, "node").join(over_tasks(e.select(F.explode(F.array("a", "b")).alias("node")), parts, "node").distinct(), "node", "left_semi")
    return e, n


def citing(bridge: DataFrame, doc: str, cited: Column, targets: DataFrame, target: Column, buyer: str, first: int = 25) -> DataFrame:
    """For each target: documents that cite it by digits, their share of all, buyers, and the first of them."""
    t = targets.select(F.col(targets.columns[0]).alias("target"), target.alias("_k")).filter("_k != ''")
    all_ = bridge.select(doc).distinct().agg(F.count(F.lit(1)).alias("_all"))
    hits = bridge.select(F.col(doc).alias("_doc"), F.col(buyer).alias("_buyer"), cited.alias("_k")).join(t, "_k").select("target", "_doc", "_buyer").distinct()
    rank = hits.select("target", "_doc").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("target").orderBy("_doc"))).filter(F.col("_r") <= first)
    g = hits.groupBy("target").agg(F.count_distinct("_doc").alias("docs"), F.count_distinct("_buyer").alias("buyers")).crossJoin(F.broadcast(all_))  # one row
    firsts = rank.groupBy("target").agg(F.array_join(F.array_sort(F.collect_list("_doc")), " ").alias("first_docs"))
    return g.join(firsts, "target").select("target", "docs", F.round(100.0 * F.col("docs") / F.col("_all"), 1).alias("share"), "buyers", "first_docs")
