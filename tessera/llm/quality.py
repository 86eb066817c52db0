"""Quality rules: base counts of each text, and robust multivariate outliers within its language and source.

All of it is DataFrame plans. A text's counts are made within its row. Texts that pass the base rules get a vector of four
transformed statistics (AXES), in whole units of 1/UNIT, so that their sums are exact and reruns agree. For each language and
source the minimum-covariance-determinant estimate is sought by concentration steps: mean and covariance of a subset,
distances of all rows, and as the next subset the h rows that lie nearest. Two starts are followed, all rows and the distances
from the medians, and the one with the lesser determinant counts. Rows whose squared Mahalanobis distance is CUTOFF or more
are rejected.

The h-th distance is found by counting rows by bins of distance, never by ordering a group, and all rows of its bin are
taken. Estimates are one row a group: they go out by broadcast up to the library's bound; beyond it hot groups are dealt
over tasks. FLOOR squared is added to each variance, so that a source in which a statistic hardly varies rejects nobody for
a single symbol. Sources of fewer than LEAST rows are taken together, by language; where those are still fewer, all are kept.

Defined results: null text has no words and fails the base rules. Null languages and sources are values of their own. Rows
count one by one, equal ones too; ids may repeat or be null. An empty table gives an empty result; other columns are not read.
A text and its words are held by one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WORD, skew_join, written

#: Base rules: words that a text needs, and the per cent of them that may lie in repeated windows.
WORDS, REPEATED = 50, 50
#: Units of a statistic's whole number, and the standard deviation in units that each axis has at least.
UNIT, FLOOR = 1024, 48
AXES = ("word_length", "symbols", "repeats", "same_lines")
#: Quarters of a group's rows that an estimate rests on, concentration steps, and rows that a group needs.
QUARTERS, STEPS, LEAST = 3, 5, 20
#: Squared distances are counted in steps of 1/FINE, up to BINS of them; what is beyond shares the last.
FINE, BINS = 16, 1 << 16
#: Squared Mahalanobis distance from which on a text is rejected.
CUTOFF = 100.0
#: Bytes of a group's estimate.
ROW_BYTES = 512
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
X = [f"x{i}" for i in range(len(AXES))]
PLACE = (1 << 24) - 1


def consistency(share: float) -> float:
    """What the covariance of the nearest share of a normal sample in four dimensions is too small by."""
    below = lambda x: 1 - math.exp(-x / 2) * (1 + x / 2)  # noqa: E731 - chi-square of four degrees
    low, high = 0.0, 100.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < share else (low, mid)
    return share / (1 - math.exp(-low / 2) * (1 + low / 2 + low * low / 8))


def counted(docs: DataFrame, *keep: str, text: str = "text", bits: int = 40) -> DataFrame:
    """The columns to keep and the counts BASE of each row's text.

    Windows of three words are sorted by ``bits`` bits of a hash with their place below them, and neighbours of equal hashes are
    compared by their words. Where unequal ones share a hash, and beyond 2^24 words, the words themselves are sorted.
    """
    high = ~PLACE & ((1 << (24 + bits)) - 1)
    high -= (high >> 63) << 64  # as a signed long
    rows = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    rows = rows.withColumn("_w", F.array_remove(F.split("_t", "[\\x20\\x09-\\x0D]+", -1), ""))
    rows = rows.withColumn("_lines", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD)))
    rows = rows.select(
        *keep,
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    window = lambda i: f"xxhash64(get(_w, {i}), get(_w, {i} + 1), get(_w, {i} + 2))"
    same = lambda i, j: " and ".join(f"get(_w, {i} + {k}) = get(_w, {j} + {k})" for k in range(3))
    alike = lambda x, y: f"coalesce(({x} ^ {y}) & {high}L, -1L) = 0L"
    places = "sequence(0, cast(n_words as int) - 3)"
    rows = rows.withColumn("_h", F.sort_array(F.expr(f"if(n_words >= 3, transform({places}, i -> ({window('i')} & {high}L) | i), cast(array() as array<bigint>))")))
    rows = rows.withColumn("_d", F.expr(f"filter(_h, (x, k) -> {alike('x', 'get(_h, k + 1)')} or {alike('x', 'get(_h, k - 1)')})"))
    at = lambda x: f"cast({x} & {PLACE}L as int)"
    mixed = f"n_words > {PLACE} or exists(transform(_d, (x, k) -> {alike('x', 'get(_d, k + 1)')} and not ({same(at('x'), at('get(_d, k + 1)'))})), x -> x)"
    plain = f"array_sort(transform({places}, i -> struct(get(_w, i) as a, get(_w, i + 1) as b, get(_w, i + 2) as c, cast(i as bigint) as i)))"
    equal = lambda k: f"coalesce(get(s, {k}).a = x.a and get(s, {k}).b = x.b and get(s, {k}).c = x.c, false)"
    sure = f"transform(array({plain}), s -> transform(filter(s, (x, k) -> {equal('k + 1')} or {equal('k - 1')}), x -> x.i))[0]"
    rows = rows.withColumn("_p", F.sort_array(F.expr(f"if({mixed}, {sure}, transform(_d, x -> x & {PLACE}L))")))
    covered = F.expr("aggregate(_p, cast(struct(0L, -3L) as struct<n: bigint, last: bigint>), (s, p) -> struct(s.n + least(3L, p - s.last) as n, p as last), s -> s.n)")
    return rows.select(*keep, *BASE[:-1], covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))


def statistics() -> list[Column]:
    """Whole numbers for AXES: a logarithm of the mean length, and square roots of shares, of a text with a word."""
    units = lambda c: F.floor(UNIT * c)
    root = lambda a, b: units(F.sqrt(F.col(a) / F.col(b)))
    return [units(F.log(F.col("word_chars") / F.col("n_words"))), root("n_symbols", "word_chars"), root("n_repeat_words", "n_words"), root("n_dup_lines", "n_words")]


def _triangle(i: int, j: int) -> str:
    return f"l{i}{j}"


def _estimate(sums: DataFrame, keys: list[str]) -> DataFrame:
    """m (means) and l (the lower triangle whose product with itself is the covariance), and the determinant, from exact sums."""
    n, out = F.col("k").cast("double"), sums
    for i, x in enumerate(X):
        out = out.withColumn(f"m{i}", F.col(f"s_{x}").cast("double") / n)
    for i in range(len(X)):
        for j in range(i + 1):
            c = F.col(f"s_{X[j]}_{X[i]}").cast("double") / n - F.col(f"m{i}") * F.col(f"m{j}")
            c = c + F.lit(float(FLOOR * FLOOR)) if i == j else c
            for k in range(j):
                c = c - F.col(_triangle(i, k)) * F.col(_triangle(j, k))
            out = out.withColumn(_triangle(i, j), F.sqrt(F.greatest(c, F.lit(1.0))) if i == j else c / F.col(_triangle(j, j)))
    det = F.lit(1.0)
    for i in range(len(X)):
        det = det * F.col(_triangle(i, i))
    return out.withColumn("det", det).select(*keys, *ESTIMATE)


ESTIMATE = [*(f"m{i}" for i in range(len(X))), *(_triangle(i, j) for i in range(len(X)) for j in range(i + 1)), "det"]


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d, the squared distance of x from m under l."""
    total, made = F.lit(0.0), []
    for i, x in enumerate(X):
        y = F.col(x).cast("double") - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(_triangle(i, k)) * F.col(f"_y{k}")
        rows = rows.withColumn(f"_y{i}", y / F.col(_triangle(i, i)))
        total = total + F.col(f"_y{i}") * F.col(f"_y{i}")
        made.append(f"_y{i}")
    return rows.withColumn("d", total).drop(*made)


def _beside(rows: DataFrame, groups: DataFrame, n_groups: int, total: int, how: str = "inner") -> DataFrame:
    """rows with their group's row, by _g; groups have n, their number of rows."""
    if n_groups * ROW_BYTES <= BROADCAST_BYTES:
        return rows.join(F.broadcast(groups), "_g", how)
    rest = [c for c in groups.columns if c not in ("_g", "n")]
    one = groups.groupBy("_g", "n").agg(F.collect_list(F.struct(*rest)).alias("_e"))  # of two starts at most
    joined = skew_join(rows, one, ["_g"], "n", total, F.xxhash64(*BASE), how)
    return joined.select(*rows.columns, "n", F.inline_outer("_e"))


def _sums(near: DataFrame, keys: list[str]) -> DataFrame:
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    pairs = [exact(F.col(X[j]) * F.col(X[i])).alias(f"s_{X[j]}_{X[i]}") for i in range(len(X)) for j in range(i + 1)]
    return near.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), *[exact(F.col(x)).alias(f"s_{x}") for x in X], *pairs)


def _bin() -> Column:
    return F.least(F.floor(F.col("d") * FINE), F.lit(BINS))


def estimates(rows: DataFrame, groups: DataFrame, n_groups: int, total: int) -> DataFrame:
    """_g, n and the estimate (ESTIMATE) of each group of rows (_g, BASE, X); groups: _g, n."""
    keys = ["_g", "n", "start"]
    # quartiles of each axis by counts of its whole numbers
    cells = rows.select("_g", F.expr(f"stack({len(X)}, {', '.join(f'{i}, {x}' for i, x in enumerate(X))}) as (axis, x)")).groupBy("_g", "axis", "x").agg(F.count(F.lit(1)).alias("c"))
    up_to = F.sum("c").over(Window.partitionBy("_g", "axis").orderBy("x"))
    ranks = cells.withColumn("up_to", up_to).join(groups, "_g")
    at = lambda q: F.min(F.when(4 * F.col("up_to") >= q * F.col("n"), F.col("x")))
    marks = ranks.groupBy("_g", "n", "axis").agg(at(1).alias("a"), at(2).alias("b"), at(3).alias("c"))
    wide = marks.groupBy("_g", "n").agg(*[F.max(F.when(F.col("axis") == i, F.col(c))).alias(f"{c}{i}") for i in range(len(X)) for c in "abc"])
    spread = lambda i: F.greatest((F.col(f"c{i}") - F.col(f"a{i}")).cast("double") / F.lit(1.349), F.lit(float(FLOOR)))
    middle = wide.select("_g", "n", F.lit(1).alias("start"), *[F.col(f"b{i}").cast("double").alias(f"m{i}") for i in range(len(X))], *[(spread(i) if i == j else F.lit(0.0)).alias(_triangle(i, j)) for i in range(len(X)) for j in range(i + 1)], F.lit(0.0).alias("det"))
    whole = _estimate(_sums(rows.withColumn("start", F.lit(0)), ["_g", "start"]).join(groups, "_g"), keys)
    at_hand = written(whole.unionByName(middle), "quality-estimates")
    for _ in range(STEPS):
        placed = _distance(_beside(rows, at_hand, 2 * n_groups, total)).withColumn("bin", _bin())
        bins = placed.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("c"))
        seen = bins.withColumn("up_to", F.sum("c").over(Window.partitionBy(*keys).orderBy("bin")))
        need = F.floor(F.col("n") * QUARTERS / 4) + 1
        radius = seen.filter(F.col("up_to") >= need).groupBy("_g", "start").agg(F.min("bin").alias("radius"))
        known = written(at_hand.join(radius, ["_g", "start"]), "quality-radius")
        near = _distance(_beside(rows, known, 2 * n_groups, total)).filter(_bin() <= F.col("radius"))
        at_hand = written(_estimate(_sums(near, keys), keys), "quality-estimates")
    best = at_hand.groupBy("_g", "n").agg(F.min_by(F.struct(*ESTIMATE), F.struct("det", "start")).alias("e"))
    return best.select("_g", "n", "e.*")


def judged(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, BASE, base_failed, kept and distance (null where none was taken) of each row."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = counted(named, "doc_id", "lang", "source").withColumn("base_failed", base_failed())
    stats = [F.when(~F.col("base_failed"), s).alias(x) for s, x in zip(statistics(), X)]
    own = F.to_json(F.struct("lang", "source"))
    rows = written(rows.select("doc_id", "lang", *BASE, "base_failed", *stats, F.when(~F.col("base_failed"), own).alias("_g")), "quality-rows")
    passed = rows.filter("not base_failed")
    sizes = written(passed.groupBy("_g", "lang").agg(F.count(F.lit(1)).alias("n")), "quality-sizes")
    n_sizes, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    rest = F.concat(F.lit("*"), F.to_json(F.struct("lang")))
    renamed = sizes.select("_g", "n", F.when(F.col("n") < LEAST, rest).otherwise(F.col("_g")).alias("_to"))
    rows = _beside(rows.withColumn("_g", F.coalesce("_g", F.lit(""))), renamed, n_sizes, total, "left").drop("_g", "n").withColumn("_g", F.coalesce("_to", F.lit(""))).drop("_to")
    groups = renamed.groupBy(F.col("_to").alias("_g")).agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
    groups = written(groups, "quality-groups")
    found = written(estimates(rows.filter("_g != ''").select("_g", *BASE, *X), groups, n_sizes, total), "quality-found")
    judged = _distance(_beside(rows, found, n_sizes, total, "left")).withColumn("distance", F.col("d") / F.lit(consistency(QUARTERS / 4)))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") < F.lit(CUTOFF), F.lit(True))
    return judged.select("doc_id", *BASE, "base_failed", kept.alias("kept"), "distance")

