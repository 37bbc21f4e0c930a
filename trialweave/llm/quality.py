"""Quality rules: base limits, then robust multivariate outliers.

Every document gets a vector of transformed text statistics. For each
(language, source), each language and all documents together, the centre and
scatter of the vectors are estimated by minimum covariance determinant. From each of several
starts (medians and quartile ranges; all documents; values drawn in towards the median) concentration steps
re-estimate mean and covariance on the ``SUPPORT`` share of documents nearest to the last estimate. After
``FIRST`` steps the start with the least determinant goes on alone, each group until a step makes its determinant no smaller.
A document whose Mahalanobis distance from its group's estimate exceeds the
limit is rejected.

Only DataFrame functions are used. Sums are combined before the shuffle, and shares of a group are found by
counting its documents in cells (1/128 of a part, 1/64 of a power of two of a squared distance), so a group
that holds most documents is no hot spot. The nearest documents are all those up to the cell that completes
the share, so the estimate doesn't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.common import BLANK_CLASS, let, words
from trialweave.session import discard, staged

#: Share of a group's documents that an estimate rests on, and the factor that
#: makes the covariance of that share consistent for normal vectors of 5 parts.
SUPPORT = 0.75
CONSISTENCY = 1.41
#: Concentration steps from each start, and the most in all; a group has settled when its log determinant falls by no more than this.
FIRST, MOST, SETTLED = 2, 100, 1e-6
#: Cells: of a part, and of the base-2 logarithm of a squared distance.
PART_CELL, DISTANCE_CELL = 1 / 128, 1 / 64
#: Groups with fewer documents use their language's estimate, then that of all documents.
LEAST_GROUP = 60
#: Least standard deviation of each part: groups may have no spread at all in a part.
FLOORS = (0.35, 0.06, 0.30, 0.25, 0.50)
#: Quantile of chi-squared with 5 degrees of freedom at 1 - 1e-6.
LIMIT = 35.89

#: Estimates are broadcast if they are for so many groups at most; beyond that, those of groups with more than one in ``HOT`` of all rows are.
BROADCAST, HOT = 20_000, 1000

PARTS = tuple(f"x{i}" for i in range(len(FLOORS)))


def repeat_words(found: Column) -> Column:
    """How many words lie in a 3-word window that stands twice or more in ``found``."""

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(z: Column) -> Column:
            same = lambda s, k: F.coalesce(F.get(z, k)["h"] == s["h"], F.lit(False))
            marked = F.transform(z, lambda s, k: F.when(same(s, k + 1) | ((k > 0) & same(s, F.greatest(k - 1, F.lit(0)))), s["i"]))
            return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

        def union(r: Column) -> Column:
            spans = F.transform(r, lambda s, k: F.coalesce(F.least(F.get(r, k + 1) - s, F.lit(3)), F.lit(3)))
            return F.aggregate(spans, F.lit(0), lambda a, b: a + b)

        return let(let(placed, starts), union)

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, 0).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))))

    return let(found, counted)


def statistics(docs: DataFrame, *keep: Column | str) -> DataFrame:
    """One row per document: what ``keep`` names, lang, source, the counts and the base verdict."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK_CLASS}]"))
    counts = docs.select(
        F.struct(*keep).alias("kept_columns"),
        "lang",
        "source",
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.regexp_replace(text, f"[{BLANK_CLASS}]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    ).select("kept_columns", "lang", "source", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.withColumn("base_failed", failed)


def vectors(stats: DataFrame) -> DataFrame:
    """The transformed vector of each document, parts ``x0`` to ``x4``."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    repeated = F.col("n_repeat_words") / n
    parts = (
        F.log1p(F.col("n_words").cast("double")),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(20 * F.col("n_symbols") / n),
        F.log1p(5 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.log((repeated + 0.05) / (1.05 - repeated)),
    )
    return stats.withColumns(dict(zip(PARTS, parts, strict=True)))


def _keys() -> Column:
    """The group, the language and the whole, as (level, lang, source); null is a value of its own."""
    nothing = F.lit(None).cast("string")
    return F.array(*(F.struct(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source")) for k, lang, source in ((0, F.col("lang"), F.col("source")), (1, F.col("lang"), nothing), (2, nothing, nothing))))


def _key_text(key: Column) -> Column:
    shown = lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("-"))
    length = F.coalesce(F.length(key["lang"]), F.lit(-1)).cast("string")
    return F.concat_ws("/", key["level"].cast("string"), length, shown(key["lang"]), shown(key["source"]))


def _estimate(rows: DataFrame, *by: str) -> DataFrame:
    """Mean, Cholesky factor and log determinant of each group's rows, scatter floored and made consistent."""
    p = range(len(PARTS))
    sums = [F.avg(PARTS[i]).alias(f"m{i}") for i in p]
    products = [F.avg(F.col(PARTS[i]) * F.col(PARTS[j])).alias(f"s{i}{j}") for i in p for j in range(i + 1)]
    got = rows.groupBy(*by).agg(*sums, *products)

    for i in p:  # one factor column after another, so that each is computed once
        for j in range(i + 1):
            cov = CONSISTENCY * (F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}"))
            rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), cov + FLOORS[i] ** 2 if i == j else cov)  # noqa: B023
            got = got.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    return got.select(*by, *(f"m{i}" for i in p), *(f"l{i}{j}" for i in p for j in range(i + 1)), _log_determinant().alias("log_det"))


def _log_determinant() -> Column:
    return reduce(lambda a, i: a + 2 * F.log(f"l{i}{i}"), range(1, len(PARTS)), 2 * F.log("l00"))


def _squared_distance() -> Column:
    """Squared Mahalanobis distance, by forward substitution with the factor."""
    z: list[Column] = []
    for i, x in enumerate(PARTS):
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * z[k], range(i), F.col(x) - F.col(f"m{i}"))  # noqa: B023
        z.append(rest / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, (v * v for v in z))


def cell_shares(cells: DataFrame, by: list[str], shares: tuple[float, ...]) -> DataFrame:
    """For each group, and for each share, the first cell up to which so many of its rows lie: q0, q1.., and n, its rows. ``cells`` has a row's ``cell``."""
    counts = cells.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n"))
    so_far, total = F.sum("n").over(Window.partitionBy(*by).orderBy("cell")), F.sum("n").over(Window.partitionBy(*by))
    counts = counts.select(*by, "cell", so_far.alias("so_far"), total.alias("total"))
    return counts.groupBy(*by).agg(F.max("total").alias("n"), *(F.min(F.when(F.col("so_far") >= x * F.col("total"), F.col("cell"))).alias(f"q{k}") for k, x in enumerate(shares)))


def _medians(rows: DataFrame) -> DataFrame:
    """key, n, and for each part its median m and scale s, from the quartiles."""
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.floor(F.col(x) / PART_CELL).alias("cell")) for i, x in enumerate(PARTS)))).alias("v")
    found = cell_shares(rows.select("key", values).select("key", "v.*"), ["key", "part"], (0.25, 0.5, 0.75))
    scale = (F.col("q2") - F.col("q0")) * PART_CELL / 1.349
    of = lambda i, c: F.max(F.when(F.col("part") == i, c))
    each = [x for i in range(len(PARTS)) for x in (of(i, (F.col("q1") + 0.5) * PART_CELL).alias(f"m{i}"), F.sqrt(F.pow(of(i, scale), 2) + FLOORS[i] ** 2).alias(f"s{i}"))]
    return found.groupBy("key").agg(F.max("n").alias("n"), *each)


Join = Callable[..., DataFrame]


def _by_group(sizes: DataFrame) -> Join:
    """How rows meet the estimates of their groups, given each group's key and n.

    Few groups are broadcast. Of many, those that are the key of so many rows that a task couldn't take them are, and there are at most three times ``HOT`` of these
    (a row has three keys); the others are shuffled.
    """
    groups, total = sizes.agg(F.count(F.lit(1)), F.sum("n")).first()
    few = groups <= BROADCAST
    hot = [] if few else [r["key"] for r in sizes.where(F.col("n") * HOT * 3 > total).select("key").collect()]

    def join(rows: DataFrame, table: DataFrame, key: str = "key", also: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
        if few:
            return rows.join(F.broadcast(table), [key, *also], how)
        named = F.col(key).isin(hot)
        return rows.where(named).join(F.broadcast(table.where(named)), [key, *also], how).unionByName(rows.where(~named).join(table.where(~named), [key, *also], how))

    return join


def _starts(rows: DataFrame, middle: DataFrame, join: Join) -> DataFrame:
    """key, start and an estimate, from medians and quartile ranges, from all rows, and from rows drawn in towards the median."""
    p = range(len(PARTS))
    factor = [(F.col(f"s{i}") if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in p for j in range(i + 1)]
    by_quartiles = middle.select("key", F.lit(0).alias("start"), *(f"m{i}" for i in p), *factor).withColumn("log_det", _log_determinant())
    drawn = [(F.col(f"m{i}") + F.col(f"s{i}") * F.tanh((F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}"))).alias(x) for i, x in enumerate(PARTS)]
    both = join(rows, middle).select("key", F.explode(F.array(F.struct(F.lit(1).alias("start"), *PARTS), F.struct(F.lit(2).alias("start"), *drawn))).alias("x")).select("key", "x.*")
    return by_quartiles.unionByName(_estimate(both, "key", "start"))


def _concentrated(rows: DataFrame, now: DataFrame, join: Join) -> DataFrame:
    """One step: the estimate of the ``SUPPORT`` share of rows nearest to the last estimate."""
    cell = F.floor(F.log2(_squared_distance() + 2.0**-40) / DISTANCE_CELL)
    near = join(rows, now).select("key", "start", *PARTS, cell.alias("cell"))
    cuts = cell_shares(near, ["key", "start"], (SUPPORT,)).select("key", "start", "q0")
    return _estimate(join(near, cuts, also=("start",)).where("cell <= q0"), "key", "start")


def estimates(vecs: DataFrame) -> tuple[DataFrame, Join]:
    """Minimum-covariance-determinant estimate of every key: n, m0.., l00.., log_det and settled; and how rows are joined with it.

    Groups whose determinant has settled are left alone; only rows of the others are read again.
    """
    rows = vecs.select(F.explode(_keys()).alias("k"), *PARTS).select(_key_text(F.col("k")).alias("key"), *PARTS)
    rows = staged(rows, "mcd-rows")  # read by every step
    middle = staged(_medians(rows), "mcd-medians")
    join = _by_group(middle.select("key", "n"))
    now = staged(_starts(rows, middle, join), "mcd-starts")
    done: DataFrame | None = None
    for step in range(MOST):
        after = _concentrated(rows, now, join)
        if step < FIRST - 1:
            now = staged(after, "mcd-step")
            continue
        if step == FIRST - 1:
            best = Window.partitionBy("key").orderBy("log_det", "start")
            now = staged(after.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place"), "mcd-best")
            continue
        # As shares end with a cell, a step can make a determinant greater: then the estimate before it stays.
        both = after.join(now.select("key", F.struct(*(c for c in now.columns if c != "key")).alias("was")), "key")
        worse = F.col("log_det") > F.col("was.log_det") + SETTLED
        kept = (F.when(worse, F.col(f"was.{c}")).otherwise(F.col(c)).alias(c) for c in now.columns if c != "key")
        after = staged(both.select("key", *kept, (F.col("log_det") >= F.col("was.log_det") - SETTLED).alias("settled")), "mcd-step")
        ended = after.where("settled")
        done = ended if done is None else done.unionByName(ended)
        now = after.where("not settled").drop("settled")
        if now.isEmpty():
            break
    if done is None or not now.isEmpty():
        left = now.withColumn("settled", F.lit(False))
        done = left if done is None else done.unionByName(left)
    found = staged(done.join(middle.select("key", "n"), "key").drop("start"), "mcd")
    discard(rows)
    return found, join


def _judged(docs: DataFrame, keep: tuple[Column | str, ...], limit: float, least_group: int) -> DataFrame:
    """``statistics`` of every row with distance, settled and kept."""
    vecs = vectors(staged(statistics(docs, *keep), "quality-statistics"))
    found, join = estimates(vecs.where(~F.col("base_failed")))
    chosen = vecs.select("*", *(_key_text(_keys()[k]).alias(f"key{k}") for k in range(3)))
    sizes = found.select("key", "n").where(F.col("n") >= least_group)  # a row for each group
    for k in range(3):
        chosen = join(chosen, sizes.select(F.col("key").alias(f"key{k}"), F.col("n").alias(f"n{k}")), f"key{k}", how="left")
    key = F.coalesce(*(F.when(F.col(f"n{k}").isNotNull(), F.col(f"key{k}")) for k in range(3)), F.lit(""))
    scored = join(chosen.withColumn("key", key), found, how="left").withColumn("distance", _squared_distance())
    return scored.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True)))


def quality_rules(docs: DataFrame, limit: float = LIMIT, least_group: int = LEAST_GROUP) -> DataFrame:
    """Statistics and verdict for every row of ``docs`` (doc_id, text, lang, source).

    Returns doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, base_failed, distance (squared; null where no
    estimate applies), kept and settled (whether the estimate stopped changing; null where none applies). Null text counts as empty and fails; null
    language or source forms a group of its own; a repeated row gets the same
    verdict as the row it repeats; an empty table gives no rows; other columns
    are ignored. Estimates come from documents that pass the base limits. A
    group of fewer than ``least_group`` uses its language's estimate, then that
    of all; if those are as few, no document is rejected by distance.
    """
    names = ("lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "distance", "kept", "settled")
    return _judged(docs, ("doc_id",), limit, least_group).select("kept_columns.doc_id", *names)


def quality_filter(docs: DataFrame, limit: float = LIMIT, least_group: int = LEAST_GROUP) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns, whatever these are called."""
    return _judged(docs, tuple(docs.columns), limit, least_group).where("kept").select("kept_columns.*")
