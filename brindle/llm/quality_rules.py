"""Quality rules: base statistics per document, and robust multivariate outliers by minimum covariance determinant.

Everything on the main path is DataFrame or SQL functions. Base statistics are array expressions within
a row. The documents that pass the base rules give a vector of transformed statistics; per language and
source a minimum-covariance-determinant (MCD) estimate of centre and scatter is made by concentration
steps: again and again keep the ``SUPPORT`` share of vectors with the smallest Mahalanobis distance and take their mean
and covariance. There are ``STARTS`` starts: medians with median absolute deviations, and means and covariances of small
subsets chosen by hash. After ``FIRST_STEPS`` steps the one of least determinant goes on, group by group, until its
determinant falls no more (``MAX_STEPS`` at most; a group that settled takes no further steps). Distances come from a
Cholesky factor written out as column expressions, so there is no matrix on the driver and no limit on the number of groups.

Statistics that hardly vary in a group add little to its distances, which therefore follow a scaled
chi-square law of fewer than five degrees of freedom. The cube root of any such variable is nearly normal
(Wilson and Hilferty), so each group's cube roots are brought to the median and the upper quartile of
those of chi-square with five degrees, over all vectors of the group; the spread is never widened. A
document beyond ``CUTOFF``, the 99.9 % point of that law, goes. Kept are texts whose statistics are
within it, whatever they say, and odd ones of a kind that makes up over a quarter of its group, as the
estimate then takes that kind for ordinary.

A group of fewer than ``MIN_GROUP`` vectors is judged by its language's estimate, and a language of fewer
by that of the whole corpus; these are estimated only where some group needs them. Quantiles are read from histograms of
fixed, relatively narrow bins (``BINS`` to a factor of e; the greatest value of the bin that holds the quantile), so they
don't depend on partitions, and a group's shuffle is as small as its histogram; sums are pre-aggregated. So a language
or source with a third of all rows costs a histogram a task. The per-document vectors are written once and read by the
steps.

Defined results: a null text has no words and fails the base rules, as every text under 50 words
does. Null languages and sources are groups of their own. Repeated rows count and return repeatedly.
An empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.common import materialise, numbered, without

SPACE = r"[\x20\x09-\x0D]+"
GRAM = 3
SUPPORT = 0.75
STARTS = 3
SUBSET = 50
FIRST_STEPS = 2
MAX_STEPS = 40
SETTLED = 1e-6
MIN_GROUP = 200
BINS = 512
LOWEST = 1e-3
BROADCAST_GROUPS = 20_000
#: Points of chi-square with five degrees of freedom: 99.9 %, the median and the upper quartile.
CUTOFF = 20.515
CHI2_MEDIAN = 4.351460
CHI2_QUARTILE = 6.625680
#: Least standard deviation of each transformed statistic: a statistic that hardly varies says little, and the
#: mean word length and the shares of short texts vary by chance.
FEATURES = {"f_length": 0.25, "f_word_chars": 0.25, "f_symbols": 0.25, "f_dup_lines": 0.25, "f_repeat": 0.15}

_HASHES = "transform(w, x -> xxhash64(x))"
_WINDOW_HASH = "xxhash64(x, get(h, i + 1), get(h, i + 2))"


def _windows(window_hash: str) -> str:
    """Hash of each 3-word window above its position, so that sorting brings equal windows together."""
    return f"sort_array(slice(transform(h, (x, i) -> shiftleft({window_hash}, bits) | cast(i AS BIGINT)), 1, size(h) - {GRAM - 1}))"


def _same_words(other: str) -> str:
    here, there = "cast(x & mask AS INT)", f"cast({other} & mask AS INT)"
    return " AND ".join(f"get(w, {here} + {k}) = get(w, {there} + {k})" for k in range(GRAM))


def _same_hash(other: str) -> str:
    return f"shiftright(x, bits) = shiftright({other}, bits)"


def _repeated() -> str:
    """Positions of the windows that occur again. Windows of equal hash are neighbours; only where such neighbours have
    different words, all windows of that hash are compared."""
    before, after = "get(s, j - 1)", "get(s, j + 1)"
    beside = " OR ".join(map(_same_hash, (before, after)))
    near = " OR ".join(f"({_same_hash(y)} AND {_same_words(y)})" for y in (before, after))
    anywhere = f"exists(s, y -> y <> x AND {_same_hash('y')} AND {_same_words('y')})"
    again = f"IF({beside}, IF(({near}) OR {anywhere}, x & mask, CAST(NULL AS BIGINT)), CAST(NULL AS BIGINT))"
    return f"sort_array(array_compact(transform(s, (x, j) -> {again})))"


_COVERED = f"""aggregate(at, named_struct('n', 0L, 'end', 0L),
    (a, p) -> named_struct('n', a.n + p + {GRAM}L - greatest(a.end, p), 'end', p + {GRAM}L), a -> a.n)"""


def base_statistics(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source"), more: tuple[str, ...] = (), window_hash: str = _WINDOW_HASH
) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ``more`` (n_lines: not blank) and base_failed of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(*keep, text.alias("text"))
    rows = rows.select(
        *keep,
        F.array_remove(F.split("text", SPACE, -1), "").alias("w"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        lines.alias("lines"),
    )
    rows = rows.withColumns({"n_words": F.size("w").cast("long"), "n_lines": F.size("lines"), "n_distinct": F.size(F.array_distinct("lines"))})
    rows = rows.withColumn("bits", F.length(F.bin("n_words"))).withColumn("mask", F.expr("shiftleft(1L, bits) - 1L"))
    for name, made in (("h", _HASHES), ("s", _windows(window_hash)), ("at", _repeated())):
        rows = rows.withColumn(name, F.expr(f"IF(n_words > {GRAM}, {made}, CAST(NULL AS array<bigint>))"))
    return rows.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.col("n_lines") - F.col("n_distinct")).cast("long").alias("n_dup_lines"),
        F.coalesce(F.expr(_COVERED), F.lit(0)).cast("long").alias("n_repeat_words"),
        *more,
    ).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )


def _features(rows: DataFrame) -> DataFrame:
    """The transformed statistics; defined where base_failed is false, so n_words is 50 or more."""
    n = F.col("n_words").cast("double")
    made = (
        F.ln(n),
        F.col("word_chars") / n,
        F.ln(1 + 100 * F.col("n_symbols") / F.col("word_chars")),
        F.col("n_dup_lines") / F.col("n_lines"),
        F.col("n_repeat_words") / n,
    )
    return rows.withColumns({k: F.when(~F.col("base_failed"), v) for k, v in zip(FEATURES, made, strict=True)})


def _key(level: int) -> Column:
    """Of the group of a row at that level: 0 language and source, 1 language, 2 the corpus."""
    parts = (F.col("lang").isNull(), F.col("lang"), F.col("source").isNull(), F.col("source"))
    return F.xxhash64(F.lit(level), *parts[: (4, 2, 0)[level]])


def _with_groups(vectors: DataFrame, min_group: int) -> DataFrame:
    """Adds ``judge``, the key of the group that judges the row, and ``keys``, those of the groups that it is counted in."""
    groups = vectors.groupBy("lang", "source").agg(F.count_if(~F.col("base_failed")).alias("n"))
    within = Window.partitionBy("lang")
    groups = groups.withColumn("lang_n", F.sum("n").over(within))
    level = F.when(F.col("n") >= min_group, 0).when(F.col("lang_n") >= min_group, 1).otherwise(2)
    groups = groups.withColumn("level", level).withColumn("lang_needed", F.max((F.col("level") == 1) & (F.col("n") > 0)).over(within))
    groups = groups.select(_key(0).alias("key0"), "level", "lang_needed")
    groups = materialise(groups, "quality-groups")
    corpus_needed = not groups.where("level = 2").isEmpty()
    keys = [F.when(F.col("level") == 0, _key(0)), F.when(F.col("lang_needed"), _key(1)), F.when(F.lit(corpus_needed), _key(2))]
    judge = F.when(F.col("level") == 0, _key(0)).when(F.col("level") == 1, _key(1)).otherwise(_key(2))
    met = _join(vectors.withColumn("key0", _key(0)), groups, _few(groups), "key0")
    return met.withColumns({"judge": judge, "keys": F.array_compact(F.array(*keys))}).drop("key0", "level", "lang_needed")


def _squared_distance() -> Column:
    """Of a vector to the centre m_i under the Cholesky factor l_ij, by forward substitution."""
    names = list(FEATURES)
    solved: list[str] = []
    for i, f in enumerate(names):
        less = "".join(f" - l_{i}_{j} * ({solved[j]})" for j in range(i))
        solved.append(f"({f} - m_{i}{less}) / l_{i}_{i}")
    return F.expr(" + ".join(f"pow({z}, 2)" for z in solved))


def _estimates(sums: DataFrame) -> DataFrame:
    """key, start, m_i, the Cholesky factor l_ij of the covariance v_ij, its diagonal raised to the least variances, and ``log_det``."""
    floors = list(FEATURES.values())
    made = []  # each may refer to those before it
    for j in range(len(floors)):
        inner = "".join(f" - pow(l_{j}_{k}, 2)" for k in range(j))
        made.append(f"sqrt(greatest(v_{j}_{j}{inner}, {floors[j] ** 2})) AS l_{j}_{j}")
        for i in range(j + 1, len(floors)):
            cross = "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
            made.append(f"(v_{i}_{j}{cross}) / l_{j}_{j} AS l_{i}_{j}")
    log_det = " + ".join(f"2 * ln(l_{j}_{j})" for j in range(len(floors)))
    return sums.selectExpr("key", "start", *(f"m_{i}" for i in range(len(floors))), *made, f"{log_det} AS log_det")


def _moments(rows: DataFrame) -> DataFrame:
    """Estimates from the mean and covariance of each key's and start's rows."""
    names = list(FEATURES)
    return _estimates(
        rows.groupBy("key", "start").agg(
            *(F.avg(f).alias(f"m_{i}") for i, f in enumerate(names)),
            *(F.covar_pop(a, b).alias(f"v_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j <= i),
        )
    )


def _few(groups: DataFrame) -> bool:
    """Whether a count shows groups to be few enough for broadcasting."""
    return groups.count() <= BROADCAST_GROUPS


def _join(rows: DataFrame, groups: DataFrame, few: bool, on: str | list[str] = "key") -> DataFrame:
    """Rows with their group's columns."""
    return rows.join(F.broadcast(groups) if few else groups, on)


def _bin(v: Column) -> Column:
    return F.floor(F.ln(v + LOWEST) * BINS).cast("int")


def quantiles(rows: DataFrame, by: list[str], values: dict[str, str], shares: tuple[float, ...]) -> DataFrame:
    """``by`` and, for each name in ``values`` (to a column that is never negative), an array of its quantiles by group."""
    cells = F.array(*(F.struct(F.lit(k).alias("name"), F.col(c).alias("v")) for k, c in values.items()))
    each = rows.select(*by, F.inline(cells)).withColumn("bin", _bin(F.col("v")))
    bins = each.groupBy(*by, "name", "bin").agg(F.count("*").alias("n"), F.max("v").alias("v"))
    whole = Window.partitionBy(*by, "name")
    bins = bins.withColumns({"up_to": F.sum("n").over(whole.orderBy("bin")), "of": F.sum("n").over(whole)})
    found = [F.min(F.when(F.col("up_to") >= F.ceil(F.col("of") * q), F.struct("bin", "v")))["v"] for q in shares]
    wide = bins.groupBy(*by, "name").agg(F.array(*found).alias("q"))
    return wide.groupBy(*by).agg(*(F.max(F.when(F.col("name") == k, F.col("q"))).alias(k) for k in values))


def _starts(rows: DataFrame, n_starts: int) -> tuple[DataFrame, bool]:
    """Estimates to start from, by key: the robust one without correlations (start 0), and those of small subsets; and
    whether the groups are few."""
    names = list(FEATURES)
    middle = quantiles(rows, ["key"], {f"m_{i}": f for i, f in enumerate(names)}, (0.5,))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    middle = materialise(middle.join(sizes, "key").select("key", "n", *(F.col(f"m_{i}")[0].alias(f"m_{i}") for i in range(len(names)))), "mcd-median")
    few = _few(middle)
    off = _join(rows, middle, few).select("key", *(F.abs(F.col(f) - F.col(f"m_{i}")).alias(f) for i, f in enumerate(names)))
    spread = quantiles(off, ["key"], {f"d_{i}": f for i, f in enumerate(names)}, (0.5,))
    robust = middle.join(spread, "key").withColumns(
        {f"v_{i}_{j}": F.pow(1.4826 * F.col(f"d_{i}")[0], 2) if i == j else F.lit(0.0) for i in range(len(names)) for j in range(i + 1)}
    )
    found = _estimates(robust.withColumn("start", F.lit(0)))
    if n_starts > 1:
        among = F.ceil(F.col("n") / SUBSET)
        chosen = F.filter(F.sequence(F.lit(1), F.lit(n_starts - 1)), lambda k: F.pmod(F.xxhash64(k, *names), among) == 0)
        subsets = _join(rows, middle.select("key", "n"), few).select("key", *names, F.explode(chosen).alias("start"))
        found = found.unionByName(_moments(subsets))
    return materialise(found, "mcd-start"), few


def _concentrate(rows: DataFrame, now: DataFrame, few: bool) -> DataFrame:
    """The estimates after one concentration step from each of ``now``, in one pass over the rows.

    Moments are summed by bin of the distance, around the centre so far; those of the nearest bins that hold the ``SUPPORT``
    share make the next estimate.
    """
    at = range(len(FEATURES))
    pairs = [(i, j) for i in at for j in range(i + 1)]
    centres = [f"m_{i}" for i in at]
    off = [(F.col(f) - F.col(m)).alias(f"x_{i}") for i, (f, m) in enumerate(zip(FEATURES, centres, strict=True))]
    far = _join(rows, now, few).select("key", "start", *centres, *off, _bin(_squared_distance()).alias("bin"))
    cells = far.groupBy("key", "start", "bin").agg(
        F.count("*").alias("n"),
        *(F.max(m).alias(m) for m in centres),
        *(F.sum(f"x_{i}").alias(f"s_{i}") for i in at),
        *(F.sum(F.col(f"x_{i}") * F.col(f"x_{j}")).alias(f"p_{i}_{j}") for i, j in pairs),
    )
    whole = Window.partitionBy("key", "start")
    cells = cells.withColumns({"up_to": F.sum("n").over(whole.orderBy("bin")), "of": F.sum("n").over(whole)})
    sums = ["n", *(f"s_{i}" for i in at), *(f"p_{i}_{j}" for i, j in pairs)]
    near = cells.where(F.col("up_to") - F.col("n") < F.ceil(F.col("of") * SUPPORT)).groupBy("key", "start")
    summed = near.agg(*(F.max(m).alias(m) for m in centres), *(F.sum(c).alias(c) for c in sums))
    means = [f"m_{i} + s_{i} / n AS m_{i}" for i in at]
    return _estimates(summed.selectExpr("key", "start", *means, *(f"p_{i}_{j} / n - s_{i} / n * (s_{j} / n) AS v_{i}_{j}" for i, j in pairs)))


def mcd_estimates(rows: DataFrame, n_starts: int = STARTS) -> DataFrame:
    """Per group ``key``: centre, Cholesky factor, ``scale`` (for the median squared distance) and ``spread`` (for the upper quartile)."""
    now, few = _starts(rows, n_starts)
    for _ in range(FIRST_STEPS):
        now = materialise(_concentrate(rows, now, few), "mcd")
    columns = [c for c in now.columns if c != "key"]
    best = now.groupBy("key").agg(F.min_by(F.struct(*columns), F.struct("log_det", "start")).alias("b"))
    now = materialise(best.select("key", "b.*"), "mcd-best")
    settled = now.limit(0)
    for _ in range(MAX_STEPS):
        stepped = _concentrate(rows, now, few)
        fell = stepped.join(now.select("key", F.col("log_det").alias("was")), "key").withColumn("fell", F.col("log_det") < F.col("was") - SETTLED)
        fell = materialise(fell, "mcd-step")
        done = now.join(fell.where("NOT fell").select("key"), "key")
        settled = settled.unionByName(done)
        now = fell.where("fell").drop("was", "fell")
        if now.isEmpty():
            break
    found = materialise(settled.unionByName(now).drop("start"), "mcd-settled")
    far = _join(rows, found, few).select("key", _squared_distance().alias("d2"))
    points = quantiles(far, ["key"], {"d2": "d2"}, (0.5, 0.75))
    scaled = points.select("key", "d2", F.greatest(F.col("d2")[0] / CHI2_MEDIAN, F.lit(1e-3)).alias("scale"))
    above = (F.cbrt(F.col("d2")[1] / F.col("scale")) - math.cbrt(CHI2_MEDIAN)) / (math.cbrt(CHI2_QUARTILE) - math.cbrt(CHI2_MEDIAN))
    scaled = scaled.select("key", "scale", F.greatest(above, F.lit(1.0)).alias("spread"))
    return materialise(found.join(scaled, "key"), "mcd-scaled")


def judge(stats: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """``stats`` (as base_statistics gives them, written before) with ``distance2`` and ``kept``."""
    vectors = _with_groups(_features(stats), min_group)
    rows = materialise(vectors.where("NOT base_failed").select(F.explode("keys").alias("key"), *FEATURES), "quality-vectors")
    found = mcd_estimates(rows).withColumnRenamed("key", "judge")
    own = vectors.drop("keys").join(F.broadcast(found) if _few(found) else found, "judge", "left")
    middle = math.cbrt(CHI2_MEDIAN)
    root = middle + (F.cbrt(_squared_distance() / F.col("scale")) - middle) / F.col("spread")
    own = own.withColumn("distance2", F.pow(root, 3)).withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance2") > cutoff, F.lit(False))
    )
    return own.select(*stats.columns, "distance2", "kept")


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row."""
    stats = materialise(base_statistics(docs, more=("n_lines",)), "quality")
    return judge(stats, cutoff).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` without the rows that quality_rules rejects."""
    rows = numbered(docs)
    flat = rows.select("rid", *(F.col(f"row.{c}").alias(c) for c in ("text", "lang", "source")))
    stats = materialise(base_statistics(flat, ("rid", "lang", "source"), ("n_lines",)), "quality")
    return without(rows, judge(stats, cutoff).where("NOT kept"))


#: The base columns alone; the method's verdict is beyond SQL.
BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 3),
t AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 3)) AS p FROM t WHERE n > 1) GROUP BY rid),
s AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
      CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
"""
