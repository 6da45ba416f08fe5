"""Quality rules: base statistics, and robust multivariate outliers per language and source.

The minimum covariance determinant (MCD) of a group is sought by concentration
steps from two starts, the mean of all rows and the medians: measure every row's
Mahalanobis distance, take mean and covariance of the nearest three quarters, and
repeat; the start with the smaller determinant counts. All groups and starts step at
once, each step one pass of sums per distance bin over a narrow table. Statistics are
whole numbers of 1/1024 in these sums, so they are exact in any order and reruns
agree. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasontide.llm.common import GAP, stored

#: The transformed statistics, each on a scale on which honest text is roughly even.
FEATURES = ("x_length", "x_word", "x_symbols", "x_lines", "x_repeats", "x_shouts")
#: Least standard deviation per feature: where a group hardly varies, smaller steps are no outliers.
FLOORS = (0.5, 0.08, 0.05, 0.1, 0.15, 0.06)
#: Share of rows that the estimates rest on, and how much narrower than the whole of a normal cloud
#: its nearest such share is: 0.75 / P(chi-squared(8) <= 7.84), 7.84 being the 0.75 quantile for 6 features.
CORE, WIDEN = 0.75, 1.36
STEPS = 4
#: A group of n sound rows counts n / (n + PRIOR_ROWS) in its estimates, those of its language (and in turn of all rows) the rest.
PRIOR_ROWS = 200
#: Parts of a unit that statistics are rounded to, and bins per doubling of a squared distance.
UNIT, BINS = 1024, 32
#: Squared distance from which a document goes: chi-squared(6) at 1 - 1e-6.
CUT = 38.3


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def base_statistics(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Word, symbol, line and repetition counts of whole texts, one row per row.

    n_shouts counts upper-case letters and exclamation marks; no base rule uses it.

    A null text counts as empty: all counts are 0 and base_failed is true. Windows
    of three words are compared by whole 64-bit hashes, whatever the text's length;
    one sort of (hash, place) finds the repeated ones, nothing is exploded or shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step1 = documents.select(
        "doc_id",
        *keep,
        F.length(F.regexp_replace(text, GAP, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[\p{Lu}!]")).cast("long").alias("n_shouts"),
        lines.alias("_lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("_w"),
    )
    step2 = step1.select(
        "doc_id", *keep, "word_chars", "n_symbols", "n_shouts", "_w",
        F.size("_w").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    marked = F.transform(
        F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))),
        lambda w, i: F.struct(
            F.xxhash64(w, _at("_w", i + 1), _at("_w", i + 2)).alias("h"), i.cast("long").alias("at")
        ),
    )
    step3 = step2.withColumn("_p", F.sort_array(marked)).drop("_w")
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    repeated = F.filter(
        "_p", lambda p, i: same(p, _at("_p", i + 1)) | ((i > 0) & same(p, _at("_p", F.greatest(i - 1, F.lit(0)))))
    )
    step4 = step3.withColumn("_r", F.sort_array(F.transform(repeated, lambda p: p["at"])))
    covered = F.aggregate(
        "_r",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    step5 = step4.withColumn("n_repeat_words", covered.cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return step5.select(
        "doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts",
        failed.alias("base_failed"),
    )


def _features(stats: DataFrame) -> DataFrame:
    words = F.greatest("n_words", F.lit(1)).cast("double")
    # a share over 1 (several symbols or lines a word) goes on by logarithm, so that the scale stays even
    return stats.withColumns(
        {
            "x_length": F.log(words),
            "x_word": F.log((F.col("word_chars") + 1) / words),
            "x_symbols": F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 1)),
            "x_lines": F.log1p("n_dup_lines") / 4,
            "x_repeats": F.sqrt(F.col("n_repeat_words") / words),
            "x_shouts": F.sqrt(F.col("n_shouts") / (F.col("word_chars") + 1)),
        }
    )


def _eliminated(matrix: Column, d: int) -> Column:
    """(m, log_det): inverse by Gauss-Jordan elimination and log determinant of a positive definite matrix in one array."""

    def eliminate(state: Column, k: Column) -> Column:
        m = state["m"]
        pivot = F.get(m, k * d + k)

        def cell(x: Column, at: Column) -> Column:
            i, j = F.floor(at / d).cast("int"), at % d
            row, col = F.get(m, k * d + j), F.get(m, i * d + k)
            return (
                F.when((i == k) & (j == k), 1 / pivot)
                .when(i == k, row / pivot)
                .when(j == k, -col / pivot)
                .otherwise(x - col * row / pivot)
            )

        return F.struct(F.transform(m, cell).alias("m"), (state["log_det"] + F.log(pivot)).alias("log_det"))

    begin = F.struct(matrix.alias("m"), F.lit(0.0).alias("log_det"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(d - 1)), begin, eliminate)


def _inverse(matrix: Column, d: int) -> Column:
    return _eliminated(matrix, d)["m"]


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def _sums() -> list[Column]:
    """Number of rows and exact sums of the whole-number statistics and their products."""
    first = [f"sum({x}) AS s_{i}" for i, x in enumerate(FEATURES)]
    products = [f"sum({FEATURES[i]} * {FEATURES[j]}) AS q_{i}_{j}" for i, j in _PAIRS]
    return [F.expr(x) for x in ("count(1) AS n", *first, *products)]


def _estimates(sums: DataFrame, widen: float) -> DataFrame:
    """pool, start, centre, spread (covariance times ``widen``, squared floors added), inverse and log_det from sums."""
    d = len(FEATURES)
    centre = ", ".join(f"s_{i} / n / {UNIT}D" for i in range(d))
    cells = []
    for i in range(d):
        for j in range(d):
            a, b = min(i, j), max(i, j)
            floor = FLOORS[i] ** 2 if i == j else 0.0
            cells.append(f"(q_{a}_{b} / n - (s_{a} / n) * (s_{b} / n)) * {widen / UNIT**2!r}D + {floor!r}D")
    spread = ", ".join(cells)
    return _solved(sums.select("pool", "start", F.expr(f"array({centre}) AS centre"), F.expr(f"array({spread}) AS spread")))


def _solved(estimates: DataFrame) -> DataFrame:
    solved = estimates.withColumn("_s", _eliminated(F.col("spread"), len(FEATURES)))
    return solved.select(*estimates.columns, F.col("_s.m").alias("inverse"), F.col("_s.log_det").alias("log_det"))


def _distance(unit: int = 1) -> Column:
    """Squared Mahalanobis distance of a row's features (in parts of ``unit``) from its group's centre."""
    d = len(FEATURES)
    away = [f"({x} / {unit}D - get(centre, {i}))" for i, x in enumerate(FEATURES)]
    return F.expr(" + ".join(f"{away[i]} * {away[j]} * get(inverse, {i * d + j}) * {1 if i == j else 2}D" for i, j in _PAIRS))


def _starts(sound: DataFrame) -> DataFrame:
    """Two starts per pool: mean and covariance of all rows; medians with quartile spreads and no covariance.

    A percentile's buffer holds a pool's distinct values, of which whole numbers of
    1/1024 have some 20,000 at most.
    """
    d = len(FEATURES)
    quartiles = [F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p_{i}") for i, x in enumerate(FEATURES)]
    plain = _estimates(sound.groupBy("pool").agg(*_sums()).withColumn("start", F.lit(0)), 1.0)
    part = lambda i, k: F.get(f"p_{i}", F.lit(k)) / UNIT
    # quartiles of a normal cloud lie 1.349 deviations apart
    own = [((part(i, 2) - part(i, 0)) / 1.349) ** 2 + FLOORS[i] ** 2 for i in range(d)]
    spread = F.array(*[own[i] if i == j else F.lit(0.0) for i in range(d) for j in range(d)])
    medians = sound.groupBy("pool").agg(*quartiles)
    medians = medians.select("pool", F.lit(1).alias("start"), F.array(*[part(i, 1) for i in range(d)]).alias("centre"), spread.alias("spread"))
    return plain.unionByName(_solved(medians))


def _step(sound: DataFrame, estimates: DataFrame) -> DataFrame:
    """Estimates from the rows in the nearest bins that hold CORE of a pool; ties share a bin."""
    away = sound.join(estimates.select("pool", "start", "centre", "inverse"), "pool")
    nearness = F.floor(F.log2(F.greatest(_distance(UNIT), F.lit(0.0)) + 2.0**-10) * BINS).cast("int")
    bins = away.withColumn("bin", nearness).groupBy("pool", "start", "bin").agg(*_sums())
    pool = Window.partitionBy("pool", "start")
    before = F.coalesce(F.sum("n").over(pool.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    core = bins.withColumn("before", before).withColumn("rows", F.sum("n").over(pool)).where(F.col("before") < CORE * F.col("rows"))
    names = ["n", *[f"s_{i}" for i in range(len(FEATURES))], *[f"q_{i}_{j}" for i, j in _PAIRS]]
    return _estimates(core.groupBy("pool", "start").agg(*[F.sum(c).alias(c) for c in names]), WIDEN)


def _blend(own: str, parent: str) -> Column:
    """Centre and spread of a mixture: ``own`` with n / (n + PRIOR_ROWS) of the weight, ``parent`` with the rest."""
    d = len(FEATURES)
    w = F.col(f"{own}.n") / (F.col(f"{own}.n") + PRIOR_ROWS)
    a, b = F.col(f"{own}.centre"), F.col(f"{parent}.centre")
    apart = lambda i: F.get(a, i) - F.get(b, i)
    centre = F.zip_with(a, b, lambda x, y: w * x + (1 - w) * y)
    spread = F.transform(
        F.col(f"{own}.spread"),
        lambda x, k: w * x
        + (1 - w) * F.get(F.col(f"{parent}.spread"), k)
        + w * (1 - w) * apart(F.floor(k / d).cast("int")) * apart(k % d),
    )
    mixed = F.struct(F.col(f"{own}.n").alias("n"), centre.alias("centre"), spread.alias("spread"))
    return F.when(F.col(own).isNull(), F.col(parent)).otherwise(mixed)


def robust_outliers(stats: DataFrame) -> DataFrame:
    """Add ``distance`` (squared robust Mahalanobis distance) and ``outlier`` to base statistics.

    ``stats`` has lang and source; nulls are values of their own. Estimates rest on
    the rows that did not fail the base rules. Those of a language and source are mixed
    with those of the language, and these with those of all rows, by the number of
    rows, so that no count switches between them; where no row is left, nothing is an
    outlier (distance null). Rows that failed the base rules are measured too. The
    core is the nearest bins of distance (2 % wide) that hold three quarters; rows of
    a bin are in it or out together.
    """
    keyed = _features(stats).withColumns(
        {
            "_l": F.to_json(F.struct("lang"), {"ignoreNullFields": "false"}),
            "_g": F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"}),
        }
    )
    keyed = stored(keyed, "statistics")
    # three levels of rows: each estimate is made from all rows of its level
    levels = F.explode(F.array("_g", "_l", F.lit("all"))).alias("pool")
    whole = [F.round(F.col(x) * UNIT).cast("long").alias(x) for x in FEATURES]
    sound = keyed.where(~F.col("base_failed")).select(levels, *whole)
    estimates = stored(_starts(sound), "estimates")
    for _ in range(STEPS):
        estimates = stored(_step(sound, estimates), "estimates")
    # the least determinant, the mean's start on a tie
    least = estimates.groupBy("pool").agg(F.min_by(F.struct("centre", "spread"), F.struct("log_det", "start")).alias("e"))
    counts = sound.groupBy("pool").count()
    found = least.join(counts, "pool").select("pool", F.struct(F.col("count").alias("n"), "e.centre", "e.spread").alias("e"))
    found = stored(found, "least")
    groups = keyed.select("_g", "_l").distinct().withColumn("_a", F.lit("all"))
    for level, name in (("_g", "own"), ("_l", "tongue"), ("_a", "every")):
        groups = groups.join(found.select(F.col("pool").alias(level), F.col("e").alias(name)), level, "left")
    groups = groups.withColumn("tongue", _blend("tongue", "every")).withColumn("own", _blend("own", "tongue"))
    groups = _solved(groups.select("_g", "own.centre", "own.spread")).select("_g", "centre", "inverse")
    return (
        keyed.join(stored(groups, "groups"), "_g", "left")
        .withColumn("distance", _distance())
        .withColumn("outlier", F.coalesce(F.col("distance") > CUT, F.lit(False)))
        .select(*stats.columns, "distance", "outlier")
    )


def rate(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Base statistics, distance and ``kept`` for every row of ``documents`` (doc_id, text, lang, source).

    Kept are rows that pass the base rules and are no outlier. Rows that repeat an
    id are rated alike, an empty table gives none, further columns are ignored.
    """
    stats = base_statistics(documents, ("lang", "source", *keep))
    rated = robust_outliers(stats)
    return rated.withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))


#: SQL for all columns but ``kept``, which rests on iterated estimates.
BASE_ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
t AS (
  SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    [words[i:i+2] FOR i IN range(1, len(words) - 1)] AS grams FROM w),
g AS (SELECT doc_id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS pos FROM t),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT pos + k)::BIGINT AS n FROM r, range(3) AS s(k) GROUP BY doc_id)
SELECT t.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(words) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(words) AS base_failed
FROM t LEFT JOIN c USING (doc_id)
"""
