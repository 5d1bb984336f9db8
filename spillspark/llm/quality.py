"""Quality rules: base counts, and robust multivariate outliers per language and source.

The estimate is a regularised minimum covariance determinant: ``FLOOR`` squared
is added to every variance, so that a statistic that is the same nearly
everywhere keeps a scale. DataFrame functions only. One pass over the texts
gives counts per document; what follows works on the small table of counts,
written once.

Six transformed statistics (log length, log mean word length, the share of
repeated words, and logs of the shares of symbols, capitals and punctuation), as integers in
thousandths so that sums don't depend on the order of rows, are fitted per
(language, source). Starts, each from all rows: medians with two scales, and the means and
covariances of the rows' distances from the medians in four shapes that far rows
pull little at (``SHAPES``, as in the deterministic MCD). Concentration
steps take the mean and covariance of the ``SHARE`` of documents nearest by
Mahalanobis distance; after ``FIRST_STEPS`` the two starts with the smallest
determinants go on until no determinant moves by a ten-thousandth (``SETTLED``, or ``MAX_STEPS``), and the smaller wins.

A step is one pass over the small table: rows are counted and summed per bin of
the logarithm of their distance, ``BINS`` a unit. The nearest share holds exactly
that share of the documents: whole bins, and the documents of the bin where it
ends (distances equal to 0.4 %, ties among them) by the same weight. A step is a
group-by with partial sums: a source that holds a third of all rows is
combined before the shuffle.

Every document that passes the base rules is judged. A source with fewer than ``LEAST``
documents can't carry six variances and 15 covariances: it is judged by the estimate of
its language's small sources together, those of languages that are still too small
by one of all of these, and where even these are too few by one of the whole table. In a
table that is smaller itself, the covariance is drawn to ``SPREAD`` and the scale to one, by
the weight of the documents that lack. ``judged_by`` tells which it was.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spillspark.llm.common import whole_row, written

WINDOW = 8
MIN_WORDS = 20
SHARE = 0.75
LEAST = 60
FIRST_STEPS, BEST, MAX_STEPS = 2, 2, 30
SETTLED = 1e-4  # a determinant that moves less, as a share of itself, has settled
#: Least standard deviation of a statistic, in its own (log) units: a share
#: that is zero nearly everywhere still gets a scale.
FLOOR = 0.25
#: Standard deviation that a statistic is drawn to where fewer than ``LEAST`` documents tell it.
SPREAD = 0.5
#: Distances beyond this multiple of the chi-square quantile are rejected.
LEVEL, SLACK = 0.999, 3.0
FEATURES = ("x1", "x2", "x3", "x4", "x5", "x6")
PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
BINS = 256  # histogram bins per unit of log distance
#: Of a row's distance from the median in scales, ``z`` by statistic and ``r`` in all: hyperbolic tangents,
#: directions alone, distances cut at that of ``SHARE`` of normal rows, logarithms.
SHAPES = ("tanh({z})", "2.45D * {z} / greatest(r, 1e-9D)", "{z} * least(1, 2.8D / greatest(r, 1e-9D))", "signum({z}) * ln(1 + abs({z}))")


def chi2_6(share: float) -> float:
    """Quantile of chi-square with six degrees of freedom, by bisection."""
    low, high = 0.0, 200.0
    for _ in range(200):
        x = (low + high) / 2
        inside = 1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8)
        low, high = (x, high) if inside < share else (low, x)
    return low


def _count_of(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, "")).cast("bigint")


def base_counts(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` (doc_id, text, lang, source) with base counts, without text."""
    # \v would be a class of its own in a pattern: the range \t-\r is meant.
    own = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_key"))
    split = own.withColumn(
        "words", F.array_remove(F.split("text", "[ \\t-\\r]+"), "")
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    counted = split.select(
        "doc_id",
        "lang",
        "source",
        "text_key",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        _count_of(F.col("text"), "[^#*$%&|<>]+").alias("n_symbols"),
        _count_of(F.col("text"), "[^A-Z]+").alias("n_capitals"),
        _count_of(F.col("text"), "[^!-/:-@\\[-`{-~]+").alias("n_punct"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    for step in (1, 2, 4):  # hashes of windows of 2, 4 and 8 words
        counted = counted.withColumn("h", F.zip_with("h", F.slice("h", step + 1, F.size("h")), lambda a, b: F.xxhash64(a, b)))
    windows = counted.withColumn("h", F.slice("h", 1, F.greatest(F.size("h") - (WINDOW - 1), F.lit(0)))).withColumn(
        "n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint")
    )
    marked = windows.withColumn("again", F.size(F.array_distinct("h")) < F.size("h")).drop("lines")
    ordered = marked.withColumn(
        "s", F.when(F.col("again"), F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ).drop("h")
    same = lambda k, d: F.coalesce(F.get(F.col("s"), k)["h"] == F.get(F.col("s"), k + d)["h"], F.lit(False))
    placed = ordered.withColumn(
        "at",
        F.when(
            F.col("again"),
            F.array_sort(
                F.transform(
                    F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda k: same(k, 1) | ((k > 0) & same(k, -1))),
                    lambda k: F.get(F.col("s"), k)["i"],
                )
            ),
        ),
    ).drop("s")
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct(
            (acc["n"] + (p + WINDOW - F.greatest(acc["end"], p))).cast("bigint").alias("n"), (p + WINDOW).alias("end")
        ),
        lambda acc: acc["n"],
    )
    return placed.select(
        "doc_id", "lang", "source", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("again"), covered).otherwise(F.lit(0)).cast("bigint").alias("n_repeat_words"),
        "n_capitals", "n_punct",
    )


def statistics(counts: DataFrame) -> DataFrame:
    """Adds base_failed and the six transformed statistics, as integers."""
    share = lambda c: F.log(1 + 100.0 * F.col(c) / (F.col("word_chars") + 1))
    x = [
        F.log(1.0 + F.col("n_words")),
        F.log((F.col("word_chars") + 1.0) / (F.col("n_words") + 1)),
        share("n_symbols"),
        4.0 * F.col("n_repeat_words") / (F.col("n_words") + 1),
        share("n_capitals"),
        share("n_punct"),
    ]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counts.withColumns({"base_failed": failed} | {n: F.round(1000 * e).cast("bigint") for n, e in zip(FEATURES, x, strict=True)})


def grouped(stats: DataFrame) -> DataFrame:
    """Adds ``g``, the group a row is judged with, and ``whole``: the last group is fitted on all rows.

    Null only where a row's language and source have no row that passes the base rules.
    """
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    keyed = stats.withColumns({"kl": name("lang"), "ks": name("source")})
    sizes = written(keyed.where(~F.col("base_failed")).groupBy("kl", "ks").agg(F.count(F.lit(1)).alias("n")), "sizes")
    first = sizes.withColumn("g", F.when(F.col("n") >= LEAST, F.concat_ws("\x1f", F.lit("source"), "kl", "ks")))
    rest = first.where("g is null").groupBy("kl").agg(F.sum("n").alias("nl"))
    second = first.join(rest, "kl", "left").withColumn("g", F.coalesce("g", F.when(F.col("nl") >= LEAST, F.concat_ws("\x1f", F.lit("lang"), "kl"))))
    pool = second.where("g is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("na"))
    few = (F.col("na") > 0) & (F.col("na") < LEAST)
    named = second.crossJoin(pool).select("kl", "ks", F.coalesce("g", F.lit("all")).alias("g"), few.alias("whole"))
    return keyed.join(named, ["kl", "ks"], "left").drop("kl", "ks")


def _median(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Lower median per key from a histogram of an integer column."""
    hist = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys)
    cum = hist.withColumns({"upto": F.sum("c").over(w.orderBy(value)), "all": F.sum("c").over(w)})
    return cum.where("2 * upto >= all").groupBy(*keys).agg(F.min(value).alias("m"))


def _starts(fit: DataFrame) -> DataFrame:
    """(g, start, mu.., w.., logdet): medians scaled by MADs (0) and by the floor alone (1), then the ``SHAPES`` of all rows."""
    long = fit.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("j"), F.col(n).alias("x")) for i, n in enumerate(FEATURES)])).alias("f")).select("g", "f.j", "f.x")
    med = written(_median(long, "x", ["g", "j"]), "medians")
    dev = long.join(med, ["g", "j"]).select("g", "j", F.abs(F.col("x") - F.col("m")).alias("d"))
    both = med.join(_median(dev, "d", ["g", "j"]).withColumnRenamed("m", "mad"), ["g", "j"])
    wide = written(
        both.groupBy("g").agg(
            *[F.max(F.when(F.col("j") == i, F.col("m") / 1000)).alias(f"mu{i}") for i in range(len(FEATURES))],
            *[F.max(F.when(F.col("j") == i, 1.4826 * F.col("mad") / 1000)).alias(f"mad{i}") for i in range(len(FEATURES))],
        ),
        "medians",
    )
    scale = lambda start, i: F.expr(_scale(i)) if start == 0 else F.lit(2 * FLOOR)
    shaped = _estimate(_sums(_shaped(fit, wide)).withColumn("part", F.lit(1.0)), drawn=False).join(wide.selectExpr("g", *[f"mu{i} AS m{i}" for i in range(len(FEATURES))], *[f"{_scale(i)} AS v{i}" for i in range(len(FEATURES))]), "g")
    made = shaped.selectExpr("g", "start", *[f"m{i} + v{i} * mu{i} AS mu{i}" for i in range(len(FEATURES))], *[f"w{i}{j} / v{j} AS w{i}{j}" for i, j in PAIRS], "0.0D AS logdet")
    for start in (0, 1):
        one = wide.select(
            "g",
            F.lit(start).alias("start"),
            *[F.col(f"mu{i}") for i in range(len(FEATURES))],
            *[(1 / scale(start, i) if i == j else F.lit(0.0)).alias(f"w{i}{j}") for i, j in PAIRS],
            F.lit(0.0).alias("logdet"),
        )
        made = made.unionByName(one)
    return made


def _scale(i: int) -> str:
    return f"greatest(mad{i}, {FLOOR}D)"


def _shaped(fit: DataFrame, medians: DataFrame) -> DataFrame:
    """Every row once in each of the ``SHAPES``, in thousandths, as starts 2 and on."""
    p = range(len(FEATURES))
    z = fit.join(medians, "g").selectExpr("g", *[f"({FEATURES[i]} / 1000 - mu{i}) / {_scale(i)} AS z{i}" for i in p])
    z = z.selectExpr("*", "sqrt(" + " + ".join(f"z{i} * z{i}" for i in p) + ") AS r")
    one = lambda k, s: f"struct({2 + k} AS start, " + ", ".join(f"cast(round(1000 * ({s.format(z=f'z{i}')})) AS bigint) AS {n}" for i, n in enumerate(FEATURES)) + ")"
    return z.selectExpr("g", "inline(array(" + ", ".join(one(k, s) for k, s in enumerate(SHAPES)) + "))").selectExpr("*", "0 AS bin", "0.0D AS logdet")


def _distances(rows: DataFrame, fitted: DataFrame, how: str = "inner") -> DataFrame:
    """Rows joined to their groups' estimates, with squared distance d2 and its bin.

    Written as SQL text, a level at a time: the plan of a step is made in a tenth of the time.
    """
    p = range(len(FEATURES))
    d = rows.join(fitted, "g", how).selectExpr("*", *[f"{FEATURES[i]} / 1000 - mu{i} AS u{i}" for i in p])
    d = d.selectExpr("*", *[" + ".join(f"w{i}{j} * u{j}" for j in range(i + 1)) + f" AS y{i}" for i in p])
    d = d.selectExpr("*", " + ".join(f"y{i} * y{i}" for i in p) + " AS d2")
    return d.selectExpr("*", f"cast(floor({BINS} * ln(d2 + 1e-6D)) AS int) AS bin")


def _sums(d: DataFrame) -> DataFrame:
    """Per (g, start, bin): rows ``n``, sums and products of the statistics, and the determinant ``was`` before."""
    return d.groupBy("g", "start", "bin").agg(
        F.expr("count(1) AS n"),
        *[F.expr(f"sum({n}) AS s{i}") for i, n in enumerate(FEATURES)],
        *[F.expr(f"sum({FEATURES[i]} * {FEATURES[j]}) AS q{i}{j}") for i, j in PAIRS],
        F.expr("min(logdet) AS was"),
    )


def _nearest(sums: DataFrame) -> DataFrame:
    """Adds ``part``, the weight of each bin: the nearest ``SHARE`` of a group's rows, no more and no less."""
    w = Window.partitionBy("g", "start")
    before = F.sum("n").over(w.orderBy("bin")) - F.col("n")
    want = F.greatest(F.lit(1), F.floor(SHARE * F.sum("n").over(w)))
    return sums.withColumn("part", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (want - before) / F.col("n"))))


def _lacking(rows: str) -> str:
    """Rows that a group's nearest share lacks: so much weight goes to ``SPREAD`` and a scale of one."""
    return f"greatest(0.0D, {SHARE * LEAST - 1}D - {rows})"


def _estimate(sums: DataFrame, drawn: bool = True) -> DataFrame:
    """Mean and inverse Cholesky factor of each (g, start) from its bins by their weight ``part``.

    ``drawn``: small ones are drawn to ``SPREAD``.
    """
    p = range(len(FEATURES))
    names = ["n", *[f"s{i}" for i in p], *[f"q{i}{j}" for i, j in PAIRS]]
    e = sums.where("part > 0").groupBy("g", "start").agg(*[F.expr(f"sum({c} * part) AS {c}") for c in names], F.expr("min(was) AS was"))
    e = e.selectExpr("*", *[f"s{i} / n / 1000 AS mu{i}" for i in p], f"{_lacking('n') if drawn else '0.0D'} AS lack")
    own = lambda i, j: (f" + lack * {SPREAD * SPREAD}D", f" + {FLOOR * FLOOR}D") if i == j else ("", "")
    e = e.selectExpr("*", *[f"(q{i}{j} / 1000000 - n * mu{i} * mu{j}{own(i, j)[0]}) / (n + lack){own(i, j)[1]} AS c{i}{j}" for i, j in PAIRS])
    less = lambda i, j: "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
    for j in p:  # Cholesky, column by column
        e = e.selectExpr("*", f"sqrt(c{j}{j}{less(j, j)}) AS l{j}{j}")
        if j + 1 < len(FEATURES):
            e = e.selectExpr("*", *[f"(c{i}{j}{less(i, j)}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, len(FEATURES))])
    for i in p:  # inverse of the triangle, row by row
        e = e.selectExpr("*", *[f"1 / l{i}{i} AS w{i}{i}" if i == j else "-(" + " + ".join(f"l{i}{k} * w{k}{j}" for k in range(j, i)) + f") / l{i}{i} AS w{i}{j}" for j in range(i + 1)])
    return e.selectExpr("g", "start", *[f"mu{i}" for i in p], *[f"w{i}{j}" for i, j in PAIRS], " + ".join(f"2 * ln(l{i}{i})" for i in p) + " AS logdet", "was")


def estimates(stats: DataFrame) -> DataFrame:
    """One row per group: centre, inverse factor, and the scale of its distances."""
    rows = stats.where(~F.col("base_failed") & F.col("g").isNotNull())
    if "whole" in stats.columns:
        rows = rows.withColumn("g", F.explode(F.when(F.col("whole"), F.array_distinct(F.array("g", F.lit("all")))).otherwise(F.array("g"))))
    fit = rows.select("g", *FEATURES)
    now = written(_starts(fit), "mcd")
    for step in range(MAX_STEPS):
        now = written(_estimate(_nearest(_sums(_distances(fit, now.drop("was"))))), "mcd")
        if step + 1 == FIRST_STEPS:
            order = F.row_number().over(Window.partitionBy("g").orderBy("logdet", "start"))
            now = written(now.withColumn("place", order).where(F.col("place") <= BEST).drop("place"), "mcd")
        elif step + 1 > FIRST_STEPS and not now.where(f"abs(logdet - was) > {SETTLED}D").limit(1).count():
            break
    settled = F.abs(F.col("logdet") - F.col("was")) <= SETTLED
    best = now.withColumn("settled", settled).groupBy("g").agg(F.min(F.struct("logdet", "start", "settled")).alias("b")).select("g", "b.start", "b.settled")
    chosen = written(now.join(best, ["g", "start"]).drop("was"), "mcd")
    ends = _nearest(_distances(fit, chosen).groupBy("g", "start", "bin").agg(F.count(F.lit(1)).alias("n"))).where("part > 0")
    last = ends.groupBy("g").agg(F.max(F.struct("bin", "part")).alias("e"), F.sum(F.col("n") * F.col("part")).alias("m"))
    lack = F.expr(_lacking("m"))
    scale = last.select("g", ((F.col("m") * F.exp((F.col("e.bin") + F.col("e.part")) / BINS) / chi2_6(SHARE) + lack) / (F.col("m") + lack)).alias("scale"))
    return written(chosen.join(scale, "g").select("g", "start", *[f"mu{i}" for i in range(len(FEATURES))], *[f"w{i}{j}" for i, j in PAIRS], "logdet", "scale", "settled"), "mcd")


def judged(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): counts and verdict.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, distance, judged_by (source, lang, all, or
    none where a row fails the base rules), settled (false where the estimate
    still moved after ``MAX_STEPS``), lang, source, text_key (hash of the text). A
    null, empty or wordless text has no words and fails the base rules; texts may
    be of any length and count whole. Null languages and sources are values of
    their own. Rows that repeat an id are judged one by one, equal rows alike;
    other columns are ignored; an empty table gives an empty result.
    """
    stats = written(grouped(statistics(written(base_counts(docs), "counts"))), "stats")
    fitted = estimates(stats)
    d = _distances(stats, fitted, "left").withColumn("distance", F.sqrt(F.col("d2") / F.col("scale")))
    outlier = F.coalesce(F.col("distance") * F.col("distance") > SLACK * chi2_6(LEVEL), F.lit(False))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~outlier).alias("kept"), F.round("distance", 3).alias("distance"),
        F.when(F.col("base_failed"), "none").otherwise(F.substring_index("g", "\x1f", 1)).alias("judged_by"), "settled",
        "lang", "source", "text_key",
    )


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns.

    A verdict depends on text, language and source, so rows are matched with
    their verdicts by these (texts by hash) and the id, nulls included. Null,
    empty and wordless texts go (too few words); rows that repeat, in whole or
    by id, share a verdict and all stay or go; other columns may have any
    names; an empty table stays empty.
    """
    keys = ["doc_id", "lang", "source", "text_key"]
    good = judged(docs).where("kept").select(*[F.col(k).alias("q_" + k) for k in keys]).distinct()
    own = docs.select(whole_row(docs).alias("row"), "doc_id", "lang", "source", F.xxhash64("text").alias("text_key"))
    same = F.col("text_key") == F.col("q_text_key")
    for k in keys[:3]:
        same = same & F.col(k).eqNullSafe(F.col("q_" + k))
    return own.join(good, same, "left_semi").select("row.*")
