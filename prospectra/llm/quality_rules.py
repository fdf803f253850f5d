"""Quality rules: robust multivariate outliers of text statistics, with DataFrame functions only.

Each whole text gives a few counts. Texts that pass two plain rules give vectors of transformed
statistics; for every language and source a minimum-covariance-determinant estimate of centre and
scatter is made from several starts by concentration steps (estimate, keep the share with the
smallest Mahalanobis distances, estimate again), of which the one with the least determinant goes
on; texts far outside are rejected. Statistics are kept to a grid, so medians and quantiles count
distinct values of which there are few, and groups are only ever summed: no group of rows meets in
one task.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.llm import scratch, textstats

SYMBOLS = "#*$%&|<>"
#: The statistics of a text that the outlier rule looks at, with the least standard deviation that counts: for lines
#: and repeats about what one line or phrase of a short text changes.
FEATURES = {"f_length": 0.25, "f_word": 0.08, "f_symbol": 0.03, "f_line": 0.08, "f_repeat": 0.1}
#: The 0.99999 quantile of a chi-squared variable with as many degrees of freedom as there are statistics.
CUTOFF = 30.856
#: Grid of the transformed statistics.
GRID = 1024.0
#: Starts of an estimate: the medians, and random eighths of a group. Steps from each start.
STARTS, DRAWN, FIRST_STEPS = 4, 8, 2
#: Groups up to which estimates are broadcast (about half a kilobyte for each start); beyond it they are joined.
BROADCAST_GROUPS = 10_000
#: Positions of repeated windows share a long with their hash up to this many words.
PACKED = 20


def _window_positions(w: str, n: str) -> Column:
    """First positions of 3-word windows that are found more than once, ascending, for the array column `w` of `n` words."""
    hashed = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    starts = F.sequence(F.lit(0), F.col(n) - 3)
    low = (1 << PACKED) - 1
    packed = F.sort_array(F.transform(starts, lambda i: F.shiftleft(F.shiftright(hashed(i), PACKED), PACKED).bitwiseOR(i.cast("long"))))
    pairs = F.sort_array(F.transform(starts, lambda i: F.struct(hashed(i).alias("h"), i.alias("i"))))

    def repeats(arr: Column, hash_of, at_of) -> Column:
        def same(x: Column, y: Column) -> Column:
            words = [F.get(w, at_of(x) + k) == F.get(w, at_of(y) + k) for k in range(3)]
            return F.coalesce((hash_of(x) == hash_of(y)) & functools.reduce(operator.and_, words), F.lit(False))

        return F.filter(arr, lambda x, i: same(x, F.get(arr, i - 1)) | same(x, F.get(arr, i + 1)))

    return packed, pairs, repeats, low


def text_statistics(df: DataFrame, key: str = "doc_id", text: str = "text", *others: str) -> DataFrame:
    """One row per row of `df`: the key, `others`, and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words as longs.

    n_lines are \\n-split lines with a word, n_dup_lines those equal to an earlier one;
    n_repeat_words are words in 3-word windows found twice or more in the text. Windows are found
    by hash and compared word by word. Null and empty texts have zeros.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = df.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(others)], t.alias("__t"))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.translate(x, textstats.SPACE, "") != "")
    counted = base.select(
        "__key",
        *[f"__o{i}" for i in range(len(others))],
        textstats.word_array(F.col("__t")).alias("__w"),
        F.length(F.translate("__t", textstats.SPACE, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
    )
    sized = counted.withColumn("n_words", F.size("__w")).withColumn("n_lines", F.size("__lines").cast("long"))
    sized = sized.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("__lines"))).drop("__lines")
    packed, pairs, repeats, low = _window_positions("__w", "n_words")
    few = (F.col("n_words") >= 3) & (F.col("n_words") < (1 << PACKED))
    many = F.col("n_words") >= (1 << PACKED)
    none_long, none_pair = F.expr("cast(array() as array<bigint>)"), F.expr("cast(array() as array<struct<h:bigint,i:int>>)")
    hashed = sized.withColumn("__p", F.when(few, packed).otherwise(none_long)).withColumn("__q", F.when(many, pairs).otherwise(none_pair))
    hit_p = repeats(F.col("__p"), lambda x: F.shiftright(x, PACKED), lambda x: x.bitwiseAND(F.lit(low)).cast("int"))
    hit_q = repeats(F.col("__q"), lambda x: x["h"], lambda x: x["i"])
    at_p = F.transform(hit_p, lambda x: x.bitwiseAND(F.lit(low)).cast("int"))
    placed = hashed.withColumn("__at", F.sort_array(F.when(many, F.transform(hit_q, lambda x: x["i"])).otherwise(at_p)))
    covered = F.aggregate(
        F.transform("__at", lambda p, i: F.coalesce(F.least(F.lit(3), F.get("__at", i + 1) - p), F.lit(3)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return placed.select(
        F.col("__key").alias(key),
        *[F.col(f"__o{i}").alias(c) for i, c in enumerate(others)],
        F.col("n_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_lines",
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def _features() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    raw = {
        "f_length": F.log1p("n_words"),
        "f_word": F.log(F.col("word_chars") / n),
        "f_symbol": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "f_line": F.col("n_dup_lines") / (F.col("n_lines") + 10),
        "f_repeat": F.sqrt(F.col("n_repeat_words") / n),
    }
    return {k: F.round(F.coalesce(v, F.lit(0.0)) * GRID) / GRID for k, v in raw.items()}


def _cholesky(prefix: str) -> tuple[list[tuple[str, Column]], Column]:
    """Expressions, each of which may use the ones before, that end in the squared Mahalanobis distance."""
    names = list(FEATURES)
    steps: list[tuple[str, Column]] = []
    for i in range(len(names)):
        for j in range(i + 1):
            c = F.col(f"{prefix}c{min(i, j)}{max(i, j)}")
            for k in range(j):
                c = c - F.col(f"__l{i}{k}") * F.col(f"__l{j}{k}")
            steps.append((f"__l{i}{j}", F.sqrt(F.greatest(c, F.lit(1e-9))) if i == j else c / F.col(f"__l{j}{j}")))
    for i, name in enumerate(names):
        z = F.col(name) - F.col(f"{prefix}m{i}")
        for k in range(i):
            z = z - F.col(f"__l{i}{k}") * F.col(f"__z{k}")
        steps.append((f"__z{i}", z / F.col(f"__l{i}{i}")))
    return steps, sum((F.col(f"__z{i}") * F.col(f"__z{i}") for i in range(1, len(names))), F.col("__z0") * F.col("__z0"))


def _estimates(rows: DataFrame) -> DataFrame:
    """Means and floored covariances per __group, with the factor of the covariance and __spread, the logarithm of the root of its determinant."""
    names = list(FEATURES)
    sums = [F.sum(a).alias(f"s{i}") for i, a in enumerate(names)]
    crosses = [F.sum(F.col(a) * F.col(b)).alias(f"q{i}{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    totals = rows.groupBy("__group").agg(F.count("*").alias("n"), *sums, *crosses)
    means = [(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(len(names))]
    floors = list(FEATURES.values())
    covs = [
        (F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n") + F.lit(floors[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}")
        for i in range(len(names))
        for j in range(i, len(names))
    ]
    out = totals.select(F.col("__group").alias("__g"), *means, *covs)
    factor = [s for s in _cholesky("")[0] if s[0].startswith("__l")]
    for name, column in factor:
        out = out.withColumn(name, column)
    out = out.withColumn("__spread", sum((F.log(f"__l{i}{i}") for i in range(1, len(names))), F.log("__l00")))
    return out.drop(*[f"c{i}{j}" for i in range(len(names)) for j in range(i, len(names))])


def drawn(start: int | Column) -> Column:
    """Whether a row is in the random eighth that a start begins with; equal rows are in together."""
    return F.pmod(F.xxhash64(F.lit(start) if isinstance(start, int) else start, *FEATURES), F.lit(DRAWN)) == 0


def _distance(rows: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """Adds __d2; null where the group has no estimate."""
    joined = rows.join(F.broadcast(estimates) if few else estimates, F.col("__group") == F.col("__g"), "left")
    steps, d2 = _cholesky("")
    for name, column in steps:
        if name.startswith("__z"):
            joined = joined.withColumn(name, column)
    return joined.withColumn("__d2", d2).select(*rows.columns, "__d2")


def _level(d2: Column) -> Column:
    """A squared distance on a logarithmic grid, of which there are few values."""
    return F.round(F.log2(d2 + 1e-6) * 128).cast("int")


def mcd_distances(rows: DataFrame, groups: tuple[str, ...] = ("lang", "source"), least: int = 100, steps: int = 4, share: float = 0.75) -> DataFrame:
    """`rows` of text statistics with features and __d2, the robust squared distance from their group.

    Groups of fewer than `least` rows join those of their first column, and these the rest. One
    start is the coordinates' medians and median deviations, the others are random parts of the
    group; each of `steps` concentration steps keeps the `share` of a group that is nearest, and
    after FIRST_STEPS of them only the start with the least determinant goes on. Distances are
    scaled so that a group's median is that of a chi-squared variable. Rows of groups that stay
    smaller than `least` get null: so few rows say too little of five statistics and their scatter.
    """
    names = list(FEATURES)
    label = lambda *cs: F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in cs])
    fine, coarse = label(*groups), label(groups[0])
    featured = rows.withColumns(_features()).withColumns({"__fine": fine, "__coarse": coarse})
    fines = scratch.stored(featured.groupBy("__coarse", "__fine").count())
    few = fines.count() <= BROADCAST_GROUPS
    small = (lambda d: F.broadcast(d)) if few else (lambda d: d)
    lang = fines.where(F.col("count") < least).groupBy("__coarse").agg(F.sum("count").alias("__n"))
    named = fines.join(lang, "__coarse", "left").select(
        F.col("__fine").alias("__f"),
        F.when(F.col("count") >= least, F.concat(F.lit("f"), "__fine")).when(F.col("__n") >= least, F.concat(F.lit("c"), "__coarse")).otherwise(F.lit("rest")).alias("__group"),
    )
    data = scratch.stored(featured.join(small(named), F.col("__fine") == F.col("__f")).drop("__f", "__fine", "__coarse"))
    big = data.groupBy("__group").count().where(F.col("count") >= least).select(F.col("__group").alias("__big"))
    used = data.join(small(big), F.col("__group") == F.col("__big"), "left_semi").select("__group", *names)
    centre = scratch.stored(used.groupBy("__group").agg(*[F.expr(f"percentile({f}, 0.5)").alias(f"m{i}") for i, f in enumerate(names)]).withColumnRenamed("__group", "__g"))
    away = used.join(small(centre), F.col("__group") == F.col("__g"))
    spread = scratch.stored(away.groupBy("__g").agg(*[F.expr(f"percentile(round(abs({f} - m{i}) * {GRID}), 0.5)").alias(f"v{i}") for i, f in enumerate(names)]))
    first = centre.join(spread, "__g")
    for i, floor in enumerate(FEATURES.values()):
        for k in range(i):
            first = first.withColumn(f"__l{i}{k}", F.lit(0.0))
        first = first.withColumn(f"__l{i}{i}", F.greatest(1.4826 * F.col(f"v{i}") / GRID, F.lit(floor)))
    first = first.drop(*[f"v{i}" for i in range(len(names))]).withColumn("__spread", F.lit(None).cast("double"))

    def stepped(rows: DataFrame, estimates: DataFrame) -> DataFrame:
        near = _distance(rows, estimates, few).where("__d2 is not null").withColumn("__level", _level(F.col("__d2")))
        limit = near.groupBy("__group").agg(F.expr(f"percentile(__level, {share})").alias("__limit")).withColumnRenamed("__group", "__g")
        return scratch.stored(_estimates(near.join(small(limit), F.col("__group") == F.col("__g")).where(F.col("__level") <= F.col("__limit"))))

    # Every start has a copy of each row, under a group that the start's number leads.
    tagged = lambda d, at: d.withColumn(at, F.concat_ws("\x1f", F.col("__start").cast("string"), at))
    copies = tagged(used.withColumn("__start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1)))), "__group")
    parts = _estimates(copies.where(F.col("__start") > 0).where(drawn(F.col("__start"))))
    estimates = scratch.stored(tagged(first.withColumn("__start", F.lit(0)), "__g").drop("__start").unionByName(parts))
    for _ in range(FIRST_STEPS):
        estimates = stepped(copies.drop("__start"), estimates)
    columns = [c for c in estimates.columns if c != "__g"]
    plain = estimates.withColumn("__plain", F.expr("substring(__g, instr(__g, '\x1f') + 1)"))
    best = plain.groupBy("__plain").agg(F.min(F.struct("__spread", "__g", *[c for c in columns if c != "__spread"])).alias("b"))
    estimates = scratch.stored(best.select(F.col("__plain").alias("__g"), *[F.col(f"b.{c}").alias(c) for c in columns]))
    for _ in range(steps - FIRST_STEPS):
        estimates = stepped(used, estimates)
    # The median of a chi-squared variable with as many degrees of freedom as there are features.
    k = len(names)
    median = k * (1 - 2 / (9 * k)) ** 3
    final = _distance(data, estimates, few)
    middle = final.where(F.col("__d2").isNotNull()).groupBy("__group").agg((F.pow(F.lit(2.0), F.expr("percentile(round(log2(__d2 + 1e-6) * 128), 0.5)") / 128) / median).alias("__scale"))
    scaled = final.join(small(scratch.stored(middle.withColumnRenamed("__group", "__g"))), F.col("__group") == F.col("__g"), "left").drop("__g")
    return scaled.withColumn("__d2", F.col("__d2") / F.greatest(F.col("__scale"), F.lit(1.0))).drop("__scale", "__group")


def quality_rules(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    groups: tuple[str, ...] = ("lang", "source"),
    cutoff: float = CUTOFF,
    least_words: int = 50,
    most_repeated: int = 50,
    least: int = 100,
) -> DataFrame:
    """One row per row of `df`: key, counts, base_failed, distance (null where none was taken) and kept.

    Base rules: fewer than `least_words` words, or over `most_repeated` percent of the words in
    repeated windows. What passes them is rejected if its robust squared distance is over `cutoff`, which
    each statistic can reach alone;
    texts in groups too small for an estimate are kept. Null or empty texts fail the base rules.
    Null languages and sources are groups of their own; the key may be null or repeated. An empty
    table gives no rows.
    """
    counts = scratch.stored(text_statistics(df, key, text, *[g for g in groups if g != key]))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    judged = counts.withColumn("base_failed", failed)
    passed = mcd_distances(judged.where(~F.col("base_failed")), groups, least)
    out = [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = passed.select(*out, F.col("__d2").alias("distance"), F.coalesce(F.col("__d2") <= cutoff, F.lit(True)).alias("kept"))
    bad = judged.where("base_failed").select(*out, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return good.unionByName(bad)
