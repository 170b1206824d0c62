"""Quality rules: counting rules, then robust multivariate outliers within each language and source.

Everything is DataFrame operations. Each text's counts become a vector of five statistics. For each (lang, source) the
minimum-covariance-determinant estimate is found by concentration steps: take the share of rows with the smallest
Mahalanobis distances, make mean and covariance of these, repeat. The steps run for all groups together as partial
aggregations; the distance that a share of rows stays under comes from counts in fine bins, so no group
is ever sorted or gathered. Of two starts, the one that ends in the smaller determinant is used. Groups of every size are judged: each
estimate is shrunk to its language's, and that to the estimate of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.columns import own, small, unpacked
from tablewright.plans.scratch import Scratch

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30
#: Log of words, log of mean word length, and logs of symbols, repeated lines and repeated words in proportion.
STATISTICS = 5
#: Least standard deviation that each statistic is given, in its own unit. Most texts have no symbols and no repeats at
#: all, so a spread is otherwise 0 and one symbol would be an outlier. Where the normal is 0, the last three reject by
#: themselves at about 2 symbols per 100 characters, 5 repeated lines per 100 words (half of ten-word lines), and a
#: quarter of the words repeated, all of which the counting rules allow.
FLOORS = (0.35, 0.08, 0.2, 0.35, 0.25)
#: The share of rows kept in a step; the factor that makes the covariance of that share of a
#: five-dimensional normal consistent; the chi-squared quantile for 5 degrees at 1 - 1e-4.
SHARE, CONSISTENCY, CUTOFF = 0.75, 1.412, 25.745
#: A group whose log determinant falls by no more has found its subset.
SETTLED = 1e-9
#: A group's estimate is its own and its language's, weighed as its rows to this many; a language's likewise with that of
#: all rows. So a group of any size has an estimate, and a rare one is judged mostly by its language.
PRIOR_ROWS = 50
BINS_A_LOG, LAST_BIN = 64, 4095
#: Estimates (about 250 bytes each) that are broadcast at most; more are joined by a shuffle.
GROUPS = 50_000
X = [f"x{i}" for i in range(1, STATISTICS + 1)]
PAIRS = [(i, j) for i in range(1, STATISTICS + 1) for j in range(1, i + 1)]


def _joined(hashes: str, ahead: int) -> Column:
    """Each hash combined with the one ``ahead`` places further."""
    return F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(F.col(hashes), i + ahead)))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """Columns ``keep`` (which may not be named like what follows) with the ``COUNTS`` of whole texts; null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(*keep, F.filter(F.split(text, SPACE), lambda w: w != "").alias("_w"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("_lines"))
    kept = first.columns[: len(keep)]
    out = first.select(
        *kept, "n_symbols", F.size("_w").cast("long").alias("n_words"), F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h1"),
    )
    # A window's hash by doubling: 2 words from 1 and 1, 4 from 2 and 2, 8 from 4 and 4.
    for width in (1, 2, 4):
        h = f"_h{width}"
        out = out.withColumn(f"_h{2 * width}", F.slice(_joined(h, width), F.lit(1), F.greatest(F.size(h) - width, F.lit(0)))).drop(h)
    out = out.withColumn("_h8", F.when(F.size(F.array_distinct("_h8")) < F.size("_h8"), F.col("_h8")))
    out = out.withColumn("_sorted", F.sort_array(F.transform("_h8", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).drop("_h8")
    same = lambda s, k: F.coalesce(F.get(F.col("_sorted"), k)["h"] == s["h"], F.lit(False))
    twice = F.filter("_sorted", lambda s, k: same(s, k - 1) | same(s, k + 1))
    out = out.withColumn("_at", F.sort_array(F.transform(twice, lambda s: s["i"]))).drop("_sorted")
    # Each window covers its words up to the next one's start.
    new = F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), k + 1) - p, F.lit(WINDOW))))
    return out.withColumn("n_repeat_words", F.coalesce(F.aggregate(new, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")).drop("_at")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)


def statistics() -> dict[str, Column]:
    """x1 to x5 of a row that has words."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    each = [F.log1p("n_words"), F.log(chars / words), F.log1p(F.col("n_symbols") * 100 / chars), F.log1p(F.col("n_dup_lines") * 100 / words), F.log1p(F.col("n_repeat_words") * 10 / words)]
    return dict(zip(X, each))


def with_cholesky(groups: DataFrame) -> DataFrame:
    """``groups`` (covariances s11, s21, ...) with the lower Cholesky factor l11, l21, ... and the log determinant."""
    out = groups
    for j in range(1, STATISTICS + 1):
        known = lambda i, j=j: sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(1, j)), F.lit(0.0))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"s{j}{j}") - known(j), F.lit(1e-9))))
        out = out.withColumns({f"l{i}{j}": (F.col(f"s{i}{j}") - known(i)) / F.col(f"l{j}{j}") for i in range(j + 1, STATISTICS + 1)}) if j < STATISTICS else out
    log_det = sum((F.log(f"l{i}{i}") for i in range(1, STATISTICS + 1)), F.lit(0.0)) * 2
    return out.withColumn("log_det", log_det).drop(*[f"s{i}{j}" for i, j in PAIRS])


def with_distance(rows: DataFrame) -> DataFrame:
    """Rows that carry x, m and l with d2, the squared Mahalanobis distance, by forward substitution."""
    out = rows
    for i in range(1, STATISTICS + 1):
        done = sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(1, i)), F.lit(0.0))
        out = out.withColumn(f"z{i}", (F.col(f"x{i}") - F.col(f"m{i}") - done) / F.col(f"l{i}{i}"))
    return out.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, STATISTICS + 1)), F.lit(0.0))).drop(*[f"z{i}" for i in range(1, STATISTICS + 1)])


SUMS = [f"a{i}" for i in range(1, STATISTICS + 1)] + [f"q{i}{j}" for i, j in PAIRS]


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows and the ``SUMS`` of x and its products by ``keys``, about the centre c1 to c5 that rows carry; the centre stays."""
    d = {i: F.col(f"x{i}") - F.col(f"c{i}") for i in range(1, STATISTICS + 1)}
    sums = [F.sum(d[i]).alias(f"a{i}") for i in d] + [F.sum(d[i] * d[j]).alias(f"q{i}{j}") for i, j in PAIRS] + [F.first(f"c{i}").alias(f"c{i}") for i in d]
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), *sums)


def _moments(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Means and floored covariances by ``keys`` from rows of ``_summed``, which are added up."""
    centre = [f"c{i}" for i in range(1, STATISTICS + 1)]
    g = sums.groupBy(*keys).agg(F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in SUMS], *[F.first(c).alias(c) for c in centre])
    mean = lambda c: F.col(c) / F.col("rows")
    plain = lambda i, j: (mean(f"q{i}{j}") - mean(f"a{i}") * mean(f"a{j}")) * factor
    cov = [(F.greatest(plain(i, j), F.lit(FLOORS[i - 1] ** 2)) if i == j else plain(i, j)).alias(f"s{i}{j}") for i, j in PAIRS]
    return g.select(*keys, "rows", *[(F.col(c) + mean(f"a{i}")).alias(f"m{i}") for i, c in enumerate(centre, 1)], *cov)


def mcd_estimates(rows: DataFrame, scratch: Scratch, steps: int | None = None) -> DataFrame:
    """(grp, n, m1.., l11..) of each group; ``rows`` has grp and x1 to x5.

    A start of a group takes steps until its determinant stops falling, which is when its subset stops changing; as it falls
    in every step before, this ends. ``steps`` bounds them all the same, if given. Tables of a row per group are written and
    counted, and go to the rows by broadcast unless there are too many groups; so no rows are dealt by group.
    """
    quarters = [F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"p{x}") for x in X]
    shape = scratch.table(rows.groupBy("grp").agg(F.count("*").alias("n"), *quarters), "shape")
    middle = [F.col(f"p{x}")[1].alias(f"c{i}") for i, x in enumerate(X, 1)]
    # First start: medians and spreads between quartiles. Second start: mean and covariance of all rows.
    spread = lambda i, x: F.greatest(F.pow((F.col(f"p{x}")[2] - F.col(f"p{x}")[0]) / 1.349, 2), F.lit(FLOORS[i - 1] ** 2))
    robust = shape.select("grp", F.lit(0).alias("start"), F.col("n").alias("rows"), *[F.col(f"p{x}")[1].alias(f"m{i}") for i, x in enumerate(X, 1)], *[(spread(i, X[i - 1]) if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i, j in PAIRS])
    few = small(shape, GROUPS)
    classic = _moments(_summed(rows.join(few.select("grp", *middle), "grp"), "grp"), ["grp"], 1.0).withColumn("start", F.lit(1))
    wanted = few.select("grp", F.ceil(F.col("n") * SHARE).alias("wanted"))
    now = scratch.table(with_cholesky(robust.unionByName(classic.select(robust.columns))), "start")
    done, step = [], 0
    while (open_ := now.count()) and (steps is None or step < steps):
        # Nothing of a row per start is longer than this table, whose rows are counted.
        hint = F.broadcast if open_ <= GROUPS else (lambda df: df)
        centres = [F.col(f"m{i}").alias(f"c{i}") for i in range(1, STATISTICS + 1)]
        near = with_distance(rows.join(hint(now.drop("rows", "log_det")), "grp")).withColumn("bin", F.least(F.lit(LAST_BIN), F.floor(F.log1p("d2") * BINS_A_LOG)).cast("int"))
        # One scan a step: sums are kept by bin, and those up to the edge are the subset's. What a window gathers of a group is
        # bounded by the number of bins.
        bins = _summed(near.select("grp", "start", "bin", *X, *centres), "grp", "start", "bin")
        w = Window.partitionBy("grp", "start").orderBy("bin")
        running = bins.withColumn("before", F.sum("rows").over(w) - F.col("rows")).join(wanted, "grp")
        moved = with_cholesky(_moments(running.filter("before < wanted"), ["grp", "start"], CONSISTENCY))
        # The starts themselves are no subsets, so their determinants do not count.
        still = F.col("n.log_det") >= F.col("o.log_det") - SETTLED if step else F.lit(False)
        better = F.lit(step == 0) | (F.col("n.log_det") < F.col("o.log_det"))
        met = moved.alias("n").join(now.alias("o"), ["grp", "start"])
        values = [c for c in moved.columns if c not in ("grp", "start")]
        both = scratch.table(met.select("grp", "start", *[F.when(better, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in values], still.alias("still")), f"step{step}")
        done.append(both.filter("still").drop("still"))
        # Settled starts are left out of the next step.
        now, step = both.filter("NOT still").drop("still"), step + 1
    for part in done:
        now = now.unionByName(part)
    now = scratch.table(now, "settled")
    best = now.groupBy("grp").agg(F.min(F.struct("log_det", "start")).alias("best")).select("grp", F.col("best.start").alias("start"))
    return scratch.table(now.join(best, ["grp", "start"]).drop("start", "rows", "log_det").join(shape.select("grp", "n"), "grp"), "estimates")


def shrunk(own: DataFrame, parent: DataFrame) -> DataFrame:
    """``own`` (grp, up, n, m1.., l11..) moved towards the row of ``parent`` whose grp is its up, the less the larger n is."""
    means = [f"m{i}" for i in range(1, STATISTICS + 1)]
    lows = [f"l{i}{j}" for i, j in PAIRS]
    above = parent.select(F.col("grp").alias("up"), *[F.col(c).alias(f"p_{c}") for c in means + lows])
    part = F.col("n") / (F.col("n") + PRIOR_ROWS)
    mixed = lambda a, b: a * part + b * (1 - part)
    cov = lambda i, j, of: sum((F.col(f"{of}l{i}{k}") * F.col(f"{of}l{j}{k}") for k in range(1, j + 1)), F.lit(0.0))
    out = own.join(above, "up").select("grp", "n", *[mixed(F.col(m), F.col(f"p_{m}")).alias(m) for m in means], *[mixed(cov(i, j, ""), cov(i, j, "p_")).alias(f"s{i}{j}") for i, j in PAIRS])
    return with_cholesky(out).drop("log_det")


def group_estimates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(grp, m1.., l11..) of each (lang, source), shrunk to its language and that to all rows; ``rows`` has lang_grp, grp and x1 to x5.

    The three levels are estimated together as groups of one table.
    """
    named = lambda level, of: F.concat(F.lit(level), of)
    all_rows, lang, source = F.lit("a"), named("l", F.col("lang_grp")), named("s", F.col("grp"))
    each = F.explode(F.array(*[F.struct(g.alias("grp"), up.alias("up")) for g, up in ((all_rows, all_rows), (lang, all_rows), (source, lang))])).alias("g")
    tree = scratch.table(rows.select("lang_grp", "grp").distinct().select(each).select("g.*").distinct(), "tree")
    long = rows.select(F.explode(F.array(all_rows, lang, source)).alias("grp"), *X)
    plain = mcd_estimates(long, scratch).join(tree, "grp")
    top = plain.filter("grp = 'a'").drop("up")
    langs = scratch.table(shrunk(plain.filter("grp LIKE 'l%'"), top), "langs")
    out = shrunk(plain.filter("grp LIKE 's%'"), langs)
    return scratch.table(out.withColumn("grp", F.expr("substr(grp, 2)")).drop("n"), "group_estimates")


def judge(docs: DataFrame, scratch: Scratch, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) with the ``COUNTS``, base_failed, distance and quality_ok.

    ``docs`` has text, lang and source. Null text counts as empty and fails the base rules, as does an empty one; very long
    texts are counted whole. Null lang or source is a value of its own. Rows that fail the base rules have no
    distance, all others have one, however few their group's rows. Repeated rows each count. An empty table gives an empty
    result. Where a kept column is named like an output, that output has an underscore after its name.
    """
    columns = keep or docs.columns
    lang, source = F.col("lang").cast("string").alias("l"), F.col("source").cast("string").alias("s")
    kept = F.struct(*[c for c, n in zip(own(docs), docs.columns) if n in columns]).alias("row")
    rows = docs.select(kept, "text", F.to_json(F.struct(lang, source)).alias("grp"), F.to_json(F.struct(lang)).alias("lang_grp"))
    counted = counts(rows, F.col("text"), F.col("row"), F.col("grp"), F.col("lang_grp")).withColumn("failed", base_failed())
    counted = scratch.table(counted.withColumns(statistics()), "counted")
    estimates = group_estimates(counted.filter("NOT failed").select("lang_grp", "grp", *X), scratch)
    # A row that failed needs no estimate and stays out of the join.
    passed = with_distance(counted.filter("NOT failed").join(small(estimates, GROUPS), "grp", "left"))
    out = passed.select(*counted.columns, "d2").unionByName(counted.filter("failed").withColumn("d2", F.lit(None).cast("double")))
    verdict = ~F.col("failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))
    return unpacked(out, columns, **{c: F.col(c) for c in COUNTS}, base_failed=F.col("failed"), distance=F.sqrt("d2"), quality_ok=verdict)


def op5_robust_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judge(docs, Scratch(spark, "rules"), ["doc_id"])
    return out.select("doc_id", *COUNTS, "base_failed", F.col("quality_ok").alias("kept"), "distance")
