"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule is a score that rises with badness and a cutoff above which a text is rejected. Cutoffs are chosen for every
stratum (language) from labelled rows in two halves. The first half proposes: it ranks cutoffs by the share of the bad
texts they reject, less ``PRICE`` times the share of good ones. The second half certifies: for the
hypothesis "this cutoff rejects more than ``risk`` of the good texts", the exact binomial tail probability of seeing so
few rejections must be at most the level. Cutoffs are tested from the most cautious to the boldest and testing stops at
the first that fails, so a rule and stratum use their level once; the level and the risk are divided by the number of
rules and strata (Bonferroni). With probability 1 - ``delta`` no stratum loses more than ``risk`` of its good texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valograph.llm.shared import WORD_BREAK, written

RISK, DELTA = 0.05, 0.05
PRICE = 200
LEAST_WORTH = 0.02  # of the bad texts that a further rule must catch
STEPS = 40  # proposed cutoffs per rule and stratum
SPAN = 8
SYMBOLS = r"[#*$%&|<>]"
SOLID = r"[^\x20\x09-\x0D]"
RULES = ("symbols", "lines", "repeats", "capitals", "long_words", "short_words")
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows with the base counts and ``_scores``, the rules' scores in their order. Columns of these names are replaced.

    ``n_repeat_words`` compares windows of eight words by 64-bit hashes that respect the words' borders.
    """
    own = [c for c in docs.columns if c not in BASE]
    rows = docs.select(*own, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = rows.withColumns({"_w": F.array_remove(F.split("_t", WORD_BREAK), ""), "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike(SOLID))})
    rows = rows.select(
        *own,
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.size("_l").cast("bigint").alias("_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("bigint").alias("_capitals"),
        F.expr(f"case when size(_w) >= {SPAN} then transform(sequence(1, size(_w) - {SPAN - 1}), i -> xxhash64(slice(_w, i, {SPAN}))) end").alias("_h"),
    )
    plain = [*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "_lines", "_capitals"]
    rows = rows.select(*plain, F.expr("case when size(array_distinct(_h)) < size(_h) then array_sort(transform(_h, (x, i) -> struct(x as x, i as i))) end").alias("_s"))
    # Equal windows stand next to each other now; each covers eight words, less what the next one covers.
    twice = "(i > 0 and get(_s, i - 1).x = e.x) or (i < size(_s) - 1 and get(_s, i + 1).x = e.x)"
    rows = rows.select(*plain, F.expr(f"sort_array(transform(filter(_s, (e, i) -> {twice}), e -> e.i))").alias("_p"))
    covered = f"aggregate(zip_with(_p, slice(_p, 2, size(_p)), (a, b) -> least({SPAN}, coalesce(b - a, {SPAN}))), 0L, (n, x) -> n + x)"
    rows = rows.select(*plain, F.coalesce(F.expr(covered), F.lit(0)).cast("bigint").alias("n_repeat_words"))
    per = lambda a, b: F.coalesce(F.floor(F.col(a) * 1000 / F.nullif(F.col(b), F.lit(0))), F.lit(0)).cast("bigint")  # noqa: E731  in thousandths
    scores = {"symbols": per("n_symbols", "word_chars"), "lines": per("n_dup_lines", "_lines"), "repeats": per("n_repeat_words", "n_words"), "capitals": per("_capitals", "word_chars"), "long_words": per("word_chars", "n_words"), "short_words": -per("word_chars", "n_words")}
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.array(*[scores[r] for r in RULES]).alias("_scores"))
    # As the output of a generator the counts are computed once: a filter on them is not pushed below and repeated there.
    return rows.select(*own, F.inline(F.array(F.struct(*BASE, "_scores"))))


def log_factorial(n: Column) -> Column:
    """Natural logarithm of n!, by Stirling's series from ten on, to about 1e-13."""
    small = F.element_at(F.array(*[F.lit(math.log(math.factorial(k))) for k in range(10)]), (F.least(n, F.lit(9)) + 1).cast("int"))
    x = (n + 1).cast("double")
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return F.when(n < 10, small).otherwise(series)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X binomial (n, p), for k up to the mean; above it 1, which certifies nothing.

    The probability of k times the sum of the ratios below it, which fall so fast that the terms left out are under
    1e-16 of it.
    """
    log_k = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(p) + (n - k) * F.log(1 - p)
    steps = F.least(k, F.ceil(40 * F.sqrt(n * p) + 40)).cast("int")
    falling = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, j: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("term")),
        lambda a: a["sum"],
    )
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(log_k) * falling)


def thresholds(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``_stratum, _cutoffs``: for each rule the score above which a text is rejected, null where none is used.

    ``labelled`` has ``_stratum``, ``_scores``, ``_good`` and ``_certify`` (whether the row is of the second half). In each
    pass every stratum takes the certified rule that is worth most on the bad texts that its rules so far let pass.
    """
    chosen: dict[str, list[int | None]] = {}
    grid = written(_grid(labelled), "grid")
    for _ in RULES:
        taken = _best_rules(labelled, grid, _table(labelled.sparkSession, chosen), risk, delta).collect()  # a row per stratum
        for r in taken:
            chosen.setdefault(r["_stratum"], [None] * len(RULES))[r["_rule"]] = r["_cutoff"]
        if not taken:
            break
    return _table(labelled.sparkSession, chosen)


def _table(spark: SparkSession, chosen: dict[str, list[int | None]]) -> DataFrame:
    return spark.createDataFrame(list(chosen.items()), "_stratum string, _cutoffs array<bigint>")


def _over(scores: str, cutoffs: str) -> Column:
    return F.coalesce(F.exists(F.arrays_zip(F.col(scores).alias("s"), F.col(cutoffs).alias("c")), lambda x: F.coalesce(x["s"] > x["c"], F.lit(False))), F.lit(False))


def _grid(labelled: DataFrame) -> DataFrame:
    """``_stratum, _rule, _all``: cutoffs to try, quantiles of the proposing good rows and their largest score."""
    fine = labelled.where("_good and not _certify").select("_stratum", F.posexplode("_scores").alias("_rule", "_score")).groupBy("_stratum", "_rule")
    tried = F.percentile_approx("_score", F.array(*[F.lit(i / STEPS) for i in range(STEPS // 2, STEPS + 1)]), F.lit(10_000))
    return fine.agg(F.array_distinct(F.array_append(tried, F.max("_score"))).alias("_all"))


def _best_rules(labelled: DataFrame, grid: DataFrame, chosen: DataFrame, risk: float, delta: float) -> DataFrame:
    """``_stratum, _rule, _cutoff`` of the rule to take next, for strata that gain by one."""
    left = labelled.join(F.broadcast(chosen), "_stratum", "left").withColumn("_passed", ~_over("_scores", "_cutoffs"))
    long = left.select("_stratum", "_good", "_certify", "_passed", F.posexplode("_scores").alias("_rule", "_score"))
    # Rows of one score are counted before they meet the cutoffs.
    long = long.groupBy("_stratum", "_rule", "_score", "_good", "_certify", "_passed").agg(F.count(F.lit(1)).alias("_rows"))
    tested = F.lit(float(len(RULES))) * F.greatest(F.col("_strata"), F.lit(1))
    strata = labelled.agg(F.countDistinct("_stratum").alias("_strata"))
    over = F.when(F.col("_score") > F.col("_cutoff"), F.col("_rows")).otherwise(F.lit(0))
    met = long.join(grid, ["_stratum", "_rule"]).withColumn("_cutoff", F.explode("_all")).withColumn("_over", over)
    part = lambda what, keep: F.coalesce(F.sum(F.when(keep, what)), F.lit(0))
    good, certify = F.col("_good"), F.col("_certify")
    counts = {"_n": (F.col("_rows"), good & certify), "_k": (F.col("_over"), good & certify), "_caught": (F.col("_over"), ~good & ~certify & F.col("_passed")), "_bad": (F.col("_rows"), ~good & ~certify), "_lost": (F.col("_over"), good & ~certify), "_fine": (F.col("_rows"), good & ~certify)}
    counted = written(met.groupBy("_stratum", "_rule", "_cutoff").agg(*[part(*x).alias(n) for n, x in counts.items()]), "counted")
    tail = binomial_tail(F.col("_k"), F.col("_n"), F.lit(risk / len(RULES)))
    judged = counted.join(F.broadcast(strata)).withColumn("_ok", (F.col("_n") > 0) & (tail <= F.lit(delta) / tested))
    # From the highest cutoff down; none below the first that fails.
    certified = F.expr("bool_and(_ok) over (partition by _stratum, _rule order by _cutoff desc)")
    worth = F.col("_caught") / F.greatest(F.col("_bad"), F.lit(1)) - PRICE * F.col("_lost") / F.greatest(F.col("_fine"), F.lit(1))
    best = judged.withColumn("_certified", certified).where("_certified").withColumn("_worth", F.round(worth, 9)).where(F.col("_worth") > LEAST_WORTH)
    # Of cutoffs about as good the most cautious one.
    best = best.withColumn("_top", F.expr("max(_worth) over (partition by _stratum)")).where("_worth >= 0.95 * _top")
    rule = F.expr("first_value(_rule) over (partition by _stratum order by _worth desc, _rule)")
    return best.withColumn("_first", rule).where("_rule = _first").groupBy("_stratum", "_rule").agg(F.max("_cutoff").alias("_cutoff"))


def stratum(docs: DataFrame, lang: str = "lang") -> Column:
    return F.coalesce(F.col(lang), F.lit("")) if lang in docs.columns else F.lit("")


def fitted(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id", lang: str = "lang", good: str = "quality") -> DataFrame:
    """Thresholds from all labelled ones of the ``measured`` rows. Texts that fail the base rules do not count, as no cutoff judges them."""
    marks = labels.where(F.col(good).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg((F.min(good) == 1).alias("_good"))
    scores = rows.where(~F.col("base_failed")).select(F.col(doc_id).alias("_id"), stratum(rows, lang).alias("_stratum"), "_scores")
    second = F.substring(F.md5(F.col("_id").cast("string")), 32, 1) < "8"
    return thresholds(written(scores.join(marks, "_id").select("_stratum", "_good", second.alias("_certify"), "_scores"), "labelled"))


def judged(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", good: str = "quality", with_text: bool = True
) -> DataFrame:
    """``docs`` with the base counts, ``base_failed`` and ``kept``; without their texts if ``with_text`` is false.

    A text is kept if it passes the base rules and no certified cutoff of its stratum rejects it; a stratum without
    enough labels has none. A null text has no words and fails. Rows that repeat are judged each by itself.
    """
    rows = measured(docs, text)
    rows = written(rows if with_text else rows.drop(text), "measured")  # once, for the thresholds and the verdicts
    cutoffs = fitted(rows, labels, doc_id, lang, good)
    # A stratum needs hundreds of labelled rows to have a cutoff; Spark broadcasts the table if it is small.
    rows = rows.withColumn("_own", stratum(docs, lang)).join(cutoffs, F.col("_own") == F.col("_stratum"), "left")
    kept = ~F.col("base_failed") & ~_over("_scores", "_cutoffs")
    return rows.withColumn("kept", kept).drop("_own", "_stratum", "_cutoffs", "_scores")
