"""Quality rules: text statistics, and the hashed n-gram log-likelihood ratio of trusted text against the raw corpus."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .shared import stored

#: Hash buckets of the two multinomials; the weight table has a row for each, whatever the corpus.
BUCKETS = 10_000
#: Share of the trusted documents, of those held out from the fit, that may fall below the threshold.
LEFT_OUT = 0.002
#: How far the threshold lies below that, in distances from there to their median.
MARGIN = 0.5
#: Threshold where no trusted document is held out: only the base rules judge.
NO_THRESHOLD = -1_000_000_000
#: Weights are whole millionths, so that sums do not depend on their order.
SCALE = 1_000_000
#: Neighbouring scores that are counted together when a rank is looked for; the driver sees counts alone.
STRETCH = 4_096

_BLANKS = " \t\n\x0b\x0c\r"
_BLANK = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for each row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none if it is null."""
    none = F.array().cast("array<string>")
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS)), lambda t: F.when(t == "", none).otherwise(F.split(t, _BLANK)))


def gram_buckets(words: Column, buckets: int = BUCKETS) -> Column:
    """Hash buckets of all words and of all pairs of neighbours."""
    hashed = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    pairs = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.concat(F.transform(words, lambda w: hashed(w)), F.transform(pairs, lambda w, i: hashed(w, F.get(words, i + 1))))


def repeated_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more. Windows are compared by 64-bit hashes."""
    heads = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    hashes = F.transform(heads, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def marked(s: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        twice = F.filter(s, lambda e, k: same(e, k + 1) | ((k > 0) & same(e, F.greatest(k - 1, F.lit(0)))))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(placed, marked), covered))

    return let(hashes, count)


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def trusted_ids(labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """Ids of all documents labelled good. Null ids are no labels."""
    return labels.filter((F.col("quality") == 1) & F.col(id).isNotNull()).select(id).distinct()


def fit_weights(df: DataFrame, trusted: DataFrame, text: str = "text", id: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """One row with ``weights``: for each bucket log(target share / raw share), add-one smoothed, in millionths.

    The raw multinomial counts the n-grams of all documents, the target those of the ``trusted`` ids among them.
    """
    return _fitted(df, df.join(trusted.select(id).distinct(), id, "left_semi"), text, buckets)


def _fitted(df: DataFrame, good: DataFrame, text: str, buckets: int = BUCKETS) -> DataFrame:
    """``fit_weights`` from the good documents themselves. Counts are summed in each task before they are shuffled."""
    def grams(docs: DataFrame, raw: int) -> DataFrame:
        exploded = docs.select(F.explode(let(words_of(F.col(text)), lambda w: gram_buckets(w, buckets))).alias("b"))
        n = exploded.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        return n.select("b", (F.col("n") * raw).alias("raw"), (F.col("n") * (1 - raw)).alias("good"))

    counts = grams(df, 1).unionByName(grams(good, 0)).groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").na.fill(0, ["raw", "good"])
    listed = every.agg(F.sort_array(F.collect_list(F.struct("b", "raw", "good"))).alias("c"), F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good"))
    weight = lambda c: F.round(SCALE * (
        F.log((c["good"] + 1) / (F.col("n_good") + buckets)) - F.log((c["raw"] + 1) / (F.col("n_raw") + buckets)))).cast("int")
    return cut_lineage(listed.select(F.transform("c", weight).alias("weights")))


def percentiles(scores: DataFrame, shares: tuple[float, ...], score: str = "score") -> list[float]:
    """Exact percentiles of the whole numbers in ``score``, linear between ranks; none without numbers.

    Stretches of STRETCH values are counted, then the values of the stretches that hold a rank looked for: counts grow with the range of scores, not with rows.
    """
    # nulls go after the scores are written: a filter before would work them out twice
    known = stored(scores.select(F.col(score).cast("long").alias("score"))).filter("score is not null")
    part = F.floor(F.col("score") / F.lit(STRETCH))
    wide = sorted((r["part"], r["count"]) for r in known.groupBy(part.alias("part")).count().collect())
    n = sum(c for _, c in wide)
    if not n:
        return []

    def at(counts: list[tuple[int, int]], rank: int) -> tuple[int, int]:
        """(the value that holds a rank, rows before it)."""
        before = 0
        for value, count in counts:
            if rank < before + count:
                return value, before
            before += count
        raise ValueError("no such rank")

    ranks = {r for q in shares for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))}
    held = {r: at(wide, r) for r in ranks}
    fine = known.filter(part.isin(sorted({p for p, _ in held.values()}))).groupBy("score").count().collect()
    counts = sorted((r["score"], r["count"]) for r in fine)
    value = {r: at([x for x in counts if x[0] // STRETCH == p], r - before)[0] for r, (p, before) in held.items()}

    def between(place: float) -> float:
        low, high = math.floor(place), math.ceil(place)
        return float(value[low]) if value[low] == value[high] else (high - place) * value[low] + (place - low) * value[high]

    return [between(q * (n - 1)) for q in shares]


def statistics(df: DataFrame, weights: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a struct ``_quality``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score.

    ``score`` is the mean weight of the text's n-grams in millionths, rounded; 0 without words.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    symbols = F.length(content) - F.length(F.regexp_replace(content, "[#*$%&|<>]+", ""))

    def measured(v: Column) -> Column:
        w, ratio = v["w"], v["ratio"]
        total = let(gram_buckets(w), lambda g: F.round(F.aggregate(
            F.transform(g, lambda b: F.get(ratio, b).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x) / F.greatest(F.size(g), F.lit(1))))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"), total.cast("long").alias("score"))

    both = F.struct(words_of(F.col(text)).alias("w"), F.col("_ratio").alias("ratio"))
    measures = df.withColumn("_ratio", weights.select("weights").scalar()).withColumn("_m", let(both, measured)).drop("_ratio")
    failed = (F.col("_m.n_words") < 50) | (100 * F.col("_m.n_repeat_words") > 50 * F.col("_m.n_words"))
    return measures.withColumn("_quality", F.struct(
        F.col("_m.n_words"), F.col("_m.word_chars"), symbols.cast("long").alias("n_symbols"),
        repeated_lines(F.col(text)).cast("long").alias("n_dup_lines"), F.col("_m.n_repeat_words"), failed.alias("base_failed"), F.col("_m.score"),
    )).drop("_m")


def only_kept(judged: DataFrame) -> DataFrame:
    """The rows of ``apply_rules`` that are kept.

    A generator says which, not a filter: a filter is pushed into the measuring, which would then be done once more for each figure in it.
    """
    one = F.when(F.col("_kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return judged.select("*", F.explode(one).alias("_one")).drop("_one")


def apply_rules(df: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``df`` with the struct ``_quality`` and ``_kept``, the verdict on each document.

    A document is kept if the base rules hold (50 words or more, at most half of them in repeated windows) and its mean log-likelihood
    ratio reaches the threshold. All trusted documents take part: half of them, by a hash of the id, make the target multinomial, the threshold comes from
    those of the other half that hold the base rules: the score below which LEFT_OUT of them lie, less MARGIN of its distance to their
    median. Without any the base rules alone judge.

    Null and empty texts have no words and fail; repeated rows are judged alike; extra columns are carried along.
    """
    trusted = trusted_ids(labels, id).withColumn("half", F.pmod(F.xxhash64(F.lit(1), id), F.lit(2)))
    # texts meet the labels once, by a shuffle however few labels there are; both halves are read from what is written here
    good = stored(df.select(id, text).join(trusted.hint("merge"), id).select(text, "half"), "zstd")
    weights = _fitted(df, good.filter("half = 0"), text)
    scored = statistics(good.filter("half = 1"), weights, text)
    score = let(F.col("_quality"), lambda q: F.when(~q["base_failed"], q["score"]))
    marks = percentiles(scored.select(score.alias("score")), (LEFT_OUT, 0.5))
    least = math.floor(marks[0] - MARGIN * (marks[1] - marks[0])) if marks else NO_THRESHOLD
    return statistics(df, weights, text).withColumn("_kept", ~F.col("_quality.base_failed") & (F.col("_quality.score") >= F.lit(least)))
