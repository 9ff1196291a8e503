"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus (native).

Words and pairs of neighbouring words are hashed into buckets. The raw multinomial counts every
row; the target multinomial counts a bounded sample of rows labelled good. A document's score is
the mean over its n-grams of log p_target - log p_raw; documents from ``threshold`` up are kept.
The ratios are one array of ``buckets`` numbers, whatever the size of the corpus, and reach the
tasks as a scalar subquery; scoring itself needs no shuffle.

Defined results: a null or blank text has no words, fails the base rules and scores 0; labels for
unknown ids, null labels and repeated labels (a row counts as good if any of its labels says so and
none says bad or toxic) are harmless; without any target the score is 0 everywhere and only the base rules
decide; repeated rows count each time; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of hashed n-grams.
BUCKETS = 1 << 14
#: Labelled rows of which the target is made, those with the least hash of doc_id.
TARGET_ROWS = 20_000
#: N-grams that the raw multinomial is worth as the prior of the target: with far fewer labelled n-grams than this the
#: ratios stay near 0 and little is rejected; prior and threshold decide together and are arguments.
PRIOR = 65_536.0
#: Mean log-likelihood ratio from which a document is kept.
THRESHOLD = -0.07
_WORD = "[^\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _apart(array: str, other: str, step: int, made: str) -> Column:
    """Hashes of the elements of ``array`` with those of ``other`` that stand ``step`` further on, as far as ``made`` many."""
    return F.zip_with(F.slice(array, F.lit(1), F.col(made)), F.slice(other, F.lit(1 + step), F.col(made)), lambda a, b: F.xxhash64(a, b))


def with_hashes(documents: DataFrame, carry: list[str] = ()) -> DataFrame:
    """doc_id, text, further columns as one, the number of words, the 64-bit hash of each word (h) and of each pair of neighbours (h2), in order."""
    carried = F.struct(*carry) if carry else F.lit(None).cast("boolean")
    words = documents.select("doc_id", "text", carried.alias("carried"), words_of(F.col("text")).alias("words"))
    hashed = words.select("doc_id", "text", "carried", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("h")).withColumn("pairs", F.greatest(F.col("n") - 1, F.lit(0)))
    return hashed.withColumn("h2", _apart("h", "h", 1, "pairs"))


def ratios(documents: DataFrame, labels: DataFrame, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS, prior: float = PRIOR) -> DataFrame:
    """One row with ``llr``, the smoothed log ratio of each bucket."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND coalesce(t, 0) = 0 AND doc_id IS NOT NULL")
    good = good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).withColumn("target", F.lit(1))
    rows = with_hashes(documents).join(F.broadcast(good), "doc_id", "left").select(F.explode(F.concat("h", "h2")).alias("x"), F.coalesce("target", F.lit(0)).alias("target")).select(F.pmod("x", F.lit(buckets)).cast("int").alias("bucket"), F.lit(1).alias("raw"), "target")
    every = documents.sparkSession.range(buckets).select(F.col("id").cast("int"), F.lit(0), F.lit(0))
    counts = rows.union(every).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    sums = counts.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("cells"), F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    share = lambda c: (c["raw"] + 1) / (F.col("raw") + buckets)
    ratio = F.transform("cells", lambda c: F.log(c["target"] / share(c) + F.lit(prior)) - F.log(F.col("target") + F.lit(prior)))
    return sums.select(F.when(F.col("target") > 0, ratio).alias("llr"))


def base_rules(documents: DataFrame, carry: list[str] = ()) -> DataFrame:
    """doc_id, text, h, n and the columns n_words .. base_failed."""
    text = F.coalesce("text", F.lit(""))
    # Hashes of five words from those of two and two and one; words in windows that occur twice or more:
    # window hashes with their places are sorted, equal neighbours are the repeated ones, and the places' reach of five words is measured.
    hashed = with_hashes(documents, carry).withColumns({"fours": F.greatest(F.col("n") - 3, F.lit(0)), "fives": F.greatest(F.col("n") - 4, F.lit(0))})
    hashed = hashed.withColumn("h4", _apart("h2", "h2", 2, "fours")).withColumn("w5", F.when(F.col("n") > 5, _apart("h4", "h", 4, "fives")))
    hashed = hashed.withColumn("again", F.coalesce(F.size(F.array_distinct("w5")) < F.size("w5"), F.lit(False)))
    pairs = F.array_sort(F.transform("w5", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    hashed = hashed.withColumn("sorted", F.when(F.col("again"), pairs))
    last = F.size("sorted") - 1
    hit = F.filter("sorted", lambda s, k: ((k > 0) & (F.get("sorted", k - 1)["x"] == s["x"])) | ((k < last) & (F.get("sorted", k + 1)["x"] == s["x"])))
    hashed = hashed.withColumn("places", F.when(F.col("again"), F.array_sort(F.transform(hit, lambda s: s["i"]))))
    end = F.size("places") - 1
    reach = F.aggregate(F.transform("places", lambda p, k: F.when(k == end, F.lit(5)).otherwise(F.least(F.lit(5), F.get("places", k + 1) - p))), F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(_WORD))
    hashed = hashed.withColumn("lines", lines)
    n = F.col("n").cast("long")
    out = hashed.select(
        "doc_id", "text", "carried", "h", "h2", "n",
        n.alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("again"), reach), F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS, prior: float = PRIOR, carry: list[str] = ()) -> DataFrame:
    """doc_id, text, the columns in ``carry``, base columns, ``llr`` (the mean log ratio) and ``kept`` for every row of ``documents``."""
    table = ratios(documents, labels, buckets, target_rows, prior).scalar()
    scored = base_rules(documents, carry).withColumn("table", table)
    add = lambda a, x: a + F.get("table", F.pmod(x, F.lit(buckets)).cast("int"))
    total = F.aggregate("h2", F.aggregate("h", F.lit(0.0), add), add)
    scored = scored.withColumn("llr", F.coalesce(F.when(F.col("n") > 0, total / (F.size("h") + F.size("h2"))), F.lit(0.0)))
    # Rows pass a generator, through which Spark pushes no filter; a pushed filter would repeat the whole chain of expressions.
    return scored.select(F.inline(F.array(F.struct("doc_id", "text", *[F.col("carried")[c].alias(c) for c in carry], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"), F.round("llr", 6).alias("llr")))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")


SQL = None  # XXH64 buckets are not in DuckDB; tests/llm holds a brute-force version
