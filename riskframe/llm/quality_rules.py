"""Quality rules: hashed n-gram log-likelihood ratio (all DataFrame functions).

Two multinomials over hashed word unigrams and bigrams are counted over the
whole corpus: one from the trusted documents, one from all documents.  A
document's score is the mean log ratio of its n-grams; it is kept if the
score reaches ``min_llr`` and no base rule fails.

The ratios are rounded to fixed-point integers, so a sum does not depend on
the order of its terms and every document gets the same verdict on each run.

Defined results.  A null text has no words; without words the ratio is 0
(the base rule rejects it).  Repeated rows get equal verdicts, also when the
id is null: nothing is joined back by id.  Without trusted documents all
ratios are 0 and only the base rules decide.  An empty table gives an empty
result.  Extra columns stay; the columns that the operator adds replace
existing ones of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.base import SPACES, WORD, let, materialise, text_of

BITS = 15
BUCKETS = 1 << BITS
UNIT = 1 << 20          # fixed point of a log ratio
PSEUDO = 4.0            # pseudo-count of a raw bucket
WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
MIN_LLR = -0.15         # mean log ratio in nats that a kept document reaches
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def pair_hashes(h: Column, step: int) -> Column:
    """Hashes of the elements ``i`` and ``i + step`` of an array."""
    n = F.size(h) - step
    return F.when(n > 0, F.zip_with(F.slice(h, 1, n), F.slice(h, step + 1, n), lambda a, b: F.xxhash64(a, b))).otherwise(
        F.expr("array()").cast("array<bigint>"))


def ngram_hashes(words: Column) -> Column:
    """A struct of the word hashes ``h1`` and of the bigram hashes ``h2``."""
    h1 = F.transform(words, lambda w: F.xxhash64(w))
    return let(h1, lambda h: F.struct(h.alias("h1"), pair_hashes(h, 1).alias("h2")))


def bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BITS).cast("int")


def repeat_words(h2: Column) -> Column:
    """Words in windows of eight that are found twice or more, each word
    once; windows are hashed by doubling, from the hashes of bigrams."""
    def covered(numbered: Column) -> Column:
        # sorted by hash: a window repeats if a neighbour has its hash
        def repeated(x, k):
            before = F.coalesce(F.get(numbered, k - 1)["h"] == x["h"], F.lit(False))
            return before | F.coalesce(F.get(numbered, k + 1)["h"] == x["h"], F.lit(False))
        starts = F.array_sort(F.transform(F.filter(numbered, repeated), lambda x: x["i"]))
        first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at"))
        return F.aggregate(
            starts, first,
            lambda acc, s: F.struct((acc["n"] + F.least(F.lit(WINDOW), s - acc["at"])).alias("n"), s.alias("at")),
            lambda acc: acc["n"].cast("long"))

    def of_windows(h: Column) -> Column:
        # most texts repeat no window; only the others are sorted
        numbered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(numbered, covered)).otherwise(F.lit(0).cast("long"))

    def of_fours(h4: Column) -> Column:
        return let(pair_hashes(h4, 4), of_windows)
    return F.when(F.size(h2) >= WINDOW, let(pair_hashes(h2, 2), of_fours)).otherwise(F.lit(0).cast("long"))


def measures(text: Column, ratios: Column) -> Column:
    """A struct of the base rules' word counts and the document's sum of
    fixed-point log ratios; the words are found once."""
    def total(h: Column) -> Column:
        return F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: acc + F.get(ratios, bucket(x)))

    def of_hashes(h: Column) -> Column:
        return F.struct(F.size(h["h1"]).cast("long").alias("n_words"), repeat_words(h["h2"]).alias("n_repeat_words"),
                        (total(h["h1"]) + total(h["h2"])).alias("_total"))
    return let(ngram_hashes(words_of(text)), of_hashes)


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(b, ratio)`` for every bucket: the fixed-point log ratio of the
    trusted to the raw multinomial, both smoothed.

    ``trusted`` holds ids.  One scan counts both; counts are combined before
    the shuffle, so a very common n-gram is one row per task."""
    ids = trusted.select(F.col(id_col).cast("string").alias("_tid")).where("_tid is not null").distinct()
    text = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    # the ids grow with the corpus, so this is a shuffle join at every size; rows without an id are dealt by text
    key = F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("null "), F.xxhash64("_text").cast("string")))
    marked = text.withColumn("_key", key).join(ids.hint("merge"), F.col("_key") == F.col("_tid"), "left")
    grams = marked.select(F.col("_tid").isNotNull().cast("long").alias("t"),
                          F.explode(let(ngram_hashes(words_of(F.col("_text"))), lambda h: F.concat(h["h1"], h["h2"]))).alias("h"))
    grams = grams.select("t", bucket(F.col("h")).alias("b"))
    counts = materialise(grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")),
                         "ngram-counts")
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    raw_n, target_n = int(total["raw"] or 0), int(total["target"] or 0)
    if target_n == 0:
        ratio = F.lit(0).cast("long")
    else:
        # equal pseudo-counts as shares of the two totals, so a rare bucket's ratio is near 0
        share = PSEUDO * BUCKETS / raw_n
        q = F.coalesce("raw", F.lit(0)) / F.lit(float(raw_n)) + F.lit(share / BUCKETS)
        p = F.coalesce("target", F.lit(0)) / F.lit(float(target_n)) + F.lit(share / BUCKETS)
        ratio = F.round(F.log(p / q) * F.lit(float(UNIT))).cast("long")
    buckets = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    return buckets.join(counts, "b", "left").select("b", ratio.alias("ratio"))


def quality_rules(docs: DataFrame, trusted: DataFrame, min_llr: float = MIN_LLR,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the base rules' columns, ``llr`` and ``kept``."""
    docs = docs.drop(*ADDED)
    ratios = log_ratios(docs, trusted, id_col, text_col)
    # BUCKETS numbers, whatever the corpus: an array constant of the scoring plan
    numbers = [str(r["ratio"]) for r in ratios.orderBy("b").collect()]
    table = F.split(F.lit(",".join(numbers)), ",").cast("array<bigint>")
    text = text_of(text_col)
    # a generator of one row computes the struct once; a projection would write it out for each use
    out = docs.select("*", F.inline(F.array(measures(text, table))))
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    llr = F.when(grams == 0, F.lit(0.0)).otherwise(F.col("_total") / grams / F.lit(float(UNIT)))
    repeats = F.col("n_repeat_words")
    return (out.select(
        *[F.col(c) for c in docs.columns], "n_words",
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup_lines(text).alias("n_dup_lines"), "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PCT * F.col("n_words"))).alias("base_failed"),
        llr.alias("llr"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(float(min_llr)))))
