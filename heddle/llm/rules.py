"""Quality rules: document statistics, and a log-likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

Everything here is DataFrame functions. A text's arrays are made once per row and handed on as columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import double_array, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Buckets of the hashed n-grams: the model's size, whatever the corpus.
BUCKETS = 1 << 13
#: Added to each bucket's count, as a share of an even spread.
SMOOTHING = 1.0
#: Trusted ids that are sent to every task, at most (8 MB); more are joined by a shuffle, with the same counts.
MOST_SENT = 1_000_000
#: Documents whose mean log-likelihood ratio an n-gram is below this are rejected.
THRESHOLD = -0.35

MIN_WORDS = 50
MOST_REPEATED_PERCENT = 50


def statistics(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs) and base_failed.

    Null and empty texts have no words, so every count is 0 and base_failed is true. Equal 3-word
    windows are told by a 64-bit hash of their words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    step = docs.withColumns({"__w": words(F.col(text_col)), "__l": lines})
    w = F.col("__w")
    step = step.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "__g": F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>")),
    })
    step = step.withColumn("n_repeat_words", _repeated(F.col("__g")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return step.withColumn("base_failed", failed).drop("__w", "__l", "__g")


def _repeated(grams: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: windows sorted by hash show their equals as neighbours."""
    placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    # Bound once per row: each array is an element of a one-element array, and the lambda names it.
    twice = lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["g"] == x["g"])) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False)))
    at = F.get(F.transform(F.array(placed), lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"]))), F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(-3).alias("last"))
    total = F.aggregate(at, start, lambda a, i: F.struct((a["covered"] + F.least(F.lit(3), i - a["last"])).alias("covered"), i.alias("last")), lambda a: a["covered"])
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(total)


def tokens(text: Column) -> Column:
    """Runs of letters (lower case, capitals or mixed), of digits, or of other signs, each apart from the others."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\p{L}+|\p{N}+|[^\p{L}\p{N}\s]+)"), F.lit(1))


def hashed_ngrams(docs: DataFrame, *, text_col: str, out: str, buckets: int) -> DataFrame:
    """``docs`` with the buckets of every token and every two tokens in a row."""
    t = F.col("__t")
    step = docs.withColumn("__t", tokens(F.col(text_col)))
    one = F.transform(t, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    two = F.when(F.size(t) >= 2, F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.pmod(F.xxhash64(F.get(t, i), F.get(t, i + 1)), F.lit(buckets)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return step.withColumn(out, F.concat(one, two)).drop("__t")


def fit_ratio(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> list[float]:
    """Log ratio of each bucket's probability in the trusted documents to that in all of ``docs``.

    ``trusted`` has the ids of documents to trust. Both sides count every n-gram of every document. Each
    task sends one row a bucket to the shuffle. Without trusted documents all ratios are 0."""
    ids = trusted.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id")).distinct().withColumn("__trusted", F.lit(1))
    if ids.limit(MOST_SENT + 1).count() <= MOST_SENT:
        ids = F.broadcast(ids)
    marked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(ids, "__id", "left")
    grams = hashed_ngrams(marked, text_col="__text", out="g", buckets=buckets)
    # Outer: else the optimizer infers a filter from the explode and computes the arrays anew inside it, once an element.
    grams = grams.select(F.explode_outer("g").alias("g"), "__trusted").where("g is not null")
    counts = {r["g"]: (r["raw"], r["target"]) for r in grams.groupBy("g").agg(F.count(F.lit(1)).alias("raw"), F.count("__trusted").alias("target")).collect()}  # a row a bucket
    raw, target = (sum(c[k] for c in counts.values()) for k in (0, 1))
    if not target:
        return [0.0] * buckets
    p = lambda n, total: (n + SMOOTHING) / (total + SMOOTHING * buckets)
    return [math.log(p(counts.get(b, (0, 0))[1], target) / p(counts.get(b, (0, 0))[0], raw)) for b in range(buckets)]


def ratio_scores(docs: DataFrame, ratios: list[float], *, text_col: str = "text", out: str = "llr") -> DataFrame:
    """``docs`` with the mean log ratio of a document's n-grams; 0 for a document without any."""
    table = double_array(ratios)
    step = hashed_ngrams(docs, text_col=text_col, out="__g", buckets=len(ratios))
    g = F.col("__g")
    total = F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, b))
    return step.withColumn(out, F.when(F.size(g) > 0, total / F.size(g)).otherwise(F.lit(0.0))).drop("__g")


def judge(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the statistics, ``llr`` and ``kept``: not base_failed, and llr at or above ``threshold``.

    Every row gets a verdict, the same one for equal texts. Rows with a null id count to the corpus and
    are judged. An empty table gives no rows."""
    ratios = fit_ratio(docs, trusted, id_col=id_col, text_col=text_col)
    scored = ratio_scores(statistics(docs, text_col=text_col), ratios, text_col=text_col)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents whose labels call them good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
