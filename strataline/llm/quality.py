"""Quality rules by the frequency of lines across documents.

Lines are normalised (lower case, one space for white space, one 0 for a number), hashed, and counted per host: in how
many distinct documents does a line stand?  Lines above a host's limit are boilerplate and are removed; a document
that loses more than half of its words is depleted and rejected.  Equal texts count as one document, so copies of a
document do not turn its own lines into boilerplate.  Everything here is DataFrame work inside the JVM.

Defined results: a null or empty text has no words and fails the base rules; a null host is a host of its own; equal
rows get equal verdicts; texts of any length are counted whole; blank lines are never counted; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import WORD, packed, row_digest, settle, words

SHARE = 0.03      # a line above this share of a host's distinct documents is boilerplate ...
LEAST = 20        # ... if it stands in more than this many of them
BROADCAST_KEYS = 1 << 16   # frequent lines (8 bytes each) up to which they go to all tasks; more are joined by key
PACKED_BITS = 14           # bits of a place that may be taken from a window's hash
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words that may lie in repeated three-word windows


def normal_lines(text: Column) -> Column:
    """The normalised lines of a text, as many as it has lines."""
    one = F.regexp_replace(F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " "), "[0-9]+", "0")
    return F.split(one, "\n", -1)


def line_key(host: str, line: Column) -> Column:
    return F.xxhash64(F.col(host), F.trim(line))


def text_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` plus __host, __digest, the counts of the base rules and __lines, (key, words) of every line with words.

    Each step is a projection of its own, so that no array is computed twice.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select(*keep, F.xxhash64("source").alias("__host"), F.unhex(row_digest("text")).alias("__digest"), text.alias("__text"),
                    words("text").alias("__w"), normal_lines(text).alias("__n"),
                    F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("__l"))
    n = F.size("__w")
    b = a.select(*keep, "__host", "__digest", n.cast("long").alias("n_words"),
                 F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
                 (F.char_length("__text") - F.char_length(F.regexp_replace("__text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
                 (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
                 F.transform(F.filter(F.transform("__n", lambda x: F.trim(x)), lambda x: x != ""),
                             lambda x: F.struct(F.xxhash64("__host", x).alias("key"),
                                                (F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words"))).alias("__lines"),
                 F.transform(F.slice("__w", F.lit(1), F.greatest(n - 2, F.lit(0))),
                             lambda x, i: F.xxhash64(x, F.get("__w", i + 1), F.get("__w", i + 2))).alias("__h"))
    # repeated windows: sort (hash, place) and compare neighbours; skipped where all windows differ.  Both are packed in one
    # long while the place takes few bits from the hash; longer texts sort pairs, with the whole hash
    base = [c for c in b.columns if c != "__h"]
    bits = F.length(F.bin(F.size("__h")))
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    c = b.select(*base, bits.alias("__bits"), F.when(
        repeats & (bits <= PACKED_BITS),
        F.sort_array(F.transform("__h", lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long"))))).alias("__s"), F.when(
        repeats & (bits > PACKED_BITS), F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("__pairs"))

    def high(x):
        return F.call_function("shiftright", x, F.col("__bits"))

    def twin(v, i):
        return (F.coalesce(high(F.get("__s", i - 1)) == high(v), F.lit(False)) | F.coalesce(high(F.get("__s", i + 1)) == high(v), F.lit(False)))

    def same(v, i):
        return (F.coalesce(F.get("__pairs", i - 1)["h"] == v["h"], F.lit(False)) | F.coalesce(F.get("__pairs", i + 1)["h"] == v["h"], F.lit(False)))

    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bits")) - 1
    d = c.select(*base, F.sort_array(F.coalesce(F.transform(F.filter("__s", twin), lambda v: v.bitwiseAND(low)),
                                                F.transform(F.filter("__pairs", same), lambda v: v["i"].cast("long")))).alias("__at"))
    covered = F.aggregate(F.transform("__at", lambda v, i: F.least(F.lit(3), F.coalesce(F.get("__at", i + 1), v + 3) - v).cast("long")),
                          F.lit(0).cast("long"), lambda s, x: s + x)
    return d.select(*base, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def frequent_lines(features: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """Keys of the lines above their host's limit, counted over distinct documents."""
    distinct = features.groupBy("__host", "__digest").agg(F.first("__lines.key").alias("__keys"))
    hosts = distinct.groupBy("__host").agg(F.count(F.lit(1)).alias("__docs"))
    counts = (distinct.select("__host", F.explode(F.array_distinct("__keys")).alias("key")).groupBy("key")
              .agg(F.count(F.lit(1)).alias("__n"), F.max("__host").alias("__host")).where(F.col("__n") > least))
    # settled: their number is known, and a join can split a line that most documents share
    frequent = settle(counts.join(hosts, "__host").where(F.col("__n") > F.lit(share) * F.col("__docs")).select("key"))
    return F.broadcast(frequent) if frequent.count() <= BROADCAST_KEYS else frequent


def lost_lines(features: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """Per distinct document with frequent lines: __lost (words in them) and __frequent (their keys)."""
    lines = features.groupBy("__host", "__digest").agg(F.first("__lines").alias("__lines")).select("__host", "__digest", F.inline("__lines"))
    hits = lines.join(frequent_lines(features, share, least), "key")
    return hits.groupBy("__host", "__digest").agg(F.sum("words").alias("__lost"), F.collect_set("key").alias("__frequent"))


def verdicts(features: DataFrame, share: float = SHARE, least: int = LEAST, lost: DataFrame | None = None) -> DataFrame:
    """The features with base_failed and kept."""
    lost = lost if lost is not None else lost_lines(features, share, least)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    depleted = 2 * F.coalesce(F.col("__lost"), F.lit(0)) > F.col("n_words")
    return (features.join(lost, ["__host", "__digest"], "left").withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & ~depleted))


def keep_documents(docs: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """The documents that pass, without their frequent lines, in the columns of ``docs``; n_chars, if any, is recounted."""
    features = settle(text_features(docs, []))
    passed = verdicts(features, share, least).where("kept").select("__host", "__digest", "__frequent").dropDuplicates(["__host", "__digest"])
    rows = packed(docs, F.xxhash64("source").alias("__host"), F.unhex(row_digest("text")).alias("__digest"), F.col("text").alias("__text"))
    rows = rows.join(passed, ["__host", "__digest"]).withColumn("__n", F.when(F.col("__frequent").isNotNull(), normal_lines(F.col("__text"))))
    left = F.array_join(F.filter(F.split("__text", "\n", -1), lambda x, i: ~F.array_contains(
        "__frequent", F.xxhash64("__host", F.trim(F.get("__n", i))))), "\n")
    out = F.col("__doc").withField("text", F.when(F.col("__frequent").isNotNull(), left).otherwise(F.col("__text")))
    rows = rows.select(out.alias("__doc"))
    if "n_chars" in docs.columns:
        rows = rows.select(F.col("__doc").withField("n_chars", F.char_length("__doc.text").cast(docs.schema["n_chars"].dataType)).alias("__doc"))
    return rows.select("__doc.*")
