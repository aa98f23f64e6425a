"""Features of texts: one array a text, and relations in long form (.., feature, value); scaling, vocabularies and TF-IDF."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import measures as M
from quillmark.functions import text as T
from quillmark.operators import sparse
from quillmark.operators.inference import added_up


#: The measures of a text that need no vocabulary, in the order of the array that measures() gives.
BASE = (
    "word_count_feature sentence_count_feature paragraph_count_feature mean_sentence_words median_sentence_words std_sentence_words short_sentence_ratio long_sentence_ratio "
    "punctuation_per_1000w comma_per_1000w semicolon_per_1000w colon_per_1000w dash_per_1000w question_per_1000w exclamation_per_1000w quote_mark_per_1000w apostrophe_per_1000w ellipsis_per_1000w "
    "type_token_ratio root_type_token_ratio hapax_ratio avg_word_length long_word_ratio short_word_ratio contraction_per_1000w archaic_marker_per_1000w abstract_suffix_per_1000w dialogue_marker_per_1000w"
).split() + [f"fw_{w}_per_1000w" for w in T.FUNCTION_WORDS]


def measures(texts: DataFrame, keys: list[str], grams: list[str] = (), column: str = "text", versions: str | None = None) -> DataFrame:
    """keys, base (the BASE measures as one array) and rates (per 1000 trigrams of the text, one for each of grams) of every text.

    Texts do not leave their partition. A null text has null measures, an empty one zeros. versions names a column after
    keys: a row for each of M.VERSIONS of a text, which tasks make of the words that they found.
    """
    kept = texts.select(*keys, F.col(column).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keys)])
    more = f"`{versions}` string, " if versions else ""
    return kept.mapInArrow(M.measured(list(keys), list(grams), versions), f"{kinds}, {more}base array<double>, rates array<double>")


def measure_sums(texts: DataFrame, by: list[str], grams: list[str] = (), column: str = "text", versions: str | None = None) -> DataFrame:
    """by (and versions) and sums, as inference.moments_of takes them, of the BASE measures and rates of grams of the texts of each group of by.

    A task measures and adds up its texts in one pass, so that no text's measures are written or dealt; null texts are
    left out. versions is as in measures.
    """
    kept = texts.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("__text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[: len(by)]) + (f"`{versions}` string, " if versions else "")
    measure = M.measured(list(by), list(grams), versions)
    names = [*by, versions] if versions else by

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added_up(map(joined, measure(batches)), names)

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.concatenate([np.asarray(batch.column(c).flatten()).reshape(batch.num_rows, -1) for c in ("base", "rates")], axis=1) if batch.num_rows else np.zeros((0, 0))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), M.lists(values)], [*names, "values"])

    return kept.mapInArrow(run, f"{kinds}sums array<double>")


def hapax_ratio(texts: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """keys, feature, value: the share of words that occur once."""
    tokens = texts.select(*keys, T.words(F.lower(column)).alias("tokens"))
    counts = tokens.select(*keys, F.size("tokens").alias("n"), F.explode_outer("tokens").alias("t")).groupBy(*keys, "n", "t").count()
    hapax = counts.groupBy(*keys, "n").agg(F.count_if((F.col("count") == 1) & F.col("t").isNotNull()).alias("once"))
    return hapax.select(*keys, F.lit("hapax_ratio").alias("feature"), T.ratio(F.col("once"), F.col("n")).alias("value"))


def eligible_grams(texts: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """keys, gram of every trigram of letters, blank and common marks that is not blank alone."""
    flat = F.regexp_replace(F.lower(column), r"\s+", " ")
    grams = F.regexp_extract_all(flat, F.lit("(?=([a-z ,.;:'\"!?-]{3}))"), F.lit(1))
    return texts.select(*keys, F.explode(grams).alias("gram")).where(F.trim("gram") != "")


def trigram_vocabulary(texts: DataFrame, size: int = 120, column: str = "text") -> DataFrame:
    """The commonest eligible trigrams, ties by the gram."""
    return eligible_grams(texts, [], column).groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(size)


def fold_vocabularies(texts: DataFrame, k: int = 3, size: int = 120) -> list[list[str]]:
    """For each outer fold, the trigram vocabulary of the texts of the other folds: k times `size` grams at most come to the driver."""
    counts = texts.select(F.col("fold").cast("int"), "text").mapInArrow(M.counted, "fold int, gram string, n long").groupBy("fold", "gram").agg(F.sum("n").alias("n"))
    dealt = counts.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("outer <> fold").groupBy("outer", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("outer").orderBy(F.desc("n"), "gram"))
    rows = dealt.withColumn("at", place).where(F.col("at") <= size).orderBy("outer", "at").collect()
    return [[r.gram for r in rows if r.outer == o] for o in range(k)]


def tfidf(texts: DataFrame, key: str, train: Column, low: int = 3, high: int = 5, least: int = 2, most: int = 30_000, column: str = "text") -> DataFrame:
    """key, gram, weight: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), scaled to length 1.

    The vocabulary and document frequencies come from the rows where train holds: grams in `least` of them at least,
    and of those the `most` with the largest total count, ties by the gram; they come to the driver. Grams are counted
    within a text, so that no task groups those of its texts.
    """
    rows = texts.select(key, F.lit("").alias("group"), F.when(train, 1).otherwise(0).alias("fold"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    vocabulary = sparse.vocabularies(rows, 1, low, high, least, most)
    kind = dict(rows.dtypes)[key]
    if not vocabulary.grams:
        return rows.where("false").select(key, F.lit("").alias("gram"), F.lit(0.0).alias("weight"))
    sent = rows.sparkSession.sparkContext.broadcast((vocabulary.grams, vocabulary.idf[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, idf = pa.array(sent.value[0]), sent.value[1]
        finder = sparse.Finder(sent.value[0])
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                places, n = finder.found(M.flat(text.lower()), low, high)
                weights = (1 + np.log(n)) * idf[places]
                if len(places):
                    keys = batch.column(0).take(pa.array(np.full(len(places), i)))
                    yield pa.RecordBatch.from_arrays([keys, grams.take(pa.array(places)), pa.array(weights / np.sqrt(weights @ weights))], [key, "gram", "weight"])

    return rows.select(key, "text").mapInArrow(run, f"`{key}` {kind}, gram string, weight double")


def scaler(features: DataFrame, by: list[str]) -> DataFrame:
    """by, feature, mean, sd: of features that vary (population variance over 1e-12)."""
    stats = features.groupBy(*by, "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return stats.where(F.col("sd") * F.col("sd") > 1e-12)


def scale(features: DataFrame, fitted: DataFrame, by: list[str]) -> DataFrame:
    """features with z in place of value; features that the scaler lacks are left out."""
    return features.join(fitted, [*by, "feature"]).withColumn("z", (F.col("value") - F.col("mean")) / F.col("sd")).drop("value", "mean", "sd")


def scale_within(features: DataFrame, by: list[str]) -> DataFrame:
    """z of every feature within each group of by; 0 where it does not vary."""
    w = Window.partitionBy(*by, "feature")
    sd = F.stddev_pop("value").over(w)
    return features.withColumn("z", F.when(sd > 0, (F.col("value") - F.avg("value").over(w)) / sd).otherwise(0.0))
