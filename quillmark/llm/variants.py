"""Spelling variants: words whose anagram hashes differ by one letter, in the right order, follow the far more frequent one."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm._store import table, written

#: Runs of these letters are words; of fewer code points than LENGTH, or met less often than OFTEN, they are left out.
RUN, LENGTH, OFTEN = "[A-Za-zÀ-ÿ]+", 7, 2
#: A word follows a near word that is so many times as frequent.
TIMES = 10
#: A letter counts as this power of its code point; sums are taken modulo a prime.
POWER, MODULUS = 5, (1 << 61) - 1


def lower(text: Column) -> Column:
    """A-Z as a-z, other letters as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_counts(docs: DataFrame, garbled: int = 31) -> DataFrame:
    """word, n: the words of doc_id and text that have LENGTH code points or more and occur OFTEN or more.

    Of a run whose crc32 h of `<doc_id>:<run>` is a multiple of `garbled`, the code point h % length is left out first.
    Null texts and rows without doc_id have no words; repeated rows count again. Counts are added up before any shuffle.
    """
    runs = docs.where("doc_id is not null and text is not null").select("doc_id", F.explode(F.regexp_extract_all(lower(F.col("text")), F.lit(f"([a-zA-ZÀ-ÿ]{{{LENGTH},}})"), F.lit(1))).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    hashed = runs.select("run", F.length("run").alias("size"), h.alias("h"))
    at = (F.col("h") % F.col("size")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.col("size")))
    word = F.when(F.col("h") % garbled == 0, cut).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)


def letter_value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    out = code
    for _ in range(POWER - 1):
        out = out * code
    return out


def anagram_hash(letters: Column) -> Column:
    """The sum of the letters' values: the same for all orders of the same letters, and changed by a letter's value when it is added or taken."""
    return F.aggregate(letters, F.lit(0).cast("long"), lambda a, x: (a + letter_value(x)) % MODULUS)


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n, n of words (word, n) that one inserted, deleted or replaced code point turns into each other; both ways, once each.

    A word stands at its anagram hash and, for each letter that it has, at the hash less this letter's value. Two words
    whose hashes differ by the value of an added or removed letter, or of one letter exchanged for another, meet at the
    hash of the letters that they share. There they are joined only if they also share, in order, the first or the last
    half of these letters, which one changed letter cannot both break; so a hash that many anagrams share is split. The
    order of all letters is then compared (edit distance of 1). Null words match nothing; no words give no pairs.
    """
    letters = F.split("word", "")
    # written, since the variables of higher-order functions keep Spark from dealing out both sides of the join as one
    spelled = written(words.where("word is not null").select("word", "n", anagram_hash(letters).alias("hash")))
    stood = spelled.withColumn("letter", F.explode(F.concat(F.array(F.lit("")), F.array_distinct(letters)))).withColumn("hash", F.pmod(F.col("hash") - letter_value(F.col("letter")), F.lit(MODULUS)))
    sides = F.explode(F.array(F.lit(0), F.lit(1)))
    placed = stood.withColumn("side", sides).select(F.xxhash64("hash", "side", _half("word", "letter", F.col("side"))).alias("key"), "word", "n", "letter", "side")
    both = placed.alias("a").join(placed.alias("b"), F.expr("a.key = b.key and a.side = b.side and a.letter <> b.letter"))
    met = both.select("a.word", "a.n", "a.letter", "a.side", *(F.col(f"b.{c}").alias(f"near_{c}") for c in ("word", "n", "letter"))).where(F.levenshtein("word", "near_word", 1) == 1)
    # a key of 64 bits may stand for two things: the letters that it left out must be those that the words don't share
    has = lambda w, x: F.length(w) - F.length(F.replace(F.col(w), F.col(x)))
    lost = [(F.col(x) == "") | (has(w, x) == has(v, x) + 1) for w, v, x in (("word", "near_word", "letter"), ("near_word", "word", "near_letter"))]
    halves = [[_half(w, x, F.lit(side)) for w, x in (("word", "letter"), ("near_word", "near_letter"))] for side in (0, 1)]
    first = halves[0][0] == halves[0][1]
    once = met.where(lost[0] & lost[1]).where(F.when(F.col("side") == 0, first).otherwise((halves[1][0] == halves[1][1]) & ~first))
    return once.select("word", "n", F.col("near_word").alias("near"), "near_n")


def _half(word: str, letter: str, side: Column) -> Column:
    """The first (side 0) or last half of as many letters as word has without letter, where there is one."""
    left = F.length(word) - F.length(letter)
    half = F.floor(left / 2).cast("int")
    return F.when(side == 0, F.substring(word, F.lit(1), half)).otherwise(F.col(word).substr(F.length(word) - (left - half) + 1, left - half))


def spelling_variants(docs: DataFrame, garbled: int = 31) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of docs, as op13_spelling_variants states them.

    A form is at least TIMES as frequent as its word, so that forms of forms end after at most 18 steps; roots are found
    by doubling the steps over the words that have a form. Nulls as in word_counts; no words give no rows.
    """
    words = written(word_counts(docs, garbled))
    best = near_pairs(words).groupBy("word").agg(F.max("n").alias("own"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"), (-F.col("best.less") >= TIMES * F.col("own")).alias("follows"))
    follows = F.col("follows")
    told = written(told.withColumns({"form": F.when(follows, F.col("form")), "form_n": F.when(follows, F.col("form_n"))}).drop("follows"))
    steps = written(told.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = written(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    return told.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of all documents.

    Two words are near if one inserted, deleted or replaced code point turns one into the other. form is the near word of
    largest n (form_n; of equals the first in code-point order) if that is TIMES the word's n or more, root the last form
    that forms of forms lead to, or the word itself; n_near counts the near words.
    """
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: crc32 from a table of 256 entries made by rule; near words by what is left without one letter, and roots by recursion.
OP13_SQL = """
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents WHERE doc_id IS NOT NULL),
long AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
crcs AS (SELECT list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)), i) ORDER BY i) AS crcs FROM range(256) t(i)),
spelled AS (SELECT *, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)]::BIGINT[] END)) AS bytes FROM long),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(bytes, lambda crc, byte: xor(crc >> 8, crcs[(xor(crc, byte) & 255) + 1]), 4294967295::BIGINT)) AS h FROM spelled, crcs),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT DISTINCT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS t(p)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(near)) AS k FROM near),
told AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 10 * w.n THEN r.near END AS form, CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND k = 1),
chain(word, root) AS (SELECT word, word FROM told UNION SELECT c.word, t.form FROM chain c JOIN told t ON t.word = c.root WHERE t.form IS NOT NULL)
SELECT t.word, t.form, c.root, t.n, t.n_near, t.form_n FROM told t JOIN chain c USING (word) JOIN told l ON l.word = c.root AND l.form IS NULL
"""
