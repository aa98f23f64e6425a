"""Line dedup: globally repeated chunks of lines, cut where a rolling hash over line hashes says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm._store import table

#: About one line in SPREAD ends a chunk, where the rolling hash over a line and the two before it says so.
SPREAD = 4
#: Factors of the hashes of the line before the last, the last and this one, and the prime that sums are taken modulo.
FACTORS, MODULUS = (1103515245, 1664525, 69069), 2147483647


def _line_hash(line: Column) -> Column:
    """The first 28 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def chunks_of(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with the column chunks, an array of (n, body): a chunk's number of lines, and its lines joined by newlines; none of a null text.

    A chunk ends after a line whose rolling hash is 0 modulo SPREAD; the hash sees three lines only, so that inserted
    lines shift no boundary beyond. Equal neighbouring lines are a run, which the hash does not cut: it begins and ends
    chunks, and is cut into pairs (an odd one ends in three), so that runs of any length share chunks. Of boundaries one
    line apart the last stays, and the first line of several ends no chunk: a chunk has two lines or is a text of one
    line. An empty text is one empty line.
    """
    at = F.col("__h")
    lines = docs.withColumn("__lines", F.split(column, "\n"))
    hashed = lines.withColumn("__h", F.transform("__lines", _line_hash)).withColumn("__n", F.size("__lines"))
    # places count from 1, as chunk ends do; what is beyond the text is null, and equals nothing
    of = lambda i: F.get(at, (i - 1).cast("int"))
    same = lambda i: F.coalesce((i > 1) & (of(i) == of(i - 1)), F.lit(False))
    a, b, c = FACTORS
    before = lambda i, k: F.when(i > k, of(i - k)).otherwise(0)
    rolled = lambda i: (before(i, 2) * a + before(i, 1) * b + of(i) * c) % MODULUS % SPREAD == 0
    places = F.sequence(F.lit(1), F.col("__n"))
    placed = hashed.withColumns({"__cuts": F.filter(places, lambda i: ~same(i) & ~same(i + 1) & rolled(i)), "__begin": F.filter(places, lambda i: same(i + 1) & ~same(i)), "__stop": F.filter(places, lambda i: same(i) & ~same(i + 1))})

    def run_ends(x: Column) -> Column:
        pairs = F.floor((x.b - x.a + 1) / 2).cast("int")
        inner = F.transform(F.sequence(F.lit(1), pairs), lambda k: F.when(k < pairs, x.a + 2 * k - 1).otherwise(x.b))
        return F.concat(F.when(x.a > 1, F.array(x.a - 1)).otherwise(F.array().cast("array<int>")), inner)

    runs = F.zip_with("__begin", "__stop", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    ended = placed.withColumn("__all", F.array_sort(F.array_distinct(F.concat("__cuts", F.flatten(F.transform(runs, run_ends)), F.array("__n")))))
    kept = F.filter("__all", lambda x, i: (x == F.col("__n")) | ((x > 1) & (F.get("__all", i + 1) > x + 1)))
    ended = ended.withColumn("__ends", kept)
    starts = F.concat(F.array(F.lit(0)), F.slice("__ends", 1, F.size("__ends") - 1))
    both = ended.withColumn("__both", F.zip_with(starts, "__ends", lambda a, b: F.struct(a.alias("a"), (b - a).alias("n"))))
    chunk = lambda x: F.struct(x.n.alias("n"), F.array_join(F.slice("__lines", x.a + 1, x.n), "\n").alias("body"))
    chunks = F.coalesce(F.transform("__both", chunk), F.array().cast("array<struct<n:int,body:string>>"))
    # always true, but not to the optimizer, which else copies all of this into filters that it pushes to the scan
    chunks = F.when(F.monotonically_increasing_id() >= 0, chunks)
    return both.withColumn("chunks", chunks).drop("__lines", "__h", "__n", "__cuts", "__begin", "__stop", "__all", "__ends", "__both")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The columns of docs without repeated chunks in text (n_chars, if there, follows), and n_lines and n_removed.

    Of equal chunks anywhere in docs (of several lines, or texts of one that is not empty), the first (by doc_id, then
    place) stays: a later copy of a text loses all of it. Chunks are grouped
    by SHA-256, and a group is thinned only once the bytes of all its chunks were compared, each task passing on one copy
    of a chunk however often it has it. The lines left are joined by newlines; a
    text all of whose lines go becomes empty. Null texts stay null with no lines, an empty text is one empty line. A row
    without doc_id neither loses nor matches chunks. Rows of equal doc_id are one document in several texts:
    of two chunks at the same place neither goes, and each text loses only chunks of its own.
    Columns of docs named n_lines, n_removed or with two leading underscores are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*names)
    docs = docs.withColumn("__tag", F.md5("text"))
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "__tag", "text")
    # outer, since an inner explode would filter by the size of the array and compute all of it once more
    numbered = chunks_of(texts).select("doc_id", "__tag", F.posexplode_outer("chunks").alias("pos", "chunk")).where((F.col("chunk.n") > 1) | (F.col("chunk.body") != ""))
    rows = numbered.select("doc_id", "__tag", "pos", F.unhex(F.sha2("chunk.body", 256)).alias("digest"), F.col("chunk.body").alias("body"))
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"), F.collect_set("body").alias("bodies"))
    first = groups.where((F.col("n") > 1) & (F.size("bodies") == 1)).select("digest", "first")
    doubles = rows.drop("body").join(first, "digest").where("struct(doc_id, pos) > first")
    gone = doubles.groupBy("doc_id", "__tag").agg(F.collect_set("pos").alias("__gone"))
    marked = chunks_of(docs.join(gone, ["doc_id", "__tag"], "left").select(*docs.columns, "__gone"))
    marked = marked.withColumn("__pos", F.coalesce("__gone", F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("chunks") - 1), "__pos")
    text = F.when(F.size("__pos") == 0, F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("chunks", i)["body"]), "\n"))
    lines = F.coalesce(F.aggregate("chunks", F.lit(0).cast("long"), lambda n, x: n + x.n), F.lit(0).cast("long"))
    removed = F.aggregate(F.array_distinct("__pos"), F.lit(0).cast("long"), lambda n, i: n + F.coalesce(F.get("chunks", i)["n"], F.lit(0)))
    out = marked.withColumns({"__text": text, "n_lines": lines, "n_removed": removed})
    new = {"text": F.col("__text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("__text").cast(dict(docs.dtypes).get("n_chars", "long"))).otherwise(F.col("n_chars") if "n_chars" in names else None)}
    return out.select(*(new[c].alias(c) if c in new else c for c in names), "n_lines", "n_removed")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 of every document, by dedup_lines."""
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = """
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS lines, len(string_split(text, chr(10))) AS size FROM documents WHERE text IS NOT NULL),
hashed AS (SELECT *, list_transform(lines, lambda x: ('0x' || left(md5(x), 7))::BIGINT) AS h FROM lines),
same AS (SELECT *, list_transform(range(1, size + 2), lambda i: i > 1 AND i <= size AND h[i] = h[i - 1]) AS same FROM hashed),
cuts AS (SELECT *, list_filter(range(1, size + 1), lambda i: NOT same[i] AND NOT same[i + 1]
    AND (CASE WHEN i > 2 THEN h[i - 2] ELSE 0 END * 1103515245 + CASE WHEN i > 1 THEN h[i - 1] ELSE 0 END * 1664525 + h[i] * 69069) % 2147483647 % 4 = 0) AS cuts,
  list_zip(list_filter(range(1, size + 1), lambda i: same[i + 1] AND NOT same[i]), list_filter(range(1, size + 1), lambda i: same[i] AND NOT same[i + 1])) AS runs FROM same),
every AS (SELECT *, list_sort(list_distinct(list_concat(cuts, [size], flatten(list_transform(runs, lambda z: list_concat(CASE WHEN z[1] > 1 THEN [z[1] - 1] ELSE [] END,
  list_transform(range(1, (z[2] - z[1] + 1) // 2 + 1), lambda k: CASE WHEN k < (z[2] - z[1] + 1) // 2 THEN z[1] + 2 * k - 1 ELSE z[2] END))))))) AS every FROM cuts),
cut AS (SELECT *, list_filter(every, lambda x: x = size OR (x > 1 AND NOT list_contains(every, x + 1))) AS ends FROM every),
placed AS (SELECT doc_id, lines, unnest(list_zip(list_concat([0], ends[:-2]), ends)) AS z, generate_subscripts(ends, 1) AS pos FROM cut),
chunks AS (SELECT doc_id, pos, z[2] - z[1] AS n, array_to_string(lines[z[1] + 1 : z[2]], chr(10)) AS body FROM placed),
ranked AS (SELECT *, body <> '' AND row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) > 1 AS gone FROM chunks),
kept AS (SELECT doc_id, sum(n) AS n_lines, coalesce(sum(n) FILTER (gone), 0) AS n_removed, coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM ranked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
