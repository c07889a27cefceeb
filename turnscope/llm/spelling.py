"""Spelling variant grouping: words that differ by one code point, found by sorting permuterm rotations.

A word ends with a terminator; its rotations begin at every place. Two words with one replaced code point share the
rotation that starts behind it up to that last code point, and a word with one code point less *is* that shared start.
So every rotation is posted without its last code point (the edited one is skipped) and once in full, and sorting by
the posted stem brings together exactly the words near each other. A group holds at most one word in full and one
word per letter, so groups are bounded by the alphabet and no pair is emitted: each member gets its count of
neighbours and the best of them. The skipped code point of an indel is the first of its run of equal ones, so that a
pair meets once.

Stems longer than ``WHOLE`` code points are replaced by two 64-bit hashes of their content, taken from prefix sums, so a
very long word costs time in proportion to its length. Rows carry the number of a word (its place in code-point order), not the word.

Defined results: a null text has no words, a null doc_id is the empty text in the checksum; an empty table has no
words; equal rows count each; ties among neighbours go to the smallest word; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope.llm.checksum_sql import TABLE as CRC_TABLE
from turnscope.llm.checksum_sql import crc32
from turnscope.llm.hashing import Sums, mixed
from turnscope.session import materialize

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_USES, FACTOR = 5, 3, 2
TYPO_EVERY = 97
MARK = "$"  # never part of a word
WHOLE = 64
ROWS = 20_000


def words_of(documents: DataFrame, min_chars: int = MIN_CHARS, typo_every: int | None = None) -> DataFrame:
    """One row per occurrence: word. Only A-Z are lower-cased; ``typo_every`` damages one in so many."""
    runs = documents.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"),
    ).where(F.length("run") >= min_chars)
    if not typo_every:
        return runs.select(F.col("run").alias("word"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    place = F.pmod(F.col("h"), F.length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    word = F.when(F.col("h") % typo_every == 0, damaged).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= min_chars)


def vocabulary(words: DataFrame, min_uses: int = MIN_USES) -> DataFrame:
    """no, word, n of the words used often enough; ``no`` grows in code-point order. Written once, so it stays."""
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_uses)
    return materialize(counted.orderBy("word").select(F.monotonically_increasing_id().alias("no"), "word", "n"), "words")


def stems(word: str) -> Iterator[tuple[str, bool, bool]]:
    """(stem, in full, first of its run): L + 1 rotations in full and L without the code point they end with."""
    size, twice = len(word), f"{word}{MARK}{word}"
    firsts = [i == 0 or word[i - 1] != word[i] for i in range(size)]
    if size < WHOLE:
        name = lambda start, length: twice[start:start + length]
    else:
        codes = mixed(np.frombuffer(twice.encode("utf-32-le"), np.uint32).astype(np.uint64))
        starts = np.arange(size + 1)
        digests = {length: [sums.of(starts, starts + length) for sums in (Sums(codes, 1), Sums(codes, 2))]
                   for length in (size, size + 1)}

        def name(start: int, length: int) -> str:
            if length <= WHOLE:
                return twice[start:start + length]
            a, b = digests[length]
            return f"{length}{MARK}{int(a[start]):016x}{int(b[start]):016x}"

    for i in range(size + 1):
        yield name(i, size + 1), True, False
    for i, first in enumerate(firsts):
        yield name(i + 1, size), False, first


def rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posted rotations of every word, a bounded number of rows at a time."""
    out: list[tuple] = []

    def taken() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))],
            names=["stem", "no", "less", "full", "first"])
        out.clear()
        return made

    for batch in batches:
        for no, word, n in zip(*(batch[c].to_pylist() for c in ("no", "word", "n"))):
            for stem, full, first in stems(word):
                out.append((stem, no, -n, full, first))
                if len(out) == ROWS:
                    yield taken()
    if out:
        yield taken()


def neighbours(words: DataFrame) -> DataFrame:
    """no, n_near, best (less: minus its uses, no) of every word with a near one."""
    posted = words.mapInArrow(rotations, "stem string, no long, less long, full boolean, first boolean")
    groups = posted.groupBy("stem").agg(
        F.array_sort(F.collect_list(F.struct("less", "no", "full", "first"))).alias("members")).where(F.size("members") > 1)
    near = lambda x: ((x["no"] != F.col("me.no")) & ~(x["full"] & F.col("me.full"))
                      & (~x["full"] | F.col("me.first")) & (~F.col("me.full") | x["first"]))
    found = groups.select(F.explode("members").alias("me"), "members").select(
        F.col("me.no").alias("no"), F.filter("members", near).alias("others")).where(F.size("others") > 0)
    best = F.col("others")[0]
    return found.select("no", F.size("others").alias("k"), F.struct(best["less"].alias("less"), best["no"].alias("no")).alias("best")
                        ).groupBy("no").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame, most: int) -> DataFrame:
    """no, root: where following ``form`` ends. A step at least doubles the uses, so paths are short and have no rings;
    pointers double in length with each round, which is written to the shared folder."""
    now = links.select("no", F.col("form_no").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(max(2.0, math.log(max(most, 2), FACTOR)))))):
        ahead = now.select(F.col("no").alias("root"), F.col("root").alias("further"))
        now = materialize(now.join(ahead, "root", "left").select("no", F.coalesce("further", "root").alias("root")), "roots")
    return now


def grouped(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (no, word, n)."""
    near = neighbours(words).select("no", "n_near", F.col("best.no").alias("best_no"), (-F.col("best.less")).alias("best_n"))
    is_form = F.col("best_n") >= FACTOR * F.col("n")
    own = materialize(words.join(near, "no", "left").select(
        "no", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best_no")).alias("form_no"),
        F.when(is_form, F.col("best_n")).alias("form_n")), "near")
    most = own.agg(F.max("n")).first()[0] or 0
    ends = roots(own.where("form_no IS NOT NULL"), most)
    named = own.select(F.col("no").alias("named_no"), F.col("word").alias("name"))
    form, root = (named.withColumnsRenamed({"named_no": f"{x}_no", "name": x}) for x in ("form", "root"))
    return (own.join(ends.select("no", F.col("root").alias("root_no")), "no", "left")
            .join(form, "form_no", "left").join(root, "root_no", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return grouped(vocabulary(words_of(documents, typo_every=TYPO_EVERY)))


SQL = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
uses AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= {MIN_CHARS} GROUP BY ALL),
summed AS (SELECT run, n, {crc32("id || ':' || run")} AS h FROM uses, crc_table),
typed AS (SELECT CASE WHEN h % {TYPO_EVERY} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(n) >= {MIN_USES}),
holes AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM words),
holed AS (SELECT word, n, left(word, i) || '*' || substr(word, i + 2) AS mask, left(word, i) || substr(word, i + 2) AS less FROM holes),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM holed a JOIN holed b USING (mask) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holed a JOIN words b ON a.less = b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN holed b ON b.less = a.word),
near AS (SELECT word, count(*) AS n_near, max(n) AS best_n FROM pairs GROUP BY word),
best AS (SELECT p.word, min(p.other) AS form, min(x.best_n) AS form_n, min(x.n_near) AS n_near
  FROM pairs p JOIN near x ON p.word = x.word AND p.n = x.best_n GROUP BY p.word),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= {FACTOR} * w.n THEN b.form END AS form,
  CASE WHEN b.form_n >= {FACTOR} * w.n THEN b.form_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
walk AS (SELECT word, word AS root, 0 AS hops FROM formed
  UNION ALL SELECT w.word, f.form, hops + 1 FROM walk w JOIN formed f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(root, hops) FROM walk w WHERE w.word = f.word) AS root, n, n_near, form_n FROM formed f
"""
