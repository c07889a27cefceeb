"""Line dedup by site-relative frequency: a line that stands on a large share of its host's pages is boilerplate.

Pages per host and pages per (host, line) are counted over all documents; lines over the ratio are dropped from every
page of that host and from no other. A line is compared without blanks around it; blank lines always stay.

The lines of one host that exceed the ratio number at most its mean number of different lines per page divided by the
ratio, however large the host is, so a host's list fits in a row. Counts are combined before every shuffle; pages of
a large host are only ever on the side of a join that Spark can split.

In the pipeline each different text of a host is one page, so that exact copies do not make their own lines
boilerplate: they are left whole to the near-duplicate stage.

Defined results: a null text stays null and has no lines; a null host is a host of its own; every row is a page, also
a repeated one, unless ``once``; hosts with fewer than ``min_pages`` pages that share a line lose none; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope.session import materialize

RATIO = 0.05
MIN_PAGES = 5
BLANKS = " \t\r"


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def boilerplate(docs: DataFrame, host: str, ratio: float, min_pages: int) -> DataFrame:
    """host and the keys of its boilerplate lines, for hosts that have any."""
    lines = F.array_distinct(F.transform(F.split("text", "\n"), stripped))
    seen = docs.select(F.col(host).alias("host"), F.explode(F.array_remove(lines, "")).alias("line"))
    counts = seen.groupBy("host", F.md5("line").alias("key")).agg(F.count("*").alias("pages"))
    totals = docs.groupBy(F.col(host).alias("of")).agg(F.count("*").alias("total"))
    over = counts.where(F.col("pages") >= min_pages).join(totals, F.col("host").eqNullSafe(F.col("of")))
    return over.where(F.col("pages") > ratio * F.col("total")).groupBy("host").agg(F.collect_list("key").alias("keys"))


def different(docs: DataFrame, host: str) -> DataFrame:
    """Each different text of a host once; a null text is one."""
    return docs.groupBy(F.col(host), F.md5("text")).agg(F.first("text").alias("text")).select(host, "text")


def dedup_lines(
    docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, once: bool = False,
) -> DataFrame:
    """All rows: their columns as ``row``, the text without boilerplate, the number of lines and of those dropped.

    ``once``: equal texts of a host are one page.
    """
    pages = different(docs, host) if once else docs
    # written first: its measured size, not a guess, decides how it is joined
    lists = materialize(boilerplate(pages, host, ratio, min_pages), "boilerplate")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(host).alias("_host"))
    both = rows.join(lists, F.col("_host").eqNullSafe(F.col("host")), "left")
    lines = F.split("row.text", "\n")
    kept = F.when(F.col("keys").isNull(), lines).otherwise(F.filter(
        lines, lambda x: (stripped(x) == "") | ~F.array_contains("keys", F.md5(stripped(x)))))
    cut = both.select("row", F.size(lines).alias("n"), kept.alias("kept"))
    return cut.select(
        "row", F.array_join("kept", "\n").alias("text"), F.coalesce(F.greatest("n", F.lit(0)), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.col("n") - F.size("kept")).cast("long").alias("n_dropped"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "text")


SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM lines),
counts AS (SELECT source, k, count(DISTINCT doc_id) AS pages FROM keyed WHERE k <> '' GROUP BY source, k),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
bad AS (
  SELECT c.source, c.k FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE pages >= {MIN_PAGES} AND pages > {RATIO} * total
), marked AS (
  SELECT l.*, b.k IS NOT NULL AS gone FROM keyed l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.k = b.k
), done AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, x.text
FROM documents d LEFT JOIN done x ON d.doc_id = x.doc_id
"""


def without_boilerplate(docs: DataFrame) -> DataFrame:
    """The rows with the columns they came with; the text is cut, and its length follows it."""
    cut = dedup_lines(docs, once=True)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": F.col("text")}
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
