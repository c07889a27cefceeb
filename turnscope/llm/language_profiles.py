"""Language identification by rank-order profiles: the out-of-place distance of most frequent n-grams.

Texts are lower-cased; everything but letters separates words, and each word is framed by blanks. N-grams of one to
three code points fit 64 bits exactly. A profile lists the most frequent n-grams by rank, ties by code point; the
distance of a document to a language adds, over the document's own most frequent n-grams, how far each one's rank lies
from its rank in the profile, and the profile's length for those it lacks. The nearest language is the prediction and
``1 - distance / greatest possible distance`` the score; ties go to the language first in order.

Profiles are fitted on a bounded sample: of each language's labelled texts about ``FitOptions.texts``, by a hash of
the id, one text per id. Counting, ranking and summing happen on Spark; what reaches the driver are
``languages * grams`` rows. Every text is scored whole, a very long one in pieces of ``PIECE`` characters whose counts
are added, so memory follows the number of different n-grams.

Defined results: a null text, one without a letter, and any text where nothing was learned are ``und`` with score 0; a
text of which several rows tell is scored row by row; an id with several texts teaches with the least; a null doc_id
never teaches (it has no checksum) and is not held out; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnscope.llm.hashing import texts_of

FOLDS = 5
UNKNOWN = "und"
PIECE = 1 << 20
BITS = 21  # of a code point
BLANK = 1  # frames a word; no letter, and above zero, so that n-grams of different lengths are different numbers


@dataclass(frozen=True)
class FitOptions:
    texts: int = 1000  # expected number of texts per language to learn from
    grams: int = 400  # length of a profile, of languages and of documents
    seed: int = 13


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def summed(kinds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal kinds added; kinds in order."""
    kinds, place = np.unique(kinds, return_inverse=True)
    total = np.zeros(len(kinds), np.int64)
    np.add.at(total, place, counts)
    return kinds, total


def gram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of a whole text and how often each occurs. An n-gram belongs to the piece in which it ends."""
    codes = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
    before = np.full(2, BLANK, np.int64)
    found = []
    for start in range(0, len(codes) + 1, PIECE):  # one blank ends the text
        piece = np.append(codes[start:start + PIECE], [BLANK] * (start + PIECE > len(codes))).astype(np.int64)
        piece[~letters()[piece]] = BLANK
        body = np.concatenate([before, piece])
        a, b, c = body[:-2], body[1:-1], body[2:]
        two, inner = b << BITS | c, b != BLANK
        grams = np.concatenate([c[c != BLANK], two[inner | (c != BLANK)], (a << 2 * BITS | two)[inner]])
        found.append(np.unique(grams, return_counts=True))
        before = body[-2:]
    return found[0] if len(found) == 1 else summed(*(np.concatenate(x) for x in zip(*found)))


def most_frequent(kinds: np.ndarray, counts: np.ndarray, grams: int) -> np.ndarray:
    return kinds[np.argsort(-counts, kind="stable")[:grams]]


@dataclass(frozen=True)
class Profiles:
    """Ranks of every n-gram in every language's profile; ``grams`` stands for a missing one."""

    languages: list[str]
    grams: int
    kinds: np.ndarray
    ranks: np.ndarray

    @staticmethod
    def of(rows: list[tuple[str, int, int]], grams: int) -> Profiles:
        """From (language, n-gram, rank from 0)."""
        languages = sorted({r[0] for r in rows})
        kinds = np.unique(np.array([r[1] for r in rows], np.int64))
        ranks = np.full((len(kinds), len(languages)), grams, np.int64)
        for language, kind, rank in rows:
            ranks[np.searchsorted(kinds, kind), languages.index(language)] = rank
        return Profiles(languages, grams, kinds, ranks)

    def nearest(self, text: bytes) -> tuple[str, float]:
        """The language at the least out-of-place distance, and how near it is."""
        top = most_frequent(*gram_counts(text), self.grams)
        if not len(top) or not self.languages:
            return UNKNOWN, 0.0
        place = np.minimum(np.searchsorted(self.kinds, top), len(self.kinds) - 1)
        theirs = np.where((self.kinds[place] == top)[:, None], self.ranks[place], self.grams)
        apart = np.where(theirs == self.grams, self.grams, np.abs(theirs - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.languages[best], float(1 - apart[best] / (len(top) * self.grams))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def sample(documents: DataFrame, options: FitOptions) -> DataFrame:
    """lang, text: about ``texts`` texts of each language, chosen by a hash of the id; one per id."""
    labelled = documents.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).select("doc_id", "lang", "text")
    # a row per language, like the profiles themselves; a join by language would shuffle every text to find a few
    shares = [x for r in labelled.groupBy("lang").count().collect() for x in (F.lit(r["lang"]), F.lit(options.texts / r["count"]))]
    if not shares:
        return labelled.select("lang", "text")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(options.seed)), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.where(drawn < F.element_at(F.create_map(*shares), F.col("lang")))
    return chosen.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x")).select("x.lang", "x.text")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, n: counts of a batch's texts by language."""
    for batch in batches:
        by_language: dict[str, list] = {}
        for language, text in zip(batch["lang"].to_pylist(), texts_of(batch["text"])):
            by_language.setdefault(language, []).append(gram_counts(text))
        for language, found in by_language.items():
            kinds, counts = summed(*(np.concatenate(x) for x in zip(*found)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(kinds), pa.string()), pa.array(kinds), pa.array(counts)], names=["lang", "gram", "n"])


def fit(documents: DataFrame, options: FitOptions = FitOptions()) -> Profiles:
    """Profiles of every language that labels a document outside the held-out fold."""
    counts = sample(documents, options).mapInArrow(counted, "lang string, gram long, n long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    rows = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", rank).where(F.col("rank") < options.grams)
    return Profiles.of([tuple(r) for r in rows.select("lang", "gram", "rank").collect()], options.grams)


def identify(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; lang and source are not read."""
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.nearest(text) for text in texts_of(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = documents.select("doc_id", held_out().alias("held_out"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predicted, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(documents, fit(documents))
