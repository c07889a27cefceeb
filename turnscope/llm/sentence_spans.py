"""Substring dedup by sliding sentence spans.

From every sentence two runs of several consecutive sentences are hashed: the shortest that begins with it and the
shortest that ends with it, of at least ``MIN_SENTENCES`` sentences and ``MIN_WORDS`` words. So inside a repeated
passage every sentence belongs to runs that repeat with it. A sentence of more than ``LONG_WORDS`` words is a run alone,
and so is one of ``MIN_WORDS`` words that is a whole text. Runs are joined over the whole corpus; where one occurs
again, the first occurrence in the order of (id, text hash, position) stays and the sentences of all others are removed.

First the hashes alone are counted; only occurrences of repeated ones are joined, with a second, independent hash.
Counts and first occurrences are combined before their shuffles, so a passage that a third of all documents
share meets in no single task.

Defined results: a null text stays null and has no sentences; rows of equal id and text are one document and get
equal results; a run that repeats inside one text counts, its later occurrence goes; documents without enough
sentences or words keep everything; empty tables give no rows; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope.llm import hashing as H
from turnscope.session import materialize

MIN_SENTENCES = 2
MIN_WORDS = 20
LONG_WORDS = 50
STOPS = np.zeros(256, bool)
STOPS[[ord("."), ord("!"), ord("?")]] = True
WIDE = [c.encode() for c in "。｡！？।॥۔؟։።။។"]  # these need no blank behind them
WIDE_CODES = np.array([int.from_bytes(c.ljust(3, b"\0")) for c in WIDE])
WIDE_LEADS = np.zeros(256, bool)
WIDE_LEADS[[c[0] for c in WIDE]] = True


def wide_stops(body: np.ndarray) -> np.ndarray:
    """Last bytes of the stops beyond ASCII, of several in a row those of the last."""
    first = np.flatnonzero(WIDE_LEADS[body])
    a, b, c = (body[np.minimum(first + k, len(body) - 1)].astype(np.int64) for k in range(3))
    size = np.where(a >= 0xE0, 3, 2)
    stop = np.isin(a << 16 | b << 8 | np.where(size == 3, c, 0), WIDE_CODES)
    first, after = first[stop], (first + size)[stop]
    return after[~np.isin(after, first)] - 1


def word_starts(body: np.ndarray, sentences: np.ndarray) -> np.ndarray:
    """Where words begin: behind blanks, with a sentence, and with every Chinese or Japanese character."""
    begin = np.concatenate(([True], H.SPACE[body[:-1]])) & ~H.SPACE[body]
    begin |= (body >= 0xE4) & (body <= 0xE9)
    begin[:-1] |= (body[:-1] == 0xE3) & (body[1:] > 0x80)
    begin[sentences] = True
    return begin


def sentence_ranges(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the sentences of a block, without blanks around them.

    A sentence ends at a newline, at a stop before a blank, or at a stop beyond ASCII.
    """
    blank = H.SPACE[body]
    ends = body == 0x0A
    ends[:-1] |= STOPS[body[:-1]] & blank[1:]
    ends[wide_stops(body)] = True
    limits = np.flatnonzero(ends) + 1  # the block ends with a newline
    solid = np.flatnonzero(~blank)
    if not len(solid):
        return solid, solid
    first = np.searchsorted(solid, np.concatenate(([0], limits[:-1])))
    last = np.searchsorted(solid, limits)
    some = last > first
    return solid[first[some]], solid[last[some] - 1] + 1


def runs(words: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs (first, end) over sentences with these numbers of words, each inside one document."""
    n = len(words)
    total = np.concatenate(([0], np.cumsum(words)))
    at = np.arange(n)
    limit = np.searchsorted(document, document, "right")  # where the sentence's document ends
    floor = np.searchsorted(document, document, "left")
    end = np.maximum(np.searchsorted(total, total[at] + MIN_WORDS), at + MIN_SENTENCES)
    start = np.minimum(np.searchsorted(total, total[at + 1] - MIN_WORDS, "right") - 1, at + 1 - MIN_SENTENCES)
    ahead, back = end <= limit, start >= floor
    alone = at[(words > LONG_WORDS) | ((limit - floor == 1) & (words >= MIN_WORDS))]
    pairs = np.unique(np.concatenate((
        at[ahead] * (n + 1) + end[ahead], start[back] * (n + 1) + at[back] + 1, alone * (n + 1) + alone + 1)))
    return pairs // (n + 1), pairs % (n + 1)


def block_runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """text number, first and end sentence (counted in the text), and two hashes of every run of a block."""
    body, offsets = H.joined(texts)
    starts, ends = sentence_ranges(body)
    document = np.searchsorted(offsets, starts, "right") - 1
    begun = np.concatenate(([0], np.cumsum(word_starts(body, starts))))
    first, end = runs(begun[ends] - begun[starts], document)
    values = H.BYTE_VALUES[body]
    keys = [H.range_hashes(H.mixed(H.range_hashes(values, starts, ends, s), s), first, end, s) for s in (1, 2)]
    zero = np.searchsorted(document, document[first]) if len(first) else first
    return document[first] if len(first) else first, first - zero, end - zero, keys[0], keys[1]


def run_batches(batches: Iterator[pa.RecordBatch], with_places: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = H.texts_of(batch["text"])
        for a, b in H.blocks(texts):
            document, first, end, key, check = block_runs(texts[a:b])
            columns = {"key": key.view(np.int64)}
            if with_places:
                at = pa.array(document + a)
                columns = {"id": batch["id"].take(at), "page": batch["page"].take(at), "at": (first << 32) | end} | columns | {"check": check.view(np.int64)}
            yield pa.RecordBatch.from_pydict(columns)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """id, page and the runs of sentences (first << 32 | end) that go from it."""
    read = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("page"), "text").where(F.col("text").isNotNull())
    id_type = read.schema["id"].dataType.simpleString()
    keys = read.select("text").mapInArrow(lambda it: run_batches(it, False), "key long")
    twice = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated-runs")
    places = read.mapInArrow(
        lambda it: run_batches(it, True), f"id {id_type}, page long, at long, key long, check long")
    # nothing else may ask for rows by key here, or Spark could not split a hot key's join
    found = materialize(places.join(twice, "key"), "run-places")
    # written, for the same reason
    first = materialize(found.groupBy("key", "check").agg(F.min(F.struct("id", "page", "at")).alias("first")), "run-firsts")
    again = found.join(first, ["key", "check"]).where(~F.struct("id", "page", "at").eqNullSafe(F.col("first")))
    return again.groupBy("id", "page").agg(F.collect_set("at").alias("gone"))


def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the sentences of their spans, with the blanks that follow these."""
    for batch in batches:
        cut, counts, removed = [], [], []
        for text, gone in zip(batch["text"].to_pylist(), batch["gone"].to_pylist(), strict=True):
            raw = (text or "").encode()
            body, _ = H.joined([raw])
            starts, ends = sentence_ranges(body)
            drop = np.zeros(len(starts) + 1, np.int64)
            for at in gone or ():
                drop[at >> 32] += 1
                drop[at & 0xFFFFFFFF] -= 1
            drop = np.cumsum(drop)[:-1] > 0
            if drop.any():
                until = np.append(starts[1:], len(raw))
                mask = np.ones(len(raw), bool)
                for s, e in zip(starts[drop], until[drop], strict=True):
                    mask[s:e] = False
                text = body[: len(raw)][mask].tobytes().decode()
            cut.append(text)
            counts.append(len(starts))
            removed.append(int(drop.sum()))
        rest = [batch[c] for c in batch.schema.names if c not in ("text", "gone")]
        names = [c for c in batch.schema.names if c not in ("text", "gone")]
        yield pa.RecordBatch.from_arrays(
            [*rest, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(cut, pa.string())],
            names=[*names, "n_sentences", "n_removed", "text"])


def dedup_spans(docs: DataFrame) -> DataFrame:
    """doc_id, number of sentences, number removed, and the text that stays, for every row."""
    gone = materialize(repeated_spans(docs), "repeated-spans").withColumnsRenamed({"id": "_id", "page": "_page"})
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("page"))
    both = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("page") == F.col("_page")), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.select("doc_id", "text", "gone").mapInArrow(
        cut_batches, f"doc_id {kind}, n_sentences long, n_removed long, text string")


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
