"""Benchmark decontamination by SimHash windows of the size of the items.

Windows slide over every whole text, in steps of an eighth of their size; their sizes form a ladder, and an item is
sought among windows of the rung nearest to its own size. A window's 64-bit SimHash over pairs of words is looked up by
multi-index Hamming search: cut into four blocks, two fingerprints within the radius agree in some block up to a
quarter of it, so tables of all block values that close find every item within the radius. Candidates are verified
exactly: windows of the item's own size around the place, weighted Jaccard of five-word shingles, best alignment.

Items are a query set: they are searched for in groups of bounded size, each shipped to the tasks as one index, so a
larger benchmark means more passes over the texts and no more memory. No text is shuffled. Shingles are weighed by
their uses in the whole benchmark, whatever the groups.

Words are compared in lower case without ASCII punctuation. Defined results: null texts are empty and match nothing;
items without words match nothing; a text shorter than an item is compared as a whole; repeated rows and repeated
items each give their own rows; other columns are kept by the filter and ignored by the search.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope.llm import hashing as H
from turnscope.session import materialize

LOWER = bytes(range(256)).lower()
BLOCK = 1 << 16  # bytes at a time: their bit counts stay in the processor's cache
PUNCTUATION = string.punctuation.encode()


@dataclass(frozen=True)
class SearchOptions:
    shingle: int = 5
    threshold: float = 0.8
    radius: int = 15
    ladder: float = 1.1  # ratio of neighbouring window sizes
    steps: int = 8  # windows that begin inside one window
    items_at_once: int = 4096


def plain(text: bytes) -> bytes:
    return text.translate(LOWER, PUNCTUATION)


def rung(words: int, options: SearchOptions) -> int:
    return round(np.log(max(words, 1)) / np.log(options.ladder))


def pair_bits(words: np.ndarray) -> np.ndarray:
    """Running counts of set bits over the hashes of neighbouring word pairs (one row more than pairs).

    They wrap around at 16 bits; differences over a window stay right.
    """
    mixed = H.mixed(words)
    pairs = H.mixed(mixed[:-1] * np.uint64(3) + mixed[1:], 5) if len(words) > 1 else mixed
    bits = np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(pairs) + 1, 64), np.uint16)
    np.cumsum(bits, axis=0, dtype=np.uint16, out=sums[1:])
    return sums


def fingerprints(ones: np.ndarray, pairs: np.ndarray | int) -> np.ndarray:
    """SimHash of windows from the number of set bits and the number of pairs."""
    half = np.asarray(pairs, np.uint16) // 2
    return np.packbits(ones > (half[:, None] if half.ndim else half), axis=1).view(np.uint64).ravel()


def near_values(blocks: np.ndarray, reach: int) -> np.ndarray:
    """For each 16-bit value all values within ``reach`` bits of it."""
    flips = [sum(1 << b for b in bits) for r in range(reach + 1) for bits in combinations(range(16), r)]
    return blocks[:, None] ^ np.array(flips, np.uint16)[None, :]


class Rung:
    """The items of one window size: block tables from values to items."""

    def __init__(self, size: int, items: list[int], prints: np.ndarray, options: SearchOptions):
        self.size, self.items, self.prints = size, np.array(items), prints
        self.tables = []
        for block in range(4):
            near = near_values(prints.view(np.uint16).reshape(-1, 4)[:, block], options.radius // 4)
            value, item = near.ravel(), np.repeat(np.arange(len(items)), near.shape[1])
            order = np.argsort(value, kind="stable")
            start = np.searchsorted(value[order], np.arange(65537))
            self.tables.append((start.astype(np.int32), item[order].astype(np.int32)))

    def search(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius."""
        found = []
        for block, (start, item) in enumerate(self.tables):
            value = prints.view(np.uint16).reshape(-1, 4)[:, block].astype(np.int64)
            first = start[value]
            count = start[value + 1] - first
            some = np.flatnonzero(count)
            if not len(some):
                continue
            count = count[some]
            window = np.repeat(some, count)
            base = np.repeat(first[some] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
            which = item[base + np.arange(len(window))]
            close = np.bitwise_count(prints[window] ^ self.prints[which]) <= radius
            found.append(window[close] * len(self.items) + which[close])
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return pairs // len(self.items), self.items[pairs % len(self.items)]


class ItemIndex:
    """Shingles with weights and the rungs of one group of items."""

    def __init__(self, texts: list[str | None], total: int, uses: dict[int, int] | None, options: SearchOptions):
        """``total`` items are in the benchmark, ``uses`` of them have a shingle; without it these are all items."""
        self.options = options
        words, begin = H.words_of([plain((t or "").encode()) for t in texts])
        self.sizes = np.diff(begin)
        per_item = [H.shingles(words[a:b], options.shingle) for a, b in zip(begin, begin[1:], strict=False)]
        if uses is None:
            uses = Counter(v for s in per_item for v in np.unique(s).tolist())
        self.top = float(np.log1p(total))
        weight = {v: float(np.log1p(total / n)) for v, n in uses.items()}
        self.shingles, self.counts, self.weights = [], [], []
        for s in per_item:
            values, counts = np.unique(s, return_counts=True)
            self.shingles.append(values)
            self.counts.append(counts)
            self.weights.append(np.array([weight[v] for v in values.tolist()]))
        ladder: dict[int, list[int]] = {}
        for i, n in enumerate(self.sizes):
            if n:
                ladder.setdefault(rung(int(n), options), []).append(i)
        self.rungs = []
        for step, items in sorted(ladder.items()):
            sums = [pair_bits(words[begin[i] : begin[i + 1]])[-1] for i in items]
            prints = fingerprints(np.array(sums), np.maximum(self.sizes[items] - 1, 1))
            self.rungs.append(Rung(max(1, round(options.ladder**step)), items, prints, options))

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, float]]:
        """(text, item, similarity) for the items found in a block of plain texts."""
        words, begin = H.words_of(texts)
        n = np.diff(begin)
        if not len(words):
            return
        sums = pair_bits(words)
        owner = np.repeat(np.arange(len(texts)), n)
        shingles = H.shingles(words, self.options.shingle)
        best: dict[tuple[int, int], float] = {}
        for r in self.rungs:
            places, prints = self._windows(r.size, sums, begin, owner)
            window, item = r.search(prints, self.options.radius)
            for w, i in zip(window.tolist(), item.tolist(), strict=True):
                text = int(owner[places[w]])
                value = self._verify(i, int(places[w]), int(begin[text]), int(begin[text + 1]), words, shingles)
                if value >= self.options.threshold - 1e-9:
                    best[text, i] = max(value, best.get((text, i), 0.0))
        for (text, i), value in sorted(best.items()):
            yield text, i, value

    def _windows(self, size: int, sums: np.ndarray, begin: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and fingerprints of the windows of one size: stepping, at both ends of each text, short texts whole."""
        n, pairs, step = np.diff(begin), max(size - 1, 1), max(1, size // self.options.steps)
        steps = np.arange(0, max(len(owner) - size + 1, 0), step)
        inside = owner[steps] == owner[steps + size - 1]
        ones = sums[pairs::step][: len(steps)] - sums[::step][: len(steps)]
        full = n >= size
        short = (n > 0) & ~full & (n >= self.options.threshold * size / self.options.ladder)
        places = np.concatenate((begin[:-1][full], begin[1:][full] - size, begin[:-1][short]))
        counts = np.maximum(np.concatenate((np.full(2 * full.sum(), size), n[short])) - 1, 1)
        ends = np.minimum(places + counts, len(sums) - 1)
        rest = fingerprints(sums[ends] - sums[places], counts)
        return np.concatenate((steps[inside], places)), np.concatenate((fingerprints(ones, pairs)[inside], rest))

    def _verify(self, item: int, place: int, low: int, high: int, words: np.ndarray, shingles: np.ndarray) -> float:
        """Best weighted Jaccard of windows of the item's size that begin within a window's step of the place."""
        size, k = int(self.sizes[item]), self.options.shingle
        size = min(size, high - low)
        slack = 2 * max(1, size // self.options.steps) + int(size * (self.options.ladder - 1)) + 1
        first, last = max(low, place - slack), min(high - size, place + slack)
        wanted, weights = self.shingles[item], self.weights[item]
        width = size - k + 1
        if width < 1:  # shorter than a shingle: one run of words, compared as a whole
            runs = H.range_hashes(H.mixed(words), np.arange(first, last + 1), np.arange(first, last + 1) + size)
            return 1.0 if len(wanted) == 1 and (runs == wanted[0]).any() else 0.0
        region = shingles[first : last + width]
        at = np.minimum(np.searchsorted(wanted, region), len(wanted) - 1)
        hit = wanted[at] == region
        if not hit.any():
            return 0.0
        weighed = np.where(hit, weights[at], 0.0)
        sums = np.concatenate(([0.0], np.cumsum(weighed)))
        total = float(weights @ self.counts[item])
        bound = sums[width:] - sums[:-width]  # no window shares more than this
        best = 0.0
        for o in np.flatnonzero(bound >= self.options.threshold * total - 1e-9):
            counts = np.bincount(at[o : o + width][hit[o : o + width]], minlength=len(wanted))
            shared = float(weights @ np.minimum(counts, self.counts[item]))
            there = float(weights @ counts) + self.top * (width - int(hit[o : o + width].sum()))
            best = max(best, shared / (total + there - shared))
        return best


def shingle_uses(items: DataFrame, place: Column, options: SearchOptions) -> DataFrame:
    """place, shingle and the number of items of the whole benchmark that have it."""
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, begin = H.words_of([plain(t) for t in H.texts_of(batch["text"])])
            once = [np.unique(H.shingles(words[a:b], options.shingle)) for a, b in zip(begin, begin[1:], strict=False)]
            if once:
                at = np.repeat(np.arange(len(once)), [len(s) for s in once])
                yield pa.RecordBatch.from_arrays(
                    [batch["place"].take(pa.array(at)), pa.array(np.concatenate(once).view(np.int64))], names=["place", "shingle"])

    had = items.select(place.alias("place"), "text").mapInArrow(shingles, "place long, shingle long")
    had = had.groupBy("place", "shingle").agg(F.count("*").alias("n"))
    total = had.groupBy("shingle").agg(F.sum("n").alias("uses"))
    return materialize(had.select("place", "shingle").join(total, "shingle"), "shingle-uses")


def item_groups(items: DataFrame, options: SearchOptions) -> Iterator[tuple[list, ItemIndex]]:
    """Ids and index of each group of about ``items_at_once`` items, one after the other."""
    total = items.count()
    groups = max(1, -(-total // options.items_at_once))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))
    known = shingle_uses(items, place, options) if groups > 1 else None
    for g in range(groups):
        rows = items.where(place == g).select("item_id", "text").collect()
        if rows:
            uses = {r.shingle & (1 << 64) - 1: r.uses for r in known.where(F.col("place") == g).collect()} if known else None
            yield [r.item_id for r in rows], ItemIndex([r.text for r in rows], total, uses, options)


def batch_matches(texts: pa.Array, index: ItemIndex) -> Iterator[tuple[int, int, float]]:
    for a, _, some in H.text_blocks(texts, BLOCK):
        for text, item, value in index.matches([plain(t) for t in some]):
            yield a + text, item, value


def find_items(docs: DataFrame, items: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """doc_id, item_id and similarity of every item found in a text."""
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double"
    found = docs.select("doc_id", F.lit(None).cast(kinds[1]).alias("item_id"), F.lit(0.0).alias("similarity")).where("false")
    for ids, index in item_groups(items, options):
        def search(batches: Iterator[pa.RecordBatch], ids: list = ids, index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(batch_matches(batch["text"], index))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array([r[0] for r in rows], pa.int64())),
                     pa.array([ids[r[1]] for r in rows], None if rows else pa.int64()),
                     pa.array([round(r[2], 9) for r in rows], pa.float64())], names=["doc_id", "item_id", "similarity"])

        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(lambda it, search=search: H.released(search(it)), schema))
    return found


def without_items(docs: DataFrame, items: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """The rows, with all their columns, in whose text no item is found."""
    for _, index in item_groups(items, options):
        def clean(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                stays[[text for text, _, _ in batch_matches(batch["text"], index)]] = False
                yield batch.filter(pa.array(stays))

        docs = docs.mapInArrow(lambda it, clean=clean: H.released(clean(it)), docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = materialize(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), "items")
    return find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), items)
