"""Exact similarity search inside a session.

The measure counts the characters of matching blocks, taken longest first. No index over runs of two or more
characters can find all matches at a threshold below 2/3: texts whose every second character agrees share no run and
still reach it. What always holds is that the blocks are a common subsequence. So texts are dealt into blocks of about
a thousand, a pair of blocks is one row, and inside it two bounds are computed for all pairs at once: characters in
common regardless of order, then the longest common subsequence, bit by bit in machine words. Only pairs that both
bounds admit reach the full measure; every other is proven below the threshold, so no match is lost.

No pair of texts is ever a row, and texts travel once per opposite block. Blocks of one session spread over all tasks.
"""

from __future__ import annotations

import difflib
import math
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnscope.functions import text as X

BUCKET_BASE = 1.25
BLOCK = 1024  # texts of a session that stay together
BINS = 64  # characters are told apart modulo this; merging some only loosens a bound
PAIRS = 16_384  # compared at once
SHORT = 1024  # characters of a text of a single pair that is bounded by its common subsequence


def bucket(c: str) -> Column:
    return F.floor(F.log(F.greatest(F.length(c), F.lit(1))) / math.log(BUCKET_BASE))


def reach(threshold: float) -> int:
    """How many length buckets apart two texts may lie and still be that similar."""
    return math.ceil(math.log((2 - threshold) / threshold) / math.log(BUCKET_BASE))


class Texts:
    """Texts as numbers: lengths, codes, counts per character, and on demand a bit mask per character."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % BINS
        owner = np.repeat(np.arange(len(texts)), self.lengths)
        self.counts = np.bincount(owner * BINS + self.codes, minlength=len(texts) * BINS).astype(np.int32).reshape(-1, BINS)

    def spread(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every character of some texts: its row, its place in the text, its code."""
        sizes = self.lengths[which]
        row = np.repeat(np.arange(len(which)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return row, at, self.codes[self.starts[which][row] + at]

    def padded(self, which: np.ndarray) -> np.ndarray:
        """Codes of some texts, one row each; BINS behind the end."""
        row, at, code = self.spread(which)
        out = np.full((len(which), max(1, self.lengths[which].max())), BINS, np.int64)
        out[row, at] = code
        return out

    def masks(self, which: np.ndarray) -> np.ndarray:
        """(word, text, character): where a character stands in each text; none stands behind the end."""
        row, at, code = self.spread(which)
        out = np.zeros((max(1, -(-int(self.lengths[which].max()) // 64)), len(which), BINS + 1), np.uint64)
        np.bitwise_or.at(out, (at >> 6, row, code), np.uint64(1) << (at & 63).astype(np.uint64))
        return out


def admitted(common: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    return 2.0 * common / np.maximum(sizes, 1) >= threshold


def in_common(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs a[i], b[j] have enough characters in common, in whatever order."""
    return admitted(np.minimum(a.counts[i], b.counts[j]).sum(axis=1), a.lengths[i] + b.lengths[j], threshold)


def common_subsequence(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a[i] and b[j], for all pairs at once.

    A bit of the running word is cleared for every character of b that ends a longer subsequence; one step per
    character of a is an addition whose carry runs along the words.
    """
    mine, i = np.unique(i, return_inverse=True)
    theirs, j = np.unique(j, return_inverse=True)
    codes, masks = a.padded(mine), b.masks(theirs)
    state = np.full((len(masks), len(i)), ~np.uint64(0))
    for step in codes.T:
        here = step[i]
        carry = np.zeros(len(i), np.uint64)
        for word, mask in zip(state, masks):
            hit = mask[j, here]
            low = word + (word & hit)
            total = low + carry
            carry = ((low < word) | (total < low)).astype(np.uint64)
            np.bitwise_or(total, word & ~hit, out=word)
    return 64 * len(masks) - np.bitwise_count(state).sum(axis=0, dtype=np.int64)


def bounded(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of the pairs a[i], b[j] that neither lengths nor the two bounds rule out."""
    fits = admitted(np.minimum(a.lengths[i], b.lengths[j]), a.lengths[i] + b.lengths[j], threshold)
    i, j = i[fits], j[fits]
    order = np.lexsort((a.lengths[i], b.lengths[j] // 64))  # texts of like size together
    for start in range(0, len(order), PAIRS):
        p, q = i[order[start:start + PAIRS]], j[order[start:start + PAIRS]]
        sizes = a.lengths[p] + b.lengths[q]
        fits = in_common(a, b, p, q, threshold)
        p, q, sizes = p[fits], q[fits], sizes[fits]
        if len(p):
            fits = admitted(common_subsequence(a, b, p, q), sizes, threshold)
            yield p[fits], q[fits]


def likely(a: Texts, b: Texts, allowed: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that neither bound rules out. ``allowed`` (a, b) says which may count at all."""
    step = max(1, 16 * PAIRS // max(1, len(b.texts)))
    for start in range(0, len(a.texts), step):
        i, j = np.nonzero(allowed[start:start + step])
        yield from bounded(a, b, start + i, j, threshold)


def together(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours (from, to) whose sizes sum to ``most`` at the most; a larger one stands alone."""
    start, held = 0, 0
    for at, size in enumerate(sizes.tolist()):
        if at > start and held + size > most:
            yield start, at
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def crossed(probes: np.ndarray, pool: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs inside rows that hold so many probes and entries each, a bounded number at a time.

    The texts of all rows stand one after the other; a row of many pairs is cut by its probes.
    """
    row = np.repeat(np.arange(len(probes)), probes)  # of each probe
    first = np.cumsum(pool) - pool
    for start, stop in together(pool[row], 16 * PAIRS):
        others = pool[row[start:stop]]
        i = np.repeat(np.arange(start, stop), others)
        within = np.arange(len(i)) - np.repeat(np.cumsum(others) - others, others)
        yield i, first[row[i]] + within


def surely_alike(other: str, own: str, threshold: float) -> bool:
    """Whether a common beginning or end alone reaches the threshold: the longest block is no shorter than it.

    Texts of 200 characters and more have frequent characters left out of the search for blocks, so nothing is sure there.
    """
    if len(other) >= 200:
        return False
    size = len(other) + len(own)
    return any(
        2.0 * len(os.path.commonprefix(pair)) / max(size, 1) >= threshold for pair in ([other, own], [other[::-1], own[::-1]]))


def common_characters(text: str, places: dict[str, int], size: int) -> int:
    """Length of the longest common subsequence of a text and another, of ``size`` characters, given as a whole number
    per character whose bits say where it stands."""
    every = (1 << size) - 1
    state = every
    for c in text:
        hit = state & places.get(c, 0)
        state = (state + hit | state - hit) & every
    return size - state.bit_count()


def resembles_any(text: str, others: Iterable[str], threshold: float) -> bool:
    """Whether any other text reaches the threshold, one after the other; the measure is taken where no bound decides.

    As in ``close_ratio``, long texts are bounded by their characters only.
    """
    places: dict[str, int] = {}
    if len(text) <= SHORT:
        for at, c in enumerate(text):
            places[c] = places.get(c, 0) | 1 << at
    for other in others:
        if text == other:
            return True
        size = len(text) + len(other)
        if 2.0 * min(len(text), len(other)) / size < threshold:
            continue
        matcher = difflib.SequenceMatcher(None, text)
        if max(len(text), len(other)) > SHORT:
            matcher.set_seq2(other)
            alike = X.reaches(matcher, threshold)
        elif 2.0 * common_characters(other, places, len(text)) / size < threshold:
            continue
        else:
            alike = surely_alike(other, text, threshold)
            if not alike:
                matcher.set_seq2(other)
                alike = matcher.ratio() >= threshold
        if alike:
            return True
    return False


class Measure:
    """The full measure, once per different pair of texts."""

    def __init__(self, threshold: float):
        self.threshold, self.known, self.matcher = threshold, {}, difflib.SequenceMatcher()

    def alike(self, a: Texts, b: Texts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        pairs = [(b.texts[q], a.texts[p]) for p, q in zip(i.tolist(), j.tolist())]
        last = None
        for other, own in sorted(set(pairs).difference(self.known)):
            sure = own == other or surely_alike(other, own, self.threshold)
            if not sure:
                if other != last:
                    self.matcher.set_seq2(other)
                    last = other
                self.matcher.set_seq1(own)
            self.known[other, own] = sure or self.matcher.ratio() >= self.threshold
        return np.array([self.known[pair] for pair in pairs], bool)


def close_ratio(a: str, b: str, threshold: float) -> Column:
    """The similarity of the two texts of a row; NULL where it lies below the threshold.

    A batch is bounded at once, and a pair of texts that many rows hold is measured once. Long texts are bounded by their
    characters only: a common subsequence costs their square, and so much memory for every short text beside them.
    """
    def ratios(left: pd.Series, right: pd.Series) -> pd.Series:
        place, pairs = pd.factorize(pd.Series(list(zip(left, right)), dtype=object))
        first, second = ([pair[side] for pair in pairs] for side in (0, 1))
        a, b = Texts(first), Texts(second)
        is_short = np.maximum(a.lengths, b.lengths) <= SHORT
        short, long = np.flatnonzero(is_short), np.flatnonzero(~is_short)
        kept = [long[in_common(a, b, long, long, threshold)], *(i for i, _ in bounded(a, b, short, short, threshold))]
        known = pd.array(np.zeros(len(pairs)), "Float64")
        for i in np.concatenate(kept).tolist():
            known[i] = X.ratio(*pairs[i])
        known[known < threshold] = None
        return pd.Series(known[place])

    return F.pandas_udf(ratios, T.DoubleType())(a, b)


HITS = pa.schema([("sid", pa.string()), ("a", pa.string()), ("upto", pa.int64()), ("hit_idx", pa.int64()), ("hits", pa.int64())])


def compared(
    threshold: float, early_only: bool, enough: int | None = None,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of two blocks to the probes with a hit: sid, a, upto, hit_idx, hits.

    The pairs of many small sessions are bounded at once; a bounded number of texts is taken at a time. A probe meets
    its entries from the earliest on, so with ``enough`` the first hit is still the earliest.
    """
    def hits_of(rows: pa.RecordBatch) -> pa.RecordBatch:
        probes, pool = rows["probes"], rows["pool"]
        n_probes, n_pool = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (probes, pool))
        probes, pool = probes.flatten(), pool.flatten()
        texts, upto = probes.field("a"), probes.field("upto").to_numpy(zero_copy_only=False)
        first = pool.field("first_idx").to_numpy(zero_copy_only=False)
        a, b = Texts(texts.to_pylist()), Texts(pool.field("b").to_pylist())
        measure = Measure(threshold)
        hit, hits = np.full(len(upto), np.iinfo(np.int64).max), np.zeros(len(upto), np.int64)
        for i, j in crossed(n_probes, n_pool):
            if early_only:
                seen = first[j] <= upto[i]
                i, j = i[seen], j[seen]
            kept = list(bounded(a, b, i, j, threshold))
            if not kept:
                continue
            p, q = (np.concatenate(x) for x in zip(*kept))
            order = np.lexsort((first[q], p))
            p, q = p[order], q[order]
            rank = np.arange(len(p)) - np.searchsorted(p, p)
            upto_rank, more = (len(p), 0) if enough is None else (enough, enough)
            while len(p):
                now = rank < upto_rank
                fits = now.copy()
                fits[now] = measure.alike(a, b, p[now], q[now])
                np.minimum.at(hit, p[fits], first[q[fits]])
                np.add.at(hits, p[fits], 1)
                left = ~now if enough is None else ~now & (hits[p] < enough)
                p, q, rank = p[left], q[left], rank[left]
                more *= 2
                upto_rank += more
        found = np.flatnonzero(hits)
        owner = np.repeat(np.arange(len(n_probes)), n_probes)[found]
        return pa.RecordBatch.from_arrays([
            rows["sid"].take(pa.array(owner)), texts.take(pa.array(found)), pa.array(upto[found], pa.int64()),
            pa.array(hit[found]), pa.array(hits[found])], schema=HITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(pc.list_value_length(batch[side]).to_numpy(zero_copy_only=False).astype(np.int64) for side in ("probes", "pool"))
            for start, stop in together(sizes, 16 * BLOCK):
                yield hits_of(batch.slice(start, stop - start))
    return run


def in_blocks(rows: DataFrame, parts: DataFrame, text: str, other: str, name: str) -> DataFrame:
    """Texts of a session as blocks, each once per block of the other side: sid, block, opposite, and the texts."""
    one = F.lit(1).cast("long")
    own, opposite = ("block", "opposite") if text == "a" else ("opposite", "block")
    dealt = rows.join(parts, "sid", "left").select(
        *rows.columns, F.pmod(F.xxhash64(text), F.coalesce(f"{text}_parts", one)).alias(own),
        F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(f"{other}_parts", one) - 1)).alias(opposite))
    # comparing costs far more than a block's bytes suggest, so the number of tasks is stated, not derived from bytes
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "sid", "block", "opposite").groupBy("sid", "block", "opposite").agg(
        F.collect_list(F.struct(*[c for c in rows.columns if c != "sid"])).alias(name))


def resemblance(
    probes: DataFrame, pool: DataFrame, threshold: float, early_only: bool, block: int = BLOCK, enough: int | None = None,
) -> DataFrame:
    """Per probe (sid, a, upto): ``hit_idx``, the earliest pool entry that equals or resembles it, and ``hits``, how
    many do. Probes without any are absent.

    probes: sid, a, upto (distinct); pool: sid, b, first_idx (distinct per sid, b). ``early_only`` looks no further
    than first_idx <= upto. Only sessions of more than ``block`` texts are cut. Who only asks for the earliest hit, or
    whether there are ``enough``, spares the comparisons after them: ``hits`` is then exact below that number only.
    """
    counted = probes.select("sid", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        pool.select("sid", F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy("sid").agg(
        *(F.greatest(F.ceil(F.sum(x) / block), F.lit(1)).cast("long").alias(f"{x}_parts") for x in "ab"))
    parts = counted.where("a_parts > 1 OR b_parts > 1")
    left = in_blocks(probes.where("a IS NOT NULL").select("sid", "a", "upto"), parts, "a", "b", "probes")
    right = in_blocks(pool.where("b IS NOT NULL").select("sid", "b", "first_idx"), parts, "b", "a", "pool")
    pairs = left.join(right, ["sid", "block", "opposite"]).select("sid", "probes", "pool")
    hits = pairs.mapInArrow(compared(threshold, early_only, enough), "sid string, a string, upto bigint, hit_idx bigint, hits bigint")
    return hits.groupBy("sid", "a", "upto").agg(F.min("hit_idx").alias("hit_idx"), F.sum("hits").alias("hits"))


def with_resemblance(
    rows: DataFrame, pool: DataFrame, threshold: float, early_only: bool = True, enough: int | None = None,
) -> DataFrame:
    """Rows (sid, a, upto, ...) with ``hit_idx`` and ``hits``, NULL where nothing resembles."""
    hits = resemblance(rows.select("sid", "a", "upto").distinct(), pool, threshold, early_only, enough=enough)
    return rows.join(hits, ["sid", "a", "upto"], "left")
