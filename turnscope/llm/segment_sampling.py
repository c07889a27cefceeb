"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k over the piece lattice.

Every segmentation of a text has a perturbed log probability: its own plus Gumbel noise. The k largest are a sample
without replacement. An A-star search finds them without listing the rest: the largest perturbed value of a whole
set of segmentations is itself a Gumbel around the log of the set's probability, cut off at the value of the set
it came from. So the agenda holds sets, the best one is popped, a segmentation is drawn from it, and what is left of
the set splits into sets by the piece at which they leave the drawn one. A value is exact, never a bound, so each pop
yields the next segmentation. The best value left in the agenda after k pops is the threshold of the inclusion scores:
``1 - exp(-exp(log_prob - threshold))``.

Random numbers depend on the row's key, the sample and the place in the text, not on batches or tasks, so reruns of
lost tasks agree.

Defined results: a null or empty text has one segmentation without pieces; a text with fewer than k segmentations
yields all of them, with inclusion 1; rows of equal key and text get equal samples; other columns are not read, and
no text is ever cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope.llm import hashing as H
from turnscope.llm.lattice import Lattice, Vocabulary, chunks_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
WORD = (1 << 64) - 1
BLOCK = 1 << 18  # text of one lattice; four times as much took 350 MB instead of 227 and no less time
U64 = np.uint64


@dataclass(frozen=True)
class SampleOptions:
    samples: int = 3
    smoothing: float = 1.0
    seed: int = 20


@dataclass
class Drawn:
    """One segmentation: its edges, running log probabilities, and the number of pieces per chunk."""

    edges: np.ndarray
    counts: np.ndarray
    value: float
    sums: np.ndarray = field(default_factory=lambda: np.zeros(1))


@dataclass
class Part:
    """A set of segmentations that leave ``drawn`` at a piece in [low, high), there by no excluded edge."""

    value: float
    drawn: Drawn
    low: int
    high: int
    excluded: tuple[int, ...] = ()


def cut_gumbel(mean: float, limit: float, u: float) -> float:
    """A Gumbel around ``mean``, given that it is below ``limit``."""
    a, b = mean - limit, math.log(-math.log(u))
    return mean - max(a, b) - math.log1p(math.exp(-abs(a - b)))


class TextSearch:
    """Agenda and results of one text."""

    def __init__(self, key: int, lattice: Lattice):
        self.key, self.lattice, self.draws = key, lattice, 0
        self.agenda: list[Part] = []
        self.found: list[Drawn] = []

    def number(self) -> float:
        self.draws += 1
        x = (self.key + self.draws * 0x9E3779B97F4A7C15) & WORD
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = ((x ^ (x >> 33)) * factor) & WORD
        return (((x ^ (x >> 33)) >> 11) + 0.5) * 2.0**-53

    def add(self, drawn: Drawn, first_new: int) -> None:
        """Takes a segmentation that differs from all earlier ones before piece ``first_new``."""
        drawn.sums = np.concatenate(([0.0], np.cumsum(self.lattice.logp[drawn.edges])))
        self.found.append(drawn)
        self.split(Part(drawn.value, drawn, first_new, len(drawn.edges)))

    def split(self, part: Part) -> None:
        """Gives a set its value, below the one it comes from, and puts it on the agenda unless it is empty."""
        mass = self.log_mass(part)
        if mass > -np.inf:
            part.value = cut_gumbel(mass, part.value, self.number())
            self.agenda.append(part)

    def log_mass(self, part: Part) -> float:
        sums = part.drawn.sums
        if part.low >= part.high:
            return -math.inf
        if part.excluded:
            left = sum(math.exp(self.lattice.logp[e]) for e in self.rest(part))
            return float(sums[part.low]) + math.log(left) if left > 0 else -math.inf
        gone = float(sums[part.high] - sums[part.low])
        return float(sums[part.low]) + math.log(-math.expm1(gone)) if gone < 0 else -math.inf

    def rest(self, part: Part) -> list[int]:
        at = self.lattice.start[part.drawn.edges[part.low]]
        edges = range(int(self.lattice.first[at]), int(self.lattice.first[at + 1]))
        return [e for e in edges if e not in part.excluded]

    def pop(self) -> tuple[Part, int, int] | None:
        """The best set, the piece at which its segmentation leaves the drawn one, and the edge by which it does."""
        if not self.agenda:
            return None
        part = max(self.agenda, key=lambda p: p.value)
        self.agenda.remove(part)
        at, excluded = part.low, part.excluded
        if not excluded:
            sums = part.drawn.sums[part.low : part.high + 1] - part.drawn.sums[part.low]
            target = math.log1p(self.number() * math.expm1(sums[-1]))
            at += min(int(np.searchsorted(-sums[1:], -target)), part.high - part.low - 1)
            while self.lattice.logp[part.drawn.edges[at]] == 0.0:  # no way to leave here; rounding led to it
                at -= 1
            excluded = (int(part.drawn.edges[at]),)
        rest = self.rest(Part(0.0, part.drawn, at, at + 1, excluded))
        share = np.cumsum(np.exp(self.lattice.logp[rest]))
        edge = rest[min(int(np.searchsorted(share, self.number() * share[-1])), len(rest) - 1)]
        if not part.excluded:
            self.split(Part(part.value, part.drawn, part.low, at))
            self.split(Part(part.value, part.drawn, at + 1, part.high))
        self.split(Part(part.value, part.drawn, at, at + 1, (*excluded, edge)))
        return part, at, edge


def sample_block(texts: list[bytes], keys: np.ndarray, vocabulary: Vocabulary, options: SampleOptions) -> list[tuple[list[Drawn], float, Lattice | None]]:
    """For every text its segmentations in the order of their values, and the threshold of inclusion."""
    kinds, kind, begin = chunks_of(texts)
    if not len(kind):
        return [([Drawn(np.empty(0, np.int64), np.empty(0, np.int64), 0.0)], -np.inf, None) for _ in texts]
    lattice = Lattice(kinds, vocabulary)
    owner = np.repeat(np.arange(len(texts)), np.diff(begin))
    inside = np.arange(len(kind)) - begin[owner]
    starts, ends = lattice.starts[kind], lattice.ends[kind]

    def place_keys(chunks: np.ndarray, turn: int) -> np.ndarray:
        return H.mixed(keys[owner[chunks]] ^ H.mixed(inside[chunks].astype(U64) * U64(64) + U64(turn), 13), 17)

    searches = [TextSearch(int(k), lattice) for k in keys]
    everything = np.arange(len(kind))
    edges, counts = lattice.walk(starts, ends, place_keys(everything, 0))
    cut = np.concatenate(([0], np.cumsum(counts)))
    for i, search in enumerate(searches):
        a, b = begin[i], begin[i + 1]
        top = -float(np.log(-np.log(search.number())))
        search.add(Drawn(edges[cut[a] : cut[b]], counts[a:b], top), 0)
    for turn in range(1, options.samples):
        popped = [(i, p) for i, search in enumerate(searches) if (p := search.pop())]
        if not popped:
            break
        # the rest of the chunk in which a text leaves its drawn segmentation, and all its later chunks, are sampled anew
        heads = [int(np.searchsorted(np.cumsum(part.drawn.counts), at, "right")) + int(begin[i]) for i, (part, at, _) in popped]
        chunks = np.concatenate([np.arange(h, begin[i + 1]) for h, (i, _) in zip(heads, popped, strict=True)])
        sizes = np.array([begin[i + 1] - h for h, (i, _) in zip(heads, popped, strict=True)])
        offsets = np.cumsum(sizes) - sizes
        position = starts[chunks].copy()
        # an edge belongs to the lattice of its chunk's kind, so its end is a position there
        position[offsets] = lattice.end[[edge for _, (_, _, edge) in popped]]
        edges, counts = lattice.walk(position, ends[chunks], place_keys(chunks, turn))
        cut = np.concatenate(([0], np.cumsum(counts)))
        for (i, (part, at, edge)), head, offset, size in zip(popped, heads, offsets, sizes, strict=True):
            old, local = part.drawn, head - int(begin[i])
            before = int(old.counts[:local].sum())
            fresh = counts[offset : offset + size].copy()
            fresh[0] += at - before + 1
            new = np.concatenate((old.edges[:at], [edge], edges[cut[offset] : cut[offset + size]]))
            searches[i].add(Drawn(new, np.concatenate((old.counts[:local], fresh)), part.value), at + 1)
    return [(s.found, max((p.value for p in s.agenda), default=-np.inf), lattice) for s in searches]


SAMPLE = "rank int, ids array<int>, log_prob double, perturbed double, inclusion double"


def sample(docs: DataFrame, vocabulary: Vocabulary, options: SampleOptions = SampleOptions(), read_back: bool = False) -> DataFrame:
    """doc_id, rank (from 1), ids, log probability, perturbed value and inclusion score of every drawn segmentation.

    ``read_back`` adds the decoded text in the same pass over the data.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["key"].to_numpy().view(U64)
            for a, b, texts in H.text_blocks(batch["text"], BLOCK):
                row, rank, ids, logs, values, shares = [], [], [], [], [], []
                for i, (found, threshold, lattice) in enumerate(sample_block(texts, keys[a:b], vocabulary, options)):
                    for r, drawn in enumerate(found, 1):
                        row.append(a + i)
                        rank.append(r)
                        ids.append(lattice.piece[drawn.edges] if lattice else np.empty(0, np.int32))
                        logs.append(float(drawn.sums[-1]))
                        values.append(drawn.value)
                        shares.append(1.0 if threshold == -np.inf else -float(np.expm1(-np.exp(logs[-1] - threshold))))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                columns = {
                    "doc_id": batch["doc_id"].take(pa.array(row, pa.int64())), "rank": pa.array(rank, pa.int32()),
                    "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32())),
                    "log_prob": pa.array(logs), "perturbed": pa.array(values), "inclusion": pa.array(shares),
                }
                if read_back:
                    columns["decoded"] = pa.array([text_of(x, vocabulary) for x in ids], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select("doc_id", "text", F.xxhash64(F.lit(options.seed), F.col("doc_id")).alias("key"))
    return rows.mapInArrow(lambda it: H.released(encode(it)), f"doc_id {kind}, {SAMPLE}" + ", decoded string" * read_back)


def text_of(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    return vocabulary.spelled(ids).removeprefix(b" ").decode(errors="replace")


def decode(samples: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The rows with the text that their ids spell; null ids give null."""
    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, out = batch["ids"], []
            offsets, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i, ok in enumerate(lists.is_valid().to_pylist()):
                out.append(text_of(ids[offsets[i] : offsets[i + 1]], vocabulary) if ok else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema)
    return samples.mapInArrow(back, f"{types}, decoded string")


def sampled(docs: DataFrame, vocabulary: Vocabulary, options: SampleOptions) -> DataFrame:
    """Samples with a digest of the ids and of the text that they spell."""
    rows = sample(docs, vocabulary, options, read_back=True)
    return rows.select(
        "doc_id", "rank", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        "log_prob", "perturbed", "inclusion", F.md5("decoded").alias("decoded_md5"))


def op9_segment_sampling(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    options = SampleOptions()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sampled(docs, Vocabulary.load(model, options.smoothing), options)
