"""Quality classifier: a byte-level convolutional network in numpy.

A text is read as bytes, whole, in overlapping chunks of two segments. Learned filters of six bytes slide over it; each
chunk keeps the maximum of each filter. The maxima over all chunks and their mean over the chunks are
combined by one logistic unit into the probability that the label is 1.

The network is fitted on at most about ``max_rows`` labelled texts, drawn by a hash of the id, of ``max_bytes`` together,
by Adam on mini-batches; gradients flow through the positions of the maxima only. Scoring is one pass over the texts without a shuffle; pairs
of bytes are looked up in folded filter tables.

Defined results: a null or empty text is one chunk of padding; labels that are null, or have no document, are
ignored; without labels the score is 0.5 everywhere; repeated rows get equal scores; of rows that share an id one text
teaches, that of the least hash; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope.llm import hashing as H
from turnscope.session import materialize

WIDTH = 6  # bytes a filter sees
SEGMENT = 256  # a chunk is two neighbouring segments
THRESHOLD = 0.3


@dataclass(frozen=True)
class FitOptions:
    max_rows: int = 6_000
    max_bytes: int = 256_000_000  # of whole texts on the driver; in the order of the ids' hashes those that fit teach
    filters: int = 16
    epochs: int = 14
    batch: int = 32
    rate: float = 0.008
    seed: int = 7


@dataclass
class Network:
    """``tables``: the filters, width x 256 x filters, the response of each filter to each byte at each place."""

    tables: np.ndarray
    bias: np.ndarray
    most: np.ndarray
    mean: np.ndarray
    offset: float

    def folded(self) -> np.ndarray:
        """Responses to pairs of bytes, so that a position takes half the lookups."""
        first, second = self.tables[0::2, :, None, :], self.tables[1::2, None, :, :]
        return np.ascontiguousarray((first + second).reshape(WIDTH // 2, 65536, -1), np.float32)


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, each filled up with at least ``WIDTH`` zeros to whole segments, and the numbers of segments.

    All is moved by ``WIDTH - 1`` zeros, so a filter ends at its position and never sees the next text.
    """
    segments = np.array([-(-(len(t) + WIDTH) // SEGMENT) for t in texts])
    body = np.zeros(int(segments.sum()) * SEGMENT + WIDTH, np.uint8)
    for at, text in zip((np.cumsum(segments) - segments) * SEGMENT + WIDTH - 1, texts, strict=True):
        body[at : at + len(text)] = np.frombuffer(text, np.uint8)
    return body, segments


def pooled(maxima: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the maxima of segments those of chunks, the chunk's winning segment, and where each text's chunks begin.

    The chunks of a text are its neighbouring segments; a text of one segment is one chunk.
    """
    begin = np.cumsum(segments) - segments
    chunks = np.maximum(segments - 1, 1)
    offsets = np.cumsum(chunks) - chunks
    first = np.arange(chunks.sum()) - np.repeat(offsets, chunks) + np.repeat(begin, chunks)
    second = first + np.repeat(segments > 1, chunks)
    winner = np.where(maxima[second] > maxima[first], second[:, None], first[:, None])
    return np.maximum(np.take_along_axis(maxima, winner, 0), 0), winner, offsets


def scores(network: Network, folded: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Probabilities of label 1 for a block of whole texts."""
    body, segments = padded(texts)
    size = int(segments.sum()) * SEGMENT
    pairs = body[:-1].astype(np.intp) * 256 + body[1:]
    maxima = np.empty((len(pairs) // SEGMENT, network.bias.size), np.float32)
    step = 64 * SEGMENT
    for at in range(0, size, step):
        end = min(at + step, size)
        response = np.take(folded[0], pairs[at:end], axis=0)
        for i in range(1, len(folded)):
            response += np.take(folded[i], pairs[at + 2 * i : end + 2 * i], axis=0)
        maxima[at // SEGMENT : end // SEGMENT] = response.reshape(-1, SEGMENT, network.bias.size).max(axis=1)
    chunks, _, offsets = pooled(maxima[: size // SEGMENT] + network.bias, segments)
    most = np.maximum.reduceat(chunks, offsets)
    mean = np.add.reduceat(chunks, offsets) / np.maximum(segments - 1, 1)[:, None]
    return 1 / (1 + np.exp(-(most @ network.most + mean @ network.mean + network.offset)))


def train(texts: list[bytes], labels: np.ndarray, options: FitOptions) -> Network:
    """Adam on the log loss. The response to a zero byte is fixed at zero, so padding is neutral."""
    rng = np.random.default_rng(options.seed)
    f = options.filters
    params = {
        "tables": (rng.normal(0, 0.3, (WIDTH, 256, f))).astype(np.float32), "bias": np.zeros(f), "most": rng.normal(0, 0.3, f),
        "mean": rng.normal(0, 0.3, f), "offset": np.zeros(1),
    }
    params["tables"][:, 0] = 0
    moments = {k: (np.zeros(v.shape), np.zeros(v.shape)) for k, v in params.items()}
    if not len(texts):
        return Network(params["tables"], params["bias"], np.zeros(f), np.zeros(f), 0.0)
    step = 0
    for _ in range(options.epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), options.batch):
            chosen = order[at : at + options.batch]
            grads = gradients(params, [texts[i] for i in chosen], labels[chosen])
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[k] -= (options.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(params[k].dtype)
    return Network(params["tables"], params["bias"], params["most"], params["mean"], float(params["offset"][0]))


def gradients(params: dict[str, np.ndarray], texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss over a mini-batch of whole texts."""
    body, segments = padded(texts)
    size, f = int(segments.sum()) * SEGMENT, params["bias"].size
    at = body.astype(np.intp)
    response = np.take(params["tables"][0], at[:size], axis=0)
    for j in range(1, WIDTH):
        response += np.take(params["tables"][j], at[j : size + j], axis=0)
    response = response.reshape(-1, SEGMENT, f)
    place = response.argmax(axis=1)
    maxima = np.take_along_axis(response, place[:, None], 1)[:, 0] + params["bias"]
    chunks, winner, offsets = pooled(maxima, segments)
    n = np.maximum(segments - 1, 1)
    most, mean = np.maximum.reduceat(chunks, offsets), np.add.reduceat(chunks, offsets) / n[:, None]
    z = most @ params["most"] + mean @ params["mean"] + params["offset"][0]
    slope = (1 / (1 + np.exp(-z)) - labels) / len(texts)
    owner = np.repeat(np.arange(len(texts)), n)
    # of equal maxima the first chunk takes the gradient
    is_most = chunks == most[owner]
    seen = np.cumsum(is_most, axis=0)
    is_most &= seen - np.where(offsets > 0, 1, 0)[owner][:, None] * seen[np.maximum(offsets - 1, 0)][owner] == 1
    back = slope[owner, None] * (params["mean"] / n[owner, None] + is_most * params["most"]) * (chunks > 0)
    tables = np.zeros(WIDTH * 256 * f)
    spots = winner * SEGMENT + np.take_along_axis(place, winner, 0)
    for j in range(WIDTH):
        cell = (j * 256 + at[spots + j]) * f + np.arange(f)
        tables += np.bincount(cell.ravel(), back.ravel(), len(tables))
    tables = tables.reshape(WIDTH, 256, f)
    tables[:, 0] = 0
    return {"tables": tables, "bias": back.sum(0), "most": slope @ most, "mean": slope @ mean, "offset": slope.sum(keepdims=True)}


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that never teach: the CRC of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, options: FitOptions = FitOptions()) -> Network:
    """Trains on a bounded sample of the rows that may teach; the sampled ids are few, so they may be broadcast."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(
        F.max("quality").alias("quality"))
    share = min(1.0, options.max_rows / max(1, known.count()))
    turn = F.xxhash64("doc_id")
    chosen = known.where(F.pmod(turn, F.lit(1_000_000)) < int(np.ceil(share * 1_000_000)))
    one = F.min(F.struct(F.xxhash64("text"), "text")).alias("least")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(one)
    rows = materialize(rows.select("doc_id", "quality", "least.text", turn.alias("turn")), "teachers")
    sizes = rows.select("turn", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).toArrow().sort_by("turn")
    fits = np.cumsum(sizes["bytes"].to_numpy().astype(np.int64)) <= options.max_bytes
    last = sizes["turn"].to_numpy()[fits].max() if fits.any() else None
    taught = rows.where(F.lit(False) if last is None else F.col("turn") <= int(last)).toArrow().sort_by("doc_id")
    return train(H.texts_of(taught["text"]), np.array(taught["quality"].to_pylist(), float), options)


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out and score of every row."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = network.folded()
        for batch in batches:
            texts = H.texts_of(batch["text"])
            parts = [scores(network, folded, texts[a:b]) for a, b in H.blocks(texts)]
            values = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(values.astype(float))], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(apply, f"doc_id {kind}, held_out boolean, score double")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
