"""The byte classifier, segment sampling, and the pipeline."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF_DIR
from llm_support import documents

import corpus_pipeline
from turnscope.llm import byte_cnn, hashing
from turnscope.llm import segment_sampling as sampling
from turnscope.llm.lattice import Vocabulary, chunks_of


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(sampling.MODEL)


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    f = 3
    params = {
        "tables": rng.normal(0, 0.3, (byte_cnn.WIDTH, 256, f)), "bias": rng.normal(0, 0.1, f), "most": rng.normal(0, 1, f),
        "mean": rng.normal(0, 1, f), "offset": np.zeros(1),
    }
    params["tables"][:, 0] = 0
    texts, labels = [b"plain text here " * 40, b"LOUD!! TEXT!! " * 9, b"", b"x" * 700], np.array([1.0, 0, 0, 1])

    def loss():
        network = byte_cnn.Network(params["tables"], params["bias"], params["most"], params["mean"], float(params["offset"][0]))
        p = byte_cnn.scores(network, (network.tables[0::2, :, None] + network.tables[1::2, None]).reshape(byte_cnn.WIDTH // 2, 65536, -1), texts)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grads = byte_cnn.gradients(params, texts, labels)
    for name, at in (("tables", (2, ord("x"), 1)), ("tables", (0, ord("!"), 2)), ("bias", 1), ("most", 0), ("mean", 2), ("offset", 0)):
        params[name][at] += 1e-3
        up = loss()
        params[name][at] -= 2e-3
        down = loss()
        params[name][at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3


def test_scores_do_not_depend_on_the_block():
    network = byte_cnn.train([b"good text " * 30, b"BAD!! " * 50] * 8, np.array([1.0, 0] * 8), byte_cnn.FitOptions(epochs=3))
    folded = network.folded()
    texts = [b"", b"a" * 250, b"good text " * 5000, b"BAD!! " * 3, "né".encode() * 300]
    together = byte_cnn.scores(network, folded, texts)
    assert np.allclose(together, [byte_cnn.scores(network, folded, [t])[0] for t in texts], atol=1e-6)


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(80)) for _ in range(300)]
    quality = [i % 3 > 0 for i in range(300)]
    texts = [t if q else t.upper().replace(" ", "!! ") for t, q in zip(texts, quality, strict=True)]
    docs = documents(spark, [*enumerate(texts), (300, None), (301, ""), (None, texts[0]), (5, texts[5])]).selectExpr("*", "1 as quality", "2 as score")
    labels = spark.createDataFrame([(i, int(q), 0) for i, q in enumerate(quality)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    network = byte_cnn.fit(docs, labels)
    rows = byte_cnn.score(docs, network).collect()
    assert len(rows) == 304 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 300]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held) and held
    assert np.mean([(r.score >= 0.3) == quality[r.doc_id] for r in held]) > 0.95
    assert {round(r.score, 6) for r in byte_cnn.score(docs, byte_cnn.fit(docs, labels.where("false"))).collect()} == {0.5}
    assert byte_cnn.score(documents(spark, []), network).count() == 0


def test_classifier_sample_is_bounded(spark, monkeypatch):
    """Rows that share an id teach once, and the texts that are brought together fit the stated bytes."""
    taught = []
    monkeypatch.setattr(byte_cnn, "train", lambda texts, labels, options: taught.append((texts, labels.tolist())))
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    docs = documents(spark, [(i, f"{j} " * 50) for i in ids for j in range(4)] + [(ids[0], None), (ids[1], "")])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] * 3, "doc_id long, quality int, toxic int")
    byte_cnn.fit(docs, labels)
    byte_cnn.fit(docs.repartition(7), labels)
    assert taught[0] == taught[1] and taught[0][1] == [i % 2 for i in ids]
    for size in (1000, 0):
        byte_cnn.fit(docs, labels, byte_cnn.FitOptions(max_bytes=size))
    some, none = taught[2][0], taught[3][0]
    assert 0 < len(some) < len(ids) and 900 <= sum(map(len, some)) <= 1000
    assert sum(map(len, none)) == 0


def segmentations(chunk, vocabulary):
    """All ways to spell a chunk of ASCII with pieces, with their log weights."""
    byte_ids = set(vocabulary.byte_ids.tolist())
    by_surface = {s: i for i, s in enumerate(vocabulary.surfaces) if s and i not in byte_ids}

    def rest(at):
        if at == len(chunk):
            yield (), 0.0
        for end in range(at + 1, len(chunk) + 1):
            piece = by_surface.get(chunk[at:end], int(vocabulary.byte_ids[chunk[at]]) if chunk[at:end] == b"\n" else None)
            if piece is not None:
                for ids, weight in rest(end):
                    yield (piece, *ids), weight + float(vocabulary.weights[piece])

    return list(rest(0))


def test_samples_have_the_exact_law(vocabulary):
    text = b"the inon.\nx"
    kinds, kind, _ = chunks_of([text])
    law = {}
    for parts in itertools.product(*(segmentations(kinds[k], vocabulary) for k in kind)):
        law[sum((p[0] for p in parts), ())] = sum(p[1] for p in parts)
    total = np.logaddexp.reduce(list(law.values()))
    p = {k: math.exp(v - total) for k, v in law.items()}
    n = 6000
    keys = hashing.mixed(np.arange(n, dtype=np.uint64), 5)
    first, second, weight = Counter(), Counter(), Counter()
    for found, threshold, lattice in sampling.sample_block([text] * n, keys, vocabulary, sampling.SampleOptions()):
        ids = [tuple(lattice.piece[d.edges].tolist()) for d in found]
        assert len(set(ids)) == 3 and found[0].value >= found[1].value >= found[2].value >= threshold
        first[ids[0]] += 1
        second[ids[1]] += 1
        for x, d in zip(ids, found, strict=True):
            assert abs(d.sums[-1] - math.log(p[x])) < 1e-9
            weight[x] += p[x] / -math.expm1(-math.exp(d.sums[-1] - threshold))
    best = max(p, key=p.get)
    assert abs(first[best] / n - p[best]) < 0.02
    follow = sum(p[a] * p[best] / (1 - p[a]) for a in p if a != best)
    assert abs(second[best] / n - follow) < 0.02
    assert abs(sum(weight.values()) / n - 1) < 0.01  # inclusion scores make unbiased estimates


TEXTS = [
    None, "", "a", " ", "  two  blanks ", "line\n\n next\tline\r\n", "mark \N{LOWER ONE EIGHTH BLOCK} stays", "naïve 日本 \U0001f600 \x00", "x" * 3000, "the cat sat " * 5000,
]


def test_samples_read_back(spark, vocabulary):
    docs = documents(spark, [*TEXTS, TEXTS[4]]).selectExpr("*", "1 as rank", "2 as ids", "3 as key")
    rows = sampling.decode(sampling.sample(docs, vocabulary), vocabulary).collect()
    by_doc = {}
    for r in rows:
        assert r.decoded == ([*TEXTS, TEXTS[4]][r.doc_id] or "")
        assert 0 < r.inclusion <= 1 or r.inclusion == 0 and r.log_prob < -300
        by_doc.setdefault(r.doc_id, []).append((r["rank"], tuple(r.ids)))
    assert len(by_doc[0]) == len(by_doc[1]) == 1 and len(by_doc[4]) == 3
    assert all(len({ids for _, ids in x}) == len(x) for x in by_doc.values())
    again = sampling.sample(docs.repartition(3), vocabulary).collect()
    assert {(r.doc_id, r["rank"]): tuple(r.ids) for r in again} == {(r.doc_id, r["rank"]): tuple(r.ids) for r in rows}
    assert sampling.sample(documents(spark, []), vocabulary).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[1] < seen[0] and seen[2] == seen[1] and seen[3] < seen[2]
    assert docs.select("doc_id").distinct().count() == seen[-1]


def test_pipeline_on_nothing(spark, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{table}.parquet").where("false").write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
