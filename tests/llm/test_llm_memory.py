"""The memory that batches of texts take."""

import tracemalloc

import pyarrow as pa

from turnscope.llm import hashing as H
from turnscope.llm import jaccard_join


def test_a_batch_is_not_taken_out_as_a_whole():
    texts = pa.array([(f"word{i} " * 180)[:1200] for i in range(30_000)] + [None, ""])
    assert [(a, b) for a, b, _ in H.text_blocks(texts)] == list(H.blocks(H.texts_of(texts)))
    assert [t for _, _, some in H.text_blocks(texts.slice(7, 900), 5000) for t in some] == H.texts_of(texts.slice(7, 900))
    batch = pa.RecordBatch.from_arrays([pa.array([b"k"] * len(texts)), texts], names=["key", "text"])
    tracemalloc.start()
    signed = list(H.released(jaccard_join.sign_batches(iter([batch]), jaccard_join.JoinOptions())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert signed[0].num_rows == len(texts) and signed[0]["sig"].null_count == 2
    assert peak < 32 << 20 < texts.nbytes
