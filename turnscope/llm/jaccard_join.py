"""N-gram Jaccard join: a forest of sorted prefix tries over MinHash signatures, then exact verification.

Equal texts form one class. The signature of a class holds, for each tree, a string of MinHash values; texts that
share a prefix of a tree's string meet. Matching starts with long prefixes, which only very similar texts share, and
shortens them until a link at the threshold would be found with the target probability.
A pair is verified where it meets first: at the longest prefix, in the first tree. A bucket whose members all met
in one earlier bucket is passed over as a whole.

Large buckets are cut into blocks by a hash, and pairs of blocks are verified on their own. A block yields counts per
text and a spanning forest of its links, never its pairs: the forest gives the classes, the counts the links.

Defined results: words are separated by white space; a text of one to four words is one shingle; a text without
words (null, empty) has no links and is a class of its own row; rows of equal text are copies, linked to each other;
class ids are the least id of the class, null where all its ids are null; an empty table gives no rows; only id and
text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope.llm import hashing as H
from turnscope.llm.columns import whole
from turnscope.llm.columns import words as split_words
from turnscope.llm.components import components
from turnscope.session import materialize


@dataclass(frozen=True)
class JoinOptions:
    words: int = 5
    threshold: float = 0.8
    trees: int = 12
    depths: tuple[int, ...] = (5, 3, 2, 1)
    recall: float = 0.999
    block: int = 512  # texts that meet at once; larger buckets are verified in pairs of blocks
    broadcast_rows: int = 500_000  # keys of 16 bytes that may be broadcast after their number is known

    def found(self, similarity: float, depth: int) -> float:
        """Probability that a pair of this similarity shares a prefix of this depth in some tree."""
        return 1 - (1 - similarity**depth) ** self.trees


LINKS = "kind int, a binary, b binary, docs long, texts long"


def shingles_of(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts, and where those of each text begin (one more at the end)."""
    words, begin = H.words_of(texts)
    n = np.diff(begin)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    offsets = np.concatenate(([0], np.cumsum(count)))
    owner = np.repeat(np.arange(len(texts)), count)
    starts = np.arange(offsets[-1]) - offsets[owner] + begin[owner]
    return H.range_hashes(H.mixed(words), starts, starts + np.minimum(size, n)[owner]), offsets


def signatures(texts: list[bytes], options: JoinOptions) -> list[bytes | None]:
    """For each text the MinHash values of all trees, two bytes each, in order; none for a text without words."""
    shingles, offsets = shingles_of(texts, options.words)
    some = np.flatnonzero(np.diff(offsets))
    depth = options.depths[0]
    out = np.empty((len(some), options.trees * depth), ">u2")
    for i in range(out.shape[1]):
        salt, factor = H.mixed(np.array([2 * i + 1, 2 * i + 2], np.uint64), 3)
        least = np.minimum.reduceat((shingles ^ salt) * (factor | np.uint64(1)), offsets[some]) if len(some) else out[:, i]
        out[:, i] = (H.mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)
    signed: list[bytes | None] = [None] * len(texts)
    for i, row in zip(some, out, strict=True):
        signed[i] = row.tobytes()
    return signed


def sign_batches(batches: Iterator[pa.RecordBatch], options: JoinOptions) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signed = [s for _, _, texts in H.text_blocks(batch["text"]) for s in signatures(texts, options)]
        yield pa.RecordBatch.from_arrays([batch["key"], pa.array(signed, pa.binary())], names=["key", "sig"])


def prefix(sig: Column | str, tree: Column | int, depth: int, options: JoinOptions) -> Column:
    at = tree * (2 * options.depths[0]) + 1
    return F.substring(sig, at, F.lit(2 * depth)) if isinstance(at, Column) else F.substring(sig, at, 2 * depth)


def met(a: str, b: str, tree: Column, depth: int, before: int | None, options: JoinOptions) -> Column:
    """Bits of the trees in which two signatures met before this tree and depth."""
    bits = F.lit(0).cast("long")
    for t in range(options.trees):
        same = (prefix(a, t, depth, options) == prefix(b, t, depth, options)) & (tree > t)
        bits = bits + F.when(same, F.lit(1 << t)).otherwise(F.lit(0))
        if before:
            deeper = prefix(a, t, before, options) == prefix(b, t, before, options)
            bits = bits + F.when(deeper, F.lit(1 << (options.trees + t))).otherwise(F.lit(0))
    return bits


def fresh_buckets(signed: DataFrame, depth: int, before: int | None, options: JoinOptions) -> DataFrame:
    """(bucket, tree, n, key) for the members of buckets that may hold a pair that has not met before."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(options.trees - 1)))
    member = signed.select("key", "sig", tree.alias("tree"))
    # the prefix itself, marked by its tree, is the bucket: no two prefixes ever share one
    named = F.concat(F.unhex(F.format_string("%02x", "tree")), prefix("sig", F.col("tree"), depth, options))
    member = member.select("key", "tree", named.alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("leader")).where("n > 1")
    members = materialize(member.join(shared, "bucket"), "members")
    leaders = signed.select(F.col("key").alias("leader"), F.col("sig").alias("leader_sig"))
    judged = members.join(signed.select("key", "sig"), "key").join(leaders, "leader")
    seen = judged.groupBy("bucket").agg(
        F.bit_and(met("sig", "leader_sig", F.col("tree"), depth, before, options)).alias("seen"))
    return members.join(seen.where("seen = 0").select("bucket"), "bucket").select("bucket", "tree", "n", "key")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets, by products of slices of the incidence matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.concatenate(([0], np.cumsum(values[1:] != values[:-1])))
    often = np.bincount(column)[column] > 1
    owner, column = owner[often], np.unique(column[often], return_inverse=True)[1]
    sizes = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (at, at + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        sizes += part @ part.T
    return sizes.astype(np.int64)


def first_meetings(sigs: np.ndarray, tree: int, depth: int, before: int | None) -> np.ndarray:
    """Pairs that share this tree's prefix and met nowhere before. ``sigs``: text x tree x depth."""
    def same(t: int, d: int) -> np.ndarray:
        part = sigs[:, t, :d]
        return (part[:, None, :] == part[None, :, :]).all(axis=2)

    new = same(tree, depth)
    for t in range(sigs.shape[1]):
        if before:
            new &= ~same(t, before)
        if t < tree:
            new &= ~same(t, depth)
    return new


def verify_block(rows: list[dict], sets: list[np.ndarray], depth: int, before: int | None, options: JoinOptions) -> Iterator[tuple]:
    """Rows of LINKS: copies and texts linked to each text, and a forest of the links."""
    one = {r["key"]: i for i, r in enumerate(rows)}  # repeated rows count once
    rows, sets = [rows[i] for i in one.values()], [sets[i] for i in one.values()]
    if len(rows) < 2:
        return
    sigs = np.frombuffer(b"".join(r["sig"] for r in rows), ">u2").reshape(len(rows), options.trees, -1)
    new = np.triu(first_meetings(sigs, rows[0]["tree"], depth, before), 1)
    if rows[0]["lo"] != rows[0]["hi"]:
        side = np.array([r["block"] for r in rows])
        new &= side[:, None] != side[None, :]
    if not new.any():
        return
    both = intersections(sets)
    sizes = np.array([len(s) for s in sets])
    union = sizes[:, None] + sizes[None, :] - both
    x, y = np.nonzero(new & (both >= options.threshold * union - 1e-9))
    if not len(x):
        return
    copies = np.array([r["copies"] for r in rows])
    docs, texts = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for p, q in ((x, y), (y, x)):
        np.add.at(docs, p, copies[q])
        np.add.at(texts, p, 1)
    for i in np.flatnonzero(texts):
        yield 0, rows[i]["key"], None, int(docs[i]), int(texts[i])
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for p, q in zip(x.tolist(), y.tolist(), strict=True):
        a, b = top(p), top(q)
        if a != b:
            root[max(a, b)] = min(a, b)
            yield 1, rows[p]["key"], rows[q]["key"], 0, 0


def verify_batches(batches: Iterator[pa.RecordBatch], depth: int, before: int | None, options: JoinOptions) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; a block that spans batches is put together. Only one block is held at a time."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("docs", pa.int64()), ("texts", pa.int64())])
    held: list[dict] = []
    sets: list[np.ndarray] = []

    def flush() -> list[tuple]:
        out = list(verify_block(held, sets, depth, before, options)) if len(held) > 1 else []
        held.clear()
        sets.clear()
        return out

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    for batch in batches:
        out = []
        rows = batch.drop_columns("text").to_pylist()
        for a, b, texts in H.text_blocks(batch["text"]):
            shingles, offsets = shingles_of(texts, options.words)
            for i in range(a, b):
                same = held and all(held[0][c] == rows[i][c] for c in ("bucket", "lo", "hi"))
                if not same:
                    out += flush()
                held.append(rows[i])
                sets.append(np.unique(shingles[offsets[i - a] : offsets[i - a + 1]]))
        if out:
            yield packed(out)
    if out := flush():
        yield packed(out)


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """Broadcasts a written table whose number of rows was counted; a longer one is joined as Spark sees fit."""
    return F.broadcast(df) if df.count() <= rows else df


def classes(docs: DataFrame) -> DataFrame:
    """One row per text: key, least id, number of its rows with that id, number of copies."""
    per_id = docs.groupBy("key", "id").agg(F.count("*").alias("rows"))
    return per_id.groupBy("key").agg(
        F.min_by(F.struct("id", "rows"), F.struct(F.col("id").isNull(), "id")).alias("x"), F.sum("rows").alias("copies")
    ).select("key", F.col("x.id").alias("id"), F.col("x.rows").alias("rows"), "copies")


def similar(docs: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """One row per different text with words: key, id (its least), rows, copies, root (the key of its class), links to
    documents of other texts and to other texts."""
    keyed = docs.select(F.col("doc_id").alias("id"), F.unhex(F.md5(whole(F.col("text")))).alias("key"), "text")
    signed = keyed.select("key", "text").mapInArrow(lambda it: H.released(sign_batches(it, options)), "key binary, sig binary")
    once = signed.where("sig is not null").groupBy("key").agg(F.first("sig").alias("sig"))
    known = materialize(once.join(classes(keyed.select("key", "id")), "key"), "signatures")
    links, before = None, None
    for depth in options.depths:
        found = materialize(verified(keyed, known, depth, before, options), "links")
        links = found if links is None else links.unionByName(found)
        before = depth
        if options.found(options.threshold, depth) >= options.recall:
            break
    roots = components(links.where("kind = 1").select("a", "b"))
    linked = links.where("kind = 0").groupBy(F.col("a").alias("key")).agg(
        F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    every = known.select("key", "id", "rows", "copies").join(roots.withColumnRenamed("node", "key"), "key", "left")
    return materialize(every.join(linked, "key", "left").select(
        "key", "id", "rows", "copies", F.coalesce("root", "key").alias("root"),
        F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("texts", F.lit(0)).alias("texts")), "similar")


def verified(keyed: DataFrame, known: DataFrame, depth: int, before: int | None, options: JoinOptions) -> DataFrame:
    """Links of the pairs that meet at this depth for the first time."""
    buckets = materialize(fresh_buckets(known, depth, before, options), "buckets")
    blocks = F.ceil(F.col("n") / options.block).cast("int")
    own = buckets.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", "tree", "block", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    wanted = materialize(buckets.select("key").distinct().join(known, "key").select("key", "id", "copies", "sig"), "wanted")
    wanted = broadcast_if(wanted, options.broadcast_rows // 4)
    same_id = F.col("id").eqNullSafe(F.col("_id"))
    texts = keyed.withColumnRenamed("id", "_id").join(wanted, "key").where(same_id).select("key", "copies", "sig", "text")
    meeting = spread.join(texts, "key").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return meeting.mapInArrow(lambda it: H.released(verify_batches(it, depth, before, options)), LINKS)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, links to other documents (copies included) and to other texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    known = similar(docs)
    least = known.groupBy("root").agg(F.min("id").alias("class_id"))
    per_text = materialize(known.join(least, "root").select(
        "key", "class_id", (F.col("copies") - 1 + F.col("docs")).alias("n_links"), F.col("texts").alias("n_text_links")), "per-text")
    keyed = docs.select("doc_id", F.unhex(F.md5(whole(F.col("text")))).alias("key"))
    zero = F.lit(0).cast("long")
    return keyed.join(per_text, "key", "left").select(
        "doc_id", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_text_links", zero).alias("n_text_links"))


def one_of_each(docs: DataFrame, options: JoinOptions = JoinOptions(), bare_once: bool = False) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of every class the row of the least id stays.

    Rows without words all stay, or with ``bare_once`` one of each text; null is the empty text. Only the keys that go
    are joined with the documents.
    """
    known = similar(docs.select("doc_id", "text"), options)
    best = known.groupBy("root").agg(F.min_by(F.struct("key", "id"), F.struct(F.col("id").isNull(), "id", "key")).alias("best"))
    judged = known.join(best, "root").withColumn("stays", F.col("key") == F.col("best.key"))
    # of a text that stays only its row of the least id is kept, of one that goes none
    rule = judged.select("key", "id", "rows", "copies", "stays")
    if bare_once:
        bare = docs.where(F.size(split_words(whole(F.col("text")))) == 0)
        bare = bare.select(F.col("doc_id").alias("id"), F.unhex(F.md5(whole(F.col("text")))).alias("key"))
        rule = rule.unionByName(classes(bare).withColumn("stays", F.lit(True)))
    rule = materialize(rule.where(~F.col("stays") | (F.col("copies") > 1)).select(
        "key", F.col("id").alias("_id"), "stays", (F.col("rows") > 1).alias("_repeated")), "rule")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.unhex(F.md5(whole(F.col("text")))).alias("key"))
    marked = keyed.join(broadcast_if(rule, options.broadcast_rows), "key", "left")
    kept = marked.where(F.col("stays").isNull() | (F.col("stays") & F.col("row.doc_id").eqNullSafe(F.col("_id"))))
    repeated = F.coalesce("_repeated", F.lit(False))
    unique = kept.where(repeated).dropDuplicates(["key"])
    return kept.where(~repeated).select("row.*").unionByName(unique.select("row.*"))
