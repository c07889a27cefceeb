"""The earliest later set of a session that shares at least two items with a given set.

Sets of at most ``LONG`` items meet on the pairs of their items, of which one row holds a few hundred at most: sharing
two items is sharing a pair, and the next set with that pair is found by an ordered scan, so nothing is compared with
all later sets. A longer set would have pairs by the square of its items. It is compared as a whole instead: sets are
dealt into blocks of about a thousand, a pair of blocks is one row, and inside it the items shared are counted from an
index of the one block by item. A set of n items is n postings there, and only the earliest hit leaves a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscope.plans.ordered import scan

LONG = 32  # items of a set that is still taken apart into pairs
BLOCK = 1024  # sets of a session that stay together
LEAST = 2  # items to share
PLACE = ["sid", "ts", "seq", "us", "chunk", "idx"]
ASKED = ["sid", "idx", "rule", "key"]
HIT = "hit_us bigint, hit_idx bigint"


def pairs_of(c: str) -> Column:
    """All two-element combinations of a sorted array."""
    tail = lambda i: F.slice(c, i + 2, F.greatest(F.size(c) - i - 1, F.lit(0)))
    return F.flatten(F.transform(c, lambda x, i: F.transform(
        tail(i), lambda y: F.struct(x.alias("t1"), y.alias("t2"))
    )))


def by_pairs(asked: DataFrame, said: DataFrame) -> DataFrame:
    """Hits of short sets: one row per pair of items, and the next ``said`` row with the same pair."""
    spoken = said.select(*PLACE, F.explode(pairs_of("items")).alias("p"), F.lit(0).alias("turn"))
    wanted = asked.select(*PLACE, "rule", "key", F.explode(pairs_of("items")).alias("p"), F.lit(1).alias("turn"))
    both = wanted.unionByName(spoken, allowMissingColumns=True).select("*", "p.t1", "p.t2").drop("p")
    # what is said sorts before what is asked at the same instant, so "next" is strictly later
    found = scan(
        both, ["sid", "t1", "t2"], ["ts", "turn", "seq"],
        nexts={"hit": F.when(F.col("turn") == 0, F.struct("us", "idx"))},
    ).where("turn = 1 AND hit IS NOT NULL")
    return found.select(*ASKED, F.col("hit.us").alias("hit_us"), F.col("hit.idx").alias("hit_idx"))


def earliest(asked: list[dict], said: list[dict]) -> Iterator[tuple]:
    """(idx, rule, key, hit_us, hit_idx) of every asked set with a hit among the said ones."""
    said = sorted(said, key=lambda s: (s["us"], s["idx"]))
    us = np.array([s["us"] for s in said], np.int64)
    index: dict[str, list[int]] = {}
    for place, s in enumerate(said):
        for item in s["items"]:
            index.setdefault(item, []).append(place)
    postings = {item: np.array(places) for item, places in index.items()}
    for a in asked:
        met = [postings[item] for item in a["items"] if item in postings]
        if len(met) < LEAST:
            continue
        after = int(np.searchsorted(us, a["us"], side="right"))
        shared = np.bincount(np.concatenate(met), minlength=len(said))[after:]
        hits = np.flatnonzero(shared >= LEAST)
        if len(hits):
            hit = said[after + int(hits[0])]
            yield a["idx"], a["rule"], a["key"], hit["us"], hit["idx"]


def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = [(sid, *hit) for sid, a, s in zip(rows.sid, rows.asked, rows.said) for hit in earliest(a, s)]
        yield pd.DataFrame(out, columns=[*ASKED, "hit_us", "hit_idx"])


def dealt(rows: DataFrame, sizes: DataFrame, name: str, other: str, block: int, identity: list[str]) -> DataFrame:
    """The sets of a session in blocks, each once per block of the other side."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts: Callable[[str], Column] = lambda side: F.ceil(F.col(f"n_{side}") / block).cast("long")
    own = F.pmod(F.xxhash64(*identity), parts(name)).alias(f"{name}_block")
    spread = rows.join(sizes, "sid").select(
        "sid", own, F.struct("us", "items", *identity).alias("row"), parts(other).alias("others"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias(f"{other}_block")
    # counting costs far more than a block's bytes suggest, so the number of tasks is stated
    blocks = ["sid", *sorted([f"{name}_block", f"{other}_block"])]
    return spread.select("sid", f"{name}_block", copies, "row").repartition(tasks, *blocks).groupBy(*blocks).agg(
        F.collect_list("row").alias(name))


def by_blocks(asked: DataFrame, said: DataFrame, block: int = BLOCK) -> DataFrame:
    """Hits of sets of any size: sessions that hold both sides, block against block."""
    count = lambda rows, name: rows.groupBy("sid").agg(F.count("*").alias(name))
    sizes = count(asked, "n_asked").join(count(said, "n_said"), "sid")
    left = dealt(asked, sizes, "asked", "said", block, ["idx", "rule", "key"])
    right = dealt(said, sizes, "said", "asked", block, ["idx"])
    pairs = left.join(right, ["sid", "asked_block", "said_block"]).select("sid", "asked", "said")
    return pairs.mapInPandas(compared, f"sid string, idx bigint, rule string, key string, {HIT}")


def first_overlap(asked: DataFrame, said: DataFrame, long: int = LONG, block: int = BLOCK) -> DataFrame:
    """sid, idx, rule, key, hit_us, hit_idx: the earliest ``said`` set after each asked one that shares two items.

    asked: sid, ts, seq, us, chunk, idx, rule, key, items; said: the same without rule and key. ``us`` is not NULL;
    items are sorted and distinct, and sets of fewer than two have no hit. Sets without a hit are absent.
    """
    asked, said = (rows.where(F.size("items") >= LEAST) for rows in (asked, said))
    is_long = F.size("items") > long
    found = (
        by_pairs(asked.where(~is_long), said.where(~is_long))
        .unionByName(by_blocks(asked.where(is_long), said, block))
        .unionByName(by_blocks(asked.where(~is_long), said.where(is_long), block))
    )
    hit = F.min(F.struct("hit_us", "hit_idx")).alias("hit")
    return found.groupBy(*ASKED).agg(hit).select(*ASKED, "hit.hit_us", "hit.hit_idx")
