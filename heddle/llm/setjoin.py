"""All pairs of texts whose shingle sets have a Jaccard similarity of at least a threshold: an exact join by prefixes, whatever the corpus's size."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import cut
from heddle.llm.components import connected_components
from heddle.llm.simhash import shingle_hashes

#: Common shingles come last in the order of prefixes. They are counted in one of 16 documents, and at most so many are
#: told apart; any one order of the shingles gives the same pairs, so this decides the time taken and nothing else.
SAMPLED, MOST_COMMON, LEAST_COUNT = 16, 1 << 17, 3
#: Members of a key that one task compares with each other, about.
BLOCK = 64
_FLUSH = 1 << 20


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle).view(np.int64))


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, grams) of ``docs`` (node, t): each text's sorted shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, grams, held = 0, [], 0
            for i, t in enumerate(b.column(1)):
                grams.append(shingle_set(t.as_py(), shingle))
                held += len(grams[-1])
                if held > _FLUSH or i + 1 == b.num_rows:
                    ends = np.cumsum([0, *map(len, grams)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(grams)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(grams)))], ["node", "grams"])
                    first, grams, held = i + 1, [], 0

    return docs.select("node", "t").mapInArrow(run, "node long, grams array<bigint>")


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles of a sample, by value, and their ranks (a larger rank is more common)."""
    sample = docs.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0)
    counted = _sets(sample, shingle).select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)
    rows = counted.orderBy(F.desc("n"), "g").limit(MOST_COMMON).collect()
    found = np.array([r["g"] for r in rows], np.int64)
    order = np.argsort(found)
    return found[order], np.arange(len(rows), 0, -1)[order]


def _prefixes(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(id, sig, size, rare): the set's digest and size, and its first shingles in the global order.

    Two sets within ``similarity`` share at least ``similarity`` of the larger one's shingles, so that the
    first shingle they share is among the first 1 - ``similarity`` of each, and one."""
    common, ranks = _common(docs, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs, sizes, rare = [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), shingle)
                sigs.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                n = len(s) - ceil(similarity * len(s) - 1e-9) + 1
                rank = np.zeros(len(s), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    rank = np.where(common[at] == s, ranks[at], 0)
                rare.append(s[np.argsort(rank, kind="stable")[:n]])
            ends = np.cumsum([0, *map(len, rare)]).astype(np.int32)
            flat = np.concatenate(rare) if rare else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "sig", "size", "rare"])

    return docs.select("node", "t").mapInArrow(run, "id long, sig binary, size long, rare array<bigint>")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets' Jaccard similarity is at least ``similarity``."""
    ga, gb = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    both = pairs.join(ga, "a").join(gb, "b").select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("o"), (F.size("ga") + F.size("gb")).alias("n"))
    return both.where(F.col("o") >= similarity * (F.col("n") - F.col("o")) - 1e-9).select("a", "b")


def near_copies(docs: DataFrame, *, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(id, component) of ``docs``, which have words and ids: component is the smallest id that pairs of ``similarity`` or more reach.

    Equal sets are one node. A prefix's shingles are keys, and two nodes that share one are a candidate if
    their sizes and their places in the order allow the similarity. Every candidate is then verified on
    the whole sets. Each key's members are compared with members drawn by hash first; of the rest, only
    those that no link has joined so far, in blocks, which leaves out no pair that could change a component."""
    own = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("t"))
    prints = cut(_prefixes(own, shingle, similarity))
    nodes = prints.groupBy("sig").agg(F.min("id").alias("node"), F.first("size").alias("size"), F.first("rare").alias("rare"))
    table = nodes.select("node", "size", F.posexplode("rare").alias("pos", "key")).select("key", "node", "size", (F.col("size") - F.col("pos")).alias("rest"))
    drawn = lambda j: F.min(F.struct(F.xxhash64("node", F.lit(j)).alias("h"), "node", "size", "rest")).alias(f"p{j}")
    keys = table.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *(drawn(j) for j in range(3))).where("n > 1")
    shared = cut(table.join(keys, "key"))
    able = lambda x, y: (1 + similarity) * F.least(f"{x}rest", f"{y}rest") >= similarity * (F.col(f"{x}size") + F.col(f"{y}size")) - 1e-6
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    star = shared.select("node", "size", "rest", F.explode(F.array_distinct(F.array("p0", "p1", "p2"))).alias("p")).where(F.col("node") != F.col("p.node"))
    star = cut(star.where(able("", "p.")).select(*ordered("node", "p.node")).distinct())
    sets = cut(_sets(own.join(shared.select("node").distinct(), "node", "left_semi"), shingle))
    links = cut(_alike(star, sets, similarity).distinct())
    joined = connected_components(links)

    placed = shared.select("key", "node", "size", "rest").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = cut(placed)
    open_keys = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    left = placed.join(open_keys.select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    x = left.select("key", "block", *(F.col(c).alias(f"x{c}") for c in ("node", "size", "rest", "component")))
    y = left.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), *(F.col(c).alias(f"y{c}") for c in ("node", "size", "rest", "component")))
    rest = x.join(y, ["key", "block"]).where((F.col("xnode") < F.col("ynode")) & (F.col("xcomponent") != F.col("ycomponent")) & able("x", "y"))
    rest = rest.select(F.col("xnode").alias("a"), F.col("ynode").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    comps = connected_components(links.unionByName(_alike(cut(rest), sets, similarity)))
    place = prints.groupBy("sig").agg(F.min("id").alias("node")).join(comps, "node", "left").select("sig", F.coalesce("component", "node").alias("component"))
    return prints.select("id", "sig").join(place, "sig").select("id", "component")
