"""SimHash near-duplicates found by multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import cut, shared_dir
from heddle.llm.components import connected_components

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCK = 1 << 14


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, repeats included; of the whole sequence if it is shorter; none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()  # of bytes: at ASCII white space
    if not found:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(found), max(1, len(found) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts, stops = [0, *ends[: n - 1].tolist()], (ends[min(shingle, len(found)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)


def bit_sums(hashes: np.ndarray, n_words: int = 1) -> np.ndarray:
    """How many hashes have each of 64 * ``n_words`` bits set. Words after the first come from the hashes remixed."""
    sums = np.zeros((n_words, 64), np.int64)
    for k in range(n_words):
        h = hashes if k == 0 else _remix(hashes, k)
        for at in range(0, len(h), _BLOCK):
            sums[k] += np.unpackbits(h[at : at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint16)  # _BLOCK rows fit
    return sums.ravel()


def fingerprint(hashes: np.ndarray, n_words: int = 1) -> list[int]:
    """``n_words`` 64-bit words as signed longs; a bit is 1 if it is set in over half of the hashes. Zero without hashes."""
    return np.packbits(2 * bit_sums(hashes, n_words) > len(hashes), bitorder="little").view("<i8").tolist()


def _remix(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ np.uint64(0x9E3779B97F4A7C15 * k & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, n_words: int = 1) -> DataFrame:
    """(id, fp: array<bigint>) of every whole text. Null, empty and blank texts: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), shingle), n_words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.list_(pa.int64()))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp array<bigint>")


def distance(a: Column, b: Column, n_words: int) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(n_words)])


def segments(fp: Column, tables: int, width: int) -> Column:
    """Keys (segment number above its value) of the first ``tables`` segments of the 64-bit words."""
    mask, per_word = F.lit((1 << width) - 1).cast("long"), 64 // width
    return F.array(*(F.shiftrightunsigned(F.get(fp, F.lit(t // per_word)), t % per_word * width).bitwiseAND(mask).bitwiseOR(F.lit(t << width).cast("long")) for t in range(tables)))


def link_fingerprints(nodes: DataFrame, *, n_words: int, tables: int, width: int, max_distance: int, cap: int = 48) -> DataFrame:
    """Links (a, b) among ``nodes`` (node long, fp array<bigint>; fps distinct) within ``max_distance`` bits.

    Multi-index hashing: each segment of a fingerprint is a key of that segment's table. Every
    fingerprint probes each table with the Hamming ball of radius one around its own segment, and the
    matches are kept if their complete distance is small enough. Two fingerprints are found if some
    segment of theirs differs in one bit or none, which is certain where ``max_distance`` is below
    twice the number of ``tables``.

    Tables can have hot keys (over ``cap`` fingerprints that share a segment). For ``max_distance`` 2
    over one word fingerprints that meet one are linked another way, which gives the same components:
    every such fingerprint sends its node to all 65 points of its radius-one ball; two fingerprints are
    within two bits if and only if they share a point, so each point's fingerprints are linked to the
    smallest of them. For larger distances a hot key's members are dealt by hash into blocks of about
    ``cap``, and a probe goes to every block: all members are compared, and no task gathers a key.
    """
    keys = segments(F.col("fp"), tables, width)
    table = nodes.select(F.explode(keys).alias("key"), "node")
    sizes = table.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    ball = F.lit([0, *(1 << j for j in range(width))]).cast("array<bigint>")
    probes = nodes.select("node", F.explode(keys).alias("seg")).select("node", F.explode(F.transform(ball, lambda m: F.col("seg").bitwiseXOR(m))).alias("key"))
    if max_distance <= 2:
        many = sizes.where(F.col("n") > cap)
        few = table.join(sizes.where(F.col("n") <= cap).select("key"), "key").groupBy("key").agg(F.collect_list("node").alias("members"))
        near = probes.join(few, "key").select("node", F.explode(F.filter("members", lambda m: m < F.col("node"))).alias("b")).select(F.col("node").alias("a"), "b")
    else:
        blocks = sizes.select("key", F.ceil(F.col("n") / cap).alias("blocks"))
        held = table.join(blocks, "key").select("key", F.pmod(F.xxhash64("node"), "blocks").alias("block"), F.col("node").alias("b"))
        asked = probes.join(blocks, "key").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("node").alias("a"))
        near = asked.join(held, ["key", "block"]).where("b < a").select("a", "b")
    near = near.distinct()
    fa = nodes.select(F.col("node").alias("a"), F.col("fp").alias("fa"))
    fb = nodes.select(F.col("node").alias("b"), F.col("fp").alias("fb"))
    links = near.join(fa, "a").join(fb, "b").where(distance(F.col("fa"), F.col("fb"), n_words) <= max_distance).select("a", "b")
    if max_distance <= 2:
        if n_words != 1:
            raise ValueError("a distance of 2 or less is for fingerprints of one word")
        hot = cut(probes.join(many.select("key"), "key").select("node").distinct().join(nodes, "node").select("node", F.get("fp", F.lit(0)).alias("f")))
        flips = F.lit([0, *(1 << j for j in range(63)), -(1 << 63)]).cast("array<bigint>")
        points = hot.select("node", F.explode(F.transform(flips, lambda m: F.col("f").bitwiseXOR(m))).alias("point"))
        star = points.groupBy("point").agg(F.min("node").alias("b"), F.collect_list("node").alias("all"))  # a point has 65 fingerprints around it at most
        links = links.unionByName(star.select(F.explode("all").alias("a"), "b").where("a <> b").distinct())
    return links


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, n_words: int = 1, tables: int = 2, width: int = 32, max_distance: int = 2, cap: int = 48) -> DataFrame:
    """(id, fp, component): component is the smallest id that links of ``max_distance`` bits or fewer reach.

    Rows that share an id share a component. Null ids give null components. Texts without words
    have fingerprint zero and link like any other. Equal fingerprints are one node, so copies cost
    one row per task. Empty tables give no rows; extra columns are ignored."""
    shared_dir(docs.sparkSession)
    prints = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, n_words=n_words))
    nodes = cut(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("node")))
    comps = connected_components(link_fingerprints(nodes, n_words=n_words, tables=tables, width=width, max_distance=max_distance, cap=cap))
    place = nodes.join(comps, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return prints.join(place, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def op10_simhash(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint (16 hex digits), component_id."""
    found = simhash_components(docs)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex(F.get("fp", F.lit(0)))), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


#: Near copies have at least this Jaccard similarity.
NEAR_SIMILARITY = 0.8

#: Bits of a near-copy fingerprint, in words of 64, the share of them in which two near copies may differ, and the tables.
NEAR_WORDS, NEAR_SHARE, NEAR_TABLES = 6, 0.176, 12


def tables_for(n: int, *, tables: int = NEAR_TABLES) -> dict[str, int]:
    """Words, tables, width and distance to find near copies among ``n`` fingerprints.

    Keys of log2(n) + 3 bits hold the number of chance matches of a fingerprint the same at every size. A
    table finds two texts if at most one bit of its segment differs; ``chance`` says how likely that is.
    More tables find more, at their price in shuffled rows."""
    width = min(32, max(12, math.ceil(math.log2(max(n, 2))) + 3))
    n_words = max(NEAR_WORDS, -(-tables // (64 // width)))
    return {"n_words": n_words, "tables": tables, "width": width, "max_distance": round(NEAR_SHARE * 64 * n_words)}


def chance(similarity: float, *, tables: int, width: int) -> float:
    """Probability that two texts of this Jaccard similarity meet in one of the tables: a bit differs with probability acos(2s / (1 + s)) / pi."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return 1 - (1 - (1 - p) ** width - width * p * (1 - p) ** (width - 1)) ** tables


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """Documents without near copies: of each group the one with the smallest id stays, with all its columns.

    Groups are held together by pairs of a Jaccard similarity of ``NEAR_SIMILARITY`` or more over
    five-word shingles. Fingerprints only estimate it, and tables of them miss pairs, so ``setjoin``
    finds these pairs exactly. Texts without words are left alone (they have nothing to compare), and so
    are rows with a null id."""
    from heddle.llm import setjoin

    has_words = F.length(F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(" \t\n\x0b\f\r"))) > 0
    own = docs.where(has_words & F.col(id_col).isNotNull()).select(id_col, text_col)
    found = setjoin.near_copies(own, id_col=id_col, text_col=text_col, shingle=shingle, similarity=NEAR_SIMILARITY)
    gone = found.where("component <> id").select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
