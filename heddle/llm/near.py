"""Near-duplicate texts by SimHash and multi-index hashing, with every link verified on whole shingle sets.

A text's shingle set gets a fingerprint of ``tables`` segments. Each segment is a key of its own table. A
text probes each table with a small Hamming ball around its segment: all flips of the segment's least
certain bits, those whose sums of ones are nearest to the half. Texts that meet in a table are a candidate
pair; the complete distance of their fingerprints sorts out chance meetings, and the Jaccard similarity of
the two sets decides.

A fingerprint only estimates similarity, so that a pair may meet in no table. ``chance`` is the
probability that it meets in one, and the number of tables follows from it: a pair of similarity 0.8 is
met with probability ``RECALL`` or more at every number of documents, one that is more alike more often.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import SPACE_CHARS, cut
from heddle.llm.components import connected_components, with_links
from heddle.llm.simhash import bit_sums, distance, fingerprint, shingle_hashes

SIMILARITY = 0.8
SHINGLE = 5
#: Probability that a pair of ``SIMILARITY`` meets in a table, at least.
RECALL = 0.98
#: Least certain bits of a segment; a ball has all their flips.
LOW = 4
#: A segment has so many bits more than the number of documents has, so that chance meetings a document are as many at every size.
SPARE = 4
#: A candidate may differ in this many standard deviations more bits than a pair of ``SIMILARITY`` does on average.
SLACK = 3.0
#: Texts that may share a key before it is crowded: a crowded key's members meet drawn members first.
CROWD = 8
#: Members of a crowded key that are compared in one place, about.
BLOCK = 2048
#: Words of the complete fingerprint, by which members of a crowded key are compared, and of its part that is looked at first.
WORDS, FIRST_WORDS = 32, 6
#: Words of the fingerprint that every document carries, at least.
LEAST_WORDS = 8
#: Bits of a filter that says which documents' sets or which keys are wanted: a bound on what the driver gets and tasks are sent (half a MB).
FILTER_BITS = 4_194_301


def differing(similarity: float) -> float:
    """Share of fingerprint bits in which two sets of this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_differing(bits: int, similarity: float) -> int:
    """Bits in which a candidate pair may differ."""
    p = differing(similarity)
    return math.floor(bits * p + SLACK * math.sqrt(bits * p * (1 - p)))


@cache
def chance(similarity: float, width: int, low: int = LOW, trials: int = 20_000) -> float:
    """Probability that two sets of this Jaccard similarity meet in one table.

    Sums of ones behave as normal variables that correlate by the sets' cosine; drawn from a fixed seed. The
    pair meets if all bits that differ are among the ``low`` least certain ones of either side."""
    rng, r = np.random.default_rng(7), 2 * similarity / (1 + similarity)
    x = rng.standard_normal((trials, width))
    y = r * x + math.sqrt(1 - r * r) * rng.standard_normal((trials, width))
    differ = (x > 0) != (y > 0)
    inside = lambda v: ~(differ & (np.abs(v) > np.partition(np.abs(v), low - 1, axis=1)[:, low - 1 : low])).any(1)
    return float((inside(x) | inside(y)).mean())


@dataclass(frozen=True)
class Tables:
    tables: int
    width: int
    low: int = LOW

    @classmethod
    def of(cls, n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> Tables:
        width = max(12, math.ceil(math.log2(max(n, 2))) + SPARE)
        return cls(math.ceil(math.log(1 - recall) / math.log(1 - chance(similarity, width))), width)

    @property
    def bits(self) -> int:
        return self.tables * self.width

    @property
    def words(self) -> int:
        """Words of the fingerprint by which candidates are sorted out first; it begins with the segments' bits."""
        return max(LEAST_WORDS, -(-self.bits // 64))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def _ones(sets: list[np.ndarray], n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(how many hashes have each bit: rows x bits, sizes: rows x 1) of shingle sets."""
    return np.stack([bit_sums(s, n_words) for s in sets]), np.array([len(s) for s in sets]).reshape(-1, 1)


def segments(sets: list[np.ndarray], t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """(segments: rows x tables, least certain bits of each: rows x tables x low) of shingle sets."""
    return _segments(*_ones(sets, -(-t.bits // 64)), t)


def _segments(ones: np.ndarray, sizes: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    over = (2 * ones - sizes)[:, : t.bits].reshape(-1, t.tables, t.width)
    return ((over > 0) << np.arange(t.width)).sum(2), np.argsort(np.abs(over), axis=2, kind="stable")[:, :, : t.low].astype(np.int8)


def ball(values: np.ndarray, lows: np.ndarray, t: Tables) -> np.ndarray:
    """Keys (table number above a segment) of every point of the balls: rows x tables x 2**low, the segment itself first."""
    flips = (np.int64(1) << lows.astype(np.int64)) @ ((np.arange(1 << t.low) >> np.arange(t.low)[:, None]) & 1)
    return (values[:, :, None] ^ flips) | (np.arange(t.tables, dtype=np.int64) << t.width)[:, None]


def prints(docs: DataFrame, t: Tables, shingle: int) -> DataFrame:
    """(id, sig, segs, lows, bits) of ``docs`` (node, t): digest of the shingle set, segments and their least certain bits, and a fingerprint that begins with the segments' bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingle_set(x.as_py(), shingle) for x in part.column(1)]
                ones, sizes = _ones(sets, t.words)
                values, lows = _segments(ones, sizes, t)
                bits = np.packbits(2 * ones > sizes, axis=1, bitorder="little").view("<i8")
                n = part.num_rows
                lists = lambda x, k: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(x.ravel()))  # noqa: B023, E731
                sigs = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sigs, lists(values, t.tables), lists(lows, t.tables * t.low), lists(bits, t.words)], ["id", "sig", "segs", "lows", "bits"])

    return docs.select("node", "t").mapInArrow(run, "id long, sig binary, segs array<bigint>, lows array<tinyint>, bits array<bigint>")


def _filter(places: DataFrame) -> np.ndarray:
    """Bits of the ``places`` (at: from 0 to FILTER_BITS - 1), in words of 64."""
    words = places.select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    found = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    held = np.zeros(FILTER_BITS // 64 + 1, np.int64)
    held[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    return held


def probes(nodes: DataFrame, t: Tables, only: np.ndarray | None = None) -> DataFrame:
    """(key, node): every point of each node's balls; with ``only``, a filter of keys, those that it lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                values = part.column(1).flatten().to_numpy().reshape(-1, t.tables)
                lows = part.column(2).flatten().to_numpy().reshape(-1, t.tables, t.low)
                keys = ball(values, lows, t).reshape(part.num_rows, -1)
                keys, owners = keys.ravel(), np.repeat(part.column(0).to_numpy(), keys.shape[1])
                if only is not None:
                    place = keys % FILTER_BITS
                    through = np.flatnonzero((only[place >> 6] >> (place & 63)) & 1)
                    keys, owners = keys[through], owners[through]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners)], ["key", "node"])

    return nodes.select("node", "segs", "lows").mapInArrow(run, "key long, node long")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, grams, print) of the ``wanted`` nodes and of some others: the shingle set and the complete fingerprint.

    Texts aren't shuffled for it: the wanted nodes' hashes travel as a filter of fixed size."""
    at = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))
    held = _filter(wanted.select(at.alias("at")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.column(2).to_numpy()
            for i in np.flatnonzero((held[place >> 6] >> (place & 63)) & 1):
                grams = shingle_set(b.column(1)[int(i)].as_py(), shingle)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (grams.view(np.int64), np.array(fingerprint(grams, WORDS)))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(int(i), 1), *lists], ["node", "grams", "print"])

    return docs.select("node", "t", at.alias("at")).mapInArrow(run, "node long, grams array<bigint>, print array<bigint>")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets' Jaccard similarity is at least ``similarity``."""
    ga, gb = (sets.select(F.col("node").alias(x), F.col("grams").alias(f"g{x}")) for x in "ab")
    both = pairs.select("a", "b").join(ga, "a").join(gb, "b").select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("o"), (F.size("ga") + F.size("gb")).alias("n"))
    return both.where(F.col("o") >= similarity * (F.col("n") - F.col("o")) - 1e-9).select("a", "b").distinct()


def _near(pairs: DataFrame, nodes: DataFrame, t: Tables, similarity: float) -> DataFrame:
    """(a, b, d) of the distinct pairs of two components whose fingerprints differ in few enough bits."""
    sa, sb = (nodes.select(F.col("node").alias(x), F.col("bits").alias(f"s{x}"), F.col("component").alias(f"c{x}")) for x in "ab")
    met = pairs.distinct().join(sa, "a").join(sb, "b").where("ca <> cb")
    return met.select("a", "b", distance(F.col("sa"), F.col("sb"), t.words).alias("d")).where(F.col("d") <= most_differing(64 * t.words, similarity))


def _closer(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, d) of the pairs whose complete fingerprints differ in few enough bits."""
    one, other = (sets.select(F.col("node").alias(x), F.col("print").alias(f"p{x}")) for x in "ab")
    met = pairs.select("a", "b").join(one, "a").join(other, "b").select("a", "b", distance(F.col("pa"), F.col("pb"), WORDS).alias("d"))
    return met.where(F.col("d") <= most_differing(64 * WORDS, similarity)).distinct()


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs that ``comps`` doesn't join."""
    of = lambda x: comps.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def _closest(pairs: DataFrame, of: int = 8) -> DataFrame:
    """Each node's closest partner, and the closest in each of ``of`` parts that the partners are dealt to by hash, as pairs."""
    both = pairs.select("a", "b", "d").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    best = both.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(of))).agg(F.min(F.struct("d", "b")).alias("m"))
    return best.select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct()


def _ordered(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def near_copies(docs: DataFrame, *, id_col: str, text_col: str, shingle: int = SHINGLE, similarity: float = SIMILARITY, n: int | None = None) -> DataFrame:
    """(id, component) of ``docs``, which have words and ids: component is the smallest id that links reach.

    Equal sets are one node. Candidates are all pairs that meet in a table; no key's members are left out:
    where over ``CROWD`` nodes share a key they meet drawn members first, and then, in blocks, all members
    of other components (those of the key's largest component only as partners of others). A candidate whose texts
    links have joined is settled, at first by links to drawn members, so that near copies of one text don't make pairs in all
    their tables; every other one is verified on the whole sets, each node's closest first."""
    own = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("t"))
    t = Tables.of(docs.count() if n is None else n, similarity)
    printed = cut(prints(own, t, shingle))
    nodes = cut(printed.groupBy("sig").agg(F.min(F.struct("id", "segs", "lows", "bits")).alias("m")).select("sig", F.col("m.id").alias("node"), "m.segs", "m.lows", "m.bits"))

    at = nodes.select(F.posexplode("segs").alias("k", "seg"), "node").select(F.shiftleft(F.col("k").cast("long"), t.width).bitwiseOR(F.col("seg")).alias("key"), "node")
    crowded = cut(at.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("key"))
    asked = probes(nodes, t, _filter(crowded.select((F.col("key") % FILTER_BITS).alias("at"))))  # not all probes: few of them meet a crowded key
    members = asked.join(crowded, "key").join(at.join(crowded, "key").withColumn("own", F.lit(True)), ["key", "node"], "left")
    members = cut(members.select("key", "node", F.coalesce("own", F.lit(False)).alias("own")))
    pivots = members.where("own").groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("p")).select("key", F.col("p.node").alias("other"))
    star = members.join(pivots, "key").where("node <> other").select(*_ordered("node", "other"))
    drawn = cut(_closest(cut(_near(star, nodes.withColumn("component", F.col("node")), t, similarity))))
    ends = lambda p: p.select(F.col("a").alias("node")).unionByName(p.select(F.col("b").alias("node")))
    sets = cut(_sets(own, ends(drawn).unionByName(members.select("node")), shingle))
    comps = connected_components(cut(_alike(drawn, sets, similarity)))

    asked = probes(nodes, t)
    few = at.join(crowded, "key", "left_anti").select("key", F.col("node").alias("other"))
    met = asked.join(few, "key").where("node <> other").select(*_ordered("node", "other"))
    placed = nodes.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    pairs = cut(_near(met, placed, t, similarity))  # not those that drawn members have joined: near copies of one text meet in very many ways
    known = sets.select("node")
    more = cut(_sets(own, ends(pairs).join(known, "node", "left_anti"), shingle))
    sets = sets.unionByName(more.join(known, "node", "left_anti"))
    pairs = cut(_closer(pairs, sets, similarity))
    comps = with_links(comps, _alike(_closest(pairs), sets, similarity))
    rest = cut(_apart(pairs, comps).unionByName(_crowd_pairs(members, comps, sets, similarity)))
    closest = cut(_closest(rest))
    comps = with_links(comps, _alike(closest, sets, similarity))
    others = rest.join(closest, ["a", "b"], "left_anti").select("a", "b").distinct()
    comps = with_links(comps, _alike(_apart(others, comps), sets, similarity))
    place = nodes.join(comps, "node", "left").select("sig", F.coalesce("component", "node").alias("component"))
    return printed.select("id", "sig").join(place, "sig").select("id", "component")


def _crowd_pairs(members: DataFrame, comps: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, d): the candidates of crowded keys whose texts aren't joined yet, by their complete fingerprints."""
    placed = members.join(comps, "node", "left").select("key", "node", "own", F.coalesce("component", "node").alias("component"))
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    keys = sizes.groupBy("key").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("components")).where("components > 1")
    still = placed.join(keys.select("key", F.col("top.component").alias("top"), F.ceil(F.col("n") / BLOCK).alias("blocks")), "key").join(sets.select("node", "print"), "node")
    still = cut(still)
    x = still.withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    x = x.select("key", "block", *(F.col(c).alias(f"x{c}") for c in ("node", "own", "component", "print")))
    y = still.where("component <> top").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    y = y.select("key", "block", "top", *(F.col(c).alias(f"y{c}") for c in ("node", "own", "component", "print")))
    once = (F.col("xcomponent") == F.col("top")) | (F.col("xnode") < F.col("ynode"))
    apart = (F.col("xcomponent") != F.col("ycomponent")) & once & (F.col("xown") | F.col("yown"))
    within = lambda words: distance(F.col("xprint"), F.col("yprint"), words) <= most_differing(64 * words, similarity)
    met = x.join(y, ["key", "block"]).where(apart & within(FIRST_WORDS) & within(WORDS))
    return met.select(*_ordered("xnode", "ynode"), distance(F.col("xprint"), F.col("yprint"), WORDS).alias("d")).distinct()


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Documents without near copies: of each group the one with the smallest id stays, with all its columns.

    Groups are held together by pairs of a Jaccard similarity of ``similarity`` or more over word
    shingles; no pair below it is a link. Texts without words are left alone (they have nothing to
    compare), and so are rows with a null id. Rows that share an id are one document. An empty table stays empty."""
    has_words = F.length(F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACE_CHARS))) > 0
    found = near_copies(docs.where(has_words & F.col(id_col).isNotNull()).select(id_col, text_col), id_col=id_col, text_col=text_col, shingle=shingle, similarity=similarity, n=docs.count())
    gone = found.where("component <> id").select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
