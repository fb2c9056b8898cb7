"""Near-duplicates of the pipeline against all pairs, at the keys' widths of corpora of any size, and in odd cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import html, near, setjoin, warc
from heddle.llm.common import ordered_parts, table


def pair(rng, size, similarity):
    """Two sets of random hashes of about this Jaccard similarity."""
    both = round(size * 2 * similarity / (1 + similarity))
    h = rng.integers(0, 2**64, 2 * size - both, dtype=np.uint64)
    return np.unique(h[:size]), np.unique(h[size - both :])


@pytest.mark.parametrize("n", [1_000, 200_000, 20_000_000, 1_000_000_000])
@pytest.mark.parametrize("size", [46, 300])
def test_recall_of_pairs_at_any_number_of_documents(n, size):
    t, rng = near.Tables.of(n), np.random.default_rng(size)
    pairs = [pair(rng, size, 0.8) for _ in range(300)]
    met = 0
    for a, b in pairs:
        values, lows = near.segments([a, b], t)
        keys = near.ball(values, lows, t)
        probe = lambda i, j: (keys[i] == keys[j][:, :1]).any()  # noqa: B023, E731
        met += bool(probe(0, 1) or probe(1, 0))
    assert met >= 0.95 * len(pairs)


def test_as_the_exact_join(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("text rlike '[^ \\t-\\r]'")
    mine = {r["id"]: r["component"] for r in near.near_copies(docs, id_col="doc_id", text_col="text").collect()}
    exact = {r["id"]: r["component"] for r in setjoin.near_copies(docs, id_col="doc_id", text_col="text", shingle=5, similarity=0.8).collect()}
    assert set(mine) == set(exact) and sum(mine[i] != exact[i] for i in exact) <= 0.02 * sum(i != c for i, c in exact.items())


def test_crowd_of_near_copies(spark):
    """A base text with many copies, some of which are near no other: no link below 0.8, and nearly all links of 0.8 or more."""
    rng = random.Random(3)
    word = lambda: "w" + str(rng.randrange(10**6))
    base, texts = [word() for _ in range(150)], {}
    for i in range(200):
        copy = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 4, 8, 12])):
            copy[at] = word()
        texts[i] = " ".join(copy)
    sets = {i: set(near.shingle_set(t, 5).tolist()) for i, t in texts.items()}
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in texts:
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    must, gone = {i for i in texts if root(i) != i}, set(texts) - {r["doc_id"] for r in near.near_dedup(docs).collect()}
    assert 50 < len(must) < 195 and gone <= must and len(must - gone) <= 0.02 * len(must)


def test_odd_rows(spark):
    long = "lorem ipsum dolor " * 20_000
    rows = [(1, None, "k"), (2, "", "k"), (3, " \n\t", "k"), (4, "one", "k"), (5, long, "k"), (5, long, "k"), (6, long, "k"), (None, "null id", "k"), (7, "one", None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumns({c: F.lit(1) for c in ("node", "__row", "score", "sig", "component")})
    kept = near.near_dedup(odd)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 3, 4, 5, 5, None] and kept.columns == odd.columns
    assert near.near_dedup(odd.where("false")).count() == 0


def test_a_repeated_page_id_keeps_each_payload(spark):
    rows = [(1, "a", "A" * 2000), (5, "b", "A" * 2000), (1, "c", "B" * 1500), (1, "d", "short"), (None, "e", "A" * 2000)]
    found = warc.op1_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    seen = sorted(((r["payload_bytes"], r["record_type"], r["refers_to"]) for r in found), key=str)
    assert seen == [(1500, "response", None), (2000, "response", None), (2000, "revisit", 5), (2000, "revisit", 5), (5, "response", None)]


def test_differencing_decides_without_articles(spark):
    menu, foot = "<div>Home</div><div>About us</div>", "<div>Imprint</div>"
    pages = [(i, f"http://h/p/{i}", f"{menu}<div>Story {i} begins</div><div>and ends {i * 7}</div>{foot}") for i in range(20)]
    rows = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(rows) == 20 and all(r["text"] == f"Story {r['id']} begins\nand ends {r['id'] * 7}" and r["n_shared"] == 3 for r in rows)


@pytest.mark.parametrize("text", ['<a "x' * 80_000, "<a" * 200_000, '<a ">" ' * 60_000, "<div>" * 60_000 + "</p>" * 60_000, "<script>" + "</script" * 50_000])
def test_broken_markup_takes_linear_time(text):
    import time

    began = time.process_time()
    html.lines(text)
    assert time.process_time() - began < 2


def test_a_repeated_key_reaches_the_driver_once(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 10_000, 7).otherwise(F.col("id")).alias("k"), F.lit("x").alias("v"))
    dealt, _ = ordered_parts(rows, ["k"], ["v"])
    own = dealt.where("halo = 0")
    assert own.count() == 20_000 and own.where("k = 7").select("part").distinct().count() == 1 and own.select("part").distinct().count() > 5
