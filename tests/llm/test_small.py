"""Nulls, empty tables, ties, repeated rows and clashing names: no operator crashes, and each case has its defined result."""

import pytest
from pyspark.sql import functions as F

from heddle.llm import chat, gam, html, multiset, packing, pieces, rules, secrets, simhash, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, fp int, part string, key string"
LONG = "lorem ipsum dolor " * 20_000


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, "x", 1, "p", "k") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None), (2, "", "a"), (3, " \n\t", "a"), (4, "one", None), (5, LONG, "a"), (5, LONG, "a"), (6, LONG, None), (None, "null id \U0001f600", "b"), (7, "x\x00y\n\nx\x00y", "b")]
    return docs_of(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, None), (4, None, 1), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def test_rules(odd, none, labels):
    rows = {r["doc_id"]: r for r in rules.judge(odd, rules.trusted_ids(labels)).collect()}
    assert len(rows) == 8 and not any(rows[i]["kept"] for i in (1, 2, 3, 4, 5))
    assert [rows[1][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [0] * 5
    assert rows[5]["n_words"] == 60_000 == rows[5]["n_repeat_words"] and rows[7]["n_dup_lines"] == 1
    assert rules.judge(none, rules.trusted_ids(labels)).count() == 0
    assert rules.judge(odd, rules.trusted_ids(labels.where("false"))).select("llr").distinct().collect()[0][0] == 0.0


def test_gam(odd, none, labels):
    rows = gam.op2_quality_classifier(odd, labels).collect()
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
    assert gam.op2_quality_classifier(none, labels).count() == 0
    assert gam.op2_quality_classifier(odd, labels.where("false")).count() == 9


def test_secrets(spark, odd, none):
    model = secrets.fit_forest(secrets.labelled_findings(spark, 600), trees=3)
    rows = secrets.scan(odd, model).collect()
    assert all(r["redacted"] == r["text"] and r["n_candidates"] == 0 for r in rows) and len(rows) == 9
    assert secrets.op3_secret_scans(none).count() == 0


def test_multiset(odd, none):
    rows = multiset.op4_document_fingerprints(odd).collect()
    assert len(rows) == 9 and len({r["fingerprint"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)} == {multiset.Fingerprint.of("").hex()}
    assert multiset.op4_document_fingerprints(none).count() == 0
    assert [r["near_next"] for r in multiset.op4_document_fingerprints(odd.where("doc_id = 4")).collect()] == [1.0]


def test_packing(odd, none):
    rows = packing.op7_best_fit_packing(odd).collect()
    assert sorted(r["length"] for r in rows if r["doc_id"] in (1, 2, 3)) == [1, 1, 1]
    assert packing.op7_best_fit_packing(none).count() == 0


def test_pieces(odd, none):
    rows = pieces.op8_sentencepiece(odd).collect()
    assert all(r["round_trip"] for r in rows) and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert pieces.op8_sentencepiece(none).count() == 0


def test_simhash(odd, none):
    rows = {(r["doc_id"], r["component_id"], r["fingerprint"]) for r in simhash.op10_simhash(odd).collect()}
    assert {(i, c) for i, c, f in rows if f == "0" * 16} == {(1, 1), (2, 1), (3, 1)} and {c for i, c, _ in rows if i in (5, 6)} == {5}
    assert {c for i, c, _ in rows if i is None} == {None}
    assert simhash.op10_simhash(none).count() == 0
    kept = [r["doc_id"] for r in simhash.near_dedup(odd).collect()]
    assert sorted(kept, key=str) == [1, 2, 3, 4, 5, 5, 7, None] and simhash.near_dedup(none).count() == 0
    assert simhash.near_dedup(odd).columns == odd.columns


def test_chat(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, record int")
    assert [r["conv_id"] for r in chat.op5_chat_formatting(empty).collect()] == [-7]
    rows = spark.createDataFrame([(None, None, None, None, 1), (1, 0, "assistant", None, 1), (1, 0, "assistant", "b", 1), (1, 0, "assistant", "b", 1)], empty.schema)
    found = {r["conv_id"]: r for r in chat.op5_chat_formatting(rows).collect()}
    assert found[None]["n_turns"] == 1 and found[None]["loss_chars"] == 0 and found[1]["n_turns"] == 3 and found[1]["loss_chars"] == 2


@pytest.fixture(scope="module")
def pages(spark):
    big = "é<p>" + "x" * 1200
    rows = [(1, None, None), (2, "http://a.com/x y\n", ""), (3, "http://a.com/1", big), (9, "http://b.com/", big), (9, "http://b.com/", big), (4, "", big), (None, "http://a.com/2", "<p>n"), (5, "http://a.com/3", "small"), (6, "http://a.com/4", "small")]
    return spark.createDataFrame([(*r, "h", "p", 0) for r in rows], "page_id long, url string, html string, host string, path string, refers_to int").repartition(2)


def test_warc(spark, pages):
    rows = warc.op1_warc(pages).collect()
    kinds = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows}
    assert len(rows) == 9 and {(3, "revisit", 9, 1205), (4, "revisit", 9, 1205), (9, "response", None, 1205), (1, "response", None, 0), (5, "response", None, 5), (None, "response", None, 4)} <= kinds
    assert warc.op1_warc(pages.where("false")).count() == 0


def test_html(pages):
    rows = html.op6_html_extraction(pages).collect()
    assert len(rows) == 9 and {r["text"] for r in rows if r["page_id"] in (1, 2)} == {""}
    assert {r["n_chars"] for r in rows if r["page_id"] == 4} == {1202}
    assert html.op6_html_extraction(pages.where("false")).count() == 0


def test_ordered_parts_see_true_neighbours(spark):
    from heddle.llm.common import ordered_parts

    df = spark.range(0, 3000, 3).withColumn("g", F.col("id") % 7).repartition(5)
    dealt, _ = ordered_parts(df, ["id"], ["g"], before=1, after=1)
    parts = {}
    for r in dealt.collect():
        parts.setdefault(r["part"], []).append((r["id"], r["halo"]))
    assert len(parts) > 4
    for rows in parts.values():
        rows.sort()
        ids = [i for i, _ in rows]
        assert all(b - a == 3 for a, b in zip(ids, ids[1:], strict=False)) and {h for _, h in rows[1:-1]} == {0}
    assert sorted(i for rows in parts.values() for i, h in rows if not h) == list(range(0, 3000, 3))
