"""Faster ways that must give what the plain ones give, and what they are made to cost."""

import random
import time

import numpy as np
import pytest
import xxhash

from heddle.llm import near, packing, simhash


@pytest.fixture(scope="module")
def known():
    return packing.WordIds(packing.tokenizer_path())


def test_odd_words_as_the_tokenizer(known):
    rng = random.Random(5)
    marks = "aAzZ09.,'!é É ß İ ı ſ Σ σ ς ñ ª º ² ¼ \t \xa0 \x85 \x1c ́ \xad 中 ﬁ Ω ǅ × ÷ ŉ 't 's 'll don't <|endoftext|> </w> Ġ ÿ \x7f ​ \U0001f600".split(" ") + [" ", " ", "\n"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    split = [packing.split_words(t) for t in texts]
    known.learn(set().union(*split))
    for text, words in zip(texts, split, strict=True):
        assert known.ids(words) == np.array(known.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_new_words_cost_less_than_the_whole_tokenizer(known):
    rng = random.Random(6)
    words = {"".join(rng.choice("abcdefghiklmnoprstuéà") for _ in range(9)) + end for _ in range(6000) for end in ("", ".", ",", "!")}
    began = time.process_time()
    known.tokenizer.encode(" ".join(words), add_special_tokens=False)
    plain, began = time.process_time() - began, time.process_time()
    known.learn(words)
    assert time.process_time() - began < 0.8 * plain


@pytest.mark.parametrize("text", ["", " \t\n", "One", "a b", "A b\x0bC\x0cd\re\x1cf g h", "x " * 40])
def test_shingles_as_plainly_made(text):
    import re

    words = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    assert simhash.shingle_hashes(text, 3).tolist() == [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]


def test_sums_of_many_hashes():
    h = np.full(70_000, 5, np.uint64)
    assert simhash.bit_sums(h)[:4].tolist() == [70_000, 0, 70_000, 0]


def test_near_copies_of_one_text_make_few_candidates(spark, monkeypatch):
    """Pairs of texts that drawn members have joined are no candidates: their number doesn't grow with the square of the group."""
    rng, made = random.Random(4), []
    word = lambda: "w" + str(rng.randrange(10**6))
    base, texts = [word() for _ in range(150)], []
    for i in range(150):
        copy = list(base)
        for at in rng.sample(range(150), 1):
            copy[at] = word()
        texts.append((i, " ".join(copy)))
    plain = near._near

    def counted(*args):
        found = plain(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(near, "_near", counted)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["component"] for r in near.near_copies(docs, id_col="doc_id", text_col="text").collect()} == {0}
    assert made[-1] < 100  # of 11175 pairs
