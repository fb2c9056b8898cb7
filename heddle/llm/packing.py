"""Best-fit packing of tokenised documents into fixed-length sequences by the sum-of-squares rule."""

from __future__ import annotations

import codecs
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import cut

CAPACITY = 4096
#: Pieces that one task packs on its own; each such group leaves about one sequence unfilled.
GROUP = 4_096
END = 1
_KEPT_WORDS = 1_000_000
#: Documents that are tokenised together.
SLICE = 512
#: Fixed value: the tokenizer's pattern of letters and signs that it keeps together.
_RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words with any other character than Latin letters and signs up to U+017F take the tokenizer's own way; \u0130 becomes two characters in lower case.
_ODD = regex.compile("[^ -~\u00a1-\u012f\u0131-\u017f]")
#: Signs that make one run at the end of a word, whatever signs they are.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The character by which the tokenizer spells each byte; a space stays one, since it separates runs.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SPELLING = "".join(" " if b == 32 else chr(b if b in _PLAIN else 256 + sum(x not in _PLAIN for x in range(b))) for b in range(256))
_PIECE = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


class WordIds(dict):
    """Ids of words as little-endian unsigned 32-bit bytes, by the public tokenizer.

    The tokenizer drops white space before it forms tokens and none crosses a space or line feed, so a
    text's ids are those of its words, put together. At most ``_KEPT_WORDS`` words are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merges = Tokenizer(self.tokenizer.model)  # the same merges, of runs that are found and spelled before
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def learn(self, words: set[str]) -> None:
        new = list(words - self.keys())
        if len(self) + len(new) > _KEPT_WORDS:
            self.clear()
            new = list(words)
        odd = [w for w in new if _ODD.search(w)] if _ODD.search(" ".join(new)) else []
        new = list(set(new).difference(odd)) if odd else new
        alone = [w for w in new if w.isalpha() and w.islower()]
        rest = [w for w in new if not (w.isalpha() and w.islower())]
        heads = [w.rstrip(_SIGNS) for w in rest]
        ended = [h.isalpha() and h.islower() for h in heads]  # a run of letters, then one of signs
        tails = [w[len(h) :] for w, h in zip(compress(rest, ended), compress(heads, ended), strict=True)]
        mixed = [(w, _RUNS.findall(w.lower())) for w, simple in zip(rest, ended, strict=True) if not simple]
        runs = set(compress(heads, ended)).union(tails, (r for _, rs in mixed for r in rs)) - self.keys()
        runs = list(runs.union(alone))
        for at in range(0, len(runs), 2048):
            if not self._learn_runs(runs[at : at + 2048]):
                self._learn_odd(runs[at : at + 2048])
        known = self.__getitem__
        self.update(zip(compress(rest, ended), map(add, map(known, compress(heads, ended)), map(known, tails)), strict=True))
        self.update([(w, b"".join(map(known, rs))) for w, rs in mixed])
        for at in range(0, len(odd), 2048):
            self._learn_odd(odd[at : at + 2048])

    def _learn_runs(self, runs: list[str]) -> bool:
        """Learn runs of lower-case Latin letters or signs: the tokenizer's steps before its merges change nothing but the spelling of bytes."""
        spelled = codecs.charmap_decode(" ".join(runs).encode(), "strict", _SPELLING)[0]
        ids = np.array(self.merges.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
        cuts = [0, *(4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()]  # after each run
        if len(cuts) != len(runs) + 1:
            return False
        ids = ids.tobytes()
        self.update(zip(runs, [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        return True

    def _learn_odd(self, part: list[str]) -> None:
        """Learn words by all of the tokenizer's own steps."""
        joined = " ".join(part)
        found = self.tokenizer.encode(joined, add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        closed = np.flatnonzero(self.closes[ids]) + 1  # after each run of letters or signs
        runs = np.cumsum([1 if w.isalpha() else len(_RUNS.findall(w)) for w in part])
        if len(closed) == runs[-1] and unicodedata.is_normalized("NFC", joined):
            cuts = 4 * np.concatenate([[0], closed])[np.concatenate([[0], runs])]
        else:  # letters that the tokenizer changes in number: ask it for each token's place
            ends = np.cumsum([len(w) + 1 for w in part])
            of = np.searchsorted(ends, [a for a, _ in found.offsets], side="right")
            cuts = 4 * np.searchsorted(of, np.arange(len(part) + 1))
        ids, cuts = ids.tobytes(), cuts.tolist()
        self.update(zip(part, [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))

    def ids(self, words: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, words))


_KNOWN: dict[str, WordIds] = {}


def known_words(path: str) -> WordIds:
    """The words of this Python worker, which serves many tasks."""
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path)
    return _KNOWN[path]


def split_words(text: str | None) -> list[str]:
    """Parts between spaces and line feeds. The tokenizer lowers letters; where they are Latin that can be done before."""
    text = (text or "").replace("\n", " ")
    return (text.lower() if text.isascii() or not _ODD.search(text) else text).split(" ")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document: its ids and the end id, cut every ``capacity`` ids.

    Null and empty texts are one piece that has the end id alone. ``path`` is the tokenizer's file,
    which every executor has; by default the installed public one."""
    width = 4 * capacity
    tail = array("I", [END]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words(path or tokenizer_path())
        for b in (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE)):
            out: list[tuple] = []
            split = [split_words(t.as_py()) for t in b.column(1)]
            known.learn(set().union(*split))
            for key, ws in zip(b.column(0).to_pylist(), split, strict=True):
                ids = known.ids(ws) + tail
                out += [(key, k, at // 4, min(width, len(ids) - at) // 4, zlib.crc32(ids[at : at + width])) for k, at in enumerate(range(0, len(ids), width))]
            kinds = (b.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = _PIECE.format(kind=docs.schema[id_col].dataType.simpleString())
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed from the longest to the shortest.

    With N(g) the number of open bins that have g left, each length goes where the sum of N(g)**2 over
    all g > 0 becomes smallest, to an open bin or a new one; ties go to the tightest place."""
    n_open = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable"):
        s = int(lengths[k])
        gaps = np.flatnonzero(n_open[s:]) + s
        rest = gaps - s
        change = 2 - 2 * n_open[gaps] + 2 * n_open[rest]
        if len(gaps) and rest[0] == 0:
            change[0] -= 1  # a bin that becomes full is open no more
        fresh = 2 * n_open[capacity - s] + 1 if s < capacity else 0
        at = int(change.argmin()) if len(gaps) else -1
        if at >= 0 and change[at] <= fresh:
            gap = int(gaps[at])
            b = stacks[gap].pop()
            n_open[gap] -= 1
        else:
            gap, b, made = capacity, made, made + 1
        bins[k], offsets[k] = b, capacity - gap
        if gap > s:
            n_open[gap - s] += 1
            stacks[gap - s].append(b)
    return bins, offsets


def pack(found: DataFrame, *, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``found`` (with length; from ``pieces``) with sequence_id and offset.

    Pieces are dealt by a hash into groups of about ``group`` rows, as many groups as the table needs,
    and each is packed by itself: rows are a few numbers each, and a group's size doesn't follow the
    table's. Pieces longer than ``capacity`` are an error."""
    n = max(1, -(-found.count() // group))
    names = [f.name for f in found.schema.fields]

    def run(pdf):
        pdf = pdf.sort_values(names, kind="stable", ignore_index=True)  # the same result however rows arrive
        lengths = pdf["length"].to_numpy()
        if len(lengths) and lengths.max() > capacity:
            raise ValueError(f"a piece of {lengths.max()} ids doesn't fit into {capacity}")
        bins, offsets = sum_of_squares(lengths, capacity)
        return pdf.assign(sequence_id=(pdf["__g"].to_numpy().astype(np.int64) << 32) + bins, offset=offsets)[[*names, "sequence_id", "offset"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields) + ", sequence_id long, offset long"
    return found.withColumn("__g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int")).groupBy("__g").applyInPandas(run, schema)


def op7_best_fit_packing(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(pieces(docs)))
