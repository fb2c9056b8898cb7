"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

The piece table comes from a public SentencePiece model file. Texts are written with U+2581 for spaces
and cut into words where no piece can cross; a word's segmentation is the one with the largest sum of
piece scores (the unigram objective). Words of equal length advance together: hashes of all their
substrings probe the sorted keys of the pieces, and maxima over the last piece's length give backpointers.

The public file was made for merges; under this objective its scores give other ids than merging would.
They equal the sentencepiece library's best lattice path for the same table read as a unigram model.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CELLS = 1 << 21
_KEPT_WORDS = 600_000
SLICE = 512
#: Below the smallest score, what a character without a piece costs.
UNKNOWN = 10.0


class PieceTable:
    """Pieces of a model file, ready to be probed, and the ids of words met so far."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        texts = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        if any(SPACE in texts[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece goes on after a space, so words can't be encoded apart")
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        keys = np.zeros(len(normal), np.uint64)
        for size in {len(texts[i]) for i in normal}:
            own = [k for k, i in enumerate(normal) if len(texts[i]) == size]
            keys[own] = _hashes(_points([texts[normal[k]] for k in own]))[:, -1]
        order = np.argsort(keys)
        if (np.diff(keys[order]) == 0).any():
            raise ValueError("two pieces share a hash")
        self.keys, self.ids = keys[order], np.array(normal, np.int64)[order]
        self.scores = np.array([model.get_score(normal[k]) for k in order])
        self.longest = max(len(texts[i]) for i in normal)
        self.unknown = float(self.scores.min()) - UNKNOWN
        self.surface = [b"" if model.is_control(i) or model.is_unknown(i) else texts[i].replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids):
            self.surface[i] = bytes([b])
        self.known: dict[str, bytes] = {}

    def units(self, text: str) -> list[str]:
        """The text's words, after its spaces are written and one is put before it."""
        return _UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, words: set[str]) -> None:
        new = sorted(words - self.known.keys(), key=len)
        if len(self.known) + len(new) > _KEPT_WORDS:
            self.known.clear()
            new = sorted(words, key=len)
        at = 0
        while at < len(new):
            length = len(new[at])
            end = at + 1
            most = at + max(1, _CELLS // (length * self.longest))
            while end < len(new) and end < most and len(new[end]) == length:
                end += 1
            self.known.update(zip(new[at:end], self.viterbi(new[at:end]), strict=True))
            at = end

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit bytes, of words of one length; ties go to the longer last piece."""
        m, n = len(words), len(words[0])
        points = _points(words)
        h = _hashes(points)
        found, gains = [], []
        for k in range(1, min(self.longest, n) + 1):
            sub = h[:, k:] - h[:, :-k] * _power(k)
            at = np.minimum(np.searchsorted(self.keys, sub), len(self.keys) - 1)
            hit = self.keys[at] == sub
            gain = np.where(hit, self.scores[at], -np.inf)
            ids = np.where(hit, self.ids[at], -1)
            if k == 1:
                gain, ids = np.where(hit, gain, self.unknown), np.where(hit, ids, -2 - points.astype(np.int64))
            found.append(ids)
            gains.append(gain)
        best, back = np.full((n + 1, m), -np.inf), np.zeros((n + 1, m), np.int64)
        best[0] = 0
        for e in range(1, n + 1):
            for k in range(min(len(gains), e), 0, -1):
                total = best[e - k] + gains[k - 1][:, e - k]
                better = total > best[e]
                best[e][better] = total[better]
                back[e][better] = k
        steps, place, rows = [], np.full(m, n), np.arange(m)
        while (place > 0).any():
            live = place > 0
            k = np.where(live, back[place, rows], 1)
            start = np.maximum(place - k, 0)
            step = np.full(m, -1, np.int64)
            for size in np.unique(k[live]):
                which = live & (k == size)
                step[which] = found[size - 1][rows[which], start[which]]
            steps.append(step)
            place = np.where(live, start, 0)
        ids = np.stack(steps[::-1], axis=1)
        used = ids != -1
        flat, ends = ids[used], np.cumsum(used.sum(1))
        data, cuts = flat.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
        out = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for i in np.flatnonzero((ids < -1).any(1)).tolist():  # words with characters that have no piece: their bytes' ids
            row = [[x] if x >= 0 else self.byte_ids[list(chr(-2 - x).encode("utf-8", "surrogatepass"))] for x in ids[i][used[i]].tolist()]
            out[i] = np.concatenate(row).astype("<u4").tobytes()
        return out

    def encode(self, text: str) -> bytes:
        words = self.units(text)
        self.learn(set(words))
        return self.joined(words)

    def joined(self, words: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))

    def decode(self, ids: bytes) -> str:
        """The text of ids; the space that encoding puts first is taken away."""
        text = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text.removeprefix(" ")


def _points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype(np.uint64)


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), k, 1 << 64))


def _hashes(points: np.ndarray) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of each row's beginnings of 0, 1, 2 ... characters."""
    out = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
    for j in range(points.shape[1]):
        out[:, j + 1] = out[:, j] * _BASE + points[:, j] + np.uint64(1)
    return out


_TABLES: dict[str, PieceTable] = {}


def piece_table(path: str | None = None) -> PieceTable:
    """The table of this Python worker, which serves many tasks."""
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("piece_bpe_32k.model"))
    if path not in _TABLES:
        _TABLES[path] = PieceTable(path)
    return _TABLES[path]


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids: array<int>) of every whole text. Null and empty texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        for keys, texts in _slices(batches):
            split = [table.units(t or "") for t in texts]
            table.learn(set().union(*split))
            yield pa.RecordBatch.from_arrays([keys, pa.array([np.frombuffer(table.joined(s), "<i4") for s in split], pa.list_(pa.int32()))], ["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, *, path: str | None = None) -> DataFrame:
    """(id, text) of each row of (id, ids). Null ids give the empty text; bytes that aren't UTF-8 are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        for b in batches:
            texts = [table.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {encoded.schema['id'].dataType.simpleString()}, text string")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            yield part.column(0), part.column(1).to_pylist()


def op8_sentencepiece(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_chars, decoded_sha256 and
    round_trip: whether decoding gives the text back. In a text, U+2581 means a space, so it comes back as one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        table = piece_table(path)
        for keys, texts in _slices(batches):
            split = [table.units(t or "") for t in texts]
            table.learn(set().union(*split))
            out = []
            for t, words in zip(texts, split, strict=True):
                ids = table.joined(words)
                back = table.decode(ids)
                out.append((len(ids) // 4, zlib.crc32(ids), len(back), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == (t or "").replace(SPACE, " ")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "n_tokens", "ids_crc32", "decoded_chars", "decoded_sha256", "round_trip"])

    return docs.select("doc_id", F.col("text").alias("t")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_crc32 long, decoded_chars long, decoded_sha256 string, round_trip boolean")
