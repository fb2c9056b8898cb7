"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line of the text, as it stands) is hashed to a wide vector, and a document's fingerprint is
the sum of its paragraphs' vectors, each lane modulo a power of two. The order of paragraphs doesn't
matter, and paragraphs are inserted or deleted by adding or subtracting their vectors.

The vector has two sorts of lanes. *Identity* lanes are expanded from a cryptographic hash of the
paragraph, modulo 2**64: equal sums mean equal multisets of paragraphs. *Likeness* lanes, modulo 2**32,
are a signed sketch of the paragraph's distinct three-word runs: the cosine of two documents' lanes
estimates how many of these they share, with an error of about 1 / sqrt(lanes).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import ordered_parts
from heddle.llm.simhash import shingle_hashes

IDENTITY_LANES = 8
LIKENESS_LANES = 512
RUN = 3


class Fingerprint:
    """Sum of paragraph vectors; ``insert`` and ``delete`` change it by one paragraph."""

    __slots__ = ("identity", "likeness")

    def __init__(self, identity: np.ndarray | None = None, likeness: np.ndarray | None = None):
        self.identity = np.zeros(IDENTITY_LANES, np.uint64) if identity is None else identity
        self.likeness = np.zeros(LIKENESS_LANES, np.uint32) if likeness is None else likeness

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        """Of a whole text; null counts as the empty text, which is one empty paragraph."""
        out = cls()
        out._add((text or "").split("\n"))
        return out

    def insert(self, paragraph: str) -> None:
        self._add([paragraph])

    def delete(self, paragraph: str) -> None:
        gone = Fingerprint()
        gone._add([paragraph])
        self.identity, self.likeness = self.identity - gone.identity, self.likeness - gone.likeness

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.identity + other.identity, self.likeness + other.likeness)

    def __eq__(self, other) -> bool:
        return isinstance(other, Fingerprint) and bool((self.identity == other.identity).all() and (self.likeness == other.likeness).all())

    __hash__ = None

    def _add(self, paragraphs: list[str]) -> None:
        digests = b"".join(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=8 * IDENTITY_LANES).digest() for p in paragraphs)
        self.identity = self.identity + np.frombuffer(digests, "<u8").reshape(-1, IDENTITY_LANES).sum(0, dtype=np.uint64)
        h = [np.unique(x) for p in paragraphs if len(x := shingle_hashes(p, RUN))]
        if h:
            h = np.concatenate(h)
            lane = (h % np.uint64(LIKENESS_LANES)).astype(np.int64)
            up = (h >> np.uint64(63)).astype(bool)
            signed = np.bincount(lane[up], minlength=LIKENESS_LANES) - np.bincount(lane[~up], minlength=LIKENESS_LANES)
            self.likeness = self.likeness + signed.astype(np.int64).astype(np.uint32)

    def hex(self) -> str:
        """The identity lanes and a hash of the likeness lanes, as text."""
        return self.identity.astype("<u8").tobytes().hex() + hashlib.blake2b(self.likeness.astype("<u4").tobytes(), digest_size=8).hexdigest()

    def similarity(self, other: Fingerprint) -> float:
        """0 to 1; 1 for equal fingerprints. Without three-word runs on either side: 1 if equal, else 0."""
        if self == other:
            return 1.0
        a, b = (x.likeness.view(np.int32).astype(np.float64) for x in (self, other))
        norm = math.sqrt(float(a @ a) * float(b @ b))
        return min(1.0, max(0.0, float(a @ b) / norm)) if norm else 0.0


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint: string, identity: array<bigint>, likeness: array<int>) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [Fingerprint.of(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f.hex() for f in fps]), pa.array([f.identity.view(np.int64) for f in fps], pa.list_(pa.int64())), pa.array([f.likeness.view(np.int32) for f in fps], pa.list_(pa.int32()))],
                ["id", "fingerprint", "identity", "likeness"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fingerprint string, identity array<bigint>, likeness array<int>")


def op4_document_fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's columns: a document beside its edited text and its successor by doc_id.

    Documents are dealt by ranges of doc_id, each range with the first row of the next, so every row meets
    its successor in one shuffle. The last document's successor is the first one; a table of one
    document is its own. Equal doc_ids are told apart by n_chars and a hash of the text; null ids come
    first. An empty table gives no rows."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"__n": F.length("text"), "__h": F.xxhash64("text")})
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = keyed.orderBy(F.col("doc_id").asc_nulls_first(), "__n", "__h").limit(1).collect()
    wrap = first[0]["text"] if first else ""
    dealt, _ = ordered_parts(keyed, ["doc_id", "__n", "__h"], ["text"], after=1)

    def rows(doc, f: Fingerprint, following: tuple[str, Fingerprint]) -> tuple:
        text = doc[1]
        n = len(text)
        edited = text[: n - n // 4] + following[0][: n // 4]
        fe = Fingerprint.of(edited)
        return doc[0], n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), f.hex(), fe.hex(), f.similarity(fe), f.similarity(following[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held = None  # (row, its fingerprint, its part): the row that waits for its successor
        for b in batches:
            kinds[0] = b.column(0).type
            out = []
            for key, text, part, halo in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                f = Fingerprint.of(text)
                if held and held[2] == part:
                    out.append(rows(held[0], held[1], (text, f)))
                elif held:
                    out.append(rows(held[0], held[1], (wrap, Fingerprint.of(wrap))))
                held = None if halo else ((key, text), f, part)
            yield _batch(out, kinds, names)
        if held:
            yield _batch([rows(held[0], held[1], (wrap, Fingerprint.of(wrap)))], kinds, names)

    return dealt.select("doc_id", "text", "part", "halo").mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _batch(out: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
