"""Language identification with hyperdimensional profiles.

Every letter has a seeded random vector of plus and minus ones.  A letter triple is bound to one vector: the product
of its letters' vectors, each permuted by its place.  A text's vector bundles (adds) those of its triples; a language's
prototype bundles those of its learning texts, each text with the same weight.  A text gets the language whose
prototype has the largest cosine with the text's vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 512
SEED = 20240229
#: Weight of one learning text, dealt over its triples in whole units so that sums are exact in any order.
UNITS = 1 << 20
#: Triples whose vectors a worker keeps; beyond it starts anew.
KEPT = 1 << 15
#: Learning texts, at most: those of the smallest hashed texts.
MAX_TEXTS = 20_000

@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def triples(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct letter triples of a text as packed code points, and their counts.  Words get a blank around."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32) if text else np.empty(0, np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    code = np.where(letter, code, 32).astype(np.uint64)
    kept = letter.copy()
    kept[0] = True
    kept[1:] |= letter[:-1]  # of blanks in a row the first
    code = code[kept]
    if code[1] == 32:  # a blank was put before another one
        code = code[1:]
    keys = code[:-2] << 42 | code[1:-1] << 21 | code[2:]
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


class TripleVectors:
    """The bound vectors of letter triples, kept while there is room."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.letters: dict[int, np.ndarray] = {}
        self._clear()

    def _clear(self) -> None:
        self.places: dict[int, int] = {}
        self.rows = np.empty((1024, self.dim), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 4096:
                self.letters.clear()
            bits = np.random.Generator(np.random.PCG64([self.seed, code])).integers(0, 2, self.dim, dtype=np.int8)
            self.letters[code] = bits * 2 - 1
        return self.letters[code]

    def bound(self, key: int) -> np.ndarray:
        low = (1 << 21) - 1
        first, second, third = (self.letter(key >> s & low) for s in (42, 21, 0))
        return np.roll(first, 2) * np.roll(second, 1) * third

    def bundle(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The weighted sum of the triples' vectors, exact."""
        total = np.zeros(self.dim)
        for at in range(0, len(keys), 2048):  # bounded memory for texts of any length
            part = keys[at : at + 2048].tolist()
            if len(self.places) + len(part) > KEPT:
                self._clear()
            at_rows = list(map(self.places.get, part))
            if None in at_rows:
                for k in part:
                    if k not in self.places:
                        n = len(self.places)
                        if n == len(self.rows):
                            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
                        self.rows[n] = self.bound(k)
                        self.places[k] = n
                at_rows = [self.places[k] for k in part]
            rows = self.rows[at_rows]
            w = weights[at : at + 2048]
            kind = np.float32 if int(w.sum()) < 1 << 24 else np.float64  # both exact
            total += w.astype(kind) @ rows.astype(kind)
        return total


def learn(labelled: DataFrame, *, dim: int = DIM, seed: int = SEED, max_texts: int = MAX_TEXTS) -> dict[str, list[float]]:
    """Language prototypes from (text, lang) rows: about ``max_texts`` of them at most, chosen by hashed text.

    Tasks bundle their rows by language; bundles are added by Spark.  What comes back is one vector per language.
    Rows with null lang, or without a letter, teach nothing.
    """

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = _vectors(dim, seed), {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = triples(text)
                if len(keys):
                    weights = counts * UNITS // counts.sum()
                    sums[lang] = sums.get(lang, 0) + vectors.bundle(keys, weights)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"lang": [lang] * dim, "place": list(range(dim)), "value": total.astype(np.int64)},
                pa.schema([("lang", pa.string()), ("place", pa.int32()), ("value", pa.int64())]),
            )

    known = labelled.where("lang is not null and text is not null").select("text", "lang")
    part = min(1.0, max_texts / max(1, known.count()))
    if part < 1:
        known = known.where(F.shiftrightunsigned(F.xxhash64("text"), 1) < F.lit(int(part * (1 << 63))))
    rows = (
        known.mapInArrow(bundles, "lang string, place int, value long")
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("place", "value")))["value"].alias("values"))
        .collect()
    )
    return {r["lang"]: [float(v) for v in r["values"]] for r in sorted(rows, key=lambda r: r["lang"])}


@lru_cache(2)
def _vectors(dim: int, seed: int) -> TripleVectors:
    """One worker's vectors, kept from task to task."""
    return TripleVectors(dim, seed)


def predict(docs: DataFrame, prototypes: dict[str, list[float]], *, dim: int = DIM, seed: int = SEED, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (cosine with the prototype, 0 to 1) to ``docs``.

    ``und`` with score 0 where the text is null, empty or has no letter, or no language was learned.  Equal cosines
    go to the language that is first by name.  Columns of these two names are replaced.
    """
    names = sorted(prototypes)
    table = np.array([prototypes[n] for n in names], dtype=np.float64).reshape(len(names), dim)
    table = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-300)
    schema = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors = _vectors(dim, seed)
        for batch in batches:
            out = []
            for value in batch:
                keys, counts = triples(value.as_py())
                vector = vectors.bundle(keys, counts) if len(keys) and names else np.zeros(dim)
                norm = np.sqrt(vector @ vector)
                if norm == 0:
                    out.append({"lang_pred": "und", "score": 0.0})
                    continue
                cosine = table @ vector / norm
                best = int(np.argmax(cosine))
                out.append({"lang_pred": names[best], "score": float(min(1.0, max(0.0, cosine[best])))})
            yield pa.array(out, schema)

    # not deterministic for the optimiser: else a later filter on the guess would make it a second time
    guess = docs.drop("lang_pred", "score").withColumn("__guess", classify.asNondeterministic()(F.col(text)))
    return guess.select("*", "__guess.lang_pred", "__guess.score").drop("__guess")
