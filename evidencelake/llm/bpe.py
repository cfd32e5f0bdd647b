"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is split at the special tokens, then into pieces by the tokenizer's fixed pattern; a piece's bytes are merged
on their own.  The leaves of a segment tree hold the rank of each symbol's pair with its right neighbour, inner nodes
the least rank below.  The root gives the lowest rank and the leftmost place that has it; a merge changes three leaves,
a logarithmic update; merging ends when the root holds no rank.  A piece of n bytes takes O(n log n), however long.
Most pieces are short, so those that a worker doesn't know yet are merged many at once: a row of numpy arrays each.

The tokenizer file is read once by the driver; its fixed-size text is broadcast.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the byte-level pre-tokenizer's pattern.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The same for texts of plain characters only, in the faster module: there letters, digits and blanks are these.
_BLANK, _ALPHA = r"\t-\r ", "a-zA-ZÀ-ÖØ-öø-ſ"
PLAIN = re.compile(rf"[\0-\x84\x86-\x9f¡-©«-±´¶-¸»¿-ſ‐-‧]*")
PLAIN_PIECES = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_ALPHA}]+| ?[0-9]+| ?[^{_BLANK}{_ALPHA}0-9]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
#: Pieces whose ids a worker keeps, and the longest that it keeps: about 90 MB at most.
#: There are two generations: a full one becomes the old one, and what is met again moves on.
KEPT, KEPT_CHARS = 150_000, 64
#: Pieces of more bytes are merged one by one.
WIDEST = 64
#: Characters of the texts that are split and looked up together, a longer text on its own.
TOGETHER = 1 << 20
#: The rank of a pair that doesn't merge, above all others.
NO_RANK = 1 << 24


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself where printable, else from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + others.index(b)) for b in range(256)]


class RankTree:
    """Least value over a row of ranks.  A value is rank * half + place, so equal ranks go leftmost first.

    Leaves are put first, then the nodes above them are made again.
    """

    def __init__(self, ranks: list[int]):
        n = len(ranks)
        self.half = half = 1 << (n - 1).bit_length()
        level = [r * half + i for i, r in enumerate(ranks)] + [NO_RANK * half] * (half - n)
        self.tree = level
        while half > 1:
            level = list(map(min, level[::2], level[1::2]))
            self.tree = level + self.tree
            half >>= 1
        self.tree.insert(0, 0)

    def refresh(self, low: int, mid: int, high: int) -> None:
        """Make the inner nodes above three changed places again, low to high; where their paths meet, once."""
        tree, half = self.tree, self.half
        low, mid, high = (low + half) >> 1, (mid + half) >> 1, (high + half) >> 1
        while low != high:
            for node in (low, high) if mid == low or mid == high else (low, mid, high):
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b
            low, mid, high = low >> 1, mid >> 1, high >> 1
        while low:
            a, b = tree[2 * low], tree[2 * low + 1]
            value = a if a < b else b
            if tree[low] == value:
                return
            tree[low] = value
            low >>= 1


class RankTrees:
    """One RankTree for each row of ``ranks``, as one array for each level from the leaves up."""

    def __init__(self, ranks: np.ndarray):
        self.width = ranks.shape[1]
        self.levels = [ranks * self.width + np.arange(self.width)]
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:, ::2], below[:, 1::2]))

    def put(self, rows: np.ndarray, places: np.ndarray, ranks: np.ndarray | int) -> None:
        self.levels[0][rows, places] = ranks * self.width + places

    def refresh(self, rows: np.ndarray, places: np.ndarray) -> None:
        for below, level in zip(self.levels, self.levels[1:]):
            places = places >> 1
            level[rows, places] = np.minimum(below[rows, 2 * places], below[rows, 2 * places + 1])


class ByteBpe:
    """Encoder and decoder of a byte-level BPE tokenizer file (JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        kind, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
            raise ValueError("a byte-level tokenizer without normalizer and prefix space is needed")
        symbols = byte_symbols()
        code = {s: b for b, s in enumerate(symbols)}
        vocab = model["vocab"]
        self.bytes_of = {i: bytes(code[c] for c in token) for token, i in vocab.items()}
        self.byte_ids = [vocab[s] for s in symbols]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = 1 + max(self.bytes_of)
        self.rank_of = {vocab[a] * self.size + vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.merged = [vocab[a + b] for a, b in merges]
        self.pair_keys = np.array(sorted(self.rank_of), np.int64)
        self.pair_ranks = np.array([self.rank_of[k] for k in self.pair_keys.tolist()], np.int64)
        self.merged_ids = np.array(self.merged, np.int64)
        self.byte_ranks = [self.rank_of.get(a * self.size + b, NO_RANK) for a in self.byte_ids for b in self.byte_ids]
        self.added = {}
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError("added tokens must match as they stand")
            self.added[t["content"]] = t["id"]
            self.bytes_of[t["id"]] = t["content"].encode()
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.special_pieces = {t: self._made([i], t) for t, i in self.added.items()}
        self.kept: dict[str, tuple[bytes, str, str]] = {}
        self.old: dict[str, tuple[bytes, str, str]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        ids = list(map(self.byte_ids.__getitem__, data))
        n, rank, size, merged_of, first = len(ids), self.rank_of.get, self.size, self.merged, self.byte_ranks
        if n < 2:
            return ids
        ranks = RankTree([first[a << 8 | b] for a, b in zip(data, data[1:])] + [NO_RANK])
        tree, half, refresh = ranks.tree, ranks.half, ranks.refresh
        none = NO_RANK * half
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (least := tree[1]) < none:
            i = h = least & half - 1
            j = after[i]
            k = after[i] = after[j]
            ids[i] = merged = merged_of[least // half]
            ids[j] = -1
            tree[half + j] = none + j
            if k < n:
                before[k] = i
                tree[half + i] = rank(merged * size + ids[k], NO_RANK) * half + i
            else:
                tree[half + i] = none + i
            if before[i] >= 0:
                h = before[i]
                tree[half + h] = rank(ids[h] * size + merged, NO_RANK) * half + h
            refresh(h, i, j)
        return [i for i in ids if i >= 0]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)

    def merge_rows(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """The ids of each of some pieces of 1 to ``width`` bytes, a power of two."""
        count = np.fromiter(map(len, pieces), np.int64, len(pieces))
        inside = np.arange(width) < count[:, None]
        data = np.zeros((len(pieces), width), np.int64)
        data[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.where(inside, np.array(self.byte_ids)[data], -1)
        paired = np.where(inside[:, 1:], np.array(self.byte_ranks)[data[:, :-1] << 8 | data[:, 1:]], NO_RANK)
        trees = RankTrees(np.pad(paired, ((0, 0), (0, 1)), constant_values=NO_RANK))
        # links to the next and the last symbol; the column after the last takes what is written beyond the ends
        after, before = np.tile(np.arange(1, width + 2), (len(pieces), 1)), np.tile(np.arange(-1, width), (len(pieces), 1))
        while len(rows := np.flatnonzero((root := trees.levels[-1][:, 0]) < NO_RANK * width)):
            rank, i = np.divmod(root[rows], width)
            merged, j = self.merged_ids[rank], after[rows, i]
            k, h = after[rows, j], before[rows, i]
            ids[rows, i], ids[rows, j], after[rows, i], before[rows, k] = merged, -1, k, i
            trees.put(rows, j, NO_RANK)
            more = k < count[rows]
            trees.put(rows, i, np.where(more, self.ranks(merged, ids[rows, np.where(more, k, 0)]), NO_RANK))
            less = np.flatnonzero(h >= 0)
            trees.put(rows[less], h[less], self.ranks(ids[rows[less], h[less]], merged[less]))
            trees.refresh(rows, j)
            trees.refresh(rows, i)
            trees.refresh(rows[less], h[less])
        ends = np.cumsum((ids >= 0).sum(axis=1)).tolist()
        flat = ids[ids >= 0].tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece, in the order given."""
        out: list[list[int]] = [[]] * len(pieces)
        widths: dict[int, list[int]] = {}
        for at, piece in enumerate(pieces):
            widths.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(at)
        for width, places in widths.items():
            some = [pieces[at] for at in places]
            for at, ids in zip(places, self.merge_rows(some, width) if width <= WIDEST else map(self.merge, some)):
                out[at] = ids
        return out

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def split(self, text: str) -> list[str]:
        """The special tokens and the pieces of a text, in order."""
        out = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                out.append(part)
            elif part:
                out += (PLAIN_PIECES if PLAIN.fullmatch(part) else PIECES).findall(part)
        return out

    def pieces(self, texts: list[str]) -> Iterator[list[tuple[bytes, str, str]]]:
        """For each text (ids as 32-bit numbers, ids as decimals, what they decode to) of each of its pieces, in order.

        A piece is made of whole characters, so pieces decode on their own.
        """
        names = [self.split(text) for text in texts]
        here = self._known(set().union(*names))
        for some in names:
            yield list(map(here.__getitem__, some))

    def _made(self, ids: list[int], name: str) -> tuple[bytes, str, str]:
        back = self.decode(ids)
        # an equal text is kept once
        return array("i", ids).tobytes(), ",".join(map(str, ids)), name if back == name else back

    def _known(self, names: set[str]) -> dict[str, tuple[bytes, str, str]]:
        """What pieces come to, by name; those that are new are merged together and kept for the next texts."""
        kept = self.kept
        here = {name: kept[name] for name in names if name in kept}
        met = {name: self.old[name] for name in names if name not in here and name in self.old}
        met |= {name: made for name, made in self.special_pieces.items() if name in names}
        new = [name for name in names if name not in here and name not in met]
        met |= {name: self._made(ids, name) for name, ids in zip(new, self.merge_all([name.encode() for name in new]))}
        for name, made in met.items():
            if len(name) <= KEPT_CHARS:
                if len(self.kept) >= KEPT:
                    self.old, self.kept = self.kept, {}
                self.kept[name] = made
        return here | met

    def encode(self, text: str) -> list[int]:
        return array("i", b"".join([p[0] for p in next(self.pieces([text]))])).tolist()


@lru_cache(2)
def model_of(source: str) -> ByteBpe:
    """One worker's model, kept from task to task with what it knows of pieces."""
    return ByteBpe(source)


def _coded(model: ByteBpe, batch: pa.Array) -> Iterator[tuple[str, list[tuple[bytes, str, str]]]]:
    """Each text of a batch (null: empty) with its pieces."""
    texts, chars = [], 0
    for at, value in enumerate(batch):
        texts.append(value.as_py() or "")
        chars += len(texts[-1])
        if chars >= TOGETHER or at == len(batch) - 1:
            yield from zip(texts, model.pieces(texts))
            texts, chars = [], 0


def _broadcast(frame: DataFrame, path: str):
    with open(path, encoding="utf-8") as file:
        return frame.sparkSession.sparkContext.broadcast(file.read())


def _lists(parts: list[bytes]) -> pa.Array:
    """Rows of 32-bit numbers, each given as bytes, as one array of lists."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """Add ``ids`` array<int> to ``docs``: the ids of each whole text.  Null and empty texts have none.

    A column of that name is replaced; others, and repeated rows, pass through.
    """
    source = _broadcast(docs, path)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of(source.value)
        for batch in batches:
            yield _lists([b"".join([p[0] for p in parts]) for _, parts in _coded(model, batch)])

    return docs.withColumn("ids", ids(F.col(text)))


def round_trip(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """Add ``ids`` array<int>, and ``round_trip`` boolean: whether decoding them gives the text (null: empty) again.

    encode() and decode() in one pass, so that no decoded text leaves the worker.  Columns of these names are replaced;
    others, and repeated rows, pass through.
    """
    source = _broadcast(docs, path)
    shape = [pa.field("ids", pa.list_(pa.int32())), pa.field("same", pa.bool_())]

    @F.arrow_udf("struct<ids:array<int>,same:boolean>")
    def checked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of(source.value)
        for batch in batches:
            ids, same = [], []
            for plain, parts in _coded(model, batch):
                ids.append(b"".join([p[0] for p in parts]))
                same.append("".join([p[2] for p in parts]) == plain)
            yield pa.StructArray.from_arrays([_lists(ids), pa.array(same, pa.bool_())], fields=shape)

    made = docs.drop("ids", "round_trip").withColumn("__c", checked.asNondeterministic()(F.col(text)))
    return made.select("*", "__c.ids", F.col("__c.same").alias("round_trip")).drop("__c")


def decode(coded: DataFrame, path: str, *, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` string to rows with ids.  Null ids give an empty text."""
    source = _broadcast(coded, path)

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of(source.value)
        for batch in batches:
            yield pa.array([model.decode(v.as_py() or []) for v in batch], pa.string())

    return coded.withColumn("decoded", texts(F.col(ids)))


def digest(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` to ``docs``: encode() and decode() in one pass.

    ids are joined by commas as decimals.  Null text is empty: no tokens, digests of empty strings.  Columns of these
    names are replaced; others, and repeated rows, pass through.
    """
    source = _broadcast(docs, path)
    shape = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of(source.value)
        for batch in batches:
            out = []
            for _, parts in _coded(model, batch):
                joined = ",".join([p[1] for p in parts])
                back = "".join([p[2] for p in parts])
                out.append((joined.count(",") + bool(joined), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            n, a, b = zip(*out, strict=True) if out else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], fields=list(shape))

    made = docs.drop("n_tokens", "ids_sha256", "decoded_sha256").withColumn("__d", digests.asNondeterministic()(F.col(text)))
    return made.select("*", "__d.n_tokens", "__d.ids_sha256", "__d.decoded_sha256").drop("__d")
