"""Best-fit packing of tokenised documents into sequences, by swap-based local search.

A document's ids, with one end id, are cut only where they exceed a sequence.  Pieces are packed where they are made: a
task packs some thousands at a time, best fit by falling length, then a local search works on the bins that are not full.
The emptiest such bin gives documents away, each step the exchange that raises the sum of squared fills most: a document
moves, or one is exchanged for one, two for one or one for two.  Bins empty in this way, until a lower bound is met or no
exchange is left.

Of each such shard only the emptiest bins travel: they meet those of other shards, are searched again as they stand, and
so on with an eighth of the pieces at most each round, until one shard is left.  Full bins never move, so the bulk of the
pieces is not shuffled, and no group holds more than some thousands of pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols, model_of
from .common import stage

CAPACITY, END = 2048, 0
#: Pieces of a shard, about.  A shard passes on an eighth of so many at most.
SHARD = 8192
#: Bins that a search looks at together, the emptiest; bins in a row that it can't empty before it ends; how far apart by
#: size two documents of a bin may be that are given for one.
WINDOW, PATIENCE, APART = 1024, 64, 8
#: Fixed value: the byte-level pre-tokenizer's pattern, as the encoder's regular expressions write it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: The same where no blank is followed by another one or by the text's end: without a look ahead, which is faster.
PLAIN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
#: Where those two differ; all that the encoder's regular expressions take for a blank is one here.
PAIRED = re.compile(r"\s(?:\s|\Z)")
#: Characters of a text that are encoded in one call; longer ones are cut where a word begins after a letter or digit.
CALL = 1 << 17
#: Runs of blanks that are too long for the encoder's regular expressions to go back over.
BLANKS = re.compile(r"\s{5000}")


@lru_cache(4)
def coder(source: str, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The encoder of a byte-level BPE tokenizer file (JSON text), whose merges stand in the order of their ids."""
    spec = json.loads(source)
    code = {s: b for b, s in enumerate(byte_symbols())}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in added}
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if made != sorted(made):
        raise ValueError("merges must stand in the order of their ids")
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks={bytes(code[c] for c in t): i for t, i in vocab.items()}, special_tokens=added)


@lru_cache(2)
def plain(source: str) -> tiktoken.Encoding:
    """The encoder for texts in which nothing is PAIRED: what lies between added tokens has at most one blank at its end, a piece of its own in both."""
    return coder(source, PLAIN)


def calls(text: str) -> Iterator[str]:
    """A text in parts that are encoded on their own: each begins with a blank between a letter or digit and a letter."""
    at = 0
    while len(text) - at > CALL:
        cut = at + CALL
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isascii() and text[cut - 1].isalnum() and text[cut + 1].isascii() and text[cut + 1].isalpha()):
            cut += 1
        if cut >= len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encoded(source: str, text: str) -> np.ndarray:
    """The ids of a text by a tokenizer file (JSON text), special tokens in it included."""
    paired = PAIRED.search(text)
    if paired and len(text) >= 5000 and BLANKS.search(text):
        return np.array(model_of(source).encode(text), np.uint32)
    model = coder(source) if paired else plain(source)
    parts = [model.encode_to_numpy(part, allowed_special="all") for part in calls(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def least_bins(size: np.ndarray, capacity: int) -> int:
    """A lower bound of the bins for these sizes.

    For each small size k: what is larger than capacity - k is alone, other large ones have a bin each, and what their
    bins can't hold of the middle sizes needs more.
    """
    count = np.bincount(size, minlength=capacity + 1)
    n, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half, k = capacity // 2, np.arange(0, capacity // 2 + 1)
    alone = n[capacity] - n[capacity - k]
    paired, held = n[capacity - k] - n[half], total[capacity - k] - total[half]
    middle = total[half] - np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    return int((alone + paired + np.maximum(0, -(-(middle - paired * capacity + held) // capacity))).max(initial=0))


def best_fit(size: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size: by falling size, each into the fullest bin that has room.  Bits of a number say which rooms there are."""
    bins, rooms, there, n = np.empty(len(size), np.int64), [[] for _ in range(capacity + 1)], 0, 0
    for at in np.argsort(-size, kind="stable").tolist():
        need = int(size[at])
        if above := there >> need:
            room = need + (above & -above).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                there ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[at] = b
        if room > need:
            rooms[room - need].append(b)
            there |= 1 << room - need
    return bins


class Exchange:
    """Bins of one shard under local search."""

    def __init__(self, size: np.ndarray, bins: np.ndarray, capacity: int):
        self.size, self.bins, self.capacity = size, bins.copy(), capacity
        self.fill = np.bincount(bins, size, bins.max(initial=-1) + 1).astype(np.int64)

    def put(self, documents: list[int], to: int) -> None:
        for d in documents:
            self.fill[self.bins[d]] -= self.size[d]
            self.fill[to] += self.size[d]
            self.bins[d] = to

    def _best(self, given: np.ndarray, taken: np.ndarray, where: np.ndarray, giver: int, room: np.ndarray) -> tuple[int, int] | None:
        """(of given, of taken) sizes whose exchange raises the sum of squared fills most; where: the bins of what is taken."""
        best, found = 0, None
        for lo in range(0, len(given), 64):  # a bounded matrix at a time
            more = given[lo : lo + 64, None] - taken[None, :]
            gain = np.where((more > 0) & (more <= room[where]), more * (self.fill[where] - self.fill[giver] + more), 0)
            if gain.size and gain.max() > best:
                at = int(gain.argmax())
                best, found = int(gain.max()), (lo + at // gain.shape[1], at % gain.shape[1])
        return found

    def step(self, giver: int) -> bool:
        """One exchange that takes tokens out of the bin; False if none raises the sum of squared fills."""
        own = np.flatnonzero(self.bins == giver)
        own = own[np.argsort(-self.size[own], kind="stable")]
        room = np.where(self.fill > 0, self.capacity - self.fill, 0)
        room[giver] = 0
        for d in own[np.unique(self.size[own], return_index=True)[1][::-1]].tolist():
            fits = np.flatnonzero((room >= self.size[d]) & (self.fill + self.size[d] > self.fill[giver]))
            if len(fits):
                self.put([d], int(fits[room[fits].argmin()]))
                return True
        others = np.flatnonzero(room[self.bins] > 0)
        singles = own[np.unique(self.size[own], return_index=True)[1]]
        if found := self._best(self.size[singles], self.size[others], self.bins[others], giver, room):
            mine, theirs = int(singles[found[0]]), int(others[found[1]])
            self._trade([mine], [theirs], giver)
            return True
        i, j = np.triu_indices(len(own), 1)
        if len(i):
            sums, first = np.unique(self.size[own[i]] + self.size[own[j]], return_index=True)
            if found := self._best(sums, self.size[others], self.bins[others], giver, room):
                at = first[found[0]]
                self._trade([int(own[i[at]]), int(own[j[at]])], [int(others[found[1]])], giver)
                return True
        ranked = others[np.lexsort((self.size[others], self.bins[others]))]
        pairs = [(ranked[:-n], ranked[n:]) for n in range(1, min(APART + 1, len(ranked)))]
        i, j = (np.concatenate([p[side] for p in pairs]) if pairs else np.empty(0, np.int64) for side in (0, 1))
        same = self.bins[i] == self.bins[j]
        i, j = i[same], j[same]
        if found := self._best(self.size[singles], self.size[i] + self.size[j], self.bins[i], giver, room):
            self._trade([int(singles[found[0]])], [int(i[found[1]]), int(j[found[1]])], giver)
            return True
        return False

    def _trade(self, mine: list[int], theirs: list[int], giver: int) -> None:
        to = int(self.bins[theirs[0]])
        self.put(theirs, giver)
        self.put(mine, to)

    def run(self, least: int) -> np.ndarray:
        """The bins after the search, which ends at ``least`` of them.  Each step raises the sum of squared fills, so it ends."""
        stuck, in_vain = self.fill >= self.capacity, 0
        while int((self.fill > 0).sum()) > least and in_vain < PATIENCE:
            left = np.flatnonzero(~stuck & (self.fill > 0))
            if not len(left):
                break
            giver = int(left[self.fill[left].argmin()])
            room = int((self.capacity - self.fill[self.fill > 0]).sum()) - self.capacity + int(self.fill[giver])
            if self.fill[giver] > room:
                break  # the other bins can't hold it, nor any fuller one
            while self.fill[giver] and self.step(giver):
                pass
            stuck[giver] = True
            in_vain = in_vain + 1 if self.fill[giver] else 0
        return self.bins


def searched(size: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Local search among the emptiest bins, again as long as bins empty."""
    least = least_bins(size, capacity)
    while True:
        names, bins = np.unique(bins, return_inverse=True)
        fill = np.bincount(bins, size)
        if len(names) <= least:
            return bins
        some = np.zeros(len(names), bool)
        some[np.argsort(fill, kind="stable")[:WINDOW]] = True
        at = np.flatnonzero(some[bins])
        own, inside = np.unique(bins[at], return_inverse=True)
        moved = bins.copy()
        moved[at] = own[Exchange(size[at], inside, capacity).run(least - (len(names) - len(own)))]
        if len(np.unique(moved)) == len(names):
            return moved
        bins = moved


def settled(size: np.ndarray, start: np.ndarray | None, capacity: int) -> np.ndarray:
    """The bin of each size: local search from ``start`` or from best fit, whichever has fewer bins, then more squared fill."""
    options = [best_fit(size, capacity)] if start is None else [start, best_fit(size, capacity)]
    worth = lambda bins: (-len(np.unique(bins)), int((np.bincount(bins, size) ** 2).sum()))
    return searched(size, max(options, key=worth), capacity)


COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")


def placed(pieces: dict[str, list], start: np.ndarray | None, capacity: int, first: int, passed: int) -> tuple[dict[str, list], int]:
    """Pieces with sequence_id (from ``first`` on), offset and whether their bin is ``open``: one of the emptiest, ``passed`` pieces in all at most; and the next free number."""
    size = np.array(pieces["length"], np.int64)
    bins = settled(size, start, capacity)
    order = np.lexsort((np.arange(len(size)), bins))
    bins, size = bins[order], size[order]
    number = np.unique(bins, return_inverse=True)[1]
    fill, count = np.bincount(number, size).astype(np.int64), np.bincount(number)
    ends = np.cumsum(size)
    offset = ends - size - np.concatenate([[0], np.cumsum(fill)])[number]
    open_ = np.zeros(len(fill), bool)
    emptiest = np.argsort(fill, kind="stable")
    emptiest = emptiest[fill[emptiest] < capacity]
    open_[emptiest[np.cumsum(count[emptiest]) <= passed]] = True
    out = {c: [v[i] for i in order.tolist()] for c, v in pieces.items()}
    return out | {"sequence_id": (first + number).tolist(), "offset": offset.tolist(), "open": open_[number].tolist()}, first + len(fill)


def pack(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end: int = END, text: str = "text", doc_id: str = "doc_id", shard: int = SHARD) -> DataFrame:
    """(doc_id, piece int, start, length, ids_crc32, sequence_id, offset long): a row for each piece of each row of ``docs``.

    ``path`` is a byte-level BPE tokenizer file.  A row's ids, then ``end``, are one piece if they fit into ``capacity``; else
    pieces of ``capacity`` of which the first may be shorter.  Null and empty texts are a piece of the end id alone.  Null,
    shared and repeated ids are ids like any other: each row of ``docs`` is a document of its own.  Very long texts are
    encoded in parts of bounded size.  An empty table gives no rows; other columns are not looked at.  Sequences are
    gapless from offset 0; their numbers follow from where pieces are read, so they may differ between runs.
    """
    with open(path, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"
    passed = shard // 8

    def batch_of(made: dict[str, list], like: pa.Schema) -> pa.RecordBatch:
        types = {"doc_id": like.field("doc_id").type, "piece": pa.int32(), "open": pa.bool_()}
        return pa.RecordBatch.from_pydict({c: pa.array(v, types.get(c, pa.int64())) for c, v in made.items()})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting, like = {c: [] for c in COLUMNS}, None
        for batch in batches:
            like = batch.schema
            for one, value in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.append(encoded(source.value, value.as_py() or ""), end).astype("<u4")
                at = 0
                for piece in range(-(-len(ids) // capacity)):
                    to = (len(ids) - 1) % capacity + 1 + piece * capacity
                    for c, v in zip(COLUMNS, (one, piece, at, to - at, zlib.crc32(ids[at:to])), strict=True):
                        waiting[c].append(v)
                    at = to
            while len(waiting["doc_id"]) >= shard:
                some = {c: v[:shard] for c, v in waiting.items()}
                waiting = {c: v[shard:] for c, v in waiting.items()}
                made, number = placed(some, None, capacity, number, passed)
                yield batch_of(made, like)
        if waiting["doc_id"]:
            yield batch_of(placed(waiting, None, capacity, number, passed)[0], like)

    def again(turn: int, last: bool):
        def searched_again(part: pa.Table) -> pa.Table:
            rows = part.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
            start = np.unique(rows["sequence_id"].to_numpy(), return_inverse=True)[1]
            first = turn << 56 | rows["part"][0].as_py() << 32
            made, _ = placed({c: rows[c].to_pylist() for c in COLUMNS}, start, capacity, first, 0 if last else passed)
            return pa.Table.from_batches([batch_of(made, part.schema)])

        return searched_again

    done, turn = [], 0
    some = stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, shape))
    while True:
        done.append(some.where("not open"))
        groups = -(-some.where("open").count() // shard)
        if not groups:
            break
        turn += 1

        part = F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("part")
        some = stage(some.where("open").select("*", part).groupBy("part").applyInArrow(again(turn, groups == 1), shape))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.drop("open")
