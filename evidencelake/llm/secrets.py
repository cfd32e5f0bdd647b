"""Secret scans with corpus-wide ownership frequency.

Every text is scanned for fixed credential shapes and for other token-like strings that mix letters and digits.  The
hashes of what was found are counted over the corpus by distinct repositories and owners.  A value that one owner
has in few repositories looks live; a value that is copied widely is an example.  Fixed shapes are always reported,
with their verdict; a token-like string is reported only where its ownership looks live.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, key_of

#: Kinds in the order of ties, their patterns and least lengths (of the group, or of the match).
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 or more: a run that is shorter has no match in it
KINDS = ("assign", "access", "hex")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: A token-like string: 16 or more characters of the usual alphabets.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
#: Looks live: this many owners at most, and this many repositories.
MAX_OWNERS, MAX_REPOSITORIES = 1, 3


def fixed_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the fixed shapes, by start and then by kind."""
    found = [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def token_spans(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """(start, end, "token", value) of token-like strings with a letter, a digit and eight distinct characters, outside the fixed spans."""
    out, at = [], 0
    for m in TOKEN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        value = m[0]
        mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and len(set(value)) >= 8
        over, i = False, at
        while not over and i < len(taken) and taken[i][0] < m.end():
            over, i = m.start() < taken[i][1], i + 1
        if mixed and not over:
            out.append((m.start(), m.end(), "token", value))
    return out


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string()), ("hash", pa.string())])


def scan_text(text: Column) -> Column:
    """The fixed and the token-like spans of a text, with the hash of each value."""

    @F.arrow_udf("array<struct<start:long,stop:long,kind:string,hash:string>>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for value in batch:
                plain = value.as_py() or ""
                fixed = fixed_spans(plain)
                spans = fixed + token_spans(plain, fixed)
                out.append([{"start": s, "stop": e, "kind": k, "hash": hashlib.sha256(v.encode()).hexdigest()} for s, e, k, v in spans])
            yield pa.array(out, pa.list_(_SPAN))

    return scan(text)


def ownership(found: DataFrame, *, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(hash, n_owners, n_repositories, live) from (hash, owner, repository) rows; null counts as an owner of its own.

    Counting goes by distinct triples, then by owner, then by value, each time with partial sums, so a value that
    stands in a third of all documents costs no task more than its share.
    """
    triples = found.select("hash", key_of("owner").alias("owner"), key_of("repository").alias("repository")).distinct()
    by_owner = triples.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    counted = by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    return counted.withColumn("live", live)


def scan(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    repository: str = "doc_id",
    owner: str = "source",
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """(doc_id, spans, n_fixed) for every row of ``docs``; spans array<struct<start,stop,kind,hash,n_owners,n_repositories,live>>.

    Spans are by start, then fixed kinds as listed, then "token"; code points, end exclusive.  Null text is empty and
    has no span.  Rows that repeat a doc_id are told apart by their text; equal rows have equal spans.  Nulls in
    owner or repository are one more owner or repository.  Other columns are not looked at.
    """
    scanned = cut(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.concat(key_of(doc_id), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))).alias("rid"),
            F.col(owner).alias("owner"),
            F.col(repository).alias("repository"),
            scan_text(F.col(text)).alias("found"),
        )
    )
    each = scanned.where(F.size("found") > 0).select("rid", "owner", "repository", F.explode("found").alias("s"))
    verdict = ownership(
        each.select(F.col("s.hash").alias("hash"), "owner", "repository"),
        max_owners=max_owners,
        max_repositories=max_repositories,
    )
    judged = each.select("rid", F.col("s.hash").alias("hash"), "s").distinct().join(verdict, "hash")
    keep = (F.col("s.kind") != "token") | F.col("live")
    place = F.element_at(F.create_map(*[x for i, k in enumerate((*KINDS, "token")) for x in (F.lit(k), F.lit(i))]), F.col("s.kind"))
    per_row = (
        judged.where(keep)
        .select("rid", F.struct("s.start", place.alias("place"), "s.stop", "s.kind", "hash", "n_owners", "n_repositories", "live").alias("s"))
        .groupBy("rid")
        .agg(F.array_sort(F.collect_set("s")).alias("spans"))
    )
    shape = "array<struct<start:long,place:int,stop:long,kind:string,hash:string,n_owners:long,n_repositories:long,live:boolean>>"
    spans = F.coalesce("spans", F.array().cast(shape))
    return scanned.select("doc_id", "rid").join(per_row, "rid", "left").select("doc_id", spans.alias("spans"))
