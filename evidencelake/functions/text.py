"""Text expressions: digests, tokens, splits and hashed features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters of any script; the engine's own \\w is ASCII.
TOKEN = r"[\p{L}\p{N}_]+"
#: A run of word characters, or one character that is neither that nor a blank of any script.
MARKS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x{85}]"
#: The splits of the hundred buckets.
SPLITS = (("train", 70), ("tune", 80), ("calibration", 90), ("test", 100))


def digest(text: Column) -> Column:
    """SHA-256 of the exact UTF-8 text, lower-case hex."""
    return F.sha2(text, 256)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """The set of tokens."""
    return F.array_distinct(tokens(text))


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one blank."""
    return F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")


def head_number(hex_digest: Column) -> Column:
    """The first 32 bits of a hex digest as a number."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long")


def bucket(text: Column) -> Column:
    """0 to 99, from the digest of the normalised text: equal for texts that differ in case or spacing only."""
    return head_number(digest(normalised(text))) % 100


def split_of(number: Column) -> Column:
    out = F.lit(SPLITS[-1][0])
    for name, end in reversed(SPLITS[:-1]):
        out = F.when(number < end, name).otherwise(out)
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all words of two sets; 0 for two empty ones."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def lexical_features(query: Column, words_: Column, base: Column, size: Column) -> dict[str, Column]:
    """Query recall, Jaccard, base score, size share and full cover, from word sets."""
    shared = F.size(F.array_intersect(query, words_))
    return {
        "recall": shared / F.greatest(F.size(query), F.lit(1)),
        "jaccard": jaccard(query, words_),
        "base": base,
        "size_share": F.least(size / F.lit(65536.0), F.lit(1.0)),
        "full_cover": F.when((F.size(query) > 0) & (shared == F.size(query)), 1.0).otherwise(0.0),
    }


def hashed_features(text: Column) -> Column:
    """Signed-hash features of a text: unigrams as "t:a", pairs of neighbours as "b:a\\0b", repeats included."""
    marks = F.regexp_extract_all(text, F.lit(MARKS), F.lit(0))
    pairs = F.zip_with(F.slice(marks, 1, F.greatest(F.size(marks) - 1, F.lit(0))), F.slice(marks, 2, F.greatest(F.size(marks), F.lit(1))), lambda a, b: F.concat(F.lit("b:"), a, F.lit("\0"), b))
    return F.concat(F.transform(marks, lambda a: F.concat(F.lit("t:"), a)), pairs)


def slot_and_sign(feature: Column, dim: int) -> tuple[Column, Column]:
    """The slot of a feature and its sign, from the digest's first five bytes."""
    h = digest(feature)
    return head_number(h) % dim, F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
