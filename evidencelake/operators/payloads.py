"""JSON texts as expressions: strings and headers as they are written, packet chunks, and a strict reader of portable payloads."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stamps import Family, is_stamp

#: The name of the portable form, its greatest size in bytes, and how a view is named.
PORTABLE, MOST_BYTES, VIEW = "scqr1", 8192, r"^[a-z][a-z0-9_]{0,31}$"
#: Control characters that JSON writes as a letter.
SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\"}


def json_string(text: Column, *, ascii_only: bool = True) -> Column:
    """A text as a JSON string; null for null.

    Quotes, backslashes and control characters are escaped, and with ``ascii_only`` all that isn't printable ASCII, as
    the four-digit codes of its UTF-16 units.  A text without any of these is taken as it is.
    """
    odd = r'[^\x20-\x7e]|["\\]' if ascii_only else r'[\x00-\x1f"\\]'
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def written(ch: Column) -> Column:
        n = F.ascii(ch)
        above = n - 0x10000
        pair = F.concat(unit(F.shiftright(above, 10) + 0xD800), unit(above.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
        out = F.when(n < 0x20, unit(n)).when(~F.lit(ascii_only) | n.between(0x20, 0x7E), ch).when(n < 0x10000, unit(n)).otherwise(pair)
        short = F.create_map(*[F.lit(x) for item in SHORT.items() for x in item])
        return F.coalesce(F.try_element_at(short, ch), out)

    escaped = F.array_join(F.transform(F.filter(F.split(text, ""), lambda ch: ch != ""), written), "")
    return F.concat(F.lit('"'), F.when(text.rlike(odd), escaped).otherwise(text), F.lit('"'))


def header(fields: dict[str, Column], *, ascii_only: bool = True) -> Column:
    """A one-line JSON object of string fields in the order given; a field that is null makes it null."""
    parts = [F.concat(F.lit(", " if i else ""), json_string(F.lit(k), ascii_only=ascii_only), F.lit(": "), json_string(v, ascii_only=ascii_only)) for i, (k, v) in enumerate(fields.items())]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def evidence_chunk(source: Column, digest: Column, text: Column) -> Column:
    """How a selected item stands in a packet: its header, a line end and its text."""
    return F.concat(header({"source": source, "sha256": digest}, ascii_only=False), F.lit("\n"), text)


def handoff_header(source: Column, revision: Column, digest: Column) -> Column:
    """The header of a node in a handoff, with the line end."""
    return F.concat(header({"revision": revision, "sha256": digest, "source": source}), F.lit("\n"))


def chunk_fields(chunk: Column) -> Column:
    """struct<fields map<string,string>, text> of a chunk; null where its first line is no JSON object of strings without repeated keys."""
    head = F.substring_index(chunk, "\n", 1)
    parts = lambda fields: F.struct(fields.alias("fields"), F.substr(chunk, F.length(head) + 2).alias("text"))
    return _let(_strings(_object(F.when(chunk.contains("\n"), head))), lambda fields: F.when(fields.isNotNull(), parts(fields)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is worked out once, however often the expression names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _object(text: Column) -> Column:
    """The JSON object that a whole text is, as a map of variants; null for anything else, and where a key repeats at any depth.

    The reader stops after the first value, so the text is read inside a list and inside an object: what may follow the
    value in one may not in the other.  Blanks around it are taken off first.
    """
    bare = F.trim(text)
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), bare, F.lit("]"))), "$", "array<variant>")
    inside = F.try_parse_json(F.concat(F.lit('{"p":'), bare, F.lit("}")))
    return _let(listed, lambda items: F.when((F.size(items) == 1) & inside.isNotNull(), _fields(F.get(items, F.lit(0)))))


def _fields(value: Column) -> Column:
    """A variant as a map of its keys; null unless it is an object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _strings(values: Column) -> Column:
    """A map of variants as a map of strings; null unless all are strings."""
    good = lambda found: F.forall(F.map_values(found), lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
    return _let(values, lambda found: F.when(good(found), F.transform_values(found, lambda _, v: F.try_variant_get(v, "$", "string"))))


def portable(views: dict[str, Column]) -> Column:
    """The portable text of one to eight named stamps: keys sorted, no blanks.  Null if a stamp is null."""
    if not 1 <= len(views) <= 8:
        raise ValueError("one to eight views")
    named = [F.concat(F.lit("," if i else ""), json_string(F.lit(n)), F.lit(":"), json_string(views[n])) for i, n in enumerate(sorted(views))]
    return F.concat(F.lit(f'{{"format":"{PORTABLE}","views":{{'), *named, F.lit("}}"))


def parse_portable(text: Column) -> Column:
    """map<string, string> of names to stamps' texts of a portable text; null unless it is exactly that.

    Refused are more than 8192 bytes, keys that repeat at any depth, keys other than format and views, another format,
    none or more than eight views, names that aren't a lower case letter and up to 31 letters, digits or _, and values
    that aren't stamps.  Keys may stand in any order and blanks between them.
    """
    names = F.array(F.lit("format"), F.lit("views"))
    kind, named = (lambda whole, n=n: F.try_element_at(whole, F.lit(n)) for n in ("format", "views"))

    def views(whole: Column) -> Column:
        said = (F.schema_of_variant(kind(whole)) == "STRING") & (F.try_variant_get(kind(whole), "$", "string") == PORTABLE)
        return F.when((F.array_sort(F.map_keys(whole)) == names) & said, _fields(named(whole)))

    def checked(stamps: Column) -> Column:
        good = F.size(stamps).between(1, 8) & F.forall(F.map_keys(stamps), lambda n: n.rlike(VIEW)) & F.forall(F.map_values(stamps), is_stamp)
        return F.when(good, stamps)

    return _let(_strings(_let(_object(F.when(F.octet_length(text) <= MOST_BYTES, text)), views)), checked)


def canonical(stamps: Column) -> Column:
    """The portable text of a map that parse_portable() gave."""
    named = F.transform(F.array_sort(F.map_keys(stamps)), lambda n: F.concat(json_string(n), F.lit(":"), json_string(F.element_at(stamps, n))))
    return F.concat(F.lit(f'{{"format":"{PORTABLE}","views":{{'), F.array_join(named, ","), F.lit("}}"))


#: The parts of a computation's identity that name something, and how many sources it may have.
NAMED, MOST_SOURCES = ("tenant", "principal", "model", "prompt", "tool", "policy"), 128
HEX_DIGEST = "^[0-9a-f]{64}$"


def identifier(text: Column) -> Column:
    """Whether a text may name something: 1 to 512 bytes, no control characters."""
    return F.coalesce(F.octet_length(text).between(1, 512) & ~text.rlike(r"[\x00-\x1f\x7f]"), F.lit(False))


def computation_identity(parts: dict[str, Column], request: Column, sources: Column) -> Column:
    """What exact reuse of a result is keyed by: the digest of all that it depends on; null for a malformed part.

    ``parts`` has tenant, principal, model, prompt, tool and policy; ``request`` is a digest and ``sources``
    array<struct<id, revision, digest>>, 1 to 128 of different ids, in any order.
    """
    if set(parts) != set(NAMED):
        raise ValueError(f"the parts are {', '.join(NAMED)}")
    listed = F.transform(F.array_sort(sources), lambda s: F.concat(F.lit("["), json_string(s["id"]), F.lit(","), json_string(s["revision"]), F.lit(","), json_string(s["digest"]), F.lit("]")))
    fields = {**{n: json_string(c) for n, c in parts.items()}, "request": json_string(request), "sources": F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]"))}
    written = F.concat(F.lit("{"), *[F.concat(F.lit(("," if i else "") + json.dumps(n) + ":"), fields[n]) for i, n in enumerate(sorted(fields))], F.lit("}"))
    ids = F.transform(sources, lambda s: s["id"])
    fine = F.size(sources).between(1, MOST_SOURCES) & (F.size(F.array_distinct(ids)) == F.size(ids)) & request.rlike(HEX_DIGEST)
    fine = fine & F.forall(sources, lambda s: identifier(s["id"]) & identifier(s["revision"]) & F.coalesce(s["digest"].rlike(HEX_DIGEST), F.lit(False)))
    for column in parts.values():
        fine = fine & identifier(column)
    return F.when(fine, F.sha2(written, 256))


def policy_scope(scope: str, families: dict[str, Family], weights: dict[str, float]) -> str:
    """What a calibrated policy is bound to: an application's scope, and the views, families and weights of its queries.

    Weights are positive and are brought to a sum of one.  No query's values are in it.
    """
    if not scope or set(weights) != set(families) or not all(0 < w < float("inf") for w in weights.values()):
        raise ValueError("a scope, and a positive weight for each view")
    total = sum(weights[n] for n in sorted(weights))
    views = [[n, families[n].identity, families[n].bits] for n in sorted(families)]
    named = [scope, views, [[n, weights[n] / total] for n in sorted(weights)]]
    return "facet-query:" + hashlib.sha256(json.dumps(named, separators=(",", ":")).encode()).hexdigest()


def profile_identity(normalization: str, semantic_weight: float) -> str:
    """What a fusion profile is told apart by."""
    return hashlib.sha256(json.dumps({"normalization": normalization, "semantic_weight": semantic_weight}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
