"""Small declared grammars: claims, packets, assignments, token pairs and exact decimals.  What doesn't parse is null."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, Inexact, InvalidOperation, localcontext

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_W = r"[\p{L}\p{N}_]+"
#: How a text of claims begins, in either form, and how it goes on.
CONFIGURED = rf"^For ({_W}), configure ({_W}): (\p{{Nd}}+) ({_W})"
STATED = rf"^({_W}) ({_W}) is (\p{{Nd}}+) ({_W})"
ALSO = rf"; ({_W}) is (\p{{Nd}}+) ({_W})"
#: The sources of a packet and the name that each assigns.
FIELDS = {"config": "training_batch_size", "schedule": "gradient_accumulation_steps"}
#: Fixed value: digits of exact results.
DIGITS = 64


def claims(text: Column) -> Column:
    """array<struct<subject, attribute, value>>: "For S, configure A: N U" or "S A is N U", then any "; A is N U" of the same subject."""
    form = F.when(text.rlike(CONFIGURED), F.lit(CONFIGURED)).when(text.rlike(STATED), F.lit(STATED))
    group = lambda i: F.when(text.rlike(CONFIGURED), F.regexp_extract(text, CONFIGURED, i)).otherwise(F.regexp_extract(text, STATED, i))
    subject = group(1)
    claim = lambda attribute, value: F.struct(subject.alias("subject"), attribute.alias("attribute"), value.alias("value"))
    first = claim(group(2), F.concat_ws(" ", group(3), group(4)))
    more = F.transform(
        F.regexp_extract_all(text, F.lit(ALSO), F.lit(0)),
        lambda m: claim(F.regexp_extract(m, ALSO, 1), F.concat_ws(" ", F.regexp_extract(m, ALSO, 2), F.regexp_extract(m, ALSO, 3))),
    )
    return F.when(form.isNull(), F.array().cast("array<struct<subject:string,attribute:string,value:string>>")).otherwise(F.concat(F.array(first), more))


def packet_fields(packet: Column) -> Column:
    """struct<batch_size, accumulation_steps, effective_batch_size> of a packet of chunks; null unless both fields are there once and as declared.

    A chunk is a JSON header that names its source, a line end and the text; chunks of other sources are not looked at.
    """
    chunks = F.transform(F.split(packet, "\n\n"), lambda c: F.struct(F.get_json_object(F.substring_index(c, "\n", 1), "$.source").alias("source"), F.regexp_replace(c, r"^[^\n]*\n", "").alias("text")))

    def field(source: str) -> Column:
        mine = F.filter(chunks, lambda c: c["source"] == source)
        value = F.regexp_extract(F.get(mine, F.lit(0))["text"], rf"^Target experiment {FIELDS[source]} = ([1-9][0-9]{{0,3}})\.$", 1)
        return F.when((F.size(mine) == 1) & (value != ""), value.cast("int"))

    a, b = field("config"), field("schedule")
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("batch_size"), b.alias("accumulation_steps"), (a * b).alias("effective_batch_size")))


def render_assignments(values: Column, allowed: list[str]) -> Column:
    """"NAME = number" lines of a map, by name; null unless its names are the allowed ones, 1 to 32, and its numbers fit 32 bits."""
    names = F.array_sort(F.map_keys(values))
    good = (names == F.array(*[F.lit(n) for n in sorted(allowed)])) & F.size(values).between(1, 32)
    good = good & F.forall(names, lambda n: n.rlike(r"^[A-Z][A-Z0-9_]{0,63}$")) & F.forall(F.map_values(values), lambda v: v.isNotNull() & v.between(-(1 << 31), (1 << 31) - 1))
    return F.when(good, F.array_join(F.transform(names, lambda n: F.concat(n, F.lit(" = "), F.element_at(values, n).cast("string"), F.lit("\n"))), ""))


def pair_lengths(query: Column, passage: Column, most: int = 512) -> tuple[Column, Column]:
    """How many tokens of a query and of a passage fit with three marks: the longer one is cut first; of equals the passage keeps the odd one."""
    room = most - 3
    half, rest = room // 2, room - room // 2
    long = F.when(query > passage, F.lit(rest)).otherwise(F.lit(half))
    q = F.when(query + passage <= room, query).when(F.least(query, passage) > half, long).when(query < passage, query).otherwise(room - passage)
    p = F.when(query + passage <= room, passage).when(F.least(query, passage) > half, F.lit(room) - long).when(query < passage, room - query).otherwise(passage)
    return q.cast("int"), p.cast("int")


def pair_tokens(query: Column, passage: Column, *, begin: Column, separator: Column, most: int = 512) -> Column:
    """struct<tokens, segments> of a pair: begin, query, separator (segment 0), passage, separator (segment 1)."""
    q, p = pair_lengths(F.size(query), F.size(passage), most)
    tokens = F.concat(F.array(begin), F.slice(query, F.lit(1), q), F.array(separator), F.slice(passage, F.lit(1), p), F.array(separator))
    return F.struct(tokens.alias("tokens"), F.concat(F.array_repeat(F.lit(0), q + 2), F.array_repeat(F.lit(1), p + 1)).alias("segments"))


def decimal_of(operation: str | None, left: str | None, right: str | None) -> tuple[str | None, str | None]:
    """(result, error) of exact arithmetic on decimal texts."""
    if operation not in ("add", "subtract", "multiply", "divide", "compare"):
        return None, "operation"
    numbers = []
    for text in (left, right):
        try:
            number = Decimal(text) if text and len(text) <= 64 else None
        except InvalidOperation:
            number = None
        if number is None or not number.is_finite() or abs(number.adjusted()) > 32:
            return None, "number"
        numbers.append(number)
    a, b = numbers
    if operation == "compare":
        return str((a > b) - (a < b)), None
    with localcontext() as context:
        context.prec, context.traps[Inexact] = DIGITS, True
        try:
            done = {"add": context.add, "subtract": context.subtract, "multiply": context.multiply, "divide": context.divide}[operation](a, b)
        except ArithmeticError:
            return None, "inexact"
    return format(done, "f"), None


def exact_decimal(operation: Column, left: Column, right: Column) -> Column:
    """struct<value, error>: add, subtract, multiply, divide or compare decimal texts exactly; an error where that needs rounding."""

    @F.arrow_udf("struct<value:string,error:string>")
    def compute(operations: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for parts in operations:
            done = [decimal_of(*row) for row in zip(*(p.to_pylist() for p in parts), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["value", "error"])

    return compute(operation, left, right)
