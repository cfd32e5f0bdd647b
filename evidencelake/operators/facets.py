"""Facets of a text from fixed lexicons and patterns, in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Intent words, relation phrases, and the patterns of versions or dates and of identifiers.
INTENTS = (
    "add", "analyse", "analyze", "build", "compare", "debug", "delete", "explain",
    "fix", "implement", "measure", "remove", "review", "route", "test", "train", "update",
)
RELATIONS = ("blocks", "calls", "depends on", "derived from", "implements", "imports", "requires", "uses")
VERSION = r"(?i)\b(?:v?\d+(?:\.\d+){1,3}|20\d{2}-\d{2}-\d{2})\b"
ENTITY = (
    r"(?:[A-Za-z_][A-Za-z0-9_]{2,}(?:\.[A-Za-z_][A-Za-z0-9_]{1,})+|"
    r"[A-Za-z_][A-Za-z0-9_]{2,}\([^\n()]{0,48}\)|"
    r"[A-Za-z0-9_.-]+/(?:[A-Za-z0-9_.-]+/)*[A-Za-z0-9_.-]+)"
)
MAX_BYTES = 512
#: What hosts may assert, and the kinds of content; where a value comes from, and by which rule.
ASSERTED = ("authority", "policy", "modality", "workflow")
MODALITIES = ("text", "code", "image", "audio", "video", "table")
RULES = {
    "semantic": "exact-text-v1", "task": "intent-lexicon-v1", "entity": "identifier-pattern-v1",
    "relation": "relation-lexicon-v1", "temporal": "version-date-pattern-v1",
}


def bounded_join(values: Column, most: int = MAX_BYTES) -> Column:
    """Values joined by ", " while the whole stays within the byte bound."""

    def add(acc: Column, v: Column) -> Column:
        longer = F.when(acc["text"] == "", v).otherwise(F.concat(acc["text"], F.lit(", "), v))
        fits = acc["open"] & (F.octet_length(longer) <= most)
        return F.struct(F.when(fits, longer).otherwise(acc["text"]).alias("text"), fits.alias("open"))

    return F.aggregate(values, F.struct(F.lit("").alias("text"), F.lit(True).alias("open")), add, lambda acc: acc["text"])


def facets(text: Column) -> dict[str, Column]:
    """task, relation, temporal and entity values of a text; null where there is none.

    Intents are whole words; relations are found anywhere, within words too.
    """
    low = F.lower(text)
    tasks = F.filter(F.array(*[F.when(low.rlike(rf"(?<![\p{{L}}\p{{N}}_]){w}(?![\p{{L}}\p{{N}}_])"), w) for w in INTENTS]), lambda w: w.isNotNull())
    relations = F.filter(F.array(*[F.when(F.contains(low, F.lit(w)), w) for w in RELATIONS]), lambda w: w.isNotNull())
    found = lambda pattern: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    by_name = lambda pattern: F.transform(F.array_sort(F.transform(found(pattern), lambda x: F.struct(F.lower(x).alias("low"), x.alias("x")))), lambda s: s["x"])
    some = lambda values: F.when(F.size(values) > 0, bounded_join(values))
    return {"task": some(tasks), "relation": some(relations), "temporal": some(by_name(VERSION)), "entity": some(by_name(ENTITY))}


def compiled(text: Column, metadata: Column) -> Column:
    """map<facet, struct<value, source, rule>> of a text and what its host asserts, a map<string,string> or null.

    A workflow counts for relation; an asserted value is joined to one that the text has, within the byte bound.  Null
    for texts without a visible character, and for metadata of other names, of blank or longer values or of another
    modality.
    """
    own = {"semantic": text, **facets(text)}
    known = F.coalesce(metadata, F.create_map().cast("map<string,string>"))
    entry = lambda name, value, source, rule: F.struct(F.lit(name).alias("key"), F.struct(value.alias("value"), F.lit(source).alias("source"), F.lit(rule).alias("rule")).alias("value"))
    names = {"authority": "authority", "policy": "policy", "modality": "modality", "relation": "workflow"}
    entries = []
    for name in dict.fromkeys((*own, *names)):
        mine = own.get(name, F.lit(None).cast("string"))
        said = F.element_at(known, names[name]) if name in names else F.lit(None).cast("string")
        both = entry(name, bounded_join(F.array(mine, said)), "input+host-metadata", "combined-v1")
        entries.append(
            F.when(mine.isNotNull() & said.isNotNull(), both).when(mine.isNotNull(), entry(name, mine, "input", RULES.get(name, "")))
            .when(said.isNotNull(), entry(name, said, "host-metadata", "asserted-v1"))
        )
    fine = F.forall(F.map_keys(known), lambda k: k.isin(*ASSERTED)) & F.forall(F.map_values(known), lambda v: v.isNotNull() & (F.trim(v) != "") & (F.octet_length(v) <= MAX_BYTES))
    fine = fine & F.coalesce(F.element_at(known, "modality").isin(*MODALITIES), F.lit(True)) & text.rlike(r"\S")
    return F.when(fine, F.map_from_entries(F.array_compact(F.array(*entries))))
