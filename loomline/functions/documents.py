"""Side documents: JSON that may be missing or damaged, read with the defaults of its kind and written with its numbers as they were."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a document of each kind holds at least, and a box's size where none is told.
DEFAULTS = {
    "embeddings": {"scans": "{}", "slides": "{}"},
    "faces": {"slides": "{}"},
    "learned": {"labels": "{}"},
    "presets": {"presets": "[]"},
    "boxes": {"boxes": "{}"},
    "people": {"ages_off": "[]", "next": "1", "people": "{}", "rejected": "{}"},
}
BOX_SIZE = 50
#: Stands before a number that is kept as text; a character that has no meaning of its own.
_MARK = "\ue000"
_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"


def parsed(text: Column) -> Column:
    """The document as a variant; null if it is missing, damaged, names a key twice or is no object."""
    doc = F.try_parse_json(text)
    return F.when(F.schema_of_variant(doc).startswith("OBJECT"), doc)


def part(doc: Column, kind: str, name: str, as_type: str) -> Column:
    """One of the parts that documents of this kind have: the document's own where it is of that type, else the default."""
    return F.coalesce(F.try_variant_get(doc, f"$.{name}", as_type), F.variant_get(F.parse_json(F.lit(DEFAULTS[kind][name])), "$", as_type))


def boxes(text: Column) -> Column:
    """map<int, struct<size int, writing string>> of the numbered boxes; none if a number is none, as in any damaged document."""
    held = part(parsed(text), "boxes", "boxes", "map<string,variant>")
    number = lambda k: F.try_to_number(k, F.lit("S999999999")).cast("int")
    box = lambda v: F.struct(F.coalesce(F.try_variant_get(v, "$.size", "int"), F.lit(BOX_SIZE)).alias("size"), F.coalesce(F.try_variant_get(v, "$.writing", "string"), F.lit("")).alias("writing"))
    good = F.forall(F.map_keys(held), lambda k: k.rlike(r"^[+-]?\d{1,9}$"))
    entries = F.transform(F.map_entries(held), lambda e: F.struct(number(e["key"]).alias("key"), box(e["value"]).alias("value")))
    return F.when(good, F.map_from_entries(entries)).otherwise(F.map_from_entries(F.array().cast("array<struct<key:int,value:struct<size:int,writing:string>>>")))


def people(text: Column) -> Column:
    """struct<people map<string, variant>, rejected map<string, array<string>>, next long, ages_off array<string>> of a people document."""
    doc = parsed(text)
    kinds = {"people": "map<string,variant>", "rejected": "map<string,array<string>>", "next": "long", "ages_off": "array<string>"}
    return F.struct(*[part(doc, "people", n, t).alias(n) for n, t in kinds.items()])


def _numbers_as_text(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(r'("(?:[^"\\]|\\.)*+"|[^"]++)'), F.lit(1))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.startswith('"'), t).otherwise(F.regexp_replace(t, f"({_NUMBER})", f'"{_MARK}$1"'))), "")


def filled(text: Column, kind: str) -> Column:
    """The document as JSON text with the defaults of its kind where parts are missing or null, all its numbers as they stand in ``text``.

    A missing or damaged document gives the defaults alone. Keys come in alphabetical order, white space goes. A text
    that begins with U+E000 and goes on as a number would be written as that number.
    """
    doc = F.try_variant_get(F.when(parsed(text).isNotNull(), parsed(_numbers_as_text(text))), "$", "map<string,variant>")
    own = F.coalesce(doc, F.map_from_entries(F.array().cast("array<struct<key:string,value:variant>>")))
    names = F.array_sort(F.array_union(F.map_keys(own), F.array(*[F.lit(n) for n in DEFAULTS[kind]])))

    def piece(n: Column) -> Column:
        default = F.coalesce(*[F.when(n == known, F.lit(held)) for known, held in DEFAULTS[kind].items()], F.lit("null"))
        quoted = F.to_json(F.array(n))
        return F.concat(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(":"), F.coalesce(F.nullif(F.to_json(F.element_at(own, n)), F.lit("null")), default))

    return F.regexp_replace(F.concat(F.lit("{"), F.array_join(F.transform(names, piece), ","), F.lit("}")), f'"{_MARK}({_NUMBER})"', "$1")
