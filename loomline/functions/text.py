"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that come apart into an ASCII one and marks, marks by themselves, letters with strokes, which don't
# come apart; letters whose capital is several, with the one sign that stands for it or, without one, the letter itself.
_PARTS = {c: unicodedata.normalize("NFD", c.lower()) for c in map(chr, range(0x80, 0x2200))}
_BASE = {c: d[0] for c, d in _PARTS.items() if d[0].isascii() and d[0].isalnum()}
_MARKED, _UNMARKED = "".join(_BASE), "".join(_BASE.values())
_MARKS = "".join(c for c in map(chr, range(0x300, 0x110000)) if unicodedata.category(c)[0] == "M")
_STROKES, _STROKELESS = "øłđ", "old"
_CAPITAL = {c: "\u1e9e" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1}
_SPACE = r"[\t\n\f\r ]"
_ENDS = "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Zs")


def lower(text: Column) -> Column:
    """Lower case letter by letter: a capital sigma is the same within and at the end of a word, and a dotted capital i one letter."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def capital(letter: Column) -> Column:
    """A letter's capital if that is one letter, else the letter; of ß the capital ẞ."""
    kept = F.translate(letter, "".join(_CAPITAL), "".join(_CAPITAL.values()))
    return F.when(F.lit("".join(_CAPITAL)).contains(letter), kept).otherwise(F.upper(letter))


def plain(text: Column, strokes: bool = True) -> Column:
    """Lower case, Latin letters without their marks, other signs as they are; with ``strokes`` also ø, ł and đ. ASCII texts have no marks to take off."""
    more, less = (_STROKES, _STROKELESS) if strokes else ("", "")
    bare = F.translate(F.replace(lower(text), F.lit("ß"), F.lit("ss")), _MARKED + more + _MARKS, _UNMARKED + less)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(bare)


def fold(text: Column, strokes: bool = True) -> Column:
    """Lower-case ASCII words parted by one space; marks go, other signs part words. Latin letters are folded natively; with ``strokes`` also ø, ł and đ."""
    return F.trim(F.regexp_replace(plain(text, strokes), "[^0-9a-z]+", " "))


def squeeze(text: Column) -> Column:
    """White space of the keyboard as one space each, none of any kind at the ends."""
    return F.trim(F.regexp_replace(text, f"{_SPACE}+", " "), F.lit(_ENDS))


def slugify(text: Column, default: str = "session") -> Column:
    slug = F.trim(lower(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}_\-]+", "-")), F.lit("-"))
    return F.when(slug == "", default).otherwise(slug)


def clean_tags(tags: Column, longest: int = 40, most: int = 30) -> Column:
    """Squeezed lower-case tags, the first of equals, without empty ones."""
    shown = F.transform(tags, lambda t: F.substring(lower(squeeze(t)), 1, longest))
    return F.slice(F.array_distinct(F.filter(shown, lambda t: t != "")), 1, most)


def tidy(caption: Column, longest: int = 200) -> Column:
    """One line with a capital first and a full stop at the end unless it ends a sentence already."""
    line = F.regexp_replace(F.substring(squeeze(caption), 1, longest), r"[\t\n\f\r ,;:]+\z", "")
    line = F.concat(capital(F.substring(line, 1, 1)), F.substring(line, 2, longest))
    return F.when(line == "", "").when(line.rlike(r"[.!?]\z"), line).otherwise(F.concat(line, F.lit(".")))


def label(*parts: Column) -> Column:
    """The parts that are not empty, each once, parted by commas."""
    return F.array_join(F.array_distinct(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))), ", ")


def coords_label(lat: Column, lon: Column) -> Column:
    return F.format_string("%.4f, %.4f", lat, lon)


COORDS = r"^\s*(-?\d{1,2}(?:\.\d+)?)\s*[,; ]\s*(-?\d{1,3}(?:\.\d+)?)\s*$"


def parse_coords(text: Column) -> Column:
    """struct<lat, lon> of two numbers in range, else null."""
    lat, lon = (F.regexp_extract(text, COORDS, i).try_cast("double") for i in (1, 2))
    return F.when(text.rlike(COORDS) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def dms(degrees: Column) -> Column:
    """struct<d, m, s> of the size of an angle, seconds to a hundredth."""
    hundredths = F.round(F.abs(degrees) * 360000).cast("long")
    return F.struct((F.floor(hundredths / 360000)).cast("long").alias("d"), (F.floor(hundredths / 6000) % 60).cast("long").alias("m"), ((hundredths % 6000) / 100).alias("s"))


def xml_escape(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def ngrams(words: Column, longest: int = 3, of: list[int] | None = None) -> Column:
    """array<struct<at, n, key>> of all runs of one to ``longest`` words, or of as many words as the numbers ``of`` say."""

    def runs_of(n: int) -> Column:
        last = F.size(words) - n
        runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(words, i + 1, F.lit(n)), " ").alias("key")))
        return F.when(last >= 0, runs).otherwise(F.array().cast("array<struct<at:int,n:int,key:string>>"))

    sizes = range(1, longest + 1) if of is None else of
    return F.concat(F.array().cast("array<struct<at:int,n:int,key:string>>"), *[runs_of(n) for n in sizes])


def content_key(*parts: Column) -> Column:
    """The first twelve hexadecimal digits of a hash of the parts, nulls told apart from empty strings."""
    return F.substring(F.sha1(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))), 1, 12)


def tray_tag(name: Column) -> Column:
    """Trays/<name>, with slashes in the name as dashes, so that they don't nest it deeper."""
    plain = F.nullif(F.trim(F.replace(name, F.lit("/"), F.lit("-"))), F.lit(""))
    return F.concat(F.lit("Trays/"), F.coalesce(plain, F.lit("Untitled tray")))
