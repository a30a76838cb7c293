"""Spans of regular expressions in texts, by DataFrame functions alone, in time that grows with the text and not with its square."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of the parts into which a text is cut before pieces are taken from it.
CHUNK_BITS = 10
_SPANS = "array<struct<start:int,end:int,word:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Running sums of an array, or running maxima if ``add`` is the greater of two; ``values`` must be cheap to name.

    Every round adds to each element the one 1, 2, 4, ... places before it, so there are as many rounds as the length has bits.
    """
    powers = F.array(*[F.lit(1 << k) for k in range(31)])
    step = lambda acc, back: F.transform(acc, lambda x, i: F.when(i >= back, add(x, F.get(acc, i - back))).otherwise(x))
    return F.aggregate(F.filter(powers, lambda p: p < F.size(values)), values, step)


def summed(values: Column) -> Column:
    return let(values, lambda v: running(v, lambda a, b: a + b))


def greatest_so_far(values: Column) -> Column:
    return let(values, lambda v: running(v, lambda a, b: F.greatest(a, b)))


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start int, end int, word string>>, in code points, end exclusive.

    The text between the matches comes from splitting at them, so that running sums of both lengths give positions.
    ``pattern`` must not match the empty string and may look back only as far as split and extract do alike.
    """

    def placed(words: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(words))
        ends = summed(F.zip_with(between, words, lambda gap, word: F.length(gap) + F.length(word)))
        return F.zip_with(ends, words, lambda end, word: F.struct((end - F.length(word)).alias("start"), end.alias("end"), word.alias("word")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda words: F.when(F.size(words) > 0, placed(words)).otherwise(F.expr(f"CAST(array() AS {_SPANS})")))


def with_pieces(text: Column, body: Callable[[Callable[[Column, Column], Column], Column], Column]) -> Column:
    """``body`` over a function that takes the piece of the text from one code point to another, at the cost of the piece and not of the way to it."""
    size = 1 << CHUNK_BITS
    cut = F.struct(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0)).alias("chunks"), F.length(text).alias("length"))

    def run(held: Column) -> Column:
        chunks = held["chunks"]

        def piece(start: Column, end: Column) -> Column:
            def taken(at: Column) -> Column:
                a, b = at["a"], at["b"]
                one, last = F.shiftright(a, CHUNK_BITS), F.shiftright(b - 1, CHUNK_BITS)
                head = F.substring(F.get(chunks, one), a.bitwiseAND(F.lit(size - 1)) + 1, F.least(b - a, F.lit(size)))
                middle = F.array_join(F.slice(chunks, one + 2, last - one - 1), "")
                return F.when(b <= a, F.lit("")).when(one == last, head).otherwise(F.concat(head, middle, F.substring(F.get(chunks, last), F.lit(1), b - F.shiftleft(last, CHUNK_BITS))))

            return let(F.struct(F.greatest(start, F.lit(0)).alias("a"), F.least(end, held["length"]).alias("b")), taken)

        return body(piece)

    return let(cut, run)


def outside(found: Column, covers: Column) -> Column:
    """The spans of ``found`` that lie in none of ``covers``, by start."""
    marked = lambda spans, order: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), (F.lit(0) if order else s["end"]).alias("reach"), s["end"].alias("end")))

    def kept(both: Column) -> Column:
        reach = greatest_so_far(F.transform(both, lambda x: x["reach"]))
        ranked = F.filter(F.zip_with(both, reach, lambda x, r: F.struct(x["order"].alias("order"), (x["end"] > r).alias("free"))), lambda x: x["order"] == 1)
        by_start = F.array_sort(found)
        return F.transform(F.filter(F.zip_with(by_start, ranked, lambda s, x: F.struct(s.alias("span"), x["free"].alias("free"))), lambda x: x["free"]), lambda x: x["span"])

    return F.when((F.size(found) > 0) & (F.size(covers) > 0), let(F.array_sort(F.concat(marked(covers, 0), marked(found, 1))), kept)).otherwise(found)


def tagged(kind: str, order: int, found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(parts: Sequence[Column], by_kind: bool) -> Column:
    """kind:start:end of all tagged spans, comma-joined, by start and then kind or the other way round."""
    keyed = F.transform(F.concat(*parts), lambda s: F.struct(*((s["order"].alias("a"), s["start"].alias("b")) if by_kind else (s["start"].alias("a"), s["order"].alias("b"))), s["end"].alias("end"), s["start"].alias("start"), s["kind"].alias("kind")))
    shown = F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(shown, ",")
