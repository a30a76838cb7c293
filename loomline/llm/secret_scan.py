"""Secrets in texts: fixed patterns, and windows of high entropy inside candidate strings. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.spans import joined, let, spans, tagged

# Patterns and least lengths of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"

KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Bits per character that a window needs, by the narrowest class that holds the whole candidate; the first that fits counts.
CLASSES = (("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0), ("alphanumeric", r"^[A-Za-z0-9]+$", 3.5), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.7))
#: Candidates that are none: no digit, no letter, identifiers with a known form, words joined by dashes or slashes.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[=_-]*+[A-Za-z]*+(?:[/_=-]++(?:[A-Za-z]++|[0-9]{1,4}+))*+[/_=-]*+$",
    r"(?i)example|placeholder|changeme|your[_-]?(?:api|key|token)",
)


#: Counters of the characters in a window, packed twelve to a long of five bits each; for the code of a character its long and its place in it.
_PER_LONG, _COUNTER_BITS = 12, 5


def hot_range(word: Column, threshold: Column, window: int = WINDOW) -> Column:
    """struct<first int, last int>: where the first window of ``threshold`` bits or more starts and the last one ends; nulls if none.

    The window moves one character at a time: the counts of the character that comes in and of the one that goes out
    change by one, and so the sum of n log2 n, from which the entropy follows. A step's cost doesn't depend on the word.
    """
    if window >= 1 << _COUNTER_BITS:
        raise ValueError(f"a window has fewer than {1 << _COUNTER_BITS} characters")
    codes = range(len(ALPHABET))
    longs = F.array(F.lit(-1), *[F.lit(c // _PER_LONG) for c in codes])
    units = F.array(F.lit(0).cast("long"), *[F.lit(1 << _COUNTER_BITS * (c % _PER_LONG)).cast("long") for c in codes])
    shifts = F.array(F.lit(0), *[F.lit(_COUNTER_BITS * (c % _PER_LONG)) for c in codes])
    weights = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)])
    weight = lambda n: F.get(weights, n.cast("int"))

    def moved(held: Column) -> Column:
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // _PER_LONG)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

        def step(acc: Column, come: Column) -> Column:
            go = F.when(acc["at"] >= window, F.get(held["codes"], acc["at"] - window)).otherwise(F.lit(0))
            count = lambda code: F.call_function("shiftright", F.get(acc["counts"], F.get(longs, code)), F.get(shifts, code)).bitwiseAND(F.lit((1 << _COUNTER_BITS) - 1))
            n, m = count(come), count(go)
            change = F.when(come == go, F.lit(0.0)).otherwise(weight(n + 1) - weight(n) + F.when(go > 0, weight(m - 1) - weight(m)).otherwise(F.lit(0.0)))
            counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == F.get(longs, come), F.get(units, come)).otherwise(F.lit(0)) - F.when(k == F.get(longs, go), F.get(units, go)).otherwise(F.lit(0)))
            total, at = acc["sum"] + change, acc["at"] + 1
            hot = (at >= window) & (math.log2(window) - total / window >= held["threshold"] - 1e-9)
            return F.struct(counts.alias("counts"), total.alias("sum"), at.alias("at"), F.when(hot & acc["first"].isNull(), at - window).otherwise(acc["first"]).alias("first"), F.when(hot, at).otherwise(acc["last"]).alias("last"))

        return F.aggregate(held["codes"], start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return let(F.struct(F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c)).alias("codes"), threshold.alias("threshold")), moved)


def entropy_spans(text: Column, window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED, classes: tuple = CLASSES) -> Column:
    """Spans of the hot parts of the candidates that no allow-list pattern suppresses."""
    asked = F.filter(spans(text, CANDIDATE), lambda s: ~F.greatest(F.lit(False), *[s["word"].rlike(p) for p in allowed]))
    threshold = lambda w: F.coalesce(*[F.when(w.rlike(p), F.lit(t)) for _, p, t in classes], F.lit(99.0))
    ranged = F.transform(asked, lambda s: F.struct(s["start"].alias("at"), s["word"].alias("word"), hot_range(s["word"], threshold(s["word"]), window).alias("hot")))
    hot = F.filter(ranged, lambda s: s["hot"]["first"].isNotNull())
    return F.transform(hot, lambda s: F.struct((s["at"] + s["hot"]["first"]).alias("start"), (s["at"] + s["hot"]["last"]).alias("end"), F.substring(s["word"], s["hot"]["first"] + 1, s["hot"]["last"] - s["hot"]["first"]).alias("word")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Rows (id_col, assign, access, hex, entropy), each an array<struct<start, end, word>>, one per row of ``docs``.

    Positions are code points, ends exclusive. Per kind, matches are the leftmost that don't overlap; of assignments
    those whose value has eight characters or more stay, without a second try inside a dropped one. A null or empty
    text has no spans; repeated rows and null ids are kept as they are; other columns are ignored. No shuffle.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_text"))
    assign = F.filter(spans(F.col("_text"), ASSIGN), lambda s: F.length(F.regexp_extract(s["word"], ASSIGN, 2)) >= ASSIGN_VALUE)
    return rows.select(id_col, assign.alias("assign"), spans(F.col("_text"), ACCESS).alias("access"), spans(F.col("_text"), HEX).alias("hex"), entropy_spans(F.col("_text"), window, allowed).alias("entropy"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the hash of the base spans and the list of all spans, from ``scan``'s rows."""
    parts = [tagged(k, i, F.col(k)) for i, k in enumerate(KINDS)]
    out = found.select(id_col, *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], joined(parts[:3], False).alias("base"), joined(parts, False).alias("spans"))
    return out.select(id_col, *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")
