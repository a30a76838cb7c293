"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.spans import greatest_so_far, joined, let, outside, spans, tagged, with_pieces

# Patterns of the base kinds. Each may start only where no earlier start in the same run could, or right
# after the last match, which finds the same matches without trying every place of a long run.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Added kinds: a bank account number, and single runs of digits inside a longer chain that the card pattern rejects.
# An IBAN is as long as its country says, whatever words follow; codes that are in no register run as far as they go.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_HEAD = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"
_LISTED = "|".join(c.replace(" ", "|") for c in IBAN_LENGTHS.values())
IBAN = rf"^(?:{'|'.join(rf'(?:{c.replace(" ", "|")})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}' for n, c in IBAN_LENGTHS.items())}|(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])"
#: Characters from the start of an IBAN that its pattern may look at: 34, each after a space, and one behind.
IBAN_REACH = 69
RUN = r"(?<![0-9])[0-9]{13,19}+(?![0-9])"

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "run")
#: Score of a span that its validator has passed, what a cue nearby adds and a counter-cue takes away.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "run": 0.6}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write to)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|pan)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|dial)\b",
    "iban": r"(?i)\b(?:iban|account|bank|transfer)\b",
    "run": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|pan)\b",
}
COUNTER = r"(?i)\b(?:version|release|isbn|invoice|order no|sample|example only)\b"
NEAR, ADDS, TAKES = 40, 0.2, 0.3
#: Added kinds count from this score on; base kinds always do.
LEAST_SCORE = 0.5


def digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if every second digit from the right, doubled and its digits added, makes with the others a multiple of ten."""
    values = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(word: Column) -> Column:
    """True if the number, its first four characters moved to the end and letters read as 10 to 35, leaves 1 when divided by 97."""
    plain = F.replace(word, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return (rest == 1) & F.length(plain).between(15, 34)


def _ibans(text: Column) -> Column:
    """Spans of IBANs that mod-97 confirms. Each head in the text is tried, so one that fails, or overlaps, hides none behind it."""

    def tried(heads: Column) -> Column:
        read = lambda piece: F.transform(heads, lambda s: F.struct(s["start"].alias("start"), F.regexp_extract(piece(s["start"], s["start"] + IBAN_REACH), IBAN, 0).alias("word")))
        confirmed = F.filter(with_pieces(text, read), lambda s: mod97(s["word"]))
        return F.transform(confirmed, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["word"])).alias("end"), s["word"].alias("word")))

    return let(spans(text, IBAN_HEAD), lambda heads: F.when(F.size(heads) > 0, tried(heads)).otherwise(heads))


def _byte_parts(word: Column) -> Column:
    """True if the four numbers are at most 255, leading zeros aside."""
    plain = F.transform(F.split(word, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(plain, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id_col, one array<struct<start, end, word, score>> per kind, then ``keep``), one per row of ``docs``.

    Positions are code points, ends exclusive. Per kind, matches are the leftmost that don't overlap; those that fail
    their validator are dropped without a second try (IBANs are tried at each head, and may overlap). A cue within ``NEAR`` characters raises the score, a
    counter-cue lowers it; added kinds (iban, run) under ``least_score`` go, base kinds stay. A null or empty text has
    no spans; repeated rows and null ids are kept; other columns are ignored. No shuffle.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    t = F.col("_text")
    valid = {
        "email": spans(t, EMAIL),
        "ip": F.filter(spans(t, IP), lambda s: _byte_parts(s["word"])),
        "card": F.filter(spans(t, CARD), lambda s: F.length(digits(s["word"])).between(13, 19) & luhn(digits(s["word"]))),
        "phone": F.filter(spans(t, PHONE), lambda s: F.length(digits(s["word"])).between(9, 15)),
        "iban": _ibans(t),
        "run": F.filter(spans(t, RUN), lambda s: luhn(s["word"])),
    }

    def scored(kind: str) -> Column:
        def one(piece, s: Column) -> Column:
            around = F.concat_ws(" ", piece(s["start"] - NEAR, s["start"]), piece(s["end"], s["end"] + NEAR))
            score = let(around, lambda a: F.lit(SCORES[kind]) + F.when(a.rlike(CUES[kind]), ADDS).otherwise(0.0) - F.when(a.rlike(COUNTER), TAKES).otherwise(0.0))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["word"].alias("word"), F.least(score, F.lit(1.0)).alias("score"))

        found = F.col(f"_{kind}")
        return F.when(F.size(found) > 0, with_pieces(t, lambda piece: F.transform(found, lambda s: one(piece, s)))).otherwise(F.expr("CAST(array() AS array<struct<start:int,end:int,word:string,score:double>>)"))

    found = rows.select("*", *[valid[k].alias(f"_{k}") for k in KINDS])
    found = found.select("*", *[scored(k).alias(k) for k in KINDS])
    enough = lambda kind: F.filter(kind, lambda s: s["score"] >= least_score)
    added = {"iban": enough("iban"), "run": let(enough("run"), lambda runs: outside(runs, F.col("card")))}
    return found.select(F.col("_id").alias(id_col), *[added.get(k, F.col(k)).alias(k) for k in KINDS], *[F.col(f"_keep_{c}").alias(c) for c in keep])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the hash of the base spans, the list of all spans and, in the same order, their scores, from ``scan``'s rows."""
    parts = [tagged(k, i, F.col(k)) for i, k in enumerate(KINDS)]
    sure = [F.transform(k, lambda s: F.struct(F.lit(i).alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))) for i, k in enumerate(KINDS)]
    scores = F.array_join(F.transform(F.array_sort(F.concat(*sure)), lambda s: F.round(s["score"], 1).cast("string")), ",")
    out = found.select(id_col, *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], joined(parts[:4], True).alias("base"), joined(parts, True).alias("spans"), scores.alias("scores"))
    return out.select(id_col, *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", "scores")


def redact(docs: DataFrame, text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; of overlapping spans the one that starts first, then the longest, names all.

    Rows without personal data come back as they were, nulls included.
    """
    columns = docs.columns
    found = scan(docs.select(F.struct(*columns).alias("row"), F.col(text_col).alias("text")), "row", "text", least_score, keep=("text",))

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), F.lit(kind.upper()).alias("kind")))

    every = F.array_sort(F.concat(*[named(k) for k in KINDS]))

    def cleaned(held: Column) -> Column:
        """Between two spans stands the text from the furthest end so far to the next start; a span that begins before that end is named already."""

        def parts(piece) -> Column:
            before = lambda i: F.when(i > 0, F.get(held["far"], i - 1)).otherwise(F.lit(0))
            shown = F.transform(held["spans"], lambda s, i: F.when(s["start"] >= before(i), F.concat(piece(before(i), s["start"]), F.lit("<"), s["kind"], F.lit(">"))).otherwise(F.lit("")))
            return F.concat(F.array_join(shown, ""), piece(F.element_at(held["far"], -1), F.length("text")))

        return with_pieces(F.col("text"), parts)

    ends = let(every, lambda e: F.struct(e.alias("spans"), greatest_so_far(F.transform(e, lambda s: -s["less"])).alias("far")))
    shown = F.when(F.greatest(*[F.size(k) for k in KINDS]) > 0, let(ends, cleaned)).otherwise(F.col("text"))
    return found.select("row", shown.alias("_clean")).select(*[F.col("_clean").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in columns])
