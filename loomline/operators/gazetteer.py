"""Places: loading a gazetteer, searching it by prefix, by distance and in text."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions import text as X
from loomline.functions.vectors import haversine_km
from loomline.sources.shared import stored

# Phrases that introduce a place, words that are a place's name too but mean something else on signs, and words
# after or before which a name is that of a street, a house or a firm. All folded.
CUES = (
    "welcome to", "greetings from", "bienvenue a", "bienvenue au", "bienvenue en", "willkommen in", "benvenuti a", "benvenuti in", "benvenuto a", "bienvenidos a", "bienvenido a", "welkom in", "welkom te", "bem vindo a",
    "bem vindos a", "vitajte v", "witamy w", "velkommen til", "valkommen till", "gruss aus", "grusse aus", "souvenir de", "ricordo di", "recuerdo de", "greetings of",
)
COMMON = tuple(
    """bar nice split best deal mobile reading bath most sale open exit stop taxi bus hotel park post police bank
museum center centre city beach station opera parking central university college victoria orange paradise
hope independence union liberty concord hollywood harmony industry commerce enterprise progress victory
welcome eden mission bay port porto santa san saint st east west north south la le de del el los las
hall market gate bridge church castle lake mountain river valley view avenue street road place plaza
cafe restaurant bakery pizza shop store tourist information entrance ausgang eingang sortie entree
uscita entrata salida entrada zimmer frei rooms camping pension tabac apotheke pharmacie farmacia office
marina airport metro plage playa coca cola castello riviera kodak agfa fuji ilford ektachrome kodachrome
agfachrome sakura polaroid esso shell texaco total mobil garage auto sport grand royal palace imperial
metropol metropole europa bellevue belvedere panorama miramar splendid excelsior savoy ritz astoria
continental majestic ocean harbour harbor pier lido""".split()
)
STREET_BEFORE = tuple(
    """via viale corso piazza piazzale largo vicolo rue avenue boulevard bd place quai chemin allee
calle avenida plaza paseo carrer rua strasse str gasse platz weg straat laan plein hotel albergo pension
gasthof gasthaus restaurant ristorante trattoria pizzeria cafe caffe bar brasserie hostal hostel
pensione""".split()
)
STREET_AFTER = tuple(
    """road street st avenue ave lane way square station airlines airline airways air express
match hotel restaurant cafe bar strasse str gasse platz weg straat laan plein boulevard bd club fc
bank insurance""".split()
)
BIG, LEAST, NEAREST_KM = 100_000, 0.3, 25.0
#: The earth's surface, and how many cities a place should see, were they spread over it evenly, where it looks first.
EARTH_KM2, SEEN = 510e6, 4
#: Letters of a query that its join is on.
HEAD = 12
#: Keys that a task holds at most, and bytes of text that it looks at together.
HELD, PIECE = 1 << 21, 1 << 23


def city_keys(cities: DataFrame) -> DataFrame:
    """Rows (key, city_id, is_primary, pop): the folded names a city is found by, its own name first among equals."""
    names = F.array_distinct(F.concat(F.array(F.struct(X.fold(F.col("name")).alias("key"), F.lit(True).alias("is_primary"))), F.transform("alts", lambda a: F.struct(X.fold(a).alias("key"), F.lit(False).alias("is_primary")))))
    rows = cities.select("city_id", "pop", F.explode(names).alias("k")).select("city_id", "pop", "k.key", "k.is_primary").where("key <> ''")
    return rows.groupBy("key", "city_id", "pop").agg(F.max("is_primary").alias("is_primary"))


def prefix_search(queries: DataFrame, keys: DataFrame, query_id: str, query: str, limit: int = 8) -> DataFrame:
    """Rows (query_id, city_id, rank): cities some key of which begins with the query: exact first, then primary, then by population.

    Keys are dealt out under each of their beginnings of two to ``HEAD`` letters, so keys and queries meet on an
    equality that is as selective as the query is long; only the rest of a longer query is a test.
    """
    asked = queries.select(query_id, X.fold(F.col(query)).alias("_q")).where("length(_q) >= 2").withColumn("_h", F.substring("_q", 1, HEAD))
    begun = keys.where("length(key) >= 2").withColumn("_h", F.explode(F.transform(F.sequence(F.lit(2), F.least(F.length("key"), F.lit(HEAD))), lambda n: F.substring("key", F.lit(1), n))))
    met = asked.join(begun, "_h").where(F.col("key").startswith(F.col("_q")))
    rank = F.struct((F.col("key") != F.col("_q")).alias("inexact"), (~F.col("is_primary")).alias("other"), (-F.col("pop")).alias("less"))
    best = met.groupBy(query_id, "city_id").agg(F.min(rank).alias("r"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy("r", "city_id"))).where(F.col("rank") <= limit).select(query_id, "city_id", "rank")


def _within(places: DataFrame, towns: DataFrame, km: float) -> DataFrame:
    """Rows (_lat, _lon, _b): the nearest of ``towns`` that is within ``km`` of each place that has one.

    Both meet by cells about as wide as the distance; a place asks its own and those around that the distance
    reaches, wider in longitude towards the poles, and across the date line.
    """
    reach = km / 111.0 + 1e-6
    n = max(int(360 / reach), 1)
    row, column = (lambda c: F.floor(c / reach)), (lambda c: F.floor(c / (360.0 / n)))
    wide = F.least(F.lit(180.0), reach / F.greatest(F.cos(F.radians(F.least(F.abs(F.col("_lat")) + reach, F.lit(89.9)))), F.lit(1e-3)))
    asked = places.withColumn("_y", F.explode(F.sequence(row(F.col("_lat") - reach), row(F.col("_lat") + reach))))
    asked = asked.withColumn("_x", F.explode(F.array_distinct(F.transform(F.sequence(column(F.col("_lon") - wide), column(F.col("_lon") + wide)), lambda x: F.pmod(x, F.lit(n))))))
    held = towns.withColumn("_y", row(F.col("_clat"))).withColumn("_x", F.pmod(column(F.col("_clon")), F.lit(n)))
    met = asked.join(held, ["_y", "_x"]).select("_lat", "_lon", F.struct(haversine_km(F.col("_lat"), F.col("_lon"), F.col("_clat"), F.col("_clon")).alias("km"), "city_id").alias("_b"))
    return met.where(F.col("_b.km") <= km).groupBy("_lat", "_lon").agg(F.min("_b").alias("_b"))


def nearest_city(points: DataFrame, cities: DataFrame, point_id: str, lat: str, lon: str, within_km: float = NEAREST_KM) -> DataFrame:
    """Rows (point_id, city_id, km): the nearest city within the distance, the smaller id of equals.

    Each place is asked for once, whatever points lie on it, and of cities on one place only the smallest can be the
    nearest. The more cities there are, the nearer places look first: only those that find none look twice as far,
    up to the distance. So a place meets a few cities, not all within the distance, where cities lie about evenly.
    """
    rows = points.where(f"{lat} IS NOT NULL AND {lon} IS NOT NULL").select(point_id, F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"))
    towns = cities.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy(F.col("lat").alias("_clat"), F.col("lon").alias("_clon")).agg(F.min("city_id").alias("city_id"))
    towns = stored(towns, "towns")
    typical, look = SEEN * EARTH_KM2 / max(towns.count(), 1), [within_km]
    while math.pi * (look[0] / 2) ** 2 >= typical:
        look.insert(0, look[0] / 2)
    left, found = rows.select("_lat", "_lon").distinct(), None
    if len(look) > 1:
        left = stored(left, "places")
    for km in look:
        near = _within(left, towns, km)
        if km < within_km:
            near = stored(near, "near")
            left = stored(left.join(near, ["_lat", "_lon"], "left_anti"), "places")
        found = near if found is None else found.unionByName(near)
    return rows.join(found, ["_lat", "_lon"]).groupBy(point_id).agg(F.min("_b").alias("b")).select(point_id, "b.city_id", "b.km")


def with_line_pairs(lines: DataFrame, item: str, number: str, text: str, confidence: str) -> DataFrame:
    """Rows (item, text, confidence): every line, and every two in a row together, as sure as the less sure one: a cue may end a line."""
    w = W.partitionBy(item).orderBy(number)
    rows = lines.select(item, text, confidence, F.lead(text).over(w).alias("_t"), F.lead(confidence).over(w).alias("_c"))
    pairs = rows.where("_t IS NOT NULL").select(item, F.concat_ws(" ", text, "_t").alias(text), F.least(confidence, "_c").alias(confidence))
    return rows.select(item, text, confidence).unionByName(pairs)


_WORD = np.zeros(256, bool)
_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True


class _Texts:
    """The words of some texts one after the other: codes, their row, their line among all, and what is before and after them."""

    def __init__(self, texts: pa.Array, by_line: bool):
        texts = texts.cast(pa.large_string())
        _, ends, held = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        signs = np.frombuffer(held or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        inner = _WORD[signs]
        first = inner.copy()
        first[1:] &= ~inner[:-1]
        begin = ends[:-1][ends[:-1] < ends[1:]]
        first[begin] = inner[begin]
        first = np.flatnonzero(first)
        letters = np.cumsum(inner, dtype=np.int64)
        places = np.append(letters[first] - 1, letters[-1:])
        words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(places), pa.py_buffer(signs[inner])) if len(first) else pa.array([], pa.large_string())
        coded = words.dictionary_encode()
        self.vocabulary, self.code = coded.dictionary, coded.indices.to_numpy()
        breaks = np.flatnonzero(signs == 10) if by_line else np.zeros(0, np.int64)
        self.row = np.searchsorted(ends[1:], first, "right")
        # lines of different texts are never next to each other
        self.first_line = np.searchsorted(breaks, ends[:-1]) + 2 * np.arange(len(texts))
        self.lines = np.searchsorted(breaks, ends[1:]) - np.searchsorted(breaks, ends[:-1]) + 1
        self.line = np.searchsorted(breaks, first) + 2 * self.row

    def among(self, words: Sequence[str]) -> np.ndarray:
        return pc.is_in(self.vocabulary, value_set=pa.array(words, pa.large_string())).to_numpy(zero_copy_only=False)[self.code]

    def cued_from(self) -> np.ndarray:
        """For each word the line in which a phrase right before it begins, -2, which is next to no line, without one."""
        found = np.full(len(self.code) + 1, -2)
        code = {w: pc.index(self.vocabulary, w).as_py() for w in {w for c in CUES for w in c.split()[1:]}}
        ends = {w: np.flatnonzero(self.code == code[w]) for w in {c.split()[-1] for c in CUES} if code[w] >= 0}
        for cue in CUES:
            first, *rest = cue.split()
            if any(code[w] < 0 for w in rest):
                continue
            at = ends[rest[-1]] - len(rest)
            at = at[at >= 0]
            for k, w in enumerate(rest[:-1], 1):
                at = at[self.code[at + k] == code[w]]
            at = at[pc.ends_with(self.vocabulary.take(pa.array(self.code[at])), first).to_numpy(zero_copy_only=False)]
            after = at + len(rest) + 1
            found[after] = np.maximum(found[after], self.line[at])
        return found[:-1]

    def runs(self, keys: dict[int, tuple[np.ndarray, pa.Array]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, at, key): the runs of n words that are keys, of one line or of two in a row, longer ones first."""
        size, total, found = len(self.vocabulary), len(self.code), []
        coded = {}
        for n, (place, words) in keys.items():
            if n == 1:
                of = pc.index_in(self.vocabulary, value_set=words).fill_null(-1).to_numpy()[self.code]
                at = np.flatnonzero(of >= 0)
                found.append((1, at, place[of[at]]))
            else:
                of = pc.index_in(words, value_set=self.vocabulary).fill_null(-1).to_numpy().astype(np.int64).reshape(-1, n)
                here = (of >= 0).all(axis=1)
                coded[n] = place[here], of[here]
        begun, at = self.code.astype(np.int64), np.arange(total)
        state = {n: of[:, 0] for n, (_, of) in coded.items()}
        for n in range(2, max(coded, default=1) + 1):
            longer = [m for m in coded if m >= n]
            both = {m: state[m] * size + coded[m][1][:, n - 1] for m in longer}
            known = np.unique(np.concatenate([both[m] for m in longer]))
            near = at + n - 1 < total
            at, begun = at[near], begun[near]
            near = self.line[at + n - 1] - self.line[at] <= 1
            at, begun = at[near], begun[near] * size + self.code[at[near] + n - 1]
            if not len(known):
                break
            to = np.minimum(np.searchsorted(known, begun), len(known) - 1)
            near = known[to] == begun
            at, begun = at[near], to[near]
            state = {m: np.searchsorted(known, both[m]) for m in longer}
            if n in coded:
                place = np.full(len(known), -1)
                place[state[n]] = coded[n][0]
                ends = place[begun] >= 0
                found.append((n, at[ends], place[begun[ends]]))
        return iter(sorted(found, key=lambda f: -f[0]))


def _named(texts: pa.Array, sure: np.ndarray, keys: pa.Table, words: dict[int, tuple[np.ndarray, pa.Array]], by_line: bool) -> tuple[np.ndarray, ...]:
    """(row, confidence, unit, at, key): the best place of each text that names one.

    Units are the lines and then every two lines in a row. In two lines only runs over the break and those that have
    their cue in the line before are looked at: any other is at least as sure in its own line, which comes first.
    """
    t = _Texts(texts, by_line)
    total, line, cue_line, found = len(t.code), t.line, t.cued_from(), []
    before, after = t.among(STREET_BEFORE), t.among(STREET_AFTER)
    plain, known, weight = (keys.column(c).to_numpy() for c in ("_plain", "_known", "_weight"))
    own, two = ({n: np.zeros(total, bool) for n in words} for _ in range(2))
    for n, at, key in t.runs(words):
        over = line[at + n - 1] > line[at]
        for m in words:
            for d in range(n - m + 1) if m < n else ():
                own[m][at[~over] + d] = True
                inner = at[over] + d
                two[m][inner[(line[inner + m - 1] > line[at[over]])]] = True
        next_to = np.minimum(at + n, total - 1)
        street = before[at - 1] & (at > 0) & (line[at - 1] == line[at]) | after[next_to] & (at + n < total) & (line[next_to] == line[at + n - 1])
        cue = cue_line[at] == line[at]
        base = np.where(cue, 0.9, np.where(street | ~known[key], np.nan, plain[key]))
        free = np.where(over, ~two[n][at], ~own[n][at]) & ~np.isnan(base)
        found.append((at[free], key[free], base[free], np.where(over, t.lines[t.row[at]], 0)[free] + line[at[free]] - t.first_line[t.row[at[free]]]))
        seam = ~over & (cue_line[at] == line[at] - 1) & ~own[n][at] & ~two[n][at]
        row = t.row[at[seam]]
        found.append((at[seam], key[seam], np.full(len(row), 0.9), t.lines[row] + line[at[seam]] - 1 - t.first_line[row]))
    at, key, base, unit = (np.concatenate(x) for x in zip(*found))
    row = t.row[at]
    confidence = base * sure[row] * weight[key]
    best = np.full(len(texts), LEAST)
    np.fmax.at(best, row, confidence)
    at, key, unit, row, confidence = (x[confidence == best[row]] for x in (at, key, unit, row, confidence))
    order = np.lexsort((at, unit, row))
    order = order[np.unique(row[order], return_index=True)[1]]
    at, key, unit, row, confidence = (x[order] for x in (at, key, unit, row, confidence))
    start = t.first_line[row] + np.where(unit < t.lines[row], unit, unit - t.lines[row])
    return row, confidence, unit, at - np.searchsorted(line, start), key


def _look(shared: Broadcast, line_id: str, by_line: bool, piece: int = PIECE) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words = shared.value, {}
        for n in np.unique(keys.column("_n").to_numpy()).tolist():
            place = np.flatnonzero(keys.column("_n").to_numpy() == n)
            words[n] = place, pc.list_flatten(pc.split_pattern(keys.column("key").take(pa.array(place)).cast(pa.large_string()), " ")).combine_chunks()
        for b in batches:
            sizes = np.cumsum(pc.binary_length(b.column("_t")).fill_null(0).to_numpy())
            cuts = np.unique(np.append(0, np.searchsorted(sizes, np.arange(piece, sizes[-1] + piece, piece), "right"))) if len(sizes) else []
            for start, end in zip(cuts, [*cuts[1:], b.num_rows]):
                part = b.slice(start, end - start)
                if not part.num_rows:
                    continue
                row, confidence, unit, at, key = _named(part.column("_t"), part.column("_c").to_numpy(zero_copy_only=False), keys, words, by_line)
                city = keys.column("city_id").take(pa.array(key)).combine_chunks()
                yield pa.RecordBatch.from_arrays([part.column(line_id).take(pa.array(row)), city, pa.array(-confidence), pa.array(unit, pa.int64()), pa.array(at, pa.int64())], [line_id, "city_id", "_less", "_unit", "_at"])

    return run


def _dealt(rows: DataFrame, held: DataFrame, line_id: str, sizes: list[int], by_line: bool) -> DataFrame:
    """What ``_look`` finds, all runs of words dealt out to meet the keys: for gazetteers that a task can't hold."""
    if by_line:
        lines = F.split("_t", "\n")
        n = F.size(lines) - 1
        pairs = F.zip_with(F.slice(lines, F.lit(1), n), F.slice(lines, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
        rows = rows.select(line_id, "_c", F.posexplode(F.concat(lines, pairs)).alias("_unit", "_t"))
    else:
        rows = rows.select(line_id, "_c", F.lit(0).alias("_unit"), "_t")
    words = F.split(F.trim(F.regexp_replace("_t", "[^0-9a-z]+", " ")), " ")
    rows = rows.select(line_id, "_c", F.col("_unit").cast("long").alias("_unit"), F.xxhash64("_t").alias("_h"), words.alias("_words"))

    def placed(g: Column) -> Column:
        before = F.array_join(F.slice("_words", F.greatest(g["at"] - 2, F.lit(1)), F.least(g["at"], F.lit(3))), " ")
        last = F.when(g["at"] > 0, F.get("_words", g["at"] - 1)).otherwise("")
        after = F.coalesce(F.get("_words", g["at"] + g["n"]), F.lit(""))
        cue = F.rlike(before, F.lit(f"(?:{'|'.join(CUES)})$"))
        street = last.isin(*STREET_BEFORE) | after.isin(*STREET_AFTER)
        return F.struct(g["at"].alias("at"), g["n"].alias("n"), g["key"].alias("key"), cue.alias("_cue"), street.alias("_street"))

    of = [line_id, "_unit", "_h"]
    grams = rows.select(*of, "_c", F.explode(F.transform(X.ngrams(F.col("_words"), of=sizes), placed)).alias("g")).select(*of, "_c", "g.*")
    alone = F.col("n") == sizes[0]
    found = grams.where(F.col("_cue") | ~F.col("_street") | ~alone).join(held, "key")
    base = F.when(F.col("_cue"), 0.9).when(~F.col("_street") & F.col("_known") & ~F.isnan("_plain"), F.col("_plain"))
    scored = found.select(*of, "at", "n", "city_id", (base * F.col("_c") * F.col("_weight")).alias("confidence")).where(F.col("confidence") >= LEAST)
    if len(sizes) > 1:
        longer = found.where(~alone).select(*[F.col(c).alias(f"_l{c}") for c in of], F.col("at").alias("_at"), F.col("n").alias("_n"))
        inside = (F.col("_n") > F.col("n")) & (F.col("_at") <= F.col("at")) & (F.col("_at") + F.col("_n") >= F.col("at") + F.col("n"))
        for c in of:
            inside &= F.col(c) == F.col(f"_l{c}")
        scored = scored.join(longer, inside, "left_anti")
    return scored.select(line_id, "city_id", (-F.col("confidence")).alias("_less"), "_unit", F.col("at").cast("long").alias("_at"))


def places_in_text(lines: DataFrame, keys: DataFrame, line_id: str, text: str, confidence: Column | None = None, by_line: bool = False, held_keys: int = HELD) -> DataFrame:
    """Rows (line_id, city_id, confidence): the best place each text names; with ``by_line`` the best that any line of it and any two lines in a row name.

    Runs of three to one words are looked up; a run inside a longer one that is a key is suppressed. After a cue word a
    run is a place; without one it must be long enough, no common word or number, not part of a street or house, and
    the main name of a place or a large one. The share of the namesakes' population that the place has counts too.
    Every task holds the gazetteer, if it has ``held_keys`` keys of up to three words at most, and looks at the words
    of many texts at once: each different word meets it once, and a row a text comes back. For a larger one all runs
    are dealt out to meet the keys.
    """
    order = W.partitionBy("key").orderBy(F.desc("is_primary"), F.desc("pop"), "city_id")
    primary_pop = F.sum(F.when(F.col("is_primary"), F.col("pop"))).over(W.partitionBy("key"))
    total = F.coalesce(primary_pop, F.sum("pop").over(W.partitionBy("key")))
    held = keys.withColumn("_r", F.row_number().over(order)).withColumn("_share", F.when(total > 0, F.col("pop") / total).otherwise(1.0)).where("_r = 1")
    key = F.col("key")
    named = (F.length(F.replace(key, F.lit(" "), F.lit(""))) >= 4) & ~key.isin(*COMMON) & ~key.rlike("^[0-9 ]+$")
    plain = F.when(named, F.when(F.length(key) >= 6, 0.6).otherwise(0.45)).otherwise(float("nan"))
    known = F.coalesce(F.col("is_primary") | (F.col("pop") >= BIG), F.lit(False))
    held = held.select("key", "city_id", known.alias("_known"), plain.alias("_plain"), (0.5 + 0.5 * F.col("_share")).alias("_weight"), F.size(F.split("key", " ")).alias("_n"))
    held = stored(held.where("_n <= 3"), "keys")
    sizes = {r._n: r["count"] for r in held.groupBy("_n").count().collect()}
    rows = lines.select(line_id, X.plain(F.col(text)).alias("_t"), (confidence if confidence is not None else F.lit(1.0)).cast("double").alias("_c")).where("_t IS NOT NULL")
    if not sizes:
        return rows.select(line_id, F.lit(None).cast(keys.schema["city_id"].dataType).alias("city_id"), F.col("_c").alias("confidence")).where(F.lit(False))
    if sum(sizes.values()) <= held_keys:
        kinds = [lines.schema[line_id], held.schema["city_id"], T.StructField("_less", T.DoubleType()), T.StructField("_unit", T.LongType()), T.StructField("_at", T.LongType())]
        told = rows.mapInArrow(_look(lines.sparkSession.sparkContext.broadcast(held.toArrow()), line_id, by_line), T.StructType(kinds))
    else:
        told = _dealt(rows, held, line_id, sorted(sizes), by_line)
    best = told.groupBy(line_id).agg(F.min(F.struct("_less", "_unit", "_at", "city_id")).alias("b"))
    return best.select(line_id, "b.city_id", (-F.col("b._less")).alias("confidence"))
