"""Matching entities across sources without keys: probabilistic record linkage.

Candidate pairs come from several blocking passes (same number and town, near each other, a rare word of the name in the
same town). Each pair is reduced to levels of agreement of name, address and place, in the JVM. The probabilities of the
levels among matches and non-matches are found by expectation-maximisation over the counts of level patterns (a bounded
table), and a record's matches exclude one another, so that the posterior of a pair is its odds over one plus all odds of
the record.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexora.functions.geo import haversine_m, latlon
from plexora.llm.addresses import FORM, Gazetteer, gazetteer, parsed, place_addresses
from plexora.llm.names import NAME_LEVELS, normal
from plexora.operators.references import plain_key
from plexora.operators.spatial import near_pairs
from plexora.scale import salted_join, stage

ADDRESS_LEVELS = ("other town", "same town", "same number", "same house", "same unit")
PLACE_LEVELS = ("far", "2 km", "300 m", "80 m")
LEVELS = (len(NAME_LEVELS), len(ADDRESS_LEVELS), len(PLACE_LEVELS))
#: Candidates by distance lie at most so far apart, in metres.
NEAR_M = 150.0


def _errors(a: Column, b: Column, most: int) -> Column:
    """Whether two words are at most `most` (1 or 2) errors apart, swapped neighbours counting as one.

    Swaps count double in Levenshtein distance, but leave the sorted letters as they are.
    """
    letters = lambda w: F.array_join(F.array_sort(F.split(w, "")), "")
    d, s = F.levenshtein(a, b, 2 * most), F.levenshtein(letters(a), letters(b), 2)
    if most == 1:
        return (d == 1) | ((d == 2) & (s == 0))
    return d.isin(1, 2) | ((d == 3) & s.isin(0, 1)) | ((d == 4) & (s == 0))


def _close(a: Column, b: Column) -> Column:
    """Two words of a name: equal, or one error apart (of more than 3 letters), or two (of more than 8)."""
    n = F.least(F.length(a), F.length(b))
    return (a == b) | ((n > 3) & _errors(a, b, 1)) | ((n > 8) & _errors(a, b, 2))


def name_levels(a: Column, b: Column) -> Column:
    """Index into NAME_LEVELS of two names in normal form (arrays of words); -1 if a name is missing.

    The same levels as names.name_level gives, but that a single shared word must be equal.
    """
    x, y = F.array_join(a, ""), F.array_join(b, "")
    first = F.size(a) < F.size(b)
    s, t = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    s = F.when((F.size(s) > 1) & (F.element_at(s, -1) == "and"), F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(s)
    every = lambda p, q: F.forall(F.zip_with(p, q, _close), lambda z: z)
    # all but the comparison of the whole names need first words that are close, which few pairs have
    opens = _close(F.get(a, F.lit(0)), F.get(b, F.lit(0)))
    start = every(s, F.slice(t, F.lit(1), F.size(s)))
    ends = (F.size(s) >= 2) & _close(F.element_at(s, -1), F.element_at(t, -1)) & F.forall(s, lambda p: F.exists(t, lambda q: _close(p, q)))
    whole = (F.least(F.length(x), F.length(y)) > 7) & _errors(x, y, 2)
    misspelt = whole | (opens & (F.size(a) == F.size(b)) & every(a, b))
    word = F.arrays_overlap(F.filter(a, lambda w: F.length(w) > 3), b)
    return (
        F.when(F.coalesce(F.size(a), F.lit(0)) < 1, -1).when(F.coalesce(F.size(b), F.lit(0)) < 1, -1)
        .when(x == y, 4).when(misspelt, 3).when(opens & (F.size(s) < F.size(t)) & (start | ends), 2).when(word, 1).otherwise(0)
    )


def address_levels() -> Column:
    """Index into ADDRESS_LEVELS of two addresses in canonical parts, of columns with _l and _r; -1 if one is missing."""
    l, r = (lambda c: F.col(f"{c}_l")), (lambda c: F.col(f"{c}_r"))  # noqa: E741
    same = lambda c: l(c) == r(c)
    street = (same("street") | _errors(l("street"), r("street"), 2)) & same("dir") & (same("type") | (l("type") == "") | (r("type") == ""))
    return (
        F.when((l("street") == "") | (r("street") == ""), -1).when(~same("town"), 0).when(~same("num") | (l("num") == ""), 1)
        .when(~street, 2).when(same("unit"), 4).otherwise(3)
    )


def place_levels(metres: Column) -> Column:
    """Index into PLACE_LEVELS; -1 if a position is missing."""
    return F.when(metres.isNull(), -1).when(metres <= 80, 3).when(metres <= 300, 2).when(metres <= 2000, 1).otherwise(0)


@dataclass
class Linkage:
    """Latent kinds of pairs: the first is the same entity, the others are kinds of non-matches.

    shares: of the kinds. levels: of each comparison, one row of level probabilities per kind.
    """

    shares: np.ndarray
    levels: list[np.ndarray]

    def kinds(self, pattern: tuple[int, ...]) -> np.ndarray:
        """Log-likelihood, with the share, of each kind; a missing value (-1) speaks neither for nor against."""
        out = np.log(self.shares)
        for k, v in enumerate(pattern):
            if v >= 0:
                out = out + np.log(self.levels[k][:, v])
        return out

    def log_odds(self, pattern: tuple[int, ...]) -> float:
        k = self.kinds(pattern)
        return float(k[0] - np.logaddexp.reduce(k[1:]))


#: What the kinds start from, by comparison (name, address, place): 1 agreement, 0 disagreement. Blocking makes candidates
#: agree in something, so non-matches are of three kinds: two entities at one place, neighbours, and entities that share no
#: more than a block. The first two are found by where they are, so their names are those of any two entities: these kinds
#: have one distribution of name levels. Nothing else about them is given.
KINDS = ((1, 1, 1), (0, 1, 1), (0, 0, 1), (0, 0, 0))
BY_PLACE = (1, 2)


class Profiles(dict):
    """Counts of level patterns, with the patterns of each record, whose matches exclude one another.

    profiles: n (records of that profile), p (array of struct<code, cnt>; at most one entry per pattern).
    """

    def __init__(self, counts: dict[tuple[int, ...], float], profiles: DataFrame):
        super().__init__(counts)
        self.codes = {pattern_code(k): k for k in counts}
        self.profiles = profiles

    def matches(self, odds: dict[tuple[int, ...], float]) -> dict[tuple[int, ...], float]:
        """Expected number of matches of each pattern. One narrow pass; a number per pattern comes to the driver."""
        # an array by code, which is looked up in one step; a map would be searched through for every entry
        held = [repr(float(odds[self.codes[c]])) + "D" if c in self.codes else "0D" for c in range(max(self.codes) + 1)]
        known = F.expr(f"array({', '.join(held)})")
        weighed = F.transform("p", lambda x: F.struct(x["code"].alias("code"), (x["cnt"] * F.get(known, x["code"])).alias("w")))
        d = self.profiles.select("n", weighed.alias("p"))
        d = d.select("n", "p", (1 + F.aggregate("p", F.lit(0.0), lambda s, x: s + x["w"])).alias("z"))
        d = d.select("n", "z", F.explode("p").alias("x")).groupBy("x.code").agg(F.sum(F.col("n") * F.col("x.w") / F.col("z")).alias("m"))
        got = {r["code"]: r["m"] for r in d.collect()}
        return {k: got.get(code, 0.0) for code, k in self.codes.items()}


def pattern_code(pattern: tuple[int, ...]) -> int:
    out = 0
    for v in pattern:
        out = 10 * out + v + 1
    return out


def _level_table(g: np.ndarray, at: np.ndarray, levels: tuple[int, ...]) -> list[np.ndarray]:
    """Level probabilities of each kind; half a pair per level as prior knowledge, so that no level is impossible."""
    out = []
    for c, size in enumerate(levels):
        a = np.full((g.shape[1], size), 0.5)
        for v in range(size):
            a[:, v] += g[at[:, c] == v].sum(0)
        if c == 0:
            a[BY_PLACE, :] = a[BY_PLACE, :].sum(0)
        out.append(a / a.sum(1, keepdims=True))
    return out


def expectation_maximisation(patterns: dict[tuple[int, ...], float], levels: tuple[int, ...] = LEVELS, rounds: int = 40, inner: int = 50) -> Linkage:
    """Fits the kinds' shares and level probabilities to counts of level patterns; levels rise with agreement.

    The E-step of the match kind lets a record's matches exclude one another where the patterns come as Profiles: so
    another firm at a host's address is told from the host by the records that have both, and nothing has to be known
    beforehand about names. Plain counts are pairs of records of their own. Between two such steps the kinds of
    non-matches are fitted to what is left. Ends when no share changes any more. No counts give the model that the kinds
    start from.
    """
    rise = [np.linspace(0.15, 1.0, n) ** 5 for n in levels]
    start = [np.array([(s if kind[c] else s[::-1]) / s.sum() for kind in KINDS]) for c, s in enumerate(rise)]
    model = Linkage(np.full(len(KINDS), 1 / len(KINDS)), start)
    keys = list(patterns)
    n = np.array([patterns[k] for k in keys], float)
    if not keys or n.sum() == 0:
        return model
    at = np.array(keys)
    for _ in range(rounds):
        odds = {k: float(np.exp(min(300.0, model.log_odds(k)))) for k in keys}
        if isinstance(patterns, Profiles):
            got = patterns.matches(odds)
            match = np.array([got[k] for k in keys])
        else:
            match = np.array([patterns[k] * odds[k] / (1 + odds[k]) for k in keys])
        rest, old = np.maximum(n - match, 0.0), model
        for _ in range(inner):
            ll = np.array([model.kinds(k)[1:] for k in keys])
            g = np.exp(ll - ll.max(1, keepdims=True))
            g = np.column_stack([match, g * (rest / g.sum(1))[:, None]])
            shares = np.maximum(g.sum(0), 1e-3)
            model = Linkage(shares / shares.sum(), _level_table(g, at, levels))
        if np.abs(old.shares - model.shares).max() < 1e-4:
            break
    return model


COMPARED = ("words", "lat", "lon", *FORM)


def _side(d: DataFrame, s: str, *more: str) -> DataFrame:
    return d.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", *COMPARED)], *more)


def _met(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both sides joined on a block key, left rows of a heavy block split over several tasks."""
    return salted_join(left, right, key, "inner", ["id_l"])


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """id_l, id_r, metres and the compared columns of both sides, of the blocking passes, each pair once.

    Both sides: id, words (of the name), lat, lon, home (a town) and the FORM parts. 1. the same house number in the same
    town; 2. at most NEAR_M apart; 3. in the same town, the rarest word of the left name that any name there has. A record
    without what a pass needs takes no part in it. A pass leaves out what an earlier one has found.
    """
    l, r = (lambda c: F.col(f"{c}_l")), (lambda c: F.col(f"{c}_r"))  # noqa: E741
    metres = haversine_m(l("lat"), l("lon"), r("lat"), r("lon")).alias("metres")
    house = F.when((F.col("num") != "") & (F.col("town") != ""), F.concat_ws("|", "num", "town")).alias("block")
    in_house = lambda d, s: _side(d, s, house).where(F.col("block").isNotNull())
    one = _met(in_house(left, "l"), in_house(right, "r"), "block").select("*", metres)
    same_house = (l("num") != "") & (l("town") != "") & (l("num") == r("num")) & (l("town") == r("town"))
    place = lambda d, s: d.select("id", "lat", "lon", *[F.col(c).alias(f"{c}_{s}") for c in COMPARED])
    two = near_pairs(place(left, "l"), place(right, "r"), NEAR_M).where(~same_house)
    word = F.explode(F.array_distinct("words")).alias("word")
    block = F.concat_ws("|", "home", "word").alias("block")
    known = right.where(F.col("home") != "").select("id", "home", word).select("id", block)
    common = known.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    asked = left.where(F.col("home") != "").select("id", "home", word).select("id", block)
    asked = salted_join(asked, common, "block", "inner", ["id"]).groupBy("id").agg(F.min(F.struct("n", "block")).alias("b")).select("id", "b.block")
    probe = _side(left, "l").join(asked.withColumnRenamed("id", "id_l"), "id_l")
    held = _side(right, "r").join(known.withColumnRenamed("id", "id_r"), "id_r")
    near_too = F.coalesce(F.col("metres") <= NEAR_M, F.lit(False))
    three = _met(probe, held, "block").select("*", metres).where(~same_house & ~near_too)
    cols = [f"{c}_{s}" for s in "lr" for c in ("id", *COMPARED)]
    return one.select(*cols, "metres").unionByName(two.select(*cols, "metres")).unionByName(three.select(*cols, "metres"))


def link(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """id_l, id_r, confidence: for each left record its likeliest right record, if the posterior exceeds `least`.

    Missing values speak neither for nor against. Ties of the posterior can't exceed one half each, so a record that
    fits two others equally well is matched with none. An empty side gives no rows.
    """
    pairs = candidates(left, right)
    levels = {"n": name_levels(F.col("words_l"), F.col("words_r")), "a": address_levels(), "g": place_levels(F.col("metres"))}
    lv = stage(pairs.select("id_l", "id_r", *[c.cast("int").alias(k) for k, c in levels.items()]), "linkage-levels")
    code = (F.col("n") + 1) * 100 + (F.col("a") + 1) * 10 + F.col("g") + 1
    one = lv.groupBy("id_l", code.alias("code")).agg(F.count(F.lit(1)).alias("cnt"))
    profiles = one.groupBy("id_l").agg(F.array_sort(F.collect_list(F.struct("code", "cnt"))).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    counts = {(r["n"], r["a"], r["g"]): float(r["count"]) for r in lv.groupBy("n", "a", "g").count().collect()}
    fitted = expectation_maximisation(Profiles(counts, stage(profiles, "linkage-profiles")))
    table = [(k[0], k[1], k[2], fitted.log_odds(k)) for k in counts]
    # one row per pattern that occurs: at most 6 * 6 * 5
    scores = left.sparkSession.createDataFrame(table, "n int, a int, g int, lo double")
    s = lv.join(F.broadcast(scores), ["n", "a", "g"]).withColumn("odds", F.exp(F.least(F.lit(300.0), F.col("lo"))))
    best = s.groupBy("id_l").agg(F.sum("odds").alias("z"), F.max(F.struct("odds", "id_r")).alias("b"))
    best = best.select("id_l", F.col("b.id_r").alias("id_r"), (F.col("b.odds") / (1 + F.col("z"))).alias("confidence"))
    return best.where(F.col("confidence") > least)


def compared(records: DataFrame, towns: Gazetteer) -> DataFrame:
    """Replaces name and address by words (the name's normal form; none for a missing name) and the FORM parts."""
    rec = parsed(records, towns)
    keep = [f for f in rec.schema.fields if f.name != "name"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "words array<string>"])

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            words = [list(normal(n if isinstance(n, str) else None, t or "")) for n, t in zip(pdf["name"], pdf["town"])]
            yield pdf.drop(columns=["name"]).assign(words=words)

    return rec.mapInPandas(work, schema)


def hosts_of_events(events: DataFrame, places: DataFrame, localities: DataFrame, least: float = 0.5) -> DataFrame:
    """eventid, place_id, confidence: the fetched business that hosts each event without a host key.

    Looked at are events whose host key is null, blank or a filler and that have an address or usable coordinates; of an
    event delivered more than once the last row counts (of rows that arrived at once the greatest). At most one place per
    event.
    """
    towns = gazetteer(localities)
    open_ = events.where(F.col("eventid").isNotNull() & plain_key(F.col("hostbusinessid")).isNull())
    row = F.struct("ingested_at", F.col("hostbusinessname").alias("name"), "address", "coordinates", "locality")
    last = open_.groupBy(F.col("eventid").alias("id")).agg(F.max(row).alias("s"))
    ev = last.select("id", "s.name", "s.address", latlon(F.col("s.coordinates")).alias("p"), F.col("s.locality").alias("locality"))
    ev = ev.where((F.trim(F.coalesce("address", F.lit(""))) != "") | F.col("p").isNotNull())
    ev = ev.select("id", "name", "address", "p.lat", "p.lon", "locality")
    home = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")
    left = stage(compared(ev, towns).withColumn("home", F.when(F.col("town") != "", F.col("town")).otherwise(home(F.col("locality")))).drop("locality"), "linkage-left")
    right = stage(compared(place_addresses(places), towns).withColumn("home", F.col("town")), "linkage-right")
    return link(left, right, least).select(F.col("id_l").alias("eventid"), F.col("id_r").alias("place_id"), "confidence")
