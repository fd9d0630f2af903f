"""Same postal address written differently: numbers first.

An address is reduced to canonical tokens (house number, unit, direction, street words, street type, town). Records are
blocked on their sorted digit tokens plus one rare word, which is the town, told by its post code or by its name with up
to one typing error, or where the town stays unknown the street. Within a block the other tokens are intersected; what they share is
weighed by rarity, and words left over on both sides must be one another's misspelling by Levenshtein distance.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexora.scale import salted_join, stage

#: Spellings of street types, of directions and of unit labels.
TYPES = {
    "street": "street st str strasse straße", "avenue": "avenue ave av aven", "boulevard": "boulevard blvd boul blv",
    "road": "road rd", "lane": "lane ln la", "drive": "drive dr drv", "court": "court ct crt", "circle": "circle cir circ crcl",
    "terrace": "terrace ter terr", "trail": "trail trl tr", "parkway": "parkway pkwy pky pkway", "highway": "highway hwy hiway",
    "place": "place plc", "square": "square sq", "way": "way wy", "alley": "alley aly", "loop": "loop", "crescent": "crescent cres",
    "weg": "weg", "gasse": "gasse g", "platz": "platz pl", "allee": "allee al",
}
DIRECTIONS = {
    "n": "n north", "s": "s south", "e": "e east", "w": "w west", "ne": "ne northeast", "nw": "nw northwest",
    "se": "se southeast", "sw": "sw southwest",
}
UNITS = set("suite ste unit apt apartment appt room rm office ofc flat fl floor bldg".split())
#: Endings of one-word street names of the form name + type, longest first.
COMPOUND = (("strasse", "street"), ("gasse", "gasse"), ("platz", "platz"), ("allee", "allee"), ("weg", "weg"), ("str", "street"))
SHORT = {"pl": "platz", "g": "gasse", "str": "strasse"}
_TYPE = {w: k for k, ws in TYPES.items() for w in ws.split()}
_DIR = {w: k for k, ws in DIRECTIONS.items() for w in ws.split()}
_SPLIT = re.compile(r"[^\w#]+|(?=#)|(?<=#)")
_LONG_CODE, _LETTER_CODE = re.compile(r"\b(\d{5})-\d{4}\b"), re.compile(r"\b[a-z]-(\d{5})\b")
_NUMBER_SIGN = re.compile(r"\b(?:no|nr|number)\b\.?\s*(?=\d)")
_SHORT_END = re.compile(r"(?<=[^\W\d_]{4})(pl|g|str)\.(?=\W|$|\d)")
_UNIT, _NUM = re.compile(r"#|[a-z]?\d{1,4}[a-z]?|[a-z]"), re.compile(r"\d+[a-z]?")
#: Most towns of a gazetteer that every task may hold.
MAX_TOWNS = 50_000
#: Words that a task remembers the answers to.
MEMO = 100_000


def _plain(text: str) -> str:
    t = text.casefold()
    if t.isascii():
        return t
    t = unicodedata.normalize("NFKD", t)
    return "".join(c for c in t if not unicodedata.combining(c))


def deletes(word: str) -> set[str]:
    """The word and every word that lacks one of its letters: two words that share one are at most two errors apart."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def damerau(a: str, b: str, most: int = 3) -> int:
    """Edits with swaps of neighbours as one, or most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, older = row, [i], before
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            row.append(v)
        before = last
        if min(row) > most:
            return most + 1
    return row[-1]


@dataclass
class Gazetteer:
    """Towns by post code and by name (with one typing error), and names of regions."""

    by_code: dict[str, str]
    names: set[str]
    near: dict[str, set[str]]
    regions: set[tuple[str, ...]]
    codes: set[str]

    def __post_init__(self) -> None:
        #: regions by what their first word leaves when a letter is deleted, and answers to words met before
        self.starts: dict[str, set[tuple[str, ...]]] = {}
        for r in self.regions:
            for d in deletes(r[0]) if r else ():
                self.starts.setdefault(d, set()).add(r)
        self.known_starts: dict[str, tuple[tuple[str, ...], ...]] = {}
        self.known_towns: dict[str, str | None] = {}

    def regions_from(self, word: str) -> tuple[tuple[str, ...], ...]:
        """Regions whose first word is this word, or at most one error away from it; in order."""
        hit = self.known_starts.get(word)
        if hit is None:
            some = {r for d in deletes(word) for r in self.starts.get(d, ())}
            hit = tuple(sorted(r for r in some if damerau(word, r[0], 1) <= (1 if len(r[0]) > 3 else 0)))
            if len(self.known_starts) > MEMO:
                self.known_starts.clear()
            self.known_starts[word] = hit
        return hit

    @staticmethod
    def of(rows: list[tuple[str | None, str | None, str | None, str | None]]) -> Gazetteer:
        by_code, names, near, regions, codes = {}, set(), {}, set(), set()
        for title, region, code, post in rows:
            if title:
                t = _plain(title).replace(" ", "")
                names.add(t)
                for d in deletes(t):
                    near.setdefault(d, set()).add(t)
                if post:
                    by_code[post.strip()] = t
            if region:
                regions.add(tuple(_plain(region).split()))
            if code:
                codes.add(code.casefold())
        return Gazetteer(by_code, names, near, regions, codes)

    def town(self, word: str) -> str | None:
        """The only town whose name is this word, or one error away from it."""
        if word in self.names:
            return word
        if len(word) < 5:
            return None
        if word not in self.known_towns:
            near = {t for d in deletes(word) for t in self.near.get(d, ()) if damerau(word, t, 1) <= 1}
            if len(self.known_towns) > MEMO:
                self.known_towns.clear()
            self.known_towns[word] = next(iter(near)) if len(near) == 1 else None
        return self.known_towns[word]


@dataclass
class Address:
    num: str = ""
    unit: str = ""
    dir: str = ""
    street: str = ""
    type: str = ""
    town: str = ""
    rest: str = ""


def _is_region(words: list[str], i: int, g: Gazetteer) -> int:
    """How many words from i on are the name of a region, allowing one error in each."""
    for r in g.regions_from(words[i]):
        n = len(r)
        if i + n <= len(words) and all(damerau(a, b, 1) <= (1 if len(b) > 3 else 0) for a, b in zip(words[i + 1 : i + n], r[1:])):
            return n
    return 0


def parse(text: str, g: Gazetteer) -> Address:
    """Canonical tokens of an address in any order of its parts."""
    t = _plain(text)
    t = _LONG_CODE.sub(r"\1", t)
    t = _LETTER_CODE.sub(r"\1", t)
    t = _NUMBER_SIGN.sub("", t)
    # short endings of compounds are known by their full stop
    t = _SHORT_END.sub(lambda m: SHORT[m.group(1)], t)
    words = [w for w in _SPLIT.split(t) if w and w != "_"]
    a = Address()
    # post code: a number of five digits that the gazetteer knows, else one that isn't the only number
    numbers = [i for i, w in enumerate(words) if w.isdigit()]
    code = next((i for i in reversed(numbers) if words[i] in g.by_code), None)
    if code is None:
        five = [i for i in numbers if len(words[i]) == 5]
        code = five[-1] if five and len(numbers) > 1 else None
    if code is not None:
        a.town = g.by_code.get(words[code], "")
        words[code] = "|"
    # unit: a label and the token after it
    out: list[str] = []
    i = 0
    while i < len(words):
        w = words[i]
        if (w == "#" or w in UNITS) and i + 1 < len(words) and _UNIT.fullmatch(words[i + 1]):
            j = i + 1
            while j < len(words) and words[j] == "#":
                j += 1
            if j < len(words):
                a.unit = words[j].lstrip("0") or words[j]
            i = j + 1
            continue
        out.append(w)
        i += 1
    words = [w for w in out if w != "#"]
    # regions: names of several words first, then two-letter codes beside the end or a post code
    i = 0
    kept: list[str] = []
    while i < len(words):
        n = _is_region(words, i, g)
        if n and (n > 1 or len(words[i]) > 3):
            kept.append("|")
            i += n
            continue
        kept.append("|" if words[i] in g.codes and len(words[i]) == 2 else words[i])
        i += 1
    words = kept
    # house number: the first number left, with a letter perhaps
    for i, w in enumerate(words):
        if _NUM.fullmatch(w):
            a.num = w.lstrip("0") or w
            words[i] = "|"
            break
    # town by name; of several candidates the last, an exact name before a misspelt one
    at = [(w in g.names, i, g.town(w)) for i, w in enumerate(words) if w.isalpha()]
    hit = max(((e, i, c) for e, i, c in at if c), default=None)
    if a.town:
        same = [i for _, i, c in at if c == a.town] or [i for i, w in enumerate(words) if w.isalpha() and len(w) > 4 and damerau(w, a.town, 2) <= 2]
        if same:
            words[same[-1]] = "|"
    elif hit:
        a.town = hit[2]
        words[hit[1]] = "|"
    left = [w for w in words if w != "|"]
    # direction and type
    for i, w in enumerate(left):
        if w in _DIR and len(left) > 1:
            a.dir = _DIR[w]
            del left[i]
            break
    for i in range(len(left) - 1, 0, -1):
        if left[i] in _TYPE:
            a.type = _TYPE[left[i]]
            del left[i]
            break
    if not a.type and left:
        for end, kind in COMPOUND:
            k = max(range(len(left)), key=lambda x: len(left[x]))
            w = left[k]
            if w.endswith(end) and len(w) - len(end) >= 4 and len(end) > 2:
                a.type, left[k] = kind, w[: -len(end)]
                break
        else:
            _misspelt_type(a, left)
    a.street = "".join(left)
    return a


def _misspelt_type(a: Address, left: list[str]) -> None:
    """A type word, or the ending of a compound, with one typing error."""
    for i in range(len(left) - 1, 0, -1):
        for full in TYPES:
            if len(full) > 3 and damerau(left[i], full, 1) == 1:
                a.type = full
                del left[i]
                return
    k = max(range(len(left)), key=lambda x: len(left[x])) if left else 0
    if left:
        w = left[k]
        for end, kind in COMPOUND[:4]:
            for n in (len(end), len(end) + 1, len(end) - 1):
                if len(w) - n >= 4 and damerau(w[-n:], end, 1) == 1 and w[-n] == end[0]:
                    a.type, left[k] = kind, w[:-n]
                    return


FORM = ("num", "unit", "dir", "street", "type", "town")


def gazetteer(localities: DataFrame) -> Gazetteer:
    """The towns for every task; refused beyond MAX_TOWNS, as a broadcast needs a bound."""
    rows = localities.select("title", "region", "regioncode", "postcode").distinct().limit(MAX_TOWNS + 1).collect()
    if len(rows) > MAX_TOWNS:
        raise ValueError(f"more than {MAX_TOWNS} localities")
    return Gazetteer.of([tuple(r) for r in rows])


def parsed(records: DataFrame, towns: Gazetteer, address: str = "address") -> DataFrame:
    """Replaces `address` by its canonical parts; null and blank addresses get empty parts. One narrow pass."""
    keep = [f for f in records.schema.fields if f.name != address]
    shared = records.sparkSession.sparkContext.broadcast(towns)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"{c} string" for c in FORM)])

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, seen = shared.value, {}
        for pdf in it:
            out = []
            for t in pdf[address]:
                a = seen.get(t)
                if a is None:
                    p = parse(t, g) if isinstance(t, str) and t.strip() else Address()
                    a = seen[t] = tuple(getattr(p, c) for c in FORM)
                    if len(seen) > 100_000:
                        seen.clear()
                out.append(a)
            yield pdf.drop(columns=[address]).assign(**{c: [a[i] for a in out] for i, c in enumerate(FORM)})

    return records.mapInPandas(work, schema)


def place_addresses(places: DataFrame) -> DataFrame:
    """id, address, name, lat, lon of each place's newest fetch (of several at once the greatest payload)."""
    last = places.where(F.col("place_id").isNotNull()).groupBy(F.col("place_id").alias("id")).agg(F.max(F.struct("fetched_at", "payload")).alias("s"))
    j = F.from_json(
        F.col("s.payload"), "formattedAddress string, displayName struct<text: string>, location struct<latitude: double, longitude: double>"
    )
    return last.select("id", j.alias("j")).select(
        "id",
        F.col("j.formattedAddress").alias("address"),
        F.col("j.displayName.text").alias("name"),
        F.col("j.location.latitude").alias("lat"),
        F.col("j.location.longitude").alias("lon"),
    )


def _tokens() -> Column:
    return F.filter(F.array(*[F.when(F.col(c) != "", F.concat(F.lit(c + ":"), F.col(c))) for c in FORM]), lambda x: x.isNotNull())


def block_key() -> Column:
    """Sorted digit tokens and one rare word: the town, or the street of an address whose town isn't known."""
    digits = F.array_sort(F.filter(F.array("num", "unit"), lambda x: x != ""))
    return F.concat_ws("|", F.concat_ws(" ", digits), F.when(F.col("town") != "", F.col("town")).otherwise(F.concat(F.lit("?"), F.col("street"))))


def match_forms(forms: DataFrame, least: float = 0.75) -> DataFrame:
    """fa, fb: pairs of different canonical forms that denote the same location, smaller form first.

    forms: form, its parts, and has_place; pairs without a place on either side aren't looked for. Digits, direction and
    town must agree. What the token sets share, weighed by rarity, and words that are each other's misspelling must make
    up at least `least` of the weight of the tokens of the form with fewer of them. A missing street type agrees with any
    type, unless places of the same number and street with different types are there: then it isn't known which is meant.
    """
    toks = forms.select("*", _tokens().alias("tokens"))
    total = F.lit(1.0) * max(1, forms.count())
    rare = (
        toks.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.log(1 + total / F.count(F.lit(1))).alias("w"))
    )
    weighed = (
        toks.select("form", F.explode("tokens").alias("t")).join(rare, "t").groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("t", "w"))).alias("w"))
    )
    side = toks.withColumn("key", block_key()).join(weighed, "form")
    a = side.select("key", *[F.col(c).alias(f"{c}_a") for c in ("form", "has_place", "tokens", "w", "num", "unit", "dir", "street", "type", "town")])
    b = side.select("key", *[F.col(c).alias(f"{c}_b") for c in ("form", "has_place", "tokens", "w", "num", "unit", "dir", "street", "type", "town")])
    same = lambda c: F.col(f"{c}_a") == F.col(f"{c}_b")
    # forms of a key that holds very many are split over several tasks
    p = salted_join(a, b, "key", "inner", ["form_a"]).where((F.col("form_a") < F.col("form_b")) & (F.col("has_place_a") | F.col("has_place_b")))
    p = p.where(same("num") & same("unit") & same("dir") & same("town") & (same("type") | (F.col("type_a") == "") | (F.col("type_b") == "")))
    weight = lambda ts, m: F.aggregate(ts, F.lit(0.0), lambda acc, t: acc + F.coalesce(m[t], F.lit(0.0)))
    shared = F.array_intersect("tokens_a", "tokens_b")
    miss = misspelt(F.col("street_a"), F.col("street_b"))
    fuzzy = F.when(
        miss,
        F.greatest(F.col("w_a")[F.concat(F.lit("street:"), F.col("street_a"))], F.col("w_b")[F.concat(F.lit("street:"), F.col("street_b"))]),
    ).otherwise(0.0)
    ok_words = same("street") | miss
    got = weight(shared, F.col("w_a")) + fuzzy
    least_all = F.least(weight(F.col("tokens_a"), F.col("w_a")), weight(F.col("tokens_b"), F.col("w_b")))
    hit = p.where(ok_words & (got >= least * least_all)).select(
        F.col("form_a").alias("fa"), F.col("form_b").alias("fb"), "type_a", "type_b", "has_place_a", "has_place_b"
    )
    return _known_types(stage(hit, "address-matches"))  # read four times


def misspelt(a: Column, b: Column) -> Column:
    """Whether two words are each one typing error away from the same word: changed, added, left out or swapped letters.

    Swaps count double in Levenshtein distance, but leave the set of letters as it is. Words of fewer than five letters
    may differ by one error only.
    """
    sorted_ = lambda w: F.array_join(F.array_sort(F.split(w, "")), "")
    d, s = F.levenshtein(a, b), F.levenshtein(sorted_(a), sorted_(b))
    short = F.least(F.length(a), F.length(b)) < 5
    return (d == 1) | ((d == 2) & ((s == 0) | ~short)) | (~short & (((d == 3) & (s <= 2)) | ((d == 4) & (s == 0))))


def _known_types(hit: DataFrame) -> DataFrame:
    """Drops pairs of a form without a type whose partners have different types."""
    open_a = hit.where((F.col("type_a") == "") & (F.col("type_b") != "")).select(F.col("fa").alias("f"), F.col("type_b").alias("t"))
    open_b = hit.where((F.col("type_b") == "") & (F.col("type_a") != "")).select(F.col("fb").alias("f"), F.col("type_a").alias("t"))
    torn = open_a.unionByName(open_b).groupBy("f").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where(F.col("lo") != F.col("hi")).select("f")
    mixed = hit.where((F.col("type_a") == "") != (F.col("type_b") == ""))
    plain = hit.where((F.col("type_a") == "") == (F.col("type_b") == ""))
    mixed = mixed.withColumn("f", F.when(F.col("type_a") == "", F.col("fa")).otherwise(F.col("fb"))).join(torn, "f", "left_anti")
    return plain.select("fa", "fb").unionByName(mixed.select("fa", "fb"))


def same_locations(events: DataFrame, places: DataFrame, localities: DataFrame) -> DataFrame:
    """id_a, id_b, smaller first: pairs of two places, or of an event and a place, at the same house number, street (with
    type and direction), unit and town.

    A place has the address of its newest fetch. Records without an id, an address, a house number or a street are in no
    pair; an event whose rows have several addresses has them all. Each pair comes once. Equal addresses are reduced to
    one canonical form before any are compared, so that copies aren't compared with one another.
    """
    towns = gazetteer(localities)
    pl = place_addresses(places).where(F.trim("address") != "").select("id", F.lit(True).alias("place"), "address")
    ev = events.where(F.col("eventid").isNotNull() & (F.trim("address") != "")).select(F.col("eventid").alias("id"), F.lit(False).alias("place"), "address").distinct()
    rec = parsed(pl.unionByName(ev), towns).where((F.col("num") != "") & (F.col("street") != ""))
    rec = stage(rec.withColumn("form", F.concat_ws("|", *FORM)), "address-records")
    forms = stage(rec.groupBy("form", *FORM).agg(F.max("place").alias("has_place")), "address-forms")
    links = stage(match_forms(forms), "address-links")
    own = forms.where("has_place").select(F.col("form").alias("fa"), F.col("form").alias("fb"))
    both = links.unionByName(links.select(F.col("fb").alias("fa"), F.col("fa").alias("fb"))).unionByName(own)
    left = rec.where("place").select(F.col("form").alias("fa"), F.col("id").alias("p"))
    right = rec.select(F.col("form").alias("fb"), F.col("id").alias("o"), "place")
    pairs = left.join(both, "fa").select("p", "fb").join(right, "fb").where((F.col("p") != F.col("o")) & (~F.col("place") | (F.col("p") < F.col("o"))))
    return pairs.select(F.least("p", "o").alias("id_a"), F.greatest("p", "o").alias("id_b")).distinct()
