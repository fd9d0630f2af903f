"""Discovery: from a typed query to filters, and the filters over records. The clock is always a parameter."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexora.functions.text import json_list

#: Words people type for an amenity, the amenity as records have it, and its note.
AMENITIES = (
    (r"\b(kid|child|children|family)[ -]?(friendly)?\b|\btoddlers?\b|\bwith kids\b", "good for children", "Kid-friendly"),
    (r"\b(outdoor seating|patio|al fresco|outdoor dining|deck seating|eat outside)\b", "outdoor seating", "Outdoor seating"),
    (r"\b(takeout|take[ -]?out|to[ -]?go|carry[ -]?out|takeaway)\b", "takeout", "Takeout"),
    (r"\b(delivery|delivers?|deliver)\b", "delivery", "Delivery"),
    (r"\b(dine[ -]?in|sit[ -]?down)\b", "dine-in", "Dine-in"),
    (r"\b(cocktails?|craft cocktails|mixed drinks|old fashioned)\b", "serves cocktails", "Cocktails"),
    (r"\b(on tap|craft beer|brews|beer garden|biergarten)\b", "serves beer", "Beer"),
    (r"\b(wine list|wine bar|glass of wine)\b", "serves wine", "Wine"),
    (r"\b(reservations?|reservable|book a table)\b", "reservable", "Takes reservations"),
    (r"\b(live music|live band)\b", "live music", "Live music"),
)
#: Phrases that are requirements only and are taken out of the text.
CHEAP = r"\b(cheap|inexpensive|budget|affordable|low[ -]?cost|good value)\b"
UPSCALE = r"\b(upscale|fancy|fine dining|high[ -]?end|expensive|splurge|pricey)\b"
OPEN = r"\b(open (now|right now|late|today)|right now|open at this hour)\b"
TOP = r"\b(best|top[ -]?rated|highly[ -]?rated|highest[ -]?rated|well[ -]?reviewed|great reviews|top notch)\b"
GEMS = r"\b(hidden gems?|underrated|under[- ]the[- ]radar|off the beaten (path|track)|secret spots?|local secret|undiscovered|lesser[- ]known|hole[- ]in[- ]the[- ]wall)\b"
TOP_RATING = 4.3
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


@dataclass
class Filters:
    """Structured constraints; None or empty means none."""

    rating_gte: float | None = None
    price_levels: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    localities: list[str] = field(default_factory=list)
    amenities: list[str] = field(default_factory=list)
    upcoming_only: bool = False
    free_only: bool = False
    date_window: str | None = None
    open_now: bool = False


@dataclass
class Reading:
    """What a query says: the text to embed, filters, notes on what was understood, and whether only gems are wanted."""

    semantic: str
    filters: Filters
    notes: list[str]
    gems_only: bool = False


#: What a phrase means, in the order in which phrases are read: pattern, note, filters it sets, and a group of which the
#: first phrase found counts. Phrases of no group stand for themselves.
PHRASES: tuple[tuple[str, str, dict[str, object], str | None], ...] = (
    (CHEAP, "Budget-friendly", {"price_levels": ["$", "$$"]}, "price"),
    (UPSCALE, "Upscale", {"price_levels": ["$$$", "$$$$"]}, "price"),
    (OPEN, "Open now", {"open_now": True}, None),
    (TOP, "Top-rated", {"rating_gte": TOP_RATING}, None),
    (GEMS, "Hidden gems", {}, None),
)


def interpret(raw: str) -> Reading:
    """Amenities are read and kept in the text; price, opening, rating and gem phrases are read and taken out.

    A query of nothing but constraints keeps its own words as text, unless it asks for gems only.
    """
    text, settled, said = f" {raw} ", set(), []
    wanted = [(amenity, note) for rx, amenity, note in AMENITIES if re.search(rx, text, re.I)]
    values: dict[str, object] = {"amenities": [a for a, _ in wanted]}
    for rx, note, sets, group in PHRASES:
        rest, hits = re.subn(rx, " ", text, count=1, flags=re.I)
        if hits and group not in settled:
            text, said, values = rest, [*said, note], {**values, **sets}
            settled |= {group} - {None}
    gems, plain = "Hidden gems" in said, " ".join(text.split())
    return Reading(plain or ("" if gems else raw.strip()), Filters(**values), [*(n for _, n in wanted), *said], gems)


def reading_of_answer(answer: Mapping[str, object]) -> Reading:
    """A model's answer in the closed vocabulary (price, openNow, topRated, gems, amenities); anything else is ignored."""
    f, notes = Filters(), []
    price = {"cheap": (["$", "$$"], "Budget-friendly"), "upscale": (["$$$", "$$$$"], "Upscale")}.get(answer.get("price"))  # type: ignore[arg-type]
    if price:
        f.price_levels = price[0]
        notes.append(price[1])
    if answer.get("openNow") is True:
        f.open_now = True
        notes.append("Open now")
    if answer.get("topRated") is True:
        f.rating_gte = TOP_RATING
        notes.append("Top-rated")
    gems = answer.get("gems") is True
    if gems:
        notes.append("Hidden gems")
    known = {a: n for _, a, n in AMENITIES}
    listed = answer.get("amenities")
    for a in listed if isinstance(listed, list) else []:
        if a in known and a not in f.amenities:
            f.amenities.append(a)
            notes.append(known[a])
    return Reading("", f, notes, gems)


def merge_filters(base: Filters, add: Filters) -> Filters:
    """What base says stands, add fills what it leaves open; amenities are united, the added ones first."""
    b, a = asdict(base), asdict(add)
    out = {k: b[k] or a[k] for k in b}
    out["amenities"] = list(dict.fromkeys([*add.amenities, *base.amenities]))
    return Filters(**out)


def merge_readings(rules: Reading, model: Reading) -> Reading:
    """The rules' text and constraints stand; the model only adds."""
    return Reading(rules.semantic, merge_filters(rules.filters, model.filters), list(dict.fromkeys([*rules.notes, *model.notes])), rules.gems_only or model.gems_only)


def date_window(window: str, today: date) -> tuple[str, str]:
    """First and last ISO date of today, of the (rest of the) weekend, or of the days up to Sunday."""
    sunday = today + timedelta(days=6 - today.weekday())
    first, last = today, today
    if window == "week":
        last = sunday
    elif window == "weekend" and today.weekday() != 6:
        first, last = max(today, sunday - timedelta(days=1)), sunday
    return first.isoformat(), last.isoformat()


def open_at(hours: Column, now: datetime) -> Column:
    """Whether opening hours ("Monday: 9 AM – 5 PM; Tuesday: Closed; …") include a moment; null if they can't be read.

    Several ranges a day, "Open 24 hours", and ranges over midnight, which are also looked up for the day before.
    """
    minute = now.hour * 60 + now.minute
    today, before = DAYS[(now.weekday() + 1) % 7], DAYS[now.weekday() % 7]
    clean = F.regexp_replace(F.regexp_replace(hours, "[   ]", " "), "[–—]", "-")
    rows = F.transform(F.split(clean, ";"), lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("day"), F.trim(F.regexp_replace(p, "^[^:]*:?", "")).alias("h")))
    clock = r"(?i)(\d{1,2})(?::(\d{2}))?\s*([AP])M"

    def at(s: Column) -> Column:
        h, m, p = (F.regexp_extract(s, clock, i) for i in (1, 2, 3))
        v = (h.try_cast("int") % 12) * 60 + F.coalesce(F.nullif(m, F.lit("")).try_cast("int"), F.lit(0)) + F.when(F.upper(p) == "P", 720).otherwise(0)
        return F.when(s.rlike(clock), v)

    def ranges(h: Column) -> Column:
        cut = F.transform(F.split(h, ","), lambda s: F.struct(at(F.substring_index(s, "-", 1)).alias("a"), at(F.regexp_replace(s, "^[^-]*-", "")).alias("b"), s.contains("-").alias("ok")))
        some = F.filter(F.transform(F.filter(cut, lambda r: r["ok"]), lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"))), lambda r: r["a"].isNotNull() & r["b"].isNotNull())
        whole = F.array(F.struct(F.lit(0).alias("a"), F.lit(1440).alias("b")))
        none = F.filter(whole, lambda r: F.lit(False))
        return F.when(h.rlike("(?i)closed"), none).when(h.rlike(r"(?i)24\s*hours"), whole).otherwise(some)

    of = lambda day: F.flatten(F.transform(F.filter(rows, lambda r: r["day"] == day), lambda r: ranges(r["h"])))
    readable = F.exists(rows, lambda r: r["day"].isin(*DAYS) & (r["h"].rlike(r"(?i)closed|24\s*hours") | (F.size(ranges(r["h"])) > 0)))
    now_open = F.exists(of(today), lambda r: F.when(r["b"] > r["a"], (r["a"] <= minute) & (r["b"] > minute)).otherwise(r["a"] <= minute))
    late = F.exists(of(before), lambda r: (r["b"] <= r["a"]) & (r["b"] > minute))
    return F.when(hours.contains(":") & readable, now_open | late)


def matches(df: DataFrame, f: Filters, now: datetime) -> Column:
    """The filters as one condition. Rating, price, category, locality and amenity need the field; upcoming, free, date
    and opening pass records that don't have theirs."""
    has = lambda c: c in df.columns
    no, out = F.lit(False), F.lit(True)
    if f.rating_gte:
        out = out & (F.coalesce(F.col("rating") >= f.rating_gte, no) if has("rating") else no)
    if f.price_levels:
        out = out & (F.coalesce(F.col("price_level").isin(*f.price_levels), no) if has("price_level") else no)
    if f.categories:
        out = out & (F.coalesce(F.arrays_overlap("categories", F.array(*map(F.lit, f.categories))), no) if has("categories") else no)
    if f.localities:
        out = out & (F.coalesce(F.col("locality").isin(*f.localities), no) if has("locality") else no)
    if f.amenities:
        wanted = F.array(*map(F.lit, f.amenities))
        out = out & (F.coalesce(F.arrays_overlap(json_list(F.col("amenities")), wanted), no) if has("amenities") else no)
    if f.upcoming_only and has("is_past"):
        out = out & ~F.coalesce(F.col("is_past"), no)
    if f.free_only and has("is_free"):
        out = out & F.coalesce(F.col("is_free"), F.lit(True))
    if f.date_window and has("start_date"):
        a, b = date_window(f.date_window, now.date())
        out = out & F.coalesce(F.substring("start_date", 1, 10).between(a, b), F.lit(True))
    if f.open_now and has("hours"):
        out = out & F.coalesce(open_at(F.col("hours"), now), F.lit(True))
    return out


def events_of_host(events: DataFrame, host: str) -> DataFrame:
    """A host's events: those to come in order of date, then past ones, the latest first."""
    past = F.coalesce("is_past", F.lit(False))
    e = events.where(F.col("host") == host).withColumn("__p", past)
    return e.orderBy("__p", F.when(~F.col("__p"), F.col("start_date")), F.when(F.col("__p"), F.col("start_date")).desc(), "id").drop("__p")


def choose_domain(named: str | None, listed: Sequence[Mapping[str, object]]) -> str | None:
    """The named domain, else the first of the catalog."""
    return named or (str(listed[0]["name"]) if listed else None)
