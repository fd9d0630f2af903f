"""Mixed timestamp formats and zones into one UTC form.

A value is tokenised into a mask of character classes (runs of digits by length; words by kind: month, weekday, am/pm,
zone, ordinal, other). Every distinct mask is planned once: which token is the year, the hour, the offset and so on.
Values of one mask are then converted together, local times through the transition tables of functions/zones.py.
Values of more than MAX_LENGTH characters are planned one by one and converted together where their plans are alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexora.functions.zones import COMMON_ABBREVIATIONS, abbreviation_offset, zone_table
from plexora.scale import broadcast_if_small

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
#: Values up to this length are converted by mask; longer ones hardly share masks and are reduced to the tokens of their
#: plan. It is also the limit of `convert` unless another is given; `to_utc` gives none.
MAX_LENGTH = 120

#: English month names and weekdays; three letters or more of a name are enough.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
_MONTH = {m[:n]: i + 1 for i, m in enumerate(MONTHS) for n in range(3, len(m) + 1)} | {"sept": 9}
_DAYS = {d[:n] for d in WEEKDAYS for n in range(3, len(d) + 1)}
_ZONES = {z.lower() for z in COMMON_ABBREVIATIONS} | {"utc", "gmt", "z", "ut"}


def _kind(tok: str) -> str:
    """One or more characters that stand for a token in the mask."""
    c = tok[0]
    if c.isdigit() and tok.isascii():
        return {1: "1", 2: "2", 4: "4", 8: "8", 6: "6"}.get(len(tok), "9")
    if c.isspace():
        return "_"
    if c.isalpha():
        w = tok.lower()
        if w in ("am", "pm"):
            return "p"
        if w in _MONTH:
            return "M"
        if w in _DAYS:
            return "w"
        if w in ("st", "nd", "rd", "th"):
            return "o"
        if w == "t":
            return "T"
        if w in _ZONES:
            return "z"
        if 3 <= len(tok) <= 5 and tok.isupper() and tok.isascii():
            return "Z"
        return "a"
    return {"–": "-", "—": "-", "‐": "-", "‑": "-", "−": "-", ".": ".", "·": "·"}.get(c, c)


class _Kinds(dict):
    """Kinds by token; those of short tokens are remembered."""

    def __missing__(self, tok: str) -> str:
        kind = _kind(tok)
        if len(tok) <= 32:
            if len(self) > 100_000:
                self.clear()
            self[tok] = kind
        return kind


_KINDS = _Kinds()


def tokens(value: str) -> list[str]:
    return _TOKEN.findall(value)


def mask_of(toks: list[str]) -> str:
    """One character per token."""
    return "".join(map(_kind, toks))


@dataclass
class Plan:
    """Positions of the parts in the token list; -1 where the mask has none."""

    epoch: int = -1
    sign: int = 1
    year: int = -1
    month: int = -1
    day: int = -1
    named: bool = False
    compact: int = -1
    hour: int = -1
    minute: int = -1
    second: int = -1
    clock: int = -1
    ampm: int = -1
    off_sign: int = -1
    off_hour: int = -1
    off_minute: int = -1
    zone: int = -1


_DATES = (
    ("ymd", re.compile(r"(4)-([12])-([12])(?![1-9])")),
    ("ymd", re.compile(r"(4)/([12])/([12])(?![1-9])")),
    ("mdy", re.compile(r"(?<![1-9/])([12])/([12])/([24])(?![1-9])")),
    ("dmy", re.compile(r"(?<![1-9.])([12])\.([12])\.([24])(?![1-9])")),
    ("dMy", re.compile(r"(?<![1-9:])([12])o?\.?_?(?:a_)?(M)[.,]?_?(4)(?![1-9])")),
    ("dMy", re.compile(r"(?<![1-9:])([12])-(M)-([24])(?![1-9])")),
    ("Mdy", re.compile(r"(M)\.?_?([12])o?,?_(4)(?![1-9:])")),
    ("dM", re.compile(r"(?<![1-9:])([12])o?\.?_(M)(?!_?4)")),
    ("Md", re.compile(r"(M)\.?_?([12])o?(?![1-9:])")),
)
_FULL = re.compile(r"(?<![1-9:.])([12]):(2)(?::(2)(?:[.,][1-9])?)?(?:_?(p))?(?![1-9:])")
_DOTTED = re.compile(r"(?<![1-9:.])([12])\.(2)(?:\.(2))?(?:_?(p))?(?![1-9.])")
_HOURLY = re.compile(r"(?<![1-9:.])([12])_?(p)(?![1-9])")
_SPAN = re.compile(r"_?-_?[12](?:[:.]2)?(?:[:.]2)?_?(p)")


def plan_of(mask: str) -> Plan | None:
    """How to read values of this mask; None if it names no date with a time of day."""
    p = Plan()
    body = mask.strip("_")
    lead = len(mask) - len(mask.lstrip("_"))
    if re.fullmatch(r"-?[1-9]", body):
        p.epoch = lead + (body[0] == "-")
        p.sign = -1 if body[0] == "-" else 1
        return p
    if m := re.match(r"(8)[T_]?([64])(?![1-9])", body):
        p.compact, p.clock = lead + m.start(1), lead + m.start(2)
        used = [(m.start(), m.end())]
        rest = _blank(body, used)
        return p if _zone(rest, lead, p, after=m.end()) else None
    for name, rx in _DATES:
        m = rx.search(body)
        if m:
            break
    else:
        return None
    at = {c.lower(): lead + m.start(i + 1) for i, c in enumerate(name)}
    p.year, p.month, p.day, p.named = at.get("y", -1), at["m"], at["d"], "M" in name
    rest = _blank(body, [m.span()])
    if name == "ymd" and rest[m.end() : m.end() + 1] in ("T",) and (c := re.match(r"T([64])(?![1-9])", rest[m.end() :])):
        p.clock = lead + m.end() + 1
        return p if _zone(_blank(rest, [(m.end(), m.end() + c.end())]), lead, p, after=m.end() + c.end()) else None
    # offsets first look like clocks, so a clock is sought before them and the first one counts
    hits = [h for rx in (_FULL, _DOTTED, _HOURLY) for h in rx.finditer(rest) if not _is_offset(rest, h)]
    if not hits:
        return None
    c = min(hits, key=lambda h: h.start())
    p.hour = lead + c.start(1)
    if c.re is not _HOURLY:
        p.minute = lead + c.start(2)
        if c.group(3):
            p.second = lead + c.start(3)
    g = 2 if c.re is _HOURLY else 4
    end = c.end()
    if c.group(g):
        p.ampm = lead + c.start(g)
    if s := _SPAN.match(rest[end:]):
        if p.ampm < 0:
            p.ampm = lead + end + s.start(1)
        rest = _blank(rest, [(end, end + s.end())])
    elif s := re.match(r"_?-_?[12][:.]2(?:[:.]2)?(?![1-9:])", rest[end:]):
        if not re.match(r"-[12]:2", rest[end:]):  # an offset follows at once
            rest = _blank(rest, [(end, end + s.end())])
    return p if _zone(_blank(rest, [(c.start(), end)]), lead, p, after=end) else None


def _blank(s: str, spans: list[tuple[int, int]]) -> str:
    for a, b in spans:
        s = s[:a] + "\0" * (b - a) + s[b:]
    return s


def _is_offset(s: str, h: re.Match) -> bool:
    """Whether a clock-like place is the hours of an offset: a sign before it, and a zone word or an earlier clock before."""
    before = s[max(h.start() - 2, 0) : h.start()]
    return before in ("z+", "z-") or before.endswith("+")


def _zone(rest: str, lead: int, p: Plan, after: int) -> bool:
    """Finds the zone among what is left. A word that may be an unknown zone makes the value unusable only at its use."""
    if m := re.search(r"z([+-])(?:([12])(?::?(2))?|(4))(?![1-9])", rest):
        _set_offset(m, lead, p)
        return True
    if m := re.match(r"_?\(?([+-])(?:([12])(?::?(2))?|(4))(?![1-9:])", rest[after:]):
        _set_offset(m, lead + after, p)
        return True
    if m := re.search(r"z", rest):
        p.zone = lead + m.start()
        return True
    if m := re.search(r"Z", rest[after:]):
        p.zone = lead + after + m.start()
    return True


def _set_offset(m: re.Match, base: int, p: Plan) -> None:
    p.off_sign = base + m.start(1)
    if m.group(4):
        p.off_hour, p.off_minute = base + m.start(4), -2
    else:
        p.off_hour = base + m.start(2)
        p.off_minute = base + m.start(3) if m.group(3) else -1


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970 of the proleptic Gregorian calendar; -10**9 where there is no such day."""
    bad = (m < 1) | (m > 12) | (d < 1) | (y < 1) | (y > 9999)
    y, m, d = np.where(bad, 2000, y), np.where(bad, 1, m), np.where(bad, 1, d)
    first = (y - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (m - 1).astype("timedelta64[M]")
    days = first.astype("datetime64[D]").astype(np.int64) + d - 1
    same = (first + np.timedelta64(1, "M")).astype("datetime64[D]").astype(np.int64) > days
    return np.where(bad | ~same, -(10**9), days)


def convert(
    values: list[str | None], zones: list[str | None], years: list[int | None], longest: int | None = MAX_LENGTH
) -> np.ndarray:
    """UTC seconds of each value as int64; NONE where a value names no date with a time of day, or its zone is unknown.

    zones: the zone of a value that names none. years: the year of a value that names none. longest: values of more
    characters get NONE; with None, values of any length are read.
    """
    out = np.full(len(values), NONE, np.int64)
    groups: dict[str, list[int]] = {}
    reduced: dict[tuple, tuple[Plan, list[int]]] = {}
    toks: list[list[str] | None] = [None] * len(values)
    for i, v in enumerate(values):
        if not v or longest is not None and len(v) > longest:
            continue
        if len(v) > MAX_LENGTH:
            if r := _reduced(v):
                plan, kinds, toks[i] = r
                reduced.setdefault((kinds, *vars(plan).values()), (plan, []))[1].append(i)
            continue
        t = toks[i] = tokens(v)
        groups.setdefault(mask_of(t), []).append(i)
    for mask, idx in groups.items():
        plan = _PLANS.get(mask, False)
        if plan is False:
            if len(_PLANS) > 100_000:
                _PLANS.clear()
            plan = _PLANS[mask] = plan_of(mask)
        if plan is not None:
            _convert_group(plan, idx, toks, zones, years, out)
    for plan, idx in reduced.values():
        _convert_group(plan, idx, toks, zones, years, out)
    return out


def _reduced(value: str) -> tuple[Plan, str, list[str]] | None:
    """The plan of a value with its positions among the few tokens that it uses, the kinds of these tokens, and them.

    The other tokens of a long value aren't held and its mask isn't remembered.
    """
    toks = tokens(value)
    mask = "".join(map(_KINDS.__getitem__, toks))
    p = plan_of(mask)
    if p is None:
        return None
    at = {f: k for f, k in vars(p).items() if f not in ("sign", "named") and k >= 0}
    used = {k: i for i, k in enumerate(sorted(set(at.values())))}
    return replace(p, **{f: used[k] for f, k in at.items()}), "".join(mask[k] for k in used), [toks[k] for k in used]


NONE = np.iinfo(np.int64).min
_PLANS: dict[str, Plan | None] = {}


def _convert_group(p: Plan, idx: list[int], toks: list, zones: list, years: list, out: np.ndarray) -> None:
    n = len(idx)
    col = lambda k: np.fromiter((int(toks[i][k]) for i in idx), np.int64, n)
    if p.epoch >= 0:
        for i in idx:
            t = toks[i][p.epoch]
            digits = t.lstrip("0")
            if len(digits) > 21:  # beyond the year 9999
                continue
            scale = 1 if len(t) <= 11 else 10**3 if len(t) <= 14 else 10**6 if len(t) <= 17 else 10**9
            s = p.sign * int(digits or "0") // scale
            if abs(s) < 253402300800:
                out[i] = s
        return
    if p.compact >= 0:
        d8 = col(p.compact)
        y, mo, d = d8 // 10000, d8 // 100 % 100, d8 % 100
    else:
        d = col(p.day)
        mo = np.fromiter((_MONTH[toks[i][p.month].lower()] for i in idx), np.int64, n) if p.named else col(p.month)
        if p.year >= 0:
            y = col(p.year)
            y = np.where(y < 100, np.where(y < 70, y + 2000, y + 1900), y) if len(toks[idx[0]][p.year]) == 2 else y
        else:
            y = np.fromiter((years[i] or 0 for i in idx), np.int64, n)
    if p.clock >= 0:
        c = toks[idx[0]][p.clock]
        raw = col(p.clock)
        h, mi, s = (raw // 10000, raw // 100 % 100, raw % 100) if len(c) == 6 else (raw // 100, raw % 100, raw * 0)
    else:
        h = col(p.hour)
        mi = col(p.minute) if p.minute >= 0 else h * 0
        s = col(p.second) if p.second >= 0 else h * 0
    ok = (mi < 60) & (s < 61) & ((h < 24) | (h == 24) & (mi == 0) & (s == 0))
    if p.ampm >= 0:
        pm = np.fromiter((toks[i][p.ampm].lower() == "pm" for i in idx), bool, n)
        ok &= (h >= 1) & (h <= 12)
        h = h % 12 + np.where(pm, 12, 0)
    days = _days(y, mo, d)
    ok &= days > -(10**9)
    local = days * 86400 + h * 3600 + mi * 60 + np.minimum(s, 59)
    at = np.array(idx)
    if p.off_sign >= 0:
        sign = np.fromiter((1 if toks[i][p.off_sign] == "+" else -1 for i in idx), np.int64, n)
        oh = col(p.off_hour)
        om = oh * 0
        if p.off_minute == -2:
            oh, om = oh // 100, oh % 100
        elif p.off_minute >= 0:
            om = col(p.off_minute)
        ok &= (oh <= 18) & (om < 60)
        out[at[ok]] = (local - sign * (oh * 3600 + om * 60))[ok]
        return
    named: dict[tuple[str | None, str | None], list[int]] = {}
    for k, i in enumerate(idx):
        if ok[k]:
            named.setdefault((toks[i][p.zone].upper() if p.zone >= 0 else None, zones[i]), []).append(k)
    for (word, zone), ks in named.items():
        k = np.array(ks)
        if word is not None:
            off = abbreviation_offset(word, zone)
            if off is not None:
                out[at[k]] = local[k] - off
            continue
        table = zone_table(zone) if zone else None
        if table is not None:
            utc, exists = table.to_utc(local[k])
            out[at[k[exists]]] = utc[exists]


def utc_texts(seconds: np.ndarray) -> list[str | None]:
    """YYYY-MM-DDTHH:MM:SSZ; None for NONE."""
    ok = seconds != NONE
    t = np.where(ok, seconds, 0).astype("datetime64[s]").astype(str)
    return [f"{a}Z" if b else None for a, b in zip(t, ok)]


def to_utc(df: DataFrame, value: str, zone: str, year: str, out: str = "utc") -> DataFrame:
    """Adds `out`, the UTC text of each value. `zone` and `year` are columns for values that name none of their own.

    Nulls, blanks, texts that name no date with a time of day, values whose zone isn't known and local times that a
    zone skips get null. A local time that occurs twice is the earlier one. Of a time span the first moment counts.
    Texts of any length are read; the limit that `convert` has by default, MAX_LENGTH, doesn't hold here.
    Other columns pass through. One narrow pass, no shuffle.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` string"

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            none = lambda c: [None if x is None or x != x else x for x in pdf[c].tolist()]
            secs = convert(none(value), none(zone), [None if x is None else int(x) for x in none(year)], None)
            yield pdf.assign(**{out: utc_texts(secs)})

    return df.mapInPandas(work, schema)


def event_moments(events: DataFrame, localities: DataFrame, fields: tuple[str, ...] = ("enddate", "datelabel")) -> DataFrame:
    """tablename, recordid, fieldname, utc of event columns that name a date with a time of day.

    The zone of an event is its own; if that is null or blank, the one of the locality whose title is its locality (of
    several such localities the smallest zone name, so that the result is defined). A missing year is that of startdate.
    A row is given once, however often its record was delivered; rows without an id are left out.
    """
    towns = (
        localities.where(F.col("title").isNotNull())
        .groupBy(F.col("title").alias("__title"))
        .agg(F.min("timezone").alias("__zone"))
    )
    own = F.nullif(F.trim("timezone"), F.lit(""))
    base = events.where(F.col("eventid").isNotNull()).select(
        F.lit("place_events").alias("tablename"),
        F.col("eventid").alias("recordid"),
        own.alias("__own"),
        F.col("locality").alias("__title"),
        F.regexp_extract(F.coalesce("startdate", F.lit("")), r"(\d{4})-\d", 1).alias("__y"),
        F.explode(
            F.filter(
                F.array(*[F.struct(F.lit(f).alias("fieldname"), F.col(f).alias("value")) for f in fields]),
                lambda s: s["value"].rlike("[0-9]"),
            )
        ).alias("__f"),
    )
    base = base.select("tablename", "recordid", "__own", "__title", "__y", "__f.*").distinct()
    base = base.join(broadcast_if_small(towns), "__title", "left").select(
        "tablename",
        "recordid",
        "fieldname",
        "value",
        F.coalesce("__own", "__zone").alias("zone"),
        F.expr("try_cast(__y AS int)").alias("year"),
    )
    return _found(base)


def review_moments(reviews: DataFrame, fields: tuple[str, ...] = ("publishtime",)) -> DataFrame:
    """As event_moments; a review's value without a zone is UTC."""
    base = reviews.where(F.col("reviewid").isNotNull()).select(
        F.lit("place_reviews").alias("tablename"),
        F.col("reviewid").alias("recordid"),
        F.explode(
            F.filter(
                F.array(*[F.struct(F.lit(f).alias("fieldname"), F.col(f).alias("value")) for f in fields]),
                lambda s: s["value"].rlike("[0-9]"),
            )
        ).alias("__f"),
    )
    base = base.select("tablename", "recordid", "__f.*").distinct()
    return _found(base.select("*", F.lit("UTC").alias("zone"), F.lit(None).cast("int").alias("year")))


def _found(base: DataFrame) -> DataFrame:
    done = to_utc(base, "value", "zone", "year")
    return done.where(F.col("utc").isNotNull()).select("tablename", "recordid", "fieldname", "utc")
