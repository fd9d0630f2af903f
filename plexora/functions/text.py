"""Texts made of records: documents to embed, labels, display forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DOCUMENT, QUERY = "search_document: ", "search_query: "
#: Longest text of a document, without its prefix.
MAX_CHARS = 1000


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def document_text(title: Column, tags: Column, subtitle: Column | None, texts: Sequence[Column] = (), lists: Sequence[tuple[str, Column]] = (), extra: Column | None = None) -> Column:
    """ "Title: …. Tags: …[. Subtitle: …][. texts][. key: a, b]" with the document prefix, cut to MAX_CHARS.

    tags: a text column. lists: (key, array column) in the order of the record's fields; the first 20 non-empty members
    of each are given, and empty lists are left out.
    """
    blank = F.lit("")
    parts = [F.concat(F.lit("Title: "), F.coalesce(title, blank), F.lit(". Tags: "), F.coalesce(tags, blank))]
    if subtitle is not None:
        parts.append(F.concat(F.lit("Subtitle: "), F.nullif(subtitle, blank)))
    if texts:
        parts.append(F.nullif(F.concat_ws("; ", *[F.nullif(t, blank) for t in texts]), blank))
    if lists:
        one = lambda k, a: F.when(F.size(a) > 0, F.concat(F.lit(f"{k}: "), F.array_join(F.filter(F.slice(a, 1, 20), lambda x: x.isNotNull() & (x != "")), ", ")))
        parts.append(F.nullif(F.concat_ws("; ", *[one(k, a) for k, a in lists]), blank))
    if extra is not None:
        parts.append(F.nullif(extra, blank))
    return F.concat(F.lit(DOCUMENT), F.substring(F.concat_ws(". ", *parts), 1, MAX_CHARS))


def searchable_text(title: Column, tags: Column, subtitle: Column, text: Column) -> Column:
    """The service's form: tags twice (they weigh more), title, subtitle, text; "record" if there is nothing."""
    t = F.concat_ws(" ", *[_filled(c) for c in (tags, tags, title, subtitle, text)])
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("record"))


def chosen_text(columns: Sequence[Column]) -> Column:
    """Chosen fields joined by blanks, with the document prefix."""
    return F.concat(F.lit(DOCUMENT), F.substring(F.concat_ws(" ", *[F.nullif(c.cast("string"), F.lit("")) for c in columns]), 1, MAX_CHARS))


def node_text(name: Column, sep: str, kind: Column, default: str, *parts: Column, tags: Column | None = None) -> Column:
    """ "name — kind, parts. Tags: …": the first 8 tags; empty parts are left out."""
    out = [name, F.lit(sep), F.coalesce(_filled(kind), F.lit(default)), *[F.coalesce(p, F.lit("")) for p in parts]]
    if tags is not None:
        out.append(F.when(F.size(tags) > 0, F.concat(F.lit(". Tags: "), F.array_join(F.slice(tags, 1, 8), ", "))).otherwise(""))
    return F.concat(*out)


def part(prefix: str, value: Column, suffix: str = "") -> Column:
    """prefix + value + suffix, or nothing if there is no value."""
    v = _filled(value)
    return F.when(v.isNotNull(), F.concat(F.lit(prefix), v, F.lit(suffix)))


def minutes(ms: Column) -> Column:
    """m:ss of milliseconds."""
    s = F.floor(ms / 1000)
    return F.format_string("%d:%02d", F.floor(s / 60), (s % 60))


def usd(x: Column) -> Column:
    """Dollars with as many places as their size needs."""
    a = F.abs(x)
    return (
        F.when(x == 0, "$0").when(a < 0.01, "<$0.01").when(a >= 1000, F.concat(F.lit("$"), F.format_number(x, 0))).otherwise(F.concat(F.lit("$"), F.format_number(x, 2)))
    )


def amount(x: Column) -> Column:
    """A number of units with as many places as its size needs."""
    a = F.abs(x)
    small = F.regexp_replace(F.regexp_replace(F.format_number(x, 6), "0+$", ""), r"\.$", "")
    return F.when(x == 0, "0").when(a >= 100, F.format_number(x, 2)).when(a >= 1, F.format_number(x, 4)).otherwise(small)


def age(seconds: Column) -> Column:
    """45s, 12m, 3.4h, 2.1d; ? if unknown."""
    return (
        F.when(seconds.isNull(), "?")
        .when(seconds < 90, F.format_string("%ds", seconds.cast("bigint")))
        .when(seconds < 5400, F.format_string("%.0fm", seconds / 60.0))
        .when(seconds < 172800, F.format_string("%.1fh", seconds / 3600.0))
        .otherwise(F.format_string("%.1fd", seconds / 86400.0))
    )


def city(text: Column) -> Column:
    """A place name without what follows its first comma; null for blanks, single letters and names of states.

    The names of states are those of the region that the records come from: a fixed list.
    """
    c = F.trim(F.substring_index(F.trim(text), ",", 1))
    states = "wi wisconsin mi michigan mn minnesota il illinois ia iowa usa us".split()
    return F.when((F.length(c) >= 2) & ~F.lower(c).isin(*states), c)


def json_list(text: Column) -> Column:
    """Members of a text that is a JSON list of texts; an empty list for anything else."""
    got = F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>"))
    return F.coalesce(got, F.array().cast("array<string>"))
