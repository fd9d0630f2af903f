"""Names of businesses: normal forms and levels of agreement."""

from __future__ import annotations

import re
import unicodedata

from plexora.llm.addresses import damerau

#: Legal forms and articles, which say nothing about identity.
EMPTY_WORDS = frozenset("the a an llc inc ltd co corp gmbh plc llp company".split())
#: Different ways to write a kind of business, longest first.
SAME_KIND = (
    ("bar and grill", "grill"), ("alley", "lanes"), ("supperclub", "supper club"), ("comm ctr", "community center"),
    ("community ctr", "community center"), ("comm center", "community center"), ("community centre", "community center"),
    ("brew co", "brewing"), ("brewing co", "brewing"), ("brewing company", "brewing"), ("brewery", "brewing"), ("brew company", "brewing"), ("brew", "brewing"), ("bakehouse", "bakery"),
    ("book shop", "bookshop"), ("bookstore", "bookshop"), ("coffee house", "coffee"), ("tap room", "taproom"), ("road house", "roadhouse"),
    ("tav", "tavern"), ("rstrnt", "restaurant"), ("ctr", "center"), ("centre", "center"),
)
_KIND = [(re.compile(rf"\b{a}\b"), b) for a, b in SAME_KIND]


def normal(name: str | None, town: str = "") -> tuple[str, ...]:
    """The words of a name: case, accents, apostrophes, articles, legal forms and a trailing town left out."""
    if not name:
        return ()
    t = unicodedata.normalize("NFKD", name.casefold())
    t = "".join(c for c in t if not unicodedata.combining(c))
    t = re.sub(r"['’`´]", "", t).replace("&", " and ")
    parts = re.split(r"[(,]|\s-\s", t)
    if len(parts) > 1 and len(w := re.findall(r"[a-z0-9]+", parts[-1] or (parts[-2] if len(parts) > 1 else ""))) == 1 and parts[0].strip():
        if not town or damerau(w[0], town, 2) <= 2:
            t = " ".join(parts[:-1])
    t = " ".join(re.findall(r"[a-z0-9]+", t))
    for rx, b in _KIND:
        t = rx.sub(b, t)
    words = [w for w in t.split() if w not in EMPTY_WORDS]
    return tuple(words or t.split())


def _close(a: str, b: str) -> bool:
    return a == b or damerau(a, b, 2) <= (2 if min(len(a), len(b)) > 8 else 1 if min(len(a), len(b)) > 3 else 0)


#: Levels of agreement of two names, worst first.
NAME_LEVELS = ("other", "one word", "start only", "misspelt", "equal")


def name_level(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """Index into NAME_LEVELS; -1 if a name is missing."""
    if not a or not b:
        return -1
    if a == b:
        return 4
    x, y = "".join(a), "".join(b)
    if x == y:
        return 4
    if len(a) == len(b) and all(map(_close, a, b)) or min(len(x), len(y)) > 7 and damerau(x, y, 2) <= 2:
        return 3
    s, t = (a, b) if len(a) < len(b) else (b, a)
    s = s[:-1] if len(s) > 1 and s[-1] == "and" else s
    if len(s) < len(t) and all(map(_close, s, t)):
        return 2
    # same start and a kind left out in the middle, as in "X music hall" and "X hall"
    if len(s) < len(t) and len(s) >= 2 and _close(s[0], t[0]) and _close(s[-1], t[-1]) and all(any(_close(p, q) for q in t) for p in s):
        return 2
    return 1 if any(len(p) > 3 and _close(p, q) for p in s for q in t) else 0
