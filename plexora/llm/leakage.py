"""Evaluation texts leaking into training text: shared runs of consecutive words.

A hash set of the normalised test n-grams is broadcast (its size is checked first), the token windows of every document
are looked up in it, hits are verified word by word, and spans or documents can be removed. A test collection that is
too large for that is joined by shuffle on the n-grams' hashes instead, with the same result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexora.scale import salted_join, stage

_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
#: Most n-grams of test items that are broadcast; 13 words of some 8 letters are about 100 bytes each.
MAX_BROADCAST_GRAMS = 500_000


def _drop_format(text: str) -> str:
    return "".join(c for c in text if unicodedata.category(c) != "Cf")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits after NFKC and lower-casing, invisible format characters left out first."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFKC", _drop_format(unicodedata.normalize("NFKC", _drop_format(text)).lower())))


def word_spans(text: str) -> list[tuple[str, int, int]]:
    """The words of a text with the places in the text that they come from.

    Normalisation is done per cluster of a base character and what follows it (marks, format characters), which composes
    the same way as the whole text does, so that every word knows its place.
    """
    if text.isascii():
        return [(m.group().lower(), m.start(), m.end()) for m in _ASCII_WORD.finditer(text.lower())]
    chars: list[str] = []
    place: list[tuple[int, int]] = []
    i, n = 0, len(text)
    while i < n:
        j = i + 1
        while j < n and (unicodedata.combining(text[j]) or unicodedata.category(text[j]) in ("Cf", "Mn", "Mc") or "ᅠ" <= text[j] <= "ᇿ"):
            j += 1
        norm = unicodedata.normalize("NFKC", _drop_format(unicodedata.normalize("NFKC", _drop_format(text[i:j])).lower()))
        chars.extend(norm)
        place.extend([(i, j)] * len(norm))
        i = j
    return [(m.group(), place[m.start()][0], place[m.end() - 1][1]) for m in _WORD.finditer("".join(chars))]


#: Base of the polynomial hash of an n-gram, modulo 2 ** 64, and words that are hashed at once.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK_WORDS = 500_000


def _window_hashes(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n numbers from each place of `at` on."""
    out, power = np.zeros(len(at), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(n):
            out += ids[at + j] * power
            power *= _BASE
    return out


class TestGrams:
    """The n-grams of the test items: numbers of their words, hashes to look windows up by, and items by n-gram."""

    __test__ = False

    def __init__(self, items: Iterable[tuple[str, str]], n: int):
        self.n = n
        found: dict[tuple[str, ...], set[str]] = {}
        for item, text in items:
            w = words(text)
            for i in range(len(w) - n + 1):
                found.setdefault(tuple(w[i : i + n]), set()).add(item)
        self.items = {k: tuple(sorted(v)) for k, v in found.items()}
        self.number = {x: i + 1 for i, x in enumerate(sorted({x for g in self.items for x in g}))}
        ids = np.array([self.number[x] for g in self.items for x in g], np.uint64)
        self.hashes = np.unique(_window_hashes(ids, np.arange(len(self.items)) * n, n))

    def hits_of(self, docs: Sequence[list[str]]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """document, start, items of the windows that are test n-grams; each hit is verified word by word.

        All windows of known words are hashed at once, and looked up by binary search.
        """
        if not self.items:
            return
        i = 0
        while i < len(docs):
            first, size = i, 0
            while i < len(docs) and (size == 0 or size < _CHUNK_WORDS):
                size += len(docs[i]) + 1
                i += 1
            part, get = docs[first:i], self.number.get
            ids = np.fromiter((x for w in part for x in (*(get(y, 0) for y in w), 0)), np.uint64, size)
            known = np.concatenate([[0], np.cumsum(ids > 0)])
            at = np.nonzero(known[self.n :] - known[: -self.n] == self.n)[0] if size >= self.n else np.zeros(0, int)
            if not len(at):
                continue
            h = _window_hashes(ids, at, self.n)
            pos = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            at = at[self.hashes[pos] == h]
            starts = np.cumsum([0, *(len(w) + 1 for w in part)])
            for k, d in zip(at.tolist(), (np.searchsorted(starts, at, "right") - 1).tolist()):
                k -= int(starts[d])
                if (its := self.items.get(tuple(part[d][k : k + self.n]))) is not None:
                    yield first + d, k, its

    def hits(self, w: list[str]) -> list[tuple[int, tuple[str, ...]]]:
        """Starts of one text's windows that are test n-grams, with the items."""
        return [(k, its) for _, k, its in self.hits_of([w])]


def _collect_items(items: DataFrame, key: str, text: str, n: int) -> list[tuple[str, str]] | None:
    """The test items that have n words for the driver, if their n-grams are few enough, else None. Counted in the tasks,
    by the words that n-grams are made of, without fetching anything."""

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            grams = [max(0, len(words(t)) - n + 1) for t in pdf[text]]
            yield pdf.assign(__n=grams)[[g > 0 for g in grams]]

    kept = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).distinct()
    kept = stage(kept.mapInPandas(count, f"`{key}` {items.schema[key].dataType.simpleString()}, `{text}` string, __n bigint"), "test-items")
    if (kept.agg(F.sum("__n")).first()[0] or 0) > MAX_BROADCAST_GRAMS:
        return None
    return [(r[0], r[1]) for r in kept.collect()]


def find_leaks(docs: DataFrame, items: DataFrame, n: int = 13, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """doc, item of every document that shares a run of at least n consecutive words with a test item, each pair once.

    Null, empty and short texts share nothing; whole texts are scanned, however long. An empty side gives no rows.
    Documents without an id are left out. No shuffle of the documents: one pass, and a final distinct of the hits for
    documents that are there twice.
    """
    pairs = _collect_items(items, item, text, n)
    out = f"`{doc}` {docs.schema[doc].dataType.simpleString()}, `{item}` {items.schema[item].dataType.simpleString()}"
    base = docs.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(doc, text)
    grams = None if pairs is None else docs.sparkSession.sparkContext.broadcast(TestGrams(pairs, n))
    own = [] if pairs is not None else ["__g"]
    if pairs is None:
        base = _with_own_grams(base, items, n, item, text).where(F.col("__g").isNotNull()).select(doc, text, "__g")

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            ws, ids = [words(t) for t in pdf[text]], pdf[doc].tolist()
            if own:
                found = {(ids[i], x) for i, w in enumerate(ws) for _, xs in _grams_of(pdf["__g"].iloc[i], n).hits(w) for x in xs}
            else:
                found = {(ids[d], x) for d, _, xs in grams.value.hits_of(ws) for x in xs}
            if found:  # an empty column has no type
                yield pd.DataFrame(list(found), columns=[doc, item])

    return base.mapInPandas(scan, out).distinct()


def _grams_of(own: Sequence | None, n: int) -> TestGrams:
    """The test n-grams that a text was joined with."""
    return TestGrams([(x, g["gram"]) for g in (own if own is not None else ()) for x in g["its"]], n)


def _gram_rows(df: DataFrame, key: str, text: str, n: int, with_gram: bool) -> DataFrame:
    """key, h and, if asked for, gram: the different n-grams of each text by a hash of 64 bits."""
    kind = df.schema[key].dataType.simpleString()

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for k, t in zip(pdf[key].tolist(), pdf[text].tolist()):
                w = words(t)
                if len(w) < n:
                    continue
                ids = np.array([xxhash.xxh3_64_intdigest(x) for x in w], np.uint64)
                h, first = np.unique(_window_hashes(ids, np.arange(len(w) - n + 1), n).view(np.int64), return_index=True)
                rows = pd.DataFrame({"k": [k] * len(h), "h": h}).rename(columns={"k": key})
                yield rows.assign(gram=[" ".join(w[i : i + n]) for i in first]) if with_gram else rows

    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInPandas(cut, f"`{key}` {kind}, h bigint" + ", gram string" * with_gram)


def _with_own_grams(docs: DataFrame, items: DataFrame, n: int, item: str, text: str) -> DataFrame:
    """docs with __g, the test n-grams (gram, its) whose hashes a text has; null if none.

    An equi-join on hashes of 64 bits, of each different text once; a gram of very many texts is split over several tasks.
    """
    base = docs.withColumn("__k", F.sha2(text, 256))
    g = _gram_rows(base.select("__k", text).dropDuplicates(["__k"]), "__k", text, n, False)
    t = _gram_rows(items, item, text, n, True).groupBy("h", "gram").agg(F.collect_set(item).alias("its"))
    t = t.groupBy("h").agg(F.collect_list(F.struct("gram", "its")).alias("own"))
    hits = salted_join(g, t, "h", "inner", ["__k"]).groupBy("__k").agg(F.flatten(F.collect_list("own")).alias("__g"))
    return base.join(hits, "__k", "left").drop("__k")


def remove_leaks(docs: DataFrame, items: DataFrame, n: int = 13, drop_share: float = 0.5, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """doc, text, removed_words, dropped: each document's text without its leaked spans.

    A document of whose words at least drop_share leaked is dropped whole: its text is null and dropped is true. The
    other documents keep every character outside the spans. Null texts stay null.
    """
    pairs = _collect_items(items, item, text, n)
    grams = None if pairs is None else docs.sparkSession.sparkContext.broadcast(TestGrams(pairs, n))
    base, kind, joined = docs.select(doc, text), docs.schema[doc].dataType.simpleString(), pairs is None
    if joined:
        base = _with_own_grams(base, items, n, item, text).select(doc, text, "__g")

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            ws = [words(t) for t in pdf[text]]
            touched = set(range(len(ws))) if joined else {d for d, _, _ in grams.value.hits_of(ws)}
            rows = []
            for i, (d, t) in enumerate(zip(pdf[doc], pdf[text])):
                g = _grams_of(pdf["__g"].iloc[i], n) if joined else grams.value
                rows.append((d, *(_without_spans(t, g, drop_share) if i in touched else (t, 0, False))))
            yield pd.DataFrame(rows, columns=[doc, text, "removed_words", "dropped"])

    return base.mapInPandas(cut, f"`{doc}` {kind}, `{text}` string, removed_words int, dropped boolean")


def _without_spans(t: str | None, g: TestGrams, drop_share: float) -> tuple[str | None, int, bool]:
    if not t or not (hits := g.hits(words(t))):
        return t, 0, False
    spans = word_spans(t)
    w = [s[0] for s in spans]
    gone = sorted({k + j for k, _ in g.hits(w) for j in range(g.n)})
    del hits
    if len(gone) >= drop_share * max(1, len(w)):
        return None, len(gone), True
    parts, at, i = [], 0, 0
    while i < len(gone):
        j = i
        while j + 1 < len(gone) and gone[j + 1] == gone[j] + 1:
            j += 1
        parts.append(t[at : spans[gone[i]][1]])
        at = spans[gone[j]][2]
        i = j + 1
    return "".join([*parts, t[at:]]), len(gone), False
