"""Texts decoded with a wrong character encoding: found and restored by expectation-maximisation.

A text, or a passage of it, went through a latent chain of steps "written in one encoding, read in another". Undoing a
chain gives the text that was meant; how likely that is is told by a character trigram model of clean text, trained on
the corpus itself. Each record's chain is latent: the E-step weighs the chains by the evidence of all its words, the
M-step pools these weights per source and field into priors, and re-estimates the character model on what is clean.

The texts are read once: what is kept of them are their words outside ASCII (odd words). The counts of distinct odd words
give the character model; evidence is gathered in narrow passes over the odd words of each record.
"""

from __future__ import annotations

import codecs
import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexora.scale import stage

#: Pairs of encodings (written in, read as) that text is commonly confused between.
STEPS: tuple[tuple[str, str], ...] = (
    *((("utf-8", e)) for e in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "iso8859_2", "cp866")),
    *(("cp1252", e) for e in ("mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "iso8859_2")),
    *(("mac_roman", e) for e in ("cp1252", "latin-1")),
    *(("cp437", e) for e in ("cp1252", "latin-1")),
    *(("cp850", e) for e in ("cp1252", "latin-1")),
    *(("cp1251", e) for e in ("cp1252", "latin-1", "koi8_r", "mac_roman", "cp866")),
    *(("koi8_r", e) for e in ("cp1251", "cp1252", "latin-1")),
    *(("cp866", e) for e in ("cp1251", "cp1252", "latin-1")),
    *(("iso8859_5", e) for e in ("cp1251", "cp1252", "latin-1")),
    *(("cp1250", e) for e in ("cp1252", "latin-1", "iso8859_2")),
    *(("iso8859_2", e) for e in ("cp1252", "latin-1", "cp1250")),
)
#: Hash buckets per order of the character model; so its size doesn't depend on the corpus.
BUCKETS = 1 << 18
#: Gain of a word that a chain can't have produced, and the least gain of any word.
CANNOT = -12.0
#: Prior of each chain before anything is known; a chain that is new to a source starts from a hundredth of it.
FIRST_PRIOR = 1e-4
#: Words of which a task remembers what a model says.
MEMO = 30_000
_SPACE = re.compile(r"[ \t\r\n]+")
_CODEC: dict[str, tuple[str, object]] = {}


def _single(name: str) -> tuple[str, object]:
    """Decoding table and encoding map of a single-byte encoding; bytes it leaves undefined are the control characters
    of the same number, as browsers read them."""
    if name not in _CODEC:
        table = []
        for b in range(256):
            try:
                c = bytes([b]).decode(name)
            except UnicodeDecodeError:
                c = chr(b)
            table.append(c)
        _CODEC[name] = ("".join(table), codecs.charmap_build("".join(table)))
    return _CODEC[name]


def garble(text: str, written: str, read: str) -> str:
    """What becomes of a text written in one encoding and read in another."""
    raw = text.encode("utf-8") if written == "utf-8" else codecs.charmap_encode(text, "replace", _single(written)[1])[0]
    return codecs.charmap_decode(raw, "strict", _single(read)[0])[0]


def undo(text: str, step: int) -> str | None:
    """The text before a step; None if the step can't have produced it or changes nothing."""
    written, read = STEPS[step]
    try:
        raw = codecs.charmap_encode(text, "strict", _single(read)[1])[0]
        out = raw.decode("utf-8") if written == "utf-8" else codecs.charmap_decode(raw, "strict", _single(written)[0])[0]
    except UnicodeError:
        return None
    return None if out == text else out


_READS = tuple(dict.fromkeys(r for _, r in STEPS))
_STEPS_OF = {r: tuple(s for s, (_, x) in enumerate(STEPS) if x == r) for r in _READS}
_CHAR_READS: dict[str, int] = {}


def _reads(word: str) -> int:
    """Bits of the encodings (of _READS) that have every character of a word."""
    out = (1 << len(_READS)) - 1
    for ch in word:
        if ch > "\x7f":
            bits = _CHAR_READS.get(ch)
            if bits is None:
                bits = sum(1 << i for i, r in enumerate(_READS) if ch in _single(r)[0])
                if len(_CHAR_READS) < 65_536:
                    _CHAR_READS[ch] = bits
            out &= bits
    return out


def _undone(word: str) -> Iterator[tuple[int, str]]:
    """Every step that can have produced the word, with the word before it."""
    bits = _reads(word)
    for i, read in enumerate(_READS):
        if not bits >> i & 1:
            continue
        try:
            raw = codecs.charmap_encode(word, "strict", _single(read)[1])[0]
        except UnicodeError:
            continue
        for s in _STEPS_OF[read]:
            written = STEPS[s][0]
            try:
                u = raw.decode("utf-8") if written == "utf-8" else codecs.charmap_decode(raw, "strict", _single(written)[0])[0]
            except UnicodeError:
                continue
            if u != word:
                yield s, u


def unchain(word: str) -> dict[tuple[int, ...], str]:
    """Every chain that can have produced the word, last step first, with the word it was made from.

    Steps from UTF-8 are followed by others, however many: undoing one makes the word shorter. A step between two
    single-byte encodings ends a chain, as two of them are one other such step.
    """
    out: dict[tuple[int, ...], str] = {}
    level: list[tuple[tuple[int, ...], str]] = [((), word)]
    while level:
        nxt = []
        for chain, w in level:
            for s, u in _undone(w):
                c = (*chain, s)
                out[c] = u
                if STEPS[s][0] == "utf-8" and not u.isascii():
                    nxt.append((c, u))
        level = nxt
    return out


def chain_name(chain: tuple[int, ...]) -> str:
    return " < ".join(f"{STEPS[s][0]} as {STEPS[s][1]}" for s in chain)


def _chain_key(chain: tuple[int, ...]) -> str:
    return ".".join(map(str, chain))


def chain_of(key: str) -> tuple[int, ...]:
    return tuple(int(x) for x in key.split("."))


def _trigrams(words: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Start of each word, and the slots of its letters: letter, pair, triple, letter before, pair before.

    All digits are one letter; a word ends with a letter of its own.
    """
    codes = np.frombuffer("".join([w + "\x03" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where((codes >= 48) & (codes <= 57), 48, codes)
    size = np.array([len(w) + 1 for w in words])
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    b = np.concatenate([[2], codes[:-1]])
    b[start] = 2
    a = np.concatenate([[2], b[:-1]])
    a[start] = 2
    pair = lambda x, y: x * 131071 + y * 8191
    return start, [codes % BUCKETS, pair(b, codes) % BUCKETS, (a * 1299709 + pair(b, codes)) % BUCKETS, b % BUCKETS, pair(a, b) % BUCKETS]


@dataclass
class CharModel:
    """Interpolated character trigrams in hash buckets: counts by order, see _trigrams. Its size is fixed."""

    counts: list[np.ndarray]

    def __post_init__(self) -> None:
        self.total = float(self.counts[0].sum())

    def logliks(self, words: Sequence[str]) -> np.ndarray:
        """Log-likelihood of each word."""
        if not len(words):
            return np.zeros(0)
        start, (s1, s2, s3, before, before_two) = _trigrams(words)
        one, two, three, after, after_two = self.counts
        p1 = (one[s1] + 0.05) / (self.total + 500)
        p2 = (two[s2] + 3 * p1) / (after[before] + 3)
        p3 = (three[s3] + 3 * p2) / (after_two[before_two] + 3)
        return np.add.reduceat(np.log(p3), start)

    def less(self, other: CharModel) -> CharModel:
        return CharModel([np.maximum(a - b, 0) for a, b in zip(self.counts, other.counts)])


def _model(words: DataFrame) -> CharModel:
    """The character model of words (word, n), counted by the tasks; at most 5 * BUCKETS numbers come together."""

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((5, BUCKETS))
        for pdf in it:
            ws = pdf["word"].tolist()
            if ws:
                n = np.repeat(pdf["n"].to_numpy(float), [len(w) + 1 for w in ws])
                for o, slots in enumerate(_trigrams(ws)[1]):
                    acc[o] += np.bincount(slots, n, BUCKETS)
        o, slot = np.nonzero(acc)
        yield pd.DataFrame({"o": o.astype("int32"), "slot": slot.astype("int32"), "n": acc[o, slot]})

    counts = words.mapInPandas(work, "o int, slot int, n double").groupBy("o", "slot").agg(F.sum("n").alias("n")).toPandas()
    out = [np.zeros(BUCKETS) for _ in range(5)]
    for o in range(5):
        mine = counts[counts["o"] == o]
        out[o][mine["slot"].to_numpy()] = mine["n"].to_numpy()
    return CharModel(out)


class Judge:
    """Weighs the chains of records by a model; words seen before are looked up."""

    def __init__(self, model: CharModel):
        self.model = model
        self.seen: dict[str, dict[tuple[int, ...], float]] = {}

    def learn(self, words: Sequence[str]) -> None:
        """Makes the words known: chain -> gain in log-likelihood over the word as it stands."""
        if len(self.seen) > MEMO:
            self.seen.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.seen]
        for i in range(0, len(new), 2000):
            part = new[i : i + 2000]
            cands = [unchain(w) for w in part]
            texts = list(dict.fromkeys([*part, *(u for c in cands for u in c.values())]))
            ll = dict(zip(texts, self.model.logliks(texts).tolist()))
            for w, c in zip(part, cands):
                own = ll[w]
                # a chain that explains the word worse than that is as good as impossible
                self.seen[w] = {k: g for k, u in c.items() if (g := ll[u] - own) > CANNOT}

    def record(self, ws: Sequence[str]) -> dict[tuple[int, ...], tuple[float, int, int]]:
        """chain -> (gain of its best passage, first and last odd word of it); only chains that gain."""
        if any(w not in self.seen for w in ws):
            self.learn(ws)
        gains = [self.seen[w] for w in ws]
        chains = {c for g in gains for c, v in g.items() if v > 0}
        out = {}
        for c in chains:
            best, run, start, span = 0.0, 0.0, 0, (0, -1)
            for i, g in enumerate(gains):
                v = g.get(c, CANNOT)
                if run <= 0:
                    run, start = 0.0, i
                run += v
                if run > best:
                    best, span = run, (start, i)
            if best > 0:
                out[c] = (best, *span)
        return out


def _weighed(judge: Judge, ws: Sequence[str], prior: Callable[[str], float]) -> list[tuple[float, tuple[int, ...], int, int]]:
    """Log odds, chain, first and last odd word of a record's chains; the place of a passage costs what it takes to name it
    among the record's odd words."""
    return [(g - math.log(len(ws)) + prior(_chain_key(c)), c, a, b) for c, (g, a, b) in judge.record(ws).items()]


def _likely(weighed: list[tuple[float, tuple[int, ...], int, int]], least: float = 0.0) -> bool:
    """Whether all chains together, of which several can give the same text, outweigh the text as it stands."""
    return sum(math.exp(min(500.0, v)) for v, *_ in weighed) > math.exp(least)


_EVIDENCE = "array<struct<chain: string, gain: double, a: int, b: int>>"


def _odd_words(docs: DataFrame, doc: str, text: Sequence[str], source: str) -> DataFrame:
    """doc, field, source, pool (what priors are pooled over: source and field), ws (odd words in order), lost (has
    replacement characters) of the texts that have odd words. The only pass over the texts."""
    one = lambda c: F.struct(F.lit(c).alias("field"), F.col(c).alias("text"))
    rows = docs.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.explode(F.array(*map(one, text))).alias("f"))
    rows = rows.select("doc", "source", "f.field", "f.text").where(F.col("text").rlike(r"[^\x00-\x7F]"))
    words = F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w.rlike(r"[^\x00-\x7F]"))
    pool = F.concat_ws("\x01", "source", "field")
    return stage(rows.select("doc", "field", "source", pool.alias("pool"), words.alias("ws"), F.col("text").contains("\ufffd").alias("lost")), "encoding-words")


def _first_words(vocabulary: DataFrame) -> DataFrame:
    """The words that no step from UTF-8 can have produced: nearly all of what is left is clean."""

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Cyrillic words can happen to be UTF-8 in the Cyrillic DOS and KOI8 encodings, so these don't speak against a word
        utf = {s for s, (w, r) in enumerate(STEPS) if w == "utf-8" and r not in ("cp866", "koi8_r")}
        for pdf in it:
            yield pdf[[all(s not in utf for s, _ in _undone(w)) for w in pdf["word"]]]

    return vocabulary.mapInPandas(work, vocabulary.schema)


def _evidence(odd: DataFrame, model: CharModel) -> DataFrame:
    """odd with ev, all chains that gain, with their gains and passages, for records that have any or have lost text."""
    shared = odd.sparkSession.sparkContext.broadcast(model)
    kind = odd.schema["doc"].dataType.simpleString()

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(shared.value)
        for pdf in it:
            texts = [list(ws) for ws in pdf["ws"]]
            judge.learn([w for ws in texts for w in ws])
            ev = [[{"chain": _chain_key(c), "gain": g, "a": a, "b": b} for c, (g, a, b) in judge.record(ws).items()] for ws in texts]
            out = pdf.assign(odd=np.array([len(ws) for ws in texts], np.int32), ev=ev)
            yield out[[bool(e) or bool(lost) for e, lost in zip(ev, pdf["lost"])]]

    return odd.mapInPandas(work, f"doc {kind}, field string, source string, pool string, ws array<string>, lost boolean, odd int, ev {_EVIDENCE}")


def _odds(ev: DataFrame, pri: DataFrame | None) -> DataFrame:
    """ev with o (odds of each of its chains, by its prior and its gain) and z (1 + their sum)."""
    lp: Callable = lambda x: F.lit(math.log(FIRST_PRIOR))
    if pri is not None:
        ev = ev.join(pri.select("pool", "lps"), "pool", "left")
        lp = lambda x: F.coalesce(F.col("lps")[x["chain"]], F.lit(math.log(FIRST_PRIOR / 100)))
    place = F.log(F.col("odd").cast("double"))  # not the size of ws, so that rounds needn't read the words
    ev = ev.withColumn("o", F.transform("ev", lambda x: F.exp(F.least(F.lit(500.0), lp(x) + x["gain"] - place))))
    return ev.withColumn("z", 1 + F.aggregate("o", F.lit(0.0), lambda s, x: s + x))


def estimate_priors(ev: DataFrame, sizes: DataFrame, start: DataFrame | None = None, change: float = 0.05, most: int = 30) -> DataFrame:
    """pool, lps: the M-step's log priors by chain, pooled per source and field with the whole corpus behind them.

    Rounds go on until no prior of a chain that anyone has changes by more than `change` in its logarithm, at most `most`.
    The weights are pre-aggregated before the shuffle; nothing but the largest change comes to the driver. A pool's map
    has one entry per chain that occurs in it.
    """
    pri = start
    n_all = sizes.agg(F.sum("n")).first()[0] or 1
    for _ in range(most):
        e = _odds(ev, pri)
        was = F.col("lps")[F.col("x.chain")] if pri is not None else F.lit(None).cast("double")
        e = e.select("pool", *(["lps"] if pri is not None else []), F.explode(F.arrays_zip(F.col("ev.chain").alias("chain"), F.transform("o", lambda x: x / F.col("z")).alias("w"))).alias("x"))
        mass = e.groupBy("pool", F.col("x.chain").alias("chain")).agg(F.sum("x.w").alias("m"), F.max(was).alias("was"))
        back = mass.groupBy("chain").agg(F.sum("m").alias("back"))
        share = (F.col("m") + 20 * (F.col("back") + 1e-3) / (n_all + 1)) / (F.col("n") + 20)
        rows = stage(mass.join(back, "chain").join(sizes, "pool").select("pool", "chain", F.log(share).alias("lp"), "was", "m"), "encoding-mass")
        moved = rows.where(F.col("m") > 0.5).agg(F.max(F.abs(F.col("lp") - F.coalesce("was", F.lit(0.0))))).first()[0]
        pri = rows.groupBy("pool").agg(F.map_from_entries(F.collect_list(F.struct("chain", "lp"))).alias("lps"))
        if (moved or 0.0) <= change:
            break
    return stage(pri, "encoding-priors")


def _garbled_words(ev: DataFrame, pri: DataFrame | None) -> DataFrame:
    """word, n: the odd words of passages that are rather garbled than not: those of chains that do so alone, and where
    only several together do, the best one's."""
    e = _odds(ev, pri).where(F.col("z") > 2)
    z = F.arrays_zip(F.col("o"), F.col("ev.a").alias("a"), F.col("ev.b").alias("b"))
    e = e.select("ws", z.alias("s"), F.array_max("o").alias("top"))
    alone = F.filter("s", lambda x: (x["o"] > 1) | ((F.col("top") <= 1) & (x["o"] == F.col("top"))))
    e = e.select("ws", alone.alias("s"))
    inside = F.filter("ws", lambda w, i: F.exists("s", lambda x: (x["a"] <= i) & (i <= x["b"])))
    return e.select(F.explode(inside).alias("word")).groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("n"))


@dataclass
class Fitted:
    """What expectation-maximisation found: the evidence by the last model, priors, and the model."""

    odd: DataFrame
    ev: DataFrame
    pri: DataFrame
    model: CharModel


def _fit(docs: DataFrame, doc: str, text: Sequence[str], source: str, rounds: int = 2) -> Fitted:
    odd = _odd_words(docs, doc, text, source)
    sizes = stage(odd.groupBy("pool").agg(F.count(F.lit(1)).alias("n")), "encoding-sizes")
    vocabulary = stage(odd.select(F.explode("ws").alias("word")).where(~F.col("word").contains("\ufffd")).groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("n")), "encoding-vocabulary")
    every = _model(vocabulary)
    model, pri = _model(_first_words(vocabulary)), None
    ev = stage(_evidence(odd, model), "encoding-evidence")
    # from the second time on with pooled priors, so that passages of weak evidence don't teach the model that they are clean
    for _ in range(rounds):
        model = every.less(_model(_garbled_words(ev, pri).where(~F.col("word").contains("\ufffd"))))
        ev = stage(_evidence(odd, model), "encoding-evidence")
        pri = estimate_priors(ev, sizes, pri)
    return Fitted(odd, ev, pri, model)


def _fields(text: str | Sequence[str]) -> list[str]:
    return [text] if isinstance(text, str) else list(text)


def find_garbled(docs: DataFrame, doc: str = "doc_id", text: str | Sequence[str] = "text", source: str = "source", least: float = 0.5) -> DataFrame:
    """doc, chain, p: records that were decoded wrongly, wholly or in a passage, with the likeliest chain.

    A record with replacement characters has lost text for good; it is given with a null chain if no chain explains it.
    Texts that are null, empty or pure ASCII are clean. A null source is a source of its own. Records without an id are
    left out; an id that occurs twice is given once. Whole texts are read. text: one or several columns, of which each
    has its own priors.
    """
    f = _fit(docs, doc, _fields(text), source)
    post = _odds(f.ev, f.pri).withColumn("p", 1 - 1 / F.col("z")).where(F.col("p") >= least)
    best = F.array_max(F.arrays_zip(F.col("o"), F.col("ev.chain").alias("chain")))["chain"]
    named = post.select("doc", best.alias("chain"), "p")
    lost = f.ev.where("lost").select("doc", F.lit(None).cast("string").alias("chain"), F.lit(1.0).alias("p"))
    return named.unionByName(lost).groupBy("doc").agg(F.max_by("chain", F.struct(F.col("chain").isNotNull(), "p")).alias("chain"), F.max("p").alias("p")).withColumnRenamed("doc", doc)


def restore(text: str, judge: Judge, prior: Callable[[str], float], least: float = 0.0) -> tuple[str, list[str]]:
    """The text with its garbled passages undone, and the chains; passages are taken one after the other, until none is
    left. Ends in any case: a text that was there before isn't taken again."""
    done: list[str] = []
    met = {text}
    while True:
        parts = re.split(r"([ \t\r\n]+)", text)
        odd = [i for i, w in enumerate(parts) if not w.isascii()]
        weighed = _weighed(judge, [parts[i] for i in odd], prior) if odd else []
        if not _likely(weighed, least):
            break
        _, c, a, b = max(weighed)
        for i in odd[a : b + 1]:
            w: str | None = parts[i]
            for s in c:
                w = undo(w, s) if w is not None else None
            if w is not None:
                parts[i] = w
        text = "".join(parts)
        if text in met:
            break
        met.add(text)
        done.append(chain_name(c))
    return text, done


def restore_garbled(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc, text, chains, lost: each garbled record with its text restored; lost: part of it can't be restored.

    An id whose rows have different garbled texts is given once for each of them; equal rows once.
    """
    f = _fit(docs, doc, [text], source)
    hit = _odds(f.ev, f.pri).where((F.col("z") >= 2) | F.col("lost")).select("doc", "pool").distinct()
    hit = hit.join(f.pri.select("pool", F.map_entries("lps").alias("lps")), "pool", "left").withColumn("source", F.substring_index("pool", "\x01", 1))
    kind = docs.schema[doc].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(f.model)
    base = docs.where(F.col(text).rlike(r"[^\x00-\x7F]")).select(F.col(doc).alias("doc"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(shared.value)
        new = math.log(FIRST_PRIOR / 100)
        for pdf in it:
            rows = []
            for d, t, lps in zip(pdf["doc"], pdf["text"], pdf["lps"]):
                known = {x["key"]: x["value"] for x in lps} if lps is not None else {}
                fixed, chains = restore(t, judge, lambda c, known=known: known.get(c, new))
                rows.append((d, fixed, chains, "\ufffd" in fixed))
            yield pd.DataFrame(rows, columns=["doc", "text", "chains", "lost"])

    out = base.join(hit.select("doc", "source", "lps"), ["doc", "source"]).dropDuplicates(["doc", "text"])
    out = out.select("doc", "text", "lps").mapInPandas(work, f"doc {kind}, text string, chains array<string>, lost boolean")
    return out.withColumnRenamed("doc", doc)
