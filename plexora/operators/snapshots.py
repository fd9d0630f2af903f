"""What changed between full snapshots: full outer join on the key, comparing canonical row hashes."""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(text: str) -> str:
    """One spelling per number: 4, 4.0, 4.00 and 40e-1 are the same value."""
    try:
        d = Decimal(text)
    except InvalidOperation:
        return text
    if not d:
        return "0"
    sign, digits, exp = d.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    short = text.rstrip("0")
    return f"{'-' if sign else ''}{short}e{exp + len(text) - len(short)}"


class _Num(str):
    """A number of the parsed document, as its canonical spelling."""


def _write(v: object, out: list[str]) -> None:
    if v is None:
        out.append("null")
    elif v is True:
        out.append("true")
    elif v is False:
        out.append("false")
    elif isinstance(v, _Num):
        out.append("#" + v)
    elif isinstance(v, str):
        out.append(json.dumps(v))
    elif isinstance(v, list):
        out.append("[")
        for x in v:
            _write(x, out)
            out.append(",")
        out.append("]")
    else:
        out.append("{")
        for k in sorted(v):
            if v[k] is not None:
                out.append(json.dumps(k) + ":")
                _write(v[k], out)
                out.append(",")
        out.append("}")


def _parse_number(text: str) -> _Num:
    return _Num(_number(text))


def canonical_json(text: str | None) -> str:
    """One text per JSON value: keys sorted, null keys dropped at every level, numbers by value, list order kept.

    SQL null equals JSON null. A text that is no JSON stands for itself, without surrounding blanks.
    """
    if text is None:
        return "null"
    try:
        v = json.loads(text, parse_float=_parse_number, parse_int=_parse_number, parse_constant=_Num)
    except (ValueError, RecursionError):
        return "raw:" + text.strip()
    out: list[str] = []
    try:
        _write(v, out)
    except RecursionError:
        return "raw:" + text.strip()
    return "".join(out)


def _digest(text: str | None) -> bytes:
    return hashlib.blake2b(canonical_json(text).encode("utf-8", "surrogatepass"), digest_size=16).digest()


@F.pandas_udf(T.BinaryType())
def canonical_hash(texts: pd.Series) -> pd.Series:
    """128-bit hash of canonical_json; equal texts of a batch are hashed once."""
    seen: dict[str | None, bytes] = {}
    out = []
    for t in texts:
        t = None if t is None or t is pd.NA else t
        h = seen.get(t)
        if h is None:
            h = seen[t] = _digest(t)
        out.append(h)
    return pd.Series(out)


def snapshot_changes(
    rows: DataFrame,
    snapshot: str = "snapshot_no",
    key: str = "track_id",
    value: str = "fields",
    version: str = "meta.version",
    delivered: str = "delivered_at",
) -> DataFrame:
    """Added, removed and changed keys of each full snapshot against the one before it.

    A row belongs to its snapshot whenever it was delivered. Of several rows of a key in a snapshot the one with the
    highest version counts; without a version it is the lowest; ties go to the later delivery, then to the greater hash.
    Rows without a key or a snapshot are left out. Only `value` decides on a change, compared as JSON (canonical_json).
    An empty table, or a single snapshot, gives no rows. Other columns of the input are never read.

    The hash is taken before anything is shuffled, so a key costs some 50 bytes per snapshot in the shuffle; the rows of
    one key are combined before the shuffle, so a key with very many rows does no harm. The numbers of the snapshots (a
    handful per table) are the only thing the driver gets.
    """
    nos = sorted(r[0] for r in rows.select(snapshot).where(F.col(snapshot).isNotNull()).distinct().collect())
    follow = {a: b for a, b in zip(nos, nos[1:])}
    base = rows.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull()).select(
        F.col(snapshot).alias("no"),
        F.col(key).alias("id"),
        F.struct(
            F.coalesce(F.col(version), F.lit(-(2**31))).alias("v"),
            F.col(delivered).alias("at"),
            canonical_hash(F.col(value)).alias("h"),
        ).alias("s"),
    )
    one = base.groupBy("no", "id").agg(F.max("s").alias("s")).select("no", "id", F.col("s.h").alias("h"))
    if len(nos) < 2:
        return one.where(F.lit(False)).select(F.col("no").alias(snapshot), F.col("id").alias(key), F.lit("added").alias("change"))
    pairs = [F.lit(x) for ab in follow.items() for x in ab]
    now = one.select("no", "id", F.col("h").alias("h1"))
    before = one.select(F.create_map(*pairs)[F.col("no")].alias("no"), "id", F.col("h").alias("h0"))
    change = (
        F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed")
    )
    return (
        now.join(before, ["no", "id"], "full_outer")
        .where(F.col("no") > F.lit(nos[0]))
        .select(F.col("no").alias(snapshot), F.col("id").alias(key), change.alias("change"))
        .where(F.col("change").isNotNull())
    )


def change_counts(changes: DataFrame, snapshot: str = "snapshot_no") -> DataFrame:
    """Changes per snapshot and kind."""
    return changes.groupBy(snapshot, "change").agg(F.count(F.lit(1)).alias("n"))
