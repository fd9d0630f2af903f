"""The analytical axis: the where grammar, group-by measures with type-safe ordering, vocabularies and counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexora.functions.values import Field, field

OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "contains", "exists")


def _operand_number(v: object) -> float | None:
    if isinstance(v, bool) or v is None:
        return None
    try:
        return float(v)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


def predicate(f: Field, condition: object) -> Column:
    """One field's condition: a plain value (equality, null meaning missing) or a mapping of operators, all of which hold.

    Range operators compare numbers only and fail if either side is none; `ne` holds for a missing field; `contains` looks
    for a case-sensitive part of the value's text; operators that aren't known are ignored, {} always holds.
    """
    if not isinstance(condition, Mapping):
        return f.equals(condition)
    out = F.lit(True)
    for op, v in condition.items():
        if op == "eq":
            out = out & f.equals(v)
        elif op == "ne":
            out = out & ~f.equals(v)
        elif op in ("gt", "gte", "lt", "lte"):
            n = _operand_number(v)
            if n is None:
                return F.lit(False)
            x = f.number()
            hit = {"gt": x > n, "gte": x >= n, "lt": x < n, "lte": x <= n}[op]
            out = out & F.coalesce(hit, F.lit(False))
        elif op == "in":
            hits = [f.equals(x) for x in v]  # type: ignore[union-attr]
            any_ = F.lit(False)
            for h in hits:
                any_ = any_ | h
            out = out & any_
        elif op == "contains":
            out = out & F.coalesce(f.present() & f.text().contains(str(v)), F.lit(False))
        elif op == "exists":
            out = out & (f.present() if v else ~f.present())
    return out


def where(df: DataFrame, conditions: Mapping[str, object] | None = None, entity_type: str | None = None, variant: str | None = None) -> DataFrame:
    """Records that meet all conditions. On plain columns the filters reach the scan."""
    if entity_type is not None:
        df = df.where(F.col("entity_type") == entity_type)
    for name, c in (conditions or {}).items():
        df = df.where(predicate(field(df, name, variant), c))
    return df


def _measure(f: Field | None, fn: str) -> Column:
    if fn == "count":
        return F.count(F.lit(1))
    assert f is not None
    if fn in ("distinct", "count_distinct"):
        # a missing value is one of the distinct values
        return F.count_distinct(f.key()) + F.max(F.when(f.present(), 0).otherwise(1))
    n = f.number()
    n = F.when(~F.isnan(n), n)
    if fn == "sum":
        return F.round(F.coalesce(F.sum(n), F.lit(0.0)), 6)
    if fn == "avg":
        return F.round(F.avg(n), 6)
    if fn == "min":
        return F.min(n)
    if fn == "max":
        return F.max(n)
    raise ValueError(f"unknown measure {fn!r}; known are count, sum, avg, min, max, distinct")


def order_columns(df: DataFrame, spec: str) -> list[Column]:
    """Sort order of a result column: numbers before texts, "-" turns it round; further columns break ties."""
    name, down = spec.lstrip("-"), spec.startswith("-")
    f = field(df, name)
    num = f.number()
    cols = [num.isNull(), num, F.coalesce(f.text(), F.lit(""))]
    first = [c.desc() for c in cols] if down else [c.asc() for c in cols]
    return first + [F.col(f"`{c}`").asc_nulls_first() for c in df.columns if c != name and not df.schema[c].dataType.typeName().startswith(("map", "variant"))]


def aggregate(
    df: DataFrame,
    group_by: str | Sequence[str],
    measures: Mapping[str, str] | None = None,
    conditions: Mapping[str, object] | None = None,
    entity_type: str | None = None,
    order_by: str | None = None,
    limit: int = 0,
    variant: str | None = None,
) -> DataFrame:
    """Groups with their measures: count, sum:f, avg:f, min:f, max:f, distinct:f. A null key is a group.

    Sums of no number are 0, averages and extremes null; sums and averages are rounded to 6 places. An unknown measure
    raises. limit 0 or less gives all groups. An empty table gives no groups.
    """
    keys = [group_by] if isinstance(group_by, str) else list(group_by)
    measures = measures or {"count": "count"}
    df = where(df, conditions, entity_type, variant)
    aggs = []
    for name, spec in measures.items():
        fn, _, target = spec.partition(":")
        aggs.append(_measure(field(df, target, variant) if target and target != "*" else None, fn).alias(name))
    out = df.groupBy(*[field(df, k, variant).key().alias(k) for k in keys]).agg(*aggs)
    if order_by:
        out = out.orderBy(*order_columns(out, order_by))
    return out.limit(limit) if limit > 0 else out


def type_counts(df: DataFrame, column: str = "entity_type") -> DataFrame:
    """Entities per type, most first; ties by name."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def field_vocabulary(df: DataFrame, variant: str) -> DataFrame:
    """Names of the fields that occur in a VARIANT column, in order."""
    keys = F.json_object_keys(F.to_json(F.col(variant)))
    return df.select(F.explode(keys).alias("field")).distinct().orderBy("field")


def facet_vocabulary(df: DataFrame, facets: Sequence[str]) -> DataFrame:
    """facet, values: sorted distinct members of list-valued facet columns; texts are no lists and are left out."""
    parts = None
    for c in facets:
        if df.schema[c].dataType.typeName() != "array":
            continue
        t = df.select(F.lit(c).alias("facet"), F.explode(c).alias("value")).where(F.col("value").isNotNull()).distinct()
        parts = t if parts is None else parts.unionByName(t)
    if parts is None:
        return df.sparkSession.createDataFrame([], "facet string, value string")
    return parts


def relation_vocabulary(edges: DataFrame, rel: str = "rel") -> DataFrame:
    """Relations that occur, in order."""
    return edges.where(F.col(rel).isNotNull()).select(rel).distinct().orderBy(rel)


def edge_shapes(edges: DataFrame) -> DataFrame:
    """rel, src_type, dst_type, min, count of the edges whose three parts are all known."""
    whole = edges.where((F.coalesce("rel", F.lit("")) != "") & (F.coalesce("src_type", F.lit("")) != "") & (F.coalesce("dst_type", F.lit("")) != ""))
    return whole.groupBy("rel", "src_type", "dst_type").agg(F.count(F.lit(1)).alias("count"))


def export_rows(df: DataFrame, fields: Sequence[str] | None = None, conditions: Mapping[str, object] | None = None, entity_type: str | None = None) -> DataFrame:
    """Flat records: id, entity_type and the chosen fields (all if None; a field named id then takes the id's place)."""
    df = where(df, conditions, entity_type)
    if fields is None:
        return df
    base = [F.col(c) for c in ("id", "entity_type") if c in df.columns]
    return df.select(*base, *[field(df, f).value.alias(f) for f in fields if f not in ("id", "entity_type")])


def write_export(df: DataFrame, path: str, fmt: str = "ndjson") -> None:
    """Line JSON or CSV with a header; columns keep their order."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "ndjson":
        w.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError("fmt is ndjson or csv")


