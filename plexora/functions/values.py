"""Values of heterogeneous fields as JVM expressions: numbers, texts, equality, whatever the field's type.

A field is a column of a plain type or a VARIANT. All functions keep to one rule set: booleans are no numbers, texts are
numbers if they spell one, a missing field is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: A text that spells a finite number: digits may be grouped by single underscores; no type suffixes.
_SPELLED = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?\s*$"


class Field:
    """One field of a record: its value, and how to see it as a number or a text."""

    def __init__(self, value: Column, dtype: T.DataType):
        self.value, self.dtype = value, dtype

    @property
    def variant(self) -> bool:
        return isinstance(self.dtype, T.VariantType)

    def _kind(self) -> Column:
        return F.schema_of_variant(self.value)

    def number(self) -> Column:
        """double, or null for what isn't a number."""
        if isinstance(self.dtype, _NUMERIC):
            return self.value.cast("double")
        if isinstance(self.dtype, T.StringType):
            return spelled_number(self.value)
        if self.variant:
            k = self._kind()
            return F.when(k == "BOOLEAN", F.lit(None).cast("double")).when(k == "STRING", spelled_number(F.try_variant_get(self.value, "$", "string"))).otherwise(
                F.try_variant_get(self.value, "$", "double")
            )
        return F.lit(None).cast("double")

    def text(self) -> Column:
        """The value as text; lists and objects as JSON."""
        if self.variant:
            return F.when(self._kind().rlike("^(ARRAY|OBJECT)"), F.to_json(self.value)).otherwise(F.try_variant_get(self.value, "$", "string"))
        if isinstance(self.dtype, T.BooleanType):
            return F.when(self.value, "True").when(~self.value, "False")
        if isinstance(self.dtype, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(self.value)
        return self.value.cast("string")

    def present(self) -> Column:
        return F.coalesce(self.value.isNotNull() & (self._kind() != "VOID"), F.lit(False)) if self.variant else self.value.isNotNull()

    def equals(self, operand: object) -> Column:
        """Whether the value is the operand, numbers by value, null only to null; never null itself."""
        if operand is None:
            return ~self.present()
        if self.variant:
            k = self._kind()
            if isinstance(operand, bool):
                hit = (k == "BOOLEAN") & (F.try_variant_get(self.value, "$", "boolean") == F.lit(operand))
            elif isinstance(operand, (int, float)):
                hit = k.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)") & (F.try_variant_get(self.value, "$", "double") == F.lit(float(operand)))
            else:
                hit = (k == "STRING") & (F.try_variant_get(self.value, "$", "string") == F.lit(str(operand)))
            return F.coalesce(hit, F.lit(False))
        if isinstance(self.dtype, T.StringType):
            return F.coalesce(self.value == F.lit(operand), F.lit(False)) if isinstance(operand, str) else F.lit(False)
        if isinstance(self.dtype, T.BooleanType):
            return F.coalesce(self.value == F.lit(operand), F.lit(False)) if isinstance(operand, bool) else F.lit(False)
        if isinstance(self.dtype, _NUMERIC) and isinstance(operand, str):
            return F.lit(False)
        return self.value.eqNullSafe(F.lit(operand))

    def key(self) -> Column:
        """The value as it groups: plain columns as they are, variants as JSON text."""
        return F.when(self._kind() == "STRING", F.try_variant_get(self.value, "$", "string")).otherwise(F.to_json(self.value)) if self.variant else self.value


def spelled_number(text: Column) -> Column:
    """double of a text that spells a number, else null."""
    return F.when(text.rlike(_SPELLED), F.regexp_replace(F.trim(text), "_", "").try_cast("double"))


def field(df: DataFrame, name: str, variant: str | None = None) -> Field:
    """A field of df: a column of that name, else a key of the VARIANT column `variant`; null where there is neither."""
    if name in df.columns:
        return Field(F.col(f"`{name}`"), df.schema[name].dataType)
    if variant is not None:
        path = name.replace("\\", "\\\\").replace("'", "\\'")
        return Field(F.try_variant_get(F.col(variant), f"$['{path}']", "variant"), T.VariantType())
    return Field(F.lit(None).cast("string"), T.StringType())
