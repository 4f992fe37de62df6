"""H8: one text for a nested value, whatever the order in which its fields were put, and short keys made of it; built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DecimalType, DoubleType, FloatType, IntegralType, MapType, StructType


def _quoted(c: Column) -> Column:
    """A string as JSON: to_json of an array of it, without the brackets."""
    listed = F.to_json(F.array(c.cast("string")))
    return F.substring(listed, F.lit(2), F.char_length(listed) - 2)


def _number(c: Column) -> Column:
    """A double as JSON writes it: whole ones without a fraction; what is no number is null."""
    x = c.cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), "null").when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))


def canonical_json(c: Column, kind: DataType) -> Column:
    """The value as JSON with the fields of objects in the order of their names and no blanks between; null is null. Two values that
    are equal but for the order of fields, or of a map's keys, give one text. A struct's null fields are written, missing keys of maps aren't."""
    if isinstance(kind, StructType):
        fields = [F.concat(_quoted(F.lit(f.name)), F.lit(":"), canonical_json(c[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, MapType):
        entry = lambda e: F.concat(_quoted(e["key"].cast("string")), F.lit(":"), canonical_json(e["value"], kind.valueType))
        entries = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("k"), entry(e).alias("t"))))
        text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: e["t"]), ","), F.lit("}"))
    elif isinstance(kind, (IntegralType, BooleanType)):
        text = c.cast("string")
    elif isinstance(kind, (DoubleType, FloatType, DecimalType)):
        text = _number(c)
    else:
        text = _quoted(c)
    return F.when(c.isNull(), "null").otherwise(text)


def key(c: Column, kind: DataType) -> Column:
    """The key of a cached answer."""
    return F.sha2(canonical_json(c, kind), 256)


def short_key(c: Column) -> Column:
    """Twelve digits that name a version of a text."""
    return F.substring(F.sha1(c), 1, 12)
