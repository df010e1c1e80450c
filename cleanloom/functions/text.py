"""Scalar column expressions: whitespace, null tokens, numeric grammars, rounding.

Everything here is a pure ``Column -> Column`` function made of built-in
expressions, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# ---------------------------------------------------------------------------
# These must equal the documented data contract.
# ---------------------------------------------------------------------------
# Cells that become null while a file is read (exact, case-sensitive).
INGEST_NULLS = ["", "NA", "N/A", "na", "null", "NULL", "None", "NaN"]
# Cells that never count as numeric-looking (trimmed, lower-cased).
NULL_TOKENS = ["", "na", "n/a", "null", "none", "nan", "-"]
# White space removed by a trim; the same class works in Java and RE2 regexes.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# Symbols dropped before a cell is read as a number, and what must then remain.
CURRENCY = "$,€£%"
PLAIN_NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"
# Numeric-looking text (before commas are removed) and after their removal.
NUMERIC_LOOK = r"^-?[0-9.,]+%?$"
NUMERIC_BODY = r"^(-?([0-9]+\.?[0-9]*|\.[0-9]+))?$"
# Numerals accepted by a non-strict cast of text.
INT_TEXT = r"^[+-]?[0-9]+$"
FLOAT_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def ref(name: str) -> Column:
    """Column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def spare_name(df, wanted: str) -> str:
    """A helper column's name that the table does not have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name += "_"
    return name


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL + FRACTIONAL)


def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def dtype_name(dt: T.DataType) -> str:
    """Data type name shown in profiles."""
    names = {
        T.ByteType: "Int8", T.ShortType: "Int16", T.IntegerType: "Int32", T.LongType: "Int64",
        T.FloatType: "Float32", T.DoubleType: "Float64", T.DecimalType: "Decimal",
        T.BooleanType: "Boolean", T.DateType: "Date", T.TimestampType: "Datetime",
        T.TimestampNTZType: "Datetime",
    }
    if is_text(dt):
        return "String"
    return names.get(type(dt), dt.simpleString())


def strip(c: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return F.btrim(c, F.lit(SPACES))


def norm_name(c: Column) -> Column:
    """Lower-case and keep only ``[a-z0-9]``; used to find column names in prose."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def is_null_token(c: Column) -> Column:
    return F.lower(strip(c)).isin(NULL_TOKENS)


def finite(c: Column) -> Column:
    """Double value of a numeric column; NaN and infinities become null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def to_numeric(c: Column, dt: T.DataType) -> Column:
    """Number hidden in a cell: currency signs, percent, commas and spaces are ignored."""
    if is_numeric(dt):
        return finite(c)
    if is_text(dt):
        bare = F.translate(c, CURRENCY + SPACES, "")
        return F.when(bare.rlike(PLAIN_NUMBER), finite(bare.try_cast("double")))
    return F.lit(None).cast("double")


def numeric_like(c: Column) -> Column:
    """True when trimmed text is a plain or comma-grouped numeral (no currency, no percent)."""
    t = strip(c)
    body = F.translate(t, ",", "")
    return F.coalesce(t.rlike(NUMERIC_LOOK) & body.rlike(NUMERIC_BODY) & ~is_null_token(c), F.lit(False))


def half_up(c: Column, digits: int) -> Column:
    """Round half towards +infinity at ``digits`` decimals: floor(x * 10^d + 0.5) / 10^d.

    From 2**53 on a scaled double has no such decimals (and floor would stop at the ends of a long): it stays as it is.
    """
    scale, x = float(10 ** digits), c.cast("double")
    rounded = F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
    return F.when(F.abs(x * F.lit(scale)) >= F.lit(2.0 ** 53), x).otherwise(rounded)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal, 0 for an empty whole."""
    safe = F.when(whole > 0, whole.cast("double"))
    share = F.floor(part.cast("double") / safe * F.lit(1000.0) + F.lit(0.5)).cast("double") / F.lit(10.0)
    return F.coalesce(share, F.lit(0.0))


def number_text(c: Column, dt: T.DataType) -> Column:
    """Short decimal text of a number: at most six decimals, no trailing zeros, no exponent below 1e21."""
    if is_integral(dt):
        return c.cast("string")
    # Six decimals are always written, so only fraction zeros can be cut off.
    fixed = F.rtrim(F.rtrim(c.try_cast("decimal(38,6)").cast("string"), F.lit("0")), F.lit("."))
    fixed = F.when(fixed.isin("-0", "-", ""), "0").otherwise(fixed)
    if isinstance(dt, T.DecimalType):
        return fixed
    return F.when(F.abs(c) < F.lit(1e21), fixed).otherwise(c.cast("string"))


def display(c: Column, dt: T.DataType) -> Column:
    """Text form of a cell as shown in previews and profile samples."""
    if is_text(dt):
        return c
    if is_numeric(dt):
        return number_text(c, dt)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd")
    return c.cast("string")


def exact_text(c: Column, dt: T.DataType) -> Column:
    """Lossless text form of a cell, for exact distinct counts."""
    if is_text(dt):
        return c
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(c.cast("double") == F.floor(c.cast("double")), display(c, dt)).otherwise(c.cast("string"))
    return c.cast("string")


def cast_to(c: Column, source: T.DataType, to: str, parse: str = "strict") -> Column:
    """Non-strict cast: what does not convert becomes null.

    ``parse="numeric"`` reads text with :func:`to_numeric` first, so that
    ``$12,345`` survives; the default accepts plain numerals only.
    """
    target = CAST_TARGETS.get(to)
    if target is None:
        raise ValueError(f'Unsupported dtype "{to}" - use one of {", ".join(CAST_TARGETS)}.')
    if to == "Boolean" and is_text(source):
        return F.when(c == "true", F.lit(True)).when(c == "false", F.lit(False))
    if to in ("Int64", "Int32", "Float64", "Float32"):
        if is_text(source):
            if parse == "numeric":
                return to_numeric(c, source).try_cast(target)
            guard = INT_TEXT if to.startswith("Int") else FLOAT_TEXT
            return F.when(c.rlike(guard), c.try_cast(target))
        if isinstance(source, (T.FloatType, T.DoubleType)):
            return finite(c).try_cast(target)
    return c.try_cast(target)


# Cast targets and the Spark type each one means.
CAST_TARGETS = {
    "Int64": "bigint",
    "Float64": "double",
    "String": "string",
    "Boolean": "boolean",
    "Int32": "int",
    "Float32": "float",
    "Date": "date",
    "Datetime": "timestamp",
}
