"""JSON text and VARIANT helpers with strict-parser semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventrail.functions.fence import compute_once

I64_MAX = 2**63 - 1
U64_MAX = 2**64 - 1

_EXPONENT = r"[0-9][eE]"
_HUGE_INTEGER = r"[0-9]{309}"
_LONE_SURROGATE = (
    r"(?<!\\)(?:\\\\)*+(?:"
    r"\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F][0-9a-fA-F]{2})"
    r"|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2})"
)
# Numbers whose spelling VARIANT may not keep; also found inside strings, which is harmless.
_RESPELLED = r"[0-9][.eE][0-9+-]|[0-9]{19}|-0"
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TOKENS = _STRING + r'|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[^"0-9-]++|-'
#: Fixed value: the depth at which the source's parser gives up.
DEPTH_LIMIT = 128


def get(value: Column, path: str) -> Column:
    """The VARIANT below ``path``; NULL when missing, a VARIANT null when JSON null."""
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    """Spark's name of the JSON kind, e.g. ``STRING``, ``BIGINT``, ``VOID`` for null."""
    return F.schema_of_variant(value)


def is_number(kind_name: Column) -> Column:
    return (
        (kind_name == "BIGINT") | (kind_name == "DOUBLE") | kind_name.startswith("DECIMAL(")
    )


def is_integer(kind_name: Column, value: Column) -> Column:
    """True for numbers that fit a signed or unsigned 64-bit integer.

    VARIANT holds integers above the signed range as decimals, where they cannot
    be told from an equal number written with a zero fraction.
    """
    wide = F.try_variant_get(value, "$", "decimal(20,0)")
    return (kind_name == "BIGINT") | (
        kind_name.isin("DECIMAL(19,0)", "DECIMAL(20,0)")
        & (wide > F.lit(I64_MAX))
        & (wide <= F.lit(str(U64_MAX)).cast("decimal(20,0)"))
    )


def is_object(kind_name: Column) -> Column:
    return kind_name.startswith("OBJECT<")


def is_array(kind_name: Column) -> Column:
    return kind_name.startswith("ARRAY<")


def type_name(kind_name: Column) -> Column:
    """The JSON type word used in projection errors."""
    return (
        F.when(kind_name == "STRING", "string")
        .when(kind_name == "BOOLEAN", "boolean")
        .when(kind_name == "VOID", "null")
        .when(is_object(kind_name), "object")
        .when(is_array(kind_name), "array")
        .otherwise("number")
    )


def parse_strict(df: DataFrame, body: str, out: str = "event") -> DataFrame:
    """Add ``out``: the body as VARIANT, NULL unless the whole text is one JSON value.

    Spark's parser stops after the first value. The text is therefore parsed as the first
    element of an array that ends in a tag hashed from the text: anything after the value
    breaks the array or moves the tag. Values nested 128 deep or more are refused.
    """
    text = F.col(body).cast("string")
    tag, boxed, parsed = f"__{out}_tag", f"__{out}_box", f"__{out}_parsed"
    staged = df.withColumn(tag, F.hex(F.xxhash64(F.col(body).cast("binary"))))
    box = F.concat(F.lit("["), text, F.lit(',"'), F.col(tag), F.lit('"]'))
    usable = F.is_valid_utf8(text) & ~_too_deep(text)
    staged = compute_once(staged.withColumn(boxed, F.when(usable, F.try_parse_json(box))), boxed)
    whole = F.try_variant_get(boxed, "$[1]", "string") == F.col(tag)
    staged = staged.withColumn(parsed, F.when(whole, get(F.col(boxed), "$[0]")))
    may_overflow = text.rlike(_EXPONENT) | (
        (F.octet_length(text) >= 309) & text.rlike(_HUGE_INTEGER)
    )
    infinite = (
        may_overflow
        & F.to_json(F.col(parsed)).contains("Infinity")
        & ~text.contains("Infinity")
    )
    surrogate = (F.instr(text, "\\u") > 0) & text.rlike(_LONE_SURROGATE)
    event = F.when(~infinite & ~surrogate, F.col(parsed))
    return compute_once(staged.withColumn(out, event).drop(tag, boxed, parsed), out)


def _too_deep(text: Column) -> Column:
    """Whether arrays and objects are nested deeper than the limit; exact, and rarely looked at."""
    closed = F.replace(F.replace(text, F.lit("["), F.lit("")), F.lit("{"), F.lit(""))
    opening = F.octet_length(text) - F.octet_length(closed)
    brackets = F.regexp_replace(F.regexp_replace(text, _STRING, ""), r"[^\[\]{}]+", "")
    level = F.aggregate(
        F.split(brackets, ""),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda acc, c: F.struct(
            (acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"),
            F.greatest(acc["most"], acc["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most"),
        ),
        lambda acc: acc["most"],
    )
    return F.when(opening >= DEPTH_LIMIT, level >= DEPTH_LIMIT).otherwise(False)


def _number_text(spelled: Column) -> Column:
    """A 64-bit float as the source's printer spells it: 1.5, 2000.0, 0.00001, 1e16, 1.5e-7."""
    value = spelled.cast("double")
    size = F.abs(value)
    short = value.cast("string")
    plain = lambda scale: F.regexp_replace(
        F.regexp_replace(short.cast(f"decimal(38,{scale})").cast("string"), "0+$", ""), r"\.$", ".0"
    )
    zero = F.when(spelled.startswith("-"), "-0.0").otherwise("0.0")
    return (
        F.when(size == 0, zero)
        .when((size >= 1e16) | (size < 1e-5), F.replace(F.lower(short), F.lit(".0e"), F.lit("e")))
        .when(size >= 1e7, plain(10))
        .when(size < 1e-3, plain(22))
        .otherwise(short)
    )


def printed(text: Column, event: Column, leave_out: str | None = None) -> Column:
    """The event as text: keys sorted, the last of equal keys kept, no spaces, numbers as they
    are printed from 64-bit values, and without the root member ``leave_out``.

    VARIANT does not keep whether a number had a fraction or an exponent. Where that changes the
    spelling, such numbers are parsed as strings with a mark hashed from the text, which is
    taken off again when they have been printed.
    """

    def bare(value: Column) -> Column:
        if leave_out is None:
            return F.to_json(value)
        inside = get(value, f'$["{leave_out}"]').isNotNull()
        return F.when(inside, F.to_json(without_key(value, leave_out))).otherwise(F.to_json(value))

    mark = F.concat(F.lit("number:"), F.hex(F.xxhash64(text)), F.lit(":"))

    def marked(token: Column) -> Column:
        wide = token.cast("decimal(38,0)")
        beyond = token.rlike("^-?[0-9]{39,}$") | (
            token.rlike("^-?[0-9]{19,38}$")
            & ((wide > F.lit(str(U64_MAX)).cast("decimal(20,0)")) | (wide < F.lit(str(-I64_MAX - 1)).cast("decimal(20,0)")))
        )
        is_float = token.rlike(r"^-?[0-9]+[.eE]") | (token == "-0") | beyond
        return F.when(is_float, F.concat(F.lit('"'), mark, _number_text(token), F.lit('"'))).otherwise(token)

    tokens = F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))
    numbers = F.array_join(
        F.transform(tokens, lambda t: F.when(t.rlike("^-?[0-9]"), marked(t)).otherwise(t)), ""
    )
    respelled = F.replace(bare(F.try_parse_json(numbers)), F.concat(F.lit('"'), mark), F.lit("\u0001"))
    exact = F.regexp_replace(respelled, '\u0001([^"]*)"', "$1")
    return F.when(text.rlike(_RESPELLED), exact).otherwise(bare(event))


def members(value: Column) -> Column:
    """Object members as a map; NULL for anything but an object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def without_key(value: Column, key: str) -> Column:
    return F.to_variant_object(F.map_filter(members(value), lambda k, _: k != key))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters never fold."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def strip(text: Column) -> Column:
    """Trim Unicode whitespace on both sides."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def base64_line(data: Column) -> Column:
    """Base64 on one line (Spark's own output is chunked)."""
    return F.translate(F.base64(data), "\r\n", "")
