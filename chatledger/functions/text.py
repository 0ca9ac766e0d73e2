"""Text measures as column expressions; everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatledger.rules import WHITE_SPACE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_all(s: Column) -> Column:
    """Strip every kind of Unicode white space, not only blanks, at both ends."""
    # Trimming a set of characters takes the whole text apart, so ends that need none are left.
    space = F.lit(WHITE_SPACE)
    trimmed = F.contains(space, F.left(s, F.lit(1))) | F.contains(space, F.right(s, F.lit(1)))
    return F.when(trimmed, F.btrim(s, space)).otherwise(s)


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 units: characters outside the BMP count twice."""
    # Of a text with a byte a character the bytes are counted at once.
    return F.when(F.octet_length(s) == F.char_length(s), F.octet_length(s)).otherwise(
        F.shiftright(F.octet_length(F.encode(s, "UTF-16BE")), 1)
    )


def json_quote(s: Column) -> Column:
    """The JSON string literal for ``s``, quotes included; null for null."""
    quoted = let(F.to_json(F.array(s)), lambda j: F.substring(j, F.lit(2), F.char_length(j) - 2))
    return F.when(s.isNotNull(), quoted)


def json_number(x: Column) -> Column:
    """JSON text of a double as JavaScript writes it: ``1`` rather than ``1.0``, and an
    exponent (``1e+25``, ``1e-7``) only from 1e21 on and below 1e-6.  An infinite number,
    which JSON has no text for, is ``null``."""
    text = x.cast("string")
    digits = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1)
    signed = F.when(power.startswith("-"), power).otherwise(F.concat(F.lit("+"), power))
    small = F.regexp_replace(x.try_cast("decimal(38,30)").cast("string"), r"\.?0+$", "")
    return (
        F.when(F.abs(x) == float("inf"), F.lit("null"))
        .when((x != 0) & ((F.abs(x) >= 1e21) | (F.abs(x) < 1e-6)), F.concat(digits, F.lit("e"), signed))
        .when(x == F.rint(x), x.try_cast("decimal(38,0)").cast("string"))
        .when(text.contains("E"), small)
        .otherwise(text)
    )


#: JSON as its standard has it: no single quotes and no ``NaN``.
STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


#: Characters of the longest JSON string Spark reads.
MAX_JSON_STRING = 20_000_000


def is_json(raw: Column) -> Column:
    """Whether ``raw`` is just one JSON value; keys may repeat.

    It is read as the first of two elements: what follows the value, or closes the
    array early, makes that fail.
    """
    end = "-end-"
    pair = F.from_json(F.concat(F.lit("["), raw, F.lit(f', "{end}"]')), "array<string>", STRICT_JSON)
    read = F.coalesce((F.size(pair) == 2) & (F.get(pair, F.lit(1)) == end), F.lit(False))
    # An object is passed over, without copying what it holds; longer strings than a reader
    # takes are only refused where they are copied.
    element = f"struct<`{end}`: boolean>"
    over = F.from_json(F.concat(F.lit("["), raw, F.lit(f', {{"{end}":true}}]')), f"array<{element}>", STRICT_JSON)
    passed = F.array(F.lit(None).cast("boolean"), F.lit(True))
    passed = F.transform(passed, lambda p: F.struct(p.alias(end)))
    short = (F.octet_length(raw) < MAX_JSON_STRING) & ~F.contains(raw, F.lit(end))
    return F.when(short & (over == passed), F.lit(True)).otherwise(read)


def entropy(column: str) -> Column:
    """Shannon entropy in bits per character; 0 for null or empty text."""
    return F.expr(entropy_sql(column_sql(column)))


def is_high_entropy(column: str, min_length: int = 20, min_entropy: float = 4.2) -> Column:
    """Long enough, not made of letters and white space only, and random enough."""
    s = F.col(column)
    letters_only = F.btrim(s, F.lit(WHITE_SPACE + _LETTERS)) == ""
    return F.coalesce(
        (utf16_length(s) >= min_length) & ~letters_only & (entropy(column) >= min_entropy), F.lit(False)
    )


_LETTERS = "".join(map(chr, range(ord("A"), ord("Z") + 1))) + "".join(
    map(chr, range(ord("a"), ord("z") + 1))
)


def truthy(s: Column) -> Column:
    """Whether a JSON scalar, read as text, counts as true (missing does not)."""
    return F.coalesce(~s.isin("", "false", "0", "null"), F.lit(False))


def estimate(chars: Column) -> Column:
    """Tokens for a number of characters: a quarter, rounded up."""
    return F.ceil(chars / 4).cast("bigint")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since the epoch, truncated; takes either timestamp type."""
    return F.unix_millis(ts.cast("timestamp"))


def utc_day(ms: Column) -> Column:
    """UTC calendar day of an epoch-millisecond value, whatever the session zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))


# --- SQL text ----------------------------------------------------------------
# Large expressions are written as SQL text: Spark parses a whole rule catalogue
# in one call, where building it node by node takes seconds on the driver.


def sql_string(s: str) -> str:
    """``s`` as a SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let_sql(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once as ``name`` within ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def utf16_length_sql(s: str) -> str:
    """As :func:`utf16_length`."""
    return (
        f"CASE WHEN octet_length({s}) = char_length({s}) THEN octet_length({s}) "
        f"ELSE shiftright(octet_length(encode({s}, 'UTF-16BE')), 1) END"
    )


def entropy_sql(s: str) -> str:
    """As :func:`entropy`."""
    share = f"((char_length({s}) - char_length(replace({s}, ch, ''))) / size_)"
    bits = (
        f"aggregate(array_distinct(split({s}, '')), 0.0D, "
        f"(acc_, ch) -> acc_ - {let_sql(share, 'p_', 'p_ * log2(p_)')})"
    )
    measured = let_sql(f"CAST({utf16_length_sql(s)} AS DOUBLE)", "size_", bits)
    return f"CASE WHEN char_length({s}) > 0 THEN {measured} ELSE 0.0D END"


def json_quote_sql(s: str) -> str:
    """As :func:`json_quote`."""
    quoted = let_sql(f"to_json(array({s}))", "json_", "substring(json_, 2, char_length(json_) - 2)")
    return f"CASE WHEN {s} IS NOT NULL THEN {quoted} END"


def column_sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
