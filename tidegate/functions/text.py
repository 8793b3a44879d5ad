"""Tokenisers, token estimates and set similarity as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token patterns; Unicode classes are spelled out because the JVM's
# plain word class is ASCII only.
LEXICAL_PATTERN = r"[\p{L}\p{N}_-]+"
INDEX_PATTERN = r"[\p{L}\p{N}]+"
IDENTIFIER_PATTERN = r"[A-Za-z][A-Za-z0-9_]*"
HUMP_PATTERN = r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|\d+"
# One match per CJK character, per started four ASCII word characters, per other symbol.
UNIT_PATTERN = (
    r"[\x{4e00}-\x{9fff}]|[A-Za-z0-9_]{1,4}|"
    r"[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    r"A-Za-z0-9_\x{4e00}-\x{9fff}]"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
CHUNK_CHARACTERS = 800


def lexical_tokens(text: Column) -> Column:
    """Lower-cased tokens that keep ``_`` and ``-`` inside a token."""
    return F.regexp_extract_all(F.lower(text), F.lit(LEXICAL_PATTERN), F.lit(0))


def index_tokens(text: Column) -> Column:
    """Lower-cased letter and digit runs, the tokens of the inverted index."""
    return F.regexp_extract_all(F.lower(text), F.lit(INDEX_PATTERN), F.lit(0))


def identifier_terms(text: Column) -> Column:
    """Distinct lower-cased camel humps and digit runs of identifiers, two letters or more."""
    names = F.regexp_extract_all(text, F.lit(IDENTIFIER_PATTERN), F.lit(0))
    humps = F.flatten(
        F.transform(
            names,
            lambda name: F.regexp_extract_all(
                F.replace(name, F.lit("_"), F.lit(" ")), F.lit(HUMP_PATTERN), F.lit(0)
            ),
        )
    )
    return F.array_distinct(
        F.transform(F.filter(humps, lambda term: F.length(term) > 1), lambda term: F.lower(term))
    )


def set_cosine(left: Column, right: Column) -> Column:
    """|A n B| / sqrt(|A| |B|) over distinct tokens, 0 when either side is empty."""
    return distinct_cosine(F.array_distinct(left), F.array_distinct(right))


def distinct_cosine(left: Column, right: Column) -> Column:
    """Set cosine of arrays that hold no token twice."""
    scale = F.sqrt(F.size(left).cast("double") * F.size(right).cast("double"))
    return F.when(scale > 0, F.size(F.array_intersect(left, right)) / scale).otherwise(F.lit(0.0))


def token_estimate(serialized: Column) -> Column:
    """Tokens of serialised text: CJK characters and symbols 1 each, words 1 per 4 bytes."""
    return F.regexp_count(serialized, F.lit(UNIT_PATTERN))


def json_string(text: Column) -> Column:
    """The JSON literal of a string."""
    wrapped = F.to_json(F.struct(text.alias("t")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def chunk_text(text: Column, size: int = CHUNK_CHARACTERS) -> Column:
    """Trimmed text in fixed-length pieces; empty text has none."""
    body = F.regexp_replace(text, r"^\s+|\s+\z", "")
    count = F.ceil(F.length(body) / F.lit(size)).cast("int")
    return F.when(
        count > 0,
        F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.substring(body, i * F.lit(size) + F.lit(1), F.lit(size)),
        ),
    ).otherwise(F.array().cast("array<string>"))


def split_lines(text: Column) -> Column:
    """Lines of a text; a final line break does not open an empty line."""
    parts = F.split(text, LINE_BREAK)
    return F.when(text == "", F.array().cast("array<string>")).when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts)


def snake_case(name: Column) -> Column:
    """Underscore before every capital but the first character, lower-cased."""
    return F.lower(F.regexp_replace(name, r"(?<!^)(?=[A-Z])", "_"))


def suffix(path: Column) -> Column:
    """Lower-cased file suffix with its dot, empty when there is none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
