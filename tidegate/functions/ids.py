"""Canonical URI identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quote_part(value: Column) -> Column:
    """Percent-encode everything but letters, digits and ``._-~``."""
    encoded = F.url_encode(value)
    for found, wanted in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return encoded


def quote_fragment(value: Column) -> Column:
    """Like a part, but ``()[],`` stay readable."""
    encoded = quote_part(value)
    for found, wanted in (("%28", "("), ("%29", ")"), ("%5B", "["), ("%5D", "]"), ("%2C", ",")):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return encoded


def quote_path(value: Column) -> Column:
    """Encode each segment of a relative POSIX path."""
    clean = F.regexp_replace(F.replace(value, F.lit("\\"), F.lit("/")), r"(^|/)(\./)+", "$1")
    clean = F.regexp_replace(F.regexp_replace(clean, "/+", "/"), "^/|/$|/\\.$", "")
    return F.array_join(F.transform(F.split(clean, "/"), quote_part), "/")


def is_part(value: Column) -> Column:
    """Components must be non-empty and trimmed."""
    return value.isNotNull() & (value != "") & ~value.rlike(r"^\s|\s\z")


def _with_fragment(base: Column, fragment: Column | None) -> Column:
    if fragment is None:
        return base
    return F.when(
        fragment.isNotNull() & (fragment != ""), F.concat(base, F.lit("#"), quote_fragment(fragment))
    ).otherwise(base)


def repo_id(repository: Column, path: Column, symbol: Column | None = None) -> Column:
    base = F.concat(F.lit("repo://"), quote_part(repository), F.lit("/"), quote_path(path))
    return _with_fragment(base, symbol)


def api_id(service: Column, method: Column, path: Column, operation: Column | None = None) -> Column:
    base = F.concat(
        F.lit("api://"), quote_part(service), F.lit("/"), quote_part(F.upper(method)),
        F.lit("/"), quote_path(path),
    )
    return _with_fragment(base, operation)


def proto_id(package: Column, service: Column, method: Column) -> Column:
    return F.concat(
        F.lit("proto://"), quote_part(package), F.lit("/"), quote_part(service),
        F.lit("/"), quote_part(method),
    )


def db_id(repository: Column, table: Column, column: Column | None = None) -> Column:
    base = F.concat(F.lit("db://"), quote_part(repository), F.lit("/"), quote_part(table))
    return _with_fragment(base, column)


def mq_id(service: Column, topic: Column, message: Column | None = None) -> Column:
    base = F.concat(F.lit("mq://"), quote_part(service), F.lit("/"), quote_part(topic))
    return _with_fragment(base, message)


def java_symbol(class_name: Column, method: Column, parameter_types: Column) -> Column:
    return F.concat(
        quote_part(class_name), F.lit("."), quote_part(method), F.lit("("),
        F.array_join(F.transform(parameter_types, quote_part), ","), F.lit(")"),
    )


def canonical_faults(rows: DataFrame, uri: str) -> DataFrame:
    """Add ``fault``: why an api/proto/db/mq URI is not canonical, else null.

    The URI is split into decoded parts and rebuilt; any difference is a fault. The parts
    are columns of their own so that each is computed once per row.
    """
    split = rows.withColumns({
        "_scheme": F.regexp_extract(uri, r"^([a-z]+)://", 1),
        "_host": F.url_decode(F.regexp_extract(uri, r"^[a-z]+://([^/#]*)", 1)),
        "_parts": F.transform(
            F.filter(
                F.split(F.regexp_extract(uri, r"^[a-z]+://[^/#]*/?([^#]*)", 1), "/"),
                lambda p: p != "",
            ),
            lambda p: F.url_decode(p),
        ),
        "_fragment": F.url_decode(F.regexp_extract(uri, r"#(.*)$", 1)),
    })
    parts, scheme, host = F.col("_parts"), F.col("_scheme"), F.col("_host")
    size = F.size(parts)
    # ``get`` is null past the end, so a branch of the wrong arity is simply not taken.
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(size, F.lit(1))), "/")
    rebuilt = (
        F.when((scheme == "api") & (size >= 2), api_id(host, first, rest, F.col("_fragment")))
        .when((scheme == "proto") & (size == 2), proto_id(host, first, second))
        .when((scheme == "db") & (size == 1), db_id(host, first, F.col("_fragment")))
        .when((scheme == "mq") & (size == 1), mq_id(host, first, F.col("_fragment")))
    )
    checked = split.withColumn("_rebuilt", rebuilt)
    fault = F.when(
        ~scheme.isin("api", "proto", "db", "mq"), F.lit(None).cast("string")
    ).when(F.col("_rebuilt").isNull(), "invalid canonical ID shape").when(
        F.col(uri) != F.col("_rebuilt"), "canonical ID does not match its factory"
    )
    return checked.withColumn("fault", fault).drop(
        "_scheme", "_host", "_parts", "_fragment", "_rebuilt"
    )
