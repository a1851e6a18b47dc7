"""Decode requests into one JSON event each: JSON body, form body or query string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventrail.functions import jsonx

TOKEN_FIELD = "x-ingest-token"
FORM_TYPE = "application/x-www-form-urlencoded"


def url_decoded(text: Column) -> Column:
    """Percent-decoding; a ``%`` that starts no escape stands for itself."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def url_pairs(text: Column) -> Column:
    """``a=1&b=2`` as an array of key/value structs, in order."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), "&"), lambda part: part != "")
    return F.transform(
        parts,
        lambda part: F.struct(
            url_decoded(F.substring_index(part, "=", 1)).alias("key"),
            F.when(
                F.instr(part, "=") > 0, url_decoded(F.substr(part, F.instr(part, "=") + 1))
            )
            .otherwise("")
            .alias("value"),
        ),
    )


def pairs_object(pairs: Column) -> Column:
    """Flat object text with sorted keys; the last of equal keys wins."""
    last = F.map_from_entries(pairs)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(last))))


def media_type(content_type: Column) -> Column:
    return jsonx.ascii_lower(jsonx.strip(F.substring_index(content_type, ";", 1)))


def header(name: str, headers: str = "headers") -> Column:
    """Header value whatever the case of its name; NULL when absent."""
    return F.try_element_at(
        F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name)), F.lit(1)
    )


def usable_token(text: Column) -> Column:
    """Trimmed token, NULL when blank."""
    return F.nullif(jsonx.strip(text), F.lit(""))


def decode(requests: DataFrame) -> DataFrame:
    """Add ``decoder``, ``decode_issue``, ``body_token``, ``event`` and ``event_text``.

    ``event`` is the VARIANT of a JSON request and NULL for the flat decoders, whose
    values are always strings.
    """
    is_get, is_post = F.col("method") == "GET", F.col("method") == "POST"
    empty = F.coalesce(F.octet_length("body"), F.lit(0)) == 0
    is_form = F.coalesce(media_type(F.col("content_type")) == FORM_TYPE, F.lit(False))
    decoder = (
        F.when(is_get, "query")
        .when(is_post & empty, F.lit(None).cast("string"))
        .when(is_post & is_form, "form")
        .when(is_post, "json")
    )
    staged = requests.withColumn("decoder", decoder).withColumn(
        "__json", F.when(F.col("decoder") == "json", F.col("body"))
    )
    staged = jsonx.parse_strict(staged, "__json", "event")
    flat = F.when(F.col("decoder") == "query", F.col("query")).when(
        F.col("decoder") == "form", F.col("body").cast("string")
    )
    staged = staged.withColumn("__pairs", F.when(flat.isNotNull(), url_pairs(flat))).withColumn(
        "__pairs",
        F.when(
            F.col("decoder").isin("query", "form"),
            F.coalesce("__pairs", F.array().cast("array<struct<key:string,value:string>>")),
        ),
    )
    root_token = jsonx.get(F.col("event"), f'$["{TOKEN_FIELD}"]')
    staged = staged.withColumn("__token", root_token)
    json_token = F.when(
        jsonx.kind(F.col("__token")) == "STRING",
        usable_token(F.try_variant_get("__token", "$", "string")),
    )
    tokens = F.filter("__pairs", lambda pair: pair["key"] == TOKEN_FIELD)
    fields = F.filter("__pairs", lambda pair: pair["key"] != TOKEN_FIELD)
    issue = (
        F.when(~(is_get | is_post), "ingest_method_not_allowed")
        .when(is_post & empty, "ingest_missing_request_body")
        .when((F.col("decoder") == "json") & F.col("event").isNull(), "ingest_invalid_json")
        .when(
            (F.col("decoder") == "form") & ~F.is_valid_utf8(F.col("body").cast("string")),
            "ingest_invalid_form",
        )
        .when((F.col("decoder") == "query") & (F.size(tokens) > 0), "ingest_query_token_not_supported")
    )
    form_token = usable_token(F.element_at(tokens, -1)["value"])
    return staged.withColumns(
        {
            "decode_issue": issue,
            "body_token": F.when(F.col("decoder") == "json", json_token).when(
                (F.col("decoder") == "form") & (F.size(tokens) > 0), form_token
            ),
            "event_text": F.when(
                F.col("decoder") == "json",
                jsonx.printed(F.col("body").cast("string"), F.col("event"), TOKEN_FIELD),
            ).otherwise(pairs_object(fields)),
        }
    ).drop("__json", "__pairs", "__token")
