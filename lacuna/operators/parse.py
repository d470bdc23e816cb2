"""Validation of raw responses: typed rows, and rejects with their reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_app_id(c: Column) -> Column:
    return c.between(1, 4294967295)


def whole_json(text: Column) -> Column:
    """A JSON text as a VARIANT, or null where it is none from its first sign to its last but for white space.

    The parser stops after the first value. So the text is read as the first of two elements, the other being a number
    made from the text itself: only if nothing follows the text's value is that number the second element. An object
    that names a key twice is no JSON here (spark.sql.variant.allowDuplicateKeys lets it pass).
    """
    seal = F.xxhash64(text)
    both = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), seal.cast("string"), F.lit("]"))), "$", "array<variant>")
    sealed = (F.size(both) == 2) & (F.schema_of_variant(F.get(both, F.lit(1))) == "BIGINT") & (F.try_variant_get(F.get(both, F.lit(1)), "$", "bigint") == seal)
    return F.when(sealed, F.get(both, F.lit(0)))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns that are computed once for each row.

    Columns of a projection are copied into every later use, filters too; what a generator gives isn't, so a text is parsed once.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def is_list(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def field(v: Column, name: str) -> Column:
    """A field of an object as a VARIANT; null where v is no object or lacks it. A field that is JSON's null isn't null."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def integer(v: Column) -> Column:
    """A whole number of 64 bits that is written as one; null for anything else: 5.0, 1e3, true and "5" are none."""
    return F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def string(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def boolean(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def number(v: Column) -> Column:
    """Any number, and 1 or 0 for a truth value, as a double."""
    kind = F.schema_of_variant(v)
    return F.when(kind.isin("BIGINT", "DOUBLE", "BOOLEAN", "FLOAT") | kind.startswith("DECIMAL"), F.coalesce(F.try_variant_get(v, "$", "double"), boolean(v).cast("double")))


def elements(v: Column) -> Column:
    """The elements of a list; none where v is no list."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def record(v: Column, *names: str) -> Column:
    """The named fields of an object, each as a VARIANT, as a struct; null where v is no object."""
    return F.try_variant_get(v, "$", "struct<" + ",".join(f"{n}:variant" for n in names) + ">")


def records(v: Column, *names: str) -> Column:
    """record of each element of a list that is an object."""
    return F.filter(F.transform(elements(v), lambda e: record(e, *names)), lambda r: r.isNotNull())


def not_blank(text: Column) -> Column:
    """Whether there is a sign that is no white space, of whatever script; null for null."""
    return text.rlike(r"(?U)[^\s\x1c-\x1f]")


def json_fault(text: Column, parsed: Column) -> Column:
    """invalid_json, invalid_schema (JSON, but no object), or null for an object. parsed: whole_json(text)."""
    return F.when(parsed.isNull() | text.isNull(), "invalid_json").when(~is_object(parsed), "invalid_schema")


def json_object_fault(payload: Column) -> Column:
    """json_fault of a text that hasn't been parsed yet."""
    return json_fault(payload, whole_json(payload))


def parse_player_counts(captures: DataFrame) -> DataFrame:
    """capture_id, app_id, t, player_count, code: code is null for valid rows, else invalid_json, invalid_schema, provider_result or invalid_player_count.

    Integers are strict: text, booleans, fractions, negatives and overflow are rejected; zero is kept.
    """
    parsed = once(captures, v=whole_json(F.col("payload"))).withColumn("r", field(F.col("v"), "response"))
    count = integer(field(F.col("r"), "player_count"))
    code = (
        F.when(json_fault(F.col("payload"), F.col("v")).isNotNull(), json_fault(F.col("payload"), F.col("v")))
        .when(~F.coalesce(integer(field(F.col("r"), "result")) == 1, F.lit(False)), "provider_result")
        .when(~F.coalesce(count >= 0, F.lit(False)), "invalid_player_count")
    )
    return parsed.withColumn("code", code).select("capture_id", "app_id", "t", F.when(F.col("code").isNull(), count).alias("player_count"), "code")


#: The markup tags that news may hold, as a pattern.
NEWS_TAGS = r"(?i)\[/?(?:url|b|i|u|h[1-6]|list|olist|quote|code|spoiler|img|previewyoutube|table|tr|td|th)(?:=[^\]]*)?\]|\[\*\]"


def clean_news_markup(text: Column) -> Column:
    """Text without images, clan-image tokens and markup tags, and without white space around it."""
    text = F.regexp_replace(text, r"(?is)\[img\].*?\[/img\]", "")
    text = F.regexp_replace(text, r"\{STEAM_CLAN_IMAGE\}[^ \t\n\r\f\[]*", "")
    return F.regexp_replace(F.regexp_replace(text, NEWS_TAGS, ""), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def safe_url(url: Column, hosts: list[str] | None = None) -> Column:
    """The url if it is http or https with a host and without credentials; with hosts: https, one of them, no port but 443. Else null.

    Scheme and host count whatever their case; what follows the host may hold any signs.
    """
    bare = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    part = lambda pattern: F.lower(F.regexp_extract(bare, r"(?is)^(https?)://(?:([^/?#]*)@)?" + pattern, 1))
    user = F.regexp_extract(bare, r"(?is)^https?://([^/?#]*)@", 1)
    place = F.regexp_extract(bare, r"(?is)^https?://(?:[^/?#]*@)?(\[[^/?#\[\]]+\]|[^/?#:\[\]]+)(?::[^/?#\[\]]*)?(?:[/?#].*)?$", 1)
    port = F.regexp_extract(bare, r"(?is)^https?://(?:[^/?#]*@)?(?:\[[^/?#]*\]|[^/?#:]*):([^/?#]*)", 1)
    ok = (part("") != "") & (place != "") & user.isin("", ":")
    if hosts is not None:
        ok = ok & (part("") == "https") & F.lower(place).isin(hosts) & port.rlike("^(0*443)?$")
    return F.when(ok, url)
