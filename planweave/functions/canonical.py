"""Canonical texts, hashes and identifiers as column expressions. Everything stays in Spark SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The codes that validators may be relaxed for are the upper-cased keys behind this prefix.
VALIDATION = "VALIDATION_"


def parsed(text: Column) -> Column:
    """JSON text as a variant, or null; of a key that repeats in an object the last value counts."""
    session = SparkSession.getActiveSession()
    if session is not None:
        session.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return F.try_parse_json(text)


_TOKENS = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'


def canonical_json(text: Column) -> Column:
    """JSON text with object keys sorted at every level, arrays in order, ``-0`` as ``0`` and nulls kept; null for null or text that is no JSON.

    A number has one form however it was given: whole ones (below 10^15) without fraction or exponent, others as the shortest text of the
    double. A number beyond doubles is no JSON here. Of a key that repeats in an object the last value counts.
    """
    plain = F.to_json(parsed(text))
    odd = plain.rlike(r"[0-9][.eE][0-9+-]")
    huge = F.exists(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), lambda p: p.rlike("^-?[0-9]") & (F.abs(p.try_cast("double")) == float("inf")))
    beyond = F.when(text.rlike(r"[0-9][eE]\+?[0-9]{3}|[0-9]{300}"), huge).otherwise(False)
    return F.when(beyond, None).when(odd, normal_numbers(plain)).otherwise(plain)


def normal_numbers(text: Column) -> Column:
    """JSON text with every number in its one form."""
    parts = F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^-?[0-9]"), number_text(p)).otherwise(p)), "")


def number_text(number: Column) -> Column:
    """One form for the text of a number."""
    value = number.try_cast("double")
    whole = (F.abs(value) < 1e15) & (value == F.floor(value))
    short = F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))
    return F.when(number.rlike("[.eE]") | (F.length(number) > 38), short).when(number == "-0", "0").otherwise(number)


def pretty_json(text: Column) -> Column:
    """Canonical JSON of an object of plain values with one member a line, indented by two spaces; its size in bytes is ``octet_length``."""
    plain = canonical_json(text)
    pattern = F.lit(r'"(?:[^"\\]|\\.)*":(?:"(?:[^"\\]|\\.)*"|[^",{}\[\]]+)')
    lines = F.transform(F.regexp_extract_all(plain, pattern, F.lit(0)), lambda m: F.concat(F.lit("  "), F.regexp_replace(m, r'^("(?:[^"\\]|\\.)*"):', "$1: ")))
    return F.when(plain.isNull() | (F.size(lines) == 0), plain).otherwise(F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}")))


def semantic_hash(text: Column) -> Column:
    """SHA-256 of the canonical JSON text; equal for documents that differ in key order or number notation only."""
    return F.sha2(canonical_json(text), 256)


def row_hash(*columns: str) -> Column:
    """SHA-256 of columns as one JSON object: nulls and separators in values count, so different rows have different texts."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def canonical_timestamp(text: Column) -> Column:
    """ISO-8601 in UTC with milliseconds, or null where the text is no timestamp. The session's time zone must be UTC."""
    return F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def sort_localized(localized: Column, order: list[str]) -> Column:
    """Entries of a map by the rank of their locale in ``order``, then by name; locales without a rank come last."""
    rank = F.create_map(*(x for i, loc in enumerate(order) for x in (F.lit(loc), F.lit(i)))) if order else F.create_map()
    place = lambda e: F.coalesce(F.try_element_at(rank, e["key"]), F.lit(len(order))) if order else F.lit(0)
    keyed = F.transform(F.map_entries(localized), lambda e: F.struct(place(e).alias("rank"), e["key"].alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.transform(F.array_sort(keyed), lambda e: F.struct(e["key"], e["value"])))


def is_portable_id(id_: Column) -> Column:
    """Whether an id is the unpadded base64url form of a version 4 UUID."""
    padded = F.concat(F.translate(id_, "-_", "+/"), F.lit("=="))
    digits = F.hex(F.unbase64(F.when(id_.rlike("^[A-Za-z0-9_-]{21}[AQgw]$"), padded)))
    return F.coalesce((F.substring(digits, 13, 1) == "4") & F.substring(digits, 17, 1).isin("8", "9", "A", "B"), F.lit(False))


def is_legacy_id(id_: Column) -> Column:
    """Whether an id is numeric: digits without leading zero."""
    return F.coalesce(id_.rlike("^(0|[1-9][0-9]*)$"), F.lit(False))


def deterministic_id(seed: Column) -> Column:
    """A portable id from a seed text: the first 16 bytes of its SHA-256 with the version and variant bits of a UUID."""
    digits = F.upper(F.substring(F.sha2(seed, 256), 1, 32))
    variant = F.element_at(F.array(*map(F.lit, "89AB")), (F.conv(F.substring(digits, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    bits = F.concat(F.substring(digits, 1, 12), F.lit("4"), F.substring(digits, 14, 3), variant, F.substring(digits, 18, 15))
    return F.translate(F.rtrim(F.base64(F.unhex(bits)), F.lit("=")), "+/", "-_")


def filename_extension(filename: Column) -> Column:
    """Lower-case part behind the last dot of the last path part; a leading dot does not count. Empty if there is none."""
    return F.lower(F.regexp_extract(filename, r"[^/]\.([^./]*)$", 1))


def basename(filename: Column) -> Column:
    """The last path part without its extension."""
    return F.regexp_replace(F.regexp_extract(filename, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def is_plain_filename(stem: Column) -> Column:
    """Lower-case ASCII letters and digits in parts joined by ``-`` or ``_``."""
    return F.coalesce(stem.rlike("^[a-z0-9]+([-_][a-z0-9]+)*$"), F.lit(False))


#: The last two code points of the planes above the first, which are no characters.
PLANE_ENDS = "".join(rf"\x{{{plane:X}FFFE}}-\x{{{plane:X}FFFF}}" for plane in range(1, 17))


def is_stable_text(text: Column) -> Column:
    """Whether a sanitizer leaves the text alone: no angle brackets, ampersand, carriage return, control or non-breaking space, non-character of any plane."""
    return ~text.rlike("[<>&\\r\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\u00A0\\uFDD0-\\uFDEF\\uFFFE\\uFFFF" + PLANE_ENDS + "]")


def is_normal_text(text: Column) -> Column:
    """Stripped, without runs of white space or control characters."""
    return (text == F.trim(F.regexp_replace(text, r"\s+", " "))) & ~text.rlike("[\\x00-\\x1F\\x7F]")


def is_http_url(text: Column) -> Column:
    """Absolute http or https address with a host."""
    return F.coalesce(text.rlike("^(?i)https?://[^/?#\\s]+"), F.lit(False))


def is_blank(text: Column) -> Column:
    """Null, empty, or nothing but white space of any kind (that of ECMAScript, which has U+FEFF too)."""
    return text.isNull() | text.rlike(r"^[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]*\z")


def claim_key(locale: Column | None, value: Column) -> Column:
    """Key of a uniqueness claim: locale (or ``value``) and the hash of the value."""
    return F.concat(F.coalesce(locale, F.lit("value")) if locale is not None else F.lit("value"), F.lit(":"), F.sha2(value, 256))


def issue_scope(path: Column) -> Column:
    """Locale of a failing path ``slice.field.locale``, or null for a field that is not localized."""
    parts = F.split(path, r"\.")
    return F.when(F.size(parts) > 2, F.element_at(parts, 3))


def validator_of(code: Column) -> Column:
    """The validator's key that an issue code names, or null."""
    return F.when(code.startswith(VALIDATION), F.lower(F.substring(code, len(VALIDATION) + 1, 200)))


def set_digest(hashes: Column) -> Column:
    """Aggregate: one number for a set of hex hashes whatever their order, the sum of their first 60 bits modulo 2^61 - 1."""
    return (F.sum(F.conv(F.substring(hashes, 1, 15), 16, 10).cast("decimal(38,0)")) % F.lit((1 << 61) - 1)).cast("long")


def order_free_digest(hashes: Column) -> list[Column]:
    """Aggregates that tell two sets of row hashes apart whatever their order: count, xor and sum of 64-bit hashes."""
    h = F.xxhash64(hashes)
    return [F.count("*").alias("n"), F.bit_xor(h).alias("digest_xor"), F.sum(F.pmod(h, F.lit(1 << 40))).alias("digest_sum")]
