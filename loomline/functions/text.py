"""Text columns: naming, masking, patterns, HTML, URLs, JSON, digests, versions, ids.

All native expressions, so they stay inside generated code; Python runs only
where the full HTML entity table is needed.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted forms of the scalar checks (Unicode word characters).
EMAIL_FORM = r"(?U)^[\w.-]+@[\w.-]+\.\w+$"
URL_FORM = r"(?U)^https?://[\w.-]+\.\w+"
UUID_FORM = r"^(?:urn:)?(?:uuid:)?\{*[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}*$"
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"

def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside nested lambdas."""
    return F.transform(F.array(value), body)[0]


# White space as Python's strip() sees it.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """The text without white space at both ends."""
    return F.btrim(c, F.lit(BLANKS))


# ---------------------------------------------------------------- naming


def slugify(c: Column) -> Column:
    kept = F.regexp_replace(F.lower(c), r"(?U)[^\w\s-]+", "")
    return F.regexp_replace(F.regexp_replace(kept, r"(?U)[-\s]+", "-"), "^-+|-+$", "")


def truncate(c: Column, length: int, suffix: str = "...") -> Column:
    """At most ``length`` characters including the suffix; a plain prefix when it has no room."""
    keep = max(length - len(suffix), 0)
    cut = F.concat(F.substring(c, 1, keep), F.lit(suffix)) if length >= len(suffix) else F.substring(c, 1, length)
    return F.when(F.length(c) <= length, c).otherwise(cut)


def title_case(c: Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere."""
    pieces = F.split(c, r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(pieces, F.initcap), "")


def camel_to_snake(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?<!^)(?=[A-Z])", "_"))


def acronym_snake(c: Column) -> Column:
    """Snake case that keeps runs of capitals together (``HTTPServer`` -> ``http_server``)."""
    # The two patterns, as specified.
    once = F.regexp_replace(c, "(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(once, "([a-z0-9])([A-Z])", "$1_$2"))


def snake_to_camel(c: Column) -> Column:
    return let(F.split(c, "_"), lambda parts: F.concat(
        parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), title_case), "")))


def upper_camel(c: Column) -> Column:
    """Snake case to upper camel case; empty parts vanish."""
    parts = F.filter(F.split(c, "_"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


# ---------------------------------------------------------------- sensitive data


def mask(c: Column) -> Column:
    """Stars, but the first and last two characters of texts longer than four."""
    n = F.length(c)
    long_ = F.concat(F.substring(c, 1, 2), F.repeat(F.lit("*"), n - 4), F.right(c, F.lit(2)))
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(long_)


def is_email(c: Column) -> Column:
    return c.rlike(EMAIL_FORM)


def is_url(c: Column) -> Column:
    return c.rlike(URL_FORM)


def is_ip(c: Column) -> Column:
    """Four dot-separated decimal numbers of 0 to 255."""
    parts = F.split(c, r"\.", -1)
    byte = lambda p: p.rlike(r"^\d+$") & F.coalesce(p.try_cast("int") <= 255, F.lit(False))
    return (F.size(parts) == 4) & F.forall(parts, byte)


def sensitive_tokens(df: DataFrame, text: str) -> DataFrame:
    """One row per white-space token that is an email, a URL or an IP address, with its mask."""
    # a cheap test inside the array first: only tokens that can be one of the kinds become rows
    likely = F.filter(F.split(F.col(text), r"\s+"), lambda t: t.contains("@") | t.startswith("http") | t.rlike(r"^\d+\."))
    tokens = df.withColumn("token", F.explode(likely))
    t = F.col("token")
    kind = F.when(is_email(t), "email").when(is_url(t), "url").when(is_ip(t), "ip")
    return tokens.withColumn("kind", kind).filter("kind is not null").withColumn("masked", mask(t)).drop(text)


# ---------------------------------------------------------------- patterns


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def matches_at_start(c: Column, pattern: str) -> Column:
    return c.rlike(f"^(?:{pattern})")


def extract_numbers(c: Column) -> Column:
    """All digit runs without leading zeros, as text, so that a run of any length stays exact."""
    return F.transform(find_all(c, r"\d+"), without_zeros)


def without_zeros(digits: Column) -> Column:
    return F.regexp_replace(digits, "^0+(?=.)", "")


def sum_of_digits(numbers: Column) -> Column:
    """Exact sum of whole numbers written as text, added nine digits at a time."""
    def added(ns):
        limbs = F.ceil(F.coalesce(F.array_max(F.transform(ns, F.length)), F.lit(0)) / 9).cast("int")

        def add(state, k):
            part = lambda x: F.substring(F.lpad(x, 9 * limbs, "0"), (limbs - k) * 9 + 1, F.lit(9)).cast("bigint")
            total = state["carry"] + F.aggregate(ns, F.lit(0).cast("bigint"), lambda a, x: a + part(x))
            return F.struct(F.floor(total.cast("decimal(20,0)") / F.lit(1_000_000_000).cast("decimal(10,0)")).cast("bigint").alias("carry"),
                            F.concat(F.lpad((total % 1_000_000_000).cast("string"), 9, "0"), state["text"]).alias("text"))

        start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit("").alias("text"))
        return F.when(limbs == 0, "0").otherwise(F.aggregate(
            F.sequence(F.lit(1), F.greatest(limbs, F.lit(1))), start, add,
            lambda s: without_zeros(F.concat(s["carry"].cast("string"), s["text"]))))

    return let(numbers, added)


# ---------------------------------------------------------------- HTML


def strip_tags(c: Column) -> Column:
    # Fixed value: what counts as a tag, as specified.
    return F.regexp_replace(c, "<[^>]+>", "")


def html_escape(c: Column) -> Column:
    # The five escaped characters, ampersand first.
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


@F.pandas_udf(T.StringType())
def html_unescape(values: pd.Series) -> pd.Series:
    """Every named and numeric entity, in Arrow batches."""
    return values.map(lambda v: None if v is None else html.unescape(v))


def last_wins_map(keys: Column, values: Column) -> Column:
    """Map from two arrays where a repeated key takes its last value."""
    def build(s):
        placed = F.sort_array(F.transform(s["k"], lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        last = let(placed, lambda ps: F.filter(ps, lambda p, j: F.coalesce(F.get(ps, j + 1)["k"] != p["k"], F.lit(True))))
        ordered = F.sort_array(F.transform(last, lambda p: F.struct(p["i"].alias("i"), p["k"].alias("k"))))
        return F.map_from_entries(F.transform(ordered, lambda p: F.struct(p["k"], F.get(s["v"], p["i"]))))
    return let(F.struct(keys.alias("k"), values.alias("v")), build)


def parse_attributes(c: Column) -> Column:
    """Map of the ``name="value"`` pairs."""
    # Fixed value: the form of an attribute, as specified.
    pattern = r'(?U)(\w+)="([^"]*)"'
    return last_wins_map(find_all(c, pattern, 1), find_all(c, pattern, 2))


# ---------------------------------------------------------------- URLs

# The generic URI form: scheme, authority, path, query, fragment.
URI_FORM = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def url_part(c: Column, part: str) -> Column:
    """scheme, netloc, path, query or fragment; empty text when absent. Any text is accepted."""
    group = {"scheme": 1, "netloc": 2, "path": 3, "query": 4, "fragment": 5}[part]
    value = F.regexp_extract(c, URI_FORM, group)
    return F.lower(value) if part == "scheme" else value


def domain(c: Column) -> Column:
    value = url_part(c, "netloc")
    return F.when(value != "", value)


def percent_decode(c: Column) -> Column:
    """Percent-decoding with ``+`` as a blank; stray percent signs stay as they are."""
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def decode_params(query: Column) -> Column:
    """Map of ``k=v`` pairs, percent-decoded; blank values are dropped, a repeated key takes the last."""
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=."))
    return let(pairs, lambda ps: last_wins_map(
        F.transform(ps, lambda p: percent_decode(F.regexp_extract(p, "^([^=]*)=", 1))),
        F.transform(ps, lambda p: percent_decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)))))


def encode_params(params: Column) -> Column:
    """``k=v&k=v`` of a map, percent-encoded, in map order."""
    pairs = F.transform(F.map_entries(params), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"])))
    return F.array_join(pairs, "&")


def url_quote(c: Column) -> Column:
    """Percent-encoding that keeps slashes and tildes and writes a blank as %20."""
    coded = F.url_encode(c)
    for have, want in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        coded = F.replace(coded, F.lit(have), F.lit(want))
    return coded


def url_unquote(c: Column) -> Column:
    return percent_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def build_url(scheme: Column, host: Column, path: Column, params: Column | None = None) -> Column:
    base = F.concat(scheme, F.lit("://"), host, path)
    if params is None:
        return base
    query = encode_params(params)
    return F.when(F.coalesce(query, F.lit("")) == "", base).otherwise(F.concat(base, F.lit("?"), query))


# ---------------------------------------------------------------- JSON


def is_json(c: Column) -> Column:
    return F.coalesce(F.try_parse_json(c).isNotNull(), F.lit(False))


def parse_or_default(c: Column, default: str = "null") -> Column:
    """VARIANT of the text, or of ``default`` when it is not JSON."""
    return F.coalesce(F.try_parse_json(c), F.parse_json(F.lit(default)))


def sorted_json(c: Column) -> Column:
    """JSON text of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))


def json_profile(df: DataFrame, text: str) -> DataFrame:
    """(key, type, n): how often each top-level key occurs with each type; bad JSON as key NULL."""
    parsed = df.select(F.try_parse_json(text).alias("v"))
    spark = df.sparkSession
    pairs = parsed.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()))
    kind = F.when(F.col("v").isNull(), "invalid").otherwise(F.schema_of_variant("value"))
    return pairs.select("key", kind.alias("type")).groupBy("key", "type").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- digests and ids


def hash_id(c: Column) -> Column:
    """Twelve hex digits of the MD5."""
    return F.substring(F.md5(c), 1, 12)


def cache_key(operation: Column, path: Column) -> Column:
    """Sixteen hex digits of the SHA-256 of ``operation:path``."""
    return F.substring(F.sha2(F.concat(operation, F.lit(":"), path), 256), 1, 16)


def base64_url(c: Column) -> Column:
    return F.translate(F.base64(F.encode(c, "utf-8")), "+/", "-_")


def unbase64_url(c: Column) -> Column:
    return F.decode(F.unbase64(F.translate(c, "-_", "+/")), "utf-8")


def duplicate_groups(df: DataFrame, text: str, ident: str) -> DataFrame:
    """(fingerprint, first id, copies) of texts that occur more than once.

    Only digests are shuffled, already combined per task.
    """
    prints = df.select(F.md5(text).alias("fingerprint"), F.col(ident))
    return prints.groupBy("fingerprint").agg(F.min(ident).alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def uuid_v5(name: Column, namespace_hex: str = DNS_NAMESPACE) -> Column:
    """Name-based id: version and variant bits set in the SHA-1 of namespace and name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
                    F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID_FORM), F.lit(False))


def random_id(length: int | None = None) -> Column:
    """Random id; differs per run, so never part of a checked result."""
    return F.uuid() if length is None else F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, length)


# ---------------------------------------------------------------- versions


def parse_version(c: Column) -> Column:
    """All digit groups as (length, digits) without leading zeros; such arrays compare as versions do, at any length."""
    return F.transform(extract_numbers(c), lambda x: F.struct(F.length(x).alias("length"), x.alias("digits")))


def compare_versions(a: Column, b: Column) -> Column:
    x, y = parse_version(a), parse_version(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def is_compatible(current: Column, needed: Column) -> Column:
    return compare_versions(current, needed) >= 0
