"""Text, network-address, map and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])"
#: Dotted quad without leading zeros, each octet at most 255.
IPV4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ipv6_groups(ip) -> Column:
    """The eight groups of a valid IPv6 address, lower case; null for other text.

    A dotted quad may end the address, `::` may stand once for one or more zero
    groups, and a zone after `%` is ignored.
    """
    address = F.regexp_replace(F.lower(_col(ip)), "%[^%]+$", "")
    quad = F.split(F.substring_index(address, ":", -1), r"\.")
    octet = lambda i: F.get(quad, F.lit(i)).try_cast("int")
    pair = lambda i: F.lower(F.hex(octet(i) * 256 + octet(i + 1)))
    dotted = F.substring_index(address, ":", -1).rlike(IPV4_PATTERN)
    head = F.substring(address, F.lit(1), F.length(address) - F.length(F.substring_index(address, ":", -1)))
    plain = F.when(dotted, F.concat(head, pair(0), F.lit(":"), pair(2))).otherwise(address)
    groups = lambda part: F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))
    short = plain.contains("::")
    left = groups(F.when(short, F.substring_index(plain, "::", 1)).otherwise(plain))
    right = groups(F.when(short, F.substring_index(plain, "::", -1)).otherwise(F.lit("")))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    every = F.concat(left, F.when(short, zeros).otherwise(F.array().cast("array<string>")), right)
    once = F.length(plain) - F.length(F.replace(plain, F.lit("::"), F.lit(""))) <= 2
    sound = (plain.contains(":") & once & ~plain.contains(":::") & (F.size(every) == 8)
             & (~short | (F.size(left) + F.size(right) <= 7))
             & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$")))
    return F.when(sound, every)


def anonymize_ipv4(ip="ip_address") -> Column:
    """Zero the last octet of a valid IPv4 address, entirely inside the JVM."""
    ip = _col(ip)
    return F.when(ip.rlike(IPV4_PATTERN), F.regexp_replace(ip, r"\.[0-9]+$", ".0")).otherwise(ip)


def anonymize_ip(ip="ip_address") -> Column:
    """IPv4 to its /24 and IPv6 to its /48 network; invalid text is unchanged."""
    ip = _col(ip)
    kept = F.transform(F.slice(ipv6_groups(ip), 1, 3), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
    # Everything after the first three groups is zero, so the text ends in `::`, which takes in zeros before it.
    network = F.concat(F.regexp_replace(F.array_join(kept, ":"), "(^|:)0(:0)*$", ""), F.lit("::"))
    return F.when(ip.contains(":"), F.coalesce(network, ip)).otherwise(anonymize_ipv4(ip))


def valid_ip(ip="ip_address") -> Column:
    """Whether the text is an IPv4 or IPv6 address; null is allowed."""
    ip = _col(ip)
    return ip.isNull() | ip.rlike(IPV4_PATTERN) | ipv6_groups(ip).isNotNull()


def merge_maps(left, right, data_type: T.DataType) -> Column:
    """Recursive merge of two map or struct columns of one type; right wins.

    Maps of maps recurse over the declared type. A null side counts as empty.
    """
    left, right = _col(left), _col(right)
    if isinstance(data_type, T.MapType):
        nested = data_type.valueType
        def pick(_key, a, b):
            return merge_maps(a, b, nested)
        empty = F.create_map().cast(data_type)
        return F.map_zip_with(F.coalesce(left, empty), F.coalesce(right, empty), pick)
    if isinstance(data_type, T.StructType):
        fields = [merge_maps(left[f.name], right[f.name], f.dataType).alias(f.name)
                  for f in data_type.fields]
        return (F.when(left.isNull(), right).when(right.isNull(), left)
                .otherwise(F.struct(*fields)))
    return F.coalesce(right, left)


def unique_id() -> Column:
    """A random id per row; changes on every evaluation."""
    return F.expr("uuid()")


def stable_id(*parts) -> Column:
    """A reproducible id, safe under task retries."""
    return F.sha2(F.concat_ws("|", *[_col(p).cast("string") for p in parts]), 256)


def escape_html(text) -> Column:
    """Escape markup characters so that ids cannot inject into map popups."""
    out = _col(text)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"),
                      ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def yes_no(flag="is_anomalous") -> Column:
    return F.when(F.coalesce(_col(flag), F.lit(False)), "Yes").otherwise("No")


def fixed_decimals(number, places: int) -> Column:
    """Number with exactly ``places`` decimals and no digit grouping.

    ``format_number`` rounds the exact binary value, like C's printf; Java's
    own format string would round the shortest decimal text instead.
    """
    return F.call_function("format_number", _col(number), F.lit("0." + "0" * places))


def popup_text() -> Column:
    """One-line label of a scored login."""
    return F.concat(
        F.lit("User ID: "), escape_html("user_id"),
        F.lit("<br>Device ID: "), escape_html("device_id"),
        F.lit("<br>Timestamp: "), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"),
        F.lit("<br>Coordinates: ["), fixed_decimals("latitude", 5), F.lit(", "),
        fixed_decimals("longitude", 5),
        F.lit("]<br>Anomaly: "), yes_no(),
        F.lit("<br>Anomaly Score: "), fixed_decimals("anomaly_score", 4))
