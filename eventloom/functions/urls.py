"""Page addresses: http(s) check and normalisation.

Scheme and host are lower-cased, a default port is dropped, an empty path
becomes `/`, dot segments are resolved, unsafe characters percent-encoded and
numeric hosts written as dotted quads.  Internationalised host names are mapped and
written in Punycode by the JVM's own IDNA; only characters whose mapping differs
between IDNA versions (sharp s, final sigma, joiners) are refused.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.model import MAX_URL

_LABEL = r"[a-z0-9_-]+"
_TIDY = (
    rf"\Ahttps?://(?:{_LABEL}\.)*[a-z][a-z0-9_-]*"
    r"/(?!\.|.*/\.)[A-Za-z0-9/_~.-]*(?:\?[A-Za-z0-9=&_%.~+-]*)?\z"
)
_SCHEME = r"(?s)\A([A-Za-z][A-Za-z0-9+.-]*):.*"
_PARTS = r"(?s)\A(?i:https?|ftp):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?\z"
_AUTHORITY = r"(?s)\A(?:(.*)@)?(\[[0-9A-Fa-f:.]+\]|[^:@\[\]]+)(?::(\d*))?\z"
_HOST_OK = r"\A[!$&'()*+,;=a-z0-9._~\[\]:-]+\z"
_FOREIGN = r"[^\x00-\x7f]"
_DEVIATING = "[\u00df\u1e9e\u03c2\u200c\u200d]"
_NUMERIC_TAIL = r"(?:\A|\.)(?:\d+|0x[0-9a-f]*)\.?\z"
_DOT_SEGMENT = r"(?i)(?:\A|/)(?:\.|%2e){1,2}(?:/|\z)"
_USER_UNSAFE = r"""[^\x21-\x7e]|["<>`{}#?/:;=@\[\\\]^|]"""
_PATH_UNSAFE = r"""[^\x21-\x7e]|["<>`{}]"""
_QUERY_UNSAFE = r"""[^\x21-\x7e]|["<>']"""
_FRAGMENT_UNSAFE = r"""[^\x21-\x7e]|["<>`]"""


def with_url(df: DataFrame, text: str, output: str) -> DataFrame:
    """Add `output`, the normalised form of the address in column `text`, else null.

    Also adds `<output>_problem`, the error type of a refused address.  Tidy
    addresses pass as they are; the others are taken apart in one stage and put
    together in the next.
    """
    stages = _stages(text, output)
    for name, column in stages:
        df = df.withColumn(name, column)
    return df.drop("_url", "_authority", "_host", "_rebuilt")


@cache
def _stages(text: str, output: str) -> list[tuple[str, Column]]:
    given, parts, authority = F.col(text), F.col("_url"), F.col("_authority")
    taken_apart = F.struct(
        F.lower(F.regexp_extract(parts, _SCHEME, 1)).alias("scheme"),
        F.when(parts.rlike(_PARTS), F.regexp_extract(parts, _PARTS, 1)).alias("authority"),
        F.translate(F.regexp_extract(parts, _PARTS, 2), "\\", "/").alias("path"),
        F.regexp_extract(parts, _PARTS, 3).alias("query"),
        F.regexp_extract(parts, _PARTS, 4).alias("fragment"),
    )
    whole, peer_host = parts.authority, authority.host
    sender = F.regexp_extract(whole, _AUTHORITY, 1)
    name = _escaped(F.substring_index(sender, ":", 1), _USER_UNSAFE)
    secret = _escaped(F.regexp_extract(sender, r"(?s)\A[^:]*:(.*)\z", 1), _USER_UNSAFE)
    peer = F.struct(
        F.when(secret == "", name).otherwise(F.concat_ws(":", name, secret)).alias("user"),
        _host(F.lower(F.regexp_extract(whole, _AUTHORITY, 2))).alias("host"),
        F.regexp_extract(whole, _AUTHORITY, 3).alias("port"),
    )
    return [
        ("_url", F.when(given.isNotNull() & ~given.rlike(_TIDY), _cleaned(given))),
        ("_url", F.when(parts.isNotNull(), taken_apart)),
        ("_authority", F.when(whole.rlike(_AUTHORITY), peer)),
        ("_host", F.when(peer_host.rlike(_NUMERIC_TAIL), _ipv4(peer_host)).otherwise(peer_host)),
        ("_rebuilt", _rebuilt(parts, authority, F.col("_host"))),
        (output, F.when(parts.isNull(), given).when(parts.scheme != "ftp", F.col("_rebuilt"))),
        (f"{output}_problem", _problem(given, F.col(output), F.col("_rebuilt"), parts.scheme)),
    ]


def _problem(text: Column, output: Column, rebuilt: Column, scheme: Column) -> Column:
    """A scheme whose addresses have another form is refused for the scheme alone."""
    foreign = ~scheme.isin("", "http", "https", "ftp")
    return (
        F.when(F.length(text) > MAX_URL, "url_too_long")
        .when(text.isNull() | output.isNotNull(), F.lit(None).cast("string"))
        .when(foreign | rebuilt.isNotNull(), "url_scheme")
        .otherwise("url_parsing")
    )


def _cleaned(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")
    return F.regexp_replace(trimmed, r"[\t\n\r]", "")


def _host(text: Column) -> Column:
    decoded = F.lower(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))))
    plain = F.when(text.contains("%"), decoded).otherwise(text)
    # 1: also code points that were assigned after the tables of IDNA
    ascii_ = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), plain, F.lit(1))
    foreign = plain.rlike(_FOREIGN)
    return F.when(foreign & ~plain.rlike(_DEVIATING), F.lower(ascii_)).when(~foreign, plain)


def _ipv4(host: Column) -> Column:
    """Dotted quad of a host that ends in a number, null when it is no address.

    One to four numbers, decimal, octal (`0..`) or hexadecimal (`0x..`); the last
    one fills the bytes that the others leave.
    """
    texts = F.split(F.regexp_replace(host, r"\.\z", ""), r"\.")

    def number(part: Column) -> Column:
        return (
            F.when(part.rlike(r"\A0x[0-9a-f]*\z"), F.conv(F.concat(F.lit("0"), F.substring(part, 3, 99)), 16, 10))
            .when(part.rlike(r"\A0[0-7]+\z"), F.conv(part, 8, 10))
            .when(part.rlike(r"\A(?:0|[1-9]\d*)\z"), part)
            .try_cast("long")
        )

    numbers = F.transform(texts, number)
    leading = F.slice(numbers, F.lit(1), F.size(texts) - 1)
    last = F.element_at(numbers, -1)
    room = F.pow(F.lit(256.0), F.lit(5) - F.size(texts))
    valid = (
        (F.size(texts) <= 4)
        & F.forall(numbers, lambda n: n.isNotNull())
        & F.forall(leading, lambda n: n <= 255)
        & (last < room)
    )
    places = F.aggregate(
        leading,
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(1 << 24).cast("long").alias("unit")),
        lambda kept, n: F.struct(
            (kept.sum + n * kept.unit).alias("sum"), F.shiftright(kept.unit, 8).alias("unit")
        ),
    )
    address = places.getField("sum") + last
    quad = [F.shiftright(address, shift).bitwiseAND(F.lit(255)).cast("string") for shift in (24, 16, 8, 0)]
    return F.when(valid, F.concat_ws(".", *quad))


def _rebuilt(parts: Column, authority: Column, host: Column) -> Column:
    port = authority.port.try_cast("int")
    standard = F.when(parts.scheme == "http", 80).otherwise(443)
    valid = (
        host.rlike(_HOST_OK)
        & ((authority.port == "") | (port <= 65535))
    )
    path = F.when(parts.path.rlike(_DOT_SEGMENT), _resolved(parts.path)).otherwise(parts.path)
    return F.when(
        valid,
        F.concat(
            parts.scheme,
            F.lit("://"),
            F.when(authority.user == "", "").otherwise(F.concat(authority.user, F.lit("@"))),
            host,
            F.when((authority.port == "") | (port == standard), "").otherwise(
                F.concat(F.lit(":"), port.cast("string"))
            ),
            F.when(parts.path.startswith("/"), "").otherwise("/"),
            _escaped(path, _PATH_UNSAFE),
            _escaped(parts.query, _QUERY_UNSAFE),
            _escaped(parts.fragment, _FRAGMENT_UNSAFE),
        ),
    )


def _escaped(text: Column, unsafe: str) -> Column:
    def escape(char: Column) -> Column:
        encoded = F.when(char == " ", "%20").otherwise(F.url_encode(char))
        return F.when(char.rlike(unsafe), encoded).otherwise(char)

    return F.when(
        text.rlike(unsafe), F.array_join(F.transform(F.split(text, ""), escape), "")
    ).otherwise(text)


def _resolved(path: Column) -> Column:
    """Resolve `.` and `..` segments."""
    segments = F.split(F.regexp_replace(path, r"\A/", ""), "/")

    def is_dots(segment: Column, count: int) -> Column:
        return F.regexp_replace(segment, "(?i)%2e", ".") == "." * count

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(is_dots(segment, 1), kept)
            .when(is_dots(segment, 2), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .otherwise(F.concat(kept, F.array(segment)))
        )

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    last = F.element_at(segments, -1)
    closing = F.when(is_dots(last, 1) | is_dots(last, 2), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, closing), "/"))
