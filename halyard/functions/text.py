"""Text, code and identifier functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(F.trim(c)) > 0, c)


def patient_sex(c: Column) -> Column:
    """M... and F... in any case are M and F, other text is O, null stays null."""
    first = F.upper(F.substring(c, 1, 1))
    return F.when(c.isNotNull(), F.when(first.isin("M", "F"), first).otherwise("O"))


def valid_uid(c: Column) -> Column:
    """1 to 64 characters, digits in parts between single dots."""
    return F.coalesce(c.rlike(r"^[0-9]+(\.[0-9]+)*$") & (F.length(c) <= 64), F.lit(False))


def valid_aet(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)).between(1, 16), F.lit(False))


def valid_header(name: Column, value: Column) -> Column:
    """An HTTP header's name is a token and its value has no control characters."""
    return F.coalesce(name.rlike(r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+$") & ~value.rlike(r"[\x00-\x08\x0A-\x1F\x7F]"), F.lit(False))


def redact(name: Column, value: Column) -> Column:
    """Values of headers that carry credentials are not shown."""
    return F.when(name.rlike("(?i)authorization|cookie|token|secret|password|api-?key"), "***").otherwise(value)


def code_value(short: Column, long: Column, urn: Column) -> Column:
    """The first code that is not blank: short, long, URN."""
    return F.coalesce(blank_to_null(short), blank_to_null(long), blank_to_null(urn))


def instance_key(uid: Column, number: Column) -> Column:
    return F.concat_ws("?", uid, number.cast("string"))


def compression_rate(c: Column) -> Column:
    """A rate from 0 to 100; text that is no number gives 0."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(c.try_cast("int"), F.lit(0))))


def http_category(status: Column) -> Column:
    names = {1: "INFORMATIONAL", 2: "SUCCESS", 3: "REDIRECTION", 4: "CLIENT_ERROR", 5: "SERVER_ERROR"}
    out = F.lit("UNKNOWN")
    for k, v in names.items():
        out = F.when(F.floor(status / 100) == k, v).otherwise(out)
    return out


# fixed values: texts of HTTP statuses
HTTP_TEXTS = {
    200: "OK",
    201: "Created",
    202: "Accepted",
    204: "No Content",
    301: "Moved Permanently",
    302: "Found",
    304: "Not Modified",
    307: "Temporary Redirect",
    308: "Permanent Redirect",
    400: "Bad Request",
    401: "Unauthorized",
    403: "Forbidden",
    404: "Not Found",
    405: "Method Not Allowed",
    408: "Request Timeout",
    409: "Conflict",
    410: "Gone",
    413: "Payload Too Large",
    415: "Unsupported Media Type",
    422: "Unprocessable Entity",
    429: "Too Many Requests",
    500: "Internal Server Error",
    501: "Not Implemented",
    502: "Bad Gateway",
    503: "Service Unavailable",
    504: "Gateway Timeout",
    505: "HTTP Version Not Supported",
}


def http_text(status: Column) -> Column:
    texts = F.create_map(*[F.lit(x) for pair in HTTP_TEXTS.items() for x in pair])
    return F.coalesce(F.try_element_at(texts, status.cast("int")), F.lit("Unknown Status"))


def valid_port(c: Column) -> Column:
    return F.coalesce(c.try_cast("int").between(1, 65535), F.lit(False))


def tag_list(c: Column) -> Column:
    """Tags of a comma-separated list in decimal, hexadecimal (0x) or octal (0...); what is no number is dropped."""

    def number(x: Column) -> Column:
        t = F.trim(x)
        return (
            F.when(t.rlike("^0[xX][0-9a-fA-F]{1,8}$"), F.conv(F.substring(t, 3, 8), 16, 10).cast("long"))
            .when(t.rlike("^0[0-7]{1,11}$"), F.conv(t, 8, 10).cast("long"))
            .when(t.rlike("^(0|[1-9][0-9]{0,9})$"), t.cast("long"))
        )

    return F.array_compact(F.transform(F.split(c, ","), number))


_TEMPLATE = re.compile(r"\$V(?::f\$(?P<pattern>[^$]*)\$|:l\$(?P<most>\d+)\$)?")


def formatted(value: Column, template: str | None, decimal: bool = False) -> Column:
    """A display template, parsed once on the driver: $V is the value, $V:f$0.00$ a number with that many decimals (numbers only),
    $V:l$n$ at most n characters and then three dots.
    """
    if not template or not template.strip() or template == "$V":
        return value.cast("string")
    parts, at = [], 0
    for m in _TEMPLATE.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m["most"] is not None:
            n, text = int(m["most"]), value.cast("string")
            parts.append(F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text))
        elif m["pattern"] is not None and decimal:
            whole, _, fraction = m["pattern"].partition(".")
            fixed, optional = fraction.count("0"), fraction.count("#")
            text = F.format_string(f"%.{fixed + optional}f", value.cast("double"))
            if optional:
                text = F.regexp_replace(text, "0{1," + str(optional) + "}$", "")
                text = F.regexp_replace(text, r"\.$", "") if not fixed else text
            parts.append(text)
        else:
            parts.append(value.cast("string"))
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def xml_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def xml_attributes(pairs: dict[str, Column]) -> Column:
    """name="value" for each value that is not blank, in order, each after a space."""
    return F.concat(*(F.when(F.coalesce(F.length(F.trim(v)), F.lit(0)) > 0, F.concat(F.lit(f' {k}="'), xml_escape(v), F.lit('"'))).otherwise("") for k, v in pairs.items()))


def text_wildcard(c: Column, pattern: str) -> Column:
    """Matching with * and ? as archives do; without either, equality."""
    if "*" not in pattern and "?" not in pattern:
        return c == pattern
    rx = "".join(".*" if x == "*" else "." if x == "?" else re.escape(x) for x in pattern)
    return c.rlike(f"(?s)^{rx}$")
