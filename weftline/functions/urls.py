"""URL resolution, directories and encoding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.text import trim_white

# Link schemes that lead to no page.
UNUSABLE_SCHEMES = ("mailto:", "javascript:", "tel:")

_REFERENCE_JUNK = r"[\t\n\r]"
_CONTROL_EDGE = r"^[\x00-\x20]+|[\x00-\x20]+$"
# characters that a serialized path or query carries percent-encoded
_PATH_UNSAFE = r"""[^\x21\x24-\x3b\x3d\x40-\x5f\x61-\x7a\x7c\x7e]"""
_QUERY_UNSAFE = r"""[^\x21\x24-\x26\x28-\x3b\x3d\x3f-\x7e]"""


def usable_href(href: Column) -> Column:
    """False for empty links and for the schemes above (compared case-sensitively)."""
    h = trim_white(href)
    bad = F.lit(False)
    for scheme in UNUSABLE_SCHEMES:
        bad = bad | h.startswith(scheme)
    return F.coalesce((h != "") & ~bad, F.lit(False))


def _percent_encode(text: Column, unsafe: str) -> Column:
    def one(char: Column) -> Column:
        return F.when(
            char.rlike(unsafe), F.regexp_replace(F.hex(F.encode(char, "UTF-8")), "(..)", "%$1")
        ).otherwise(char)

    chars = F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))
    return F.when(text.rlike(unsafe), F.array_join(F.transform(chars, one), "")).otherwise(text)


def _normal_path(path: Column) -> Column:
    """Fold ``.`` and ``..`` segments; the result starts with a slash."""
    dot, dots = r"(?i)^(?:\.|%2e)$", r"(?i)^(?:\.|%2e){2}$"
    clean = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^/", "")
    segments = F.split(clean, "/", -1)
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s.rlike(dot), done)
        .when(s.rlike(dots), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(s))),
    )
    last = F.element_at(segments, -1)
    ends_open = last.rlike(dot) | last.rlike(dots)
    closed = F.when(ends_open, F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    plain = F.concat(F.lit("/"), clean)
    # paths without dot segments, nearly all of them, skip the fold
    return F.when(
        clean.rlike(r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|$)"), F.concat(F.lit("/"), F.array_join(closed, "/"))
    ).otherwise(plain)


# The parameters of Punycode (RFC 3492)
_BASE, _TMIN, _TMAX, _SKEW, _DAMP, _FIRST_BIAS, _FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _bias(delta: Column, points: Column, first: Column) -> Column:
    """The bias for the next number, from the one just written."""
    halved = F.when(first, F.floor(delta / _DAMP)).otherwise(F.floor(delta / 2))
    start = F.struct((halved + F.floor(halved / points)).alias("d"), F.lit(0).cast("long").alias("k"))
    # code points are below 2^21 and labels short: six divisions are more than any number needs
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(6)), start,
        lambda s, _: F.when(s["d"] > (_BASE - _TMIN) * _TMAX // 2, F.struct(F.floor(s["d"] / (_BASE - _TMIN)).alias("d"), (s["k"] + _BASE).alias("k"))).otherwise(s),
    )
    return done["k"] + F.floor((_BASE - _TMIN + 1) * done["d"] / (done["d"] + _SKEW))


def _number(delta: Column, bias: Column) -> Column:
    """A number as digits of falling weight, each with its own threshold."""

    def digit(value: Column) -> Column:
        return F.substring(F.lit(_DIGITS), value.cast("int") + 1, F.lit(1))

    def step(s: Column, n: Column) -> Column:
        t = F.greatest(F.lit(_TMIN).cast("long"), F.least(F.lit(_TMAX).cast("long"), n * _BASE - bias))
        more = F.struct(
            F.concat(s["text"], digit(t + (s["q"] - t) % (_BASE - t))).alias("text"), F.floor((s["q"] - t) / (_BASE - t)).alias("q"), F.lit(False).alias("done")
        )
        last = F.struct(F.concat(s["text"], digit(s["q"])).alias("text"), s["q"].alias("q"), F.lit(True).alias("done"))
        return F.when(s["done"], s).when(s["q"] < t, last).otherwise(more)

    start = F.struct(F.lit("").alias("text"), delta.cast("long").alias("q"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(14).cast("long")), start, step)["text"]


def punycode(label: Column) -> Column:
    """A label with non-ASCII characters as RFC 3492 writes it: a fold over its code points, smallest first."""
    codes = F.transform(F.regexp_extract_all(label, F.lit("(?s)(.)"), F.lit(1)), lambda c: F.ascii(c).cast("long"))
    plain = F.regexp_replace(label, r"[^\x00-\x7f]", "")
    higher = F.array_sort(F.array_distinct(F.filter(codes, lambda c: c >= _FIRST_CODE)))
    zero = F.lit(0).cast("long")

    def state(text, delta, bias, handled, code) -> Column:
        return F.struct(
            text.alias("text"), delta.cast("long").alias("delta"), bias.cast("long").alias("bias"), handled.cast("long").alias("handled"), code.cast("long").alias("code")
        )

    def of_code(s: Column, code: Column) -> Column:
        def of_place(t: Column, c: Column) -> Column:
            written = state(
                F.concat(t["text"], _number(t["delta"], t["bias"])), zero,
                _bias(t["delta"], t["handled"] + 1, t["handled"] == F.length(plain)), t["handled"] + 1, t["code"],
            )
            passed = state(t["text"], t["delta"] + 1, t["bias"], t["handled"], t["code"])
            return F.when(c < code, passed).when(c == code, written).otherwise(t)

        moved = state(s["text"], s["delta"] + (code - s["code"]) * (s["handled"] + 1), s["bias"], s["handled"], code)
        return F.aggregate(codes, moved, of_place, lambda t: state(t["text"], t["delta"] + 1, t["bias"], t["handled"], t["code"] + 1))

    begin = state(
        F.when(plain == "", F.lit("")).otherwise(F.concat(plain, F.lit("-"))), zero, F.lit(_FIRST_BIAS), F.length(plain), F.lit(_FIRST_CODE)
    )
    return F.aggregate(higher, begin, of_code, lambda s: s["text"])


def ascii_host(host: Column) -> Column:
    """A lower-case host with its non-ASCII labels in Punycode; ideographic full stops separate labels too."""
    labels = F.split(F.regexp_replace(host, r"[\x{3002}\x{ff0e}\x{ff61}]", "."), r"\.", -1)
    known = F.transform(labels, lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), F.concat(F.lit("xn--"), punycode(x))).otherwise(x))
    return F.when(host.rlike(r"[^\x00-\x7f]"), F.array_join(known, ".")).otherwise(host)


def _let(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that are computed exactly once, however often later steps use them."""
    fields = F.struct(*[value.alias(name) for name, value in values.items()])
    return df.select("*", F.inline(F.array(fields)))


def with_resolved(links: DataFrame, href: str, base: str, name: str) -> DataFrame:
    """Add ``name``: the absolute form of ``href`` as found on page ``base``, without fragment.

    Host lower-cased and in Punycode where it isn't ASCII, default ports dropped, dot segments folded, unsafe
    characters percent-encoded. Rows without a valid http(s) URL are dropped.
    """
    trimmed = F.regexp_replace(F.regexp_replace(href, _CONTROL_EDGE, ""), _REFERENCE_JUNK, "")
    split_base = r"(?s)^([A-Za-z]+)://([^/?]*)([^?]*)(.*)$"
    page = F.regexp_replace(base, "(?s)#.*$", "")
    out = _let(links, _h=F.regexp_replace(trimmed, "(?s)#.*$", ""), _b=page)
    out = _let(
        out,
        _base_scheme=F.lower(F.regexp_extract("_b", split_base, 1)),
        _base_authority=F.regexp_extract("_b", split_base, 2),
        _base_path=F.regexp_extract("_b", split_base, 3),
        _base_query=F.regexp_extract("_b", split_base, 4),
        _scheme=F.lower(F.regexp_extract("_h", r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)),
        _after=F.regexp_replace("_h", r"^[A-Za-z][A-Za-z0-9+.\-]*:", ""),
    )
    # "https:path" on an https page is a relative link
    relative = (F.col("_scheme") == F.col("_base_scheme")) & ~F.col("_after").rlike(r"^[/\\]{2}")
    absolute = (F.col("_scheme") != "") & ~relative
    out = _let(out, _absolute=absolute, _ref=F.when(absolute | relative, F.col("_after")).otherwise(F.col("_h")))
    own = F.col("_absolute") | F.col("_ref").rlike(r"^[/\\]{2}")
    out = _let(out, _own=own, _rest=F.when(own, F.regexp_replace("_ref", r"^[/\\]+", "")).otherwise(F.col("_ref")))
    split_rest = r"(?s)^([^/\\?]*)([^?]*)(.*)$"
    out = _let(
        out,
        _authority=F.when(F.col("_own"), F.regexp_extract("_rest", split_rest, 1)).otherwise(F.col("_base_authority")),
        _tail=F.when(F.col("_own"), F.regexp_extract("_rest", split_rest, 2)).otherwise(
            F.regexp_replace("_rest", r"(?s)\?.*$", "")
        ),
        _query=F.regexp_extract("_rest", r"(?s)^[^?]*(\?.*)$", 1),
    )
    directory = F.regexp_replace("_base_path", "[^/]*$", "")
    out = _let(
        out,
        _out_scheme=F.when(F.col("_absolute"), F.col("_scheme")).otherwise(F.col("_base_scheme")),
        _path=F.when(F.col("_own") | F.col("_tail").rlike(r"^[/\\]"), F.col("_tail"))
        .when(F.col("_tail") == "", F.col("_base_path"))
        .otherwise(F.concat(F.when(directory == "", F.lit("/")).otherwise(directory), "_tail")),
        _out_query=F.when(~F.col("_own") & (F.col("_rest") == ""), F.col("_base_query"))
        .when(F.col("_query") == "?", F.lit(""))
        .otherwise(F.col("_query")),
        _login=F.regexp_extract("_authority", "^(.*@)", 1),
        _named=F.regexp_extract("_authority", r"^(?:.*@)?([^:@]*)", 1),
        _port=F.regexp_extract("_authority", r"^(?:.*@)?[^:@]*:([0-9]*)$", 1).try_cast("long"),
    )
    # percent-encoded characters of a host stand for themselves; what they decode to must be a valid host again
    plain = F.when(F.col("_named").contains("%"), F.expr("try_url_decode(replace(_named, '+', '%2B'))")).otherwise(F.col("_named"))
    out = _let(out, _lower=F.lower(plain))
    out = _let(out, _host=ascii_host(F.col("_lower")))
    bad_port = F.col("_authority").rlike(r":[0-9]*[^0-9@][^@]*$") | (F.coalesce("_port", F.lit(0)) > 65535)
    valid = (
        F.col("_out_scheme").isin("http", "https")
        & F.col("_host").rlike(r"^[a-z0-9._~!$&'()*+,;=\-]+$")
        & ~bad_port
    )
    default_port = F.when(F.col("_out_scheme") == "https", F.lit(443)).otherwise(F.lit(80))
    port = F.when(F.col("_port").isNull() | (F.col("_port") == default_port), F.lit("")).otherwise(
        F.concat(F.lit(":"), F.col("_port").cast("string"))
    )
    path = _percent_encode(_normal_path(F.col("_path")), _PATH_UNSAFE)
    query = _percent_encode(F.col("_out_query"), _QUERY_UNSAFE)
    url = F.concat("_out_scheme", F.lit("://"), "_login", "_host", port, path, query)
    found = F.when(valid, F.array(url)).otherwise(F.array().cast("array<string>"))
    return out.select(*links.columns, F.explode(found).alias(name))


def directory_prefix(url: Column) -> Column:
    """Origin and directory of a URL: everything up to the last slash of its path."""
    return F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]+/(?:[^?#]*/)?)", 1)


def encode_component(text: Column) -> Column:
    """Percent-encode all but letters, digits and ``- _ . ! ~ * ' ( )``."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def last_part(url: Column) -> Column:
    """Text after the last slash."""
    return F.element_at(F.split(url, "/", -1), -1)
