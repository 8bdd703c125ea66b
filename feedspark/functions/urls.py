"""URLs: resolution against a base, hosts, and percent-encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedspark.functions.binding import let
from feedspark.model import nonempty

_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_HIERARCHICAL = r"(?i)^(https?|ftp|wss?):"
# Characters a path, query or fragment keeps as they are (a character class).
_KEPT = r"\x21\x23-\x3b\x3d\x3f-\x7e"
# Characters a component encoding keeps besides letters and digits.
_COMPONENT_KEPT = "!'()*-._~"


def _hex(char: str) -> str:
    return f"%{ord(char):02X}"


def encode_component(value: Column) -> Column:
    """Percent-encode everything but letters, digits and ``! ' ( ) * - . _ ~``."""
    out = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for char in _COMPONENT_KEPT:
        out = F.replace(out, F.lit(_hex(char)), F.lit(char))
    return out


def _encode_non_ascii(url: Column) -> Column:
    """Percent-encode blanks, quotes, angle brackets and non-ASCII text, nothing else.

    The text is cut into runs of kept and of other characters; only the latter are encoded.
    """
    runs = F.regexp_extract_all(url, F.lit(f"([{_KEPT}]+|[^{_KEPT}]+)"))
    encoded = F.transform(
        runs,
        lambda r: F.when(r.rlike(f"^[{_KEPT}]"), r).otherwise(
            F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))
        ),
    )
    return F.when(url.rlike(f"[^{_KEPT}]"), F.array_join(encoded, "")).otherwise(url)


def _remove_dots(path: Column) -> Column:
    """Fold ``.`` and ``..`` segments of a path that starts with a slash."""

    def fold(segments: Column) -> Column:
        kept = F.aggregate(
            F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))),
            F.array().cast("array<string>"),
            lambda acc, seg: F.when(seg == ".", acc)
            .when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(seg))),
        )
        # A closing dot segment stands for the folder, so an empty last segment is added.
        closed = F.when(
            F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))
        ).otherwise(kept)
        return F.concat(F.lit("/"), F.array_join(closed, "/"))

    return F.when(path.rlike(r"/\.{1,2}(/|$)"), let(F.split(path, "/"), fold)).otherwise(path)


_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*://)([^/?#]*)([^?#]*)(.*)$"


def _normalize(url: Column) -> Column:
    """Lower-case scheme and host, drop a default port, give an empty path its slash."""
    scheme = F.lower(F.regexp_extract(url, _PARTS, 1))
    authority = F.regexp_extract(url, _PARTS, 2)
    user = F.regexp_extract(authority, r"^(.*@)", 1)
    host = F.lower(F.regexp_replace(authority, r"^.*@", ""))
    # The default ports of http and https go.
    site = F.regexp_replace(
        F.concat(scheme, user, host), r"^(http://.*):80$|^(https://.*):443$", "$1$2"
    )
    path = F.coalesce(nonempty(F.regexp_extract(url, _PARTS, 3)), F.lit("/"))
    rest = F.regexp_extract(url, _PARTS, 4)
    return F.concat(site, let(F.concat(_remove_dots(path), rest), _encode_non_ascii))


def _join(ref: Column, base: Column) -> Column:
    """The reference put in place of what it replaces in the base."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/(?:[^?#]*/)?)", 1)
    return (
        F.when(ref == "", F.regexp_replace(base, r"#.*$", ""))
        .when(ref.startswith("//"), F.concat(F.regexp_replace(base, r"//.*$", ""), ref))
        .when(ref.startswith("/"), F.concat(origin, ref))
        .when(ref.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), ref))
        .when(ref.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), ref))
        .otherwise(F.concat(F.coalesce(nonempty(folder), F.concat(origin, F.lit("/"))), ref))
    )


def resolve_url(href: Column, base: Column) -> Column:
    """Resolve a possibly relative link; a link that cannot be resolved stays as it is."""

    def resolve(ref: Column) -> Column:
        hierarchical = ref.rlike(_HIERARCHICAL + r"//[^/?#]")
        opaque = ref.rlike(_ABSOLUTE) & ~hierarchical
        rootless = ~base.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]")
        target = F.when(hierarchical, ref).otherwise(_join(ref, base))
        return (
            F.when(opaque, ref)
            .when(rootless & ~hierarchical, href)
            .otherwise(let(target, _normalize))
        )

    return let(F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\r\n]", ""), resolve)


def url_host(url: Column, port: bool = True) -> Column:
    """Host of a URL (with its port unless told otherwise), absent when there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, r"^.*@", ""))
    if not port:
        host = F.regexp_replace(host, r":\d*$", "")
    return nonempty(host)


def host_or_url(url: Column) -> Column:
    return F.coalesce(url_host(url), url)
