"""URL handling as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# File names that stand for the folder itself, tried in order.
FOLDER_PAGES = [
    "/index.html", "/index.htm", "/index.cgi", "/index.xml", "/index.rxml", "/index.php",
    "/default.asp", "/index.asp", "/default.aspx", "/index.aspx", "/index.shtml",
]
NO_LINKS = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)"
ANCHOR = r"""(?is)<(?:a|area)(?=[\s/>])[^>]*?href=[ ]*(?:["'].*?["']|[^\s"'>]+)"""
HREF = r"""(?is)href=[ ]*(?:["'](.*?)["']|([^\s"'>]+))"""
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def host(url: Column) -> Column:
    """What stands between ``//`` and the next ``/``, ``?`` or ``#``."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def subdomain(url: Column) -> Column:
    """Labels of the host except the last two."""
    labels = F.split(host(url), r"\.")
    return F.array_join(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0))), ".")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def _dots_resolved(segments: Column) -> Column:
    """``.`` is skipped and ``..`` removes the segment before it."""
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        segments,
        none,
        lambda done, s: F.when(
            s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        )
        .when(s == ".", done)
        .otherwise(F.array_append(done, s)),
    )
    last_is_dots = F.element_at(segments, -1).isin(".", "..")
    joined = F.array_join(F.when(last_is_dots, F.array_append(kept, F.lit(""))).otherwise(kept), "/")
    return F.when(F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined))


def _merged(base: Column, link_path: Column) -> Column:
    """Segments of the base folder followed by those of a relative path.

    Only the first and the last segment may be empty.
    """
    folder = _let(
        F.split(path(base), "/"),
        lambda p: F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))),
    )
    return _let(
        F.concat(folder, F.split(link_path, "/")),
        lambda m: F.when(F.size(m) < 2, F.concat(F.array(F.lit("")), m)).otherwise(
            F.concat(
                F.slice(m, 1, 1),
                F.filter(F.slice(m, F.lit(2), F.greatest(F.size(m) - 2, F.lit(0))), lambda s: s != ""),
                F.slice(m, -1, 1),
            )
        ),
    )


def resolve(base: Column, link: Column) -> Column:
    """Absolute form of ``link`` as found on the page ``base``."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    link_path = F.regexp_extract(link, r"^([^?#]*)", 1)
    tail = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    has_dots = link.rlike(r"^([^?#]*/)?\.{1,2}(/|$|[?#])")
    absolute = F.when(has_dots, _let(F.split(link_path, "/"), _dots_resolved)).otherwise(link_path)
    return (
        F.when(link == "", base)
        .when(link.rlike(_SCHEME), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, absolute, tail))
        .when(F.startswith(link, F.lit("?")), F.concat(root, path(base), tail))
        .otherwise(F.concat(root, _let(_merged(base, link_path), _dots_resolved), tail))
    )


def _folder_page_length(lowered: Column) -> Column:
    cut = F.lit(0)
    for ending in reversed(FOLDER_PAGES):
        cut = F.when(F.endswith(lowered, F.lit(ending)), F.lit(len(ending))).otherwise(cut)
    return cut


def normal_form(url: Column) -> Column:
    """No ``../``, no slash after a bare host, no file name that means the folder."""
    without_slash = _let(
        F.replace(url, F.lit("../"), F.lit("")),
        lambda u: F.when(path(u) == "/", F.substring(u, F.lit(1), F.length(u) - 1)).otherwise(u),
    )
    return _let(
        without_slash,
        lambda u: F.substring(u, F.lit(1), F.length(u) - _let(F.lower(u), _folder_page_length)),
    )


def allowed(url: Column, allow: str | None, deny: str | None) -> Column:
    """The allow pattern must occur and the deny pattern must not; none means no demand."""
    ok = F.lit(True)
    if allow:
        ok = ok & url.rlike(allow)
    if deny:
        ok = ok & ~url.rlike(deny)
    return ok


def link_wanted(url: Column, restrict: bool, allow: str | None, deny: str | None) -> Column:
    """Like :func:`allowed` for links, except that without an allow pattern deny is not looked at."""
    if not restrict or not allow:
        return F.lit(True)
    return allowed(url, allow, deny)
