"""URL functions as Spark columns, each with the same rule in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scheme, host (a port is left out), path, query with its mark, fragment with its mark.
URL = r"(?i)^\s*(?:([a-z][a-z0-9+.-]*)://|//)?((?:[\w-]+\.)+[a-z]{2,})(?::\d+)?(/[^?#\s]*)?(\?[^#\s]*)?(#\S*)?\s*$"
ARCHIVE = r"(?i)^https?://web\.archive\.org/web/\d+[a-z_]*/(.+)$"
#: Paths that carry no document of their own.
IGNORED = ("/login", "/wp-login.php", "/signup", "/cart", "/feed/", "/tag/", "/share?", "/print/", "/wp-json/", "/xmlrpc.php")


def split_url(url: Column) -> Column:
    """``protocol`` (https if absent), ``domain``, ``page``, ``params`` and ``anchor``; null if it isn't a URL."""
    group = lambda i: F.regexp_extract(url, URL, i)
    parts = F.struct(
        F.when(group(1) == "", "https").otherwise(F.lower(group(1))).alias("protocol"),
        F.lower(group(2)).alias("domain"),
        group(3).alias("page"),
        group(4).alias("params"),
        group(5).alias("anchor"),
    )
    return F.when(url.rlike(URL), parts)


def remove_www(domain: Column) -> Column:
    """The domain less a leading ``www.``; the letters alone are never stripped."""
    return F.regexp_replace(domain, r"^www\.", "")


def unwrap_archive(url: Column) -> Column:
    """The archived page's own URL, or the URL itself."""
    return F.when(url.rlike(ARCHIVE), F.regexp_extract(url, ARCHIVE, 1)).otherwise(url)


def radical(url: Column) -> Column:
    """The URL before its anchor, if there is something on both sides of the mark."""
    return F.when(url.rlike("^[^#]+#.+$"), F.regexp_extract(url, "^([^#]+)#", 1)).otherwise(url)


def contains_any(text: Column, needles: Iterable[str] | str) -> Column:
    """Whether the text holds any of the strings; an empty string is in all."""
    found = [needles] if isinstance(needles, str) else list(needles)
    if not all(isinstance(x, str) for x in found):
        raise TypeError("a string or strings are needed")
    out = F.lit(False)
    for x in found:
        out = out | F.contains(text, F.lit(x))
    return F.coalesce(out, F.lit(False))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.transform(F.array(value), use)[0]


def canonical_url(url: Column, keep_params: bool = False, ignored: Iterable[str] = IGNORED, keep_www: bool = False) -> Column:
    """The address by which copies of a page are recognised; null if ignored or malformed.

    Archive wrappers, final slashes, ports, ``www.`` (unless kept), mobile
    hosts of the encyclopaedia, parameters (unless kept, or a language or
    video choice) and anchors (unless a page number) go. An address with a
    virtual path after ``/#/`` is kept whole, as it stands.
    """

    def build(p: Column) -> Column:
        domain = F.regexp_replace(p["domain"] if keep_www else remove_www(p["domain"]), r"\.m\.wikipedia\.org$", ".wikipedia.org")
        params = F.when(F.lit(keep_params) | p["params"].rlike(r"^\?(lang|v)="), p["params"]).otherwise("")
        anchor = F.when(p["anchor"].startswith("#page="), p["anchor"]).otherwise("")
        return F.concat(p["protocol"], F.lit("://"), domain, F.regexp_replace(p["page"], "/+$", ""), params, anchor)

    def clean(inner: Column) -> Column:
        built = _let(split_url(inner), build)
        return F.when(inner.rlike(URL), F.when(F.contains(inner, F.lit("/#/")), F.trim(url)).otherwise(built))

    out = _let(F.regexp_replace(unwrap_archive(F.trim(url)), "/+$", ""), clean)
    return F.when(~contains_any(url, ignored), out)


def domain_of(url: Column) -> Column:
    """The host without ``www.``."""
    return remove_www(split_url(url)["domain"])


def absolute(link: Column, base: Column) -> Column:
    """A link resolved against the page's URL for the usual forms.

    With a scheme as it is; ``//host`` takes the base's scheme, ``/path`` its
    host, ``?query`` and ``#anchor`` its page, all else its folder; segments
    of one and two dots are resolved.
    """
    b = split_url(base)
    root = F.concat(b["protocol"], F.lit("://"), b["domain"])
    folder = F.regexp_replace(F.when(b["page"] == "", "/").otherwise(b["page"]), "[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(b["protocol"], F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, _undotted(link)))
        .when(link.startswith("?"), F.concat(root, b["page"], link))
        .when(link.startswith("#"), F.concat(root, b["page"], b["params"], link))
        .when(link == "", base)
        .otherwise(F.concat(root, _undotted(F.concat(folder, link))))
    )


def _undotted(path: Column) -> Column:
    """A path without segments of one or two dots; what follows ``?`` or ``#`` stays."""
    head, rest = F.regexp_extract(path, r"^([^?#]*)", 1), F.regexp_extract(path, r"([?#].*)$", 1)
    parts = F.split(head, "/")
    step = lambda kept, x: F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(x == ".", kept).otherwise(F.array_append(kept, x))
    kept = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    closed = F.when(head.rlike(r"/\.\.?$"), F.concat(F.regexp_replace(kept, "/$", ""), F.lit("/"))).otherwise(kept)
    return F.when(head.rlike(r"(^|/)\.\.?(/|$)"), F.concat(closed, rest)).otherwise(path)


def sql_absolute(link: str, base: str) -> str:
    """:func:`absolute` as a DuckDB expression, for links without dotted segments."""
    b = sql_split(base)
    root = f"({b['protocol']} || '://' || {b['domain']})"
    folder = f"regexp_replace(CASE WHEN {b['page']} = '' THEN '/' ELSE {b['page']} END, '[^/]*$', '')"
    return (
        f"CASE WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {link} WHEN starts_with({link}, '//') THEN {b['protocol']} || ':' || {link} WHEN starts_with({link}, '/') THEN {root} || {link} "
        f"WHEN starts_with({link}, '?') THEN {root} || {b['page']} || {link} WHEN starts_with({link}, '#') THEN {root} || {b['page']} || {b['params']} || {link} WHEN {link} = '' THEN {base} ELSE {root} || {folder} || {link} END"
    )


def sql_split(url: str) -> dict[str, str]:
    """The parts of :func:`split_url` as DuckDB expressions."""
    pattern = URL.replace("'", "''")
    get = lambda i: f"regexp_extract({url}, '{pattern}', {i})"
    return {
        "ok": f"regexp_matches({url}, '{pattern}')",
        "protocol": f"CASE WHEN {get(1)} = '' THEN 'https' ELSE lower({get(1)}) END",
        "domain": f"lower({get(2)})",
        "page": get(3),
        "params": get(4),
        "anchor": get(5),
    }


def sql_canonical(url: str) -> str:
    """:func:`canonical_url` as a DuckDB expression."""
    inner = f"rtrim(CASE WHEN regexp_matches(trim({url}), '{ARCHIVE}') THEN regexp_extract(trim({url}), '{ARCHIVE}', 1) ELSE trim({url}) END, '/')"
    p = sql_split(inner)
    domain = rf"regexp_replace(regexp_replace({p['domain']}, '^www\.', ''), '\.m\.wikipedia\.org$', '.wikipedia.org')"
    built = rf"{p['protocol']} || '://' || {domain} || rtrim({p['page']}, '/') || CASE WHEN regexp_matches({p['params']}, '^\?(lang|v)=') THEN {p['params']} ELSE '' END || CASE WHEN starts_with({p['anchor']}, '#page=') THEN {p['anchor']} ELSE '' END"
    no = " OR ".join(f"contains({url}, '{x}')" for x in IGNORED)
    return f"CASE WHEN {p['ok']} AND NOT ({no}) THEN CASE WHEN contains({inner}, '/#/') THEN trim({url}) ELSE {built} END END"
