"""URL splitting, resolution, canonical form and link filters as JVM-side column expressions.

`parse_url` is not used: it returns NULL for URLs browsers accept and its HOST drops the port.
A URL is split once into a struct<scheme, netloc, path, query>; the rules then work on the fields.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegraph.functions.html import SPACES, let

# RFC 3986 appendix B, and the lists that define which links are pages.
SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?.*\z"
PSEUDO_SCHEMES = ("mailto:", "tel:", "javascript:", "data:")
PAGE_SCHEMES = ("http", "https")
PARAM_SCHEMES = ("", "http", "https", "ftp")
ASSET_EXTENSIONS = (
    "pdf", "jpg", "jpeg", "png", "gif", "svg", "webp", "bmp", "tiff", "avif",
    "zip", "mp4", "css", "js", "ico", "xml", "json", "woff", "woff2", "ttf",
)
INFRA_PREFIXES = ("/cdn-cgi/", "/wp-json/", "/xmlrpc.php", "/feed")
ASSET_HINTS = ("css_combine", "js_combine", "css_cache", "js_cache", ".css?", ".js?", "ai_skin=")

_CONTROLS = "".join(map(chr, range(0x21)))
_REPEATED_SEGMENT = r"(^|/)([^/]++)(?:/\2(?=/|\z))++"
_DOT_SEGMENT = r"/\.\.?(?:/|\z)"
_PARAMS = r";[^/]*\z"


def any_of(tests: list[Column]) -> Column:
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return found


def clean(url: Column) -> Column:
    """Drop leading control characters and blanks, and tabs and line breaks anywhere."""
    return F.translate(F.ltrim(url, F.lit(_CONTROLS)), "\t\r\n", "")


def url_parts(url: Column) -> Column:
    """struct<scheme, netloc, path, query>; the scheme is lower-cased, the netloc kept as written.

    One regex match: the groups are written as lines, which a clean URL cannot contain.
    """
    groups = F.split(F.regexp_replace(clean(url), SPLIT, "$1\n$2\n$3\n$4"), "\n", -1)
    return let(groups, lambda g: _parts(F.lower(g[0]), g[1], g[2], g[3]))


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(clean(url), SPLIT, 2)


def url_fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)#(.*)\z", 1)


def _parts(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
    return F.struct(scheme.alias("scheme"), netloc.alias("netloc"), path.alias("path"), query.alias("query"))


def url_text(parts: Column, slashes: Column | None = None) -> Column:
    """Parts as text; the canonical form writes `://` even without a netloc."""
    mark = F.lit("://") if slashes is None else slashes
    tail = F.when(parts["query"] != "", F.concat(F.lit("?"), parts["query"])).otherwise(F.lit(""))
    return F.concat(parts["scheme"], mark, parts["netloc"], parts["path"], tail)


def bare_path(path: Column) -> Column:
    """Path without the `;params` of its last segment."""
    return F.when(path.contains(";"), F.regexp_replace(path, _PARAMS, "")).otherwise(path)


def _params(path: Column) -> Column:
    return F.when(path.contains(";"), F.nullif(F.regexp_extract(path, _PARAMS, 0), F.lit(";")))


def canonical_parts(p: Column) -> Column:
    """Canonical form: repeated neighbouring segments, trailing slashes, params and fragment go."""
    kept = F.when(p["scheme"].isin(*PARAM_SCHEMES), bare_path(p["path"])).otherwise(p["path"])
    kept = F.rtrim(F.regexp_replace(kept, _REPEATED_SEGMENT, "$1$2"), F.lit("/"))
    return _parts(p["scheme"], p["netloc"], kept, p["query"])


def normalize_url(url: Column) -> Column:
    return let(url_parts(url), lambda p: url_text(canonical_parts(p)))


def _fold_dots(path: Column) -> Column:
    segments = F.split(path, "/", -1)

    def step(done: Column, seg: Column) -> Column:
        parent = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(seg == "..", parent).when(seg == ".", done).otherwise(F.concat(done, F.array(seg)))

    folded = F.array_join(F.aggregate(segments, F.expr("cast(array() as array<string>)"), step), "/")
    # A final dot segment names a directory.
    return F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(folded, F.lit("/"))).otherwise(folded)


def _merge_paths(base: Column, path: Column) -> Column:
    """Path of a relative reference, `;params` of its last segment included."""
    own = bare_path(path)
    directory = let(bare_path(base), lambda b: F.left(b, F.length(b) - F.length(F.substring_index(b, "/", -1))))
    joined = F.when(path.startswith("/"), own).otherwise(
        F.regexp_replace(F.concat(F.lit("/"), directory, own), "/{2,}", "/")
    )
    folded = let(joined, lambda j: F.when(j.contains("/.") & j.rlike(_DOT_SEGMENT), _fold_dots(j)).otherwise(j))
    rooted = let(folded, lambda f: F.when(f.startswith("/"), f).otherwise(F.concat(F.lit("/"), f)))
    return F.concat(rooted, F.coalesce(_params(path), F.lit("")))


def resolved_parts(b: Column, h: Column) -> Column:
    """Parts of reference `h` resolved against page `b`, both given as parts; the page is http(s)."""
    absolute = ((h["scheme"] != "") & (h["scheme"] != b["scheme"])) | (h["netloc"] != "")
    scheme = F.when(h["scheme"] != "", h["scheme"]).otherwise(b["scheme"])
    same_page_query = F.when(h["query"] != "", h["query"]).otherwise(b["query"])
    return (
        F.when(absolute, _parts(scheme, h["netloc"], h["path"], h["query"]))
        .when(h["path"] == "", _parts(b["scheme"], b["netloc"], b["path"], same_page_query))
        .otherwise(_parts(b["scheme"], b["netloc"], _merge_paths(b["path"], h["path"]), h["query"]))
    )


def resolve_url(base: Column, href: Column) -> Column:
    """`href` resolved against the page URL `base`, without fragment."""
    return let(
        F.struct(url_parts(base).alias("b"), url_parts(href).alias("h")),
        lambda s: let(
            resolved_parts(s["b"], s["h"]),
            lambda p: url_text(p, F.when(p["netloc"] == "", F.lit(":")).otherwise(F.lit("://"))),
        ),
    )


def is_pseudo_link(href: Column) -> Column:
    return let(
        F.lower(F.ltrim(href, F.lit(SPACES))), lambda text: any_of([text.startswith(s) for s in PSEUDO_SCHEMES])
    )


def is_asset_path(path: Column) -> Column:
    last = F.substring_index(F.lower(path), ".", -1)
    return path.contains(".") & last.isin(*ASSET_EXTENSIONS)


def is_infra_path(path: Column) -> Column:
    return any_of([path.startswith(prefix) for prefix in INFRA_PREFIXES])


def has_asset_hint(url: Column) -> Column:
    return let(F.lower(url), lambda low: any_of([low.contains(hint) for hint in ASSET_HINTS]))


def has_asset_query(query: Column) -> Column:
    return query.contains(".") & F.lower(query).rlike(r"\.(?:" + "|".join(ASSET_EXTENSIONS) + ")")


def page_links(base: Column, hrefs: Column) -> Column:
    """Links of one page worth crawling, as array<struct<pos, url, host>> in document order.

    The whole chain stays on the page's array, so each step is evaluated once per link and only
    surviving links become rows.
    """
    numbered = F.transform(hrefs, lambda h, i: F.struct(i.alias("pos"), h.alias("href")))
    real = F.filter(numbered, lambda x: ~is_pseudo_link(x["href"]))
    split = F.transform(real, lambda x: F.struct(x["pos"].alias("pos"), url_parts(x["href"]).alias("p")))
    target = let(
        url_parts(base),
        lambda b: F.transform(
            split,
            lambda x: F.struct(
                x["pos"].alias("pos"), let(resolved_parts(b, x["p"]), canonical_parts).alias("p")
            ),
        ),
    )
    # Without a netloc the canonical text reads differently from its parts (`http:h/x`), so those
    # rare links are split again.
    located = F.transform(
        target,
        lambda x: F.struct(
            x["pos"].alias("pos"),
            url_text(x["p"]).alias("url"),
            F.when(x["p"]["netloc"] != "", x["p"]).otherwise(url_parts(url_text(x["p"]))).alias("p"),
        ),
    )
    pages = F.filter(
        located,
        lambda x: x["p"]["scheme"].isin(*PAGE_SCHEMES)
        & ~is_asset_path(bare_path(x["p"]["path"]))
        & ~is_infra_path(x["p"]["path"])
        & ~has_asset_hint(x["url"])
        & ~has_asset_query(x["p"]["query"]),
    )
    return F.transform(
        pages, lambda x: F.struct(x["pos"].alias("pos"), x["url"].alias("url"), x["p"]["netloc"].alias("host"))
    )
