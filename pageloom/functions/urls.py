"""URL columns: parts, joining, admission to the crawl, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import bind, strip

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"

# Path endings that are never queued.
EXCLUDED_EXTENSIONS = (
    ".pdf", ".zip", ".exe", ".dmg", ".pkg", ".jpg", ".jpeg", ".png", ".gif",
    ".css", ".js", ".xml", ".rss",
)


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(url, _NETLOC, 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, _QUERY, 1)


def url_parts(url: Column) -> Column:
    """struct(scheme, netloc, path, query); a missing part is an empty string."""
    return F.struct(
        url_scheme(url).alias("scheme"),
        url_netloc(url).alias("netloc"),
        url_path(url).alias("path"),
        url_query(url).alias("query"),
    )


def valid_url(url: Column) -> Column:
    """http or https, with a host."""
    return F.coalesce(url_scheme(url).isin("http", "https") & (url_netloc(url) != ""), F.lit(False))


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


def link_base(url: Column) -> Column:
    """What joining needs of a page URL, as one struct to be computed once per page."""

    def base(parts: Column) -> Column:
        folder = F.split(parts["path"], "/")
        return F.struct(
            parts["scheme"].alias("scheme"),
            parts["netloc"].alias("netloc"),
            parts["path"].alias("path"),
            parts["query"].alias("query"),
            # The last segment is a file name unless it is empty.
            F.when(parts["path"].endswith("/") | (parts["path"] == ""), folder)
            .otherwise(F.slice(folder, F.lit(1), F.size(folder) - 1))
            .alias("folder"),
        )

    return bind(url_parts(url), base)


def _drop_dots(segments: Column) -> Column:
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(part == ".", done)
        .otherwise(F.array_append(done, part)),
    )
    # A path that ends in a dot segment names a folder.
    ended = F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.regexp_replace(F.array_join(ended, "/"), r"^(?!/)", "/")


def _unsplit(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
    def url(p: Column) -> Column:
        site = F.when(
            p["netloc"] != "",
            F.concat(
                F.lit("//"), p["netloc"],
                F.when((p["path"] != "") & ~p["path"].startswith("/"), F.lit("/")).otherwise(F.lit("")),
            ),
        ).otherwise(F.lit(""))
        asked = F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(F.lit(""))
        return F.concat(p["scheme"], F.lit(":"), site, p["path"], asked)

    parts = F.struct(scheme.alias("scheme"), netloc.alias("netloc"), path.alias("path"), query.alias("query"))
    return bind(parts, url)


def join_link(base: Column, href: Column) -> Column:
    """Absolute http(s) URL of a link on a page, without fragment; null if there is none.

    `base` is a link_base struct.
    """

    def hang(path: Column) -> Column:
        """A relative path in the page's folder; empty inner segments vanish."""
        return bind(
            F.concat(base["folder"], F.split(path, "/")),
            lambda all_: F.concat(
                F.slice(all_, 1, 1),
                F.filter(F.slice(all_, F.lit(2), F.greatest(F.size(all_) - 2, F.lit(0))), lambda s: s != ""),
                F.slice(all_, -1, 1),
            ),
        )

    def join(link: Column) -> Column:
        own, path = link["scheme"], link["path"]
        absolute = ((own != "") & (own != base["scheme"])) | (link["netloc"] != "")
        segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(hang(path))
        joined_path = (
            F.when(absolute, path)
            .when(path == "", base["path"])
            .when(path.startswith("/") & ~path.contains("/."), path)
            .otherwise(bind(segments, _drop_dots))
        )
        keeps_query = ~absolute & (path == "") & (link["query"] == "")
        return _unsplit(
            F.when(own == "", base["scheme"]).otherwise(own),
            F.when(absolute, link["netloc"]).otherwise(base["netloc"]),
            joined_path,
            F.when(keeps_query, base["query"]).otherwise(link["query"]),
        )

    def usable(link: Column) -> Column:
        scheme = F.when(link["scheme"] == "", base["scheme"]).otherwise(link["scheme"])
        # An unbalanced bracket in the host makes the link unreadable.
        balanced = link["netloc"].contains("[") == link["netloc"].contains("]")
        return scheme.isin("http", "https") & balanced

    text = F.regexp_replace(strip(href), r"[\t\r\n]", "")
    return bind(
        bind(text, url_parts), lambda link: F.when(usable(link), join(link))
    )


def resolve_link(base_url: Column, href: Column) -> Column:
    """join_link for a plain page URL."""
    return bind(link_base(base_url), lambda base: join_link(base, href))


def base_path(start_url: Column) -> Column:
    """The folder of a start URL, to which its crawl is confined."""
    return resolve_link(start_url, F.lit("."))


def url_site(url: Column) -> Column:
    """scheme://host:port."""
    return F.concat(url_scheme(url), F.lit("://"), url_netloc(url))


def queue_decision(url: Column, depth: Column, base: Column, max_depth: int, visited: Column | None = None) -> Column:
    """Why a link is not queued (first failing rule), or null if it is admitted."""
    endings = "|".join(ext.removeprefix(".") for ext in EXCLUDED_EXTENSIONS)
    excluded = url_path(url).rlike(rf"(?i)\.(?:{endings})$")
    seen = F.lit(False) if visited is None else visited
    return (
        F.when(seen, "visited")
        .when(depth > F.lit(max_depth), "too_deep")
        .when(~url.startswith(base), "outside_base")
        .when(~(url.startswith("http://") | url.startswith("https://")), "not_http")
        .when(excluded, "excluded_type")
    )


def repo_url(url: Column) -> Column:
    """struct(is_repo, owner, repo) of a URL on the code-hosting site."""
    parts = F.filter(F.split(url_path(url), "/"), lambda p: p != "")
    owner, repo, third = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    is_repo = F.coalesce(
        (F.lower(url_netloc(url)) == "github.com")
        & repo.isNotNull()
        & (owner != "topics")
        & (third.isNull() | third.isin("tree", "blob")),
        F.lit(False),
    )
    return F.struct(
        is_repo.alias("is_repo"), F.when(is_repo, owner).alias("owner"), F.when(is_repo, repo).alias("repo")
    )


def path_extension(path: Column) -> Column:
    """Lower-cased last extension with its dot; leading dots of a name do not count."""
    return F.lower(F.regexp_extract(path, r"(?:^|/)\.*[^./][^/]*?(\.[^./]*)$", 1))


def _safe(text: Column) -> Column:
    out = F.regexp_replace(text, r"^[a-zA-Z]+://", "")
    out = F.regexp_replace(out, r'[\\/*?:"<>|]+', "_")
    out = F.regexp_replace(out, r"[\s_]+", "_")
    return F.btrim(out, F.lit("_"))


def safe_file_part(text: Column, max_len: int = 180) -> Column:
    """Characters a file system refuses become underscores; cut at max_len."""
    return F.substring(_safe(text), 1, max_len)


def safe_topic_part(text: Column, max_len: int = 100) -> Column:
    """safe_file_part in lower case, `untitled` for an empty text."""
    return F.when(F.coalesce(text, F.lit("")) == "", "untitled").otherwise(F.lower(safe_file_part(text, max_len)))


def raw_file_name(url: Column, repo_path: Column | None = None) -> Column:
    """raw_{host}_{path}_{8 hex digits}{extension}.

    The readable part is cut first, so that the digits and the extension of a
    long name survive and two long names stay apart.
    """
    path = F.lit(None).cast("string") if repo_path is None else repo_path
    from_repo = F.coalesce(path, F.lit("")) != ""
    netloc = url_netloc(url)
    host = F.when(netloc == "", "no_domain").otherwise(F.translate(netloc, ":.", "__"))
    query = url_query(url)
    page = F.concat(url_path(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    page = F.btrim(page, F.lit("/"))
    slug = (
        F.when(from_repo, safe_file_part(F.btrim(path, F.lit("/"))))
        .when(page == "", "index")
        .otherwise(safe_file_part(page))
    )
    own = F.regexp_extract(path, r"(?:^|/)\.*[^./][^/]*?(\.[^./]*)$", 1)
    ext = F.when(~from_repo, ".html").when(own == "", ".md").otherwise(own)
    digits = F.substring(F.sha1(F.encode(F.when(from_repo, path).otherwise(url), "UTF-8")), 1, 8)
    readable = F.concat(F.lit("raw_"), host, F.lit("_"), slug)
    room = F.lit(180 - 9) - F.length(ext)
    return safe_file_part(F.concat(F.substring(readable, F.lit(1), room), F.lit("_"), digits, ext))


def document_file_name(topic: Column, domain: Column, extension: str = ".txt") -> Column:
    """{topic}_{domain}{extension}, at most 80 characters before the extension."""
    domain_part = safe_topic_part(F.replace(domain, F.lit(":"), F.lit("_")))
    name = F.substring(F.concat(safe_topic_part(topic), F.lit("_"), domain_part), 1, 80)
    name = F.btrim(F.regexp_replace(name, r"_+", "_"), F.lit("_"))
    spare = F.concat(F.lit("output_"), F.substring(F.sha1(F.encode(F.concat_ws("|", topic, domain), "UTF-8")), 1, 8))
    return F.concat(F.when(name == "", spare).otherwise(name), F.lit(extension))
