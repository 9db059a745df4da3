"""URL rules whose decisions reach the aliases of a page.

Nodes are canonical forms of URLs; edges are redirects (given as a table, or
meta refresh in the page) and canonical links in the page. Connected components
of the edges are pages that stand for each other. A URL's own rule decides; a
URL without a rule is allowed if any member of its component is explicitly
allowed, else blocked if any member is blocked, else allowed.

Defined results: a null URL, or one without ``://``, has empty host and path
and no alias; equal URLs share their verdict; null or empty pages give no
edges; a link to itself is no edge; an empty table gives no rows; other columns
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffspark.llm.components import connected_components
from tariffspark.llm.lookups import bounded
from tariffspark.llm.text import ascii_lower, free_names, whole
from tariffspark.session import materialize


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(whole(url), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(whole(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def without_dots(path: Column) -> Column:
    """``.`` and ``..`` segments taken out of an absolute path; ``..`` never climbs above the root."""
    start = F.array().cast("array<string>")
    kept = F.aggregate(F.split(path, "/", -1), start, lambda acc, part: F.when(part == ".", acc).when(
        part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(part))))
    closing = F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), closing)).otherwise(path)


def canonical(url: Column) -> Column:
    """Host, path and query without fragment, dot segments, default port, tracking parameters and closing slash; null without ``://``.

    The scheme is left out: a site answers for both.
    """
    rest = F.regexp_extract(whole(url), r"(?s)^.*?://[^/?#]*[^?#]*\??([^#]*)", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(rest, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|gclid|fbclid)="))), "&")
    place = F.concat(F.regexp_replace(host_of(url), ":(80|443)?$", ""), F.regexp_replace(without_dots(path_of(url)), "/+$", ""))
    return F.when(F.instr(whole(url), "://") > 0, F.when(query == "", place).otherwise(F.concat(place, F.lit("?"), query)))


def resolved(link: Column, url: Column) -> Column:
    """``link`` as seen from ``url``, as RFC 3986 resolves references, without its fragment.

    Null for a link that is empty or only a fragment (the page itself), for one
    of another scheme than ``x://`` and for a relative one from a URL without ``://``.
    """
    scheme = F.regexp_extract(whole(url), r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(whole(url), r"(?s)^(.*?://[^/?#]*)", 1)
    page = path_of(url)
    folder = F.when(page == "", F.lit("/")).otherwise(F.regexp_extract(page, r"(?s)^(.*/)", 1))
    reference = F.regexp_extract(link, r"(?s)^([^#]*)", 1)
    own, query = F.regexp_extract(reference, r"(?s)^([^?]*)", 1), F.regexp_extract(reference, r"(?s)^[^?]*(.*)$", 1)
    absolute = F.when(reference.startswith("//"), F.concat(scheme, F.lit(":"), reference)).otherwise(reference)
    site, place = F.regexp_extract(absolute, r"(?s)^(.*?://[^/?]*)", 1), F.regexp_extract(absolute, r"(?s)^.*?://[^/?]*([^?]*)", 1)
    relative = (F.when(own == "", page).when(own.startswith("/"), without_dots(own)).otherwise(without_dots(F.concat(folder, own))))
    has_scheme = reference.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return (F.when((reference == "") | (has_scheme & ~reference.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")), None)
            .when(has_scheme | (reference.startswith("//") & (root != "")), F.concat(site, without_dots(place), query))
            .when(root != "", F.concat(root, relative, query)))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, quoted or not, with ``&`` decoded; empty if absent."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.trim(F.regexp_replace(value, r"(?i)&(?:amp|#0*38|#x0*26);", "&"), F.lit(" \t\n\f\r"))


def page_links(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(source, target) URLs of canonical links and meta refreshes, outside comments and scripts."""
    html = F.regexp_replace(whole(F.col(html_column)), r"(?is)<!--.*?-->|<script\b.*?</script\s*>", " ")
    marks = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    tags = pages.select(F.col(url_column).alias("source"), F.explode(marks).alias("tag"))
    tag = F.col("tag")
    refresh = F.regexp_extract(attribute(tag, "content"), r"""(?is)^[^"']*?\burl\s*=\s*["']?\s*([^"'\s]+)""", 1)
    is_canonical = tag.rlike("(?i)^<link") & F.array_contains(F.split(F.lower(attribute(tag, "rel")), r"\s+"), "canonical")
    is_refresh = tag.rlike("(?i)^<meta") & (F.lower(attribute(tag, "http-equiv")) == "refresh")
    target = F.when(is_canonical, attribute(tag, "href")).when(is_refresh, refresh)
    return tags.select("source", resolved(target, F.col("source")).alias("target")).where("target is not null and source is not null")


def ruled(places: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``places(host, path)`` with ``rule`` and ``own``, the longest fitting of ``rules`` (host, path, verdict) and its verdict.

    Each place is looked up under its host and parent domains, once for every
    length that the rules of that domain have. Rules are a list of the caller,
    so their table is as small as the list.
    """
    spark = places.sparkSession
    table = spark.createDataFrame([(h, p, v) for h, p, v in rules], "r_host string, r_path string, verdict string").distinct()
    lengths = table.groupBy("r_host").agg(F.array_sort(F.collect_set(F.length("r_path"))).alias("lengths"))
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = (places.select("host", "path", F.explode(domains).alias("r_host")).join(bounded(lengths), "r_host")
             .select("host", "path", "r_host", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
             .withColumn("r_path", F.expr("substring(path, 1, n)")).join(bounded(table), ["r_host", "r_path"]))
    # The longest rule wins; of two verdicts for one rule allow, which sorts first, is taken.
    best = found.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("verdict").alias("own")),
                                                    F.struct(F.length("r_host") + F.length("r_path"), F.col("verdict") == "allow")).alias("b"))
    return best.select("host", "path", "b.rule", "b.own")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, url_column: str = "url",
               html_column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default all) with struct ``judged``: host, path, rule, verdict.

    ``redirects(source, target)`` are URLs as a crawl logged them.
    """
    keep = pages.columns if keep is None else keep
    links = page_links(pages, url_column, html_column)
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    links = materialize(links.distinct(), "url-links")
    ends = links.select("source").union(links.select("target")).union(pages.select(F.col(url_column))).toDF("url").where("url is not null").distinct()
    places = ends.select("url", canonical(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    places = materialize(places, "url-places")
    own = materialize(ruled(places.select("host", "path").distinct(), rules), "url-rules")
    edges = links.select(canonical(F.col("source")).alias("u"), canonical(F.col("target")).alias("v"))
    groups = materialize(connected_components(edges, "url-groups"), "url-groups")
    at = (places.join(own, ["host", "path"], "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
    out, place, verdict = free_names(pages.columns, "judged", "__url", "__verdict")
    passed = (at.where("own is not null and component is not null").groupBy("component")
              .agg(F.min("own").alias("passed")))  # allow sorts before block
    decided = at.join(passed, "component", "left").select(
        F.col("url").alias(place), F.struct("rule", F.coalesce("own", "passed", F.lit("allow")).alias("verdict")).alias(verdict))
    url = F.col(f"`{url_column}`")
    met = pages.select(*dict.fromkeys([*[f"`{c}`" for c in keep], f"`{url_column}`"])).join(decided, url == F.col(place), "left")
    struct = F.struct(host_of(url).alias("host"), path_of(url).alias("path"), F.col(verdict)["rule"].alias("rule"), F.coalesce(F.col(verdict)["verdict"], F.lit("allow")).alias("verdict"))
    return met.select(*[f"`{c}`" for c in keep], struct.alias(out))
