"""Incremental document crawls: discovery, link scans, and the state of each address after its fetches."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillspark.functions.text import drop_title_suffix, in_domain, safe_filename, url_basename, url_host, url_path
from quillspark.schemas import MANIFEST, MANIFEST_FIELDS
from quillspark.util import cut

# Fixed value: a link to a PDF.
PDF_LINK = r"(?i)\.pdf(?:[?#]|$)"


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("hrefs", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]))
def scan_page(pages: pd.Series) -> pd.DataFrame:
    """Title and links of an HTML page, and what was wrong with it. An Arrow function, as HTML needs a parser."""

    class Scan(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.title, self.inside, self.links = "", False, []

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "title"
            if tag == "a" and (link := dict(attrs).get("href")):
                self.links.append(link)

        def handle_endtag(self, tag):
            self.inside = self.inside and tag != "title"

        def handle_data(self, data):
            if self.inside:
                self.title += data

    rows = []
    for page in pages:
        scan, error = Scan(), None
        try:
            scan.feed(page or "")
        except Exception as problem:  # a broken page has what was read of it, and the others go on
            error = str(problem) or type(problem).__name__
        rows.append((scan.title.strip(), scan.links, error))
    return pd.DataFrame(rows, columns=["title", "hrefs", "error"])


@F.pandas_udf(T.StringType())
def resolve_link(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link as an absolute address; null if it can't be one."""

    def join(b: str | None, h: str | None) -> str | None:
        try:
            return urljoin(b, h) if b and h else None
        except ValueError:
            return None

    return pd.Series([join(b, h) for b, h in zip(base, link)], dtype=object)


def discover_pdfs(pages: DataFrame, title_filter: Column | None = None, domain: str | None = None) -> DataFrame:
    """(page_url, title, pdf_url) of each PDF link of pages (page_url, html) whose title fits, in ``domain``."""
    seen = pages.select("page_url", scan_page("html").alias("s")).select("page_url", F.col("s.title").alias("title"), F.col("s.hrefs").alias("hrefs"))
    if title_filter is not None:
        seen = seen.where(title_filter)  # before links are resolved, as that costs more
    links = seen.select("page_url", "title", F.explode("hrefs").alias("href")).where(F.col("href").rlike(PDF_LINK))
    found = links.select("page_url", "title", resolve_link("page_url", "href").alias("pdf_url")).where("pdf_url IS NOT NULL")
    return found if domain is None else found.where(in_domain(F.col("pdf_url"), domain))


def page_errors(pages: DataFrame) -> DataFrame:
    """I4: (page_url, error) of each page (page_url, html) that couldn't be read; the others aren't touched by it."""
    return pages.select("page_url", scan_page("html")["error"].alias("error")).where("error IS NOT NULL")


def sitemap_edges(fetched: DataFrame) -> DataFrame:
    """(parent, child, is_index) of fetched sitemaps (url, content), gunzipped where they need it.

    A sitemap that is missing, no gzip behind such a name or no XML has no edges; the walk goes on without it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url, content in zip(frame["url"], frame["content"]):
                try:
                    root = ElementTree.fromstring(gzip.decompress(content) if url.endswith(".gz") or content[:2] == b"\x1f\x8b" else content)
                except Exception:
                    continue
                is_index = root.tag.rsplit("}", 1)[-1] == "sitemapindex"
                rows += [(url, e.text.strip(), is_index) for e in root.iter() if e.tag.rsplit("}", 1)[-1] == "loc" and e.text]
            yield pd.DataFrame(rows, columns=["parent", "child", "is_index"])

    return fetched.where("url IS NOT NULL AND content IS NOT NULL").select("url", "content").mapInPandas(run, "parent string, child string, is_index boolean")


def walk_sitemaps(edges: DataFrame, root: str, prefix: str = "/he/", most: int | None = None, rules: DataFrame | None = None) -> DataFrame:
    """(url, depth) of the pages below ``root``; edges (parent, child, is_index).

    Level by level with a visited set until no new sitemap is found, so cycles end; each level is cut by a checkpoint.
    ``rules`` (see :func:`robots_allow`) bar sitemaps from being read; ``most`` bounds the pages (the first by depth
    and address), and ends the walk at the level that reaches it.
    """
    spark = edges.sparkSession
    front = spark.createDataFrame([(root,)], "parent string")
    visited, found, pages, level = front.withColumnRenamed("parent", "url"), None, 0, 0
    while True:
        level += 1
        if rules is not None:
            front = robots_allow(front, rules, "parent")
        step = cut(front.join(edges, "parent").select(F.col("child").alias("url"), "is_index").groupBy("url").agg(F.max("is_index").alias("is_index")).join(visited, "url", "left_anti"))
        fits = ~F.col("is_index") & F.startswith(url_path(F.col("url")), F.lit(prefix))
        sizes = step.agg(F.count("*").alias("all"), F.count_if(fits).alias("pages"), F.count_if(F.col("is_index")).alias("more")).first()
        here = step.where(fits).select("url", F.lit(level).alias("depth"))
        found = here if found is None else found.unionByName(here)
        pages += sizes["pages"]
        if not sizes["more"] or most is not None and pages >= most:
            break
        visited = visited.unionByName(step.where("is_index").select("url"))
        front = step.where("is_index").select(F.col("url").alias("parent"))
    found = found.groupBy("url").agg(F.min("depth").alias("depth"))  # a page can stand in sitemaps of several levels
    return found if most is None else found.orderBy("depth", "url").limit(most)


def feed_links(feed: Column) -> Column:
    """The first link of each entry of an Atom feed."""
    return F.xpath(feed, F.lit("//entry/link[1]/@href"))


def percent_encoded(text: Column) -> Column:
    """``text`` for an address, every character but letters, digits and ``_.-~`` encoded."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


# Fixed value: the title of a site's page of recent changes.
RECENT_CHANGES = "מיוחד:שינויים_אחרונים"


def feed_url(site: Column, title: str = RECENT_CHANGES, days: int = 1, limit: int = 500) -> Column:
    """Address of a site's feed of recent changes."""
    return F.concat(site, F.lit("/w/he/index.php?title="), percent_encoded(F.lit(title)), F.lit(f"&feed=atom&days={days}&limit={limit}"))


def discover(mode: str, pages: DataFrame, edges: DataFrame | None = None, root: str = "", feeds: DataFrame | None = None, rules: DataFrame | None = None, prefix: str = "/he/", most: int = 20_000, title_filter: Column | None = None, domain: str | None = None) -> DataFrame:
    """(page_url, title, pdf_url) of the pages (page_url, html) that a mode looks at.

    ``full``: those below ``root`` in the sitemaps ``edges``, at most ``most``. ``incremental``: those that the feeds (xml)
    of recent changes name, without prefix, bound or removal of repeats. Any other mode is an error. Pages that robots
    ``rules`` bar aren't looked at; without rules given none is barred.
    """
    if mode == "full":
        urls = walk_sitemaps(edges, root, prefix, most, rules).select("url")
    elif mode == "incremental":
        urls = feeds.select(F.explode(feed_links(F.col("xml"))).alias("url")).where("url <> ''")
    else:
        raise ValueError(f"unknown mode {mode!r}: full or incremental")
    if rules is not None:
        urls = robots_allow(urls, rules, "url")
    return discover_pdfs(urls.join(pages, urls["url"] == pages["page_url"]).select("page_url", "html"), title_filter, domain)


def robots_allow(urls: DataFrame, rules: DataFrame, url: str) -> DataFrame:
    """Addresses that no rule (host, path_prefix) refuses; hosts without any rule are refused."""
    named = urls.withColumn("__host", url_host(F.col(url)))
    hosts = rules.select(F.col("host").alias("__host")).distinct()
    bans = rules.where("path_prefix IS NOT NULL AND path_prefix <> ''").select(F.col("host").alias("__host"), "path_prefix")
    allowed = named.join(hosts, "__host", "left_semi")
    return allowed.join(bans, (allowed["__host"] == bans["__host"]) & F.startswith(url_path(allowed[url]), bans["path_prefix"]), "left_anti").drop("__host")


def fetch_outcome(prior_sha: Column, known: Column) -> Column:
    """New, updated, unchanged or error of one fetch, by the content stored before it and whether there was an entry."""
    return (
        F.when(~F.coalesce(F.col("robots_ok"), F.lit(False)) | F.col("transport_error").isNotNull(), "error")
        .when(F.col("status") == 304, "unchanged")
        .when(~F.coalesce(F.col("status") == 200, F.lit(False)), "error")
        .when(F.col("sha256") == prior_sha, "unchanged")
        .when(F.coalesce(known, F.lit(False)), "updated")
        .otherwise("new")
    )


def _answered(*status: int) -> Column:
    """Whether a fetch was allowed, got through and came back with one of these."""
    return F.coalesce(F.col("status").isin(*status) & F.col("robots_ok") & F.col("transport_error").isNull(), F.lit(False))


def stores() -> Column:
    """Whether a fetch brings content that becomes the stored one."""
    return _answered(200)


_ORDER = ("ts", "arrived_at", "status", "sha256", "etag", "last_modified", "robots_ok", "transport_error")


def manifest_changes(fetches: DataFrame, manifest: DataFrame | None = None, block_seconds: int = 86_400) -> DataFrame:
    """I1, W3 in batch: every fetch with its ``outcome``, in order of (ts, arrived_at, the rest).

    The content stored before a fetch is that of the last good fetch in its block of time, else that of the last earlier
    block that has one, else that of ``manifest``. An address has an entry from the manifest, or from its first fetch that
    brings content or is answered 304. Blocks are windows of their own and only their last contents are ordered per address,
    so an address with a third of all fetches is spread over as many tasks as it has blocks. A null hash counts as ``-``;
    rows without an address or a time take no part; repeated rows count each.
    """
    rows = fetches.where("pdf_url IS NOT NULL AND ts IS NOT NULL").withColumn("block", F.floor(F.expr("timestampdiff(SECOND, timestamp_ntz'2000-01-01 00:00:00', ts)") / block_seconds).cast("bigint"))
    rows = rows.withColumn("sha256", F.when(stores(), F.coalesce("sha256", F.lit("-"))).otherwise(F.col("sha256")))
    good, touch = F.when(stores(), F.col("sha256")), F.when(_answered(200, 304), True)
    per_block = rows.groupBy("pdf_url", "block").agg(F.max_by("sha256", F.when(stores(), F.struct(*_ORDER))).alias("s"), F.max(touch).alias("touched"))
    if manifest is not None:
        held = manifest.where("pdf_url IS NOT NULL").select("pdf_url", F.lit(-(2**62)).alias("block"), F.nullif("sha256", F.lit("")).alias("s"), F.lit(True).alias("touched"))
        per_block = per_block.unionByName(held.groupBy("pdf_url", "block").agg(F.max("s").alias("s"), F.max("touched").alias("touched")))
    across = Window.partitionBy("pdf_url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("pdf_url", "block").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select("pdf_url", "block", F.last("s", ignorenulls=True).over(across).alias("before"), F.last("touched", ignorenulls=True).over(across).alias("known"))
    seen = rows.withColumn("inside", F.last(good, ignorenulls=True).over(within)).withColumn("met", F.last(touch, ignorenulls=True).over(within)).join(starts, ["pdf_url", "block"])
    return seen.withColumn("outcome", fetch_outcome(F.coalesce("inside", "before"), F.coalesce("met", "known"))).select(*fetches.columns, "outcome")


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def manifest_state(changes: DataFrame, discoveries: DataFrame, site: str, manifest: DataFrame | None = None) -> DataFrame:
    """The manifest after all fetches of :func:`manifest_changes`, one row per address with an entry.

    A fetch that brings new content replaces an entry: its validators (null where the answer had none), its hash, and page
    and title of ``discoveries`` (pdf_url, source_page_url, source_title; the first by page and title counts); the file
    name is reused, or made of title and address, and ``first_seen`` is kept where there is one. Known content refreshes the
    validators that come with it, and any answer of 200 or 304 ``last_checked``. Errors leave entries as they are. All of
    it is one aggregation per address, combined before the shuffle.
    """
    old = (changes.sparkSession.createDataFrame([], MANIFEST) if manifest is None else manifest).where("pdf_url IS NOT NULL").groupBy("pdf_url").agg(F.max(F.struct(*MANIFEST_FIELDS)).alias("o"))
    order, changed = F.struct(*_ORDER), F.col("outcome").isin("new", "updated")
    brought = (F.col("outcome") == "unchanged") & (F.col("status") == 200) | changed
    late = lambda c: F.max(F.when(brought & F.col(c).isNotNull(), F.struct(order.alias("at"), F.col(c).alias("v"))))
    news = changes.where("outcome <> 'error'").groupBy("pdf_url").agg(
        F.max(F.when(changed, order)).alias("replaced"), F.max_by("sha256", F.when(changed, order)).alias("sha"), F.min(F.when(changed, F.col("ts"))).alias("first"), F.max("ts").alias("checked"),
        late("etag").alias("etag"), late("last_modified").alias("last_modified"),
    )
    told = discoveries.where("pdf_url IS NOT NULL").groupBy("pdf_url").agg(F.min(F.struct("source_page_url", "source_title")).alias("d"))
    all_ = old.join(news, "pdf_url", "full_outer").join(told, "pdf_url", "left")
    is_new = F.col("replaced").isNotNull()

    def validator(c: str) -> Column:
        fresh = F.when(F.col(c).isNotNull() & (~is_new | (F.col(f"{c}.at") >= F.col("replaced"))), F.col(f"{c}.v"))
        return F.coalesce(fresh, F.when(~is_new, F.col(f"o.{c}"))).alias(c)

    made = F.concat(safe_filename(drop_title_suffix(F.coalesce("d.source_title", F.lit("")), site)), F.lit(" -- "), url_basename(F.col("pdf_url")))
    kept = lambda c: F.nullif(F.col(f"o.{c}"), F.lit(""))
    return all_.select(
        "pdf_url", validator("etag"), validator("last_modified"), F.when(is_new, F.col("sha")).otherwise(F.col("o.sha256")).alias("sha256"),
        F.when(is_new, F.coalesce(kept("local_filename"), made)).otherwise(F.col("o.local_filename")).alias("local_filename"),
        *(F.when(is_new, F.col(f"d.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("source_page_url", "source_title")),
        F.when(is_new, F.coalesce(kept("first_seen"), _iso(F.col("first")))).otherwise(F.col("o.first_seen")).alias("first_seen"),
        F.coalesce(_iso(F.col("checked")), F.col("o.last_checked")).alias("last_checked"),
    )


def crawl_stats(changes: DataFrame, *by: str) -> DataFrame:
    """Fetches and outcomes, and the errors other than refusals by robots rules."""
    outcome = lambda kind: F.count_if(F.col("outcome") == kind).alias(f"pdfs_{kind}")
    told = F.count_if((F.col("outcome") == "error") & F.coalesce(F.col("robots_ok"), F.lit(False))).alias("errors")
    return changes.groupBy(*by).agg(F.count("*").alias("pdfs_seen"), outcome("new"), outcome("updated"), outcome("unchanged"), outcome("error"), told)


def crawl_errors(changes: DataFrame) -> DataFrame:
    """(pdf_url, ts, message) of each error, as rows, since a list of them has no bound; refusals by robots rules aren't told."""
    message = F.concat("pdf_url", F.lit(": "), F.coalesce("transport_error", F.concat(F.lit("HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("None")))))
    return changes.where((F.col("outcome") == "error") & F.coalesce(F.col("robots_ok"), F.lit(False))).select("pdf_url", "ts", message.alias("message"))


def conditional_headers(discovered: DataFrame, manifest: DataFrame) -> DataFrame:
    """Discovered addresses with the validators that their stored entry has, and whether there is one."""
    state = manifest.select("pdf_url", F.nullif("etag", F.lit("")).alias("if_none_match"), F.nullif("last_modified", F.lit("")).alias("if_modified_since"), F.lit(True).alias("known"))
    return discovered.select("pdf_url").distinct().join(state, "pdf_url", "left").withColumn("known", F.coalesce("known", F.lit(False)))
