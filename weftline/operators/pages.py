"""Web pages: addresses in one form, and HTML to text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.html import read_page

#: scheme, host with port, path, query; what doesn't look like this stays as it is.
ADDRESS = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\s]*)([^?#\s]*)(?:\?([^#\s]*))?(?:#\S*)?\s*$"

#: Query parameters that tell where a visitor came from and not what the page is.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)"


def canonical_url(url: str) -> Column:
    """A struct of an address's canonical form and its host.

    Scheme and host are lower case, without user, default port and last dot; the path has no doubled
    slashes and no slash at its end; tracking parameters and the fragment are gone, the other
    parameters sorted. An address of another form stays as it is, without a host; null stays null.
    """
    scheme, place, path, query = (F.regexp_extract(url, ADDRESS, k) for k in (1, 2, 3, 4))
    scheme = F.lower(scheme)
    host = F.regexp_replace(F.lower(F.regexp_replace(place, r"^.*@", "")), r"\.?(:\d*)?$", "")
    port = F.regexp_extract(place, r":(\d+)$", 1)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")
    wanted = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING)))
    rest = F.when(F.size(wanted) > 0, F.concat(F.lit("?"), F.array_join(wanted, "&"))).otherwise("")
    made = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), rest)
    known = F.col(url).rlike(ADDRESS)
    return F.struct(F.when(known, made).otherwise(F.col(url)).alias("canonical"), F.when(known & (host != ""), host).alias("host"))


def canonical_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, canonical, host, first_page_id and n_same: the smallest id and the number of pages of one address.

    Addresses are counted before they meet, and the join back to the pages is one that Spark splits where
    many pages share an address. Rows without an address are of no group (first_page_id null, n_same 0);
    repeated rows count as pages of their own; rows without an id count, but are no group's first.
    """
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    made = named.select("page_id", canonical_url("url").alias("c")).select("page_id", "c.canonical", "c.host")
    groups = made.where("canonical is not null").groupBy(F.col("canonical").alias("address"))
    groups = groups.agg(F.min("page_id").alias("first_page_id"), F.count("*").alias("n_same"))
    both = made.join(groups, F.col("canonical") == F.col("address"), "left")
    return both.select("page_id", "canonical", "host", "first_page_id", F.coalesce("n_same", F.lit(0)).alias("n_same"))


PAGES_AT_ONCE = 256  #: pages whose texts a task holds beside the batch that it reads
PAGE = "title string, text string, n_blocks long, n_kept long, n_links long, chars long, link_chars long"


def page_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", link_share: float = 0.5) -> DataFrame:
    """page_id and what `read_page` gives of each whole page; a null page is an empty one, rows are independent."""

    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [(name, kinds[kind]) for name, kind in (c.split() for c in PAGE.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(at, PAGES_AT_ONCE)
                read = [read_page(p, link_share) for p in part.column("html").to_pylist()]
                made = [pa.array([r[name] for r in read], kind) for name, kind in fields]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), *made], names=["page_id", *(name for name, _ in fields)])

    named = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return named.mapInArrow(run, f"page_id {named.schema['page_id'].dataType.simpleString()}, {PAGE}")
