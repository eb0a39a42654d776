"""Line dedup by site-relative frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

#: Boilerplate lines of all sites up to which the table is broadcast (24 bytes each, and what a map of sites takes).
BROADCAST_LINES = 1 << 20


def _keys(line: Column) -> Column:
    """A line's two 64-bit hashes."""
    return F.struct(F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2"))


def _lines(text: Column) -> Column:
    """Lines without surrounding blanks."""
    return F.transform(F.split(text, "\n"), lambda x: F.trim(x))


def boilerplate_lines(docs: DataFrame, site: str = "source", ratio: float = 0.05, least_pages: int = 3, once: bool = False) -> DataFrame:
    """(site, line keys k1 and k2, pages, site_pages) of the lines that over ratio of a site's pages contain.

    A page counts once for each distinct line.  Lines are told apart by two 64-bit hashes, 128 bits.
    Blank lines and lines that fewer than least_pages pages contain are never boilerplate.  once: pages of
    a site with the same whole text count as one page.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    pages = docs.select(F.col(f"`{site}`").alias("site"), F.array_distinct(_lines(text)).alias("lines"), *([F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")] if once else []))
    page = ["t1", "t2"] if once else []
    totals = pages.select("site", *page)
    totals = (totals.distinct() if once else totals).groupBy("site").agg(F.count("*").alias("site_pages"))
    each = pages.select("site", *page, F.explode("lines").alias("line")).filter("line <> ''").select("site", *page, _keys(F.col("line")).alias("k"))
    each = each.select("site", "k.k1", "k.k2", *page)
    if once:
        each = each.distinct()
    counts = each.groupBy("site", "k1", "k2").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least_pages)
    return counts.join(totals, counts["site"].eqNullSafe(totals["site"])).select(counts["site"], "k1", "k2", "pages", "site_pages").filter(F.col("pages") > ratio * F.col("site_pages"))


def dedup_lines(docs: DataFrame, site: str = "source", ratio: float = 0.05, least_pages: int = 3, once: bool = False, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs with its lines of site boilerplate dropped from text, and n_lines and n_dropped added.

    A site is a value of the column site; null is a site of its own.  A line (between line feeds, compared
    without surrounding blanks) goes from every page of a site if more than ratio of the site's pages,
    and at least least_pages, contain it.  Other lines keep their bytes and order.  Null text stays null
    with no lines; a text of boilerplate only becomes empty.  Pages that are copies of one another each
    count, so a group of copies on more than ratio of a site's pages loses its text, every copy of it;
    with once they count as one page, and keep it.  Rows are neither removed nor joined by doc_id, so null
    and repeated doc_ids make no difference; an empty table gives one.  Other columns stay, whatever their
    names (columns named n_lines or n_dropped are replaced).

    Per-page counts are pre-aggregated before the shuffle on (site, line), so a site with a third of all
    pages is spread by its lines.  The boilerplate table holds at most 1 / ratio lines a page on average
    of a site; it is written and its lines counted.  A site's lines are one row: rows are only joined with
    them, by a broadcast of up to broadcast_lines lines, else by site, where adaptive execution splits a
    hot site's pages.
    """
    marked = written(boilerplate_lines(docs, site, ratio, least_pages, once), "boilerplate")
    total = marked.count()
    sites = marked.groupBy("site").agg(F.collect_list(F.struct("k1", "k2")).alias("marks"))
    # One array of first hashes for a quick intersection; the pairs decide.
    sites = sites.select("site", F.transform("marks", lambda m: m["k1"]).alias("quick"), "marks")
    sites = F.broadcast(sites) if total <= broadcast_lines else written(sites, "sites")
    rows = docs.drop("n_lines", "n_dropped").select(F.struct("*").alias("row"))
    rows = rows.withColumns({"own": F.col(f"row.`{site}`"), "lines": F.split(F.col("row.text").cast("string"), "\n")})
    rows = rows.join(sites, rows["own"].eqNullSafe(sites["site"]), "left")
    rows = rows.withColumn("hit", F.array_intersect(F.transform("lines", lambda x: F.xxhash64(F.trim(x))), "quick"))
    goes = lambda x: (F.trim(x) != "") & F.array_contains("hit", F.xxhash64(F.trim(x))) & F.array_contains("marks", _keys(F.trim(x)))
    some = F.coalesce(F.size("hit") > 0, F.lit(False))
    rows = rows.withColumn("kept", F.when(some, F.filter("lines", lambda x: ~goes(x))))
    n_lines = F.coalesce(F.size("lines"), F.lit(0))
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(n_lines)
    n_dropped = F.when(F.col("kept").isNull(), 0).otherwise(F.size("lines") - F.size("kept"))
    text = F.when(n_dropped > 0, F.array_join("kept", "\n")).otherwise(F.col("row.text"))
    columns = [text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*columns, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
