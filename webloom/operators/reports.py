"""Reports: status by group, refusals, errors, file check, file catalogue, site probe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text, urls
from ..sources import steps

# Extensions of the catalogue's categories, in their order; sheet music also by its part of the site.
CATEGORIES = {
    "books": "epub fb2 fb2.zip mobi azw3 djvu djv pdf doc docx rtf odt txt chm".split(),
    "notes": "pdf mus mid midi nwc sib musx mxl zip".split(),
    "audio": "mp3 m4b m4a ogg oga opus wav flac aac wma".split(),
    "video": "mp4 m4v webm mkv avi mov flv 3gp mpg mpeg wmv".split(),
    "archives": "zip rar 7z gz tgz".split(),
}
PER_PAGE = 1000


def group_key(by: str, main_host: str = "") -> Column:
    """Group of a URL for status reports: section (own sections, own sub-hosts, else outer hosts), kind, status or ctype."""
    if by in ("kind", "status"):
        return F.col(by)
    if by == "ctype":
        return urls.base_content_type("content_type")
    host = urls.host_of("url")
    return F.when(host == main_host, F.concat(F.lit("/"), urls.section("url"))).when(host.endswith("." + main_host), host).otherwise(F.concat(F.lit("outer: "), host))


def by_status(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def by_group(queue: DataFrame, by: str = "section", top: int = 40, main_host: str = "") -> DataFrame:
    """(g, done, queued, bad, bytes) of the groups with most bytes (a top-k report)."""
    one = lambda *s: F.count_if(F.col("status").isin(*s))
    size = F.coalesce(F.sum(F.when(F.col("status") == "done", F.col("size"))), F.lit(0))
    made = queue.groupBy(group_key(by, main_host).alias("g")).agg(one("done").alias("done"), one("queued", "active").alias("queued"), one("error", "auth").alias("bad"), size.alias("bytes"))
    return made.orderBy(F.desc("bytes"), F.desc("done"), "g").limit(top)


def skips_by_reason(skips: DataFrame) -> DataFrame:
    return skips.groupBy("reason").agg(F.sum("n").alias("n"))


def top_skips(skips: DataFrame, top: int = 12) -> DataFrame:
    return skips.orderBy(F.desc("n"), "reason", "prefix").limit(top)


def errors(queue: DataFrame, top: int = 10) -> DataFrame:
    made = queue.where(F.col("status").isin("error", "auth")).groupBy("status", "http_status", "error").agg(F.count("*").alias("n"), F.min("url").alias("example"))
    return made.orderBy(F.desc("n"), "example").limit(top)


def embeds_by_status(embeds: DataFrame) -> DataFrame:
    return embeds.groupBy("status").agg(F.count("*").alias("n"))


def done_bytes(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'done'").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def distinct_hosts(rows: DataFrame, url: str = "url") -> DataFrame:
    return rows.select(urls.host_of(url).alias("host")).distinct()


def file_check(queue: DataFrame, files: DataFrame) -> DataFrame:
    """(id, url, path, problem) of done rows whose file is missing or has another size; files: path, length.

    A file whose name differs in case only counts as found.
    """
    rows = queue.where((F.col("status") == "done") & F.col("path").isNotNull()).select("id", "url", "path", "size").withColumn("__k", text.case_folded(F.col("path")))
    exact = files.select("path", F.col("length").alias("__l"))
    folded = files.select(text.case_folded(F.col("path")).alias("__k"), F.col("length").alias("__f")).groupBy("__k").agg(F.min("__f").alias("__f"))
    joined = rows.join(exact, "path", "left").join(folded, "__k", "left").withColumn("__n", F.coalesce("__l", "__f"))
    problem = F.when(F.col("__n").isNull(), "missing").when(F.col("size").isNotNull() & (F.col("__n") != F.col("size")), "size")
    return joined.select("id", "url", "path", problem.alias("problem")).where("problem IS NOT NULL")


def category(url: str, path: str) -> Column:
    """Catalogue category of a file by its URL's or else its place's extension."""
    name = F.lower(F.regexp_extract(path, "[^/]*$", 0))
    own = F.when(name.endswith(".fb2.zip"), "fb2.zip").otherwise(F.regexp_extract(name, r"\.([^.]*)$", 1))
    ext = F.when(urls.extension(url) != "", urls.extension(url)).otherwise(own)
    out = F.when(F.col(url).contains("/kliros/") & ext.isin(CATEGORIES["notes"]), "notes")
    for key in ("books", "audio", "video", "archives"):
        out = out.when(ext.isin(CATEGORIES[key]), key)
    return out


def catalogue_files(queue: DataFrame) -> DataFrame:
    """Files with the title of the page they were found on (a left self-join on the parent)."""
    kept = (F.col("status") == "done") & F.col("path").isNotNull() & F.col("kind").isin("media", "page", "asset")
    for pattern in ("text/html%", "image/%", "text/css%", "%javascript%"):
        kept = kept & ~F.col("content_type").ilike(pattern)
    parents = queue.select(F.col("id").alias("parent_id"), F.col("title").alias("parent_title"))
    rows = queue.where(kept).select("id", "url", "path", "size", "parent_id").join(parents, "parent_id", "left")
    return rows.withColumn("category", category("url", "path")).where("category IS NOT NULL").select("id", "category", "parent_title", "url", "path", "size")


def catalogue_pages(files: DataFrame, per_page: int = PER_PAGE) -> DataFrame:
    """files with their place, page and whether a new page title begins, in the order of titles and places in a category.

    The order is a distributed sort by (category, title, path, id), so neither a category nor the files without a title meet in
    one task.  A row's place is its row id less that of its category's first row in the partition, and the rows of the
    category in the partitions before; sizes of (partition, category) are all that is gathered.
    """
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    keys = ["__c", "__t", "__p", "id"]
    title = F.coalesce("parent_title", F.lit(""))
    rows = files.withColumns({"__c": rank, "__t": F.lower(F.when(title == "", "~").otherwise(title)), "__p": F.lower("path")})
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__o", F.monotonically_increasing_id())
    # Row ids follow the sampled ranges, so they are fixed in a table before two branches read them.
    fixed = steps.written(spread.drop("__t", "__p"), "catalogue").withColumn("__b", F.shiftright("__o", 33))
    parts = fixed.groupBy("__b", "__c").agg(F.count("*").alias("__n"), F.min("__o").alias("__first"), F.max_by(title, "__o").alias("__last"))
    by_part = Window.partitionBy("__c").orderBy("__b")
    ahead = F.coalesce(F.sum("__n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("__b", "__c", "__first", ahead.alias("__ahead"), F.lag("__last").over(by_part).alias("__before"))
    placed = fixed.join(parts, ["__b", "__c"]).withColumn("place", F.col("__ahead") + F.col("__o") - F.col("__first") + 1)
    placed = placed.withColumn("page", F.floor((F.col("place") - 1) / per_page) + 1)
    before = F.coalesce(F.lag(title).over(Window.partitionBy("__b", "__c").orderBy("__o")), F.col("__before"))
    header = ((F.col("place") - 1) % per_page == 0) | before.isNull() | (before != title)
    return placed.withColumn("header", header).select(*files.columns, "place", "page", "header")


def catalogue_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("category").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def link_counts(links: DataFrame, column: str, top: int) -> DataFrame:
    """(value, n) of the most frequent values, the first seen (by seq) among equals."""
    made = links.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return made.orderBy(F.desc("n"), "first", "value").limit(top).select("value", "n")


def diverse(rows: DataFrame, n: int, url: str = "url", seq: str = "seq") -> DataFrame:
    """The first URL of each shape (slashes, query or not, extension, number at the end), n shapes at most (a sample)."""
    path = urls.path_of(url)
    shape = F.struct(F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))), urls.query_of(url) != "", urls.extension(url), path.rlike(r"/\d+/?$"))
    first = rows.groupBy(shape.alias("shape")).agg(F.min(F.struct(F.col(seq), F.col(url))).alias("f"))
    return first.select(f"f.{url}", f"f.{seq}").orderBy(seq).limit(n)


def probe(links: DataFrame, site: urls.UrlRules) -> dict[str, DataFrame]:
    """Counters of a page set's links (seq, url canonical, kind, source): kinds, sources, sections, query keys, outer hosts."""
    inside = urls.host_within(urls.host_of("url"), site.scope)
    own, outer = links.where(inside), links.where(~inside)
    keys = own.where(urls.query_of("url") != "").select("seq", F.explode(F.split(urls.query_of("url"), "&")).alias("t")).select("seq", F.substring(F.regexp_extract("t", "^[^=]*", 0), 1, 30).alias("k"))
    return {
        "kinds": link_counts(links, "kind", 10),
        "sources": link_counts(links.withColumn("s", F.split("source", ":")[0]), "s", 15),
        "sections": link_counts(own.where(F.col("kind").isin("page", "embed")).withColumn("s", urls.section("url")), "s", 25),
        "query_keys": link_counts(keys, "k", 20),
        "outer_hosts": link_counts(outer.withColumn("h", urls.host_of("url")), "h", 20),
    }
