"""Videos: ids and API addresses, choice of a file, listing pages, canonical and comparison forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import urls

PAGE_SIZE = 50
_FILE = "struct<resolution:struct<id:string>,fileDownloadUrl:string,fileUrl:string>"
VIDEO = f"struct<name:string,thumbnailPath:string,previewPath:string,files:array<{_FILE}>,streamingPlaylists:array<struct<files:array<{_FILE}>>>,total:bigint,data:array<struct<uuid:string,shortUUID:string>>>"
# Address forms of the video service and of a common player.
VIDEO_PATH = r"^/(?:videos/(?:embed|watch)|w)/([0-9A-Za-z-]{6,})/?$"
API_PATH = r"^/api/v1/videos/([0-9A-Za-z-]{6,})/?$"
USED_PATH = r"^/(api/v1/videos(/[0-9A-Za-z-]+)?/?$|static/|lazy-static/|download/videos/|download/streaming-playlists/)"
FILE_PATH = r"^/(download/|static/web-videos/|static/webseed/|static/streaming-playlists/)"
PLAYER = r"(?i)youtube(?:-nocookie)?\.com/embed/([\w-]{6,})"


def origin(url: str) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)


def video_id(path: Column) -> Column:
    one = F.regexp_extract(path, VIDEO_PATH, 1)
    return F.nullif(F.when(one != "", one).otherwise(F.regexp_extract(path, API_PATH, 1)), F.lit(""))


def api_url(start: Column, video: Column) -> Column:
    return F.concat(start, F.lit("/api/v1/videos/"), video)


def list_url(start: Column, offset: Column) -> Column:
    return F.concat(start, F.lit("/api/v1/videos?start="), offset.cast("string"), F.lit(f"&count={PAGE_SIZE}&sort=publishedAt&isLocal=true"))


def queue_form(url: str) -> Column:
    """Struct (url, kind) under which an address of the video service is queued; null if it is of no use."""
    path, of = urls.path_of(url), lambda u, k: F.struct(u.alias("url"), F.lit(k).alias("kind"))
    vid = video_id(path)
    return (
        F.when(vid.isNotNull() & ~path.startswith("/api/"), of(api_url(origin(url), vid), "page"))
        .when(path.rlike(USED_PATH) & path.startswith("/api/"), of(F.col(url), "page"))
        .when(path.rlike(USED_PATH) & path.rlike(FILE_PATH), of(F.col(url), "media"))
        .when(path.rlike(USED_PATH), of(F.col(url), "asset"))
    )


def height(file: Column) -> Column:
    return F.coalesce(file["resolution"]["id"].try_cast("int"), F.lit(0))


def chosen_file(video: Column, most: int) -> Column:
    """The file struct with the greatest height up to `most`, else the lowest; the first in the list among equals."""
    empty = F.array().cast(f"array<{_FILE}>")
    lists = F.coalesce(F.transform(video["streamingPlaylists"], lambda p: F.coalesce(p["files"], empty)), F.array().cast(f"array<array<{_FILE}>>"))
    usable = F.filter(F.concat(F.coalesce(video["files"], empty), F.flatten(lists)), lambda f: F.coalesce(f["fileDownloadUrl"], f["fileUrl"]).isNotNull() & (height(f) > 0))
    fit = F.filter(usable, lambda f: height(f) <= most)
    best = F.when(F.size(fit) > 0, F.array_max(F.transform(fit, height))).otherwise(F.array_min(F.transform(usable, height)))
    return F.get(F.filter(usable, lambda f: height(f) == best), F.lit(0))


def from_api(responses: DataFrame, most: int, url: str = "url", body: str = "body") -> DataFrame:
    """(parent, url, kind) that API responses name: videos and the next page of a listing, or a video's file and pictures."""
    rows = responses.select(F.col(url).alias("parent"), F.from_json(F.col(body).cast("string"), VIDEO).alias("v"))
    start = F.coalesce(F.regexp_extract("parent", r"[?&]start=(\d+)", 1).try_cast("bigint"), F.lit(0))
    count = F.coalesce(F.nullif(F.regexp_extract("parent", r"[?&]count=(\d+)", 1).try_cast("bigint"), F.lit(0)), F.lit(PAGE_SIZE))
    entry = lambda u, k: F.struct(u.alias("url"), F.lit(k).alias("kind"))
    listing = F.col("v.data").isNotNull() & F.col("v.total").isNotNull()
    ids = F.transform(F.filter(F.transform("v.data", lambda d: F.coalesce(d["uuid"], d["shortUUID"])), lambda i: i.isNotNull()), lambda i: entry(api_url(origin("parent"), i), "page"))
    more = F.when((start + count < F.col("v.total")) & (F.size("v.data") > 0), F.array(entry(list_url(origin("parent"), start + count), "page")))
    none = F.array().cast("array<struct<url:string,kind:string>>")
    file = chosen_file(F.col("v"), most)
    own = F.array(entry(F.coalesce(file["fileDownloadUrl"], file["fileUrl"]), "media"), *[entry(F.concat(origin("parent"), F.col(f"v.{p}")), "asset") for p in ("thumbnailPath", "previewPath")])
    named = F.when(listing, F.concat(ids, F.coalesce(more, none))).otherwise(F.filter(own, lambda x: x["url"].isNotNull()))
    return rows.where("v IS NOT NULL").select("parent", F.explode(named).alias("x")).select("parent", "x.url", "x.kind")


def canonical_video(url: str) -> Column:
    """Address of a video's own page, without a fragment."""
    vid = F.regexp_extract(url, PLAYER, 1)
    return F.when(vid != "", F.concat(F.lit("https://www.youtube.com/watch?v="), vid)).otherwise(F.regexp_extract(url, "^[^#]*", 0))


def comparison_key(df: DataFrame, url: str, out: str = "video_key") -> DataFrame:
    """df with the video's address without scheme, www., m. and a last slash."""
    df = df.withColumn("__v", canonical_video(url))
    host = F.regexp_replace(F.regexp_replace(urls.host_of("__v"), r"^www\.", ""), r"^m\.", "")
    query = urls.query_of("__v")
    return df.withColumn(out, F.concat(host, F.regexp_replace(urls.path_of("__v"), "/+$", ""), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))).drop("__v")


def chosen_files(files: DataFrame, most: int, *video: str) -> DataFrame:
    """The chosen row of each video of a table of files (height, seq, ...): as chosen_file, by a grouped minimum, without lists."""
    fits = F.col("height") <= most
    order = F.struct(F.when(fits, 0).otherwise(1).alias("late"), F.when(fits, -F.col("height")).otherwise(F.col("height")).alias("h"), F.col("seq").alias("seq"))
    rest = [c for c in files.columns if c not in video]
    return files.where("height > 0").groupBy(*video).agg(F.min_by(F.struct(*rest), order).alias("f")).select(*video, "f.*")
