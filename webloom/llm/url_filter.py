"""URL filters: allow and block rules first, then logistic regression on hashed character n-grams of host and path.

The host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the path follows up to `?`, `#` or
the end.  A rule fits its host and all subdomains if the path starts with the rule's; the longest rule wins.  Where no
rule fits, a model trained here on a small labelled URL table judges: its features are the character n-grams (NGRAMS) of
the host and of the path, each in its own marked string, hashed to SLOTS weights.

The labelled table is bounded by MAX_LABELLED rows (the least hashes of its URLs are taken), and fitted on the driver by
full-batch gradient steps, so the weights are the same for any partitioning; the SLOTS weights are what is broadcast.
Defined results: null URLs and those without `://` have an empty host and path, no rule, and are allowed (there is nothing
to judge); repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import session
from .textvec import mix, slices, utf8

NGRAMS = (3, 4, 5)
SLOTS = 1 << 15
MAX_LABELLED = 20_000
#: Above one half, so that a site the model knows nothing of is allowed.
THRESHOLD = 0.65
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the rules that the query applies.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: The labelled URL table (own examples): names of sites to block, and of sites to allow.
BLOCKED = (
    "casino casinos casino-win win-casino royal-casino online-casino slots free-slots jackpot poker poker-win roulette lottery bet bets free-bets betting"
    " sport-bets gambling adult adult-x adults-only porn free-porn xxx sex sex-cams nude escorts webcam-girls hot-x cheap-pills pills viagra cialis pharmacy-deals"
    " cheap-meds weight-loss-pills spam spam-farm spammy link-farm seo-farm content-farm ads ads-track adserver ad-track tracker track-click click-ads popads"
    " clickbait malware phishing warez torrents crack-keygen free-money fast-loans payday-loans get-rich crypto-doubler fake-watches replica-bags"
).split()
ALLOWED = (
    "news daily-news library museum gardens history science journal university school cooking recipes travel maps weather music books reviews"
    " physics biology chemistry astronomy city-council railway harbour mountain river forest church monastery archive encyclopedia dictionary grammar"
    " poems novels letters painting sculpture theatre cinema football chess running cycling sailing farmers-market bakery carpenter plumbing"
    " software docs developer opensource compilers database mathematics statistics health hospital clinic dentist law parliament government elections"
    " north south other thesis theory thinking within another together weather leather brother gathering winter summer tonight station nation ration"
    " windmill window twin trackers-of-birds adulthood-studies betterhomes essex-history addresses padlock loadstone roads heads threads"
).split()


def labelled(spark: SparkSession) -> DataFrame:
    """(url, blocked) of the built-in labelled table: each name under several top-level domains and page addresses."""
    domains = ("example.com", "example.org", "example.net", "test.info", "sample.co")
    pages = ("/en/12", "/fr/345/", "/de/6.html", "/es/978", "/index.html", "/", "/en/77?page=2", "/articles/2020/05/on-the-way")
    heads = ("", "www.", "blog.", "m.")
    rows = []
    for label, names in ((1, BLOCKED), (0, ALLOWED)):
        for i, name in enumerate(names):
            for k in range(8):
                rows.append((f"https://{heads[(i + k) % 4]}{name}.{domains[(i + k) % 5]}{pages[k]}", label))
            if label:
                rows.append((f"https://www.{ALLOWED[i % len(ALLOWED)]}.{domains[i % 5]}/{name}/{i}", 1))
            else:
                rows.append((f"https://www.{ALLOWED[(i * 7 + 3) % len(ALLOWED)]}.{domains[i % 5]}/{name}/{i}", 0))
    return spark.createDataFrame(rows, "url string, blocked int")


def host_and_path(url: str = "url"):
    """The columns (host, path) of a URL column."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    column = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(column, whole, 1), _UPPER, _LOWER)
    return host.alias("host"), F.regexp_extract(column, whole, 2).alias("path")


def rule_column(rules=RULES):
    """(rule, verdict) struct of the longest rule that fits columns host and path, else null."""
    chain = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        chain = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chain)
    return chain


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slot, row) of every n-gram of every string's UTF-8 bytes."""
    data, offsets = utf8(column)
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    slots, rows = [], []
    for n in NGRAMS:
        if len(data) < n:
            continue
        h = np.zeros(len(data) - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + data[k : len(data) - n + 1 + k] + np.uint64(1)
        whole = row[: len(data) - n + 1] == row[n - 1 :]
        slots.append((mix(h[whole], n) % np.uint64(SLOTS)).astype(np.int64))
        rows.append(row[: len(data) - n + 1][whole])
    return np.concatenate(slots or [np.zeros(0, np.int64)]), np.concatenate(rows or [np.zeros(0, np.int64)])


def marked(host: str = "host", path: str = "path"):
    """The string whose n-grams are features: host and path, each with its own brackets."""
    return F.concat(F.lit("<"), F.col(host), F.lit(">("), F.col(path), F.lit(")"))


class Model:
    def __init__(self, urls: list[str], blocked: list[int], steps: int = 400, rate: float = 4.0, decay: float = 2e-5):
        slot, row = grams(pa.array(urls, pa.string()))
        keys = np.unique(row * SLOTS + slot)
        row, slot = keys // SLOTS, keys % SLOTS
        y = np.array(blocked, float)
        size = np.sqrt(np.bincount(row, minlength=len(y)))
        value = 1 / size[row]
        # Both classes count alike, however many rows each has.
        share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        self.weights, self.bias = np.zeros(SLOTS), 0.0
        for _ in range(steps):
            miss = (y - self._p(np.bincount(row, self.weights[slot] * value, len(y)) + self.bias)) * share
            self.weights += rate * (np.bincount(slot, miss[row] * value, SLOTS) - decay * self.weights)
            self.bias += rate * miss.sum() * 0.1

    @staticmethod
    def _p(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of each marked string that it is to be blocked; n-grams count once each."""
        slot, row = grams(column)
        keys = np.unique(row * SLOTS + slot)
        row, slot = keys // SLOTS, keys % SLOTS
        size = np.sqrt(np.maximum(np.bincount(row, minlength=len(column)), 1))
        return self._p(np.bincount(row, self.weights[slot], len(column)) / size + self.bias)


def train(table: DataFrame, url_col: str = "url", label_col: str = "blocked") -> Model:
    """Fit on (url, 0 or 1) rows without nulls."""
    rows = table.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(url_col).alias("url"), F.col(label_col).cast("int").alias("y")).distinct()
    rows = rows.select("y", "url", *host_and_path()).select("y", marked().alias("m"), F.xxhash64("url").alias("h"))
    picked = rows.orderBy("h", "m", "y").limit(MAX_LABELLED).collect()
    return Model([r["m"] for r in picked], [r["y"] for r in picked])


def judge(pages: DataFrame, model: Model, rules=RULES, url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The kept columns (with underscores behind names that clash), host, path, rule, verdict and score of every URL."""
    spark = pages.sparkSession
    session.arrow(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [F.col(c).alias(session.free(c, "host", "path", "rule", "verdict", "score")) for c in keep]
    host, path = host_and_path(url_col)
    rows = pages.select(F.struct(*kept).alias("kept"), host, path).withColumn("fit", rule_column(rules))
    rows = rows.select(marked().alias("marked_"), "kept.*", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"))

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(0)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(shared.value.score(part.column(0)))], [*batch.schema.names[1:], "score"])

    out = rows.mapInArrow(run, rows.drop("marked_").schema.add("score", "double"))
    method = F.when((F.col("score") >= THRESHOLD) & ((F.col("host") != "") | (F.col("path") != "")), "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("verdict", method))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), train(labelled(spark)))
