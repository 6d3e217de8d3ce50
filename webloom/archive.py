"""One archive as a whole: its state tables are snapshots in a folder, its commands read them or put new ones in their place.

The network is a table of fetch results (see operators.crawl); files are what the results' bodies are.  Every command is a
plan over whole tables; what the driver holds are settings and counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import urls
from .operators import admission, crawl, frontier, links, main_text, reports, robots, search, viewer
from .sources import sinks, steps, tables

TABLES = ("queue", "skips", "embeds", "counts")


def matching(part: str) -> Column:
    """Whether the address contains the part, as it stands."""
    return F.col("url").contains(part) if part else F.lit(True)


class Archive:
    def __init__(self, spark: SparkSession, folder: str, rules: admission.Rules, agent: str = "archiver"):
        self.spark, self.folder, self.rules, self.agent = spark, folder.rstrip("/"), rules, agent
        steps.arrow(spark)

    def state(self) -> crawl.State:
        read = lambda name: sinks.read_snapshot(self.spark, f"{self.folder}/{name}")
        return crawl.State(*map(read, TABLES)) if sinks.has_snapshot(self.spark, f"{self.folder}/queue") else crawl.nothing(self.spark)

    def put(self, state: crawl.State) -> None:
        for name in TABLES:
            sinks.write_snapshot(getattr(state, name), f"{self.folder}/{name}")

    def crawl(self, seeds: DataFrame, results: DataFrame, robots_files: DataFrame, now: float, rounds: int = 50, max_tries: int = 5) -> None:
        """Go on where the last run stopped: claims left behind and failures of the network are due again."""
        state = self.state()
        queue = frontier.requeued(frontier.reset_active(state.queue), frontier.transient_errors())
        begun = crawl.State(queue, state.skips, state.embeds, state.counts)
        self.put(crawl.crawl(self.spark, seeds, results, self.rules, robots_files, self.agent, f"{self.folder}/rounds", rounds, max_tries=max_tries, state=begun, now=now))

    def bodies(self, results: DataFrame) -> DataFrame:
        """Done rows with the body of the last attempt."""
        last = results.groupBy("url").agg(F.max_by(F.struct("body"), "attempt").alias("r")).select("url", "r.body")
        return self.state().queue.where("status = 'done'").join(last, "url")

    def relink(self, results: DataFrame, robots_files: DataFrame, match: str = "") -> bool:
        """Read stored pages for links again under the rules of now; nothing is done if the rules are those of the last time."""
        mark = tables.signature({"rules": repr(self.rules), "match": match})
        place = f"{self.folder}/relinked"
        if sinks.has_snapshot(self.spark, place) and sinks.read_snapshot(self.spark, place).first()["value"] == mark:
            return False
        done = self.bodies(results).where(matching(match)).where(frontier.read_for_links("content_type", "url") & admission.follows(self.rules, "url"))
        state = self.state()
        arriving = crawl.children(done, self.rules)
        self.put(crawl.admitted(state, arriving, self.rules, robots.rules_table(robots_files, self.agent)))
        sinks.write_snapshot(self.spark.range(1).select(F.lit(mark).alias("value")), place)
        return True

    def status(self, by: str = "section", top: int = 40, main_host: str = "") -> dict[str, DataFrame]:
        s = self.state()
        return {"status": reports.by_status(s.queue), "groups": reports.by_group(s.queue, by, top, main_host), "skips": reports.top_skips(s.skips), "errors": reports.errors(s.queue), "embeds": reports.embeds_by_status(s.embeds)}

    def _requeue(self, which: Column) -> int:
        queue = self.state().queue
        n = queue.where(which).count()
        if n:
            sinks.write_snapshot(frontier.requeued(queue, which), f"{self.folder}/queue")
        return n

    def retry(self, statuses: tuple[str, ...] = ("error", "auth"), match: str = "") -> int:
        """Number of failed rows that are queued again."""
        return self._requeue(F.col("status").isin(*statuses) & matching(match))

    def refresh(self, now: float, match: str = "", older_days: float = 0) -> int:
        """Number of done rows that are queued again: those fetched longer ago than so many days."""
        old = F.coalesce(F.col("fetched_at"), F.lit(0.0)) < now - older_days * 86_400
        return self._requeue((F.col("status") == "done") & matching(match) & old)

    def probe(self, results: DataFrame, folder: str, limit: int = 3) -> dict[str, DataFrame]:
        """Counters of the stored pages' links, written as JSON and as Markdown tables, and some addresses of each shape."""
        pages = self.bodies(results).where(urls.base_content_type("content_type").isin("text/html", "application/xhtml+xml"))
        found = links.from_html(pages.withColumnRenamed("url", "page"), "id", "body", "page")
        made = found.select(frontier.place("id", F.col("seq")).alias("seq"), urls.canonical_column(self.rules.site, "url", "page")["url"].alias("url"), "kind", "source").where("url IS NOT NULL")
        parts = reports.probe(made, self.rules.site) | {"samples": reports.diverse(made, limit).select(F.col("url").alias("value"), F.lit(1).cast("long").alias("n"))}
        for name, rows in parts.items():
            sinks.write_json(rows, f"{folder}/json/{name}")
            sinks.markdown(rows, ("value", "n")).coalesce(1).write.mode("overwrite").text(f"{folder}/markdown/{name}")
        return parts

    def serve(self, asked: DataFrame) -> DataFrame:
        """asked (url) with the stored row that a viewer shows for each."""
        return viewer.looked_up(asked, self.state().queue, self.rules.site, self.rules.rewrites)

    def index(self, results: DataFrame, rebuild: bool = False) -> int:
        """Number of pages whose words are new in the index; pages with the same content are not read again."""
        place = f"{self.folder}/index"
        pages = self.bodies(results).where(urls.base_content_type("content_type").isin("text/html", "application/xhtml+xml")).withColumn("sha1", F.sha1("body"))
        if not rebuild and sinks.has_snapshot(self.spark, f"{place}/pages"):
            changed = search.changed(pages, sinks.read_snapshot(self.spark, f"{place}/pages"))
            gone = search.stale(sinks.read_snapshot(self.spark, f"{place}/pages"), self.state().queue.withColumn("path", F.col("url")))
            n = changed.count()
            if not n and not gone.limit(1).count():
                return 0
        else:
            changed, gone, n = pages, None, pages.count()
        fresh = search.documents(main_text.main_text(changed, "body", "id"), "id", "title", "text")
        postings, lengths, table = search.written_words(fresh)
        if gone is not None:
            out = gone.select(F.col("id").alias("doc_id")).unionByName(changed.select(F.col("id").alias("doc_id")))
            postings = search.refreshed(sinks.read_snapshot(self.spark, f"{place}/postings"), out, postings)
            lengths = search.refreshed(sinks.read_snapshot(self.spark, f"{place}/documents"), out, lengths)
        sinks.write_snapshot(search.by_term(postings), f"{place}/postings")
        sinks.write_snapshot(lengths, f"{place}/documents")
        steps.forget(table)
        sinks.write_snapshot(pages.select("id", "url", "sha1"), f"{place}/pages")
        return n

    def search(self, line: str, limit: int = 30, offset: int = 0) -> DataFrame:
        """(url, score) of the best pages for a line."""
        read = lambda name: sinks.read_snapshot(self.spark, f"{self.folder}/index/{name}")
        query = search.parse(line)
        if query is None:
            return self.spark.createDataFrame([], "url string, score double")
        best = search.page_of(search.ranked(read("postings"), read("documents"), query), limit, offset)
        return best.join(read("pages"), best.doc_id == F.col("id")).select("url", "score").orderBy("score", "url")

    def files(self) -> DataFrame:
        """Done rows with the place of their file."""
        rows = self.state().queue.where("status = 'done'")
        return rows.withColumn("path", urls.relative_path("url", urls.content_extension("content_type")))

    def catalog(self, folder: str) -> DataFrame:
        """Pages of the catalogue of files, written as HTML; returns the totals of each category."""
        rows = self.files().withColumns({"parent_id": F.col("parent"), "title": F.lit(None).cast("string")})
        found = reports.catalogue_files(rows)
        sinks.write_html(sinks.html_pages(reports.catalogue_pages(found)), folder)
        return reports.catalogue_totals(found)

    def video(self) -> DataFrame:
        """Players found on pages whose videos are not stored yet."""
        return self.state().embeds.where("status <> 'done'").select("url", "page_url", "status")

    def verify(self, stored: DataFrame, fix: bool = False) -> DataFrame:
        """(id, url, path, problem) of files that are missing or have another size (stored: path, length); fix queues them again."""
        problems = reports.file_check(self.files(), stored)
        if fix:
            queue = self.state().queue
            bad = problems.select("id", F.lit(True).alias("__bad"))
            marked = queue.join(bad, "id", "left")
            sinks.write_snapshot(frontier.requeued(marked, F.col("__bad")).drop("__bad"), f"{self.folder}/queue")
        return problems
