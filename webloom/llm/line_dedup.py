"""Line dedup: a suffix array over line-ID sequences by prefix doubling; later copies of repeated line runs are deleted.

Only DataFrame functions are used.  A run of whole lines with LEAST_WORDS words or more (a line's words are its spaces plus
one, none in an empty line) that occurred earlier, in the order of (doc_id, line number), is deleted: what goes is exactly
the later copies of all maximal repeated runs.  A passage is the shortest run from a line on that has LEAST_WORDS words;
every repeated run is a union of repeated passages but for its last lines, which are followed up from its passages.  With
whole_runs=False only passages are deleted, so these last lines can stay.

1. Lines become IDs.  IDs that occur once are unique suffixes already and leave; the others get ranks.
2. Doubling: the rank of a suffix by its first 2^(k+1) lines is the rank of its pair (rank by 2^k lines here, rank by 2^k
   lines 2^k further on).  Ranks are places in a distributed sort of the distinct pairs: the pairs are range-partitioned and
   sorted, and their increasing row ids are the ranks, so ranks order the suffixes as a suffix array does.  Pairs that
   occur once leave, so each round works on what is still repeated.
3. Suffixes that agree on their passage's n lines form an interval of longest common prefix n or more.  With 2^k <= n < 2^(k+1)
   the pair (rank by 2^k here, rank by 2^k at n - 2^k) names the interval.  Its earliest suffix stays, the passages of
   the others are deleted.
4. Whole runs: an occurrence is lengthened line by line while the lines behind its first have fewer than LEAST_WORDS
   words (what reaches further holds the next line's passage).  Occurrences of one passage that agree on the added lines,
   by sums of hashes of (line, place), are copies of the longer run.

Groups are reduced before they are shuffled and joined back, so a line or passage that a third of the corpus holds is never
gathered in a task.  Defined results: null texts stay null; texts without a repeated passage stay as they are; a
text all of whose lines go becomes empty; rows with equal id and text are one document (treated alike, never each other's
copies); rows with one id and different texts are ordered by a hash of the text; a null id comes first; other columns are
kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import session

LEAST_WORDS = 50
_DOC = ["key", "tie"]


def _key(id_col: str, text_col: str) -> list:
    """Columns that tell documents apart and give their order."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64(F.col(text_col)).alias("tie")]


def _ranks(keys: DataFrame, columns: list[str]) -> DataFrame:
    """keys with `rank`: row ids that increase in the order of the columns."""
    n = session.partitions(keys.sparkSession)
    return keys.repartitionByRange(n, *columns).sortWithinPartitions(*columns).withColumn("rank", F.monotonically_increasing_id())


def _repeated(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1").drop("n")


def passages(docs: DataFrame, id_col: str, text_col: str, least_words: int, whole_runs: bool, used: list[DataFrame]) -> DataFrame:
    """(key, tie, pos, last, rank and, with whole_runs, until) of lines that occur more than once: the place of each, and where its passage ends.

    last is null where the repeated lines end before the passage has its words.  From the line behind pos to until, the
    repeated lines have fewer than least_words words.  The written tables that this reads are added to `used`.
    """
    lines = docs.where(F.col(text_col).isNotNull()).select(*_key(id_col, text_col), F.col(text_col).alias("text")).select(*_DOC, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    words = F.expr("IF(line = '', 0, length(line) - length(replace(line, ' ', '')) + 1)")
    lines = session.written(lines.select(*_DOC, "pos", F.xxhash64("line").alias("a"), F.hash("line").alias("b"), words.alias("words")), "lines")
    ids = session.written(_ranks(_repeated(lines, ["a", "b"]), ["a", "b"]), "line-ids")
    used += [lines, ids]
    found = lines.join(ids, ["a", "b"]).select(*_DOC, "pos", "words", "rank").distinct()
    by_doc = Window.partitionBy(*_DOC).orderBy("pos")
    found = found.withColumn("run", F.col("pos") - F.row_number().over(by_doc))
    so_far = Window.partitionBy(*_DOC).orderBy("run", "pos").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("before", F.coalesce(F.sum("words").over(so_far), F.lit(0)))
    ahead = Window.partitionBy(*_DOC, "run").orderBy("before").rangeBetween(0, least_words - 1)
    behind = Window.partitionBy(*_DOC, "run").orderBy(F.col("before") + F.col("words")).rangeBetween(0, least_words - 1)
    found = found.withColumns({"last": F.max("pos").over(ahead), "reached": F.max(F.col("before") + F.col("words")).over(ahead)})
    until = [F.max("pos").over(behind).alias("until")] if whole_runs else []
    return found.select(*_DOC, "pos", F.expr(f"IF(reached - before >= {least_words}, last, null)").alias("last"), *until, "rank")


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, whole_runs: bool = False) -> DataFrame:
    """(key, tie, pos, last): passages (or, with whole_runs, runs) from line pos to line last that occurred earlier."""
    level, out, until = 0, [], ["until"] if whole_runs else []
    used: list[DataFrame] = []
    lines = rows = session.written(passages(docs, id_col, text_col, least_words, whole_runs, used), "suffixes-0")
    session.forget(*used)
    while True:
        width = 1 << level
        behind = lambda n: F.first("rank").over(Window.partitionBy(*_DOC).orderBy("pos").rangeBetween(n, n))
        # Suffixes whose passage has width to 2 * width - 1 lines are settled by two ranks of width lines that overlap.
        # The place of the second rank differs by suffix, so it is looked up by a join on (document, place).
        settled = rows.where(f"last - pos + 1 BETWEEN {width} AND {2 * width - 1}").select(*_DOC, "pos", "last", *until, F.col("rank").alias("x"), (F.col("last") - width + 1).alias("at"))
        named = settled.join(rows.select(*_DOC, F.col("pos").alias("at"), F.col("rank").alias("y")), [*_DOC, "at"]).select(*_DOC, "pos", "last", *until, "x", "y", (F.col("last") - F.col("pos") + 1).alias("lines"))
        first = named.groupBy("lines", "x", "y").agg(F.min(F.struct(*_DOC, "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        held = session.joined_back(named, first, "lines", "x", "y").withColumn("copy", F.struct(*_DOC, "pos") > F.col("first"))
        held = held.select(*_DOC, "pos", "last", "until", "lines", "x", "y", "copy") if whole_runs else held.where("copy").select(*_DOC, "pos", "last")
        # Written by level: to plan all levels at once fills the driver's memory, however small the input.
        out.append(session.written(held, f"passages-{level}"))
        if not rows.where(f"last - pos + 1 >= {2 * width}").limit(1).count():
            if rows is not lines:
                session.forget(rows)
            held = session.as_one(out)
            return _with_longer(held, lines) if whole_runs else held
        pairs = rows.withColumn("next", behind(width)).where("next IS NOT NULL")
        ranks = session.written(_renamed(_repeated(pairs, ["rank", "next"])), f"ranks-{level}")
        shorter, rows = rows, session.written(pairs.join(ranks, ["rank", "next"]).select(*_DOC, "pos", "last", *until, F.col("to").alias("rank")), f"suffixes-{level + 1}")
        session.forget(ranks, *([] if shorter is lines else [shorter]))
        level += 1


def _with_longer(held: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, tie, pos, last) of the copies among the occurrences of repeated passages, and of the longer runs from them."""
    added = held.where("until > last").select(*_DOC, "pos", "last", "lines", "x", "y", F.explode(F.sequence(F.col("last") + 1, F.col("until"))).alias("at"))
    added = added.join(lines.select(*_DOC, F.col("pos").alias("at"), F.col("rank").alias("line")), [*_DOC, "at"]).withColumn("more", F.col("at") - F.col("last"))
    so_far = Window.partitionBy(*_DOC, "pos").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # 40 bits each, so that the sums of eight million lines fit.
    added = added.withColumns({n: F.sum(F.shiftrightunsigned(F.xxhash64("line", "more", F.lit(seed)), 24)).over(so_far) for n, seed in (("s", 1), ("t", 2))})
    name = ["lines", "x", "y", "more", "s", "t"]
    first = added.groupBy(*name).agg(F.min(F.struct(*_DOC, "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    longer = session.joined_back(added, first, *name).where(F.struct(*_DOC, "pos") > F.col("first")).groupBy(*_DOC, "pos").agg(F.max("at").alias("last"))
    return held.where("copy").select(*_DOC, "pos", "last").union(longer)


def _renamed(pairs: DataFrame) -> DataFrame:
    """(rank, next, to): to is the place of the pair in the order of pairs."""
    made = _ranks(pairs.select(F.col("rank").alias("x"), F.col("next").alias("y")), ["x", "y"])
    return made.select(F.col("x").alias("rank"), F.col("y").alias("next"), F.col("rank").alias("to"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, count_col: str = "lines_deleted", whole_runs: bool = True) -> DataFrame:
    """docs with later copies of maximal repeated runs (or only of passages) cut out of the text, and their number of lines as
    count_col, which takes the place of a column of that name."""
    key, tie, cut = (session.free(n, *docs.columns) for n in ("key", "tie", "cuts"))
    copies = later_copies(docs, id_col, text_col, least_words, whole_runs)
    by_doc = Window.partitionBy(*_DOC).orderBy("pos", "last")
    # Passages that touch or overlap become one cut.
    reach = F.max("last").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    cuts = copies.withColumn("fresh", F.when(F.col("pos") <= reach + 1, 0).otherwise(1)).withColumn("cut", F.sum("fresh").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    cuts = cuts.groupBy(*_DOC, "cut").agg(F.min("pos").alias("a"), F.max("last").alias("b"))
    cuts = cuts.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("cuts"))
    own = dict(zip((key, tie), _key(id_col, text_col)))
    joined = docs.withColumns(own).join(cuts.withColumnsRenamed({"key": key, "tie": tie, "cuts": cut}), [key, tie], "left")
    # What lies between the cuts: from the end of one to the start of the next.
    kept = F.expr(f"""
        transform(array(split({_quoted(text_col)}, '\\n', -1)), line ->
            array_join(flatten(transform(
                arrays_zip(concat(array(0), transform({cut}, c -> c.b + 1)), concat(transform({cut}, c -> c.a), array(size(line)))),
                g -> slice(line, g.`0` + 1, greatest(g.`1` - g.`0`, 0)))), '\\n'))[0]""")
    deleted = F.expr(f"coalesce(aggregate({cut}, 0, (n, c) -> n + c.b - c.a + 1), 0)")
    text = F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(kept).alias(text_col)
    return joined.select(*[text if c == text_col else F.col(c) for c in docs.columns if c != count_col], deleted.alias(count_col))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(session.documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "text", "lines_deleted")


ORACLE = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
    FROM documents WHERE text IS NOT NULL),
counted AS (SELECT *, CASE WHEN line = '' THEN 0 ELSE length(line) - length(replace(line, ' ', '')) + 1 END AS words FROM lines),
summed AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM counted),
ended AS (
    SELECT doc_id, pos, before, max(pos) OVER w AS last, max(before + words) OVER w AS reached, max(pos) OVER v AS until
    FROM summed WINDOW w AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND {LEAST_WORDS - 1} FOLLOWING),
                       v AS (PARTITION BY doc_id ORDER BY before + words RANGE BETWEEN CURRENT ROW AND {LEAST_WORDS - 1} FOLLOWING)),
runs AS (SELECT doc_id, pos, unnest(range(last, greatest(last, until) + 1)) AS last FROM ended WHERE reached - before >= {LEAST_WORDS}),
passages AS (
    SELECT r.doc_id, r.pos, r.last, array_to_string(string_split(d.text, chr(10))[r.pos + 1 : r.last + 1], chr(10)) AS passage
    FROM runs r JOIN documents d USING (doc_id)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY doc_id, pos) AS copy FROM passages),
copies AS (SELECT doc_id, pos, max(last) AS last FROM numbered WHERE copy > 1 GROUP BY ALL),
covered AS (
    SELECT l.doc_id, l.pos, l.line, coalesce(max(c.last) OVER (PARTITION BY l.doc_id ORDER BY l.pos), -1) >= l.pos AS gone
    FROM lines l LEFT JOIN copies c ON c.doc_id = l.doc_id AND c.pos = l.pos)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(c.line, chr(10) ORDER BY c.pos) FILTER (NOT c.gone), '') END AS text,
       (count(*) FILTER (c.gone))::INTEGER AS lines_deleted
FROM documents d LEFT JOIN covered c USING (doc_id) GROUP BY d.doc_id, d.text
"""
