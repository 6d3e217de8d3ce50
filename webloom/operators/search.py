"""Full-text index and search: postings, AND of words, prefixes, phrases, BM25 ranking, snippets, incremental updates.

The index is three tables: documents (doc_id, url, title, body, otitle, tokens), postings (term, doc_id, col, tf, positions),
and totals are aggregates of documents.  A query reads the postings of its own terms only: equality or a range on the
sorted term column, which the Parquet scan prunes by its statistics.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text
from ..sources import steps

COUNT_CAP = 1000
TITLE_WEIGHT, BODY_WEIGHT = 8.0, 1.0
K1, B = 1.2, 0.75
SNIPPET_TOKENS = 24
_OPENING, _CLOSING = '"«“„', '"»”“'


@dataclass(frozen=True)
class Query:
    """A phrase (exact words in a row), or words that must all occur; words of 3 letters or more count as prefixes."""

    words: tuple[str, ...]
    phrase: bool = False

    def prefix(self, word: str) -> bool:
        return not self.phrase and len(word) >= 3


def parse(asked: str) -> Query | None:
    """The query that a user's line stands for, or None if it has no word to look for."""
    line = (text.search_form(asked) or "").strip()
    words = [w.lower() for w in re.findall(r"[^\W_]+", line)]
    if len(line) > 2 and line[0] in _OPENING and line[-1] in _CLOSING:
        return Query(tuple(words), True) if words else None
    words = [w for w in words if len(w) > 1]
    return Query(tuple(words)) if words else None


def match_expression(asked: str) -> str | None:
    """The query in the notation of common full-text engines."""
    q = parse(asked)
    if q is None:
        return None
    return f'"{" ".join(q.words)}"' if q.phrase else " AND ".join(f'"{w}"' + "*" * q.prefix(w) for w in q.words)


def documents(pages: DataFrame, key: str, title: str, body: str) -> DataFrame:
    """Documents of the index with normalised words of title and body."""
    steps.arrow(pages.sparkSession)
    rows = pages.select(F.col(key).alias("doc_id"), *[F.coalesce(text.search_form_of(c), F.lit("")).alias(n) for c, n in ((title, "t"), (body, "b"))])
    return rows.select("doc_id", text.tokens(F.col("t")).alias("title_words"), text.tokens(F.col("b")).alias("body_words"))


def _listed(batches):
    """Words of whole documents as postings, grouped by sorting numbers; a last row with no term has the document's length."""
    names = ["term", "doc_id", "col", "tf", "positions"]
    for batch in batches:
        ids, length = batch.column(0), np.zeros(batch.num_rows, np.int64)
        for col, lists in (("title", batch.column(1)), ("body", batch.column(2))):
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            length += sizes
            words = lists.flatten().dictionary_encode()
            if not len(words):
                continue
            place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            key = np.repeat(np.arange(batch.num_rows), sizes) * len(words.dictionary) + words.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            ends = np.append(starts, len(key))
            row, term = np.divmod(key[starts], len(words.dictionary))
            positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(term)), ids.take(pa.array(row)), pa.repeat(col, len(row)), pa.array(np.diff(ends)), positions], names)
        none = [pa.nulls(len(ids), t) for t in (pa.string(), pa.string(), pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([none[0], ids, none[1], pa.array(length), none[2]], names)


def listed(docs: DataFrame) -> DataFrame:
    """(term, doc_id, col, tf, positions) of each row of docs by itself, and one row without a term whose tf is its length."""
    steps.arrow(docs.sparkSession)
    schema = f"term string, doc_id {dict(docs.dtypes)['doc_id']}, col string, tf bigint, positions array<int>"
    return docs.select("doc_id", "title_words", "body_words").mapInArrow(_listed, schema)


def _merged(rows: DataFrame) -> DataFrame:
    """Postings of documents that share an id as one."""
    return rows.groupBy("term", "doc_id", "col").agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, col, tf, positions) of documents."""
    return _merged(listed(docs).where("term IS NOT NULL"))


def by_term(rows: DataFrame) -> DataFrame:
    """Postings in ranges of terms, sorted, so that a query opens few row groups."""
    return rows.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")


def written_words(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, lengths, table): the texts are read into words once and written; the caller forgets the table.

    Only documents that share an id need a grouping, all others are grouped where they are read.
    """
    table = steps.written(listed(docs), "words")
    words, lengths = table.where("term IS NOT NULL"), table.where("term IS NULL").select("doc_id", F.col("tf").alias("length"))
    shared = lengths.groupBy("doc_id").count().where("count > 1")
    return words if shared.isEmpty() else _merged(words), lengths, table


def write_index(docs: DataFrame, path: str) -> None:
    """Write postings and documents; postings are range-partitioned and sorted by term, so a query opens few row groups."""
    words, lengths, table = written_words(docs)
    by_term(words).write.mode("overwrite").parquet(f"{path}/postings")
    lengths.write.mode("overwrite").parquet(f"{path}/documents")
    steps.forget(table)


def read_index(spark: SparkSession, path: str, lengths: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(postings, documents) of a written index; a query's scan reads the row groups of its terms and the columns it needs."""
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/documents") if lengths else None


def _term(word: str, prefix: bool) -> Column:
    return F.col("term").startswith(word) if prefix else F.col("term") == word


def _phrase_rows(found: DataFrame, words) -> DataFrame:
    """(doc_id, col, tf) of the places where the words follow each other."""
    names = {w: f"p{i}" for i, w in enumerate(dict.fromkeys(words))}
    rows = found.groupBy("doc_id", "col").agg(*[F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(n) for w, n in names.items()])
    back = lambda places, k: F.transform(places, lambda p: p - k)
    starts = [back(names[w], k) for k, w in enumerate(words)]
    rows = rows.where(reduce(Column.__and__, [F.col(n).isNotNull() for n in names.values()]))
    return rows.select("doc_id", "col", F.size(reduce(F.array_intersect, starts)).cast("long").alias("tf")).where("tf > 0")


def term_weights(index: DataFrame, query: Query) -> DataFrame:
    """(doc_id, t0, t1, ..) of documents with any of the query's terms: the weighted frequency of each, null if it is not there.

    One scan of the postings that any term wants, and one grouping by document.
    """
    weight = F.when(F.col("col") == "title", TITLE_WEIGHT).otherwise(BODY_WEIGHT) * F.col("tf")
    if query.phrase:
        return _phrase_rows(index.where(F.col("term").isin(*query.words)), query.words).groupBy("doc_id").agg(F.sum(weight).alias("t0"))
    wants = [_term(w, query.prefix(w)) for w in query.words]
    hits = index.where(reduce(Column.__or__, wants))
    return hits.groupBy("doc_id").agg(*[F.sum(F.when(w, weight)).alias(f"t{i}") for i, w in enumerate(wants)])


def _terms(weights: DataFrame) -> list[Column]:
    return [F.col(c) for c in weights.columns if c != "doc_id"]


def _with_all(weights: DataFrame) -> DataFrame:
    return weights.where(reduce(Column.__and__, [t.isNotNull() for t in _terms(weights)]))


def matches(index: DataFrame, query: Query) -> DataFrame:
    """(doc_id) of the documents that have all of the query's terms."""
    return _with_all(term_weights(index, query)).select("doc_id")


def ranked(index: DataFrame, lengths: DataFrame, query: Query) -> DataFrame:
    """(doc_id, score), lower is better: BM25 over title (weight 8) and body (1); a term's idf counts all documents with it.

    The number of documents, their mean length and each term's count come to the driver first: two numbers and one for a term.
    """
    count, mean = lengths.agg(F.count("*"), F.avg("length")).first()
    weights = term_weights(index, query)
    having = weights.agg(*[F.count(t) for t in _terms(weights)]).first()
    idf = [math.log((count - n + 0.5) / (n + 0.5)) for n in having]
    long = K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0))
    parts = [F.lit(x if x > 0 else 1e-6) * t * (K1 + 1) / (t + long) for x, t in zip(idf, _terms(weights))]
    return _with_all(weights).join(lengths, "doc_id").select("doc_id", (-reduce(Column.__add__, parts)).alias("score"))


def page_of(scores: DataFrame, limit: int = 30, offset: int = 0) -> DataFrame:
    return scores.orderBy("score", "doc_id").offset(offset).limit(limit)


def capped_count(index: DataFrame, query: Query, cap: int = COUNT_CAP) -> DataFrame:
    """Number of matches, counted no further than cap + 1 (the feature: a viewer shows `1000+`)."""
    return matches(index, query).limit(cap + 1).agg(F.count("*").alias("n"))


def snippet(body: str, query: Query, size: int = SNIPPET_TOKENS) -> Column:
    """A window of the body's words around the first match, matches marked; escaped for HTML."""
    words = F.split(F.regexp_replace(F.trim(body), r"\s+", " "), " ")
    plain = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    hit = lambda w: reduce(lambda a, x: a | (plain(w).startswith(x) if query.prefix(x) else plain(w) == x), query.words, F.lit(False))
    first = F.greatest(F.coalesce(F.array_position(F.transform(words, hit), True), F.lit(1)) - size // 4, F.lit(1)).cast("int")
    cut = F.array_join(F.transform(F.slice(words, first, F.lit(size)), lambda w: F.when(hit(w), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w)), " ")
    lead = F.when(first > 1, "… ").otherwise("")
    tail = F.when(F.size(words) >= first + size, " …").otherwise("")
    return text.with_marks(F.concat(lead, cut, tail))


def changed(pages: DataFrame, indexed: DataFrame, key: str = "url", mark: str = "sha1") -> DataFrame:
    """Pages that the index does not have, or has in another state of content."""
    old = indexed.select(key, F.col(mark).alias("__old"), F.lit(True).alias("__had"))
    return pages.join(old, key, "left").where(F.col("__had").isNull() | ~F.col(mark).eqNullSafe(F.col("__old"))).drop("__old", "__had")


GONE = ("redirect", "notfound", "skipped", "auth", "gone")


def stale(indexed: DataFrame, queue: DataFrame, key: str = "url") -> DataFrame:
    """Index entries whose page is unknown, gone, or done without a file or no longer HTML."""
    now = queue.select(key, F.col("status").alias("__s"), F.col("content_type").alias("__c"), F.col("path").alias("__p"))
    html = F.coalesce(F.col("__c").ilike("text/html%") | F.col("__c").ilike("application/xhtml%"), F.lit(False))
    return indexed.join(now, key, "left").where(F.col("__s").isNull() | F.col("__s").isin(*GONE) | ((F.col("__s") == "done") & (F.col("__p").isNull() | ~html))).drop("__s", "__c", "__p")


def refreshed(index: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """Postings without those of the documents gone, and with the fresh ones."""
    return index.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(fresh)
