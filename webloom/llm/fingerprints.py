"""Document fingerprints: SimHash over weighted words, and a search by permuted block tables.

A text's terms are its distinct lower-cased words.  A term's weight grows with its length (weights() has the rule),
since short words say little about a text, and with the root of its count in the text.  Every term's 256-bit hash votes on 256 signed
counters; the fingerprint holds the signs (a counter of 0 gives a 0 bit).  Equal texts have equal fingerprints, and the
votes are sums of integers, so their order is of no account.

likeness() is the cosine that the Hamming distance stands for, max(0, cos(pi * distance / 256)).

Defined results: null, empty and blank texts have no terms and the fingerprint of zeros; null ids come last in the order
of documents; rows that share an id are ordered by their texts; a single document is its own next one.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import session
from .textvec import Words, mix, slices, utf8

WIDTH = 256
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1)


def weights(sizes: np.ndarray) -> np.ndarray:
    """Integer weights of terms by their bytes: the square of what exceeds 2, up to 100."""
    return np.minimum(np.maximum(sizes - 2, 0), 10) ** 2 + 1


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[rows, 32] bytes of fingerprints of the rows' texts."""
    words = Words(data, offsets)
    n = len(offsets) - 1
    terms = (words.hashes & ~np.uint64(255)) | weights(words.ends - words.starts).astype(np.uint64)
    for first, last in zip(words.rows[:-1].tolist(), words.rows[1:].tolist()):
        terms[first:last].sort()
    fresh = np.ones(len(terms), bool)
    fresh[1:] = terms[1:] != terms[:-1]
    fresh[words.rows[:-1][np.diff(words.rows) > 0]] = True
    times = np.diff(np.append(np.flatnonzero(fresh), len(terms)))
    rows, terms = np.repeat(np.arange(n), np.diff(words.rows))[fresh], terms[fresh]
    heavy = (terms & np.uint64(255)) * np.rint(8 * np.sqrt(times))
    votes = np.zeros((n, WIDTH))
    base = rows * 256
    for part in range(WIDTH // 64):
        bytes_ = mix(terms, 20 + part).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            seen = np.bincount(base + bytes_[:, k], heavy, n * 256).reshape(n, 256)
            votes[:, part * 64 + k * 8 : part * 64 + k * 8 + 8] = seen @ _SIGNS
    return np.packbits(votes > 0, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines, 0 to 1, that the Hamming distances of fingerprints [rows, 32] stand for; 1 for equal ones."""
    return np.maximum(0.0, np.cos(np.pi * _ONES[a ^ b].sum(1) / WIDTH))


def _of(texts: list[str]) -> np.ndarray:
    column = pa.array(texts, pa.large_string())
    return np.concatenate([np.zeros((0, WIDTH // 8), np.uint8), *(fingerprints(*utf8(column.slice(a, b - a))) for a, b in slices(column))])


def edited(text: str, after: str) -> str:
    """The text whose last third of code points gave way to the first as many of the text after it."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def _compare(batches):
    held = None  # the last row of the batch before waits for its next one
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
        group, guest, ids, texts = (c.to_pylist() for c in table.columns)
        for first in range(0, len(texts) - 1, 500):
            at = range(first, min(first + 500, len(texts) - 1))
            yield from _rows([i for i in at if not guest[i]], group, ids, texts, at)
        held = table.slice(table.num_rows - 1)
    # The last row of a partition ends its group, so it is a guest (see beside_next).


def _rows(mine: list[int], group, ids, texts, at):
    if mine:
        here = _of(texts[at.start : at.stop + 1])
        changed = [edited(texts[i], texts[i + 1]) for i in mine]
        own, other = here[[i - at.start for i in mine]], here[[i + 1 - at.start for i in mine]]
        after = _of(changed)
        assert all(group[i] == group[i + 1] for i in mine), "a document's next one is missing"
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in mine], pa.int64()), pa.array([len(texts[i]) for i in mine], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed])]
            + [pa.array([x.tobytes().hex() for x in part]) for part in (own, after)]
            + [pa.array(likeness(own, part)) for part in (after, other)],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, guest, id, text) sorted inside partitions so that a row's next document, by descending id, is the row after it.

    Ids are cut into ranges at quantiles; each range is one part, followed by a guest, a copy of the first row of the next
    range that has rows.  What the driver holds is one number for each range.
    """
    spark = docs.sparkSession
    n = 4 * session.partitions(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cuts = sorted(set(rows.select(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n)).first()[0] or []))
    step = max(1, int(len(cuts) ** 0.5))
    coarse, fine = cuts[step - 1 :: step], cuts
    as_array = lambda x: "array(" + ",".join(f"{v}L" if v > -(1 << 63) else "-9223372036854775807L - 1L" for v in x) + ")" if x else "cast(array() as array<bigint>)"
    whole = f"size(filter({as_array(coarse)}, c -> c <= key))"
    part = F.expr(f"{whole} * {step} + size(filter(slice({as_array(fine)}, {whole} * {step} + 1, {step}), c -> c <= key))")
    rows = rows.withColumn("part", part)
    heads = sorted((r["part"], r["head"]) for r in rows.groupBy("part").agg(F.max("key").alias("head")).collect())
    guests = [(head, heads[i + 1][0] if i + 1 < len(heads) else heads[0][0]) for i, (_, head) in enumerate(heads)]
    guests = spark.createDataFrame(guests, "key bigint, beside int")
    both = rows.join(F.broadcast(guests), "key", "left").withColumn("to", F.expr("explode(CASE WHEN beside IS NULL THEN array(struct(part, false AS guest)) ELSE array(struct(part, false AS guest), struct(beside AS part, true AS guest)) END)"))
    # Ranges are dealt in turn, not by hash, so each task has as many as any other.
    shares = session.partitions(spark)
    both = both.select("to.part", "to.guest", "key", "id", "text").repartitionById(shares, F.col("part") % shares)
    return both.sortWithinPartitions("part", "guest", F.desc("key"), "text").select("part", "guest", "id", "text")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike it is to that and to the next document."""
    session.arrow(docs.sparkSession)
    return beside_next(docs, id_col, text_col).mapInArrow(_compare, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprint_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint in hex) of every row."""
    session.arrow(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes().hex() for x in fingerprints(*utf8(part.column(1)))], pa.string())], ["id", "fingerprint"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def within_radius(asked: DataFrame, stored: DataFrame, radius: int = 6, blocks: int = 8) -> DataFrame:
    """(asked, stored, distance) of distinct fingerprints in hex at most `radius` bits apart, by permuted block tables.

    The 64 hex digits are cut into `blocks` blocks.  A pair within the radius differs in at most `radius` blocks, so it
    agrees on some choice of blocks - radius others; each such choice is a table, and a pair is met in the tables whose
    blocks agree.  No pair is missed.  Both sides are folded to distinct fingerprints first: copies never multiply.
    """
    if not 0 <= radius < blocks <= 64:
        raise ValueError("0 <= radius < blocks <= 64")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = [F.concat(F.lit(f"{t}:"), *[F.substring("fingerprint", edges[k] + 1, edges[k + 1] - edges[k]) for k in chosen]) for t, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    table = lambda df, name: df.select("fingerprint").where("fingerprint IS NOT NULL").distinct().select(F.col("fingerprint").alias(name), F.explode(F.array(*keys)).alias("key"))
    words = " + ".join(f"bit_count(conv(substring(asked, {k * 8 + 1}, 8), 16, 10)::bigint ^ conv(substring(stored, {k * 8 + 1}, 8), 16, 10)::bigint)" for k in range(8))
    met = table(asked, "asked").join(table(stored, "stored"), "key").withColumn("distance", F.expr(words)).where(F.col("distance") <= radius)
    return met.select("asked", "stored", "distance").distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(session.documents(spark, sf_dir, "doc_id", "text"))
