"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped edges.

1. One Arrow pass turns every whole text into its set of distinct word shingles (64-bit hashes), keyed by a 128-bit
   digest of the set, BINS one-permutation minima (densified: an empty bin copies the bin that its own fixed probe
   sequence reaches first; sets that fill so few bins that PROBES tries fail go on to the next full bin), BANDS band keys
   and a parity sketch of the set.
2. Texts with equal sets fold into one class (a grouped minimum), so copies never meet each other in a bucket.
3. In every bucket all classes are joined to one centre chosen by hash: a bucket of n gives n - 1 candidates.  Those that
   the sketches do not rule out are confirmed on the full shingle sets; confirmed edges give components.
4. A star leaves a link between two others open.  Classes of buckets that still hold several components are looked at
   again by an exact prefix filter: their shingles are put in one order, rare ones first, and two sets can only be linked if
   the smaller one has a shingle among its first n - ceil(2 p n / (100 + p)) + 1 that the other has among its first
   n - ceil(p n / 100) + 1, at places that leave room for the overlap.  Only pairs of different components meet.
   Classes that share a passage without being linked differ in rare shingles, which fill these prefixes, so a bucket
   of many such classes gives few pairs, not all of them.  Nothing is capped, and no link inside a bucket is lost.

Sketches rule out nothing that is a link: each shingle that only one of two sets has changes one bit, so the sketches differ
in at most as many bits as there are such shingles, and these are at most (|A| + |B|) * (100 - percent) / (100 + percent)
for a link.  A pair at the threshold J = 0.85 shares no bucket with probability (1 - J^ROWS)^BANDS, about 2e-7.

The order of shingles goes by how often open classes have them, counted in SLOTS slots by hash: what the driver gathers
and broadcasts is these counts, whatever the input.  Any order is exact, a good one makes few pairs.

Defined results: null, empty and blank texts have an empty set, component doc_id and kept; a row without an id has no
component and is kept; repeated rows of one doc_id are one document in a component; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import session
from .components import components
from .textvec import Words, mix, row_sums, shingles, slices, utf8

BITS = 9
BINS = 1 << BITS
ROWS = 8
BANDS = 48
#: 64-bit words of a sketch: bit h of it tells whether an odd number of the set's shingles hash to h.
SKETCH = 8
#: Slots in which shingles are counted for their order.
SLOTS = 1 << 18
#: 64-bit words of the bit set that tells which texts are worth another look.
FILTER = 1 << 19
#: Tries of an empty bin.
PROBES = 64

_PROBES = np.stack([np.random.default_rng(7).permutation(BINS * PROBES)[k * BINS : (k + 1) * BINS] % BINS for k in range(PROBES)])


def densified(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """[rows, BINS] minima by bin of sorted distinct hashes; empty bins copy the bin their probes reach first.

    The bin is the hash's top bits, so the first hash of each bin in order is its minimum.
    """
    n = len(rows) - 1
    doc = np.repeat(np.arange(n), np.diff(rows))
    bins = (values >> np.uint64(64 - BITS)).astype(np.int64)
    slot = doc * BINS + bins
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    out = np.zeros(n * BINS, np.uint64)
    full = np.zeros(n * BINS, bool)
    out[slot[first]] = values[first]
    full[slot[first]] = True
    out, full = out.reshape(n, BINS), full.reshape(n, BINS)
    some = np.diff(rows) > 0
    open_row, open_bin = np.nonzero(~full & some[:, None])
    step = 0
    while len(open_row):
        to = _PROBES[step][open_bin] if step < len(_PROBES) else (open_bin + step - len(_PROBES) + 1) % BINS
        hit = full[open_row, to]
        out[open_row[hit], open_bin[hit]] = out[open_row[hit], to[hit]]
        open_row, open_bin = open_row[~hit], open_bin[~hit]
        step += 1
    return out


def bands(minima: np.ndarray) -> np.ndarray:
    """[rows, BANDS] keys of the buckets."""
    keys = np.zeros((len(minima), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(minima), band, np.uint64)
        for k in range(ROWS):
            key = mix(key ^ minima[:, band * ROWS + k], 2)
        keys[:, band] = key
    return keys


def _signatures(width: int):
    def run(batches):
        as_list = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(x).reshape(-1)))
        for part, values, rows in _shingled(batches, width):
            sizes = np.diff(rows)
            digests = [row_sums(mix(values, seed), rows).view(np.int64) for seed in (11, 12)]
            keys = bands(densified(values, rows))
            bit = np.repeat(np.arange(len(sizes)), sizes) * (SKETCH * 64) + (mix(values, 3) % np.uint64(SKETCH * 64)).astype(np.int64)
            odd = (np.bincount(bit, minlength=len(sizes) * SKETCH * 64) & 1).astype(np.uint8).reshape(len(sizes), SKETCH * 64)
            bits = np.packbits(odd, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(digests[0]), pa.array(digests[1]), as_list(keys.view(np.int64)), as_list(bits)], ["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"])

    return run


#: Where the bit of an id is.
_PLACE = (f"cast(pmod(xxhash64(doc_id), {FILTER}) AS int) AS word", "cast(shiftrightunsigned(xxhash64(doc_id), 58) AS int) AS bit")


def _filter(ids: DataFrame):
    """A broadcast set of bits: that of each doc_id is set.  Its size is fixed, so with very many ids it lets others pass
    too; the joins behind it drop them.  It spares the texts a shuffle."""
    bits = ids.selectExpr(*_PLACE).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    out = np.zeros(FILTER, np.int64)
    out[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(out)


def _chosen(texts: DataFrame) -> DataFrame:
    """(doc_id, text, word, bit): the texts with the place of their id in a filter."""
    return texts.where("doc_id IS NOT NULL").selectExpr("doc_id", "text", *_PLACE)


def _shingled(batches, width: int, shared=None):
    """(rows, their shingles, offsets) of batches (doc_id, text, ...), in parts of bounded bytes; only those in the filter."""
    for batch in batches:
        if shared is not None:
            word, bit = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            batch = batch.filter(pa.array((shared.value[word] >> bit & 1).astype(bool)))
        for a, b in slices(batch.column(1)):
            part = batch.slice(a, b - a)
            yield part, *shingles(Words(*utf8(part.column(1))), width)


def _sets(width: int, shared):
    def run(batches):
        for part, values, rows in _shingled(batches, width, shared):
            raw = values.tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([raw[x * 8 : y * 8] for x, y in zip(rows[:-1].tolist(), rows[1:].tolist())], pa.binary())], ["doc_id", "shingles"])

    return run


def _slot(values: np.ndarray) -> np.ndarray:
    return (mix(values, 4) % np.uint64(SLOTS)).astype(np.int64)


def _counts(width: int, shared):
    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for _, values, _ in _shingled(batches, width, shared):
            total += np.bincount(_slot(values), minlength=SLOTS)
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(total[slots])], ["slot", "n"])

    return run


def prefixes(values: np.ndarray, rows: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, place) of the first n - ceil(percent n / 100) + 1 shingles of every set in the common order."""
    n = np.diff(rows)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((values, often[_slot(values)], owner))
    place = np.arange(len(values)) - np.repeat(rows[:-1], n)
    first = place < (n + (-percent * n) // 100 + 1)[owner]
    return owner[first], values[order][first], place[first]


def _tokens(width: int, percent: int, shared, often):
    def run(batches):
        for part, values, rows in _shingled(batches, width, shared):
            owner, token, place = prefixes(values, rows, often.value, percent)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), part.column(0).take(pa.array(owner)), pa.array(place)], ["token", "doc_id", "place"])

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = np.zeros(len(left), bool)
            for i in range(len(left)):
                x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = np.sort(np.concatenate([x, y]))
                    common = int((both[1:] == both[:-1]).sum())
                    keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): linked are texts with 100 * |A & B| >= percent * |A | B| on their
    distinct `width`-word shingles; component_id is the smallest id reached, kept marks the one that stays."""
    session.arrow(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = session.written(texts.mapInArrow(_signatures(width), "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>, sketch array<bigint>"), "signatures")
    some = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    least = some.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    sketches = [F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH)]
    reps = some.join(least, ["k1", "k2", "doc_id"]).select("doc_id", "k1", "k2", "copies", F.col("n_shingles").alias("n"), "bands", *sketches)
    reps = session.written(reps.dropDuplicates(["doc_id", "k1", "k2"]), "representatives")

    shared = _crowded(reps).join(reps.drop("bands", "k1", "k2", "copies", "n"), "doc_id")
    shared = session.written(shared, "buckets")
    centres = shared.where(F.xxhash64("doc_id", "bucket") == F.col("chosen"))
    stars = shared.alias("l").join(centres.alias("r"), F.expr(f"l.bucket = r.bucket AND l.doc_id <> r.doc_id AND {_likely('l', 'r', percent)}"))
    links = _confirmed(stars.select("l.doc_id", "r.doc_id").toDF("a", "b"), texts, width, percent)
    together = components(links)
    more = _between(shared, together, texts, width, percent)
    session.forget(shared, links)
    if more is not None:
        together = components(together.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    moved = reps.join(together, reps.doc_id == together.node, "left").where("copies > 1 OR node IS NOT NULL")
    moved = moved.select("k1", "k2", F.coalesce("component", "doc_id").alias("component"))
    same = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    placed = found.join(moved, ["k1", "k2"], "left").select("doc_id", "n_shingles", same.alias("component_id"))
    return placed.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _likely(one: str, two: str, percent: int) -> str:
    """Condition that every link fulfils: sizes fit, and the sketches differ in few enough bits."""
    unlike = " + ".join(f"bit_count({one}.s{k} ^ {two}.s{k})" for k in range(SKETCH))
    return f"100 * least({one}.n, {two}.n) >= {percent} * greatest({one}.n, {two}.n) AND ({unlike}) * {100 + percent} <= ({one}.n + {two}.n) * {100 - percent}"


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are linked."""
    pairs = session.written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = session.written(_chosen(texts).mapInArrow(_sets(width, _filter(ends)), "doc_id bigint, shingles binary"), "sets")
    one, two = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    links = session.written(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a bigint, b bigint"), "links")
    session.forget(pairs, sets)
    return links


def _crowded(reps: DataFrame) -> DataFrame:
    """(bucket, doc_id, n, chosen): rows of the buckets with two classes or more; chosen is their least hash."""
    rows = reps.select(F.explode("bands").alias("bucket"), "doc_id", "n")
    counts = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min(F.xxhash64("doc_id", "bucket")).alias("chosen")).where("members > 1")
    return session.joined_back(rows, counts.drop("members"), "bucket")


def _between(shared: DataFrame, together: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Links (a, b) between different components in buckets that hold several of them; None where no bucket does."""
    spark = shared.sparkSession
    label = shared.join(together, shared.doc_id == together.node, "left").select("bucket", "doc_id", "n", *[f"s{k}" for k in range(SKETCH)], F.coalesce("component", "doc_id").alias("comp"))
    mixed = label.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    left = session.written(session.joined_back(label, mixed.select("bucket"), "bucket").drop("bucket").dropDuplicates(["doc_id"]), "open")
    if left.isEmpty():
        session.forget(left)
        return None
    shared, texts = _filter(left), _chosen(texts)
    often = np.zeros(SLOTS, np.int64)
    counted = texts.mapInArrow(_counts(width, shared), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    tokens = texts.mapInArrow(_tokens(width, percent, shared, spark.sparkContext.broadcast(often)), "token bigint, doc_id bigint, place bigint")
    tokens = tokens.join(left.select("doc_id", "n", "comp"), "doc_id").withColumn("indexed", F.expr(f"place <= n + floor(-2 * {percent} * n / {100 + percent})"))
    tokens = session.written(tokens, "tokens")
    met = tokens.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("indexed").alias("some")).where("low <> high AND some")
    rows = session.joined_back(tokens, met.select("token"), "token").join(left.drop("comp", "n"), "doc_id")
    rows = session.written(rows, "met")
    # Components meet first, so that the many members of one are never paired with each other.
    sides = session.written(rows.groupBy("token", "comp").agg(F.count("*").alias("size"), F.sum(F.col("indexed").cast("long")).alias("indexed")), "sides")
    cross = sides.where("indexed > 0").select("token", F.col("comp").alias("one"), F.col("indexed").alias("n1")).join(sides.select("token", F.col("comp").alias("two"), F.col("size").alias("n2")), "token").where("one <> two")
    fits = f"l.n <= r.n AND least(l.n - l.place, r.n - r.place) * {100 + percent} >= {percent} * (l.n + r.n) AND {_likely('l', 'r', percent)}"
    index, probe = rows.where("indexed").withColumnRenamed("comp", "one"), rows.withColumnRenamed("comp", "two")
    # The smaller side of two components takes its members first; the other side's join lets only likely pairs through.
    few = cross.where("n1 <= n2").join(index, ["token", "one"]).alias("l").join(probe.alias("r"), F.expr(f"l.token = r.token AND l.two = r.two AND {fits}"))
    many = cross.where("n1 > n2").join(probe, ["token", "two"]).alias("r").join(index.alias("l"), F.expr(f"l.token = r.token AND l.one = r.one AND {fits}"))
    pairs = few.select("l.doc_id", "r.doc_id").toDF("a", "b").union(many.select("l.doc_id", "r.doc_id").toDF("a", "b"))
    more = _confirmed(pairs, texts.select("doc_id", "text"), width, percent)
    session.forget(tokens, rows, sides, left)
    return None if more.isEmpty() else more


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(session.documents(spark, sf_dir, "doc_id", "text"), percent=85, width=3)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, w.b FROM reached r JOIN ways w ON w.a = r.c),
least AS (SELECT d, min(c) AS c FROM reached GROUP BY d)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM sizes JOIN least ON d = doc_id
"""
