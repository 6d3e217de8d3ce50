"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are sequences of normalised words (runs of ASCII letters, digits and non-ASCII bytes; A-Z lowered; each
character from U+3000 to U+9FFF by itself).  An item of n words, one or more, leaks where a text holds a stretch of words
at an edit distance (words inserted, deleted, replaced) of at most n // 5 from it, a similarity of 0.8; so items of
fewer than five words leak by exact occurrences only.

1. Windows: an item is cut into n // 5 + 1 pieces.  Within the distance at least one piece is intact, so only windows
   around an occurrence of a piece can match.  A piece is looked up by PIECE words in a row of it (by all of them where
   it has fewer), the ones that are rarest in the benchmark; every shift that the distance allows is a window (of more
   than STRIDES words: every STRIDES-th part of the length).  This needs one table look-up for each word of the corpus.
2. CGK: a window of n words is embedded into 3 n symbols by a random walk: each step emits the word at the pointer and a
   random bit of (step, word) says whether the pointer moves on.  Edit distance becomes Hamming distance.
3. LSH: in WALKS independent walks, TABLES tables sample BITS positions each; a window that agrees with its item in any
   table is a candidate.  RECALL of windows at the largest distance is what the numbers are chosen for (see the tests).
4. Candidates of one item that touch are verified together: the least edit distance of the item to any stretch of their
   region, by dynamic programming, a row of the region at a time.

The benchmark is taken in blocks of BLOCK_BYTES, so what is broadcast is bounded (a longer item is a block of its own); each
block reads the texts once.  Windows are made and embedded in parts of PART_BYTES.
Defined results: null, empty and wordless texts and items match nothing; repeated items are reported for each of their ids,
repeated rows for each row.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import session
from .textvec import NOT_ALNUM, Words, mix, slices, utf8

PIECE = 3
WALKS, TABLES, BITS = 4, 24, 5
RECALL = 0.9
BLOCK_BYTES = 32 << 20
PART_BYTES = 32 << 20
#: Occurrences of pieces that are looked at together.
HITS = 1 << 17
#: An item of more words has windows at every STRIDES-th part of its length only, so at most 2 / STRIDES of them are edits more.
STRIDES = 64
#: Bytes that an item takes in a block besides its words.
ITEM_BYTES = 1200
_BLOOM = 22
_PLACES = np.random.default_rng(9).integers(0, 1 << 62, (WALKS, TABLES, BITS))


def most_edits(n: int) -> int:
    return n // 5


def words_in(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, space=NOT_ALNUM, ideographs=True)


def words_of(texts: list[str]) -> list[np.ndarray]:
    words = words_in(*utf8(pa.array(texts, pa.string())))
    return [words.hashes[a:b] for a, b in zip(words.rows[:-1].tolist(), words.rows[1:].tolist())]


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every `size` words in a row."""
    n = max(len(h) - size + 1, 0)
    out = mix(h[:n], size)
    for k in range(1, size):
        out = mix(out * np.uint64(3) + h[k : n + k], 30)
    return out


def embed(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, walk: int) -> np.ndarray:
    """[window, 3 * longest] symbols of the CGK walks over windows of words (start, size); 0 behind a window's end."""
    steps = 3 * int(sizes.max(initial=0))
    out = np.zeros((len(starts), steps), np.uint32)
    at, last = starts.copy(), starts + sizes
    limit = len(words) - 1
    for t in range(steps):
        inside = at < last
        if not inside.any():
            break
        symbol = np.where(inside, words[np.minimum(at, limit)], np.uint64(0))
        out[:, t] = symbol >> np.uint64(32)
        at += inside & ((mix(symbol, 1000 * walk + 100 + t) >> np.uint64(63)) > 0)
    return out


def sampled(made: np.ndarray, sizes: np.ndarray, walk: int) -> np.ndarray:
    """[window, TABLES] hashes of the symbols at the sampled positions of the items' sizes."""
    places = _PLACES[walk][None] % (3 * sizes[:, None, None])
    wide = places.max(initial=0) + 1
    if made.shape[1] < wide:
        made = np.pad(made, ((0, 0), (0, int(wide) - made.shape[1])))
    out = np.zeros((len(made), TABLES), np.uint64)
    for bit in range(BITS):
        out = mix(out * np.uint64(5) + np.take_along_axis(made, places[:, :, bit], 1), 31)
    return out


def _last_row(item: np.ndarray, region: np.ndarray, anywhere: bool) -> np.ndarray:
    """Edit distance of the item to the stretches of region that end at each place and begin anywhere, or at its start."""
    at = np.arange(len(region) + 1)
    row = np.zeros(len(at), np.int64) if anywhere else at.copy()
    for w in item:
        new = row + 1
        np.minimum(new[1:], row[:-1] + (region != w), out=new[1:])
        row = np.minimum.accumulate(new - at) + at
    return row


def least_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of region nearest to item; the earliest end, then the latest start, on ties."""
    row = _last_row(item, region, True)
    end = int(row.argmin())
    back = _last_row(item[::-1], region[:end][::-1], False)
    return int(row[end]), end - int(back.argmin()), end


def _blocks(sizes: np.ndarray):
    """(first, last) ranges of windows, in order of size, whose walks take about PART_BYTES."""
    at = 0
    while at < len(sizes):
        # A walk takes the longest window's steps for each.
        cost = np.arange(1, min(len(sizes) - at, PART_BYTES // 1000) + 1) * (12 * sizes[at : at + PART_BYTES // 1000] + 1000)
        stop = at + max(1, int(np.searchsorted(cost, PART_BYTES, "right")))
        yield at, stop
        at = stop


class Items:
    """A block of benchmark items, ready to be looked for."""

    def __init__(self, ids: list, texts: list[str]):
        owners = defaultdict(list)
        for i, words in zip(ids, words_of(texts)):
            if len(words):
                owners[words.tobytes()].append(i)
        self.words = sorted((np.frombuffer(k, np.uint64) for k in owners), key=len)
        self.ids = [owners[w.tobytes()] for w in self.words]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.seeds = {g: made for g in range(1, PIECE + 1) if (made := self._seeds(g)) is not None}
        joined = np.concatenate([np.zeros(1, np.uint64), *self.words])
        starts = 1 + np.cumsum(self.sizes) - self.sizes
        self.keys = np.zeros((WALKS, len(self.words), TABLES), np.uint64)
        for a, b in _blocks(self.sizes):
            for walk in range(WALKS):
                self.keys[walk, a:b] = sampled(embed(joined, starts[a:b], self.sizes[a:b], walk), self.sizes[a:b], walk)

    def _seeds(self, size: int):
        """(hashes, items, offsets, table of hash prefixes) of the pieces that are looked up by `size` words."""
        whose = [k for k, n in enumerate(self.sizes.tolist()) if min(PIECE, n // (most_edits(n) + 1)) == size]
        grams = {k: _grams(self.words[k], size) for k in whose}
        often = Counter()
        for k in whose:
            often.update(grams[k].tolist())
        seeds = []
        for k in whose:
            n, pieces, own = len(self.words[k]), most_edits(len(self.words[k])) + 1, grams[k].tolist()
            for j in range(pieces):
                first, last = j * n // pieces, (j + 1) * n // pieces - size
                o = min(range(first, last + 1), key=lambda x: (often[own[x]], x))
                seeds.append((own[o], k, o))
        if not seeds:
            return None
        seeds.sort()
        hashes = np.array([s[0] for s in seeds], np.uint64)
        bloom = np.zeros(1 << _BLOOM, bool)
        bloom[(hashes >> np.uint64(64 - _BLOOM)).astype(np.int64)] = True
        return hashes, np.array([s[1] for s in seeds], np.int64), np.array([s[2] for s in seeds], np.int64), bloom

    def windows(self, words: Words):
        """(item, row, start) of windows around occurrences of pieces, in parts and in order of item; distinct within a part."""
        for size, (hashes, items, offsets, bloom) in self.seeds.items():
            grams = _grams(words.hashes, size)
            at = np.flatnonzero(bloom[(grams >> np.uint64(64 - _BLOOM)).astype(np.int64)])
            row = np.searchsorted(words.rows, at, "right") - 1
            whole = at + size <= words.rows[row + 1]  # a piece does not reach into the next text
            at, row = at[whole], row[whole]
            low, high = np.searchsorted(hashes, grams[at], "left"), np.searchsorted(hashes, grams[at], "right")
            some = high > low
            at, row, low, total = at[some], row[some], low[some], np.cumsum((high - low)[some])
            for c in range(0, int(total[-1]) if len(total) else 0, HITS):
                # Hits c to d: one for each place and each piece that stands there.
                d = min(c + HITS, int(total[-1]))
                a, b = int(np.searchsorted(total, c, "right")), int(np.searchsorted(total, d, "left")) + 1
                n = np.diff(total[a:b], prepend=total[a - 1] if a else 0)
                hit = np.arange(c, d)
                place = np.repeat(np.arange(a, b), n)[hit - (int(total[a - 1]) if a else 0)]
                which = low[place] + hit - np.where(place > 0, total[place - 1], 0)
                item, of = items[which], row[place]
                first = at[place] - offsets[which] - words.rows[of]
                stride, edits = 1 + self.sizes[item] // STRIDES, self.sizes[item] // 5
                # Window numbers (starts over the stride) from the first to the last that the distance allows; a number may be
                # given by many hits, so their ranges are joined first.
                end = (words.rows[of + 1] - words.rows[of] - 1) // stride
                lows, highs = (np.clip((first + sign * edits) // stride, 0, end) for sign in (-1, 1))
                order = np.lexsort((lows, of, item))
                item, of, lows, highs = item[order], of[order], lows[order], highs[order]
                owner = np.cumsum(np.append(True, (item[1:] != item[:-1]) | (of[1:] != of[:-1])))
                wide = int(highs.max()) + 2
                reach = np.maximum.accumulate(highs + owner * wide) - owner * wide  # the furthest so far of the same item and row
                lows[1:] = np.where(owner[1:] == owner[:-1], np.maximum(lows[1:], reach[:-1] + 1), lows[1:])
                many = np.maximum(highs - lows + 1, 0)
                number = np.repeat(lows - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                item, of = np.repeat(item, many), np.repeat(of, many)
                yield item, of, words.rows[of] + number * (1 + self.sizes[item] // STRIDES)

    def candidates(self, words: Words) -> list[tuple[int, int, int]]:
        """(row, item, start) of windows that agree with their item in a table of some walk, in order."""
        out: set[tuple[int, int, int]] = set()
        for item, row, start in self.windows(words):
            for a, b in _blocks(self.sizes[item]):
                i, r, s = item[a:b], row[a:b], start[a:b]
                sizes = np.minimum(self.sizes[i], words.rows[r + 1] - s)
                met = np.zeros(len(i), bool)
                for walk in range(WALKS):
                    left = np.flatnonzero(~met)
                    if len(left):
                        made = sampled(embed(words.hashes, s[left], sizes[left], walk), self.sizes[i[left]], walk)
                        met[left] = (made == self.keys[walk, i[left]]).any(1)
                out.update(zip(r[met].tolist(), i[met].tolist(), s[met].tolist()))
        return sorted(out)

    def matches(self, words: Words) -> list[tuple[int, int, int, int, int]]:
        """(row, item, distance, start, end in words of the row) of verified leaks, one for each region of candidates."""
        found, group = [], []
        todo = self.candidates(words)
        for x, after in zip(todo, [*todo[1:], None]):
            group.append(x)
            n = len(self.words[x[1]])
            if after is None or after[:2] != x[:2] or after[2] > x[2] + n // 2 or x[2] > group[0][2] + 4 * n:
                row, k, _ = x
                first, end = int(words.rows[row]), int(words.rows[row + 1])
                low, high = max(group[0][2] - most_edits(n), first), min(x[2] + n + most_edits(n), end)
                distance, a, b = least_distance(self.words[k], words.hashes[low:high])
                if distance <= most_edits(n):
                    found.append((row, k, distance, low + a - first, low + b - first))
                group = []
        return found


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, distance, start_word, end_word): every verified leak of every item in every whole text."""
    spark = docs.sparkSession
    session.arrow(spark)
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = f"id {kind}, item_id {item_kind}, distance int, start_word int, end_word int"
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def looking(shared):
        def run(batches):
            items = shared.value
            for batch in batches:
                for a, b in slices(batch.column(1), 2 << 20):
                    part = batch.slice(a, b - a)
                    found = items.matches(words_in(*utf8(part.column(1))))
                    rows = [(r, i, d, s, e) for r, k, d, s, e in found for i in items.ids[k]]
                    if rows:
                        r, i, d, s, e = zip(*rows)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), pa.array(i, items.kind), *(pa.array(x, pa.int32()) for x in (d, s, e))], ["id", "item_id", "distance", "start_word", "end_word"])

        return run

    total, block, size = None, [], 0
    kind_of_item = to_arrow_type(benchmark.schema[item_col].dataType)

    def look() -> None:
        nonlocal total, block, size
        items = Items([i for i, _ in block], [t for _, t in block])
        items.kind = kind_of_item
        made = texts.mapInArrow(looking(spark.sparkContext.broadcast(items)), schema)
        total, block, size = made if total is None else total.unionByName(made), [], 0

    for r in benchmark.select(F.col(item_col).alias("i"), F.col(item_text).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").orderBy("i", "t").toLocalIterator():
        bytes_ = 5 * len(r["t"]) + ITEM_BYTES
        if block and size + bytes_ > BLOCK_BYTES:
            look()
        block.append((r["i"], r["t"]))
        size += bytes_
    if block or total is None:
        look()
    return total.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(session.documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
