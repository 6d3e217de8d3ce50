"""Language ID by cross-parsing entropy over suffix automata of labelled text.

Training: a bounded sample of labelled text per language (SAMPLE_DOCS documents, chosen by the least hash of their id, and
of each a stretch of SAMPLE_CHARS characters at a place chosen by hash, the whole text if it is shorter) becomes one suffix
automaton per language.  Every label is learned.  Prediction: a text is parsed against every automaton into longest
matches; a phrase ends where no labelled text of the language continues it.  The language with the fewest phrases per
symbol wins.

Symbols are the UTF-8 bytes of the lower-cased letters and one symbol for a run of all else, so every script has symbols of
its own and there are never more than 256; a byte that no labelled text has is a phrase of its own.

The automata are stored sparsely: the steps of all states share one array, each state's row being shifted to where it
fits (about 1 MB a language).  Whole texts are parsed in lockstep: windows of WINDOW symbols first start at the root, then
each is parsed again from the state in which the one before it ended, until both parses are in the same state at the same
place, from where they agree; this is repeated until no end changes.  So the result is that of one parse from start to end.

Null texts and texts without a letter are `und` with score 0.  The score is 1 - best / second best phrase rate
(1 where only one language was learned), so it is 0 for a tie, which goes to the language first in order.
Without any labelled text every document is `und`.  Extra columns are ignored; repeated rows are judged alike.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import session
from .textvec import slices

SAMPLE_DOCS = 64
SAMPLE_CHARS = 600
WINDOW = 256
UNSEEN, SPACE = 0, 1
#: A text needing more phrases than this for each symbol is like no learned language; the pipeline rejects it.  SLACK
#: phrases more are allowed to any text, since a short one has few symbols to a phrase in every language.
FOREIGN, SLACK = 0.35, 5
#: Where some language has less labelled text than this, its own documents need many phrases, and only LOOSE is sure.
LEAST_CHARS, LOOSE = 6000, 0.8

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Lower-cased code point of each letter, 0 for what is no letter."""
    if not _LETTER:
        table = np.zeros(sys.maxunicode + 1, np.uint32)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(chr(c))[0] == "L":
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTER.append(table)
    return _LETTER[0]


def suffix_automaton(codes: list[int], symbols: int) -> np.ndarray:
    """Transitions [state, symbol] of the suffix automaton of codes; -1 where there is none."""
    link, length, to = [-1], [0], [{}]
    last = 0
    for c in codes:
        cur = len(to)
        link.append(0), length.append(length[last] + 1), to.append({})
        p = last
        while p != -1 and c not in to[p]:
            to[p][c] = cur
            p = link[p]
        if p != -1:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(to)
                link.append(link[q]), length.append(length[p] + 1), to.append(dict(to[q]))
                while p != -1 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    table = np.full((len(to), symbols), -1, np.int32)
    for s, row in enumerate(to):
        for c, t in row.items():
            table[s, c] = t
    return table


def packed(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells, root) of transitions [state, symbol]: cell base + symbol holds base << 32 | base of the next state, where
    base is a state's own shift (0 for the root); root is the step of each symbol from the root, -1 for none."""
    states, symbols = table.shape
    has = table >= 0
    sizes = has.sum(1)
    taken, used = np.zeros(4 * states + 4 * symbols + 1024, bool), np.zeros(4 * states + 4 * symbols + 1024, bool)
    base = np.zeros(states, np.int64)
    tight = 0
    for s in [0, *(x for x in (1 + np.argsort(-sizes[1:], kind="stable")).tolist() if sizes[x] != 1)]:
        of = np.flatnonzero(has[s])
        at = tight if s else 0
        while s:
            shifts = np.arange(at, at + 256)
            fits = np.flatnonzero(~used[at : at + 256] & ~taken[shifts[:, None] + of].any(1))
            if len(fits):
                base[s] = at + int(fits[0])
                break
            at += 256
        if at - tight > 2048:  # what is before is nearly full
            tight = at - 1024
        taken[base[s] + of] = True
        used[base[s]] = True
    # A state of one step fits at any free cell whose shift is not another state's.
    alone = 1 + np.flatnonzero(sizes[1:] == 1)
    symbol = has[alone].argmax(1)
    for c in np.unique(symbol).tolist():
        of = alone[symbol == c]
        free = c + np.flatnonzero(~taken[c:])
        free = free[~used[free - c]][: len(of)]
        base[of] = free - c
        taken[free] = used[free - c] = True
    cells = np.full(int(base.max()) + symbols, -1, np.int64)
    state, symbol = np.nonzero(has)
    cells[base[state] + symbol] = base[state] << 32 | base[table[state, symbol]]
    return cells, np.where(has[0], base[np.maximum(table[0], 0)], -1)


class Model:
    """Languages, the symbol of each byte, and one automaton per language."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        self.foreign = FOREIGN if all(sum(map(len, texts[lang])) >= LEAST_CHARS for lang in texts) else LOOSE
        self.symbol = np.zeros(256, np.uint8)
        seen = np.zeros(256, bool)
        for lang in self.languages:
            seen[self._bytes(texts[lang])[0]] = True
        seen[32] = False
        self.symbol[32] = SPACE
        self.symbol[seen] = 2 + np.arange(int(seen.sum()))
        self.symbols = 2 + int(seen.sum())
        self.tables = []
        for lang in self.languages:
            codes, _ = self.encode(texts[lang])
            self.tables.append(packed(suffix_automaton([c for text in codes for c in [*text.tolist(), SPACE]], self.symbols)))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Symbols of each text with its runs of non-letters made one, and its number of letters."""
        codes, offsets, count = self.codes(texts)
        return [codes[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], count

    @staticmethod
    def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(UTF-8 bytes of the lower-cased letters, a space for each run of all else; offsets; letters) of texts."""
        sizes = np.array([len(t) for t in texts], np.int64)
        low = letters()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        letter = low != 0
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # of a run of non-letters the first one after a letter stays
        starts = offsets[:-1][(sizes > 0)]
        keep[starts] = letter[starts]
        kept = np.where(letter, low, 32)[keep].astype(np.uint32)
        width = np.zeros(len(low) + 1, np.int64)
        width[1:][keep] = 1 + (kept > 0x7F).astype(np.int64) + (kept > 0x7FF) + (kept > 0xFFFF)
        many = np.concatenate([[0], np.cumsum(letter)])
        return np.frombuffer(kept.tobytes().decode("utf-32-le").encode(), np.uint8), np.cumsum(width)[offsets], many[offsets[1:]] - many[offsets[:-1]]

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, offsets, letters) of texts."""
        data, offsets, count = self._bytes(texts)
        return self.symbol[data], offsets, count

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases [language, text], symbols, letters) of whole texts."""
        codes, offsets, count = self.codes(texts)
        n = np.diff(offsets)
        windows = -(-n // WINDOW)
        at = np.concatenate([[0], np.cumsum(windows)])
        # Windows in order of size, the full ones first, as columns of a grid.
        size = np.full(int(at[-1]), WINDOW)
        size[at[1:][n > 0] - 1] = n[n > 0] - WINDOW * (windows[n > 0] - 1)
        order = np.argsort(-size, kind="stable")
        column = np.empty_like(order)
        column[order] = np.arange(len(order))
        grid = np.zeros((len(size), WINDOW), np.uint8)
        grid.reshape(-1)[np.arange(len(codes)) + np.repeat(at[:-1] * WINDOW - offsets[:-1], n)] = codes
        steps = np.ascontiguousarray(grid[order].T).astype(np.int64)
        size = size[order]
        follows = np.ones(len(size), bool)
        follows[at[:-1][n > 0]] = False
        before = np.where(follows, np.concatenate([[0], column[:-1]]), -1)[order]  # the window that a column goes on from
        last = column[at[1:][n > 0] - 1]
        out = np.zeros((len(self.languages), len(texts)), np.int64)
        for k, table in enumerate(self.tables):
            ended, state = self._parse(table, steps, size, before)
            ended[last] += state[last] > 0  # the phrase that the text ends
            total = np.concatenate([[0], np.cumsum(ended[column])])
            out[k] = total[at[1:]] - total[at[:-1]]
        return out, n, count

    @staticmethod
    def _parse(table: tuple[np.ndarray, np.ndarray], steps: np.ndarray, size: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases that end in each window, state behind it) where each window goes on from the one before it."""
        cells, root = table
        first, unseen = np.maximum(root, 0), (root < 0).astype(np.int32)

        def step(state: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            cell = cells.take(state + row)
            miss = cell >> 32 != state
            return np.where(miss, first.take(row), cell & 0xFFFFFFFF), np.where(miss, (state > 0) + unseen.take(row), 0)

        wide = steps.shape[1]
        states, counts = np.zeros((WINDOW, wide), np.int32), np.zeros((WINDOW, wide), np.uint8)
        state, live = np.zeros(wide, np.int64), np.searchsorted(-size, -np.arange(WINDOW), "left")
        for t in range(WINDOW):
            w = int(live[t])
            if not w:
                break
            state[:w], counts[t, :w] = step(state[:w], steps[t, :w])
            states[t, :w] = state[:w]
        changed = np.flatnonzero((before >= 0) & (state[before] > 0))
        while len(changed):
            now, at, old = state[before[changed]].copy(), changed, state[changed].copy()
            for t in range(WINDOW):
                inside = size[at] > t
                at, now = at[inside], now[inside]
                if not len(at):
                    break
                now, counts[t, at] = step(now, steps[t, at])
                apart = states[t, at] != now
                states[t, at] = now
                at, now = at[apart], now[apart]
            state[changed] = states[size[changed] - 1, changed]
            moved = np.zeros(wide + 1, bool)
            moved[changed] = state[changed] != old
            changed = np.flatnonzero((before >= 0) & moved[before])
        return counts.sum(0, dtype=np.int64), state

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language or und, score, phrases per symbol of the winner) of whole texts."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts))
        made, n, count = self.phrases(texts)
        rate = made / np.maximum(n, 1)
        best = rate.argmin(0)
        ordered = np.sort(rate, 0)
        score = 1 - ordered[0] / np.maximum(ordered[1], 1e-12) if len(ordered) > 1 else np.ones(len(texts))
        known = count > 0
        return [self.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())], np.where(known, score, 0.0), np.where(known, ordered[0], 1.0)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Learn from (doc_id, text, lang) rows that are not held out; the sample is bounded as the module says.

    The first pass reads ids and languages only; its grouped minimum keeps one row for each language and slot.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang")
    picked = rows.groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_DOCS)).alias("slot")).agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(1)).alias("h"), F.col("doc_id"))).alias("first"))
    texts: dict[str, list[str]] = {}
    ids = set()
    for r in picked.select("lang", "first.doc_id").toLocalIterator():
        texts[r["lang"]] = []
        ids.add(r["doc_id"])
    place = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int")
    wanted = docs.where(F.col("doc_id").isin(sorted(ids))).select("doc_id", "lang", F.substr("text", place + 1, F.lit(SAMPLE_CHARS)).alias("text"))
    for r in sorted(wanted.where("lang IS NOT NULL AND text IS NOT NULL").distinct().collect()) if ids else []:
        if r["lang"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            texts[r["lang"]].append(r["text"])
    return Model({k: v for k, v in texts.items() if v})


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", passing: bool = False, names: tuple[str, str, str] = ("lang_pred", "score", "phrase_rate")) -> DataFrame:
    """docs' ids (or all its columns if passing) with language, score and phrase rate of every whole text under `names`."""
    spark = docs.sparkSession
    session.arrow(spark)
    shared = spark.sparkContext.broadcast(model)
    columns = docs.columns if passing else [id_col]
    source = docs.select(F.col(text_col).cast("string").alias(session.free("text", *columns)), *[F.col(c) for c in columns])

    def run(batches):
        judge = shared.value.judge
        for batch in batches:
            for a, b in slices(batch.column(0)):
                part = batch.slice(a, b - a)
                lang, score, rate = judge([t or "" for t in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], [*batch.schema.names[1:], *names])

    schema = docs.select(*columns).schema
    for name, kind in zip(names, ("string", "double", "double")):
        schema = schema.add(name, kind)
    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session.documents(spark, sf_dir, "doc_id", "text", "lang")
    model = train(docs)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "phrase_rate")
