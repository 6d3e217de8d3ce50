"""Byte-level BPE as a bounded-lookahead streaming transducer, and decoding by an incremental byte-to-text machine.

Encoding has two levels, both with a bounded look ahead:

* Text is cut into pretokens by character classes alone (letters, numbers, white space, the rest, and the seven
  contractions); whether a pretoken begins at some place is settled by a few characters on either side (NEAR at most).
* Every pretoken is a stream of bytes that goes through a window.  sufficient_lookahead() derives from the merge list how
  many bytes after a token's end can still change it; a token with that many bytes of its window after it, or with the
  stream's end in the window, is stable, is emitted and leaves the window.

streams() runs the windows of all pretokens of a batch together, round by round; each distinct pretoken is a stream
once.  The windows of a round are merged rank by rank as rows of arrays where they are narrow (LOCKSTEP), else from a heap.
Texts of more than STREAM_CHARS code points pass in stretches that end where a pretoken begins; a pretoken that fills a
stretch is fed to its window stretch by stretch, so beside the text itself memory is constant, whatever the script.

Special strings of the tokenizer file are tokens of their own, as in the library's default.  Decoding looks up each
token's bytes and feeds them to an incremental UTF-8 decoder, ill-formed bytes becoming U+FFFD.

Defined results: null and empty texts have no tokens, an empty decoded text and the SHA-256 of nothing; other columns are
ignored; repeated rows are encoded alike.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import session
from .textvec import Remembered, distinct, slices

#: Widest window in bytes that is merged as a row of an array; wider ones are merged one by one from a heap.
LOCKSTEP = 48
#: Distinct pretokens whose tokens a worker remembers, and the bytes of the longest one remembered.
KNOWN, KNOWN_BYTES = 400_000, 64
#: Code points that are handled at once.
STREAM_CHARS = 1 << 19
#: Code points on either side of a place that can decide whether a pretoken begins there.
NEAR = 8

LETTER, NUMBER, SPACE, REST = 0, 1, 2, 3
#: The characters of the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: The endings that an apostrophe takes along.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_CLASS: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Character class of every code point."""
    if not _CLASS:
        table = np.full(sys.maxunicode + 1, REST, np.uint8)
        for c in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(c))[0]
            if kind in "LN":
                table[c] = LETTER if kind == "L" else NUMBER
        table[[ord(c) for c in WHITE_SPACE]] = SPACE
        _CLASS.append(table)
    return _CLASS[0]


def pretoken_starts(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """True at each code point that begins a pretoken; `edges` are the starts of the texts in `points`."""
    n = len(points)
    kind = np.full(n + 1, SPACE, np.uint8)
    kind[:n] = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    edge[n] = True
    starts = edge.copy()
    starts[1:n] |= kind[1:n] != kind[: n - 1]
    white = kind[:n] == SPACE
    # The last white-space character before something else stands apart from the run: a space joins what follows it.
    last = white.copy()
    last[:n] &= (kind[1:] != SPACE) & ~edge[1:]
    starts[:n] |= last
    joins = np.flatnonzero(last & (points == 32))
    starts[joins + 1] = False
    # An apostrophe alone before one of the endings takes it along, unless a space has joined the apostrophe.
    marks = np.flatnonzero((points == 39) & starts[:n])
    marks = marks[marks + 1 < n]
    marks = marks[(kind[marks + 1] == LETTER) & ~edge[marks + 1]]
    if len(marks):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[marks + 1], padded[marks + 2]
        two = np.where((marks + 2 < n) & ~edge[np.minimum(marks + 2, n)], two, 0)
        takes = np.zeros(len(marks), np.int64)
        for ending in CONTRACTIONS:
            hit = (one == ord(ending[0])) & (len(ending) == 1 or two == ord(ending[-1]))
            takes[hit] = len(ending)
        marks, takes = marks[takes > 0], takes[takes > 0]
        starts[marks + 1] = False
        starts[marks + 1 + takes] = True
    return starts[:n]


def sufficient_lookahead(merges: list[tuple[int, int]], made: list[int], size: dict[int, int]) -> int:
    """Bytes after a token's end that can decide whether it stands.

    reach[r] bounds how far behind the end of merge r's bytes the text matters for whether r applies there.  It is the
    largest of: the reaches of its parts' own merges; those of earlier merges that would take its right part away with
    something behind it (plus that something's bytes); and those of earlier merges that end inside it.  Since every rule
    named is an earlier one, one pass over the list in order settles all.
    """
    reach_of: dict[int, int] = {}  # token -> reach of the merge that makes it
    takes_after: dict[int, int] = {}  # token -> bytes behind it that may take it away
    takes_before: dict[int, int] = {}  # token -> reach of merges with it as the right part
    most = 0
    for (u, v), token in zip(merges, made):
        reach = max(0, reach_of.get(v, 0), reach_of.get(u, 0) - size[v], takes_after.get(v, 0), takes_before.get(u, 0) - size[v], takes_after.get(u, 0) - size[v])
        reach_of[token] = max(reach_of.get(token, 0), reach)
        takes_after[u] = max(takes_after.get(u, 0), size[v] + reach)
        takes_before[v] = max(takes_before.get(v, 0), reach)
        most = max(most, size[v] + reach)
    return most


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: its own, or one from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class Transducer:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level BPE without a normaliser or a space in front is handled")
        vocab = spec["model"]["vocab"]
        chars = byte_characters()
        as_bytes = {token: bytes(map(chars.__getitem__, token)) for token in vocab}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        tokens = [b""] * size
        for token, k in vocab.items():
            tokens[k] = as_bytes[token]
        for token, k in self.special.items():
            tokens[k] = token.encode()
        self.tokens = tokens
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.byte_id = np.array([vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])], np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        left, right = np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs])
        made = np.array([vocab[a + b] for a, b in pairs])
        self.rank = {(a, b): (r, m) for r, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), made.tolist()))}
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        self._slots()
        self.lookahead = sufficient_lookahead(list(zip(left.tolist(), right.tolist())), made.tolist(), dict(enumerate(self.sizes.tolist())))
        self.window = max(4 * self.lookahead, 256)
        self.known = Remembered(KNOWN)
        self.emitted = 0  # tokens that left a window

    #: Rank of a pair that is no merge.
    NONE = np.int32(1 << 30)

    def _slots(self) -> None:
        """An open hash table of the pairs: pair -> rank."""
        bits = int(len(self.keys)).bit_length() + 2
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.full((1 << bits) + 64, -1, np.int64)
        self.slot_rank = np.full((1 << bits) + 64, self.NONE, np.int32)
        for key, rank, h in zip(self.keys.tolist(), self.ranks.tolist(), self._slot(self.keys).tolist()):
            while self.slot_key[h] != -1:
                h += 1
            self.slot_key[h], self.slot_rank[h] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = left.shape
        keys = (left.astype(np.int64) << 32 | right).reshape(-1)
        h = self._slot(keys)
        found = self.slot_key[h]
        out = np.where(found == keys, self.slot_rank[h], self.NONE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            h[todo] += 1
            got = self.slot_key[h[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.slot_rank[h[todo[hit]]]
            todo = todo[~hit & (got != -1)]
        return out.reshape(shape)

    def merged(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of each) of windows: all narrow ones take their lowest merge at once, wide ones go one by one."""
        sizes = ends - starts
        counts = np.zeros(len(sizes), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        bounds = [1, 2, 4, 6, 8, 12, 16, 24, 32, LOCKSTEP]
        for low, high in zip([0, *bounds[:-1]], bounds):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(rows):
                cell = np.arange(high)
                inside = cell < sizes[rows, None]
                token = np.where(inside, self.byte_id[data[np.minimum(starts[rows, None] + cell, len(data) - 1)]], -1).astype(np.int32)
                token, n = self._merge(token, sizes[rows].copy())
                counts[rows] = n
                parts.append((rows, token, n))
        wide = {k: self.merge_window(data[starts[k] : ends[k]].tobytes()) for k in np.flatnonzero(sizes > LOCKSTEP).tolist()}
        for k, ids in wide.items():
            counts[k] = len(ids)
        at = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(int(at[-1]), np.int32)
        for k, ids in wide.items():
            out[at[k] : at[k + 1]] = ids
        for rows, token, n in parts:
            used = np.arange(token.shape[1]) < n[:, None]
            out[(at[rows][:, None] + np.arange(token.shape[1]))[used]] = token[used]
        return out, counts

    def _merge(self, token: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rows of tokens (-1 behind the end) until none of a row's pairs is a merge."""
        final = token.copy()
        live = np.flatnonzero(n > 1)
        if token.shape[1] < 2 or not len(live):
            return final, n
        work = token[live]
        ranks = np.where(work[:, 1:] >= 0, self.pair_ranks(work[:, :-1], np.maximum(work[:, 1:], 0)), self.NONE)
        while len(live):
            best = ranks.min(1)
            go = best < self.NONE
            if not go.all():
                final[live[~go]] = work[~go]
                live, work, ranks, best = live[go], work[go], ranks[go], best[go]
                if not len(live):
                    break
            # The leftmost place of the lowest rank; equal ranks further right follow in later rounds.
            place = ranks.argmin(1)
            rows = np.arange(len(live))
            width = work.shape[1]
            after = np.arange(width) > place[:, None]
            moved = np.concatenate([work[:, 1:], np.full((len(live), 1), -1, np.int32)], 1)
            work = np.where(after, moved, work)
            work[rows, place] = self.made[best]
            moved = np.concatenate([ranks[:, 1:], np.full((len(live), 1), self.NONE, np.int32)], 1)
            ranks = np.where(after[:, : width - 1], moved, ranks)
            n[live] -= 1
            for beside in (place - 1, place):
                ok = np.flatnonzero((beside >= 0) & (beside < width - 1))
                a, b = work[ok, beside[ok]], work[ok, beside[ok] + 1]
                ranks[ok, beside[ok]] = np.where(b >= 0, self.pair_ranks(a, np.maximum(b, 0)), self.NONE)
        return final, n

    def merge_window(self, raw: bytes) -> list[int]:
        """Tokens of one window, lowest rank first and leftmost first, by a heap of the pairs that stand side by side."""
        ids = self.byte_id[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = [(*rank[pair], i, pair) for i, pair in enumerate(zip(ids, ids[1:])) if pair in rank]
        heapq.heapify(heap)
        while heap:
            _, token, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != pair[0] or ids[j] != pair[1]:
                continue  # one of its tokens has been merged since
            ids[i], ids[j] = token, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                pair = (token, ids[k])
                if pair in rank:
                    heapq.heappush(heap, (*rank[pair], i, pair))
            h = before[i]
            if h >= 0:
                pair = (ids[h], token)
                if pair in rank:
                    heapq.heappush(heap, (*rank[pair], h, pair))
        return [t for t in ids if t >= 0]

    def streams(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of each) of pretokens, each a stream with its own window; all windows move on in one round."""
        at, live = starts.astype(np.int64), np.arange(len(starts))
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            stop = np.minimum(ends[live], at[live] + self.window)
            over = stop == ends[live]
            ids, n = self.merged(data, at[live], stop)
            row, size = np.repeat(np.arange(len(live)), n), self.sizes[ids]
            total = np.cumsum(size)
            behind = (stop - at[live])[row] - (total - (total - size)[np.cumsum(n) - n][row])
            stable = over[row] | (behind >= self.lookahead)
            parts.append((live[row[stable]], ids[stable]))
            at[live] += np.bincount(row[stable], size[stable], len(live)).astype(np.int64)
            live = live[~over]
        owner, ids = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
        self.emitted += len(ids)
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner.astype(np.int64), minlength=len(starts))

    def stream(self, chunks):
        """Tokens of one pretoken whose bytes arrive in chunks: a token is emitted once the lookahead is behind it."""
        held = b""
        for chunk in chunks:
            held += chunk
            done = 0
            while len(held) - done >= self.window:
                part, at = held[done : done + self.window], 0
                for token in self.merge_window(part):
                    size = int(self.sizes[token])
                    if at + size + self.lookahead > len(part):
                        break
                    self.emitted += 1
                    yield token
                    at += size
                done += at
            held = held[done:]
        for token in self.merge_window(held):
            self.emitted += 1
            yield token

    def _tokens(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of each) of pretokens; each distinct one, told apart by its bytes, is a stream once and remembered."""
        first, back = distinct(data, starts, ends)
        raw = data.tobytes()
        keys = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        made = self.known.many(keys)
        new = [i for i, ids in enumerate(made) if ids is None]
        if new:
            ids, n = self.streams(data, starts[first[new]], ends[first[new]])
            whole, cuts = ids.astype("<i4").tobytes(), (4 * np.concatenate([[0], np.cumsum(n)])).tolist()
            for i, a, b in zip(new, cuts, cuts[1:]):
                made[i] = whole[a:b]
                if len(keys[i]) <= KNOWN_BYTES:
                    self.known.put(keys[i], made[i])
        n = np.array([len(ids) // 4 for ids in made], np.int64)
        flat, begin, counts = np.frombuffer(b"".join(made), "<i4"), np.cumsum(n) - n, n[back]
        total = np.cumsum(counts) - counts
        return flat[np.repeat(begin[back] - total, counts) + np.arange(int(counts.sum()))].astype(np.int64), counts

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without special strings."""
        out = [np.zeros(0, np.int64)] * len(texts)
        at = 0
        while at < len(texts):
            if len(texts[at]) > STREAM_CHARS:
                out[at] = np.concatenate([np.zeros(0, np.int64), *self._flow(texts[at])])
                at += 1
                continue
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= STREAM_CHARS):
                size += len(texts[stop])
                stop += 1
            group = texts[at:stop]
            points = _points("".join(group))
            edges = np.concatenate([[0], np.cumsum([len(p) for p in group])]).astype(np.int64)
            if len(points):
                first = np.flatnonzero(pretoken_starts(points, edges[:-1][np.diff(edges) > 0]))
                width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
                byte = np.concatenate([[0], np.cumsum(width)])
                data = np.frombuffer("".join(group).encode(), np.uint8)
                ids, n = self._tokens(data, byte[first], byte[np.append(first[1:], len(points))])
                total = np.concatenate([[0], np.cumsum(n)])
                cut = total[np.searchsorted(first, edges)]
                for k in range(len(group)):
                    out[at + k] = ids[cut[k] : cut[k + 1]]
            at = stop
        return out

    def _flow(self, text: str):
        """Ids of one text without special strings, stretch by stretch."""
        at = 0
        while len(text) - at > STREAM_CHARS:
            stretch = text[at : at + STREAM_CHARS]
            points = _points(stretch)
            begins = pretoken_starts(points, np.zeros(1, np.int64))
            # White space is cut by what follows it, so no stretch ends behind it.
            begins[1:] &= classes()[points[:-1]] != SPACE
            sure = int(np.flatnonzero(begins[: max(len(stretch) - NEAR, 0) + 1])[-1])
            if sure:
                yield self._plain([stretch[:sure]])[0]
                at += sure
            else:  # one pretoken is longer than the stretch
                end = [at]
                yield from self._arrays(self.stream(self._through(text, at, end)))
                at = end[0]
        yield self._plain([text[at:]])[0]

    @staticmethod
    def _arrays(tokens, most: int = 1 << 16):
        while len(part := np.fromiter(islice(tokens, most), np.int64)):
            yield part

    @staticmethod
    def _through(text: str, at: int, end: list[int]):
        """Bytes of the pretoken that begins at `at`, part by part; end[0] becomes the place where it ends."""
        while end[0] < len(text):
            low = max(at, end[0] - NEAR)
            stretch = text[low : end[0] + STREAM_CHARS]
            last = low + len(stretch) == len(text)
            starts = low + np.flatnonzero(pretoken_starts(_points(stretch), np.zeros(1, np.int64)))
            stop = len(text) if last else low + len(stretch) - NEAR
            starts = starts[(starts > at) & (starts >= end[0]) & (starts < stop)]
            begin, end[0] = end[0], int(starts[0]) if len(starts) else stop
            yield text[begin : end[0]].encode()
            if len(starts):
                return

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, special strings as their own tokens."""
        if not self.split or not any(s in t for t in texts for s in self.special):
            return self._plain(texts)
        plain, shape = [], []
        for text in texts:
            at, row = 0, []
            for m in self.split.finditer(text):
                row += [len(plain), self.special[m[0]]]
                plain.append(text[at : m.start()])
                at = m.end()
            row.append(len(plain))
            plain.append(text[at:])
            shape.append(row)
        ids = self._plain(plain)
        return [np.concatenate([x for k, v in enumerate(row) for x in ([ids[v]] if k % 2 == 0 else [np.array([v], np.int64)])]) for row in shape]

    def flow(self, text: str):
        """Ids of one text of any length, a stretch at a time."""
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            yield from self._flow(text[at : m.start()])
            yield np.array([self.special[m[0]]], np.int64)
            at = m.end()
        yield from self._flow(text[at:])

    def decoded(self, ids, step: int = 1 << 16):
        """Text of ids that come as arrays, part by part: their bytes go through an incremental UTF-8 decoder."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for some in ids:
            for a in range(0, len(some), step):
                part = some[a : a + step]
                n = self.sizes[part]
                before = np.cumsum(n) - n
                yield machine.decode(self.flat[np.repeat(self.at[part] - before, n) + np.arange(int(n.sum()))].tobytes())
        yield machine.decode(b"", True)

    def decode(self, ids: np.ndarray, step: int = 1 << 16) -> str:
        return "".join(self.decoded([ids], step))

    def digests(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the text decoded from them) of a text that is never held encoded."""
        count, of_ids, of_text = [0], hashlib.sha256(), hashlib.sha256()

        def ids():
            for part in self.flow(text):
                count[0] += len(part)
                of_ids.update(part.astype("<u4").tobytes())
                yield part

        for part in self.decoded(ids()):
            of_text.update(part.encode())
        return count[0], of_ids.hexdigest(), of_text.hexdigest()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


_MODELS: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    return _MODELS.get(path) or _MODELS.setdefault(path, Transducer(path))


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", outputs: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text; with outputs also ids and decoded themselves."""
    session.arrow(docs.sparkSession)

    def run(batches):
        model = transducer(tokenizer)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column(1).to_pylist()]
                if not outputs and len(texts) == 1 and len(texts[0]) > STREAM_CHARS:
                    n, of_ids, of_text = model.digests(texts[0])
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n], pa.int64()), pa.array([of_ids]), pa.array([of_text])], names)
                    continue
                ids = model.encode(texts)
                back = [model.decode(x) for x in ids]
                columns = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string())]
                if outputs:
                    columns += [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * outputs
    names = [x.split(" ")[0] for x in schema.split(", ")]
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(session.documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
