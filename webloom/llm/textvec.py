"""Array views of Arrow text columns, shared by the operators that read whole texts.

A text column arrives as one UTF-8 byte buffer with row offsets.  The helpers here find words,
hash them and cut work into pieces of bounded size without making a Python object per word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step handles; a single longer text is handled alone.
CHUNK_BYTES = 1 << 20

_M = (1 << 64) - 1

#: Word separators: space and \t \n \v \f \r.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Separators of normalised words: all ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer (the splitmix64 finaliser) after adding a seed."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & _M)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null rows are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def slices(column: pa.Array, most: int = CHUNK_BYTES):
    """(first, last) row ranges of about `most` bytes; a longer text makes a range of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if len(sizes) > at:
        yield at, len(sizes)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as a little-endian number; zeros follow the end."""
    padded = np.zeros(len(data) + 9, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _steps(starts: np.ndarray, ends: np.ndarray):
    """(spans with more than 8 k bytes, place of their next eight bytes, mask of the bytes that are theirs) for k = 0, 1, ..."""
    left = (ends - starts).astype(np.int64)
    live = np.flatnonzero(left > 0)
    at, left = starts[live].astype(np.int64), left[live]
    while len(live):
        yield live, at, np.uint64(_M) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8


#: Spans of more bytes are hashed one by one.
LONG = 1 << 10


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span: equal spans have equal hashes wherever they stand.

    Eight bytes at a time go through a bijective mixer after the span's length, so spans of up to eight bytes of one length
    never share a hash, and longer ones do so by chance only; there is no algebra in it that texts could hit upon.
    """
    if lower:
        data = _LOWER[data]
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64), 1)
    short = np.flatnonzero(sizes <= LONG) if len(sizes) and sizes.max() > LONG else np.arange(len(sizes))
    eight = _eights(data)
    for live, at, mask in _steps(starts[short], ends[short]):
        out[short[live]] = mix(out[short[live]] ^ (eight[at] & mask), 1)
    for k in np.flatnonzero(sizes > LONG).tolist() if len(short) < len(sizes) else ():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the first span of each kind, kind of every span): told apart by their bytes, the hash only groups them."""
    _, first, back = np.unique(spans_hash(data, starts, ends), return_index=True, return_inverse=True)
    model = first[back]
    same = ends - starts == (ends - starts)[model]
    eight = _eights(data)
    check = np.flatnonzero(same & (model != np.arange(len(starts))))
    shift = starts[model[check]] - starts[check]
    for live, at, mask in _steps(starts[check], ends[check]):
        same[check[live]] &= (eight[at] & mask) == (eight[at + shift[live]] & mask)
    if not same.all():  # spans that share a hash with another one
        kinds: dict[bytes, int] = {}
        for k in np.flatnonzero(~same).tolist():
            raw = data[starts[k] : ends[k]].tobytes()
            if raw not in kinds:
                kinds[raw] = len(first)
                first = np.append(first, k)
            back[k] = kinds[raw]
    return first, back


class Words:
    """Words ([^\\x20\\x09-\\x0D]+) of every row: starts, ends, hashes (if hashed), and rows' offsets into them;
    with ideographs each character from U+3000 to U+9FFF is a word, since they have no spaces between words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = _IS_SPACE, hashed: bool = True, ideographs: bool = False):
        n = len(data)
        solid = np.zeros(n + 2, bool)
        solid[1 : n + 1] = ~space[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        if ideographs:  # each of the characters whose three bytes begin with E3 to E9 is a word
            lead = np.flatnonzero((data >= 0xE3) & (data <= 0xE9))
            edge[lead] = edge[np.minimum(lead + 3, n)] = True
        here = solid[1 : n + 1]
        self.starts = np.flatnonzero(here & (~solid[:n] | edge[:n]))
        self.ends = np.flatnonzero(here & (~solid[2 : n + 2] | edge[1:])) + 1
        self.rows = np.searchsorted(self.starts, offsets)
        self.hashes = spans_hash(data, self.starts, self.ends, lower) if hashed else None


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, with rows' offsets into them.

    A shingle is `width` words in a row; a row of fewer words has its whole sequence as one, a row of none has none.
    """
    h, rows = words.hashes, words.rows
    counts = np.diff(rows)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_rows = np.concatenate([[0], np.cumsum(made)])
    total = int(out_rows[-1])
    first = np.repeat(rows[:-1] - out_rows[:-1], made) + np.arange(total)
    length = np.repeat(np.minimum(counts, width), made)
    s = np.zeros(total, np.uint64)
    for k in range(width):
        has = length > k
        s = np.where(has, mix(s * np.uint64(3) + h[np.minimum(first + k, max(len(h) - 1, 0))] if total else s, k), s)
    for a, b in zip(out_rows[:-1].tolist(), out_rows[1:].tolist()):
        s[a:b].sort()
    fresh = np.ones(total, bool)
    fresh[1:] = s[1:] != s[:-1]
    starts = out_rows[:-1][made > 0]
    fresh[starts] = True
    at = np.concatenate([[0], np.cumsum(fresh)])
    return s[fresh], at[out_rows]


def row_sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of values by row offsets, 0 for empty rows."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[rows[1:]] - total[rows[:-1]]


class Remembered:
    """What was made of byte strings, at most `most` of them: the ones used least lately go, half at a time."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most // 2, {}, {}

    def __len__(self) -> int:
        return len(self.new) + len(self.old)

    def many(self, keys: list[bytes]) -> list:
        """The value of each key, None where there is none."""
        values = [self.new.get(k) for k in keys]
        for i in [i for i, v in enumerate(values) if v is None]:
            values[i] = self.old.pop(keys[i], None)
            if values[i] is not None:
                self.put(keys[i], values[i])
        return values

    def put(self, key: bytes, value) -> None:
        if len(self.new) >= self.most:
            self.new, self.old = {}, self.new
        self.new[key] = value
