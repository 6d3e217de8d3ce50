"""Personal data: fixed patterns for four kinds, and a skip-chain conditional random field that adds spans to them.

The field's nodes are the tokens that could be personal (HOT digits or more, an @, letters mixed with digits at length, or
touched by a base span) and their NEAR neighbours; all other tokens are outside by definition.  Chain edges join
neighbours; skip edges join each token to the next one in the document with the same content (equal last digits, equal
text, equal part before the @), so a number, address or secret that is plain in one place is recognised where it is bare or
abbreviated in another.  Labels are settled by loopy sum-product message passing over all documents of a batch at
once.  Weights are learned here by pseudo-likelihood on sentences that sentences() invents.

Besides the four kinds the field knows secrets (keys, tokens, passwords); they have columns of their own.  What it adds to
the base patterns: numbers of card length whose check digit is wrong, card numbers in groups, phone numbers without
their country, and later short mentions of what is plain elsewhere in the document.

A text of more than WINDOW characters goes through the field in windows cut at white space, forth and back: skip edges
reach across windows as messages kept for each content, chain edges and neighbours do not.  So memory is bounded beside
the text itself and a few numbers for each of its tokens.

The base spans always stay; a run of tokens with a label at SURE probability or more, outside base spans, is added.
Defined results: null, empty and blank texts have no spans and the SHA-256 of nothing; extra columns are ignored; repeated
rows are judged alike; texts of any length are read whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import session
from .textvec import mix, slices, spans_hash, utf8

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS, "secret")
NEAR = 2
#: Digits that make a token worth a look.
HOT = 4
#: Length from which letters mixed with digits may be a secret.
MIXED = 16
SURE = 0.7
ROUNDS = 12
#: Characters of a long text that go through the field at once.
WINDOW = 1 << 18

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is taken whole or not at all, so a long run costs its length once.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping e-mail spans.  The part before the @ cannot hold one, so each @ is tried once."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at)):
            yield begin, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)  # characters before this @ belong to no later local part
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the spans of the fixed patterns, in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{LABELS[k + 1]}:{a}:{b}" for a, k, b in spans)


#: Words before a token that hint at a kind (own choice).
CUES = {
    "mail": 0, "email": 0, "e-mail": 0, "write": 0, "ip": 1, "host": 1, "server": 1, "card": 2, "visa": 2, "credit": 2,
    "tel": 3, "phone": 3, "call": 3, "mobile": 3, "fax": 3, "token": 4, "key": 4, "secret": 4, "password": 4, "passwd": 4, "apikey": 4, "api_key": 4,
}
_DIGITS = (0, 2, 5, 6, 9, 13, 15, 16, 19)
_TRAILING, _LEADING = (np.array([c < 128 and not chr(c).isalnum() and chr(c) not in kept for c in range(129)]) for kept in (")", "+("))
_PLAIN = np.array([chr(c).isalnum() and c < 128 or chr(c) in "+/_=-" for c in range(129)])
_WHITE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


def _eight(word: str) -> int:
    return int.from_bytes(word.encode().ljust(8, b"\0"), "little")


class Nodes:
    """Nodes of texts: their places, base kinds, features, chain edges and content keys.

    base: (text, start, kind, end) of base spans as an array, sorted by text.
    """

    def __init__(self, texts: list[str], base: np.ndarray):
        whole = "\n".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])[: len(texts)]
        n = len(points)
        low = np.minimum(points, 128).astype(np.uint8)
        low[(low >= 65) & (low <= 90)] += 32
        solid = np.zeros(n + 2, bool)
        solid[1 : n + 1] = ~_WHITE[np.minimum(points, 0x3001)]
        starts, ends = np.flatnonzero(solid[1:] & ~solid[:-1]), np.flatnonzero(solid[:-1] & ~solid[1:])
        digit = (low >= 48) & (low <= 57)
        count = lambda mask: (lambda c: c[ends] - c[starts])(np.concatenate([[0], np.cumsum(mask)]))
        digits, ats = count(digit), count(low == 64)
        letters = count((low >= 97) & (low <= 122))
        text = np.searchsorted(at, starts, "right") - 1
        based = np.zeros(len(starts), np.int64)
        for kind in range(len(KINDS), 0, -1):
            of = base[base[:, 2] == kind - 1]
            a, b = of[:, 1] + at[of[:, 0]], of[:, 3] + at[of[:, 0]]
            next_ = np.searchsorted(b, starts, "right")
            inside = next_ < len(b)
            inside[inside] = a[next_[inside]] < ends[inside]
            based[inside] = kind
        # Trimmed ends: the last character in front of closing marks, the first one behind opening marks.
        place = np.arange(n)
        last = np.maximum.accumulate(np.where(_TRAILING[low], -1, place)) if n else place
        first = np.minimum.accumulate(np.where(_LEADING[low], n, place)[::-1])[::-1] if n else place
        self_start, self_end = first[starts] if len(starts) else starts, last[ends - 1] + 1 if len(ends) else ends
        blank = (self_start >= self_end) | (self_end <= starts) | (self_start >= ends)
        self_start, self_end = np.where(blank, starts, self_start), np.where(blank, ends, self_end)
        size = self_end - self_start
        plain = np.concatenate([[0], np.cumsum(_PLAIN[low])])
        mixed = (digits > 1) & (letters > 1) & (ats == 0) & (size >= MIXED) & (plain[self_end] - plain[self_start] == size)
        hot = (digits >= HOT) | (ats > 0) | (based > 0) | mixed
        keep = hot.copy()
        for k in range(1, NEAR + 1):
            keep[k:] |= hot[:-k] & (text[k:] == text[:-k])
            keep[:-k] |= hot[k:] & (text[k:] == text[:-k])
        cue = np.full(len(starts), -1)
        short = np.flatnonzero((size <= 8) & (digits == 0))
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = low
        eights = np.ndarray(n + 1, "<u8", padded, strides=(1,))[self_start[short]] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.clip(size[short], 1, 8)).astype(np.uint64)))
        for word, kind in CUES.items():
            cue[short[eights == _eight(word)]] = kind
        hints = np.zeros((len(starts), len(LABELS) - 1), bool)
        for k in range(1, 4):
            some = np.flatnonzero((cue[:-k] >= 0) & (text[k:] == text[:-k])) if len(cue) > k else np.zeros(0, np.int64)
            hints[some + k, cue[some]] = True
        i = np.flatnonzero(keep)
        self.text, self.start, self.end, self.based = text[i], self_start[i] - at[text[i]], self_end[i] - at[text[i]], based[i]
        self.digits = digits[i]
        self.chain = np.flatnonzero((np.diff(i) == 1) & (np.diff(self.text) == 0))
        dots, lead = count(low == 46)[i], low[starts[i]] if n else low[i]
        columns = [np.ones(len(i)), *(np.searchsorted(_DIGITS, digits[i]) == k for k in range(len(_DIGITS) + 1))]
        columns += [ats[i] > 0, digits[i] == size[i], (dots == 3) & (digits[i] >= 4), lead == 43, lead == 40, (count(low == 45)[i] > 0) & (digits[i] > 0), letters[i] > 0]
        columns += [*(based[i] == k for k in range(len(KINDS) + 1)), *hints[i].T, (digits[i] > 0) & (dots > 0), mixed[i], (lead == 34) | (lead == 39)]
        self.features = np.stack(columns, 1).astype(np.float32)
        # Content keys: the last four digits; the text, or what is before the @.
        where = np.flatnonzero(digit)
        upto = np.concatenate([[0], np.cumsum(digit)])[ends[i]]
        value = np.zeros(len(i), np.uint64)
        four = digits[i] >= 4
        for k in range(4):
            value[four] = value[four] * np.uint64(10) + (low[where[upto[four] - 4 + k]] - 48).astype(np.uint64)
        next_at = np.minimum.accumulate(np.where(low == 64, place, n)[::-1])[::-1] if n else place
        stop = np.where(ats[i] > 0, np.maximum(next_at[np.minimum(self_start[i], max(n - 1, 0))] if n else 0, self_start[i]), self_end[i])
        named = (ats[i] > 0) | ((size[i] >= 6) & (digits[i] > 0) & (letters[i] > 0))
        wide = np.where((points >= 65) & (points <= 90), points + 32, points).astype("<u4").view(np.uint8)
        names = spans_hash(wide, 4 * self_start[i][named], 4 * np.maximum(stop, self_start[i])[named])
        self.entry = np.concatenate([np.flatnonzero(four), np.flatnonzero(named)])
        keys = np.concatenate([mix(value[four], 5), mix(names, 6)])
        self.key = mix(keys ^ mix(self.text[self.entry].astype(np.uint64), 7), 8)
        order = np.lexsort((self.entry, self.key))
        self.entry, self.key = self.entry[order], self.key[order]

    def skip_edges(self) -> np.ndarray:
        """Edges from each token to the one before it that shares a content key: a repeated token adds one edge, not pairs."""
        same = np.flatnonzero((self.key[1:] == self.key[:-1]) & (self.entry[1:] != self.entry[:-1]))
        edges = np.stack([self.entry[same], self.entry[same + 1]], 1)
        return np.unique(edges, axis=0) if len(edges) else edges

    def chain_edges(self) -> np.ndarray:
        return np.stack([self.chain, self.chain + 1], 1)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) entry of every key."""
        new = np.ones(len(self.key) + 1, bool)
        new[1:-1] = self.key[1:] != self.key[:-1]
        return np.flatnonzero(new[:-1]), np.flatnonzero(new[1:])


def sentences(count: int = 600, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """Invented (tokens, labels): plain personal data, later short mentions, wrong check digits, and other numbers."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("aeiounrstlm"), rng.integers(2, 9)))
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    hexa = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    cue = lambda kind: str(rng.choice([w for w, k in CUES.items() if k == kind]))
    marks = ["", "", "", ".", ",", "!!", "$$$", '"']
    other = [
        lambda: num(rng.integers(1, 4)), lambda: f"{rng.integers(1900, 2030)}", lambda: f"{rng.integers(0, 99)}.{num(2)}", lambda: f"{num(4)}-{num(2)}-{num(2)}",
        lambda: f"v{rng.integers(0, 9)}.{rng.integers(0, 20)}", lambda: f"#{num(5)}", lambda: num(7), lambda: num(5), lambda: num(10), lambda: num(13), lambda: f"{num(3)}-{num(4)}",
        lambda: f"{word()}{num(3)}", lambda: f"@{word()}", lambda: num(rng.integers(20, 30)), lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"{num(1)},{num(3)},{num(3)}", lambda: hexa(40), lambda: hexa(32),
    ]
    out = []
    for _ in range(count):
        tokens, labels = [], []

        def add(w, label, tokens=tokens, labels=labels):
            tokens.append(str(w))
            labels.append(label)

        later = []
        for _ in range(rng.integers(2, 7)):
            for _ in range(rng.integers(1, 5)):
                add(word(), 0)
            kind = int(rng.integers(0, 10))
            if kind < 6 and rng.random() < 0.3:
                add(cue(min(kind, 4)), 0)
            if kind == 0:
                name = f"{word()}.{num(2)}"
                add(f"{name}@{word()}.com{rng.choice(marks)}", 1)
                later.append((name, 1))
            elif kind == 1:
                add(".".join(str(x) for x in rng.integers(0, 256, 4)), 2)
            elif kind == 2:
                whole = num(16)
                if rng.random() < 0.3:
                    for k in range(4):
                        add(whole[4 * k : 4 * k + 4], 3)
                else:
                    add(whole + str(rng.choice(marks)), 3)
                later.append((rng.choice([whole[-8:], whole]), 3))
            elif kind == 3:
                a, b, c = num(3), num(3), num(4)
                for w in ([f"+{rng.integers(1, 99)}"] if rng.random() < 0.7 else []) + [f"({a})", f"{b}-{c}"]:
                    add(w, 4)
                later.append((rng.choice([f"{b}-{c}", f"{a}-{b}-{c}", b + c]), 4))
            elif kind in (4, 5):
                value = hexa(int(rng.choice([32, 40, 40]))) if rng.random() < 0.7 else "".join(rng.choice(list("abcXYZ0123456789_-"), 24)) + "a1b2"
                add(cue(4), 0)
                if rng.random() < 0.8:
                    add("=", 0)
                add(f'"{value}"' if rng.random() < 0.7 else value, 5)
                later.append((value, 5))
            elif kind < 8 and later:
                add(*later[rng.integers(0, len(later))])
            else:
                add(other[rng.integers(0, len(other))](), 0)
        out.append((tokens, labels))
    return out


def _base_rows(spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    return np.array([(t, a, k, b) for t, of in enumerate(spans) for a, k, b in of], np.int64).reshape(-1, 4)


class Field:
    """Weights of the field: features to labels, label pairs on chain edges, label pairs on skip edges."""

    def __init__(self, steps: int = 400, rate: float = 0.5, decay: float = 1e-3):
        data = sentences()
        texts = [" ".join(tokens) for tokens, _ in data]
        nodes = Nodes(texts, _base_rows([base_spans(t) for t in texts]))
        label = {}
        for t, (tokens, labels) in enumerate(data):
            at = 0
            for w, y in zip(tokens, labels):
                label[t, at] = y
                at += len(w) + 1
        token = [[0, *np.cumsum([len(w) + 1 for w in tokens])] for tokens, _ in data]
        y = np.array([label[t, token[t][int(np.searchsorted(token[t], a, "right")) - 1]] for t, a in zip(nodes.text.tolist(), nodes.start.tolist())])
        x, n = nodes.features.astype(float), len(LABELS)
        one = np.eye(n)[y]
        left, right, skip = np.zeros((len(y), n)), np.zeros((len(y), n)), np.zeros((len(y), n))
        left[nodes.chain + 1] = one[nodes.chain]
        right[nodes.chain] = one[nodes.chain + 1]
        edges = nodes.skip_edges()
        np.add.at(skip, edges[:, 0], one[edges[:, 1]])
        np.add.at(skip, edges[:, 1], one[edges[:, 0]])
        self.node, self.chain, self.skip = np.zeros((x.shape[1], n)), np.zeros((n, n)), np.zeros((n, n))
        for _ in range(steps):
            score = x @ self.node + left @ self.chain + right @ self.chain.T + skip @ self.skip
            p = np.exp(score - score.max(1, keepdims=True))
            miss = (one - p / p.sum(1, keepdims=True)) / len(y) * 20
            self.node += rate * (x.T @ miss - decay * self.node)
            self.chain += rate * (left.T @ miss + (right.T @ miss).T - decay * self.chain) / 2
            both = skip.T @ miss
            self.skip += rate * ((both + both.T) / 2 - decay * self.skip)

    @staticmethod
    def _sent(out: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Messages (logarithms, largest 0) over a label pair potential from what the senders believe."""
        made = np.log(np.exp(out - out.max(1, keepdims=True)) @ np.exp(pair) + 1e-30)
        return (made - made.max(1, keepdims=True)).astype(np.float32)

    def beliefs(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Logarithms of the nodes' label beliefs after ROUNDS of damped message passing along all edges both ways."""
        edges = np.concatenate([chain, skip])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        half, c = len(edges), len(chain)
        m = np.zeros((2 * half, len(LABELS)), np.float32)

        def total() -> np.ndarray:
            return unary + np.stack([np.bincount(target, m[:, k], len(unary)) for k in range(len(LABELS))], 1).astype(np.float32)

        for _ in range(ROUNDS if half else 0):
            out = total()[source] - np.concatenate([m[half:], m[:half]])  # without what came back along the same edge
            new = np.concatenate([self._sent(out[:c], self.chain), self._sent(out[c:half], self.skip), self._sent(out[half : half + c], self.chain.T), self._sent(out[half + c :], self.skip.T)])
            m = np.float32(0.3) * m + np.float32(0.7) * new
        return total()

    def unary(self, nodes: Nodes) -> np.ndarray:
        return nodes.features @ self.node.astype(np.float32)


def _labels(belief: np.ndarray, based: np.ndarray) -> np.ndarray:
    p = np.exp(belief - belief.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return np.where((p.max(1) >= SURE) & (based == 0), p.argmax(1), 0)


def _runs(nodes: Nodes, label: np.ndarray):
    """(text, start, label, end) of runs of neighbours with one label."""
    joined_ = np.zeros(len(label) + 1, bool)
    one, two = nodes.chain, nodes.chain + 1
    # Cards in groups and phone numbers have several tokens; two whole numbers side by side are two.
    joined_[two] = (label[one] == label[two]) & np.isin(label[one], (3, 4)) & (np.minimum(nodes.digits[one], nodes.digits[two]) <= 6)
    first = np.flatnonzero(~joined_[:-1]) if len(label) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(label)) - 1 if len(first) else first
    for a, b in zip(first.tolist(), last.tolist()):
        if label[a]:
            yield int(nodes.text[a]), int(nodes.start[a]), int(label[a]), int(nodes.end[b])


class _Kept:
    """Messages by content key: the last one put for a key counts."""

    def __init__(self):
        self.key, self.message = np.zeros(0, np.uint64), np.zeros((0, len(LABELS)), np.float32)

    def get(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        out = np.zeros((len(key), len(LABELS)), np.float32)
        if len(self.key):
            hit = self.key[at] == key
            out[hit] = self.message[at[hit]]
        return out

    def put(self, key: np.ndarray, message: np.ndarray) -> None:
        key, at = np.unique(np.concatenate([key, self.key]), return_index=True)
        self.key, self.message = key, np.concatenate([message, self.message])[at]


class Finder:
    def __init__(self):
        self.field = Field()

    def spans(self, texts: list[str]) -> list[tuple[list, list]]:
        """(base spans, spans of the four kinds) of texts."""
        return [x[:2] for x in self.found(texts)]

    def found(self, texts: list[str]) -> list[tuple[list, list, list]]:
        """(base spans, spans of the four kinds, secrets) of texts; the field's nodes of all texts are settled together."""
        based = [base_spans(t) for t in texts]
        added: list[list] = [[] for _ in texts]
        short = [i for i, t in enumerate(texts) if len(t) <= WINDOW]
        if short:
            nodes = Nodes([texts[i] for i in short], _base_rows([based[i] for i in short]))
            label = _labels(self.field.beliefs(self.field.unary(nodes), nodes.chain_edges(), nodes.skip_edges()), nodes.based)
            for t, a, k, b in _runs(nodes, label):
                added[short[t]].append((a, k - 1, b))
        for i, text in enumerate(texts):
            if len(text) > WINDOW:
                added[i] = sorted(self._long(text, based[i]))
        return [(b, sorted(b + [x for x in a if x[1] < len(KINDS)]), [x for x in a if x[1] == len(KINDS)]) for b, a in zip(based, added)]

    def _long(self, text: str, base: list[tuple[int, int, int]]):
        """(start, kind, end) that the field adds to one long text, window by window forth and back."""
        cuts, at = [0], 0
        while at < len(text):
            space = _SPACE.search(text, min(at + WINDOW, len(text)))
            at = space.end() if space else len(text)
            cuts.append(at)
        rows = _base_rows([base])
        starts, reach = rows[:, 1], np.maximum.accumulate(rows[:, 3]) if len(rows) else rows[:, 3]

        def nodes(w: int) -> Nodes:
            a, b = cuts[w], cuts[w + 1]
            of = rows[np.searchsorted(reach, a, "right") : np.searchsorted(starts, b)]
            return Nodes([text[a:b]], of - [0, a, 0, a])

        kept, came = _Kept(), []
        for w in range(len(cuts) - 1):
            here = nodes(w)
            first, last = here.ends()
            came.append(kept.get(here.key[first]))
            unary = self.field.unary(here)
            np.add.at(unary, here.entry[first], came[-1])
            belief = self.field.beliefs(unary, here.chain_edges(), here.skip_edges())
            kept.put(here.key[last], self.field._sent(belief[here.entry[last]], self.field.skip))
        kept = _Kept()
        for w in range(len(cuts) - 2, -1, -1):
            here = nodes(w)
            first, last = here.ends()
            unary = self.field.unary(here)
            np.add.at(unary, here.entry[first], came[w])
            np.add.at(unary, here.entry[last], kept.get(here.key[last]))
            belief = self.field.beliefs(unary, here.chain_edges(), here.skip_edges())
            kept.put(here.key[first], self.field._sent(belief[here.entry[first]] - came[w], self.field.skip))
            came[w] = None
            for _, a, k, b in _runs(here, _labels(belief, here.based)):
                yield cuts[w] + a, k - 1, cuts[w] + b


_SPACE = re.compile(r"\s")
_FINDER: list[Finder] = []
_HOT = np.zeros(256, bool)
_HOT[[*range(48, 58), 64]] = True


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and spans of personal data in every whole text; the number and spans of secrets, and whether anything was
    found.  Only ASCII digits and @ make a text worth a look."""
    session.arrow(docs.sparkSession)
    empty = hashlib.sha256(b"").hexdigest()
    names = [f"n_{k}" for k in KINDS]

    def run(batches):
        if not _FINDER:
            _FINDER.append(Finder())
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                data, offsets = utf8(part.column(1))
                total = np.concatenate([[0], np.cumsum(_HOT[data])])
                hot = np.flatnonzero(total[offsets[1:]] > total[offsets[:-1]])
                counts, digests, spans = np.zeros((len(part), len(KINDS)), np.int64), [empty] * len(part), [""] * len(part)
                secret, secrets = np.zeros(len(part), np.int64), [""] * len(part)
                found = _FINDER[0].found(part.column(1).take(pa.array(hot)).to_pylist())
                for r, (base, every, hidden) in zip(hot.tolist(), found):
                    for _, k, _ in base:
                        counts[r, k] += 1
                    digests[r] = hashlib.sha256(joined(base).encode()).hexdigest()
                    spans[r] = joined(every)
                    secret[r], secrets[r] = len(hidden), joined(hidden)
                some = [bool(x or y) for x, y in zip(spans, secrets)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(secret), pa.array(secrets, pa.string()), pa.array(some)], ["id", *names, "base_sha256", "spans", "n_secret", "secrets", "found"])

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, {', '.join(f'{n} bigint' for n in names)}, base_sha256 string, spans string, n_secret bigint, secrets string, found boolean"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(session.documents(spark, sf_dir, "doc_id", "text"))
