"""Pre-tokenisation without regular expressions: class arrays and an associative scan.

The pattern that byte-level BPE vocabularies use,

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

is a small automaton over classes of code points, once a class also says what little lookahead the
pattern needs (is white space followed by more of it; is an apostrophe followed by a contraction).
Each class is a function from state to state. Such functions compose associatively, and those that
occur are few, so each gets a number and composition is one table lookup: the state before every code
point of a whole batch of texts follows from a blocked prefix scan over numbers, in array operations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Fixed value: the one pattern that the automaton stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Kinds of a code point, as a library's own regular expressions see it.
LETTER, NUMBER, OTHER, SPACE, WHITE, END = range(6)

# Classes: a kind with its lookahead. END stands between two texts.
(C_LETTER, C_NUMBER, C_OTHER, C_SHORT, C_LONG, C_GLUE, C_LAST, C_RUN, C_END) = range(9)

# States after a code point: what token is open.
(S_BREAK, S_LETTER, S_NUMBER, S_OTHER, S_ONE, S_TWO, S_GLUED, S_RUN) = range(8)
_STATES, _CLASSES = 8, 9


def _step(state: int, cls: int) -> tuple[int, bool]:
    """(next state, does a token start here)."""
    if cls == C_END:
        return S_BREAK, True
    if state == S_TWO:  # the first of two letters of a contraction
        return S_ONE, False
    if state == S_ONE:  # the last one
        return S_BREAK, False
    if cls in (C_SHORT, C_LONG) and state not in (S_OTHER, S_GLUED):
        return (S_ONE if cls == C_SHORT else S_TWO), True
    run = {C_LETTER: S_LETTER, C_NUMBER: S_NUMBER, C_OTHER: S_OTHER, C_SHORT: S_OTHER, C_LONG: S_OTHER}.get(cls)
    if run is not None:
        return run, state not in (run, S_GLUED)
    if cls == C_RUN:
        return S_RUN, state != S_RUN
    return (S_GLUED if cls == C_GLUE else S_BREAK), True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions that compositions of classes give: (composition table, value of each at S_BREAK, number of each class)."""
    basic = [tuple(_step(s, c)[0] for s in range(_STATES)) for c in range(_CLASSES)]
    known = {tuple(range(_STATES)): 0}
    for f in basic:
        known.setdefault(f, len(known))
    grown = True
    while grown:
        grown = False
        for f in list(known):
            for g in basic:
                h = tuple(g[x] for x in f)  # f first, then g
                if h not in known:
                    known[h] = len(known)
                    grown = True
    functions = list(known)
    compose = np.array([[known[tuple(g[x] for x in f)] for g in functions] for f in functions], np.int32)
    return compose, np.array([f[S_BREAK] for f in functions], np.int8), np.array([known[f] for f in basic], np.int32)


COMPOSE, FROM_BREAK, NUMBER_OF = _monoid()
_N = len(COMPOSE)
_FLAT = COMPOSE.ravel()
_STARTS = np.array([[_step(s, c)[1] for c in range(_CLASSES)] for s in range(_STATES)]).ravel()
_BLOCK = 64


def prefix_scan(f: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of the functions numbered f: blocks side by side, then a scan of the blocks."""
    n = len(f)
    if n <= _BLOCK:
        out = f.copy()
        for i in range(1, n):
            out[i] = COMPOSE[out[i - 1], out[i]]
        return out
    rows = -(-n // _BLOCK)
    grid = np.zeros(rows * _BLOCK, np.int32)
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(rows, _BLOCK).T)
    for i in range(1, _BLOCK):
        grid[i] = _FLAT[grid[i - 1] * _N + grid[i]]
    before = np.zeros(rows, np.int32)
    before[1:] = prefix_scan(grid[-1, :-1].copy()) if rows > 1 else 0
    return _FLAT[before[None, :] * _N + grid].T.ravel()[:n]


class Classifier:
    """Kinds of code points by asking a library: probe(text) is the number of its pre-tokens in text.

    Unicode versions differ between libraries; so each code point is asked for when it first occurs.
    """

    def __init__(self, joins: Callable[[str, str], bool]):
        self.joins = joins
        self.kinds = np.full(0x110000 + 1, 255, np.uint8)
        self.kinds[0x110000] = END
        self.learn(np.arange(128))

    def learn(self, points: np.ndarray) -> None:
        for p in points.tolist():
            c = chr(p)
            self.kinds[p] = SPACE if c == " " else LETTER if self.joins("a", c) else NUMBER if self.joins("1", c) else OTHER if self.joins("!", c) else WHITE

    def __call__(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        if (kinds == 255).any():
            self.learn(np.unique(points[kinds == 255]))
            kinds = self.kinds[points]
        return kinds


def classes(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Kinds with their lookahead. Both arrays end with END."""
    after = np.append(kinds[1:], END)
    out = np.array([C_LETTER, C_NUMBER, C_OTHER, C_GLUE, C_LAST, C_END], np.uint8)[kinds]
    white = (kinds == SPACE) | (kinds == WHITE)
    out[white & ((after == SPACE) | (after == WHITE) | (after == END))] = C_RUN
    at = np.flatnonzero(points == ord("'"))
    if len(at):
        one = points[np.minimum(at + 1, len(points) - 1)]
        two = points[np.minimum(at + 2, len(points) - 1)]
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        short = np.isin(one, [ord(x) for x in "stmd"])
        out[at[long]] = C_LONG
        out[at[short]] = C_SHORT
    return out


def split(texts: list[str], kinds_of: Classifier) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(all texts in UTF-8, bounds of their pre-tokens as byte offsets with the end last, pre-tokens of each text)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "".join(texts)
    raw = joined.encode("utf-8")
    flat = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    # A mark after each text; the marks are no characters and take no bytes.
    ends = np.cumsum(lengths)
    points = np.insert(flat, ends, 0x110000) if len(texts) else np.zeros(0, np.uint32)
    if not len(points):
        return raw, np.zeros(1, np.int64), np.zeros(len(texts), np.int64)
    cls = classes(points, kinds_of(points))
    prefix = prefix_scan(NUMBER_OF[cls])
    state = np.empty(len(cls), np.int32)
    state[0] = S_BREAK
    state[1:] = FROM_BREAK[prefix[:-1]]
    starts = _STARTS[state * _CLASSES + cls] & (cls != C_END)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    width[cls == C_END] = 0
    offset = np.cumsum(width) - width
    of_text = np.zeros(len(texts) + 1, np.int64)
    of_text[1:] = np.cumsum(starts)[ends + np.arange(len(texts))]
    return raw, np.append(offset[starts], len(raw)), np.diff(of_text)


class Hashes:
    """128-bit hashes of slices of a buffer: differences of running polynomial sums, brought back to power 0."""

    def __init__(self, longest: int = 1 << 20):
        rng = np.random.default_rng(20_240_601)
        self.bytes = rng.integers(0, 1 << 64, (2, 256), np.uint64)
        self.base = (rng.integers(0, 1 << 64, 2, np.uint64) & ~np.uint64(3)) | np.uint64(3)
        self.inverse = np.array([pow(int(b), -1, 1 << 64) for b in self.base], np.uint64)
        self.powers = self._powers(longest)

    def _powers(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        return [tuple(np.multiply.accumulate(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in pair) for pair in zip(self.base, self.inverse, strict=True)]

    def __call__(self, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(raw, np.uint8)
        powers = self.powers if len(data) < len(self.powers[0][0]) else self._powers(len(data))
        out = []
        for (up, down), values in zip(powers, self.bytes, strict=True):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values[data] * up[: len(data)], out=sums[1:])
            at = sums[bounds]
            h = (at[1:] - at[:-1]) * down[bounds[:-1]]
            out.append((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
        return out[0] ^ (out[0] >> np.uint64(32)), out[1]


class HashTable:
    """Open addressing in arrays: 128-bit key -> a non-negative number, looked up for many keys at a time."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self, limit: int = 0) -> None:
        size = 1 << max(4, (3 * max(limit, self.limit) // 2).bit_length())
        self.mask = np.uint64(size - 1)
        self.key, self.check, self.value, self.n = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.full(size, -1, np.int32), 0

    def get(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        at = (key & self.mask).astype(np.int64)
        out = self.value[at]
        wrong = np.flatnonzero((out >= 0) & ((self.key[at] != key) | (self.check[at] != check)))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & int(self.mask)
            there = at[wrong]
            out[wrong] = self.value[there]
            wrong = wrong[(out[wrong] >= 0) & ((self.key[there] != key[wrong]) | (self.check[there] != check[wrong]))]
        return out

    def put(self, key: np.ndarray, check: np.ndarray, value: np.ndarray) -> None:
        """Adds keys that are not there and differ from each other."""
        if self.n + len(key) > 3 * len(self.key) // 4:
            there = np.flatnonzero(self.value >= 0)
            old = self.key[there], self.check[there], self.value[there]
            self.clear(2 * (self.n + len(key)))
            self.put(*old)
        self.n += len(key)
        at = (key & self.mask).astype(np.int64)
        left = np.arange(len(key))
        while len(left):
            free = left[self.value[at[left]] < 0]
            self.value[at[free]] = value[free]  # where two want one place, one of them stays
            won = free[self.value[at[free]] == value[free]]
            self.key[at[won]], self.check[at[won]] = key[won], check[won]
            lost = np.ones(len(key), bool)
            lost[won] = False
            left = left[lost[left]]
            at[left] = (at[left] + 1) & int(self.mask)


class Memo:
    """Pre-tokens of a buffer -> numbers that `make` gives for new ones; remembers `limit` of them besides a chunk's own.

    A hash only says where to look: a pre-token is a remembered one if its bytes are. What has the hash of
    another one, but not its bytes, is kept apart in a dictionary.
    """

    #: Bytes of pre-tokens after which, as after `limit` of them, a start is made anew.
    HELD_BYTES = 64 << 20

    def __init__(self, limit: int, make: Callable[[list[bytes], bool], np.ndarray], first: list[bytes] = ()):
        """make(new pre-tokens, started anew): a distinct number for each at least while no start lies between."""
        self.make, self.hash, self.table, self.first, self.limit = make, Hashes(), HashTable(limit), list(first), limit
        self._clear()

    def _clear(self) -> None:
        self.table.clear()
        self.apart: dict[bytes, int] = {}
        self.numbers, self.blob, self.begin = np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.fresh = True

    def __call__(self, raw: bytes, bounds: np.ndarray) -> np.ndarray:
        if len(self.numbers) > self.limit or len(self.blob) > self.HELD_BYTES:
            self._clear()
        if self.fresh and self.first:
            cuts = np.append(0, np.cumsum(list(map(len, self.first))))
            self._slots(*self.hash(b"".join(self.first), cuts), self.first)
        if len(bounds) < 2:
            return np.zeros(0, np.int64)
        key, check = self.hash(raw, bounds)
        slot = self.table.get(key, check)
        slot[~self._same(slot, raw, bounds)] = -1
        new = np.flatnonzero(slot < 0)
        if len(new):
            slot[new] = self._slots(key[new], check[new], [raw[a:b] for a, b in zip(bounds[new].tolist(), bounds[new + 1].tolist(), strict=True)])
        return self.numbers[slot]

    def _same(self, slot: np.ndarray, raw: bytes, bounds: np.ndarray) -> np.ndarray:
        """Is each slice the pre-token of its slot, byte by byte? (slot -1: no)"""
        if not len(self.numbers):
            return np.zeros(len(slot), bool)
        width = np.diff(bounds)
        same = (slot >= 0) & (self.begin[slot + 1] - self.begin[slot] == width)
        at = np.flatnonzero(same)
        n = width[at]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        wrong = self.blob[np.repeat(self.begin[slot[at]], n) + inner] != np.frombuffer(raw, np.uint8)[np.repeat(bounds[at], n) + inner]
        if wrong.any():
            same[np.repeat(at, n)[wrong]] = False
        return same

    def _slots(self, key: np.ndarray, check: np.ndarray, pieces: list[bytes]) -> np.ndarray:
        """Slots of pre-tokens that the table lacks: those kept apart, and a new one for each other."""
        first: dict[bytes, int] = {}
        for i, p in enumerate(pieces):
            if p not in self.apart:
                first.setdefault(p, i)
        start = len(self.numbers)
        if first:
            at = np.fromiter(first.values(), np.int64, len(first))
            made = self.make(list(first), self.fresh)
            self.fresh = False
            self.numbers = np.append(self.numbers, made)
            self.blob = np.append(self.blob, np.frombuffer(b"".join(first), np.uint8))
            self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(np.fromiter(map(len, first), np.int64, len(first))))
            taken = self.table.get(key[at], check[at]) >= 0
            _, alone = np.unique(np.rec.fromarrays([key[at], check[at]]), return_index=True)
            once = np.zeros(len(at), bool)
            once[alone] = True
            put = np.flatnonzero(once & ~taken)
            self.table.put(key[at[put]], check[at[put]], (start + put).astype(np.int32))
            for i in np.flatnonzero(~once | taken).tolist():
                self.apart[pieces[at[i]]] = start + i
        slots = {p: start + i for i, p in enumerate(first)}
        return np.fromiter((slots[p] if p in slots else self.apart[p] for p in pieces), np.int64, len(pieces))
