"""External induced sorting of suffixes with their common prefixes.

A text's leftmost small positions (smaller than the next suffix, after a larger
one) are sorted first: by one induction that orders the substrings between
them, which are then named, and by recursion on the string of names.  A second
induction hands their order on to all suffixes.  Both are scans in order of the
suffixes: each suffix puts the one before it into a queue, which is kept by its
first symbol and read when the scan comes there.  What enters a queue enters in
sorted order, so the queues together are the priority queue; they spill to disk
beyond a bound.  The tuples in them hold a position and the length of the prefix
shared with the tuple before, up to a cap: 1 more than the least such length
between the two suffixes that put them there.

Scans work on arrays of tuples at a time, not on single ones.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Common prefixes are counted up to here.
CAP = 200
#: Tuples that are handled as one array.
CHUNK = 1 << 18
#: Tuples that the queues hold in memory, and names that are sorted there; more go to disk, or one level deeper.
IN_MEMORY = 12_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


class Queues:
    """First-in first-out queues of (position, prefix) tuples by symbol, on disk beyond a bound."""

    def __init__(self, folder: str, in_memory: int):
        self.folder, self.limit, self.held, self.file = folder, in_memory, 0, None
        self.memory: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.disk: dict[int, list[tuple[int, int]]] = {}

    def put(self, symbol: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.memory.setdefault(symbol, []).append((positions, prefixes))
        self.held += len(positions)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.folder)  # noqa: SIM115
        self.file.seek(0, 2)
        for symbol, parts in self.memory.items():
            for positions, prefixes in parts:
                self.disk.setdefault(symbol, []).append((self.file.tell(), len(positions)))
                self.file.write(positions.tobytes())
                self.file.write(prefixes.tobytes())
        self.memory, self.held = {}, 0

    def _read(self, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(n), np.uint8)

    def take(self, symbol: int, backwards: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The tuples of a symbol, which leave the queue; backwards, parts and tuples come last first, prefixes as they were stored."""
        disk, memory = self.disk.pop(symbol, []), self.memory.pop(symbol, [])
        self.held -= sum(len(p) for p, _ in memory)
        if backwards:
            yield from ((p[::-1], x[::-1]) for p, x in reversed(memory))
            yield from ((p[::-1], x[::-1]) for p, x in (self._read(*d) for d in reversed(disk)))
        else:
            yield from (self._read(*d) for d in disk)
            yield from memory

    def symbols(self) -> set[int]:
        return {*self.disk, *self.memory}


def _pieces(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same tuples in arrays of fair size: short parts joined, long ones cut."""
    held, n = [], 0
    for p, x in parts:
        held.append((p, x))
        n += len(p)
        if n >= CHUNK // 4:
            yield from _cut(held)
            held, n = [], 0
    if n:
        yield from _cut(held)


def _cut(held):
    p, x = (np.concatenate([h[i] for h in held]) if len(held) > 1 else held[0][i] for i in (0, 1))
    for at in range(0, len(p), CHUNK):
        yield p[at : at + CHUNK], x[at : at + CHUNK]


class Scan:
    """One scan, upwards for large suffixes or downwards for small ones, that fills the queues of the suffixes before."""

    def __init__(self, text: np.ndarray, symbols: int, down: bool, queues: Queues, prefixes: bool):
        self.text, self.down, self.queues, self.prefixes = text, down, queues, prefixes
        self.least = np.full(symbols if prefixes else 0, CAP, np.uint8)  # since the last tuple of a symbol's queue
        self.begun = np.zeros(symbols if prefixes else 0, bool)

    def pass_on(self, positions: np.ndarray, shared: np.ndarray, symbol: int, seeds: bool) -> None:
        """Queue the suffixes before those at ``positions``, which begin with ``symbol``; shared: prefixes with the one scanned before."""
        before = positions - 1
        q = self.text[before]  # position 0 has none: its text[-1] is the end's symbol
        if self.down:
            fits = q < symbol if seeds else q <= symbol
        else:
            fits = q > symbol if seeds else q >= symbol
        fits &= positions > 0
        at = np.flatnonzero(fits)
        if not len(at):
            if self.prefixes and len(shared):
                np.minimum(self.least, shared.min(), out=self.least)
            return
        q = q[at]
        order = np.argsort(q, kind="stable")
        at, q = at[order], q[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        last = np.concatenate([first[1:], [len(q)]])
        fresh = self._prefixes(at, q, first, last, shared) if self.prefixes else np.zeros(len(at), np.uint8)
        moved = before[at]
        for a, b, s in zip(first.tolist(), last.tolist(), q[first].tolist(), strict=True):
            self.queues.put(s, moved[a:b], fresh[a:b])

    def _prefixes(self, at, q, first, last, shared) -> np.ndarray:
        """1 more than the least shared prefix since the tuple before in the same queue."""
        n = len(shared)
        levels = [shared]
        while 2 << (len(levels) - 1) <= n:
            half = 1 << (len(levels) - 1)
            up = levels[-1].copy()
            np.minimum(up[:-half], levels[-1][half:], out=up[:-half])
            levels.append(up)
        table = np.concatenate(levels)
        start = np.empty(len(at), np.int64)
        start[1:] = at[:-1] + 1
        start[first] = 0
        size = at + 1 - start
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.minimum(table[level * n + start], table[level * n + at + 1 - (1 << level)])
        head = q[first].astype(np.int64)
        out[first] = np.minimum(out[first], self.least[head])
        out = np.minimum(out, CAP - 1) + np.uint8(1)
        out[first[~self.begun[head]]] = 0
        suffix = np.minimum.accumulate(shared[::-1])[::-1]
        np.minimum(self.least, suffix[0], out=self.least)
        ends = at[last - 1] + 1
        self.least[head] = np.where(ends < n, suffix[np.minimum(ends, n - 1)], CAP)
        self.begun[head] = True
        return out


def _run(text: np.ndarray, position: int, symbol: int) -> int:
    """How often ``symbol`` stands from ``position`` on, up to the cap."""
    differ = text[position : position + CAP] != symbol
    return int(differ.argmax()) if differ.any() else len(differ)


class Marks:
    """Positions whose suffix shares CAP symbols with a neighbour."""

    def __init__(self, n: int):
        self.at = np.zeros(n, bool)

    def see(self, positions: np.ndarray, shared: np.ndarray, before: int | None) -> None:
        hits = np.flatnonzero(shared >= CAP)
        if len(hits):
            self.at[positions[hits]] = True
            self.at[positions[hits[hits > 0] - 1]] = True
            if hits[0] == 0 and before is not None:
                self.at[before] = True


def _induce(text: np.ndarray, symbols: int, seeds: Queues, folder: str, in_memory: int, prefixes: bool, marks: Marks | None) -> Iterator[tuple[int, str, np.ndarray]]:
    """Induce all suffixes from sorted seeds; gives (symbol, "small" or "large", positions) downwards, each array downwards too."""
    waiting, large = Queues(folder, in_memory), Queues(folder, in_memory)
    scan = Scan(text, symbols, False, waiting, prefixes)
    todo = _Symbols(seeds.symbols(), False)
    waiting_put = waiting.put

    def put_up(symbol, positions, shared):
        todo.add(symbol)
        waiting_put(symbol, positions, shared)

    waiting.put = put_up
    for symbol in todo:
        last = None
        while True:
            any_left = False
            for positions, shared in _pieces(waiting.take(symbol)):
                any_left = True
                if marks:
                    marks.see(positions, shared, last)
                last = int(positions[-1])
                scan.pass_on(positions, shared, symbol, False)
                large.put(symbol, positions, shared)
            if not any_left:
                break
        for positions, shared in _pieces(seeds.take(symbol)):
            if last is not None and prefixes:
                shared = shared.copy()
                shared[0] = min(_run(text, last, symbol), _run(text, int(positions[0]), symbol))
                last = None
            scan.pass_on(positions, shared, symbol, True)

    waiting = Queues(folder, in_memory)
    scan = Scan(text, symbols, True, waiting, prefixes)
    todo = _Symbols(large.symbols(), True)
    waiting_put_down = waiting.put

    def put_down(symbol, positions, shared):
        todo.add(symbol)
        waiting_put_down(symbol, positions, shared)

    waiting.put = put_down
    for symbol in todo:
        last = None
        while True:
            any_left = False
            for positions, shared in _pieces(waiting.take(symbol)):
                any_left = True
                if marks:
                    marks.see(positions, shared, last)
                last = int(positions[-1])
                scan.pass_on(positions, shared, symbol, False)
                yield symbol, "small", positions
            if not any_left:
                break
        carry = 0
        for positions, stored in _pieces(large.take(symbol, backwards=True)):
            # Stored prefixes are with the next smaller one; going down, each belongs to the tuple after it.
            shared = np.concatenate([np.array([carry], np.uint8), stored[:-1]])
            carry = stored[-1]
            if last is not None and prefixes:
                seam = min(_run(text, last, symbol), _run(text, int(positions[0]), symbol))
                shared[0] = seam
                if marks and seam >= CAP:
                    marks.at[last] = marks.at[positions[0]] = True
                last = None
            scan.pass_on(positions, shared, symbol, True)
            yield symbol, "large", positions


class _Symbols:
    """Symbols in order, taking in such as come up on the way (never behind the one at hand)."""

    def __init__(self, symbols: set[int], down: bool):
        import heapq

        self.sign, self.known, self.heapq = (-1 if down else 1), set(symbols), heapq
        self.heap = [self.sign * s for s in symbols]
        heapq.heapify(self.heap)

    def add(self, symbol: int) -> None:
        if symbol not in self.known:
            self.known.add(symbol)
            self.heapq.heappush(self.heap, self.sign * symbol)

    def __iter__(self):
        while self.heap:
            symbol = self.sign * self.heapq.heappop(self.heap)
            self.known.discard(symbol)
            yield symbol


def star_positions(text: np.ndarray, block: int = 1 << 22) -> np.ndarray:
    """Leftmost small positions, the last one included; blocks are read from the end."""
    found, right_small, n = [np.array([len(text) - 1])], True, len(text)
    end = n - 1
    carried = False  # whether the first position of the block to the right is small and still needs to see its left neighbour
    while end > 0:
        start = max(0, end - block)
        here, after = np.asarray(text[start:end]), np.asarray(text[start + 1 : end + 1])
        differs = here != after
        at = np.where(differs, np.arange(len(here)), len(here))
        at = np.minimum.accumulate(at[::-1])[::-1]
        small = np.append(here < after, right_small)[at]
        stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1 + start
        if carried and not small[-1]:
            stars = np.append(stars, end)
        found.append(stars)
        right_small, carried = bool(small[0]), bool(small[0])
        end = start
    return np.concatenate(found[::-1])  # blocks came from the right, and each is in order


def _names(text: np.ndarray, stars: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the substrings between stars, by their order; equal ones have one name."""
    lengths = np.append(np.diff(stars), 0) + 1
    hashes = np.empty(len(stars), np.uint64)
    step = 1 << 18
    for a in range(0, len(stars), step):
        starts, sizes = stars[a : a + step], lengths[a : a + step]
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        place = np.arange(sizes.sum()) - np.repeat(offsets, sizes)
        value = (text[place + np.repeat(starts, sizes)].astype(np.uint64) + np.uint64(1)) * _ODD
        value ^= value >> np.uint64(29)
        turn = (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        value *= turn ^ (turn >> np.uint64(32)) | np.uint64(1)
        value ^= value >> np.uint64(31)
        hashes[a : a + step] = np.add.reduceat(value * _ODD, offsets)
    where = np.searchsorted(stars, order)
    same = (hashes[where[1:]] == hashes[where[:-1]]) & (lengths[where[1:]] == lengths[where[:-1]])
    name = np.concatenate([[0], np.cumsum(~same)])
    out = np.empty(len(stars), np.int64)
    out[where] = name
    return out, int(name[-1]) + 1


def _order_in_memory(names: np.ndarray, reach: int) -> np.ndarray:
    """Order of the suffixes of ``names`` by their first ``reach`` names at least, by doubling.

    A suffix's rank is the place where the group of its equals begins; only
    groups of two or more are sorted on.
    """
    n, h = len(names), 1
    order = np.argsort(names, kind="stable")
    ordered = names[order]
    rank = np.empty(n, np.int64)
    place = np.arange(n)
    todo = place
    while True:
        fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        head = np.maximum.accumulate(np.where(fresh, todo, 0))
        rank[order[todo]] = head
        equal = ~fresh
        equal[:-1] |= ~fresh[1:]
        todo = todo[equal]
        if not len(todo) or h >= reach:
            return order
        suffix = order[todo]
        after = suffix + h
        key = rank[suffix] * np.int64(n + 2) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by_key = np.argsort(key, kind="stable")
        order[todo] = suffix[by_key]
        ordered = key[by_key]
        h *= 2


def _sorted_stars(text: np.ndarray, symbols: int, folder: str, in_memory: int) -> np.ndarray:
    stars = star_positions(text)
    if len(stars) == 1:
        return stars
    seeds = Queues(folder, in_memory)
    heads = text[stars]
    by_head = np.argsort(heads, kind="stable")
    bounds = np.flatnonzero(np.concatenate([[True], heads[by_head][1:] != heads[by_head][:-1]])).tolist() + [len(stars)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        seeds.put(int(heads[by_head[a]]), stars[by_head[a:b]], np.zeros(b - a, np.uint8))
    parts = []
    for _, kind, positions in _induce(text, symbols, seeds, folder, in_memory, False, None):
        if kind == "small":
            inner = positions[positions > 0]
            parts.append(inner[text[inner - 1] > text[inner]])
    order = np.concatenate([[len(text) - 1], *(p[::-1] for p in reversed(parts))])
    names, kinds = _names(text, stars, order)
    if kinds == len(stars):
        return order
    if len(names) <= in_memory:
        return stars[_order_in_memory(names, CAP // 2 + 1)]
    return stars[suffix_array(names, kinds, folder, in_memory)]


def _shared(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the prefix that each suffix shares with the one before, up to the cap."""
    out = np.zeros(len(order), np.uint8)
    left, right, n = order[:-1], order[1:], len(text)
    active, shift = np.arange(1, len(order)), np.zeros(len(order), np.int64)
    if text.dtype == np.uint16 and text.flags.c_contiguous and n > 4:  # four symbols at a time as long as they agree
        words = np.ndarray((n - 3,), np.uint64, text, 0, (2,))
        for k in range(0, CAP - 3, 4):
            a, b = left[active - 1] + k, right[active - 1] + k
            inside = np.maximum(a, b) < n - 3
            active, a, b = active[inside], a[inside], b[inside]
            active = active[words[a] == words[b]]
            if not len(active):
                break
            shift[active] = k + 4
        out[:] = shift
        active = np.arange(1, len(order))[shift[1:] < CAP]
    for _ in range(CAP):
        done = shift[active]
        a, b = left[active - 1] + done, right[active - 1] + done
        inside = (np.maximum(a, b) < n) & (done < CAP)
        active, a, b = active[inside], a[inside], b[inside]
        active = active[text[a] == text[b]]
        if not len(active):
            break
        shift[active] += 1
    out[:] = shift
    return out


def _seeded(text: np.ndarray, symbols: int, folder: str, in_memory: int, prefixes: bool, marks: Marks | None):
    order = _sorted_stars(text, symbols, folder, in_memory)
    shared = _shared(text, order) if prefixes else np.zeros(len(order), np.uint8)
    seeds = Queues(folder, in_memory)
    heads = text[order]
    bounds = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]])).tolist() + [len(order)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        seeds.put(int(heads[a]), order[a:b], shared[a:b])
    return _induce(text, symbols, seeds, folder, in_memory, prefixes, marks)


def suffix_array(text: np.ndarray, symbols: int, folder: str, in_memory: int = IN_MEMORY) -> np.ndarray:
    """Order of all suffixes of a text that ends with its only 0 (by CAP symbols at least)."""
    parts = [p for _, _, p in _seeded(text, symbols, folder, in_memory, False, None)]
    return np.concatenate([[len(text) - 1], *(p[::-1] for p in reversed(parts))])


def repeated_starts(text: np.ndarray, symbols: int, in_memory: int = IN_MEMORY) -> np.ndarray:
    """Mask of positions whose CAP symbols also start elsewhere, in a text that ends with its only 0."""
    marks = Marks(len(text))
    if len(text) > CAP:
        with tempfile.TemporaryDirectory(prefix="induced-") as folder:
            for _ in _seeded(text, symbols, folder, in_memory, True, marks):
                pass
    return marks.at
