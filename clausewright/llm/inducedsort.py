"""Suffix arrays with common-prefix lengths by external induced sorting.

A suffix is S if it is smaller than the next one, else L; an S suffix after an L one is S*.  The S* suffixes are
sorted first: the pieces of text between them get names in order, and if names repeat, the text of names is
sorted by the same procedure, or by doubling once it fits into memory.  Two scans then induce the others: the suffix before one that is popped from a priority
queue is the next of its first symbol.  Tuples carry the common prefix with the tuple inserted before them for the same
symbol, which is the symbol's own length and the least common prefix popped in between.

Insertions of a symbol come in order, so the queue is a file of spans of symbols, each in order of arrival: it is appended to,
and read span by span.  What a span's suffixes induce within the span is merged in before they are popped.
Text, types and results lie in files as soon as they are large, so memory is bounded by ``MEMORY``, not by the text.
The files are without a name, like those that Spark's own sort spills to, and end with the task that sorts.

Common prefixes are counted up to ``limit``.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes in memory before an array or a queue goes to a file; symbols handled at a time.
MEMORY, BLOCK = 48 << 20, 1 << 18
_SPANS = 256


def room(n: int, dtype) -> np.ndarray:
    """An array of ``n``, in a file where it is large."""
    dtype = np.dtype(dtype)
    if n * dtype.itemsize <= MEMORY:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, dtype, "w+", shape=(n,))


def _blocks(n: int) -> Iterator[tuple[int, int]]:
    size = 8 * BLOCK
    for a in range(0, n, size):
        yield a, min(n, a + size)


class _Least:
    """Least values of ranges of an array of small numbers."""

    def __init__(self, values: np.ndarray):
        self.rows, step = [values], 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2
        self.table = np.zeros((len(self.rows), len(values)), values.dtype)
        for k, r in enumerate(self.rows):
            self.table[k, : len(r)] = r

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least of first..last, both included and first <= last."""
        k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        return np.minimum(self.table[k, first], self.table[k, last - (1 << k) + 1])


class Text:
    """Symbols 0 .. size - 1, or names of the pieces of ``parent`` that start at ``stars``, with what each advances in the base text.

    ``separated``: 0 ends an item, and each 0 differs from the others: the last is the smallest, then they rise by place.  None follows
    another, and the text starts and ends with one.
    """

    def __init__(self, symbols: np.ndarray, size: int, limit: int, advance: np.ndarray | None = None, parent: Text | None = None, stars: np.ndarray | None = None, separated: bool = False):
        self.symbols, self.size, self.limit, self.n = symbols, size, limit, len(symbols)
        self.small = np.uint8 if limit < 256 else np.uint16 if limit < 1 << 16 else np.int64
        self.advance, self.parent, self.stars, self.separated = advance, parent, stars, separated
        self.larger = room(self.n, bool)  # S: smaller than the next suffix
        after, kind = -1, False
        for a, b in reversed(list(_blocks(self.n))):
            part = np.append(self.symbols[a:b].astype(np.int64), after)
            rise = np.flatnonzero(part[1:] != part[:-1])
            at = np.searchsorted(rise, np.arange(b - a))
            known = np.append(part[rise + 1] > part[rise], kind)
            self.larger[a:b] = known[at]
            after, kind = int(part[0]), bool(self.larger[a])

    def steps(self, symbols: np.ndarray) -> np.ndarray:
        return np.ones(len(symbols), np.int64) if self.advance is None else self.advance[symbols].astype(np.int64)

    def differ(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes with different symbols; one of the two may be at the end."""
        out = np.zeros(len(p), np.int64)
        if self.parent is not None:
            at = np.flatnonzero((p < self.n) & (q < self.n))
            out[at] = self.parent.common(self.stars[p[at]], self.stars[q[at]])
        return out

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes, symbol by symbol; for those that differ soon."""
        out, at, k = np.zeros(len(p), np.int64), np.arange(len(p)), 0
        while len(at):
            a, b = p[at] + k, q[at] + k
            x = np.where(a < self.n, self.symbols[np.minimum(a, self.n - 1)].astype(np.int64), -1)
            y = np.where(b < self.n, self.symbols[np.minimum(b, self.n - 1)].astype(np.int64), -1)
            same = (x == y) & (x >= self.separated)
            out[at[~same]] += self.differ(a[~same], b[~same])
            at = at[same]
            out[at] += self.steps(x[same])
            at, k = at[out[at] < self.limit], k + 1
        return np.minimum(out, self.limit)


class _Queue:
    """Tuples (symbol, position, common prefix) by symbol, and in order of arrival."""

    def __init__(self, counts: np.ndarray, small):
        total = np.cumsum(counts)
        cut = np.unique(np.searchsorted(total, np.linspace(0, total[-1] if len(total) else 0, _SPANS + 1)[1:-1]))
        heavy = np.flatnonzero(counts > max(BLOCK, int(counts.sum()) // _SPANS))
        self.first = np.unique(np.concatenate(([0], cut, heavy, heavy + 1)))
        self.first = self.first[self.first < max(1, len(counts))]
        self.single = np.diff(np.append(self.first, len(counts))) == 1
        self.kind = np.dtype([("c", np.int32), ("p", np.int64), ("l", small)])
        self.file, self.size, self.held = None, 0, 0
        self.memory: list[list[np.ndarray]] = [[] for _ in self.first]
        self.stored: list[list[tuple[int, int]]] = [[] for _ in self.first]
        self.span = 0

    def insert(self, rows: np.ndarray) -> None:
        """Rows in order of symbols; none before what was popped."""
        at = np.searchsorted(self.first, rows["c"], "right") - 1
        cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(rows)], strict=True):
            self.memory[int(at[a])].append(rows[a:b])
        self.held += rows.nbytes
        if self.held > MEMORY:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(self.size)
        for s, parts in enumerate(self.memory):
            if parts:
                data = np.concatenate(parts)
                data.tofile(self.file)
                self.stored[s].append((self.size, len(data)))
                self.size += data.nbytes
                self.memory[s] = []
        self.file.flush()
        self.held = 0

    def _load(self, at: int, n: int) -> np.ndarray:
        self.file.seek(at)
        return np.fromfile(self.file, self.kind, n)

    def end(self) -> int:
        """The first symbol after the span."""
        return int(self.first[self.span + 1]) if self.span + 1 < len(self.first) else 1 << 62

    def pop(self) -> np.ndarray:
        """All of the span by symbol, or of a span of one symbol the next part; empty when there is no more."""
        s = self.span
        if self.single[s] and self.stored[s]:
            at, n = self.stored[s].pop(0)
            take = min(n, BLOCK)
            if n > take:
                self.stored[s].insert(0, (at + take * self.kind.itemsize, n - take))
            return self._load(at, take)
        parts = [self._load(*x) for x in self.stored[s]] + self.memory[s]
        self.held -= sum(x.nbytes for x in self.memory[s])
        self.stored[s], self.memory[s] = [], []
        rows = np.concatenate(parts) if parts else np.empty(0, self.kind)
        return rows if self.single[s] else rows[np.argsort(rows["c"], kind="stable")]


class _Seeds:
    """Sorted suffixes that are popped after those induced for their symbol; ``turn``: from the last to the first."""

    def __init__(self, positions: np.ndarray, common: np.ndarray, turn: bool):
        self.positions, self.common, self.turn, self.at = positions, common, turn, 0

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The next ``n`` positions, and the common prefix of each with the one before it."""
        total, a = len(self.positions), self.at
        b = min(total, a + n)
        if not self.turn:
            return self.positions[a:b], self.common[a:b]
        p = self.positions[total - b : total - a][::-1]
        return p, np.concatenate(([0] if a == 0 and b else [], self.common[total - b + 1 : total - a + (a > 0)][::-1])).astype(self.common.dtype)


def _merged(text: Text, p: np.ndarray, key: np.ndarray, end: int, down: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A span's suffixes and those that they induce within it: positions and keys in order, and which are new.

    ``key`` is three times the symbol, and 1 more for new ones and 2 more for seeds, so among a symbol's suffixes the new ones are after what
    the queue had and before the seeds; among themselves they are in the order of those that induce them.
    """
    n = len(p)
    source, fresh, rank = np.full(n, -1), np.arange(n), np.arange(n)
    while len(fresh):
        prev = p[fresh] - 1
        ok = prev >= 0
        prev = np.maximum(prev, 0)
        to = text.symbols[prev].astype(np.int64)
        to = text.size - 1 - to if down else to
        own = np.flatnonzero(ok & (text.larger[prev] == down) & (to >= key[fresh] // 3) & (to < end))
        if not len(own):
            break
        source = np.concatenate((source, fresh[own]))
        p, key = np.concatenate((p, prev[own])), np.concatenate((key, 3 * to[own] + 1))
        fresh = np.arange(len(source) - len(own), len(source))
        order = np.lexsort((np.where(source < 0, np.arange(len(source)), rank[source]), key))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
    order = np.argsort(rank)
    return p[order], key[order], order


def _induce(text: Text, seeds: _Seeds, down: bool, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the L suffixes in order, from S* seeds, or ``down`` of the S suffixes in falling order, from L seeds; and common prefixes with the one before."""
    size, n, limit, small = text.size, text.n, text.limit, text.small
    turn = (lambda c: size - 1 - c) if down else (lambda c: c)
    counts, n_seeds = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for a, b in _blocks(n):
        counts += np.bincount(text.symbols[a:b][text.larger[a:b] == down], minlength=size)
    for a, b in _blocks(len(seeds.positions)):
        n_seeds += np.bincount(text.symbols[seeds.positions[a:b]], minlength=size)
    counts, n_seeds = (counts[::-1], n_seeds[::-1]) if down else (counts, n_seeds)
    queue, until = _Queue(counts + n_seeds, small), np.concatenate(([0], np.cumsum(n_seeds)))
    out_p, out_l, done = room(count, np.int64), room(count, small), 0
    last_batch, tail = np.full(size, -1, np.int64), np.zeros(size, small)
    batches, stack_at, stack_least = 0, [], []
    before_c, before_p, before_seed = -1, -1, False
    if not down and n:  # the end of the text is the smallest suffix, and induces the last one
        c = int(text.symbols[n - 1])
        queue.insert(np.array([(c, n - 1, 0)], queue.kind))
        last_batch[c], batches, stack_at, stack_least = 0, 1, [0], [0]
    while True:
        head, single, end = queue.pop(), queue.single[queue.span], queue.end()
        want = int(until[min(end, size)]) - seeds.at
        seed_p, seed_l = seeds.take(min(want, BLOCK) if single else want) if not (single and len(head)) else seeds.take(0)
        if not len(head) and not len(seed_p):
            if queue.span + 1 == len(queue.first):
                break
            queue.span += 1
            continue
        seeds.at += len(seed_p)
        p, own = np.concatenate((head["p"], seed_p)), np.concatenate((head["l"], seed_l))
        key = np.concatenate((3 * head["c"].astype(np.int64), 3 * turn(text.symbols[seed_p].astype(np.int64)) + 2))
        new = np.zeros(0, np.int64)
        if not single:
            order = np.argsort(key, kind="stable")
            p, key, order2 = _merged(text, p[order], key[order], end, down)
            own = np.concatenate((own[order], np.zeros(len(p) - len(own), small)))[order2]
            new = np.flatnonzero(key % 3 == 1)
        m, c, is_seed = len(p), key // 3, key % 3 == 2
        prev = np.maximum(p - 1, 0)
        to = turn(text.symbols[prev].astype(np.int64))
        gives = (p > 0) & (text.larger[prev] == down) & (to >= (c if single else end))
        # common prefix with what was popped before: carried, or compared where symbols change, seeds follow others, or a suffix is new here
        last_c, last_seed, last_p = np.append(before_c, c[:-1]), np.append(before_seed, is_seed[:-1]), np.append(before_p, p[:-1])
        common = own.astype(np.int64)
        other = np.flatnonzero(c != last_c)
        common[other] = text.differ(p[other], np.where(last_p[other] < 0, n, last_p[other]))
        seam = np.flatnonzero((c == last_c) & is_seed & ~last_seed)
        seam = np.concatenate((seam, new[c[new] == last_c[new]]))
        common[seam] = text.common(p[seam], last_p[seam])
        common = np.minimum(common, limit).astype(small)
        before_c, before_p, before_seed = int(c[-1]), int(p[-1]), bool(is_seed[-1])
        made = p[~is_seed]
        out_p[done : done + len(made)], out_l[done : done + len(made)] = made, common[~is_seed]
        done += len(made)
        # what these induce beyond the span
        source = np.flatnonzero(gives)
        if len(source):
            target = to[source]
            by = np.argsort(target.astype(np.uint8) if size <= 256 else target, kind="stable")
            source, target = source[by], target[by]
            first = np.concatenate(([True], target[1:] != target[:-1]))
            least = _Least(common)
            carried = np.empty(len(source), np.int64)
            again = np.flatnonzero(~first)
            carried[again] = least(source[again - 1] + 1, source[again])
            start = np.flatnonzero(first)
            tc, since = target[start], last_batch[target[start]]
            got = least(np.zeros(len(start), np.int64), source[start]).astype(np.int64)
            history = np.append(np.array(stack_least, np.int64), limit)[np.searchsorted(np.array(stack_at, np.int64), since + 1)]
            carried[start] = np.minimum(np.minimum(got, history), np.where(since >= 0, tail[tc], 0))
            ends = np.append(start[1:] - 1, len(source) - 1)
            after = source[ends] + 1
            tail[tc] = np.where(after < m, least(np.minimum(after, m - 1), np.full(len(ends), m - 1)), limit)
            last_batch[tc] = batches
            rows = np.empty(len(source), queue.kind)
            rows["c"], rows["p"] = target, p[source] - 1
            rows["l"] = np.minimum(carried + text.steps(turn(target)), limit)
            queue.insert(rows)
        low = int(common.min())
        while stack_least and stack_least[-1] >= low:
            stack_at.pop()
            stack_least.pop()
        stack_at.append(batches)
        stack_least.append(low)
        batches += 1
    assert done == count, (done, count)
    return out_p, out_l


def _names(text: Text, stars: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Name of each S* position's piece in order, their number, and what each advances."""
    m, n = len(stars), text.n
    ends = np.append(stars[1:], n)  # the piece ends with the next S* symbol, or with the end of the text
    bits = max(2, int(text.size + 2).bit_length())
    per = 63 // bits
    over = (1 << bits) - 1

    def chunk(rows: np.ndarray, k: int) -> np.ndarray:
        key = np.zeros(len(rows), np.int64)
        for j in range(k * per, k * per + per):
            at = stars[rows] + j
            s = np.where(at < n, text.symbols[np.minimum(at, n - 1)].astype(np.int64) + 1, 0)
            key = key << bits | np.where(at <= ends[rows], s, over)
        return np.where(text.symbols[stars[rows]] == 0, k, key) if text.separated else key

    key = room(m, np.int64)
    for a, b in _blocks(m):
        key[a:b] = chunk(np.arange(a, b), 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    k = 1
    length = ends - stars
    open_ = (~new | np.append(~new[1:], False)) & (length[order] >= per - 1)  # equal so far, and perhaps longer
    while open_.any():
        at = np.flatnonzero(open_)
        group = np.cumsum(new)[at]
        more = chunk(order[at], k)
        by = np.lexsort((more, group))
        order[at], more, group = order[at][by], more[by], group[by]
        differs = np.concatenate(([True], (more[1:] != more[:-1]) | (group[1:] != group[:-1])))
        new[at] = differs
        k += 1
        same = ~differs | np.append(~differs[1:], False)
        open_[:] = False
        open_[at] = same & (length[order[at]] >= k * per - 1)
    if text.separated:  # equal pieces that start or end with a separator are in order of place, which sorting kept
        new |= (text.symbols[stars[order]] == 0) | (text.symbols[np.minimum(ends[order], n - 1)] == 0)
    rank = np.cumsum(new) - 1
    names = room(m, np.int32)
    names[order] = rank
    firsts = order[new]
    if text.advance is None:
        return names, len(firsts), np.minimum(length[firsts], text.limit)
    total = np.concatenate(([0], np.cumsum(text.advance[text.symbols].astype(np.int64))))
    return names, len(firsts), np.minimum(total[ends[firsts]] - total[stars[firsts]], text.limit)


def _sort_within(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """As sort_suffixes, for names that fit into memory: prefixes of doubling length, of those suffixes that aren't told apart yet."""
    n, rank, step = text.n, np.asarray(text.symbols).astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    sorted_ = rank[order]
    new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = start
    at = np.flatnonzero(~new | np.append(~new[1:], False))
    while len(at):
        own = order[at]
        after = np.where(own + step < n, rank[np.minimum(own + step, n - 1)], -1)
        by = np.lexsort((after, start[at]))
        own, after, group = own[by], after[by], start[at]
        differs = np.concatenate(([True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])))
        order[at], start[at] = own, np.maximum.accumulate(np.where(differs, at, 0))
        rank[own] = start[at]
        at = at[~differs | np.append(~differs[1:], False)]
        step *= 2
    lcp = np.zeros(n, text.small)
    lcp[1:] = text.common(order[1:], order[:-1])
    return order, lcp


def sort_suffixes(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """All positions in order of their suffixes, and the common prefix of each with the one before it (0 for the first)."""
    n = text.n
    stars = np.concatenate([a + np.flatnonzero(text.larger[a:b] & ~np.append(text.larger[a - 1] if a else True, text.larger[a : b - 1])) for a, b in _blocks(n)]) if n else np.zeros(0, np.int64)
    seeds, common = stars, np.zeros(len(stars), text.small)
    if len(stars):
        names, size, advance = _names(text, stars)
        if size == len(stars):
            seeds = np.empty(len(stars), np.int64)
            seeds[names] = stars
            common[1:] = text.common(seeds[1:], seeds[:-1])
        else:
            below = Text(names, size, text.limit, advance, text, stars)
            order, common = (_sort_within if 8 * below.n <= MEMORY else sort_suffixes)(below)
            seeds = stars[order]
    n_large = int(sum(text.larger[a:b].sum() for a, b in _blocks(n)))
    down_p, down_l = _induce(text, _Seeds(seeds, common, False), False, n - n_large)
    up_p, up_l = _induce(text, _Seeds(down_p, down_l, True), True, n_large)
    # L suffixes come before S ones of their symbol
    kinds = np.zeros((2, text.size), np.int64)
    for a, b in _blocks(n):
        for k in (0, 1):
            kinds[k] += np.bincount(text.symbols[a:b][text.larger[a:b] == bool(k)], minlength=text.size)
    before = np.concatenate((np.zeros((2, 1), np.int64), np.cumsum(kinds, 1)), 1)
    order, lcp = room(n, np.int64), room(n, text.small)
    for a, b in _blocks(len(down_p)):
        at = np.arange(a, b) + before[1][text.symbols[down_p[a:b]]]
        order[at], lcp[at] = down_p[a:b], down_l[a:b]
    m = len(up_p)
    for a, b in _blocks(m):
        p = up_p[m - b : m - a][::-1]
        at = np.arange(a, b) + before[0][text.symbols[p].astype(np.int64) + 1]
        order[at] = p
        lcp[at] = np.append(0 if a == 0 else up_l[m - a], up_l[m - b + 1 : m - a][::-1])
    starts = np.flatnonzero(kinds.sum(0))
    first = (before[0] + before[1])[starts]
    if n:
        lcp[first[0]] = 0
        lcp[first[1:]] = np.minimum(text.differ(order[first[1:]], order[first[1:] - 1]), text.limit)
    both = np.flatnonzero((kinds > 0).all(0))
    seam = before[0][both + 1] + before[1][both]
    lcp[seam] = text.common(order[seam], order[seam - 1])
    return order, lcp
