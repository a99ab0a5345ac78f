"""External induced sorting of all suffixes of a byte string, with their common-prefix lengths.

Suffixes smaller than the next one (S) and larger (L) alternate in runs; the first S of each run, the leftmost ones, are sorted first:
the substrings between them are named by rank, and the string of names is sorted by the same procedure, recursively, until it
is short. The order of all others is induced. For bytes, tuples (position, common prefix with the one before) pass
through a queue for each first byte, served in the order of bytes: taking a suffix puts the suffix one byte longer
behind all that its first byte already has, and their common prefix is one more than the least among those passed since. For
names, of which there are as many as suffixes, a queue holds each range of names, and a range is put in order at once: by name and next
suffix, again where the next suffix lies in the same range.

Text, types, names and results are mapped files, queues and lists are files, all without a name in the temporary folder
(``Store``), read and written in blocks; the system keeps of mapped files what it has room for. A queue holds ``memory`` bytes
before it writes, and a block is ``memory`` / 32 items, so a text may be far larger than memory: it takes some 40
bytes of disk for each of its own. Names are sorted in memory only when they are as few as a block. A single name that more suffixes
have than a block holds is put in order in one piece.

Order and common prefixes are exact to ``depth`` bytes; suffixes equal to that depth come in any order.
"""

from __future__ import annotations

import heapq
import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

#: Bytes that a queue keeps in memory; blocks are in proportion.
MEMORY = 8 << 20


class Store:
    """Arrays in files that are gone when the process is; counts the bytes written and how deep names were sorted by themselves."""

    def __init__(self, memory: int = MEMORY, folder: str | None = None):
        self.memory, self.folder, self.block = memory, folder, max(16, memory // 32)
        self.spilled = self.levels = 0

    def file(self):
        return tempfile.TemporaryFile(dir=self.folder)

    def array(self, n: int, kind: str) -> np.ndarray:
        """A mapping of ``n`` zeros."""
        if not n:
            return np.zeros(0, kind)
        f = self.file()
        f.truncate(n * np.dtype(kind).itemsize)
        return np.memmap(f, kind, "r+", shape=(n,))

    def listed(self, parts: Iterator[np.ndarray], kind: str) -> np.ndarray:
        """A mapping of all parts one after the other."""
        f, n = self.file(), 0
        for part in parts:
            part.astype(kind).tofile(f)
            n += len(part)
        f.flush()
        return np.memmap(f, kind, "r+", shape=(n,)) if n else np.zeros(0, kind)

    def blocks(self, n: int, down: bool = False) -> Iterator[tuple[int, int]]:
        starts = range(0, n, self.block)
        for a in reversed(starts) if down else starts:
            yield a, min(n, a + self.block)


class _Queue:
    """First in, first out queues of tuples, one for each key; the caller serves keys in order."""

    def __init__(self, store: Store):
        self.store, self.blocks, self.held, self.disk = store, {}, 0, None

    def put(self, key: int, *columns: np.ndarray) -> None:
        self.blocks.setdefault(key, deque()).append(columns)
        self.held += sum(c.nbytes for c in columns)
        if self.held > self.store.memory:
            self._spill()

    def _spill(self) -> None:
        """Writes all that is in memory; what a key has on disk comes before that."""
        self.disk = self.disk or self.store.file()
        for parts in self.blocks.values():
            fresh = []
            while parts and isinstance(parts[-1][0], np.ndarray):
                fresh.append(parts.pop())
            if fresh:
                columns = [np.concatenate(c) for c in zip(*reversed(fresh), strict=True)]
                for a, z in self.store.blocks(len(columns[0])):
                    self.disk.seek(0, 2)
                    parts.append((self.disk.tell(), z - a, [c.dtype for c in columns]))
                    for c in columns:
                        c[a:z].tofile(self.disk)
                        self.store.spilled += c[a:z].nbytes
                    self.disk.flush()
        self.held = 0

    def take(self, key: int) -> Iterator[tuple[np.ndarray, ...]]:
        """All tuples of a key, about a block at a time, also those put while it is served."""
        waiting = self.blocks.get(key, ())
        while waiting:
            some, size = [], 0
            while waiting and size < self.store.block:
                part = waiting.popleft()
                if isinstance(part[0], np.ndarray):
                    self.held -= sum(c.nbytes for c in part)
                else:
                    at, n, kinds = part
                    self.disk.seek(at)
                    part = tuple(np.fromfile(self.disk, kind, n) for kind in kinds)
                some.append(part)
                size += len(part[0])
            yield some[0] if len(some) == 1 else tuple(np.concatenate(c) for c in zip(*some, strict=True))
        self.blocks.pop(key, None)


def _range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low : high + 1] for each pair, low <= high, by tables of powers of two."""
    if not len(low):
        return values[:0]
    span = high - low + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out, table = np.empty(len(low), values.dtype), values
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
        if (1 << k) < len(table):
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


class _Induction:
    """One pass over the sorted sequence, which puts longer suffixes behind each other by first byte."""

    def __init__(self, depth: int, store: Store):
        self.depth, self.queue = depth, _Queue(store)
        self.least: dict[int, int] = {}  # the least common prefix passed since a key's last entry
        self.todo: list[int] = []
        self.listed: set[int] = set()

    def expect(self, keys) -> None:
        for k in keys:
            if k not in self.listed:
                self.listed.add(k)
                heapq.heappush(self.todo, k)

    def passed(self, lcps: np.ndarray, sources: np.ndarray, positions: np.ndarray, keys: np.ndarray, sign: int) -> None:
        """A block of the sequence went by; its entries at ``sources`` put ``positions`` behind what ``keys`` have."""
        all_least = int(lcps.min())
        present = set()
        if len(sources):
            order = np.argsort(keys, kind="stable")
            keys, at, positions = keys[order], sources[order], positions[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            before = np.minimum.accumulate(lcps)
            after = np.minimum.accumulate(lcps[::-1])[::-1]
            new = np.empty(len(at), np.int16)
            inner = np.ones(len(at), bool)
            inner[first] = False
            inner = np.flatnonzero(inner)
            new[inner] = _range_minima(lcps, at[inner - 1] + 1, at[inner]) + 1
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
                k = int(keys[lo])
                present.add(k)
                new[lo] = min(self.least[k], int(before[at[lo]])) + 1 if k in self.least else 0
                last = int(at[hi - 1])
                self.least[k] = int(after[last + 1]) if last + 1 < len(lcps) else self.depth
                self.queue.put(k, positions[lo:hi], np.minimum(new[lo:hi], self.depth).astype(np.int16))
        for k, v in self.least.items():
            if k not in present and v > all_least:
                self.least[k] = all_least
        self.expect(sign * k for k in present)


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of suffixes pairwise, to ``depth``."""
    n, out, live = len(text), np.zeros(len(a), np.int16), np.arange(len(a))
    for k in range(depth):
        x, y = a[live] + k, b[live] + k
        inside = (x < n) & (y < n)
        live = live[inside]
        live = live[text[x[inside]] == text[y[inside]]]
        if not len(live):
            break
        out[live] = k + 1
    return out


def _types(text: np.ndarray, store: Store) -> np.ndarray:
    """True for S suffixes; the last one is L, as the end is smaller than any symbol. Blocks from the end on."""
    n, out, follows = len(text), store.array(len(text), "?"), False
    for a, z in store.blocks(n - 1, down=True):
        part = np.array(text[a : z + 1])
        differs = np.flatnonzero(part[:-1] != part[1:])
        less = np.append(part[differs] < part[differs + 1], follows)  # equal ones are as what follows them
        out[a:z] = less[np.searchsorted(differs, np.arange(z - a))]
        follows = bool(out[a])
    return out


def _leftmost(small: np.ndarray, store: Store) -> np.ndarray:
    """The first S suffix of each run but one at the beginning, ascending."""

    def parts() -> Iterator[np.ndarray]:
        for a, z in store.blocks(len(small)):
            here = np.array(small[max(a - 1, 0) : z])
            yield np.flatnonzero(here[1:] & ~here[:-1]) + max(a - 1, 0) + 1

    return store.listed(parts(), _kind(len(small)))


def _kind(n: int) -> str:
    return "<i4" if n < 1 << 30 else "<i8"


def _named(text: np.ndarray, small: np.ndarray, starts: np.ndarray, depth: int, top: int, store: Store) -> np.ndarray:
    """Ranks of the substrings from each start to the next one, both ends included, to ``depth`` symbols of ``top`` at most.

    A rank is the number of smaller substrings. Where a list is longer than a block it is dealt out by its next symbols, between and at
    values of a sample of them; lists of one value go on with the symbols that follow.
    """
    m, names = len(starts), store.array(len(starts), _kind(len(text)))
    wide = top.bit_length() + 2
    each, last = max(1, 63 // wide), len(text) - 1

    def words(ids: np.ndarray, at: int) -> np.ndarray:
        begin = np.array(starts[ids], np.int64)
        end = np.minimum(np.where(ids + 1 < m, starts[np.minimum(ids + 1, m - 1)], last), begin + depth)
        key = np.zeros(len(ids), np.uint64)
        for k in range(at, at + each):
            x = np.minimum(begin + k, last)
            code = (text[x].astype(np.uint64) << np.uint64(1) | small[x].astype(np.uint64)) + np.uint64(1)
            key = key << np.uint64(wide) | np.where(begin + k <= end, code, np.uint64(0))
        return key

    def ended(key: np.ndarray) -> np.ndarray:
        return key & np.uint64((1 << wide) - 1) == 0

    def in_memory(ids: np.ndarray, at: int, base: int) -> None:
        rank, live = np.zeros(len(ids), np.int64), np.arange(len(ids))
        while len(live):
            key = words(ids[live], at)
            order = np.lexsort((key, rank[live]))
            r, k = rank[live][order], key[order]
            first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])]))
            group = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            times = np.diff(np.append(first, len(r)))
            smaller = first - group[np.searchsorted(group, first, side="right") - 1]
            rank[live[order]] = r + np.repeat(smaller, times)
            going = np.repeat(times > 1, times) & ~ended(k)
            live, at = live[order[going]], at + each
        names[ids] = base + rank

    todo = [(None, m, 0, 0)]
    while todo:
        listed, n, at, base = todo.pop()
        get = (lambda a, z: np.arange(a, z)) if listed is None else (lambda a, z, x=listed: np.array(x[a:z], np.int64))
        if n <= store.block:
            in_memory(get(0, n), at, base)
            continue
        sample = np.unique(np.linspace(0, n - 1, 4096).astype(np.int64))
        keys = np.sort(words(sample if listed is None else np.array(listed[sample], np.int64), at))
        splits = np.unique(keys[:: max(1, len(keys) // 64)])
        dealt, counts = _Queue(store), np.zeros(2 * len(splits) + 1, np.int64)
        for a, z in store.blocks(n):
            ids = get(a, z)
            key = words(ids, at)
            bucket = np.searchsorted(splits, key, side="left")
            bucket = 2 * bucket + ((bucket < len(splits)) & (splits[np.minimum(bucket, len(splits) - 1)] == key))
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
                dealt.put(int(bucket[lo]), ids[order[lo:hi]])
                counts[bucket[lo]] += hi - lo
        for b, before in zip(range(len(counts)), (np.cumsum(counts) - counts).tolist(), strict=True):
            if not counts[b]:
                continue
            if b % 2 and ended(splits[b // 2 : b // 2 + 1])[0]:
                for (ids,) in dealt.take(b):
                    names[ids] = base + before
                continue
            part = store.listed((ids for (ids,) in dealt.take(b)), "<i8")
            todo.append((part, int(counts[b]), at + each * (b % 2), base + before))
    return names


def _doubled(names: np.ndarray, starts: np.ndarray, depth: int, end: int) -> np.ndarray:
    """Order of the suffixes of a few names, by doubling, until they differ or span ``depth`` bytes."""
    n, h = len(names), 1
    rank = np.unique(names, return_inverse=True)[1].astype(np.uint64)
    while True:
        second = np.zeros(n, np.uint64)
        second[: n - h] = rank[h:] + np.uint64(1)
        _, inverse, counts = np.unique(rank << np.uint64(32) | second, return_inverse=True, return_counts=True)
        rank, h = inverse.astype(np.uint64), 2 * h
        tied = np.flatnonzero(counts[inverse] > 1)
        if not len(tied) or h >= n:
            break
        reach = np.where(tied + h < n, starts[np.minimum(tied + h, n - 1)], end)
        if (reach - starts[tied] >= depth).all():
            break
    return np.argsort(rank, kind="stable")


def _by_names(names: np.ndarray, starts: np.ndarray, depth: int, end: int, store: Store, level: int = 1) -> np.ndarray:
    """Order of the suffixes of a string of names, which start at the bytes ``starts``."""
    m, kind = len(names), _kind(len(names))
    if m <= store.block:
        return _doubled(np.array(names, np.int64), np.array(starts, np.int64), depth, end)
    store.levels = max(store.levels, level)
    small = _types(names, store)
    lms = _leftmost(small, store)
    place = store.array(m, kind)  # of a suffix among those of its name and type; at last, its place in the order
    if len(lms):
        inner = _named(names, small, lms, depth // 2 + 2, m, store)
        at = store.listed((np.array(starts[lms[a:z]]) for a, z in store.blocks(len(lms))), starts.dtype.str)
        order = _by_names(inner, at, depth, end, store, level + 1)
        for a, z in store.blocks(len(lms)):
            place[lms[order[a:z]]] = np.arange(a, z)
        del inner, at, order
    size = store.block
    queues = {False: _Queue(store), True: _Queue(store)}
    for a, z in store.blocks(m):
        group = np.array(names[a:z]) // size
        for kind_of, queue in queues.items():
            here = np.flatnonzero(small[a:z] == kind_of)
            here = here[np.argsort(group[here], kind="stable")]
            g = group[here]
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else []
            for lo, hi in zip(first, [*first[1:], len(g)], strict=False):
                queue.put(int(g[lo]), (a + here[lo:hi]).astype(kind))
    larger, out = store.array(m, kind), store.array(m, kind)
    groups = -(-m // size)
    for is_small, queue in queues.items():
        for g in reversed(range(groups)) if is_small else range(groups):
            parts = [p for (p,) in queue.take(g)]
            if not parts:
                continue
            p = np.sort(np.concatenate(parts).astype(np.int64))
            mine, more = np.array(names[p], np.int64), p + 1 < m
            nxt = np.minimum(p + 1, m - 1)
            name, small_next = np.array(names[nxt], np.int64), np.array(small[nxt])
            second = np.where(more, 2 * name + small_next + 1, 0)
            within = np.flatnonzero(more & (small_next == is_small) & (name // size == g))
            third = np.array(place[nxt], np.int64)
            third[within] = 0
            of = np.searchsorted(p, nxt[within])  # the next suffix, among these
            order = np.lexsort((third, second, mine))
            rank = _dense(order, mine, second, third)
            for _ in range(depth):
                if not len(within):
                    break
                third[within] = rank[of]
                times = np.bincount(rank, minlength=len(p))
                live = np.zeros(len(p), bool)
                live[rank[within]] = True
                live = np.flatnonzero(live[rank] & (times[rank] > 1))  # ties that hold one whose next suffix is among these
                if not len(live):
                    break
                inner = live[np.lexsort((third[live], rank[live]))]
                changed = _dense(inner, rank, rank, third, base=True)
                if np.array_equal(changed, rank[inner]):
                    break
                rank[inner] = changed
            order = np.argsort(rank, kind="stable")
            p, mine = p[order], mine[order]
            first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            times = np.diff(np.append(first, len(p)))
            at = mine + np.arange(len(p)) - np.repeat(first, times)
            if is_small:
                at += larger[mine]
            else:
                larger[mine[first]] = times
            place[p] = at
            out[at] = p
    return out


def _dense(order: np.ndarray, one: np.ndarray, two: np.ndarray, three: np.ndarray, base: bool = False) -> np.ndarray:
    """For items in an order by three keys, the place of the first equal one: by item; or, with ``base``, in that order, counted from ``one``."""
    a, b, c = one[order], two[order], three[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
    at = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    if base:
        start = np.maximum.accumulate(np.where(np.concatenate([[True], a[1:] != a[:-1]]), np.arange(len(order)), 0))
        return a + at - start
    out = np.empty(len(order), np.int64)
    out[order] = at
    return out


def suffix_order(text: np.ndarray, depth: int, store: Store | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All positions of ``text`` in the order of their suffixes, and the common prefix of each with the one before it, as mapped files."""
    store = store or Store()
    n, kind = len(text), _kind(len(text))
    order, lcps = store.array(n, kind), store.array(n, "<i2")
    if n < 2:
        return order, lcps
    small = _types(text, store)
    lms = _leftmost(small, store)
    if len(lms):
        names = _named(text, small, lms, depth, 255, store)
        by = _by_names(names, lms, depth, n, store)
        lms = store.listed((lms[by[a:z]] for a, z in store.blocks(len(lms))), kind)
        del names, by
    del small
    counts, starts = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for a, z in store.blocks(n):
        counts += np.bincount(text[a:z], minlength=256)
    for a, z in store.blocks(len(lms)):
        starts += np.bincount(text[lms[a:z]], minlength=256)
    begin, lms_begin = np.cumsum(counts) - counts, np.cumsum(starts) - starts
    n_larger = np.zeros(256, np.int64)

    # L suffixes, ascending: those of a byte come before its leftmost S ones
    up = _Induction(depth, store)
    last = int(text[n - 1])
    up.queue.put(last, np.array([n - 1], kind), np.zeros(1, np.int16))
    up.least[last] = 0
    up.expect([last, *np.flatnonzero(starts).tolist()])
    while up.todo:
        c = heapq.heappop(up.todo)
        at = begin[c]
        for positions, lcp in up.queue.take(c):
            order[at : at + len(positions)], lcps[at : at + len(positions)] = positions, lcp
            at += len(positions)
            before = positions - 1
            ok = np.flatnonzero((before >= 0) & (text[np.maximum(before, 0)] >= c))
            up.passed(lcp, ok, before[ok], text[before[ok]], 1)
        n_larger[c] = at - begin[c]
        previous = np.array(order[at - 1 : at]) if n_larger[c] else None
        for a, z in store.blocks(int(starts[c])):
            positions = np.array(lms[lms_begin[c] + a : lms_begin[c] + z])
            lcp = np.zeros(len(positions), np.int16)
            lcp[1:] = _common(text, positions[:-1], positions[1:], depth)
            if previous is not None:
                lcp[:1] = _common(text, previous, positions[:1], depth)
            previous = positions[-1:]
            up.passed(lcp, np.arange(len(positions)), positions - 1, text[positions - 1], 1)

    # S suffixes, descending: behind the L ones of their byte; the seam between both is compared directly
    down = _Induction(depth, store)
    down.expect((-np.flatnonzero(n_larger)).tolist())
    while down.todo:
        c = -heapq.heappop(down.todo)
        at = end = begin[c] + counts[c]
        for positions, lcp in down.queue.take(c):
            order[at - len(positions) : at] = positions[::-1]
            upto = min(at + 1, end)  # a common prefix with the next one is that one's with the one before
            lcps[at - len(positions) + 1 : upto] = lcp[::-1][: upto - (at - len(positions) + 1)]
            at -= len(positions)
            before = positions - 1
            ok = np.flatnonzero((before >= 0) & (text[np.maximum(before, 0)] <= c))
            down.passed(lcp, ok, before[ok], text[before[ok]], -1)
        seam, border = 0, begin[c] + n_larger[c]
        if n_larger[c] and at < end:
            seam = lcps[at] = _common(text, np.array(order[border - 1 : border]), np.array(order[at : at + 1]), depth)[0]
        elif at < end:
            lcps[at] = 0
        for a, z in store.blocks(int(n_larger[c]), down=True):
            a, z = begin[c] + a, begin[c] + z
            positions = np.array(order[a:z])[::-1]
            right = np.append(lcps[a + 1 : z], lcps[z] if z < border else seam).astype(np.int16)[::-1]
            before = positions - 1
            ok = np.flatnonzero((before >= 0) & (text[np.maximum(before, 0)] < c))
            down.passed(right, ok, before[ok], text[before[ok]], -1)
    return order, lcps
