"""Exact n-gram Jaccard join by prefixes of token combinations, and the components of its links.

A document's set holds its distinct word shingles (the whole sequence, if it has fewer words). Equal sets are one class;
one of it takes part in what follows.

Fingerprints. A word of up to 64 bytes is a sum of its bytes, each times a random 64-bit number of its place; a longer one
is its keyed BLAKE2b. A shingle mixes the fingerprints of its words to 64 bits, of which a range's task keeps 48 beside
the range's number. So two given shingles are taken for the same with a chance of about 2^-48 at worst, whatever
their words; classes are told apart by 128 bits of all of a set's fingerprints.

Order the shingles of all sets by how frequent they are, rare ones first. A set that links with this one lacks at most e of its
shingles, so a prefix stays in touch if any e of its shingles can go and a signature is left. A rare shingle is a
signature by itself. A frequent one is none: frequent shingles are dealt into token classes, and each two of a class are
a signature, so that a class of c shingles stands c - 1 losses; the prefix is extended until its losses add up to
more than e. The number of classes follows the set's size, so that there are about as many pairs as shingles; a set near
the border of two sizes has the signatures of both. Links between different sets always share a signature.

Frequencies are exact and of all sets, but for those of common shingles, which 16 sets of one block of text have: all of these count as equally
frequent, above all others, and their sets do not meet in one task. Shingles that only one set has come first in the order; they can be no signature, so
they are only counted, and a set that has more of them than it may lose can link with nothing and goes no further.
Fingerprints travel to the task of their range in packed blocks, beside the set's number in its block; only shared ones come back, with their
frequency, to where the block's table of digests is sent. Of common ones a block sends one each to the range's task, and which sets have them straight on.
Of equal sets only the first is sent, but for a few that a table of bits cannot tell from it. Those count as sets of their own: then shingles that
no other set has may pass for shared ones, which costs time and changes no link.

Verification. Sets of a signature are compared with one of them, the pivot P: the set of the most frequent shingles. Let x
be the number of shingles by which a set differs from P (P's own unshared ones left out). Two sets A and B differ by x_A + x_B - 2c, where c counts
the differences from P that they have in common, and they link if that is at most k (n_A + n_B), k = (100 - percent) /
(100 + percent). With s = x - k n, they link for certain if s_A + s_B <= 0, and all such links are had by linking to M, the set of the
least s. Any other link needs c >= (s_A + s_B) / 2 > 0. So sets that are still apart get new signatures, the rarest of their
differences from P, in prefixes of the same kind: near copies of one text share nearly all shingles, but few of their
differences. Those groups go through the same steps again, a few times, and only what is still apart then, and in groups of
few, is compared pairwise. A group of near copies thus costs about its size, and no link between components is lost.

Null and empty texts, and those of white space, have no set and are alone. Rows that repeat an id are one document with
all their sets. Rows without an id are their own components, of a null id. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumbung.llm.common import documents, hash_bits, materialise, release, small_batches, text_of, tidy, with_maybe

#: Fingerprints for each range: what a task holds at a time. Text bytes that a task gathers before it sends its blocks.
RANGE_ITEMS, BLOCK_BYTES = 2 << 20, 8 << 20
#: Sets that may share a shingle for it to be rare.
RARE = 8
#: Sets of one block that make a shingle common: it is then not counted any further.
COMMON, COUNTED = 16, 65534
#: Sets of a signature that are compared pairwise at once. Rounds of pivots before larger groups are, too.
FEW, ROUNDS = 8, 3
#: Bits of the tables of sets that are still looked up: 1 MB each.
OPEN_BITS = 1 << 23
#: Bytes up to which a word's fingerprint is a sum over its places.
SHORT_WORD = 64

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KEY = np.random.default_rng(20240607).integers(0, 1 << 63, SHORT_WORD + 1, dtype=np.uint64) * _U(2) + _U(1)
_LONG = b"words of more bytes"
_PLACE = np.random.default_rng(20240608).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A fingerprint of each word of ``data``, which ends no word of its own in the middle."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return np.empty(0, np.uint64)
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[0::2], edge[1::2]
    size = end - start
    place = np.arange(len(a), dtype=np.int32)
    place[space] = 0
    letters = ~space
    place[letters] -= np.repeat(start.astype(np.int32), size)
    np.minimum(place, SHORT_WORD - 1, out=place)
    sums = np.empty(len(a) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((a.astype(np.uint64) + _U(1)) * _KEY[place], out=sums[1:])
    out = mixed(sums[end] - sums[start] + size.astype(np.uint64) * _KEY[SHORT_WORD])
    for i in np.flatnonzero(size > SHORT_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, key=_LONG).digest(), "little")
    return out


def shingle_sets(texts: list[bytes], n: int, block: int = 1 << 20) -> Iterator[np.ndarray]:
    """The sorted distinct fingerprints of each text's shingles."""

    def pieces(text: bytes) -> Iterator[bytes]:
        at = 0
        while len(text) - at > block:  # cut where a word ends
            cut = at + block
            while cut < len(text) and not _SPACE[text[cut]]:
                cut += 1
            yield text[at:cut]
            at = cut
        yield text[at:]

    def sets(some: list[bytes]) -> Iterator[np.ndarray]:
        if len(some) == 1:
            hashes, counts = np.concatenate([word_hashes(p) for p in pieces(some[0])]), None
            bounds = [0, len(hashes)]
        else:
            joined = b"\n".join(some)
            a = np.frombuffer(joined, np.uint8)
            space = _SPACE[a]
            starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(a) else np.empty(0, np.int64)
            ends = np.cumsum([len(t) + 1 for t in some])
            hashes, bounds = word_hashes(joined), [0, *np.searchsorted(starts, ends).tolist()]
        total = hashes * _PLACE[0]
        for k in range(1, n):
            total[: len(total) - k] += hashes[k:] * _PLACE[k]
        total = mixed(total)
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if hi - lo >= n:
                yield np.unique(total[lo : hi - n + 1])
            elif hi > lo:
                yield mixed((hashes[lo:hi] * _PLACE[n : n + hi - lo]).sum(keepdims=True, dtype=np.uint64) + _U(hi - lo))
            else:
                yield np.empty(0, np.uint64)

    group, size = [], 0
    for text in texts:
        text = text.lower()  # of bytes: A to Z only
        if group and size + len(text) > block:
            yield from sets(group)
            group, size = [], 0
        group.append(text)
        size += len(text) + 1
    if group:
        yield from sets(group)


def least_overlap(n: int, percent: int) -> int:
    """The shingles that a set of ``n`` shares at least with any that it links with."""
    return -(-percent * n // 100)


def has_partners(n: int, percent: int) -> bool:
    """Whether a set of ``n`` can link with a different one."""
    return n > 0 and (100 * n // percent > n or least_overlap(n, percent) < n)


def signatures(shared: np.ndarray, often: np.ndarray, n: int, percent: int) -> np.ndarray:
    """The signatures of a set of ``n`` shingles, given its shared ones and how many sets have each: of rare ones, and of
    pairs of frequent ones within a class. The others come before these in the order, and are no signatures."""
    alone = n - len(shared)
    order = np.lexsort((shared, often))
    s, frequent = shared[order], often[order] > RARE
    low, high = least_overlap(n, percent), 100 * n // percent
    losses = n - low - alone
    if losses < 0:
        return np.empty(0, np.uint64)
    rounds = lambda size: max(1, size - least_overlap(size, percent)).bit_length() - 1
    out, singles = [], 0
    for r in range(rounds(low), rounds(high) + 1):
        classes = mixed(s) & _U((1 << r) - 1)
        stands = np.ones(len(s), bool)
        at = np.flatnonzero(frequent)
        stands[at[np.unique(classes[at], return_index=True)[1]]] = False  # the first of a class stands no loss
        upto = int(np.searchsorted(np.cumsum(stands), losses + 1)) + 1
        singles = max(singles, min(upto, len(s)))
        at = at[at < upto]
        at = at[np.argsort(classes[at], kind="stable")]
        c, x = classes[at], s[at]
        for d in range(1, len(at)):
            same = c[d:] == c[:-d]
            if not same.any():
                break
            # members of a class keep their order, so a pair is the same in every set
            out.append(mixed(x[:-d][same] * _PLACE[40] + x[d:][same] * _PLACE[41] + _U(r)))
    rare = s[:singles]
    out.append(mixed(rare[~frequent[:singles]] + _U(1)))
    return np.unique(np.concatenate(out))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("__text"))


def _set_rows(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n and digest of each text's set."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest()) for s in shingle_sets([t.as_py() for t in batch.column("__text").cast(pa.binary())], n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([k for k, _ in got], pa.int64()), pa.array([d for _, d in got], pa.binary())], ["doc_id", "n", "digest"])

    return _texts(docs).mapInArrow(tidy(run), "doc_id bigint, n bigint, digest binary")


def _pack(*arrays: np.ndarray) -> bytes:
    import pyarrow as pa

    raw = b"".join([np.array([a.nbytes for a in arrays], "<u8").tobytes(), *(a.tobytes() for a in arrays)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    import pyarrow as pa

    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    at, out = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(raw, "<u8", len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _planes(numbers: np.ndarray) -> np.ndarray:
    """The first bytes of all numbers of 4 bytes, then all second ones and so on: small numbers are packed to little."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _numbers(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _gaps(own: np.ndarray) -> np.ndarray:
    """Ascending numbers, packed as their differences."""
    return _planes(np.diff(own.astype(np.int64), prepend=0))


def _from_gaps(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(_numbers(planes), dtype=np.int64)


def _shared_shingles(docs: DataFrame, n: int, percent: int, bits: int) -> DataFrame:
    """(digest, n, weight, shared, often): the sets with enough shingles that other sets have too, these, how many sets have each, and the sum of that.

    A set goes by its number in its block. A block's table of digests and sizes is sent once, to where the ranges' tasks send what they
    find of the block, so what a shingle costs does not grow with the number of ranges. A task takes each set once; a copy in another
    task counts as another set there, which gives both more shared shingles than they need, and a row each.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    sent_as = ["part", "block", "direct", "data"]
    found_as = ["block", "part", "data"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()

        def blocks(sets: list[np.ndarray], digests: list[bytes], number: int) -> pa.RecordBatch:
            h, own = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
            table, sizes = np.frombuffer(b"".join(digests), np.uint8), np.array([len(s) for s in sets], "<u4")
            name = hashlib.blake2b(table.tobytes(), digest_size=8, key=f"{TaskContext.get().partitionId()} {number}".encode())
            block = int.from_bytes(name.digest(), "little", signed=True)
            by_hash = np.argsort(h)
            first = np.flatnonzero(np.concatenate([[True], h[by_hash[1:]] != h[by_hash[:-1]]]))
            times = np.diff(np.append(first, len(h)))
            common = np.zeros(len(h), bool)
            common[by_hash] = np.repeat(times >= COMMON, times)
            hot = h[by_hash[first[times >= COMMON]]]
            part_of = lambda x: (x >> _U(64 - bits)).astype(np.int32) if bits else np.zeros(len(x), np.int32)
            rest = lambda x: ((x << _U(bits) >> _U(32)).astype("<u4"), (x << _U(bits) >> _U(16) & _U(0xFFFF)).astype("<u2"))
            to, out = [], []

            left = np.flatnonzero(~common)
            part, hot_part = part_of(h[left]), part_of(hot)  # hot ones ascend, and so do their parts
            order = left[np.argsort(part, kind="stable")]
            ends, hot_ends = (np.searchsorted(np.sort(x), np.arange((1 << bits) + 1)) for x in (part, hot_part))
            for p in np.flatnonzero((np.diff(ends) > 0) | (np.diff(hot_ends) > 0)).tolist():
                i = order[ends[p] : ends[p + 1]]  # a set's shingles are together
                out.append(_pack(*rest(h[i]), _gaps(own[i]), *rest(hot[hot_ends[p] : hot_ends[p + 1]])))
                to.append(p)

            # common shingles go straight on with the table, with the range's number in each fingerprint
            i = np.flatnonzero(common)
            whole = part_of(h[i]).astype(np.uint64) << _U(48) | h[i] << _U(bits) >> _U(16)
            answers = np.array([len(to)], "<u4")
            out.append(_pack(table, sizes, _gaps(own[i]), whole, answers))
            to.append(block % (1 << bits))
            direct = [False] * (len(to) - 1) + [True]
            return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([block] * len(to), pa.int64()), pa.array(direct), pa.array(out, pa.binary())], sent_as)

        sets, digests, size, number = [], [], 0, 0
        for batch in batches:
            for s in shingle_sets([t.as_py() for t in batch.column("__text").cast(pa.binary())], n):
                if not has_partners(len(s), percent):
                    continue
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if digest in seen:
                    continue
                if len(seen) < 1 << 18:
                    seen.add(digest)
                sets.append(s)
                digests.append(digest)
                size += 8 * len(s)
                if size > BLOCK_BYTES:
                    yield blocks(sets, digests, number)
                    sets, digests, size, number = [], [], 0, number + 1
        if sets:
            yield blocks(sets, digests, number)

    def count(part: int, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        got = [_unpack(b, "<u4", "<u2", "u1", "<u4", "<u2") for _, b in held]
        common = np.unique(np.concatenate([g[3].astype(np.uint64) << _U(16) | g[4] for g in got]))
        ends = np.cumsum([0, *(len(g[0]) for g in got)]).tolist()
        h = np.concatenate([g[0].astype(np.uint64) << _U(16) | g[1] for g in got])
        order = np.argsort(h)
        h = h[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        times = np.diff(np.append(start, len(h)))
        often = np.empty(len(h), "<u2")
        often[order] = np.repeat(np.where(np.isin(h[start], common, assume_unique=True), COUNTED + 1, np.minimum(times, COUNTED)).astype("<u2"), times)
        del h, order
        out = []
        for g, a, z in zip(got, ends[:-1], ends[1:], strict=True):
            keep = often[a:z] > 1
            out.append(_pack(g[0][keep], g[1][keep], _gaps(_from_gaps(g[2])[keep]), _planes(often[a:z][keep])))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int64()), pa.array([part] * len(out), pa.int32()), pa.array(out, pa.binary())], found_as)

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for k, block, straight, v in zip(*(batch.column(c).to_pylist() for c in sent_as[:3]), batch.column("data"), strict=True):
                if straight:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1], pa.int32()), pa.array([v.as_py()], pa.binary())], found_as)
                    continue
                if k != current and held:
                    yield from count(current, held)
                    held = []
                current = k
                held.append((block, v.as_py()))
        if held:
            yield from count(current, held)

    def gathered(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        tables = [_unpack(b, "V16", "<u4", "u1", "<u8", "<u4") for part, b in held if part < 0]
        if len(tables) != 1 or tables[0][4][0] != len(held) - 1:
            raise ValueError("a block's table and the ranges' answers do not belong together: the documents came in another order when a task was run again")
        table, sizes, own, h, _ = tables[0]
        owns, hs, oftens = [_from_gaps(own)], [h], [np.full(len(h), COUNTED + 1, "<u2")]
        for part, b in held:
            if part >= 0:
                high, low, own, often = _unpack(b, "<u4", "<u2", "u1", "u1")
                owns.append(_from_gaps(own))
                hs.append(_U(part) << _U(48) | high.astype(np.uint64) << _U(16) | low)
                oftens.append(_numbers(often).astype("<u2"))
        own, h, often, sizes = np.concatenate(owns), np.concatenate(hs), np.concatenate(oftens), sizes.astype(np.int64)
        del owns, hs, oftens
        # a set with fewer shared shingles than any link needs is out
        stay = (100 * np.bincount(own, minlength=len(sizes)) >= percent * sizes)[own]
        h, own, often = h[stay], own[stay], often[stay]
        order = np.lexsort((h, own))
        h, own, often = h[order], own[order], often[order]
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
        ends = np.append(start[1:], len(own))
        for lo in range(0, len(start), 1024):
            some = list(zip(start[lo : lo + 1024].tolist(), ends[lo : lo + 1024].tolist(), strict=True))
            which = own[start[lo : lo + 1024]]
            columns = ([table[i].tobytes() for i in which], sizes[which], [int(often[a:z].sum(dtype=np.int64)) for a, z in some], [h[a:z].astype("<u8").tobytes() for a, z in some], [often[a:z].tobytes() for a, z in some])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["digest", "n", "weight", "shared", "often"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for k, part, v in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), batch.column("data"), strict=True):
                if k != current and held:
                    yield from gathered(held)
                    held = []
                current = k
                held.append((part, v.as_py()))
        if held:
            yield from gathered(held)

    sent = _texts(docs).mapInArrow(tidy(send), "part int, block bigint, direct boolean, data binary")
    shared = sent.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(receive), "block bigint, part int, data binary")
    return shared.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(collect), "digest binary, n bigint, weight bigint, shared binary, often binary")


def _first_copies(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The documents that classes are named by, and maybe a few others."""
    bits = hash_bits(classes, F.xxhash64("class_id"), "jaccard-first")
    return with_maybe(docs, F.xxhash64(docs["doc_id"].cast("bigint")), bits, "__maybe").where("__maybe").drop("__maybe")


def _once(rows: DataFrame) -> DataFrame:
    """One row of each set ``k``; only those of sets that may have several are looked at together."""
    several = materialise(rows.groupBy("k").agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1").select("k"), "jaccard-several")
    if several.isEmpty():
        release(several)
        return rows
    bits = hash_bits(several, F.xxhash64("k"), "jaccard-bits", OPEN_BITS)
    looked = with_maybe(rows, F.xxhash64("k"), bits, "__maybe", OPEN_BITS)
    out = materialise(looked.where(~F.col("__maybe")).unionByName(looked.where("__maybe").dropDuplicates(["k"])).drop("__maybe"), "jaccard-candidates")
    release(rows, several)
    return out


def _open(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """The sets of some keys ``k``, and maybe a few others: sets are long, and only those that a join asks for go through its shuffle."""
    bits = hash_bits(keys, F.xxhash64("k"), "jaccard-bits", OPEN_BITS)
    return with_maybe(sets, F.xxhash64("k"), bits, "__maybe", OPEN_BITS).where("__maybe").drop("__maybe")


def _beside(sets: DataFrame, pairs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """The pairs (a, b) with the shared shingles of both, as set_a and set_b."""
    sets = _open(sets, pairs.select(F.col("a").alias("k")).union(pairs.select("b")))
    one, two = (sets.select(F.col("k").alias(c), F.col("shared").alias(f"set_{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", *more, "set_a", "set_b")


def _compared(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) with the number of shingles that they have in common: those are among the shared ones of each."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common.append(len(x) + len(y) - len(np.unique(np.concatenate([x, y]))))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64())], ["a", "b", "common"])

    return _beside(sets, pairs).mapInArrow(tidy(run), "a binary, b binary, common bigint")


def _differences(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(p, k, s, d) for the pairs (a, b, s): each shingle d by which the set k = b differs from the pivot p = a, with the side that has it."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[np.ndarray] = []
            of: list[int] = []

            def rows() -> pa.RecordBatch:
                row = pa.array(np.repeat(of, [len(d) for d in parts]))
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in ("a", "b", "s")), pa.array(np.concatenate(parts).view(np.int64))], ["p", "k", "s", "d"])  # noqa: B023

            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                parts.append(np.concatenate([np.setdiff1d(y, x, assume_unique=True), mixed(np.setdiff1d(x, y, assume_unique=True))]))
                of.append(i)
                if sum(map(len, parts)) > 1 << 18:
                    yield rows()
                    parts, of = [], []
            if parts:
                yield rows()

    return _beside(sets, pairs, ("s",)).mapInArrow(tidy(run), "p binary, k binary, s bigint, d bigint")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component) of every document in a link, by alternating large and small stars until nothing changes.

    Each round points a node's neighbours to its least neighbour; hubs meet in partial minima and in joins that can
    be split, never in a list.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "component-edges")
    state = None
    while True:
        before = edges
        ends = edges.union(edges.select("v", "u"))
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ends.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select("v", "m")).distinct()
        edges = materialise(small, "component-edges")
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        release(before)
        if now == state:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct()).distinct()
        state = now


def _together(signed: DataFrame) -> DataFrame:
    """The rows of signatures that several sets have, and both sides where there are two, with the pivot p of each and the number of its sets.

    A pivot has the most frequent shingles; of equal ones it is the one of the greatest key.
    """
    rows = materialise(signed, "jaccard-signatures")
    top = F.max(F.struct("weight", "k", "doc_id", "n")).alias("__top")
    groups = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.min("side").alias("__low"), F.max("side").alias("__high"), top)
    groups = groups.where("size > 1 AND (__low <> __high OR __low = 0)").select("sig", "size", F.col("__top.k").alias("p"), F.col("__top.doc_id").alias("p_doc"), F.col("__top.n").alias("p_n"))
    out = materialise(rows.join(groups, "sig"), "jaccard-groups")
    release(rows)
    return out


def _apart(groups: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of groups whose sets are not all in one component, with the component of each."""
    component = F.coalesce("component", groups["doc_id"]).alias("component")
    rows = groups.join(found, "doc_id", "left").select(*[groups[c] for c in groups.columns], component)
    ends = rows.groupBy("sig").agg(F.min("component").alias("__lo"), F.max("component").alias("__hi")).where("__lo <> __hi").select("sig")
    return materialise(rows.join(ends, "sig", "left_semi"), "jaccard-apart")


def _linked(sets: DataFrame, ids: DataFrame, signed: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """(doc_id, component) of all documents in links: those given and those between sets of a signature."""
    w, lost = 100 + percent, 100 - percent
    # P's own unshared shingles are in no other set, and count for P alone
    alone = sets.select(F.col("k").alias("p"), F.expr("n - octet_length(shared) DIV 8").alias("p_alone"))
    pairwise, old = [], []
    for turn in range(ROUNDS):
        groups = _together(signed)
        fits = F.expr(f"size > {FEW} OR (100 * n >= {percent} * p_n AND 100 * p_n >= {percent} * n)")
        near = groups.where("k <> p").where(fits).select(F.col("p").alias("a"), F.col("k").alias("b"), "p_doc", "p_n", "doc_id", "n").distinct()
        near = materialise(near, "jaccard-near")
        common = _compared(sets, near.select("a", "b"))
        # s of every set beside its pivot, times w; a pivot's own differences are its unshared shingles
        beside = near.join(common, ["a", "b"]).join(alone, F.col("a") == F.col("p"))
        s = F.expr(f"{w} * (n + p_n - p_alone - 2 * common) - {lost} * n").alias("s")
        beside = materialise(beside.select("p", "p_doc", "p_n", "p_alone", F.col("b").alias("k"), "doc_id", s), "jaccard-beside")
        own = F.expr(f"{w} * p_alone - {lost} * p_n")
        least = beside.groupBy("p", "p_doc").agg(F.min(F.struct("s", "doc_id")).alias("__m"), F.first(own).alias("__own"))
        least = least.select("p", F.least("__m", F.struct(F.col("__own").alias("s"), F.col("p_doc").alias("doc_id"))).alias("m"))
        everyone = beside.select("p", "k", "doc_id", "s").union(beside.select("p", F.col("p").alias("k"), F.col("p_doc").alias("doc_id"), own.alias("s")).distinct())
        judged = materialise(everyone.join(least, "p").select("p", "k", "doc_id", "s", F.col("m.s").alias("m_s"), F.col("m.doc_id").alias("m_doc")), "jaccard-judged")
        star = materialise(judged.where("s + m_s <= 0 AND doc_id <> m_doc").select(F.col("doc_id").alias("a"), F.col("m_doc").alias("b")).distinct(), "jaccard-links")
        links = links.unionByName(star)
        found = materialise(components(links), "jaccard-components")
        apart = _apart(groups, found)
        release(groups, near, beside)
        if turn == 0:  # few sets are still of interest
            members = apart.select("k").union(apart.select("p")).distinct()
            sets = materialise(_open(sets, members), "jaccard-open")
            old.append(sets)
        last = turn == ROUNDS - 1
        few = apart if last else apart.where(f"size <= {FEW}")
        if not few.isEmpty():
            pairwise.append(few.where("k <> p").select("sig", "k", "doc_id", "n", "side"))
        many = apart.where(f"size > {FEW}").select("p", "k").distinct()
        old += [apart, judged, star, found]
        if last or many.isEmpty():
            break
        # differences that no other set of the pivot has stand for losses only
        some = judged.join(many, ["p", "k"], "left_semi")
        some = materialise(some, "jaccard-some")
        old.append(some)
        listed = materialise(_differences(sets, some.select(F.col("p").alias("a"), F.col("k").alias("b"), "s")), "jaccard-differences")
        often = listed.groupBy("p", "d").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
        order = Window.partitionBy("p", "k").orderBy("often", "d")
        ranked = listed.join(often, ["p", "d"]).withColumns({"place": F.row_number().over(order), "all": F.count(F.lit(1)).over(Window.partitionBy("p", "k"))})
        ranked = ranked.join(judged.select("p", "m_s").distinct(), "p")
        # what it must share with sets that M does not link, and, if M does not link it either, with those that M does
        up = lambda x: F.greatest(F.lit(1), F.ceil(x / (2 * w)))
        inside = F.col("s") + F.col("m_s") <= 0
        outer = F.struct(F.lit(0).alias("kind"), F.lit(0).alias("side"), up(F.col("s") - F.col("m_s") + 1).alias("need"))
        inner = F.struct(F.lit(1).alias("kind"), F.lit(1).alias("side"), up(F.col("s") - F.col("m_s") + 1).alias("need"))
        across = F.struct(F.lit(1).alias("kind"), F.lit(2).alias("side"), up(F.col("s") + F.col("m_s")).alias("need"))
        ranked = ranked.withColumn("how", F.explode(F.when(inside, F.array(inner)).otherwise(F.array(outer, across)))).where("place <= all - how.need + 1")
        signed = ranked.select(F.xxhash64("p", "d", "how.kind").alias("sig"), "k", F.col("how.side").alias("side")).join(sets.select("k", "n", "weight").join(ids, "k"), "k").select("sig", "k", "doc_id", "n", "weight", "side")
        old.append(listed)
    if pairwise:
        rows = None
        for part in pairwise:  # with the components as they are now
            part = part.join(found, "doc_id", "left").select("sig", "k", "n", "side", part["doc_id"], F.coalesce("component", "doc_id").alias("component"))
            rows = part if rows is None else rows.unionByName(part)
        other = rows.select("sig", *[F.col(c).alias(f"{c}_b") for c in ("k", "n", "side", "doc_id", "component")])
        pairs = rows.join(other, "sig").where(f"k < k_b AND component <> component_b AND (side = 0 OR side <> side_b) AND 100 * n >= {percent} * n_b AND 100 * n_b >= {percent} * n")
        pairs = materialise(pairs.select(F.col("k").alias("a"), F.col("k_b").alias("b"), "doc_id", "doc_id_b", "n", "n_b").distinct(), "jaccard-pairs")
        more = pairs.join(_compared(sets, pairs.select("a", "b")), ["a", "b"]).where(f"100 * common >= {percent} * (n + n_b - common)")
        links = links.unionByName(more.select(F.col("doc_id").alias("a"), F.col("doc_id_b").alias("b")))
        old.append(pairs)
        found = materialise(components(links), "jaccard-components")
    release(*[x for x in old if x is not found])
    return found


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (the least id with an equal set) of every row."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    rows = materialise(_set_rows(docs, n), "jaccard-sets")
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n"), F.count(F.lit(1)).alias("__rows"))
    classes = materialise(classes, "jaccard-classes")
    total, most = classes.agg(F.sum("n"), F.max("__rows")).first()
    bits = (-(-total // RANGE_ITEMS) - 1).bit_length() if total else 0
    taken = docs.where(docs["doc_id"].isNotNull()).select("doc_id", "text")
    if most is not None and most > 1:
        taken = _first_copies(taken, classes)
    sets = _once(materialise(_shared_shingles(taken, n, percent, bits).withColumnRenamed("digest", "k"), "jaccard-candidates"))
    ids = materialise(sets.select("k").join(classes.select(F.col("digest").alias("k"), F.col("class_id").alias("doc_id")), "k"), "jaccard-ids")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [signatures(np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(o.as_buffer(), "<u2"), m.as_py(), percent) for s, o, m in zip(*(batch.column(c) for c in ("shared", "often", "n")), strict=True)]
            row = np.repeat(np.arange(len(got)), [len(g) for g in got])
            sig = np.concatenate([*got, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sig), *(batch.column(c).take(pa.array(row)) for c in ("k", "n", "weight"))], ["sig", "k", "n", "weight"])

    signed = sets.mapInArrow(tidy(sign), "sig bigint, k binary, n bigint, weight bigint").join(ids, "k").select("sig", "k", "doc_id", "n", "weight", F.lit(0).alias("side"))

    # rows of one id are one document: it links the classes of all its sets, and itself if a row of it has no set
    again = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1").select("doc_id")
    repeated = rows.join(again, "doc_id", "left_semi").join(classes.select("digest", "class_id"), "digest", "left")
    links = materialise(repeated.select(F.col("doc_id").alias("a"), F.coalesce("class_id", "doc_id").alias("b")).where("a <> b").distinct(), "jaccard-repeats")
    found = _linked(sets, ids, signed, links, percent)
    release(sets, ids)
    of_class = classes.select("digest", "class_id").join(found.withColumnRenamed("doc_id", "class_id"), "class_id", "left")
    full = rows.where("n > 0").join(of_class, "digest", "left").select("doc_id", "n", "class_id", F.coalesce("component", "class_id").alias("own"))
    empty = rows.where("n = 0").join(found, "doc_id", "left").select("doc_id", "n", F.col("doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("own"))
    out = full.unionByName(empty)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("own")).alias("component_id"), "class_id")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard_join(documents(spark, sf_dir), n=3, percent=90)
