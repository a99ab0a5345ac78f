"""Removal of repeated byte strings across documents, by suffix arrays of shards.

Every string of ``length`` bytes that also starts in a document of a smaller id is removed, byte by byte, as judged on
the input. Equal texts are one text of the least id that has them; a later document of that text is removed whole if it
is long enough. What is left is found in three steps, none of which sends all windows through a shuffle:

1. Anchors. Of each window's 26-byte runs the one of the least fingerprint is its anchor, wherever the window stands.
   Anchors that occur in one text only cannot be part of a repeat; they are found by their fingerprints alone.
2. Shards. The stretch of bytes that an anchor's windows span goes to the shard of the anchor's fingerprint. Equal
   stretches are one there, with the least id that has them; an anchor with one stretch only has no other windows to be compared with.
3. Suffix arrays. Each shard sorts all suffixes of its other stretches with their common prefixes by external induced sorting
   (``suffix_sort``), whose queues and arrays are files; suffixes that share ``length`` bytes are neighbours, and the least id among
   them decides.

Null and empty texts have no bytes. Documents of one id do not count as smaller than each other. A null id neither
removes nor is removed from. An empty table gives an empty result; columns beyond id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.llm.common import documents, materialise, text_of
from lumbung.llm.suffix_sort import Store, suffix_order

LENGTH, ANCHOR = 50, 26
#: Text bytes for each range of fingerprints and each shard, on average; a frequent anchor's shard is larger, and one task holds it.
RANGE_BYTES, SHARD_BYTES = 32 << 20, 12 << 20
#: Bytes of texts that a task gathers before it sends a block for each range or shard.
BLOCK_BYTES = 8 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240609).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    bits = max(16, n.bit_length())
    if (base, bits) not in _POWERS:
        out = np.empty(1 << bits, np.uint64)
        out[0], k = 1, 1
        while k < len(out):
            out[k : 2 * k] = out[:k] * _U(pow(base, k, 1 << 64))
            k *= 2
        _POWERS[base, bits] = out
    return _POWERS[base, bits]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def fingerprints(text: bytes, width: int, block: int = 1 << 20) -> np.ndarray:
    """A fingerprint of the ``width`` bytes from each position."""
    a, out = np.frombuffer(text, np.uint8), []
    for at in range(0, len(a) - width + 1, block):
        part = a[at : at + block + width - 1]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[part] * _powers(_BASE, len(part))[: len(part)], out=sums[1:])
        out.append(_mixed((sums[width:] - sums[:-width]) * _powers(_INVERSE, len(part))[: len(part) - width + 1]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _sliding(a: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        a = f(a[:-n], a[n:])
        n *= 2
    return f(a[: len(a) - (width - n)], a[width - n :]) if n < width else a


def anchors(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Positions and fingerprints of the anchors of all windows; all equal least ones of a window count."""
    if len(text) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h, runs = fingerprints(text, anchor), length - anchor + 1
    least = _sliding(h, runs, np.minimum)
    edge = np.zeros(runs - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), runs, np.maximum) == h)
    return at, h[at]


def _pack(*arrays: np.ndarray) -> bytes:
    import pyarrow as pa

    raw = b"".join([np.array([len(a.tobytes()) for a in arrays], "<u8").tobytes(), *(a.tobytes() for a in arrays)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    import pyarrow as pa

    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    at, out = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(raw, "<u8", len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


def _batch(columns: dict[str, tuple[list, str]]):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, k in columns.values()], list(columns))


def _gathered(batches: Iterator, *columns: str) -> Iterator[list[tuple]]:
    """Rows of some columns, about BLOCK_BYTES of the column ``b`` at a time."""
    some, size = [], 0
    for batch in batches:
        for row in zip(*[batch.column(c) for c in columns], strict=True):
            row = tuple(x.as_py() for x in row)
            some.append(row)
            size += len(row[columns.index("b")])
            if size >= BLOCK_BYTES:
                yield some
                some, size = [], 0
    if some:
        yield some


def _by_key(batches: Iterator, key: str, value: str) -> Iterator[list[bytes]]:
    """The values of each key, of batches that are sorted by it."""
    current, held = None, []
    for batch in batches:
        for k, v in zip(batch.column(key).to_pylist(), batch.column(value), strict=True):
            if k != current and held:
                yield held
                held = []
            current = k
            held.append(v.as_py())
    if held:
        yield held


def _dealt(keys: np.ndarray, counts: np.ndarray, values: np.ndarray, bits: int):
    """Rows (bucket, block) of the numbers of each text, one for each range of the ascending keys, whatever the number of texts."""
    bucket = np.frombuffer(keys.tobytes(), ">u4")[::4].astype(np.int64) >> (32 - bits)
    ends = np.append(0, np.cumsum(counts))
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    out = [_pack(keys[a:z], counts[a:z].astype("<u4"), values[ends[a] : ends[z]].astype("<u4")) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return _batch({"bucket": (bucket[edges[:-1]].tolist(), "int"), "block": (out, "binary")})


def _by_text(blocks: DataFrame, name: str) -> DataFrame:
    """(key, ``name``): all numbers of each text, one row a text."""

    def run(batches: Iterator) -> Iterator:
        for held in _by_key(batches, "bucket", "block"):
            got = [_unpack(b, "V16", "<u4", "<u4") for b in held]
            keys, of = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
            own = np.repeat(of, np.concatenate([g[1] for g in got]))
            values = np.concatenate([g[2] for g in got])[np.argsort(own, kind="stable")]
            ends = np.append(0, np.cumsum(np.bincount(own, minlength=len(keys))))
            for lo in range(0, len(keys), 4096):
                some = range(lo, min(lo + 4096, len(keys)))
                yield _batch({"key": ([keys[i].tobytes() for i in some], "binary"), name: ([values[ends[i] : ends[i + 1]].tobytes() for i in some], "binary")})

    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, f"key binary, {name} binary")


def _anchor_blocks(texts: DataFrame, bits: int, length: int) -> DataFrame:
    """Blocks (range, block) of fingerprints, positions and text keys. A task takes each text once."""

    def run(batches: Iterator) -> Iterator:
        seen: set[bytes] = set()
        for rows in _gathered(batches, "key", "b"):
            hashes, places, owners, keys = [], [], [], []
            for key, b in rows:
                if key in seen:
                    continue
                if len(seen) < 1 << 18:
                    seen.add(key)
                at, h = anchors(b, length)
                if len(at):
                    hashes.append(_mixed(h ^ _U(0xD1342543DE82EF95)))  # least fingerprints lie close together
                    places.append(at.astype("<u4"))
                    owners.append(np.full(len(at), len(keys), "<u4"))
                    keys.append(key)
            if not keys:
                continue
            h, at, own = map(np.concatenate, (hashes, places, owners))
            part = (h >> _U(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)
            order = np.argsort(part, kind="stable")
            parts, start = np.unique(part[order], return_index=True)
            table, out = np.frombuffer(b"".join(keys), "V16"), []
            for i in np.split(order, start[1:]):
                used, local = np.unique(own[i], return_inverse=True)
                out.append(_pack((h[i] >> _U(32 - bits) & _U(0xFFFFFFFF)).astype("<u4"), at[i], local.astype("<u4"), table[used]))
            yield _batch({"part": (parts.tolist(), "int"), "block": (out, "binary")})

    return texts.select("key", "b").mapInArrow(run, "part int, block binary")


def _shared_anchors(blocks: DataFrame, bits: int) -> DataFrame:
    """(bucket, block): positions of anchors whose fingerprint occurs in more than one text, by text."""

    def run(batches: Iterator) -> Iterator:
        for held in _by_key(batches, "part", "block"):
            got = [_unpack(b, "<u4", "<u4", "<u4", "V16") for b in held]
            offset = np.cumsum([0, *(len(g[3]) for g in got)])[:-1]
            keys, of = np.unique(np.concatenate([g[3] for g in got]), return_inverse=True)
            h = np.concatenate([g[0] for g in got])
            at = np.concatenate([g[1] for g in got])
            own = of.astype(np.uint32)[np.concatenate([g[2] + np.uint32(o) for g, o in zip(got, offset, strict=True)])]
            del got
            order = np.argsort(h, kind="stable")
            h, own, at = h[order], own[order], at[order]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            mixed_up = np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start)
            keep = np.repeat(mixed_up, np.diff(np.append(start, len(h))))
            both = np.unique(own[keep].astype(np.uint64) << _U(32) | at[keep])
            if not len(both):
                continue
            own, at = both >> _U(32), (both & _U(0xFFFFFFFF)).astype("<u4")
            used, counts = np.unique(own.astype(np.int64), return_counts=True)
            yield _dealt(keys[used], counts, at, bits)

    return blocks.repartition("part").sortWithinPartitions("part").mapInArrow(run, "bucket int, block binary")


def _stretches(texts: DataFrame, bits: int, length: int) -> DataFrame:
    """Blocks (shard, block) of the stretches around shared anchors: bytes, lengths, positions, their anchors' places in them, text numbers, ids and keys."""
    around = length - ANCHOR

    def run(batches: Iterator) -> Iterator:
        for rows in _gathered(batches, "key", "first", "b", "places"):
            shard, low, high, own, offset = [], [], [], [], []
            for n, (_, _, b, places) in enumerate(rows):
                at = np.unique(np.frombuffer(places, "<u4")).astype(np.int64)
                h = _mixed(fingerprints(b, ANCHOR)[at] ^ _U(0x5851F42D4C957F2D))
                shard.append((h >> _U(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32))
                low.append(np.maximum(at - around, 0))
                offset.append((at - low[-1]).astype("u1"))
                high.append(np.minimum(at + length, len(b)))
                own.append(np.full(len(at), n, np.int64))
            shard, low, high, own, offset = map(np.concatenate, (shard, low, high, own, offset))
            order = np.lexsort((low, own, shard))
            parts, start = np.unique(shard[order], return_index=True)
            out = []
            for i in np.split(order, start[1:]):
                used, local = np.unique(own[i], return_inverse=True)
                data = b"".join([rows[n][2][a:z] for n, a, z in zip(own[i].tolist(), low[i].tolist(), high[i].tolist(), strict=True)])
                out.append(_pack(np.frombuffer(data, np.uint8), (high[i] - low[i]).astype("<u2"), low[i].astype("<u4"), offset[i], local.astype("<u4"), np.array([rows[n][1] for n in used], "<i8"), np.frombuffer(b"".join(rows[n][0] for n in used), "V16")))
            yield _batch({"shard": (parts.tolist(), "int"), "block": (out, "binary")})

    return texts.select("key", "first", "b", "places").mapInArrow(run, "shard int, block binary")


def _runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(covered, prepend=False, append=False))
    return edge[0::2], edge[1::2]


def earlier_windows(stretches: list[bytes], least: np.ndarray, length: int = LENGTH, store: Store | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct stretches with the least id that has each: (stretch, first, last) of all ``length`` bytes in them that also stand in one of a
    smaller id; their places in neighbourhood are one run, but for the ends of blocks.

    Their joined text and what is computed for each of its bytes are mapped files of the store.
    """
    store, none = store or Store(), np.iinfo(np.int64).max
    sizes = np.array([len(s) + 1 for s in stretches], np.int64)
    ends, step = np.cumsum(sizes), max(1, store.block // 64)
    some = [slice(a, a + step) for a in range(0, len(stretches), step)]
    text = store.listed((np.frombuffer(b"\xff".join([*stretches[x], b""]), np.uint8) for x in some), "u1")
    owner = store.listed((np.repeat(np.arange(x.start, x.start + len(sizes[x])), sizes[x]) for x in some), "<i4")
    order, common = suffix_order(text, length, store)

    # the least id of suffixes that share the length: of the part up to a block's end, then of the whole run
    best, carried = store.array(len(text), "<i8"), none
    for a, z in store.blocks(len(text)):
        at = np.array(order[a:z])
        own = owner[at]
        ids = np.where(at + length < ends[own], least[own], none)
        start = np.flatnonzero(common[a:z] < length)
        if not len(start) or start[0]:
            start = np.append(0, start)
            ids[0] = min(ids[0], carried)
        runs = np.minimum.reduceat(ids, start)
        best[a:z], carried = np.repeat(runs, np.diff(np.append(start, z - a))), runs[-1]
    out = store.array(len(text), "<i8")
    for a, z in store.blocks(len(text), down=True):
        ids, at = np.array(best[a:z]), np.array(order[a:z])
        if z < len(text) and common[z] >= length:
            start = np.flatnonzero(common[a:z] < length)
            ids[start[-1] if len(start) else 0 :] = carried
        carried = ids[0]
        out[at] = np.where(at + length < ends[owner[at]], ids, none)

    found = [(np.empty(0, np.int64),) * 3]
    for a, z in store.blocks(len(text)):
        low, high = _runs(out[a:z] < least[owner[a:z]])
        own = np.array(owner[a + low], np.int64)
        begin = a - (ends - sizes)[own]
        found.append((own, low + begin, high - 1 + begin))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _not_alone(stretches: list[bytes], of: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Numbers of the stretches around an anchor that other stretches are around, too; ``offset`` is where in stretch ``of`` an anchor stands."""
    by: dict[bytes, list[int]] = {}
    for pair in np.unique(of * 256 + offset).tolist():
        n, at = divmod(pair, 256)
        by.setdefault(stretches[n][at : at + ANCHOR], []).append(n)
    return np.unique(np.array([n for some in by.values() if len(some) > 1 for n in some], np.int64))


def _spans(blocks: DataFrame, bits: int, length: int) -> DataFrame:
    """(bucket, block): pairs of positions whose bytes are repeats, by text."""

    def run(batches: Iterator) -> Iterator:
        for held in _by_key(batches, "shard", "block"):
            number: dict[bytes, int] = {}
            of, at, ids, keys, base, owns, offsets = [], [], [], [], 0, [], []
            for block in held:
                data, sizes, low, offset, local, firsts, table = _unpack(block, "u1", "<u2", "<u4", "u1", "<u4", "<i8", "V16")
                data, ends = data.tobytes(), np.cumsum(sizes, dtype=np.int64)
                of.append(np.array([number.setdefault(data[z - n : z], len(number)) for z, n in zip(ends.tolist(), sizes.tolist(), strict=True)], np.int64))
                at.append(low.astype(np.int64))
                offsets.append(offset)
                ids.append(firsts[local])
                owns.append(local.astype(np.int64) + base)
                keys.append(table)
                base += len(table)
            of, at, ids, owns, keys, offsets = map(np.concatenate, (of, at, ids, owns, keys, offsets))
            least = np.full(len(number), np.iinfo(np.int64).max)
            np.minimum.at(least, of, ids)
            stretches = list(number)
            several = _not_alone(stretches, of, offsets)
            low, high, own = [], [], []
            later = ids > least[of]  # all of such a stretch starts in a smaller id
            sizes = np.array([len(s) for s in stretches])
            low.append(at[later])
            high.append(at[later] + sizes[of[later]])
            own.append(owns[later])
            # of the first to have a stretch, the windows that another stretch has earlier
            stretch, first, last = earlier_windows([stretches[n] for n in several.tolist()], least[several], length)
            stretch = several[stretch]
            firsts = np.flatnonzero(~later)
            firsts = firsts[np.argsort(of[firsts], kind="stable")]
            lo, hi = np.searchsorted(of[firsts], stretch, side="left"), np.searchsorted(of[firsts], stretch, side="right")
            times = hi - lo
            which = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())
            start = at[firsts[which]]
            low.append(start + np.repeat(first, times))
            high.append(start + np.repeat(last, times) + length)
            own.append(owns[firsts[which]])
            low, high, own = map(np.concatenate, (low, high, own))
            # by text, whatever its block
            names, of_text = np.unique(keys, return_inverse=True)
            own = of_text[own]
            order = np.lexsort((high, low, own))
            low, high, own = low[order], high[order], own[order]
            if not len(own):
                continue
            used, first = np.unique(own, return_index=True)
            merged = [_merged(low[a:z], high[a:z]) for a, z in zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=True)]
            pairs = np.concatenate([np.stack(m, axis=1).ravel() for m in merged])
            yield _dealt(names[used], np.array([2 * len(x) for x, _ in merged]), pairs, bits)

    return blocks.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "bucket int, block binary")


def _merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans that are sorted by their beginning; spans that touch join."""
    reach = np.maximum.accumulate(high)
    new = np.concatenate([[True], low[1:] > reach[:-1]])
    start = np.flatnonzero(new)
    return low[start], reach[np.append(start[1:] - 1, len(low) - 1)]


def _bits(total: int, each: int) -> int:
    return max(0, (-(-total // each) - 1).bit_length()) if total else 0


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256 of every row."""
    text = text_of(docs).cast("binary")
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text.alias("b"))
    rows = rows.withColumn("key", F.unhex(F.substring(F.sha2("b", 256), 1, 32)))
    texts = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("b") >= length))
    firsts = materialise(texts.groupBy("key").agg(F.min("doc_id").alias("first"), F.first(F.octet_length("b")).alias("n")), "repeat-texts")
    total = firsts.agg(F.sum("n")).first()[0] or 0

    ranges, shards = _bits(total, RANGE_BYTES), _bits(total, SHARD_BYTES)
    shared = materialise(_shared_anchors(_anchor_blocks(texts, ranges, length), ranges), "repeat-anchors")
    places = _by_text(shared, "places").join(firsts.select("key", "first"), "key")
    ours = texts.join(places.hint("shuffle_hash"), "key").where("doc_id = first").select("key", "first", "b", "places")
    spans = materialise(_spans(_stretches(ours, shards, length), ranges, length), "repeat-spans")

    found = firsts.select("key", "first").join(_by_text(spans, "spans"), "key", "left")
    joined = rows.join(found.hint("shuffle_hash"), "key", "left").select("doc_id", "b", (F.col("doc_id") > F.col("first")).alias("copy"), F.when(F.col("doc_id") == F.col("first"), F.col("spans")).alias("spans"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = {"doc_id": batch.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept": [], "kept_sha256": []}
            for b, copy, spans in zip(*(batch.column(c) for c in ("b", "copy", "spans")), strict=True):
                b, spans = b.as_py(), spans.as_py()
                low = high = np.empty(0, np.int64)
                if copy.as_py():
                    low, high = np.array([0]), np.array([len(b)])
                elif spans:
                    pairs = np.frombuffer(spans, "<u4").reshape(-1, 2).astype(np.int64)
                    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                    low, high = _merged(pairs[:, 0], pairs[:, 1])
                left = b"".join(b[a:z] for a, z in zip([0, *high.tolist()], [*low.tolist(), len(b)], strict=True))
                for c, v in (("n_bytes", len(b)), ("n_removed", len(b) - len(left)), ("n_spans", len(low)), ("kept", left), ("kept_sha256", hashlib.sha256(left).hexdigest())):
                    out[c].append(v)
            kinds = [None, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([v if k is None else pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats of 50 bytes leave of every document, by digest."""
    return suffix_dedup(documents(spark, sf_dir)).drop("kept")
