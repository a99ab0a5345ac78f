"""Token ids in files of length-delimited binary records, with a separate offset index.

A record is one document: a little-endian 64-bit length of the payload, the masked CRC-32C of those eight bytes,
the payload and the masked CRC-32C of the payload. A payload is a byte with the width of an id, 2 or 4 (2 where every id of
the vocabulary fits), and the ids as little-endian unsigned integers of that width. Shards hold the
documents in ascending id order. The index, a Parquet table beside the shards, has each record's shard, offset,
length and token count; it names only files of tasks that succeeded, so a lost executor's half-written file is never
read: a task that runs again writes a file of another name.

Null ids come first, rows of one id in the order of a hash of their texts. Null and empty texts have the end id only.
An empty table has no shards. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import array
import codecs
import itertools
import json
import os
import re
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumbung.llm.common import BYTE_SIGNS, PLAIN_PIECES, PLAIN_WORD, by_stretch, known_words, shared_folder, text_of, tidy

#: Bytes and records after which a task begins another shard.
SHARD_BYTES, SHARD_RECORDS = 64 << 20, 1 << 16
#: Words and pieces that a worker remembers; a full table keeps those that return.
REMEMBER = 1 << 19
#: Pieces that the library's model takes before their ids are copied: few enough that its tokens stay in the processor's cache.
CHUNK = 512
#: Lines of ``PLAIN_WORD`` or nothing, each with its end: a whole block is looked over at once.
PLAIN_LINES = re.compile(rb"(?:%s|\n)*+" % PLAIN_WORD.pattern.replace(b")+", b")++"))
#: The sign of each byte in byte-level vocabularies; a line end stays one.
SIGN_OF = "".join("\n" if b == 10 else chr(BYTE_SIGNS.get(b, b)) for b in range(256))
#: Fixed value of the record format: what is added to a rotated checksum.
MASK = 0xA282EAD8


def _tables() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Tables of CRC-32C (reflected polynomial 0x82F63B78): of a byte; of each 16 bits of eight bytes; and, for each k,
    two that move both halves of a state over 2^k zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0x82F63B78), byte >> 1)
    over_byte = lambda x: (x >> 8) ^ byte[x & 255]
    halves = np.stack([np.arange(1 << 16, dtype=np.uint32), np.arange(1 << 16, dtype=np.uint32) << np.uint32(16)])
    steps = [over_byte(halves)]
    for _ in range(36):
        last = steps[-1]
        steps.append(np.stack([last[0][h & 0xFFFF] ^ last[1][h >> 16] for h in last]))
    # a word's j-th 16 bits: they enter the state and pass the bytes from there to the word's end
    word = []
    for j in range(4):
        x = halves[0]
        for _ in range(8 - 2 * j):
            x = over_byte(x)
        word.append(x)
    return byte, np.stack(word), steps


_BYTE, _WORD, _STEPS = _tables()
_T0 = _BYTE.tolist()


def crc32c(data: bytes) -> int:
    """CRC-32C of a few bytes."""
    c = 0xFFFFFFFF
    for b in data:
        c = _T0[(c ^ b) & 255] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def crc32c_many(items: list[bytes], block_bytes: int = 16 << 20) -> list[int]:
    """CRC-32C of many values at once, in numpy.

    Zero bytes before a value leave an empty state as it is, so values stand at the end of rows of 2^k words. The
    states of all words are then moved and joined pairwise, in k rounds.
    """
    out, groups = [0] * len(items), {}
    for i, x in enumerate(items):
        if len(x) < 4:
            out[i] = crc32c(x)
        else:
            groups.setdefault(((len(x) + 7) // 8 - 1).bit_length(), []).append(i)
    for k, members in groups.items():
        width = 8 << k
        step = max(1, block_bytes // width)
        for at in range(0, len(members), step):
            some = members[at : at + step]
            rows = np.zeros((len(some), width), np.uint8)
            for r, i in enumerate(some):
                n = len(items[i])
                rows[r, width - n :] = np.frombuffer(items[i], np.uint8)
                rows[r, width - n : width - n + 4] ^= np.uint8(255)  # the initial state
            words = rows.view("<u2").reshape(len(some), 1 << k, 4)
            state = _WORD[0][words[:, :, 0]]
            for j in range(1, 4):
                state ^= _WORD[j][words[:, :, j]]
            for level in range(k):
                move, x = _STEPS[level + 3], state[:, 0::2]
                state = move[0][x & 0xFFFF] ^ move[1][x >> 16] ^ state[:, 1::2]
            for i, c in zip(some, (state[:, 0] ^ np.uint32(0xFFFFFFFF)).tolist(), strict=True):
                out[i] = c
    return out


def masked(c: int) -> int:
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frames(payloads: list[bytes]) -> list[bytes]:
    """The records of some payloads."""
    out = []
    for payload, c in zip(payloads, crc32c_many(payloads), strict=True):
        head = struct.pack("<Q", len(payload))
        out.append(b"".join((head, struct.pack("<I", masked(crc32c(head))), payload, struct.pack("<I", masked(c)))))
    return out


def unframe(records: list[bytes]) -> list[bytes]:
    """The payloads of some records; raises ValueError if a length or a checksum is wrong."""
    payloads = []
    for record in records:
        if len(record) < 16:
            raise ValueError("a record is cut short")
        (n,), head = struct.unpack("<Q", record[:8]), struct.unpack("<I", record[8:12])[0]
        if head != masked(crc32c(record[:8])) or len(record) != n + 16:
            raise ValueError("a record's length is damaged")
        payloads.append(record[12:-4])
    for record, c in zip(records, crc32c_many(payloads), strict=True):
        if struct.unpack("<I", record[-4:])[0] != masked(c):
            raise ValueError("a record's payload is damaged")
    return payloads


def _files(uri: str):
    """The file system of a path and the path in it, for Python workers."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


class LibraryWords:
    """Ids through the tokenizers library, a word at a time where the vocabulary file allows it.

    In a file whose chain is the one of ``common``, every piece and special token of the vocabulary file lies within a stretch without ASCII white space, and so
    the ids of a text are those of its stretches, in order; each worker encodes a stretch once while it remembers it.
    Stretches of plain Latin letters and signs are cut into the pieces of the file's own pattern first, and the library's model
    encodes each piece once, without the library's other steps; the whole chain takes the others. With any other file it takes whole texts.
    """

    PIECES, PLAIN = PLAIN_PIECES, PLAIN_WORD

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = bool(spec["model"].get("end_of_word_suffix")) and known_words(spec)
        ids = [*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), end_id]
        self.width = 2 if max(ids) < 1 << 16 else 4
        if not self.by_word:
            return
        self.model = self.library.model
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        out = array.array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _ids(self, texts: list[str], to: dict) -> None:
        for at in range(0, len(texts), 4096):
            some = texts[at : at + 4096]
            for x, e in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                to[x] = self._bytes(e.ids)

    def _pieces(self, texts: list[str]) -> None:
        """Encodes pieces by the library's model alone, which takes each as it stands."""
        for at in range(0, len(texts), CHUNK):
            some = texts[at : at + CHUNK]
            got = list(map(self.model.tokenize, codecs.charmap_decode("\n".join(some).encode("utf-8"), "strict", SIGN_OF)[0].split("\n")))
            cuts = [0, *(np.cumsum(list(map(len, got))) * self.width).tolist()]
            data = self._bytes([t.id for ts in got for t in ts])
            self.pieces.update(zip(some, [data[a:z] for a, z in itertools.pairwise(cuts)], strict=True))

    def _learn(self, new: list[bytes]) -> None:
        lines, plain = b"\n".join([*new, b""]), new
        if not PLAIN_LINES.fullmatch(lines):
            plain = list(filter(self.PLAIN.fullmatch, new))
            lines = b"\n".join([*plain, b""])
            got: dict[str, bytes] = {}
            self._ids([w.decode("utf-8") for w in set(new).difference(plain)], got)
            self.known.update((w.encode("utf-8"), ids) for w, ids in got.items())
        cut = self.PIECES.findall(lines.decode("utf-8").lower())
        some = set(cut)
        some.discard("\n")
        unseen = some.difference(self.pieces)
        if len(self.pieces) + len(unseen) > REMEMBER:
            self.pieces = {x: self.pieces[x] for x in some - unseen}
        self._pieces(list(unseen))
        self.pieces["\n"] = b""  # a stretch's end: every piece has an id
        parts = list(map(self.pieces.__getitem__, cut))
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        ends, data = [0, *np.cumsum(size)[size == 0].tolist()], b"".join(parts)
        self.known.update(zip(plain, [data[a:z] for a, z in itertools.pairwise(ends)], strict=True))

    def _known(self, words: list[bytes]) -> list[bytes]:
        got = list(map(self.known.get, words))
        new = [n for n, ids in enumerate(got) if ids is None]
        if len(self.known) + len(new) > REMEMBER:
            self.known = {w: ids for w, ids in zip(words, got, strict=True) if ids is not None}
        if new:
            some = [words[n] for n in new]
            self._learn(some)
            for n, ids in zip(new, map(self.known.__getitem__, some), strict=True):
                got[n] = ids
        return got

    def encode(self, texts, block: int = 16 << 20) -> Iterator[bytes]:
        """The ids of each text of an Arrow array of strings or a list of bytes, ``width`` bytes each; looks at about ``block`` bytes at a time."""
        if self.by_word:
            yield from by_stretch(texts, block, self._known)
            return
        texts, at = [t if isinstance(t, bytes) else t.as_py().encode("utf-8") for t in texts], 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size < block):
                size, upto = size + len(texts[upto]), upto + 1
            for e in self.library.encode_batch_fast([t.decode("utf-8") for t in texts[at:upto]], add_special_tokens=False):
                yield self._bytes(e.ids)
            at = upto


_WORDS: dict[tuple[str, int], LibraryWords] = {}


def write_records(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, shard_bytes: int = SHARD_BYTES, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """Encodes every text and writes shards under ``folder``/shards and the index under ``folder``/index; returns the index.

    Text goes through one shuffle, into ranges of the id, and is encoded after it: ranges come from a sample of
    ids, and encoding before would run twice. Index columns: task, shard (number within the task), file, doc_id,
    offset, length, n_tokens, task_start (ids before it in its task).
    """
    import pyarrow as pa

    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select(docs["doc_id"], text_of(docs).alias("__text"))
    source = source.withColumn("__tie", F.xxhash64("__text")).repartitionByRange("doc_id", "__tie").sortWithinPartitions("doc_id", "__tie").drop("__tie")
    shards = f"{folder}/shards"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        if (tokenizer, end_id) not in _WORDS:
            _WORDS[tokenizer, end_id] = LibraryWords(tokenizer, end_id)
        words = _WORDS[tokenizer, end_id]
        begin, end = bytes([words.width]), end_id.to_bytes(words.width, "little")
        store, root = _files(shards)
        store.create_dir(root, recursive=True)
        attempt = uuid.uuid4().hex
        out = name = None
        shard, offset, seen, held = -1, 0, 0, 0
        try:
            for batch in batches:
                rows = []
                for record in frames([begin + ids + end for ids in words.encode(batch.column("__text"))]):
                    if out is None or held == shard_records or offset and offset + len(record) > shard_bytes:
                        if out is not None:
                            out.close()
                        shard, offset, held = shard + 1, 0, 0
                        name = f"{task:06d}-{shard:04d}-{attempt}.rec"
                        out = store.open_output_stream(f"{root}/{name}")
                    out.write(record)
                    n = (len(record) - 17) // words.width
                    rows.append((shard, name, offset, len(record), n, seen))
                    offset, seen, held = offset + len(record), seen + n, held + 1
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task] * len(rows), pa.int32()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[2:])],
                    ["task", "shard", "file", "doc_id", "offset", "length", "n_tokens", "task_start"],
                )
        finally:
            if out is not None:
                out.close()

    schema = f"task int, shard int, file string, doc_id {id_type}, offset bigint, length bigint, n_tokens bigint, task_start bigint"
    source.mapInArrow(tidy(run), schema).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def read_records(spark: SparkSession, folder: str, shuffle_seed: int | None = None) -> DataFrame:
    """The records of a folder, read from its shards: task, shard, offset, task_start, doc_id, n_tokens, ids, ids_crc32.

    One row of index entries a shard tells a task what to read; a shard is bounded in bytes and in records, so the row is. With
    ``shuffle_seed`` each shard's records come in a random order, read by their offsets, and shards are dealt out
    at random; without it a shard is read from its beginning to its end.
    """
    import pyarrow as pa

    index = spark.read.parquet(f"{folder}/index")
    id_type = index.schema["doc_id"].dataType.simpleString()
    entry = F.struct("offset", "length", "doc_id", "n_tokens", "task_start")
    plan = index.groupBy("task", "shard", "file").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    if shuffle_seed is not None:
        plan = plan.withColumn("__deal", F.xxhash64("file", F.lit(shuffle_seed))).repartition("__deal").sortWithinPartitions("__deal").drop("__deal")
    shards = f"{folder}/shards"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _files(shards)
        for batch in batches:
            for row, listed in zip(batch.drop_columns(["entries"]).to_pylist(), batch.column("entries"), strict=True):
                entries = listed.values
                if shuffle_seed is not None:
                    order = np.random.default_rng([shuffle_seed, zlib.crc32(row["file"].encode())]).permutation(len(entries))
                    entries = entries.take(pa.array(order))
                with store.open_input_file(f"{root}/{row['file']}") as f:
                    for at in range(0, len(entries), 4096):
                        some, records = entries.slice(at, 4096), []
                        for offset, length in zip(some.field("offset").to_numpy().tolist(), some.field("length").to_numpy().tolist(), strict=True):
                            f.seek(offset)
                            records.append(f.read(length))
                        ids, n = [np.frombuffer(x, f"<u{x[0]}", offset=1).astype("<u4").tobytes() for x in unframe(records)], len(some)
                        sizes = np.fromiter(map(len, ids), np.int64, n)
                        if (sizes != 4 * some.field("n_tokens").to_numpy()).any():
                            raise ValueError("the index and a record differ in length")
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([row["task"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), some.field("offset"), some.field("task_start"), some.field("doc_id"),
                                pa.array(sizes // 4), pa.array(ids, pa.binary()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                            ],
                            ["task", "shard", "offset", "task_start", "doc_id", "n_tokens", "ids", "ids_crc32"],
                        )

    return plan.mapInArrow(tidy(run), f"task int, shard int, offset bigint, task_start bigint, doc_id {id_type}, n_tokens bigint, ids binary, ids_crc32 bigint")


def starts(index: DataFrame) -> DataFrame:
    """task and base: the ids in all tasks before it. One row a task, so the single-partition window stays small."""
    totals = index.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("base"))


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the records of ``documents`` and reads them back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    from lumbung.llm.common import documents

    folder = shared_folder(spark, "op1")
    index = write_records(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), folder)
    read = read_records(spark, folder).drop("ids")
    return read.join(starts(index), "task").select("doc_id", (F.col("base") + F.col("task_start")).alias("start"), "n_tokens", "ids_crc32")
