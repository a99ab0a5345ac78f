"""What the operators of this subpackage share: the shared folder, materialising, word and fold rules."""

from __future__ import annotations

import ctypes
import functools
import gc
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.functions.batches import ARROW_BYTES, small_batches  # noqa: F401 (the operators take them from here)

#: The white space of every word and normalisation rule here: space and \t \n \v \f \r.
SPACE = "[\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``).

    Only a session on this machine alone may go without the setting; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lumbung-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its lineage ends there, for any executor."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``materialise`` made and that nothing still to be computed reads."""
    for df in tables:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.__dict__.pop("_stored_at"))
        place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its rows in the shared folder and its lineage ended there; partitions and the order in them stay."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "rows"))
    return df.checkpoint()


def give_back() -> None:
    """Returns what this process has freed to the system: Arrow's pool and, where the C library can, its heap."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


#: What this process keeps for later tasks of the same kind: tables that take long to make.
_KEPT: dict[tuple[str, str], object] = {}


def kept(kind: str, name: str, make: Callable[[str], object]) -> object:
    """What ``make(name)`` returned when it was first asked for; the process keeps it until a task of another kind begins."""
    if (kind, name) not in _KEPT:
        _KEPT[kind, name] = make(name)
        give_back()  # what making it took
    return _KEPT[kind, name]


def keep_only(kind: str) -> None:
    """Frees what tasks of other kinds have kept."""
    if others := [k for k in _KEPT if k[0] != kind]:
        for k in others:
            del _KEPT[k]
        gc.collect()  # tables refer to each other
        give_back()


def tidy(run: Callable[[Iterator], Iterator], kind: str = "") -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, giving memory back at its start (what tasks of another kind have kept) and its end: workers
    wait beside those of later stages, with all that they hold."""

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        keep_only(kind)
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text, a null as the empty string."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))

#: The columns of ``documents`` that stages use; others travel in one struct, so that no name of theirs can clash.
CORE = ("doc_id", "text", "lang", "source")


def packed(docs: DataFrame) -> DataFrame:
    """The core columns (null where missing) and all others as the struct ``__rest``."""
    rest = [docs[c] for c in docs.columns if c not in CORE]
    core = [docs[c] if c in docs.columns else F.lit(None).cast("string").alias(c) for c in CORE]
    return docs.select(*core, F.struct(F.lit(True).alias("__here"), *rest).alias("__rest"))


def unpacked(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` from rows that hold what ``packed`` made."""
    return rows.select(*[F.col(c) if c in CORE else F.col("__rest").getField(c).alias(c) for c in like.columns])


#: Bits of a table of hashes; it has at most this / 32768 rows of 4 KB each, whatever it is made of, and so can be sent to all executors.
HASH_BITS = 1 << 26


def hash_bits(keys: DataFrame, key: Column, purpose: str, size: int = HASH_BITS) -> DataFrame:
    """Which hashes modulo ``size`` occur among some keys: 8 MB at most by default."""
    place = F.pmod(key, F.lit(size)) + 1
    table = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    return F.broadcast(materialise(table, purpose))


def with_maybe(rows: DataFrame, key: Column, bits: DataFrame, name: str, size: int = HASH_BITS) -> DataFrame:
    """``rows`` with a boolean: false if the key is surely not among those of ``bits``, else true."""
    place = F.pmod(key, F.lit(size)) + 1
    out = rows.withColumn("__place", place)
    out = out.join(bits, F.bitmap_bucket_number("__place") == bits["__bucket"], "left")
    at = F.bitmap_bit_position("__place")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, CAST(bitmap_bit_position(__place) % 8 AS INT))")) != 0
    return out.withColumn(name, F.coalesce(bit, F.lit(False))).drop("__place", "__bucket", "__bits")


#: The normal form and the pieces of the vocabulary file whose words ``records`` and ``bpe`` cut by themselves.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_PIECES = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


#: That pattern over lower-cased text of ``PLAIN_WORD``; a line end stands between stretches.
PLAIN_PIECES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-z0-9ß-öø-ÿ]+")
#: Printable ASCII and the letters from À to ÿ, which no normal form changes; of them no special token with ``<|`` is made.
PLAIN_WORD = re.compile(rb"(?:[!-;=-~]|<(?!\|)|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: How byte-level vocabularies write bytes that have no sign of their own.
BYTE_SIGNS = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}


def known_words(spec: dict) -> bool:
    """Whether a tokenizer file cuts texts in the way above, so that no piece of a text crosses ASCII white space."""
    return spec.get("normalizer") == WORD_NORMALIZER and spec.get("pre_tokenizer") == WORD_PIECES


def by_stretch(texts, block: int, ids_of: Callable[[list[bytes]], list[bytes]]) -> Iterator[bytes]:
    """The ids of each text of an Arrow array of strings (or of a list of bytes), from those of its stretches without ASCII white space.

    Looks at about ``block`` bytes of texts at a time; ``ids_of`` is asked once for each stretch that a block has (one
    may be empty), and Arrow puts their ids in the order of the texts.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if not isinstance(texts, pa.Array):
        texts = pa.array(list(texts), pa.binary()).cast(pa.string())
    at, ends = 0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    while at < len(texts):
        upto = min(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block)) + 1, len(texts))
        split = pc.ascii_split_whitespace(texts.slice(at, upto - at))
        words = split.flatten().dictionary_encode()
        ids = ids_of(words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
        all_ids = pa.array(ids, pa.large_binary()).take(words.indices)
        at_word, data = np.frombuffer(all_ids.buffers()[1], np.int64), all_ids.buffers()[2]
        for a, z in itertools.pairwise(at_word[split.offsets.to_numpy()].tolist()):
            yield data[a:z].to_pybytes() if z > a else b""
        at = upto
