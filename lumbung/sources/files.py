"""Reading folders of differently shaped CSV files into one long table of cells, and the small tables beside them.

A folder becomes cells(file, row_order, position, column, value): one plan for any number of files and headers. Files
are read whole by the task that has them (they are exports of one product each), so that quoted line ends and repeated
headers are read as they stand and a row's number is dense and stable.
"""

from __future__ import annotations

import codecs
import csv
import io
import itertools
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.functions.batches import small_batches
from lumbung.functions.columns import squeezed, trimmed
from lumbung.functions.text import fragment_key

#: Tried in order; the next one only if bytes do not decode.
ENCODINGS = ("utf-8", "utf-8-sig", "cp1252", "latin1")
MAPPING_COLUMNS = ("file", "nama_toko", "nama_produk", "product_key", "status", "sumber_nama", "catatan", "ukuran_byte")
TRUE_WORDS = ("ya", "y", "1", "true", "x", "setuju")


def decoded(data: bytes) -> tuple[str, str]:
    """Text and encoding (SC1); a byte-order mark goes."""
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding).removeprefix("﻿"), encoding
        except UnicodeDecodeError:
            continue
    raise ValueError("no encoding fits")


def unique_headers(names: list[str]) -> list[str]:
    """Repeated headers get .1, .2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def read_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """file, length, modified, sha256 and content of each file (SC13). A file in a folder ``file=name`` has that name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = files["file"].cast("string") if "file" in files.columns else F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B"))
    return files.select(name.alias("file"), "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), "content")


#: Bytes of a file that a Python worker is given at a time.
PIECE = 1 << 20
#: Cells and characters that it gives back at a time, a row more at most.
CELLS, CHARACTERS = 20_000, 2 << 20
#: Bytes that cp1252 has no character for.
NOT_CP1252 = ("81", "8D", "8F", "90", "9D")


def lines(pieces: Iterable[bytes], encoding: str) -> Iterator[str]:
    """A file's lines with their ends, from its bytes cut anywhere; a byte-order mark goes."""
    decoder, held, begun = codecs.getincrementaldecoder(encoding)(), [], False
    for piece, last in itertools.chain(((p, False) for p in pieces), [(b"", True)]):
        text = decoder.decode(piece, last)
        if text and not begun:
            text, begun = text.removeprefix("\ufeff"), True
        if not last and "\n" not in text and "\r" not in text:
            held.append(text)
            continue
        found = list(io.StringIO("".join([*held, text]), newline=""))
        # the last line may go on in the next piece, as may a line end of two characters
        held = [found.pop()] if not last and found and not found[-1].endswith("\n") else []
        yield from found


def read_cells(files: DataFrame) -> DataFrame:
    """All cells of some files, empty ones as the empty string (SC1 to SC3, SC14).

    The JVM finds a file's encoding and cuts it, so that a Python worker never holds more of it than some pieces and a row.
    """
    small_batches(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit((1 << 31) - 1)

        def pieces() -> Iterator[tuple[int, str, str, bytes]]:
            number = -1
            for batch in batches:
                for name, encoding, at, piece in zip(batch["file"], batch["encoding"], batch["at"], batch["piece"], strict=True):
                    number += at == 0
                    yield number, name, encoding, bytes(piece)

        table = lambda cells: pd.DataFrame(cells, columns=["file", "row_order", "position", "column", "value", "encoding"])
        some, size = [], 0
        for (_, name, encoding), own in itertools.groupby(pieces(), key=lambda p: p[:3]):
            rows = csv.reader(lines((p[3] for p in own), encoding))
            header = unique_headers(next(rows, []))
            for n, row in enumerate(r for r in rows if r):
                row = row + [""] * (len(header) - len(row))
                some += [(name, n, k, c, v, encoding) for k, (c, v) in enumerate(zip(header, row, strict=False))]
                size += sum(map(len, row))
                if len(some) > CELLS or size > CHARACTERS:
                    yield table(some)
                    some, size = [], 0
        yield table(some)

    odd = " OR ".join(f"contains(content, X'{b}')" for b in NOT_CP1252)
    encoding = F.expr(f"CASE WHEN is_valid_utf8(CAST(content AS STRING)) THEN 'utf-8' WHEN {odd} THEN 'latin1' ELSE 'cp1252' END")
    # the encoding is found before and the pieces are made within the generator, so that a file's bytes do not go along with each piece
    pieces_of = F.expr(f"transform(sequence(0L, greatest(length(content) - 1, 0) DIV {PIECE}), k -> substring(content, CAST(k * {PIECE} + 1 AS INT), {PIECE}))")
    each = files.select("file", encoding.alias("encoding"), "content").select("file", "encoding", F.posexplode(pieces_of).alias("at", "piece"))
    return each.mapInPandas(run, "file string, row_order long, position int, column string, value string, encoding string")


def read_table(spark: SparkSession, path: str, required: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """A CSV table of strings, empty cells as the empty string; ``strict`` asks for exactly the required header (SC8, SC9)."""
    table = spark.read.csv(path, header=True, multiLine=True, escape='"', mode="FAILFAST").na.fill("")
    table = table.toDF(*[c.removeprefix("﻿") for c in table.columns])
    if strict and tuple(table.columns) != tuple(required):
        raise ValueError(f"the header must be {', '.join(required)}")
    if missing := [c for c in required if c not in table.columns]:
        raise ValueError(f"missing columns: {missing}")
    return table


def file_map(spark: SparkSession, path: str, expected_rows: int | None = None, expected_ok: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Files to use and files left out of a mapping table, checked (SC4)."""
    table = read_table(spark, path, MAPPING_COLUMNS)
    own = path.rsplit("/", 1)[-1]
    ok = (F.col("status") == "ok") & (F.col("file") != own)
    counts = table.agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.count_if(ok & (trimmed(F.col("product_key")) == "")).alias("blank")).first()
    twice = table.groupBy("file").count().where("count > 1").limit(5).collect()
    for what, wrong in (
        (f"{counts['n']} rows, expected {expected_rows}", expected_rows is not None and counts["n"] != expected_rows),
        (f"{counts['ok']} usable files, expected {expected_ok}", expected_ok is not None and counts["ok"] != expected_ok),
        ("usable files without a product key", counts["blank"] > 0),
        (f"files listed twice: {[r['file'] for r in twice]}", bool(twice)),
    ):
        if wrong:
            raise ValueError(what)
    return table.where(ok), table.where(~ok)


def slang_dictionary(spark: SparkSession, path: str) -> dict[str, str]:
    """slang -> standard, keys case folded; contradictions are errors (SC10). A reviewed table, small by nature."""
    rows = read_table(spark, path, ("slang", "baku"), strict=True).select(squeezed(F.col("slang")), squeezed(F.col("baku"))).collect()
    out: dict[str, str] = {}
    for slang, standard in rows:
        key = slang.casefold()
        if not key or not standard:
            raise ValueError("a slang word or its standard is empty")
        if out.setdefault(key, standard) != standard:
            raise ValueError(f"two standards for {key!r}")
    if not out:
        raise ValueError("the dictionary is empty")
    return out


def scrape_dates(spark: SparkSession, path: str) -> DataFrame:
    """(file, day): explicit scrape dates, ISO only, one a file (SC11)."""
    table = read_table(spark, path, ("file", "tanggal_scrape")).select(trimmed(F.col("file")).alias("file"), trimmed(F.col("tanggal_scrape")).alias("raw"))
    day = F.when(F.col("raw").rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?$"), F.expr("try_cast(raw AS timestamp_ntz)"))
    table = table.withColumn("day", day)
    wrong = table.agg(F.count_if((F.col("file") == "") | F.col("day").isNull()).alias("bad"), (F.count("*") - F.count_distinct("file")).alias("twice")).first()
    if wrong["bad"] or wrong["twice"]:
        raise ValueError("scrape dates must be ISO days, one for each file")
    return table.select("file", "day")


def aspect_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(key) of approved aspect words: lines of a .txt, or a .csv of ``fragmen`` and ``setuju`` (SC12)."""
    if path.endswith(".txt"):
        words = spark.read.text(path).select(F.col("value").alias("fragmen"))
    else:
        words = read_table(spark, path, ("fragmen",))
        if "setuju" in words.columns:
            words = words.where(F.lower(trimmed(F.col("setuju"))).isin(*TRUE_WORDS))
    return words.select(fragment_key("fragmen").alias("key")).where("key <> ''").distinct()


def timestamp_anchors(cells: DataFrame, files: DataFrame, overrides: DataFrame | None, timezone: str) -> DataFrame:
    """One row a file: the day that relative dates count from, and why.

    An explicit day wins; else the file's time, unless dates within the file are later than it.
    """
    from lumbung.functions.columns import timestamp_fields

    stamp = timestamp_fields(F.col("value"), F.lit(None).cast("timestamp_ntz"))
    latest = cells.where(F.col("value").rlike(r"^\s*\d{4}-\d{2}-\d{2}")).select("file", stamp.alias("t")).where("t.status = 'ok'").groupBy("file").agg(F.max("t.timestamp").alias("latest_absolute"))
    local = F.from_utc_timestamp(F.col("modified"), timezone).cast("timestamp_ntz")
    out = files.select("file", local.alias("mtime_local")).join(latest, "file", "left")
    out = out.join(overrides, "file", "left") if overrides is not None else out.withColumn("day", F.lit(None).cast("timestamp_ntz"))
    anomaly = F.coalesce(F.col("mtime_local") < F.col("latest_absolute"), F.lit(False))
    source = F.when(F.col("day").isNotNull(), "scrape_dates.csv").when(F.col("mtime_local").isNotNull() & ~anomaly, "mtime").otherwise("tidak_ada")
    anchor: Column = F.when(source == "scrape_dates.csv", F.col("day")).when(source == "mtime", F.col("mtime_local"))
    return out.select("file", "mtime_local", "latest_absolute", anomaly.alias("mtime_anomaly"), F.date_trunc("day", anchor).cast("timestamp_ntz").alias("timestamp_anchor"), source.alias("timestamp_anchor_source"))


def clean_reviews(spark: SparkSession, path: str, included_only: bool = True, columns: list[str] | None = None) -> DataFrame:
    """The clean table in reading order, with its key columns always there (SC5, SC7)."""
    table = spark.read.parquet(path)
    if included_only:
        table = table.where("include_for_inference")
    if columns is not None:
        table = table.select(*dict.fromkeys(["review_id", "product_id", "seq_in_product", "timestamp", *columns]))
    return table.orderBy("product_id", "seq_in_product")


def split_ids(spark: SparkSession, path: str) -> DataFrame:
    """(product_id, split) of a split file, no other column read (SC6)."""
    table = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
    return table.select("product_id", "split").distinct()
