"""Files that share reviews, and which to leave out (J9, J10, U4, U7 and the greedy decision)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.functions.columns import is_copy_name, name_key


def overlap_pairs(keys: DataFrame, hashes: DataFrame | None = None, min_percent: float = 30.0) -> DataFrame:
    """File pairs with the multiset intersection of their review keys, as a share of each (J9); equal contents are 100 %.

    keys: file, key. Counts are aggregated before the self-join, which meets on the key alone: a key of m files makes
    m (m - 1) / 2 rows, and m is bounded by the files that share one review.
    """
    counts = keys.groupBy("file", "key").agg(F.count("*").alias("n"))
    size = counts.groupBy("file").agg(F.sum("n").alias("size"))
    a, b = (counts.select(F.col("file").alias(f"file_{s}"), "key", F.col("n").alias(f"n_{s}")) for s in "ab")
    pairs = a.join(b, "key").where("file_a < file_b").groupBy("file_a", "file_b").agg(F.sum(F.least("n_a", "n_b")).alias("shared"))
    pairs = pairs.withColumn("identical", F.lit(False))
    if hashes is not None:
        x, y = (hashes.select(F.col("file").alias(f"file_{s}"), "sha256") for s in "ab")
        same = x.join(y, "sha256").where("file_a < file_b").select("file_a", "file_b", F.lit(True).alias("same"))
        pairs = pairs.drop("identical").join(same, ["file_a", "file_b"], "full").select("file_a", "file_b", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("same", F.lit(False)).alias("identical"))
    for s in "ab":
        pairs = pairs.join(size.select(F.col("file").alias(f"file_{s}"), F.col("size").alias(f"size_{s}")), f"file_{s}", "left")
        pairs = pairs.withColumn(f"pct_{s}", F.when(F.col("identical"), 100.0).otherwise(F.coalesce(100.0 * F.col("shared") / F.nullif(F.col(f"size_{s}"), F.lit(0)), F.lit(0.0))))
    return pairs.where(F.col("identical") | (F.greatest("pct_a", "pct_b") >= min_percent)).select("file_a", "file_b", "shared", "size_a", "size_b", "pct_a", "pct_b", "identical")


def directed(pairs: DataFrame) -> DataFrame:
    """Each pair once from either side: file, partner, pct, identical."""
    one = pairs.select(F.col("file_a").alias("file"), F.col("file_b").alias("partner"), F.col("pct_a").alias("pct"), "identical")
    return one.unionByName(pairs.select(F.col("file_b").alias("file"), F.col("file_a").alias("partner"), F.col("pct_b").alias("pct"), "identical"))


def best_partners(pairs: DataFrame) -> DataFrame:
    """Each file's best partner: the greatest share, equal contents first, then by name (T4)."""
    most = pairs.groupBy("file").agg(F.max(F.struct("pct", "identical")).alias("m"))
    tied = pairs.join(most, "file").where("pct = m.pct AND identical = m.identical").groupBy("file", "pct", "identical").agg(F.min("partner").alias("partner"))
    return tied.select("file", "partner", "pct", "identical")


def exclusions(files: list[tuple[str, bool]], pairs: list[tuple[str, str, float, bool]], threshold: float = 80.0) -> dict[str, tuple[str, float, bool]]:
    """Files to leave out with their partner, share and whether contents are equal; each decision depends on those before.

    files: (name, is it named as a copy); pairs: directed rows. Copies are decided first, each file by its best partner
    that is still in, and one of the two must be named as a copy. A list of files is small, so this runs on the driver.
    """
    copies, by_file = {n for n, c in files if c}, {}
    for name, partner, pct, same in pairs:
        if pct >= threshold:
            by_file.setdefault(name, []).append((-pct, not same, partner))
    out: dict[str, tuple[str, float, bool]] = {}
    for name in sorted((n for n, _ in files), key=lambda n: (n not in copies, n)):
        choices = [o for o in by_file.get(name, ()) if o[2] not in out and (name in copies or o[2] in copies)]
        if choices:
            pct, other, partner = min(choices)
            out[name] = (partner, -pct, not other)
    return out


def name_groups(files: DataFrame) -> DataFrame:
    """(key, files): files whose names are alike, of groups with a new one (X7). files: file, is_new."""
    g = files.withColumn("key", name_key(F.col("file"))).groupBy("key").agg(F.array_sort(F.collect_set("file")).alias("files"), F.bool_or("is_new").alias("any_new"))
    return g.where((F.size("files") > 1) & F.col("any_new")).select("key", "files")


def key_clashes(keys: DataFrame) -> DataFrame:
    """(product_key, n) of keys that several files have, old and new ones together."""
    return keys.where(F.coalesce("product_key", F.lit("")) != "").groupBy("product_key").agg(F.count("*").alias("n")).where("n > 1")


def suggestions(files: DataFrame, clashes: DataFrame, threshold: float = 80.0) -> DataFrame:
    """(file, usulan): what to do with each file, and why (X6). files: file, product_key, n_reviews, pct, excluded."""
    f = files.join(clashes.select("product_key", F.lit(True).alias("clash")), "product_key", "left")
    share = F.expr("format_number(pct, '0.######')")
    # fixed values: the notes
    notes = (
        (F.col("n_reviews") == 0, F.lit("0 ulasan terbaca (cleaning akan melewati berkas); cek skema")),
        (F.col("pct") >= threshold, F.concat(F.lit("tumpang tindih "), share, F.lit("% tanpa nama salinan; tinjau manual"))),
        (F.coalesce("clash", F.lit(False)), F.lit("product_key sama dengan berkas lain (digabung jadi satu produk)")),
        (is_copy_name(F.col("file")), F.lit("bernama salinan tetapi tidak memenuhi aturan; tinjau")),
    )
    said = F.concat_ws("; ", *[F.when(cond, text) for cond, text in notes])
    return f.select("file", F.when(F.col("excluded"), "kecualikan (aturan salinan)").when(said == "", "pertahankan").otherwise(said).alias("usulan"))


def revised_mapping(mapping: DataFrame, new: DataFrame, excluded: DataFrame, own: str) -> DataFrame:
    """Old rows and new files, the table's own row and left-out files marked (PR15, U2).

    excluded: file, note.
    """
    rows = mapping.unionByName(new.join(mapping.select("file"), "file", "left_anti"), allowMissingColumns=True).join(excluded, "file", "left")
    status = F.when(F.col("file") == own, "bukan_data").when(F.col("note").isNotNull(), "dikecualikan").otherwise(F.col("status"))
    return rows.withColumns({"status": status, "catatan": F.concat_ws("; ", F.nullif("catatan", F.lit("")), "note")}).drop("note")
