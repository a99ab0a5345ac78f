"""Scalar rules as column expressions (ids of the survey's inventory in brackets)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and value lists that decide what a cell is.
DATE = r"(?s)^\s*\d{4}-\d{2}-\d{2}(?:[ T]\d{1,2}:\d{2}(?::\d{2})?)?\s*(?:\|.*)?$"
RELATIVE_DATE = r"(?i)^\s*(?:\d+\s*(?:detik|menit|jam|hari|minggu|bulan|tahun)\s*(?:yang\s*)?lalu|kemarin|hari ini|baru saja)\s*$"
URL = r"(?i)^\s*(?:https?://|www\.)\S+\s*$"
URL_IN_TEXT = r"(?i)(?:https?://|www\.)\S+"
MASKED_NAME = r"^\s*\S\*{3,}\S\s*$"
NULL_WORDS = ("", "nan", "none", "null", "<na>")
SELLER_MARKERS = ("respon penjual:", "respon penjual", "seller response", "balasan penjual:")
SELLER_STYLE = (
    r"(?isU)pelanggan yang terhormat|\b(?:toko|produk|customer service|cs|admin) kami\b|\bkami (?:akan|mohon|minta|harap|berharap)\b"
    r"|(?:terima ?kasih|makasih|trimakasih|terimakasih)\b.{0,30}\batas\b.{0,20}\b(?:ulasan|penilaian|review|rating|kepercayaan|dukungan|orderan)"
    r"|\b(?:sudah|telah) berbelanja\b"
)
HANDLE = r"^(?=.*[\d_.])[A-Za-z0-9._]+$"
NAME_HINTS = (
    (r"^web_scraper_start_url$|src$", "url_media"),
    (r"^(timestamp|time|seller-time|XYk98l)$", "timestamp"),
    (r"^(review-attribute|K5v3lN|skuInfo-label)$", "aspect_tag"),
    (r"^(web_scraper_order|pagination|skuInfo-value|seller-name|item-content-like-content-text|rating-media-list__video-cover|img-more-text|lzKjkR|jtmC98|T79_5U|rFzVcr|rating)$", "metadata"),
    (r"^(review\s*\d*|revwie|ulasan|data\d*|item-content-main-content-reviews-item|meQyXP|f35Wh2|YNedDV|FtqM1T|QSiE2A|phone)$", "review_text"),
)
RELATIVE_PARTS = r"(?i)^(?:(\d+)\s*(menit|jam|hari|minggu|bulan|tahun)|se(minggu|bulan))\s*(?:yang\s+)?lalu$"
FUNCTION_WORDS = (
    "yang dan di ke dari ini itu untuk dengan ada juga sudah saya aku nya ya tapi atau karena "
    "jadi sih kak min lagi aja saja kalau kok pun buat dalam akan bisa udah sama"
).split()
LENGTH_BOUNDS = (2, 5, 10, 20, 50)
LABELS = ("negatif", "netral", "positif")
PROBABILITIES = tuple(f"p_{k}" for k in LABELS)


def trimmed(c: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeezed(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, r"(?U)\s+", " "))


def word_count(c: Column) -> Column:
    """Words between white space of any kind."""
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")).cast("bigint")


def classify(value: Column, is_trimmed: bool = False) -> Column:
    """What a cell holds, by the first rule that fits (PR1)."""
    t = value if is_trimmed else trimmed(F.coalesce(value, F.lit("")))
    rules = [
        (F.lower(t).isin(*NULL_WORDS), "kosong"),
        (t.rlike(DATE), "tanggal"),
        (t.rlike(RELATIVE_DATE), "tanggal_relatif"),
        (t.rlike(URL), "url"),
        (F.lower(t).isin(*SELLER_MARKERS), "penanda_penjual"),
        (t.rlike(MASKED_NAME), "nama_tersamar"),
        (~t.rlike(r"\p{L}") & t.rlike(r"[\p{Nd}²³¹⁰-⁹₀-₉①-⑨]"), "angka"),
        (~t.rlike(r"\p{L}") & t.rlike(r"\p{So}"), "teks"),
        (~t.rlike(r"\p{L}"), "simbol"),
        (t.endswith(":") & (word_count(t) <= 4), "label_aspek"),
    ]
    return F.coalesce(*[F.when(cond, name) for cond, name in rules], F.lit("teks"))


def base_column_name(c: Column) -> Column:
    """Without a trailing number in brackets (PR3)."""
    return F.regexp_replace(trimmed(c), r"\s*\(\d+\)$", "")


def name_hint(c: Column) -> Column:
    """The role that a column's name suggests (PR2)."""
    return F.coalesce(*[F.when(base_column_name(c).rlike(p), role) for p, role in NAME_HINTS], F.lit(""))


def relative_parts(raw: Column) -> Column:
    """struct(n, unit) of a relative date, else null."""
    v = F.lower(trimmed(F.split(F.coalesce(raw, F.lit("")), r"\|")[0]))
    n, unit, one = (F.regexp_extract(v, RELATIVE_PARTS, k) for k in (1, 2, 3))
    parts = lambda a, b: F.struct(a.cast("int").alias("n"), b.alias("unit"))
    return (
        F.when(v == "kemarin", parts(F.lit(1), F.lit("hari")))
        .when(v == "hari ini", parts(F.lit(0), F.lit("hari")))
        .when(v.rlike(RELATIVE_PARTS) & (one != ""), parts(F.lit(1), one))
        .when(v.rlike(RELATIVE_PARTS), parts(F.expr("0") + F.try_to_number(n, F.lit("999999999")).cast("int"), unit))
    )


def timestamp_fields(raw: Column, anchor: Column) -> Column:
    """struct(timestamp, has_time, status, is_estimated) of a raw date and its file's anchor (S24, PR19)."""
    v = trimmed(F.split(F.coalesce(raw, F.lit("")), r"\|")[0])
    shape = r"^\d{4}-\d{1,2}-\d{1,2}"
    at = lambda end, form: F.when(v.rlike(shape + end), F.try_to_timestamp(v, F.lit(form)).cast("timestamp_ntz"))
    timed = F.coalesce(at(r" \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"), at(r" \d{1,2}:\d{1,2}$", "yyyy-M-d H:m"))
    dated = at("$", "yyyy-M-d")
    part, day = relative_parts(raw), F.to_date(anchor)
    n, unit = part["n"], part["unit"]
    moved = (
        F.when(unit.isin("menit", "jam"), day)
        .when(unit == "hari", F.date_sub(day, n))
        .when(unit == "minggu", F.date_sub(day, n * 7))
        .when(unit == "bulan", F.add_months(day, -n))
        .when(unit == "tahun", F.add_months(day, -12 * n))
    ).cast("timestamp_ntz")
    status = (
        F.when(part.isNotNull() & anchor.isNull(), "relatif_tanpa_acuan")
        .when(part.isNotNull(), "relatif_dikonversi")
        .when(F.coalesce(timed, dated).isNotNull(), "ok")
        .otherwise("tak_terparsing")
    )
    stamp = F.when(part.isNotNull(), F.when(anchor.isNotNull(), moved)).otherwise(F.coalesce(timed, dated))
    return F.struct(
        stamp.alias("timestamp"), (part.isNull() & timed.isNotNull()).alias("has_time"), status.alias("status"), (status == "relatif_dikonversi").alias("is_estimated"), part.isNotNull().alias("is_relative")
    )


def digit_mask(raw: Column) -> Column:
    """A raw date's pattern: N for each run of digits among letters, else 9 for each digit."""
    head = trimmed(F.split(F.coalesce(raw, F.lit("")), r"\|")[0])
    shape = F.when(head == "", "<kosong>").when(head.rlike("[a-zA-Z]"), F.regexp_replace(head, r"\d+", "N")).otherwise(F.regexp_replace(head, r"\d", "9"))
    return F.when((head != "") & F.contains(raw, F.lit("|")), F.concat(shape, F.lit(" | <teks>"))).otherwise(shape)


def strict_boolean(c: Column) -> Column:
    """true/false/1/0, else an error (PR13)."""
    v = F.lower(trimmed(c.cast("string")))
    return F.when(v.isin("true", "1"), True).when(v.isin("false", "0"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(v, F.lit("null")))).cast("boolean"))


def percent(n: Column, total: Column, digits: int = 2) -> Column:
    """100 n / total, null for a total of 0; half-way cases to even."""
    return F.bround(100.0 * n / F.nullif(total, F.lit(0)), digits)


def argmax_label(*p: Column) -> Column:
    """The first label of the greatest probability, null if any is (PR20)."""
    a, b, c = p
    ok = a.isNotNull() & b.isNotNull() & c.isNotNull()
    return F.when(ok & (a >= b) & (a >= c), LABELS[0]).when(ok & (b >= c), LABELS[1]).when(ok, LABELS[2])


def entropy(*p: Column) -> Column:
    """Shannon entropy in nats, 0 log 0 = 0, null if any is (PR21)."""
    return reduce(lambda a, b: a + b, [F.when(x > 0, -x * F.ln(x)).when(x.isNotNull(), 0.0) for x in p])


def max_probability(*p: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, [x.isNotNull() for x in p]), F.greatest(*p))


def softmax(*logits: Column) -> list[Column]:
    """Shifted by the greatest, so that none overflows (PR27)."""
    top = F.greatest(*logits)
    total = reduce(lambda a, b: a + b, [F.exp(x - top) for x in logits])
    return [F.exp(x - top) / total for x in logits]


def observation(kind: str, negative: Column, neutral: Column, positive: Column, epsilon: float = 1e-6, logits: tuple[Column, ...] | None = None, reference: str = "p_netral") -> Column:
    """The array a sequence model sees: prob, logit (the scorer's own), alr (against the reference) or clr (PR26)."""
    if kind == "prob":
        return F.array(negative, neutral, positive)
    if kind == "logit":
        if logits is None:
            raise ValueError("logit observations need the scorer's logits")
        return F.array(*[x.cast("double") for x in logits])
    a, b, c = (F.ln(F.greatest(F.least(x, F.lit(1.0)), F.lit(epsilon))) for x in (negative, neutral, positive))
    if kind == "alr":
        logs = dict(zip(PROBABILITIES, (a, b, c), strict=True))
        base = logs.pop(reference)
        return F.array(*[x - base for x in logs.values()])
    if kind == "clr":
        mean = (a + b + c) / 3
        return F.array(a - mean, b - mean, c - mean)
    raise ValueError(f"unknown observation {kind!r}")


def length_class(words: Column) -> Column:
    """1-2, 3-5, ... >50; null for no words."""
    low, out = 0, None
    for high in LENGTH_BOUNDS:
        cond, name = (words > low) & (words <= high), f"{low + 1}-{high}"
        out = F.when(cond, name) if out is None else out.when(cond, name)
        low = high
    return out.when(words > low, f">{low}")


def length_classes() -> list[str]:
    lows = (0, *LENGTH_BOUNDS)
    return [f"{a + 1}-{b}" for a, b in zip(lows, LENGTH_BOUNDS, strict=False)] + [f">{LENGTH_BOUNDS[-1]}"]


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters with an inner apostrophe."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{L}+(?:'\p{L}+)?"), F.lit(0)), F.lower)


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, joined by a space."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def joined_review(fragments: Column, separator: str = " | ") -> Column:
    """Fragments as they are, with a separator."""
    return F.array_join(F.transform(fragments, trimmed), separator)


def joined_light(fragments: Column) -> Column:
    """Fragments as sentences: a full stop after each but the last that has no end of its own."""
    clean = F.filter(F.transform(fragments, trimmed), lambda x: x != "")
    return F.array_join(F.transform(clean, lambda x, i: F.when((i < F.size(clean) - 1) & ~x.rlike(r"[.!?…,;:]$"), F.concat(x, F.lit("."))).otherwise(x)), " ")


def shop_and_product(file: Column) -> Column:
    """struct(shop, product) of a file name, at its last underscore (PR14)."""
    stem = F.regexp_replace(file, r"(?i)(\.csv)+$", "")
    return F.struct(trimmed(F.regexp_extract(stem, r"^(.*)_([^_]*)$", 1)).alias("shop"), trimmed(F.regexp_extract(stem, r"^(.*)_([^_]*)$", 2)).alias("product"), stem.contains("_").alias("ok"))


def file_mapping(file: Column) -> Column:
    """A mapping row for a file of no mapping: shop, product, key, status, where the name comes from and notes (PR14)."""
    stem = F.regexp_replace(file, r"(?i)(\.csv)+$", "")
    parts = shop_and_product(file)
    several = F.length(stem) - F.length(F.replace(stem, F.lit("_"), F.lit(""))) > 1
    whole = parts["ok"] & (parts["shop"] != "") & (parts["product"] != "")
    # fixed values: the notes
    notes = (
        (several, "lebih dari satu underscore; dipisah pada underscore terakhir"),
        (F.regexp_count(F.lower(file), F.lit(r"\.csv")) > 1, "akhiran .csv berulang dibuang"),
        (file.rlike("[\"']"), "nama memuat tanda kutip"),
        ((file != trimmed(file)) | stem.rlike(r"\s$| _|_ "), "spasi di ujung/di sekitar underscore dibuang"),
        (is_copy_name(file), "nama berakhiran salinan; akhiran tetap di nama_produk - cek"),
    )
    noted = F.concat_ws("; ", *[F.when(cond, text) for cond, text in notes])
    return F.struct(
        file.alias("file"), F.when(parts["ok"], parts["shop"]).otherwise("").alias("nama_toko"), F.when(parts["ok"], parts["product"]).otherwise(trimmed(stem)).alias("nama_produk"),
        F.when(whole, F.concat_ws("|", F.lower(parts["shop"]), F.lower(parts["product"]))).otherwise("").alias("product_key"), F.when(whole, "ok").otherwise("perlu_cek").alias("status"),
        F.when(~parts["ok"], "tanpa underscore - cek manual").when(several, "underscore terakhir").otherwise("nama file").alias("sumber_nama"),
        F.when(~parts["ok"], "nama berkas tanpa '_' ; toko tidak dapat diturunkan").when(~whole, "toko/produk kosong").otherwise(noted).alias("catatan"),
    )


def is_copy_name(file: Column) -> Column:
    """'x copy', 'x copy 2', 'x (1)' (S14)."""
    return F.regexp_replace(file, r"(?i)(\.csv)+$", "").rlike(r"(?i)(\s+copy(\s*\d+)?|\s*\(\d+\))\s*$")


def name_key(file: Column) -> Column:
    """A key under which similar file names meet."""
    stem = F.regexp_replace(F.regexp_replace(file, r"(?i)(\.csv)+$", ""), r"(?i)(\s+copy(\s*\d+)?|\s*\(\d+\))\s*$", "")
    return squeezed(F.regexp_replace(F.regexp_replace(F.lower(stem), "[^0-9a-z]+", " "), r"([a-z])\1+", "$1"))


def schema_family(columns: Column) -> Column:
    """Which exporter made a file, from its header (PR4)."""
    return (
        F.when(F.array_contains(columns, "web_scraper_order"), "A_webscraper")
        .when(F.exists(columns, lambda c: c.startswith("item-content") | (c == "time")), "B_lazada")
        .otherwise("C_acak")
    )


#: Brands by the beginning of a product's name, in order.
BRANDS = {"Samsung": "Samsung", "iPhone": "Apple", "Xiaomi": "Xiaomi", "Redmi": "Xiaomi", "POCO": "Xiaomi", "OPPO": "OPPO", "vivo": "vivo", "iQOO": "vivo/iQOO", "realme": "realme", "Infinix": "Infinix", "TECNO": "TECNO"}


def brand(product: Column) -> Column:
    """The first prefix that fits, case-sensitive (PR18)."""
    return F.coalesce(*[F.when(product.startswith(p), name) for p, name in BRANDS.items()], F.lit("Lainnya"))


def capacity(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+/\d+GB)", 1), F.lit(""))


def color(text: Column) -> Column:
    return F.nullif(trimmed(F.regexp_extract(text, r"Variasi:\s*([^,]+)", 1)), F.lit(""))


def legacy_text(text: Column) -> Column:
    """The retired normalisation: any character's repeats are cut to two, digits as well."""
    t = F.when(F.lower(trimmed(text)).isin(*NULL_WORDS), "").otherwise(text)
    t = F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), URL_IN_TEXT, " ")
    return squeezed(F.regexp_replace(t, r"(.)\1{2,}", "$1$1"))


def combined_review(*columns: Column) -> Column:
    """Several review columns as one text, each in the retired normal form."""
    return squeezed(F.concat_ws(" ", *[legacy_text(F.coalesce(c, F.lit(""))) for c in columns]))


def written_time(timestamp: Column, has_time: Column) -> Column:
    """A day, with its time only where one is known; empty for none."""
    return F.coalesce(F.when(has_time, F.date_format(timestamp, "yyyy-MM-dd HH:mm")), F.date_format(timestamp, "yyyy-MM-dd"), F.lit(""))


def letters(number: Column) -> Column:
    """A, B, ... Z, AA, AB, ... for 0, 1, ...."""
    # digits run from 1 to 26, so a number loses one before each division
    step = lambda a, _: F.when(a["rest"] > 0, F.struct(F.floor((a["rest"] - 1) / 26).alias("rest"), F.concat(F.char((65 + (a["rest"] - 1) % 26).cast("int")), a["text"]).alias("text"))).otherwise(a)
    first = F.struct((number + 1).cast("bigint").alias("rest"), F.lit("").alias("text"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), first, step, lambda a: a["text"])


def safe_name(name: Column) -> Column:
    """A file name without odd characters."""
    plain = F.regexp_replace(F.regexp_replace(trimmed(name), r"(?U)[^\w\-.]+", "_"), "^-+|-+$", "")
    return F.when(plain == "", "unknown_product").otherwise(plain)
