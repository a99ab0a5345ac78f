"""Secret scan: patterns find candidates, a random forest removes the false ones.

Candidates are values assigned to telling names, keys of known makers' formats and long random-looking runs. The forest
judges each by its length, its transitions between characters and between their classes, its variety, the share that dictionary
words cover, the path it comes from and the words beside it. It learns from labelled findings (``labelled`` makes them of
documents and marks); where none are given, from generated ones of every rule: random values against placeholders, checksums,
identifiers, paths and words. The dictionary is the words of a public vocabulary file, from which the likelihood of letters
after each other is counted as well. All steps are DataFrame functions and the JVM's own forest.

Patterns start where a run starts and never give back what they took, so a text takes time in proportion to its length.
Null and empty texts have no findings; repeated rows repeat theirs; an empty table gives none. A null path counts as
empty. Findings come in the order of the text, never cut off.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.llm.common import checkpointed, documents, text_of

#: An assignment to a telling name, and what it assigns.
NAME = r"(?i:(?<![a-z_\-])[a-z_\-]{0,40}(?:key|token|secret|password|passwd|pwd|credential)[a-z_\-]{0,40}[\"']?\s{0,8}[:=]\s{0,8}[\"']?)"
VALUE = r"[A-Za-z0-9+/=_\-.$\{\}]{8,}+"
#: Fixed formats of known makers, and the other two kinds of candidates.
RULES = {
    "assigned": NAME + VALUE,
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "repository_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}+\b",
    "chat_token": r"(?<![A-Za-z0-9\-])xox[abprs]-[A-Za-z0-9\-]{10,}+",
    "payment_key": r"\bsk_live_[A-Za-z0-9]{16,}+\b",
    "web_token": r"(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{10,}+\.[A-Za-z0-9_\-]{10,}+\.[A-Za-z0-9_\-]*+",
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    "random_run": r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*+[0-9])[A-Za-z0-9+/]{32,}+={0,2}",
}
ANY = "|".join(RULES.values())
FORMAT = "|".join(v for k, v in RULES.items() if k not in ("assigned", "random_run"))
#: What placeholders hold, and words that stand beside true and false ones.
WORDS = "example|sample|test|dummy|fake|placeholder|changeme|change|your|here|insert|replace|password|secret|token|key|value|none|null|true|false|admin|user|default|xxxx|0000|1234|abcd|qwerty"
BESIDE_TRUE = r"(?i)key|token|secret|password|passwd|pwd|credential|auth|bearer|private"
BESIDE_FALSE = r"(?i)sha|md5|checksum|digest|commit|revision|hash|etag|integrity|uuid|guid|build|version|example"
FALSE_PATH = r"(?i)test|example|sample|fixture|mock|doc|readme|tutorial"
FEATURES = ["f_length", "f_transitions", "f_letters", "f_variety", "f_digits", "f_upper", "f_hex", "f_words", "f_placeholder", "f_format", "f_assigned", "f_beside_true", "f_beside_false", "f_path"]
TREES, DEPTH, SEED = 32, 9, 3
#: Generated findings of each kind.
GENERATED = 4000
#: Letters of a dictionary word at least.
WORD_LETTERS = 4
#: Bits of the table of words.
WORD_BITS = 1 << 22


@cache
def dictionary(path: str) -> tuple[tuple[str, ...], dict[str, float]]:
    """The lower-case words of a vocabulary file, and the logarithm of how likely each two letters follow in them.

    The file is small and of a fixed size, and so are both.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix = model.get("end_of_word_suffix") or ""
    names = (k[: len(k) - len(suffix)].lower() for k in model["vocab"] if k.endswith(suffix))
    words = sorted({w for w in names if len(w) >= WORD_LETTERS and w.isascii() and w.isalpha()})
    pairs = Counter(a + b for w in words for a, b in zip(w, w[1:], strict=False))
    letters = [chr(97 + k) for k in range(26)]
    ahead = {a: sum(pairs[a + b] for b in letters) + 26 for a in letters}
    return tuple(words), {a + b: math.log((pairs[a + b] + 1) / ahead[a]) for a in letters for b in letters}


@cache
def word_bits(path: str) -> bytes:
    """The dictionary as bits at the words' CRC-32 modulo WORD_BITS. One in a hundred other strings counts as a word."""
    out = bytearray(WORD_BITS // 8)
    for w in dictionary(path)[0]:
        at = zlib.crc32(w.encode()) % WORD_BITS
        out[at // 8] |= 1 << at % 8
    return bytes(out)


def features(found: DataFrame, dictionary_path: str) -> DataFrame:
    """Adds the forest's columns to rows with value, assigned, before, after (the words beside) and path."""
    _, pairs = dictionary(dictionary_path)
    v = F.col("value")
    share = lambda pattern: (F.length(v) - F.length(F.regexp_replace(v, pattern, ""))) / F.greatest(F.length(v), F.lit(1))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]+", "a"), "[A-Z]+", "B"), "[0-9]+", "1"), "[^aB1]+", "-")
    # words of a name in small letters, in capitals or in both
    parts = F.transform(F.regexp_extract_all(v, F.lit("[A-Z]?[a-z]{3,}|[A-Z]{4,}"), F.lit(0)), F.lower)
    # a subquery: plans have its number only, where a literal's digits would stand in each text that the driver keeps of them
    words = found.sparkSession.createDataFrame([(bytearray(word_bits(dictionary_path)),)], "bits binary").scalar()
    found = found.withColumns({"__parts": parts, "__words": words})
    bit = f"shiftright(CAST(conv(hex(substring(__words, CAST(crc32(w) % {WORD_BITS} DIV 8 AS INT) + 1, 1)), 16, 10) AS INT), CAST(crc32(w) % 8 AS INT)) % 2 = 1"
    known = F.aggregate(F.expr(f"filter(__parts, w -> {bit})"), F.lit(0), lambda n, w: n + F.length(w))
    table = F.expr(f"array({', '.join(f'{x!r}D' for x in pairs.values())})")
    two = F.transform(F.sequence(F.lit(1), F.greatest(F.length(v) - 1, F.lit(1))), lambda i: F.lower(F.substring(v, i, F.lit(2))))
    place = lambda x: (F.ascii(x) - 97) * 26 + F.ascii(F.substring(x, 2, 1)) - 96
    likely = F.transform(F.filter(two, lambda x: x.rlike("^[a-z]{2}$")), lambda x: F.element_at(table, place(x)))
    return found.withColumns(
        {
            "f_length": F.length(v).cast("double"),
            "f_transitions": (F.length(classes) - 1) / F.greatest(F.length(v) - 1, F.lit(1)),
            "f_letters": F.aggregate(likely, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(likely), F.lit(1)),
            "f_variety": F.size(F.array_distinct(F.split(v, ""))) / F.greatest(F.least(F.length(v), F.lit(64)), F.lit(1)),
            "f_digits": share("[0-9]+"),
            "f_upper": share("[A-Z]+"),
            "f_hex": v.rlike("^[0-9a-f]+$").cast("double"),
            "f_words": known / F.greatest(F.length(v), F.lit(1)),
            "f_placeholder": share(f"(?i){WORDS}"),
            "f_format": v.rlike(f"^(?:{FORMAT})$").cast("double"),
            "f_assigned": F.col("assigned").cast("double"),
            "f_beside_true": F.col("before").rlike(BESIDE_TRUE).cast("double"),
            "f_beside_false": (F.col("before").rlike(BESIDE_FALSE) | F.col("after").rlike(BESIDE_FALSE)).cast("double"),
            "f_path": F.coalesce(F.col("path"), F.lit("")).rlike(FALSE_PATH).cast("double"),
        }
    ).drop("__parts", "__words")


def generated_findings(spark: SparkSession, dictionary_path: str, n: int = GENERATED) -> DataFrame:
    """Labelled findings made from hashes of their numbers: value, assigned, before, after, path, label."""
    words, _ = dictionary(dictionary_path)
    some = words[:: max(1, len(words) // 2000)]
    listed = F.split(F.lit(" ".join(some)), " ")
    h = lambda k: F.sha2(F.concat_ws(":", F.lit(k), F.col("id")), 256)
    r = lambda k, m: F.pmod(F.xxhash64(F.lit(k), F.col("id")), F.lit(m))
    one = lambda k, *xs: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), (r(k, len(xs)) + 1).cast("int"))
    base64 = lambda k: F.regexp_replace(F.concat(F.base64(F.unhex(h(k))), F.base64(F.unhex(h(k + "+")))), "[^A-Za-z0-9]", "Q")
    cut = lambda text, size: F.substring(text, F.lit(1), size if isinstance(size, Column) else F.lit(size))
    length = (r("len", 45) + 16).cast("int")
    word = lambda k: F.element_at(listed, (r(k, max(1, len(some))) + 1).cast("int"))
    dummy = lambda k: one(k, *WORDS.split("|"))
    any_of = lambda k: F.when(r(k + "?", 2) == 0, word(k)).otherwise(dummy(k))
    names = [any_of(f"w{k}") for k in range(4)]
    capital = F.array_join(F.transform(F.array(*names), F.initcap), "")
    formats = lambda body: (
        F.concat(F.lit("AKIA"), F.upper(cut(body, 16))), F.concat(F.lit("sk_live_"), cut(body, 24)), F.concat(F.lit("ghp_"), cut(body, 36)),
        F.concat(F.lit("xoxb-"), F.translate(cut(h("x"), 12), "abcdef", "012345"), F.lit("-"), cut(body, 24)), F.concat(F.lit("eyJ"), cut(body, 30), F.lit("."), cut(base64("y"), 40), F.lit("."), cut(base64("z"), 40)),
    )
    true = one(
        "kind", cut(h("a"), F.greatest(length, F.lit(20))), cut(base64("b"), length), *formats(base64("c")), cut(h("a"), 40), F.concat_ws("-", cut(base64("d"), 10), cut(base64("e"), 12), cut(base64("f"), 8)),
        F.concat(F.lit("-----BEGIN "), one("pk", "", "RSA ", "EC ", "OPENSSH "), F.lit("PRIVATE KEY-----")), F.concat(word("w1"), cut(base64("g"), 12)),
    )
    padded = F.rpad(F.upper(F.concat(any_of("w1"), any_of("w2"), F.lit("EXAMPLE"))), 80, "X")
    false = one(
        "kind", h("a"), cut(h("b"), 40), cut(F.translate(h("c"), "abcdef", "000000"), 32), F.concat_ws("-", cut(h("d"), 8), cut(h("e"), 4), cut(h("f"), 12)), F.repeat(one("rep", "x", "0", "a", "1", "-", "X"), length), F.concat_ws("_", *names[:3]),
        F.concat_ws(".", *names), F.concat_ws("-", *names[:3]), F.concat_ws("/", *names, F.lit("v1"), *names), F.concat(F.lit("${"), names[0], F.lit("_"), names[1], F.lit("}")), capital, F.concat(capital, F.lit("123")), F.upper(F.concat_ws("_", *names[:3])), F.concat(F.lit("process.env."), F.upper(F.concat_ws("_", *names[:2]))), *formats(padded),
    )
    ids = spark.range(n)
    # what stands beside a key of a known format says less
    bare = F.when(true.rlike(f"^(?:{FORMAT})$"), r("bare", 10) < 6).otherwise(r("bare", 10) < 1)
    plain = ("a", "the", "chat", "value", "text", "")
    paths = ("src1", "app/config", "deploy/prod", "web", "tests/fixtures", "docs/readme")
    good = ids.select(true.alias("value"), ((r("as", 10) < 9) & ~bare).alias("assigned"), F.when(bare, one("before3", *plain)).otherwise(one("before", "api_key", "token", "secret", "password", "auth_token", "private")).alias("before"), one("after", "", "the", "and", "user").alias("after"), one("path", *paths[:4]).alias("path"), F.lit(1.0).alias("label"))
    # hashes count as false where their neighbours say so; the rest are false by what they hold
    hashlike = r("kind", 19) < 4
    bad = ids.select(
        false.alias("value"), (~hashlike & (r("as", 10) < 6)).alias("assigned"), F.when(hashlike, one("before", "sha256", "md5", "commit", "checksum", "digest", "etag", "build")).otherwise(one("before2", "api_key", "token", "secret", "password", "name", *plain)).alias("before"),
        one("after", "", "the", "and", "user").alias("after"), one("path", *paths).alias("path"), F.lit(0.0).alias("label"),
    )
    return good.unionByName(bad)


def labelled(docs: DataFrame, marks: DataFrame, path: str | None = None) -> DataFrame:
    """Findings to learn from: the candidates of documents, labelled by marks (doc_id, start, is_secret)."""
    marks = marks.select("doc_id", "start", F.col("is_secret").cast("double").alias("label"))
    return candidates(docs, path).join(marks, ["doc_id", "start"]).select("value", "assigned", "before", "after", "path", "label")


def train(spark: SparkSession, findings: DataFrame | None, dictionary_path: str):
    """A forest from labelled findings (value, assigned, before, after, path, label)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    findings = generated_findings(spark, dictionary_path) if findings is None else findings
    forest = RandomForestClassifier(featuresCol="__features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction")
    # the fit runs many plans over its rows: these are made once, and the plans begin after them
    rows = checkpointed(features(findings, dictionary_path).select(*FEATURES, "label"))
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="__features"), forest]).fit(rows)


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row a match of any rule: doc_id, rule, start (from 0, in characters), value, assigned, before, after, path."""
    text = text_of(docs)
    matches = docs.select(docs["doc_id"], (docs[path].cast("string") if path else F.lit(None).cast("string")).alias("path"), text.alias("__text"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("__found")).where(F.size("__found") > 0)
    # what lies between the matches gives their places and neighbours
    parts = matches.select("doc_id", "path", "__found", F.split("__text", ANY, -1).alias("__between"))
    before = F.col("__between")
    step = lambda a, x: F.struct((a["at"] + F.length(x["b"]) + F.length(x["m"])).alias("at"), F.array_append(a["starts"], (a["at"] + F.length(x["b"])).cast("int")).alias("starts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    pairs = F.zip_with("__found", F.slice("__between", 1, F.size("__found")), lambda m, b: F.struct(m.alias("m"), b.alias("b")))
    parts = parts.withColumn("__starts", F.aggregate(pairs, start, step, lambda a: a["starts"]))
    tail = lambda s: F.right(s, F.lit(60))
    head = lambda s: F.left(s, F.lit(60))
    each = parts.select("doc_id", "path", F.posexplode(F.arrays_zip("__found", "__starts", F.transform(F.slice(before, 1, F.size("__found")), tail).alias("left"), F.transform(F.slice(before, 2, F.size("__found")), head).alias("right"))).alias("n", "x"))
    each = each.select("doc_id", "path", F.col("x.__found").alias("match"), F.col("x.__starts").alias("start"), F.col("x.left").alias("left"), F.col("x.right").alias("right"))
    rule = F.coalesce(*[F.when(F.col("match").rlike(f"^(?:{p})$"), k) for k, p in RULES.items()], F.lit("random_run"))
    each = each.withColumn("rule", rule).withColumn("assigned", F.col("rule") == "assigned")
    value = F.when(F.col("assigned"), F.regexp_extract("match", f"^{NAME}({VALUE})$", 1)).otherwise(F.col("match"))
    each = each.withColumn("value", value)
    name = F.substring(F.col("match"), F.lit(1), F.length("match") - F.length("value"))
    return each.select(
        "doc_id", "rule", (F.col("start") + F.length(name)).alias("start"), "value", "assigned", F.concat_ws(" ", F.regexp_extract("left", r"(\S+)\s*$", 1), name).alias("before"), F.regexp_extract("right", r"^\W*(\w+)", 1).alias("after"), "path"
    )


def scan(docs: DataFrame, dictionary_path: str, path: str | None = None, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Every candidate with the forest's score and verdict."""
    from pyspark.ml.functions import vector_to_array

    scored = train(docs.sparkSession, findings, dictionary_path).transform(features(candidates(docs, path), dictionary_path))
    score: Column = F.round(vector_to_array("__probability")[1], 6)
    return scored.select("doc_id", "rule", "start", "value", "before", "after", score.alias("score"), (score >= threshold).alias("is_secret"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in every document; values are given by length and digest only."""
    import public_tokenizers

    found = scan(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), path="source")
    return found.select("doc_id", "rule", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")
