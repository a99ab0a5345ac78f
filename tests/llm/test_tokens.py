"""Records (1) and byte-pair encoding (8) against the library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumbung.llm import records
from lumbung.llm.bpe import encode_documents, encoder, op8_bpe
from lumbung.llm.common import shared_folder


def ids_of(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_op1_is_the_library(spark, sf_dir, texts, library):
    want, start = {}, 0
    for i in sorted(texts):
        b = ids_of(library, texts[i]) + b"\1\0\0\0"
        want[i] = (start, len(b) // 4, zlib.crc32(b))
        start += len(b) // 4
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in records.op1_token_records(spark, sf_dir).collect()} == want


def test_op8_is_the_library(spark, sf_dir, texts, library):
    for r in op8_bpe(spark, sf_dir).collect():
        ids = ids_of(library, texts[r["doc_id"]])
        decoded = library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aabcdeehinorstthu'!.#1 éñßΣ漢\n\x1c\x85  ́‍"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = _LIBRARY.setdefault(path, Tokenizer.from_file(path))
    words = _LIBRARY.setdefault("words", records.LibraryWords(path, 1))
    want = ids_of(library, text)
    assert encoder(path).encode(text.encode()) == want
    assert np.frombuffer(next(iter(words.encode([text.encode()]))), "<u2").astype("<u4").tobytes() == want


_LIBRARY: dict = {}


def test_special_tokens_and_long_words(tokenizer_path, library):
    bpe = encoder(tokenizer_path)
    for text in ("a<|endoftext|>b <|startoftext|>", "<|endof text|>", "<|endoftext|><|endoftext|>", "ha" * 3000, "=" * 2001, "x" * 777):
        ids = ids_of(library, text)
        assert bpe.encode(text.encode()) == ids
        assert bpe.decode(ids).decode() == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_checksums_and_frames():
    assert records.crc32c(b"123456789") == 0xE3069283
    rng = random.Random(1)
    items = [rng.randbytes(n) for n in [*range(0, 40), 63, 64, 65, 1000, 4097, 70_001]]
    assert records.crc32c_many(items, 1 << 16) == [records.crc32c(x) for x in items]
    framed = records.frames(items)
    assert records.unframe(framed) == items
    for at in (0, 9, 14, len(framed[-1]) - 1):
        bad = bytearray(framed[-1])
        bad[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            records.unframe([bytes(bad)])
    with pytest.raises(ValueError, match="cut"):
        records.unframe([b"short"])


def test_shuffled_reads_and_shards(spark, docs, tokenizer_path):
    folder = shared_folder(spark, "test-records")
    index = records.write_records(docs, tokenizer_path, folder, shard_bytes=20_000)
    assert index.select("file").distinct().count() > 5
    plain = {r["doc_id"]: r["ids_crc32"] for r in records.read_records(spark, folder).collect()}
    mixed = records.read_records(spark, folder, shuffle_seed=3).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in mixed} == plain and [r["doc_id"] for r in mixed] != sorted(plain)


def test_odd_rows(spark, odd, none, tokenizer_path, library):
    for df, n in ((odd, 13), (none, 0)):
        folder = shared_folder(spark, "test-odd")
        index = records.write_records(df, tokenizer_path, folder)
        rows = records.read_records(spark, folder).join(records.starts(index), "task").collect()
        assert len(rows) == n
        at = sorted((r["base"] + r["task_start"], r["n_tokens"]) for r in rows)
        assert [a for a, _ in at] == [sum(k for _, k in at[:i]) for i in range(n)]
        out = encode_documents(df, tokenizer_path, keep=("doc_id", "score"), outputs=("ids", "decoded")).collect()
        assert len(out) == n and all(r["n_tokens"] == len(r["ids"]) // 4 for r in out)
        if n:
            by = {r["doc_id"]: r for r in out}
            assert by[1]["n_tokens"] == by[2]["n_tokens"] == by[3]["n_tokens"] == 0 and by[1]["decoded"] == ""
            assert bytes(by[4]["ids"]) == ids_of(library, odd.where("doc_id = 4").first()["text"])


def test_another_tokenizer_file(spark, docs, texts, odd):
    """A byte-level file with other pieces: the library's own chain cuts the texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    words = records.LibraryWords(path, 50256)
    assert not words.by_word
    some = [*list(texts.values())[:150], "", "a  b\n\n c<|endoftext|>d \u00e9\u6f22\U0001f600", "'ll we've\t x"]
    got = [np.frombuffer(x, f"<u{words.width}").astype("<u4").tobytes() for x in words.encode([t.encode() for t in some])]
    assert got == [ids_of(library, t) for t in some] == [encoder(path).encode(t.encode()) for t in some]
    for t, ids in zip(some, got, strict=True):
        assert encoder(path).decode(ids).decode() == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False) == t
    cut = got[-2][:-4]  # ends within a character
    assert encoder(path).decode(cut).decode() == library.decode(np.frombuffer(cut, "<u4").tolist(), skip_special_tokens=False)


def test_shards_of_many_empty_records(spark, tokenizer_path):
    folder = shared_folder(spark, "test-many")
    df = spark.range(0, 3000, 1, 2).selectExpr("id AS doc_id", "'' AS text")
    index = records.write_records(df, tokenizer_path, folder, shard_records=100)
    assert index.groupBy("file").count().agg({"count": "max"}).first()[0] == 100
    assert records.read_records(spark, folder).where("n_tokens = 1").count() == 3000


def test_workers_give_memory_back():
    """A task's freed memory goes back to the system at its end, also from below what stays."""
    import subprocess
    import sys

    code = """
import os
from lumbung.llm.common import tidy

def held():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGESIZE") >> 20

def run(batches):
    some = [os.urandom(4000) for _ in range(50_000)]
    keep.append(os.urandom(4000))  # lies above them
    yield len(some)

keep, before = [], held()
assert list(tidy(run)([])) == [50_000]
assert held() - before < 60, held() - before
"""
    subprocess.run([sys.executable, "-c", code], check=True)


def test_an_encoder_is_small_and_goes_with_its_tasks(tokenizer_path):
    """A worker holds no second copy of the vocabulary, and nothing of it beside tasks of another kind."""
    import subprocess
    import sys

    code = """
import os, sys
import numpy, pyarrow, ahocorasick, tokenizers
from lumbung.llm.bpe import encoder
from lumbung.llm.common import give_back, tidy

def held():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGESIZE") >> 20

give_back()
before = held()
assert encoder(sys.argv[1]) is encoder(sys.argv[1])
assert held() - before < 54, held() - before
assert list(tidy(iter)([1])) == [1]
assert held() - before < 30, held() - before
"""
    subprocess.run([sys.executable, "-c", code, tokenizer_path], check=True)


def test_batches_for_workers_are_bounded_by_bytes(spark, tokenizer_path):
    """Many long texts of one partition do not meet in one batch."""
    import pyarrow as pa

    from lumbung.llm.bpe import encode_documents

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('satu dua ', 400) AS text")
    encode_documents(df, tokenizer_path)
    got = [r["n"] for r in df.mapInArrow(sizes, "n bigint").collect()]
    assert sum(got) > 10_000_000 and max(got) < 4_000_000


def test_words_that_return_stay_remembered(monkeypatch, tokenizer_path, library):
    """A full table forgets what a block of texts lacks, and keeps what it has; special, odd and long-worded blocks too."""
    from lumbung.llm import bpe

    monkeypatch.setattr(bpe, "REMEMBER", 64)
    e = bpe.BacktrackingEncoder(tokenizer_path)
    hot = "Zqwxkrandung übergrößtes qwvrt's x<|endoftext|>y e\u0301t\u00e9 12a!?"
    texts = [hot + " " + " ".join(f"vkw{chr(97 + n % 26)}{'qz' * (k + 1)}" for k in range(9)) + " <|" * (n % 3) for n in range(40)] + ["", " \n", " ".join(f"aq{n}" for n in range(99))]
    got = []
    for n, ids in enumerate(e.encode_many([t.encode() for t in texts], block=1)):
        got.append(np.frombuffer(ids, "<u4").tolist())
        if n < 40:
            assert set(hot.encode().split()) <= set(e.words) and len(e.words) <= 64
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_returning_word_is_encoded_once(monkeypatch, tokenizer_path, library):
    """A full table of words keeps those of the block at hand; texts come as Arrow slices, with any white space around their words."""
    import pyarrow as pa

    monkeypatch.setattr(records, "REMEMBER", 64)
    words, learnt = records.LibraryWords(tokenizer_path, 1), []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda new: (learnt.extend(new), learn(new)))
    hot = "Zqwxkrandung \t\x0b\x0c\r\n übergrößtes qwvrt's\x1c x<|endoftext|>y e\u0301t\u00e9 12a!?"
    texts = ["cut off", *[f" {hot} " + " ".join(f"vkw{chr(97 + n % 26)}{'qz' * (k + n)}" for k in range(9)) for n in range(40)], "", " \n", "\u3000 \x85a"]
    got = [np.frombuffer(x, "<u2").tolist() for x in words.encode([t.encode() for t in texts[1:]], block=1)]
    assert [learnt.count(w) for w in hot.encode().split()] == [1] * 6 and len(words.known) <= 64
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts[1:]] == [np.frombuffer(x, "<u2").tolist() for x in words.encode(pa.array(texts).slice(1))]


def test_a_returning_piece_is_encoded_once(tokenizer_path, library):
    """A full table of pieces lets go of those that did not return, not of all."""
    from lumbung.llm import bpe

    e = bpe.BacktrackingEncoder(tokenizer_path)
    made, make, e.pieces.limit = [], e.pieces.make, 16
    e.pieces.make = lambda piece: made.append(piece) or make(piece)
    texts = [f"Qzwxkvb{n}! \t\vaq{chr(97 + n % 26)}x{'zq' * (n // 26 + 1)}k" for n in range(99)]
    got = [np.frombuffer(x, "<u4").tolist() for x in e.encode_many([t.encode() for t in texts], block=1)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert made.count("qzwxkvb" + bpe.END) == 1 and len(made) > 90 and len(e.pieces) <= 16


def test_plain_blocks_are_looked_over_at_once(tokenizer_path, library):
    """op1: a block of plain stretches is not tested stretch by stretch; one with others is, and signs of bytes are as the library has them."""
    plain = ["", " \n", "Übergrößtes a<b <", "x<y|z ñandú's 12a!? ýþÿ ÀÖØÞ àöøÿ", *[f"w{chr(97 + n % 26)}{'éq' * (n % 7)}z{n}" for n in range(2 * records.CHUNK)]]
    words = records.LibraryWords(tokenizer_path, 1)
    words.PLAIN = None
    want = lambda texts: [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in words.encode([t.encode() for t in plain])] == want(plain)
    odd = ["a×b", "x<|endoftext|>y", "<|", "é \x1c", "　", " x", *plain]
    words = records.LibraryWords(tokenizer_path, 1)
    assert [np.frombuffer(x, "<u2").tolist() for x in words.encode([t.encode() for t in odd])] == want(odd)
