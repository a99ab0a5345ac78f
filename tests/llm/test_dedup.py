"""Exact dedup (2), repeated bytes (4) and the Jaccard join (9) against brute force."""

import hashlib
import itertools
import os
import random
import subprocess
import sys
from collections import defaultdict

import numpy as np
import pytest

from lumbung.llm import jaccard_join as jaccard
from lumbung.llm import suffix_dedup
from lumbung.llm.exact_dedup import OP2_SQL, exact_dedup, op2_exact_dedup
from lumbung.llm.jaccard_join import components, jaccard_join, op9_jaccard_join, shingle_sets, word_hashes
from lumbung.llm.suffix_dedup import earlier_windows
from lumbung.llm.suffix_sort import Store, suffix_order


def test_op2_is_the_sql(spark, sf_dir, duck, same_rows):
    same_rows(op2_exact_dedup(spark, sf_dir), duck.sql(OP2_SQL))


def test_exact_odd_rows(odd, none):
    assert exact_dedup(none, digest_all=True).count() == 0
    rows = exact_dedup(odd, digest_all=True).collect()
    assert len(rows) == 13
    blank = [r for r in rows if r["doc_id"] in (1, 2, 3)]
    assert {r["keep_id"] for r in blank} == {3} and {r["group_size"] for r in blank} == {4}
    same = [r for r in rows if r["text_sha256"] == hashlib.sha256(b"Satuduatiga.").hexdigest()]
    assert len(same) == 3 and sum(r["kept"] for r in same) == 1 and {r["keep_id"] for r in same} == {6}
    assert [r["keep_id"] for r in rows if r["doc_id"] in (4, 5)] == [4, 4]
    only = {(r["doc_id"], r["kept"]) for r in exact_dedup(odd, carry=("text",)).collect()}
    assert only == {(r["doc_id"], r["kept"]) for r in rows}
    with pytest.raises(ValueError):
        exact_dedup(odd)


def spans_by_force(texts, length=50):
    first, out = {}, {}
    for i in sorted(texts):
        b = texts[i].encode()
        hit = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first.setdefault(b[k : k + length], i) < i:
                hit[k : k + length] = b"\1" * length
        left = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        runs = sum(1 for k in range(len(b)) if hit[k] and not (k and hit[k - 1]))
        out[i] = (len(b), len(b) - len(left), runs, hashlib.sha256(left).hexdigest())
    return out


def results(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("small", [False, True])
def test_op4_by_force(spark, sf_dir, texts, small, monkeypatch):
    if small:  # many ranges and shards
        monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 50_000)
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 50_000)
        monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 30_000)
    assert results(suffix_dedup.op4_suffix_dedup(spark, sf_dir)) == spans_by_force(texts)


def test_op4_on_runs_and_edges(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdé ") for _ in range(70))
    texts = {1: "x" * 200, 2: "y" + "x" * 120 + "z", 3: passage, 4: passage[:49] + "!", 5: "?" + passage[5:] + "?" + passage[:60], 6: "ab" * 60, 7: "ba" * 60, 8: "x" * 49, 9: "x" * 50, 10: passage, 11: "", 12: "é" * 40}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert results(suffix_dedup.suffix_dedup(df)) == spans_by_force(texts)


def test_op4_sends_blocks_and_not_texts(spark, monkeypatch):
    """What ranges and shards find goes on in a block for each range of texts: not in a row for each text of each range."""
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(40)]
    texts = {i: " ".join([str(rng.random()), *rng.sample(passages, 12)]) for i in range(300)}
    kept, sent = suffix_dedup.materialise, {}

    def counted(df, purpose):
        out = kept(df, purpose)
        sent[purpose] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "materialise", counted)
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 100_000)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert results(suffix_dedup.suffix_dedup(df)) == spans_by_force(texts)
    assert 0 < sent["repeat-anchors"] <= 16 and 0 < sent["repeat-spans"] <= 16


def test_op4_odd_rows(odd, none):
    assert suffix_dedup.suffix_dedup(none).count() == 0
    rows = suffix_dedup.suffix_dedup(odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 13 and by[5]["n_removed"] == by[5]["n_bytes"] > 0 and by[5]["n_spans"] == 1 and by[4]["n_removed"] == 0
    assert by[1]["n_bytes"] == 0 and by[10]["n_removed"] > 100 and by[9]["n_removed"] == 0
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] is None)


def check_order(t, depth, store):
    order, common = suffix_order(np.frombuffer(t, np.uint8), depth, store)
    assert np.array_equal(np.sort(order), np.arange(len(t)))
    heads = [t[i : i + depth] for i in order.tolist()]
    for i in range(1, len(t)):
        a, b = heads[i - 1], heads[i]
        k = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert a <= b and common[i] == k


def test_suffix_order_by_force():
    rng = random.Random(9)
    for n in [*range(0, 40), 60, 90]:
        for alphabet, depth in itertools.product((1, 2, 4), (3, 100)):
            check_order(bytes(97 + rng.randrange(alphabet) for _ in range(n)), depth, Store(rng.choice([0, 1 << 10, 1 << 20])))


def test_suffix_order_recurses_and_spills():
    rng = random.Random(5)
    words = [bytes(97 + rng.randrange(20) for _ in range(rng.randrange(2, 9))) for _ in range(30)]
    texts = [rng.randbytes(4000), bytes(97 + rng.randrange(3) for _ in range(5000)), b" ".join(rng.choice(words) for _ in range(900)), b"abcab" * 900, b"a" * 3000]
    deepest = 0
    for t, depth, memory in itertools.product(texts, (5, 50), (0, 2000)):
        store = Store(memory)
        check_order(t, depth, store)
        deepest = max(deepest, store.levels)
        assert store.spilled > len(t) or len(set(t)) == 1  # runs of one byte are served as they come
    assert deepest >= 3


def test_suffix_order_in_little_memory():
    """24 MB of text in a process that may take 110 MB more than it began with; the arrays of a sort in memory would need some 700 MB."""
    code = """
import resource, sys
import numpy as np
from lumbung.llm.suffix_sort import Store, suffix_order
rng = np.random.default_rng(1)
words = [rng.integers(97, 123, rng.integers(2, 10)).astype(np.uint8).tobytes() for _ in range(5000)]
store = Store(2 << 20)
text = store.listed((np.frombuffer(b" ".join(words[i] for i in rng.integers(0, 5000, 20000).tolist()), np.uint8) for _ in range(190)), "u1")
now = next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("VmData")) << 10
resource.setrlimit(resource.RLIMIT_DATA, (now + (110 << 20),) * 2)
order, common = suffix_order(text, 50, store)
assert len(text) > 24_000_000 and store.levels >= 3 and store.spilled > 5 * len(text)
step = 997
for i in range(1, len(text), step * 10):
    a, b = (text[p : p + 50].tobytes() for p in order[i - 1 : i + 1].tolist())
    assert a <= b and common[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
seen = np.zeros(len(text), bool)
for a, z in store.blocks(len(text)):
    seen[order[a:z]] = True
assert seen.all()
print("whole")
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, env=os.environ | {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"})
    assert done.stdout.strip() == "whole", done.stderr[-2000:]


@pytest.mark.parametrize("memory", [0, 3000, 8 << 20])
def test_earlier_windows_by_force(memory):
    rng = random.Random(8)
    base = bytes(97 + rng.randrange(3) for _ in range(400))
    stretches = list({base[a : a + rng.randrange(12, 40)] for a in range(0, 380, 3)} | {b"a" * 30, b"a" * 25, b"b" * 9})
    least = np.array([rng.randrange(50) for _ in stretches])
    first = {}
    for s, i in zip(stretches, least.tolist(), strict=True):
        for k in range(len(s) - 9):
            first[s[k : k + 10]] = min(first.get(s[k : k + 10], 99), i)
    want = {(n, k) for n, (s, i) in enumerate(zip(stretches, least.tolist(), strict=True)) for k in range(len(s) - 9) if first[s[k : k + 10]] < i}
    got = [(n, k) for n, a, z in zip(*(x.tolist() for x in earlier_windows(stretches, least, 10, Store(memory))), strict=True) for k in range(a, z + 1)]
    assert set(got) == want and len(got) == len(want) > 50
    assert [len(x) for x in earlier_windows([], np.empty(0, np.int64))] == [0, 0, 0]


def components_by_force(texts, n, percent):
    sets, parent = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = [x.decode() for x in t.encode().lower().split()]
        sets[i] = {tuple(w)} if 0 < len(w) < n else set(zip(*[w[k:] for k in range(n)], strict=False))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i in sorted(sets):
        common = defaultdict(int)
        for s in sets[i]:
            for j in where[s]:
                common[j] += 1
            where[s].append(i)
        for j, c in common.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def joined(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_op9_by_force(spark, sf_dir, texts):
    assert joined(op9_jaccard_join(spark, sf_dir)) == components_by_force(texts, 3, 90)


def test_join_of_near_copies_and_common_passages(spark):
    """Chains of near copies, short sets, sizes at the limit, and passages that most documents share."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts, n = {}, 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(4, 130))]
        for _ in range(rng.randint(1, 9)):
            for _ in range(rng.randint(0, 2)):  # a chain: each is an edit of the one before
                base = base[:]
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts[n] = " ".join(base + (passage if n % 2 else []))
            n += 1
    for k in range(8, 14):
        texts[n], texts[n + 1] = " ".join(vocabulary[:k]), " ".join(vocabulary[: k + 1])
        n += 2
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for size, percent in ((3, 90), (5, 80), (1, 60)):
        assert joined(jaccard_join(df, size, percent)) == components_by_force(texts, size, percent)


@pytest.mark.parametrize(("n", "percent", "length", "edits"), [(3, 90, 150, 5), (5, 80, 120, 9), (1, 60, 40, 12)])
def test_join_of_a_large_group_of_near_copies(spark, n, percent, length, edits, monkeypatch):
    """One text's many near copies, of which some link with it, some with each other and most with none; and copies of copies."""
    from lumbung.llm import jaccard_join as module

    rng = random.Random(length)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [rng.choice(vocabulary) for _ in range(length)]
    other = base[:]
    for k in rng.sample(range(length), 2 * edits):
        other[k] = rng.choice(vocabulary)
    texts = {}
    for i in range(260):
        words = (base if i % 3 else other)[:]
        for _ in range(rng.randint(0, edits)):
            at, what = rng.randrange(len(words)), rng.randrange(6)
            words[at : at + 1 + (what == 1)] = [] if what == 0 else [rng.choice(vocabulary)]
        texts[1000 - i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    expected = components_by_force(texts, n, percent)
    assert 1 < len({c for _, c in expected.values()}) < 250
    assert joined(jaccard_join(df, n, percent)) == expected
    monkeypatch.setattr(module, "FEW", 2)
    assert joined(jaccard_join(df, n, percent)) == expected


def test_comparing_a_pair_reads_its_sets_only(spark):
    """Sets that no pair asks for do not go through the joins of a comparison."""
    sets = spark.createDataFrame([(i.to_bytes(16, "big"), np.arange(i, i + 9, dtype="<u8").tobytes()) for i in range(2000)], "k binary, shared binary")
    pairs = spark.createDataFrame([((7).to_bytes(16, "big"), (9).to_bytes(16, "big")), ((7).to_bytes(16, "big"), (1900).to_bytes(16, "big"))], "a binary, b binary")
    assert sorted(r["common"] for r in jaccard._compared(sets, pairs).collect()) == [0, 7]
    keys = pairs.selectExpr("a AS k").union(pairs.select("b"))
    left = {int.from_bytes(r["k"], "big") for r in jaccard._open(sets, keys).collect()}
    assert left >= {7, 9, 1900} and len(left) < 10


def test_what_ranges_get_does_not_grow_with_their_number(spark, monkeypatch):
    """A set goes by its number in its block, not by its digest in each range."""
    from pyspark.sql import functions as F

    rng = random.Random(11)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(300)] for _ in range(160)]
    texts += [[*t[:150], "other", *t[151:]] for t in texts[:40]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(2)
    dealt, kept = [], type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: dealt.append(self) or kept(self, *a))
    found = [{bytes(r["digest"]): (r["n"], r["weight"], len(r["shared"])) for r in jaccard._shared_shingles(df, 3, 90, bits).collect()} for bits in (0, 6)]
    one, many = (f.agg(F.sum(F.octet_length(f.columns[-1]))).first()[0] for f in dealt[::2])
    assert found[0] == found[1] and len(found[0]) == 80
    assert many < 1.2 * one


def test_copies_that_are_sent_twice_change_nothing(spark, monkeypatch):
    """Copies in several tasks that the table of bits lets through are one set, and link as it does."""
    rng = random.Random(12)
    base = [[f"w{rng.randrange(300)}" for _ in range(80)] for _ in range(6)]
    near = [[*t[:40], "other", *t[41:]] for t in base]
    texts = {i: " ".join((base + near)[i % 12]) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4, "doc_id")
    monkeypatch.setattr(jaccard, "_first_copies", lambda docs, classes: docs)
    assert joined(jaccard_join(df, 3, 90)) == components_by_force(texts, 3, 90)


def test_words_of_equal_sums():
    """Words that sums of powers cannot tell apart have fingerprints of their own."""
    for size in (8, 64, 1024, 4096):
        one = bytes(97 + bin(i).count("1") % 2 for i in range(size))
        two = bytes(195 - b for b in one)
        a, b, c = word_hashes(one + b" " + two + b"\n" + one).tolist()
        assert a == c != b
    words = [bytes(p) for k in range(1, 5) for p in itertools.product(b"ab\xff\x00", repeat=k)]
    assert len(set(word_hashes(b" ".join(words)).tolist())) == len(words)


def test_join_odd_rows(odd, none):
    assert jaccard_join(none, 3, 90).count() == 0
    rows = jaccard_join(odd, 3, 90).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 13 and by[1]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[7]["component_id"] == 6 and by[5]["component_id"] == 4
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None, None]


def test_join_through_a_repeated_id(spark):
    a, b, c = ("one two three four five", "six seven eight nine ten", "red green blue black white")
    df = spark.createDataFrame([(1, a), (2, b), (3, a), (3, b), (4, c), (5, c), (5, ""), (6, "alone of all these")], "doc_id bigint, text string")
    rows = jaccard_join(df, 3, 90).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(1, 1), (2, 1), (3, 1), (3, 1), (4, 4), (5, 4), (5, 4), (6, 6)]


def test_long_texts_in_pieces():
    text = " ".join(f"a{i % 300} b{i % 7}" for i in range(5000)).encode()
    whole, pieces = (list(shingle_sets([text, b"", b"x"], 3, block=b)) for b in (1 << 20, 997))
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces, strict=True)) and len(whole[1]) == 0 and len(whole[2]) == 1


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["doc_id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    looped = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in parent if x not in looped}


def test_bits_are_right_about_a_no(spark):
    from pyspark.sql import functions as F

    from lumbung.llm.common import HASH_BITS, hash_bits, with_maybe

    numbers = [0, 1, 7, 8, 9, 32767, 32768, 32769, 65535, HASH_BITS - 1, HASH_BITS, -1, -32768, 12345678901]
    keys = spark.createDataFrame([(n,) for n in numbers[::2]], "k bigint")
    rows = spark.createDataFrame([(n,) for n in numbers], "k bigint")
    got = {r["k"]: r["m"] for r in with_maybe(rows, F.col("k"), hash_bits(keys, F.col("k"), "test-bits"), "m").collect()}
    places = {n % HASH_BITS for n in numbers[::2]}
    assert got == {n: n % HASH_BITS in places for n in numbers} and not all(got.values())
    assert not any(r["m"] for r in with_maybe(rows, F.col("k"), hash_bits(keys.limit(0), F.col("k"), "test-bits"), "m").collect())
