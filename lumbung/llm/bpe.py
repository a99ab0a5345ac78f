"""Exact byte-pair encoding by backtracking, and decoding through an offset table.

The longest vocabulary entry that starts at each position comes from one Aho-Corasick pass over the reversed
pieces. Entries are then taken greedily; an entry may follow another only if byte-pair merging of the two strings
would leave exactly these two (the pair-compatibility table). When no entry fits, the walk takes back its last one
and never comes to that position again, so each position is left at most once and the time is linear.

Null and empty texts give no ids and the empty string; repeated rows give repeated results; an empty table gives
none; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lumbung.llm.common import BYTE_SIGNS, PLAIN_PIECES, PLAIN_WORD, by_stretch, documents, give_back, kept, known_words, small_batches, text_of, tidy

#: Stands for the end-of-word suffix inside pieces; byte-level alphabets have no such character.
END = "\ue000"
#: Remembered words, pieces and pairs of one worker; a full table starts anew.
REMEMBER = 1 << 17
#: Edges of entries that a worker remembers.
EDGES = 1 << 13
#: Bytes of texts whose new words are encoded together.
BLOCK_BYTES = 1 << 19
#: Bytes of results after which a worker hands on what it has.
BATCH_BYTES = 4 << 20


class _Memo(dict):
    """Remembers what ``make`` returns, for ``limit`` keys at most."""

    def __init__(self, make, limit: int = REMEMBER):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
            give_back()
        self[key] = value = self.make(key)
        return value


class _Recent(_Memo):
    """Remembers as many; half a table of new keys lets only those go that were not asked for since the half before."""

    def __init__(self, make, limit: int = REMEMBER):
        super().__init__(make, limit)
        self.older: dict = {}

    def __missing__(self, key):
        if 2 * len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.pop(key, None)
        self[key] = value = self.make(key) if value is None else value
        return value


class BacktrackingEncoder:
    """Encodes as the library does with the same vocabulary file, without its merge loop."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        #: The library's own steps before merging; its tables of the vocabulary would be held beside those below.
        self.library = Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        if model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("this encoder is for plain byte-level merges")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special tokens are taken as they stand in the text")
        #: Whether words are cut here; with any other chain the library cuts whole texts.
        self.by_word = known_words(spec)
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        if spec.get("decoder") and not self.byte_level:
            raise ValueError("the decoder of this file is not known")
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = {self._inner(k): v for k, v in model["vocab"].items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        made: dict[tuple[int, int], int] = {}
        for n, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = vocab[self._inner(left)], vocab[self._inner(right)]
            c = vocab[self._inner(left + right)]
            self.rank.setdefault((a, b), n)
            made.setdefault((a, b), c)
            if c in self.parts:
                raise ValueError("an entry that two merges make needs the library's own merge loop")
            self.parts[c], self.made_at[c] = (a, b), n
        self.text = {v: k for k, v in vocab.items()}
        self.left, self.right = _Memo(lambda v: self._spine(v, False), EDGES), _Memo(lambda v: self._spine(v, True), EDGES)
        self.compatible = _Memo(self._compatible)
        #: An entry that its own parts cannot sit side by side in is never made by merging.
        self.whole = {k: v for k, v in vocab.items() if self._reachable(v)}
        #: Of each entry its length and, if there is one, the longest entry that it begins with.
        self.size, self.shorter = [0] * (max(self.text) + 1), [None] * (max(self.text) + 1)
        for v, k in self.text.items():
            self.size[v] = len(k)
        reverse = ahocorasick.Automaton()
        for k, v in self.whole.items():
            reverse.add_word(k[::-1], v)
            for n in range(len(k) - 1, 0, -1):
                if k[:n] in self.whole:
                    self.shorter[v] = self.whole[k[:n]]
                    break
        reverse.make_automaton()
        self.reverse = reverse
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.is_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.in_bulk = self.by_word and all("<|" in x for x in self.special)
        self.pieces = _Recent(self._encode_piece)
        self.words = _Memo(self._encode_word)
        self._offsets()

    def _inner(self, token: str) -> str:
        return token[: -len(self.suffix)] + END if self.suffix and token.endswith(self.suffix) else token

    def _spine(self, token: int, right: bool) -> list[int]:
        """The entries at the token's right (or left) edge, from one symbol to the token itself, as merging makes them."""
        up = [token]
        while up[-1] in self.parts:
            up.append(self.parts[up[-1]][right])
        return up[::-1]

    def _merges_across(self, one: int, two: int, before: float) -> bool:
        """Whether merging joins something across the border of two tokens before rank ``before``.

        At equal ranks the leftmost pair goes first: the left token's own merge precedes one across the border,
        which precedes one inside the right token.
        """
        left, right, i, j = self.right[one], self.left[two], 0, 0
        while True:
            next_left = self.made_at[left[i + 1]] if i + 1 < len(left) else before
            next_right = self.made_at[right[j + 1]] if j + 1 < len(right) else before
            rank = self.rank.get((left[i], right[j]), before)
            if rank < next_left and (rank < next_right or rank == next_right and j + 1 < len(right)):
                return True
            if i + 1 == len(left) and j + 1 == len(right):
                return False
            if j + 1 == len(right) or i + 1 < len(left) and next_left <= next_right:
                i += 1
            else:
                j += 1

    def _compatible(self, pair: tuple[int, int]) -> bool:
        return not self._merges_across(*pair, float("inf"))

    def _reachable(self, token: int) -> bool:
        if token not in self.parts:
            return True
        one, two = self.parts[token]
        return self._reachable(one) and self._reachable(two) and not self._merges_across(one, two, self.made_at[token])

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-tokenised piece, as little-endian unsigned 32-bit integers; those of an entry are not remembered."""
        if self.suffix:
            piece += END
        known = self.whole.get(piece)
        return self.pieces[piece] if known is None else known.to_bytes(4, "little")

    def _encode_piece(self, piece: str) -> bytes:
        n, last = len(piece), len(piece) - 1
        found = list(self.reverse.iter(piece[::-1]))
        found.reverse()  # of the matches that end at a place the longest now comes last, and stays
        longest, size, shorter, compatible = dict(found), self.size, self.shorter, self.compatible
        closed = {last} if self.suffix else set()  # the suffix is part of the last symbol
        ids, at, before, token = [], 0, None, longest.get(last)
        while at < n:
            while token is not None:
                end = at + size[token]
                if end not in closed and (before is None or compatible[before, token]):
                    ids.append(token)
                    at, before, token = end, token, longest.get(last - end)
                    break
                token = shorter[token]
            else:
                if not ids:
                    raise ValueError(f"no entries spell {piece!r}")
                closed.add(at)
                token = ids.pop()
                at -= size[token]
                before = ids[-1] if ids else None
        return struct.pack(f"<{len(ids)}I", *ids)

    #: ASCII part of the library's pre-tokenising pattern; other words go through the library's own steps.
    ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\x0b\x0c\ra-z0-9]+")

    def _encode_word(self, word: bytes) -> bytes:
        """Ids of a stretch that no piece and no special token crosses the ends of."""
        out, text = [], word.decode("utf-8")
        for part in self.is_special.split(text) if self.is_special else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out += map(self._piece, self._split(part))
        return b"".join(out)

    def _split(self, text: str) -> list[str]:
        if self.by_word and text.isascii() and not any(c < "!" or c == "\x7f" for c in text):
            return self.ASCII.findall(text.lower())
        text = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)] if self.library.pre_tokenizer else [text]

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split())) if self.by_word else self._encode_word(text)

    def _learn(self, new: list[bytes]) -> None:
        """Encodes the plain ones among words not yet remembered."""
        new = list(filter(PLAIN_WORD.fullmatch, new))
        cut = PLAIN_PIECES.findall(b"\n".join([*new, b""]).decode("utf-8").lower())
        some = set(cut)
        some.discard("\n")
        made = {x: self._piece(x if x.isascii() else x.encode("utf-8").decode("latin-1").translate(BYTE_SIGNS)) for x in some}
        made["\n"] = b""  # a word's end: every piece has an id
        parts = list(map(made.__getitem__, cut))
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        ends, data = [0, *np.cumsum(size)[size == 0].tolist()], b"".join(parts)
        self.words.update(zip(new, [data[a:z] for a, z in itertools.pairwise(ends)], strict=True))

    def _known(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words; when the table is full, words that do not occur here go."""
        if len(words) > REMEMBER // 2:
            return list(map(self.words.__getitem__, words))  # one at a time, as the table keeps its bound then
        got = list(map(self.words.get, words))
        new = [n for n, ids in enumerate(got) if ids is None]
        if len(self.words) + len(new) > REMEMBER:
            stay = {w: ids for w, ids in zip(words, got, strict=True) if ids is not None}
            self.words.clear()
            self.words.update(stay)
            give_back()
        if new:
            self._learn([words[n] for n in new])
        for n in new:
            got[n] = self.words[words[n]]
        return got

    def encode_many(self, texts, block: int = BLOCK_BYTES) -> Iterator[bytes]:
        """The ids of each text of an Arrow array of strings or a list of bytes; new words of about ``block`` bytes of texts are encoded together."""
        if self.in_bulk:
            yield from by_stretch(texts, block, self._known)
        else:
            yield from (self.encode(t if isinstance(t, bytes) else t.as_py().encode("utf-8")) for t in texts)

    def _offsets(self) -> None:
        """Every id's text in one block, with an offset for each id; and a space after it, where the file has no decoder."""
        names = {v: k.replace(END, self.suffix) for k, v in self.whole.items()} | {v: k for k, v in self.special.items()}
        names |= {v: k.replace(END, self.suffix) for v, k in self.text.items() if v not in names}
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes whose sign is the character of that number
        signs = {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(own)))}
        raw = lambda name: bytes(map(signs.__getitem__, name)) if self.byte_level else name.encode() + b" "
        blobs = [raw(names.get(i, "")) for i in range(max(names) + 1)]
        self.length = np.fromiter(map(len, blobs), np.int64, len(blobs))
        self.start = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)

    def decode(self, ids: bytes) -> bytes:
        """The library's decode(): the entries' texts with a space between them, or the bytes that they stand for if the file's decoder is of bytes.

        Works in blocks, so that a very long text needs little more memory than its result.
        """
        tokens, out = np.frombuffer(ids, "<u4"), []
        for at in range(0, len(tokens), 1 << 18):
            part = tokens[at : at + (1 << 18)]
            length = self.length[part]
            ends = np.cumsum(length)
            shift = np.repeat(self.start[part] - (ends - length), length)
            out.append(self.blob[shift + np.arange(ends[-1] if len(ends) else 0)].tobytes())
        return b"".join(out).decode("utf-8", "replace").encode() if self.byte_level else b"".join(out)[:-1]


def encoder(path: str) -> BacktrackingEncoder:
    """One encoder for each worker process and vocabulary file, for as long as the process encodes."""
    return kept("bpe", path, BacktrackingEncoder)


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """The columns ``keep`` with, for each document, n_tokens and the asked outputs.

    ids: little-endian unsigned 32-bit integers; decoded: the decoded text; ids_sha256, decoded_sha256: their
    digests in lowercase hex, made beside the encoding so that the long values need not travel.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)
    kinds = {"ids": ("binary", pa.binary()), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    source = docs.select(*[docs[c] for c in keep], text_of(docs).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(keep)]] + ["n_tokens bigint"] + [f"{o} {kinds[o][0]}" for o in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, decodes = encoder(path), any(o.startswith("decoded") for o in outputs)
        def made(batch: pa.RecordBatch, first: int) -> pa.RecordBatch:
            some = batch.slice(first, len(counts)).columns[: len(keep)]
            return pa.RecordBatch.from_arrays([*some, pa.array(counts, pa.int64()), *(pa.array(columns[o], kinds[o][1]) for o in outputs)], [*keep, "n_tokens", *outputs])

        for batch in batches:
            first, size, counts, columns = 0, 0, [], {o: [] for o in outputs}
            for ids in bpe.encode_many(batch.column("__text")):
                if size > BATCH_BYTES:
                    yield made(batch, first)
                    give_back()
                    first, size, counts, columns = first + len(counts), 0, [], {o: [] for o in outputs}
                decoded = bpe.decode(ids) if decodes else b""
                counts.append(len(ids) // 4)
                for o, to in columns.items():
                    value = ids if o.startswith("ids") else decoded
                    to.append(hashlib.sha256(value).hexdigest() if o.endswith("sha256") else value if o == "ids" else value.decode("utf-8"))
                    size += len(to[-1])
            yield made(batch, first)

    return source.mapInArrow(tidy(run, "bpe"), schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count and the digests of its ids and of their decoding."""
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), outputs=("ids_sha256", "decoded_sha256"))
