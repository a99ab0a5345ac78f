"""Text chains. Patterns run in the JVM; Arrow UDFs do what Spark has no expression for: entities, compatibility forms, dictionaries.

Java's patterns know fewer characters as white space than Python's, so its four separators are named.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumbung.config import PROTECTED_TERMS
from lumbung.functions.batches import small_batches

# What both chains take out or keep.
URL = r"(?iU)(?:https?://|www\.)[^\s\x1c-\x1f]+"
TAG = r"<[^>]+>"
SPACE = r"(?U)[\s\x1c-\x1f]+"
EMOJI = "\U0001f000-\U0001faff\u2600-\u27bf\ufe0f"  # as characters: Java looks behind by whole ones only if it sees them in the pattern
KEYCAP = r"[0-9#*]\ufe0f?\u20e3"
NOT_KEPT = r"(?U)[^\p{L}\p{Nd}\s\x1c-\x1f.,!?'\-]"
PUNCTUATION_RUN = r"([.,!?'\-])\1+"
LONG_NUMBER = r"(?U)(?<!\w)\d{6,}(?!\w)"
SEPARATORS, ZERO_WIDTH = "\u2028\u2029\u00a0", "\u200b\u200c\u200d\u2060\ufeff"
LETTER = r"[\p{L}\p{Nl}\p{No}]"

Step = Callable[[Column], Column]


def _sent(change: Callable[[str], str], those: str) -> Step:
    """``change`` as a column function that sends only texts to Python in which the pattern occurs."""

    @F.pandas_udf(StringType())
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(change, na_action="ignore")

    def step(t: Column) -> Column:
        small_batches()
        return F.coalesce(run(F.when(t.rlike(those), t)), t)

    return step


def _replaced(pattern: str, by: str = " ") -> Step:
    return lambda t: F.regexp_replace(t, pattern, by)


def nfkc(text: Column) -> Column:
    """The compatibility form; plain ASCII is its own."""
    return _sent(lambda t: unicodedata.normalize("NFKC", t), r"[^\x00-\x7f]")(text)


def without_markup(text: Column) -> Column:
    """Entities as characters, then tags as spaces."""
    return F.regexp_replace(_sent(html.unescape, "&")(text), TAG, " ")


def without_controls(text: Column) -> Column:
    """Control characters as spaces and no format characters, but for joiners between two emoji."""
    lone = rf"(?<![{EMOJI}])\u200d|\u200d(?![{EMOJI}])"
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, lone, ""), r"\p{Cc}", " "), r"[\p{Cf}&&[^\u200d]]", "")


def tidy(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SPACE, " "), "^ | $", "")


#: The light chain, in order.
LIGHT: dict[str, Step] = {
    "hapus_html": without_markup,
    "hapus_url": _replaced(URL),
    "hapus_kontrol_zero_width": without_controls,
    "normalisasi_nfkc": nfkc,
    "kurangi_huruf_berulang": _replaced(rf"({LETTER})\1{{2,}}", "$1$1"),
    "rapikan_spasi": tidy,
}
#: The proposal chain up to its dictionary, in order (S15 to S19); the steps after it need terms.
PLAIN_PROPOSAL: dict[str, Step] = {
    "nfkc": nfkc,
    "normalisasi_pemisah_unicode": lambda t: F.translate(t, SEPARATORS + ZERO_WIDTH, " " * len(SEPARATORS)),
    "hapus_url": _replaced(URL),
    "hapus_emoji_karakter_khusus": lambda t: F.regexp_replace(F.regexp_replace(t, KEYCAP, " "), NOT_KEPT, " "),
    "ringkas_tanda_baca": _replaced(PUNCTUATION_RUN, "$1"),
    "hapus_angka_panjang": _replaced(LONG_NUMBER),
}
PROPOSAL_STEPS = (*PLAIN_PROPOSAL, "normalisasi_typo_huruf_berulang", "normalisasi_slang", "rapikan_spasi")


def single_letters(protected: Iterable[str]) -> Step:
    """Letters said three times or more become one, but not in protected phrases.

    One pattern finds either, so that a phrase is passed over whole; in descending order a phrase comes before its own beginnings.
    """
    terms = [r"\s+".join(map(re.escape, t.split())) for t in sorted(set(protected), reverse=True) if t.strip()]
    spared = rf"(?<!\w)(?:{'|'.join(terms)})(?!\w)" if terms else r"(?!)"
    return _replaced(rf"(?iU)({spared})|(?-i:({LETTER})\2{{2,}})", "$1$2")


class Phrases:
    """Phrases as a tree of units (words, single signs, gaps), each path ending in what stands for the phrase."""

    UNIT = re.compile(r"\w+|\s+|[^\w\s]")

    def __init__(self, table: Mapping[str, str]):
        self.tree: dict = {}
        for phrase, value in table.items():
            node = self.tree
            for unit in self.units(phrase.strip()):
                node = node.setdefault(self.key(unit), {})
            if node is not self.tree:
                node[None] = (" ".join(phrase.split()).casefold(), value)

    @classmethod
    def units(cls, text: str) -> list[str]:
        return cls.UNIT.findall(text)

    @staticmethod
    def key(unit: str) -> str:
        return " " if unit.isspace() else unit.casefold()

    def spans(self, units: list[str], closed: set[int] = frozenset()) -> list[tuple[int, int, tuple[str, str]]]:
        """The longest phrase from each unit on, left to right, apart from each other and from closed units."""
        word = lambda i: 0 <= i < len(units) and (units[i][0].isalnum() or units[i][0] == "_")
        found, at = [], 0
        while at < len(units):
            node, best, i = self.tree, None, at
            while i < len(units) and i not in closed and (node := node.get(self.key(units[i]))) is not None:
                i += 1
                if None in node and not (word(i - 1) and word(i)):
                    best = (at, i, node[None])
            if best and not (word(at) and word(at - 1)):
                found.append(best)
                at = best[1]
            else:
                at += 1
        return found


#: How a replacement follows what it replaces: the first test that holds.
STYLES = ((str.isupper, str.upper), (str.istitle, lambda w: w[:1].upper() + w[1:]), (bool, str))


def standard_words(slang: Mapping[str, str], protected: Iterable[str]) -> Callable[[str], tuple[str, list[dict[str, str]]]]:
    """A function from a text to the text with standard words, and the replacements made (key, standard)."""
    known, spared = Phrases(slang), Phrases(dict.fromkeys(protected, ""))

    def run(text: str) -> tuple[str, list[dict[str, str]]]:
        units, made = Phrases.units(text), []
        closed = {i for a, z, _ in spared.spans(units) for i in range(a, z)}
        out, done = [], 0
        for a, z, (key, standard) in known.spans(units, closed):
            source = "".join(units[a:z])
            new = next(style(standard) for test, style in STYLES if test(source))
            out += [*units[done:a], new]
            done = z
            if new != source:
                made.append({"key": key, "standard": standard})
        return "".join([*out, *units[done:]]), made

    return run


def _chained(text: Column, steps: Mapping[str, Step]) -> tuple[Column, list[Column]]:
    """The text after all steps, and for each whether it changed the text."""
    changed = []
    for name, step in steps.items():
        new = step(text)
        changed.append((new != text).alias(name))
        text = new
    return text, changed


def clean_light(text: Column, with_nfkc: bool = True) -> Column:
    """struct(text, one boolean for each step that changed it)."""
    out, changed = _chained(F.coalesce(text, F.lit("")), {k: f for k, f in LIGHT.items() if with_nfkc or k != "normalisasi_nfkc"})
    return F.struct(out.alias("text"), *changed)


def clean_proposal(text: Column, slang: Mapping[str, str] | None = None, protected: Iterable[str] = PROTECTED_TERMS) -> Column:
    """struct(text, one boolean for each step, slang: array of (key, standard) replacements)."""
    slang, protected = dict(slang or {}), tuple(protected)

    @F.pandas_udf("text string, slang array<struct<key:string,standard:string>>")
    def replaced(batch: pd.Series) -> pd.DataFrame:
        run = standard_words(slang, protected)
        return pd.DataFrame([run(t) for t in batch], columns=["text", "slang"])

    letters, changed = _chained(F.coalesce(text, F.lit("")), PLAIN_PROPOSAL | {PROPOSAL_STEPS[-3]: single_letters(protected)})
    if slang:
        small_batches()
        result = replaced(letters)
        words, made = result["text"], result["slang"]
    else:
        words, made = letters, F.array().cast("array<struct<key:string,standard:string>>")
    out = tidy(words)
    return F.struct(out.alias("text"), *changed, (words != letters).alias(PROPOSAL_STEPS[-2]), (out != words).alias(PROPOSAL_STEPS[-1]), made.alias("slang"))


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _nfkc(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


@F.pandas_udf(StringType())
def _fragment_key(text: pd.Series) -> pd.Series:
    return text.map(lambda t: squeeze(_nfkc(t or "").casefold()).rstrip(":").strip())


@F.pandas_udf(StringType())
def _review_key(text: pd.Series) -> pd.Series:
    return text.map(lambda t: squeeze(_nfkc(t or "")).casefold())


def fragment_key(text: Column | str) -> Column:
    """Compatibility form, case folded, squeezed, without trailing colons."""
    small_batches()
    return _fragment_key(text)


def review_key(text: Column | str) -> Column:
    """The key under which equal reviews of two files meet."""
    small_batches()
    return _review_key(text)


class LexicalChain:
    """Spelling, seed phrases, negation and stop words, up to the tokens of a lexicon.

    Dictionaries are looked up before punctuation goes, and so a word with a comma is not found in them.
    """

    def __init__(self, seeds: Iterable[str], negations: Iterable[str], domain: Mapping[str, str] | None = None, public: Mapping[str, str] | None = None, stopwords: Iterable[str] = ()):
        plain = self.plain
        self.negations = frozenset(negations)
        self.words = {plain(k): plain(v) for k, v in (public or {}).items()} | {plain(k): plain(v) for k, v in (domain or {}).items()}
        self.stopwords = frozenset(map(plain, stopwords))
        self.kept = self.negations
        seeds = [plain(s) for s in seeds]
        self.kept = self.negations | {w for s in seeds for w in " ".join(map(self._spelled, s.split())).split()}
        joined = sorted({" ".join(map(self._spelled, s.split())) for s in seeds}, key=lambda s: (-len(s.split()), s))
        self.joined = [(re.compile(rf"(?<!\w){re.escape(s)}(?!\w)"), s.replace(" ", "_")) for s in joined if " " in s]

    @staticmethod
    def plain(text: str) -> str:
        return squeeze(_nfkc(str(text)).lower())

    def _spelled(self, word: str) -> str:
        return word if word in self.kept else self.words.get(word, word)

    def tokens(self, text: str | None) -> list[str]:
        line = " ".join(map(self._spelled, self.plain(text or "").split()))
        for pattern, name in self.joined:
            line = pattern.sub(name, line)
        words = iter(re.sub(r"\d+", " ", re.sub(r"[^\w\s]", " ", line)).split())
        paired = []
        for w in words:
            follower = next(words, None) if w in self.negations else None
            paired.append(w if follower is None else f"{w}_{follower}")
        return [w for w in paired if w not in self.stopwords or w in self.kept or w.split("_")[0] in self.negations and "_" in w]


def lexical_tokens(text: Column, chain: LexicalChain) -> Column:
    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(chain.tokens)

    small_batches()
    return run(text)
