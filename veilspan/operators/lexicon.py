"""Name lists as data, and the checks that look names up in them.

A lexicon is a table (list, surface): surname_kanji, surname_kana, given_kanji, word,
name. It is joined, or, when small, turned into a Names value for a Python worker.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import GRAMMAR_ENDINGS, GRAMMAR_WORDS, HONORIFICS, PARTICLES, ROMAJI_TOKEN, WESTERN_WORD, trimmed

LISTS = ("surname_kanji", "surname_kana", "given_kanji", "word", "name")
#: Entries that a worker may hold (about 100 bytes each); beyond, look names up by join.
MAX_ENTRIES = 2_000_000

_KANJI = re.compile("^[一-鿿㐀-䶿豈-﫿々〆ヶ]+$")
_HAS_KANJI = re.compile("[一-鿿㐀-䶿豈-﫿]")
_HAS_KATAKANA = re.compile("[゠-ヿｦ-ﾝ]")
_HAS_HIRAGANA = re.compile("[぀-ゟ]")
_JAPANESE = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾝ\U00020000-\U0003134f]")
_HONORIFIC_END = re.compile("(?:" + "|".join(HONORIFICS) + ")$")
_AFTER = re.compile("[ 　]?(?:" + "|".join(HONORIFICS) + ")")
_ROMAJI, _WESTERN = re.compile(ROMAJI_TOKEN), re.compile(WESTERN_WORD)
_STRUCTURE = re.compile("[:：\n\t=、。/|]")
_GRAMMAR_END = re.compile("(?:" + "|".join(GRAMMAR_ENDINGS) + ")$")


def has_japanese(text: str) -> bool:
    return bool(_JAPANESE.search(text))


def without_honorific(text: str) -> str:
    return _HONORIFIC_END.sub("", text.strip()).strip()


def reads_as_romaji(text: str) -> bool:
    tokens = [t for t in re.split("[ ._\\-　]+", text.lower()) if t and not t.isnumeric() and not re.fullmatch("[a-z]", t)]
    return bool(tokens) and all(_ROMAJI.match(t) for t in tokens)


def is_western_name(text: str) -> bool:
    words = [w for w in text.split(" ") if w]
    return 1 <= len(words) <= 4 and all(any(c.islower() for c in w) and _WESTERN.match(w) for w in words)


def followed_by_honorific(name: str, context: str) -> bool:
    core, at = without_honorific(name), -1
    if not core:
        return False
    while (at := context.find(core, at + 1)) >= 0:
        if _AFTER.match(context, at + len(core)):
            return True
    return False


def starts_a_continuation(text: str) -> bool:
    return any(t[0] in PARTICLES for t in [t for t in re.split("[ 　]+", text) if t][1:])


def is_grammar(text: str) -> bool:
    return text.strip() in GRAMMAR_WORDS or bool(_GRAMMAR_END.search(text.strip()))


@dataclass
class Names:
    """Name lists in a worker, and the checks over them. ``is_person`` judges Latin
    names of Western shape; without one they pass by shape alone."""

    surname_kanji: set[str] = field(default_factory=set)
    surname_kana: set[str] = field(default_factory=set)
    given_kanji: set[str] = field(default_factory=set)
    word: set[str] = field(default_factory=set)
    name: set[str] = field(default_factory=set)
    is_person: object = None

    def begins_with_surname(self, text: str) -> bool:
        t = text.strip()
        if any(t[:k] in self.surname_kanji for k in range(min(3, len(t)), 0, -1)):
            return True
        return bool(t) and (t.split(" ")[0] in self.surname_kana or t in self.surname_kana)

    def ends_with_given(self, text: str) -> bool:
        t = re.sub("[ 　]", "", without_honorific(text))
        return len(t) >= 3 and bool(_KANJI.match(t)) and any(t[k:] in self.given_kanji for k in range(1, min(5, len(t) - 2) + 1))

    def latin(self, text: str) -> bool:
        t = unicodedata.normalize("NFKC", text)
        return reads_as_romaji(t) or (is_western_name(t) and (self.is_person is None or bool(self.is_person(t))))

    def shaped(self, text: str) -> bool:
        kanji, katakana = bool(_HAS_KANJI.search(text)), bool(_HAS_KATAKANA.search(text))
        if kanji and katakana:
            return False
        if kanji or katakana:
            return self.begins_with_surname(text) or self.ends_with_given(text)
        if _HAS_HIRAGANA.search(text):
            return not is_grammar(text)
        return self.latin(text)

    def plausible_answer(self, text: str, context: str = "") -> bool:
        """Whether a model's answer may be a name."""
        if not text or len(text) > 24 or not without_honorific(text) or _STRUCTURE.search(text) or "を" in text:
            return False
        if not any(c.isalpha() for c in text) or starts_a_continuation(text):
            return False
        return self.shaped(text) or followed_by_honorific(text, context)

    def plausible_span(self, text: str) -> bool:
        """Whether a tagged span may be a name."""
        folded = unicodedata.normalize("NFKC", text)
        if not any(unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo") for c in folded):
            return False
        if len(folded) == 1 and self.word and folded not in self.name:
            return False
        if folded in self.word and folded not in self.name:
            return False
        if len(text) == 1 and ("぀" <= text <= "ヿ" or "ｦ" <= text <= "ﾝ"):
            return False
        return not (len(text) > 1 and all("A" <= c <= "Z" for c in text))

    def parts(self, name: str) -> tuple[str, str] | None:
        """Family and given part: at a space, else by the lists."""
        core = without_honorific(name)
        spaced = [t for t in re.split("[ 　]+", core) if t]
        if len(spaced) >= 2:
            return spaced[0], spaced[-1]
        if len(core) < 3 or not _KANJI.match(core):
            return None
        cuts = [(core[:k], core[k:]) for k in range(1, min(5, len(core) - 1) + 1)]
        both = [c for c in cuts if c[0] in self.surname_kanji and c[1] in self.given_kanji]
        given = [c for c in cuts if c[1] in self.given_kanji]
        family = [c for c in reversed(cuts) if 2 <= len(c[0]) <= 3 and c[0] in self.surname_kanji]
        return next(iter(both + given + family), None)

    def mentions(self, found: list[tuple[int, int, str]], text: str) -> list[tuple[int, int, str]]:
        """Further places of the family and given parts of found names (start, end,
        text) that stand alone or before an honorific."""
        covered = sorted((s, e) for s, e, _ in found)
        out, seen = [], set()
        for _, _, name in found:
            split = self.parts(name)
            if not split:
                continue
            for part in (split[0], *([split[1]] if len(split[1]) >= 2 else [])):
                if part in seen:
                    continue
                seen.add(part)
                at = text.find(part)
                while at >= 0:
                    stop = at + len(part)
                    alone = not (at and _KANJI.match(text[at - 1])) and not (stop < len(text) and _KANJI.match(text[stop]))
                    if not _inside(covered, at, stop) and (alone or _AFTER.match(text, stop)):
                        covered.append((at, stop))
                        out.append((at, stop, part))
                    at = text.find(part, stop)
        return out


def _inside(covered: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether every place of the range is covered by the union of ranges."""
    at = start
    for s, e in sorted(covered):
        if s <= at < e:
            at = e
    return at >= end


def collect_names(lexicon: DataFrame, is_person: object = None) -> Names:
    """A lexicon as a worker's value; its size is checked first."""
    n = lexicon.count()
    if n > MAX_ENTRIES:
        raise ValueError(f"{n} entries are too many for a worker: join the lexicon instead")
    out = Names(is_person=is_person)
    for r in lexicon.collect():
        getattr(out, r["list"]).add(r["surface"])
    return out


def surname_listed(names: DataFrame, lexicon: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``listed``: the name begins with a listed surname. By join, for lists of
    any size: prefixes of up to three characters, and whole katakana tokens."""
    t = trimmed(F.col(text_col))
    tries = F.array(
        *[F.when(F.char_length(t) >= k, F.struct(F.lit("surname_kanji").alias("list"), F.substring(t, 1, k).alias("surface"))) for k in (3, 2, 1)],
        F.struct(F.lit("surname_kana").alias("list"), F.split(t, " ")[0].alias("surface")), F.struct(F.lit("surname_kana").alias("list"), t.alias("surface")),
    )
    keyed = names.select(text_col).distinct().select(text_col, F.explode(F.filter(tries, lambda x: x.isNotNull())).alias("x")).select(text_col, "x.list", "x.surface")
    hits = keyed.join(lexicon, ["list", "surface"], "left_semi").select(F.col(text_col).alias("__hit")).distinct()
    joined = names.join(hits, F.col(text_col) == F.col("__hit"), "left")
    return joined.withColumn("listed", F.col("__hit").isNotNull()).drop("__hit")
