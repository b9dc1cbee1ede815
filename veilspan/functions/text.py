"""Text predicates over scripts, digits, lines and Japanese name shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let, prefix

#: Character ranges, for use inside a character class.
KANJI = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}"
KANJI_MARKS = KANJI + "々〆ヶ"
KATAKANA = r"\x{30A0}-\x{30FF}\x{FF66}-\x{FF9D}"
HIRAGANA = r"\x{3040}-\x{309F}"
JAPANESE = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9D}\x{20000}-\x{3134F}"

#: Honorifics, particles, grammar words and endings, romaji syllables.
HONORIFICS = ("様", "さん", "氏", "くん", "ちゃん")
PARTICLES = "のはがをにでともへや"
GRAMMAR_WORDS = (
    "これ それ あれ どれ ここ そこ あそこ どこ こちら そちら あちら どちら この その あの どの "
    "だれ どなた なに なぜ いつ いくら いかが ありがとう よろしく おねがい すみません おつかれ"
).split()
GRAMMAR_ENDINGS = "でしょうか でしょう ましょう ですか ますか ですね ますね ました ません でした ください くださる います あります だろう".split()
ROMAJI_TOKEN = r"^(?:[aiueo]|(?:ky|gy|sh|sy|zy|jy|ch|cy|ty|dy|ny|hy|by|py|my|ry|ts)[aiueo]|[kgsztdnhbpmrywfjv][aiueo]|n(?![aiueoy])|([kgsztdhbpmrfjc])(?=\1|ch))+$"
WESTERN_WORD = r"^(?:[A-Z][a-z]*(?:['’-]?[A-Z][a-z]+)*|[A-Z][a-z]+(?:['’-][a-z]+)*)$"
STRUCTURE = r"[:：\n\t=、。/|]"

FULL_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
_HONORIFIC = "(?:" + "|".join(HONORIFICS) + ")"


def ascii_digits(c: Column) -> Column:
    """Full-width digits as ASCII ones; the length stays."""
    return F.translate(c, FULL_DIGITS, DIGITS)


def _fold_pairs() -> tuple[str, str]:
    pairs = {}
    for cp in range(0x41, 0x10000):
        c = chr(cp)
        low = c.lower()
        if low != c and len(low) == 1 and not 0xD800 <= cp < 0xE000:
            pairs[c] = low
    pairs |= {chr(0xFF01 + i): chr(0x21 + i).lower() for i in range(94)} | {"　": " "}
    return "".join(pairs), "".join(pairs.values())


def fold(c: Column) -> Column:
    """Case and width folded one to one, so offsets stay. Half-width katakana with
    voicing marks, which would change the length, is left as it is."""
    return F.translate(c, *_fold_pairs())


def has_japanese(c: Column) -> Column:
    return c.rlike(f"[{JAPANESE}]")


def is_kanji(c: Column) -> Column:
    return c.rlike(f"^[{KANJI_MARKS}]+$")


def trimmed(c: Column) -> Column:
    """Without spaces at either end, ideographic ones included."""
    return F.regexp_replace(c, r"^(?U)\s+|\s+$", "")


def without_honorific(c: Column) -> Column:
    return trimmed(F.regexp_replace(trimmed(c), _HONORIFIC + "$", ""))


def followed_by_honorific(context: Column, name: Column) -> Column:
    core = without_honorific(name)
    quoted = F.concat(F.lit("\\Q"), F.replace(core, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(f"\\E[ \u3000]?{_HONORIFIC}"))
    return (core != "") & F.coalesce(F.regexp_like(context, quoted), F.lit(False))


def starts_a_continuation(c: Column) -> Column:
    """A later token begins with a particle: the span ran into the sentence."""
    tokens = F.filter(F.split(c, "[ \u3000]+"), lambda x: x != "")
    return (F.size(tokens) > 1) & F.exists(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t: t.rlike(f"^[{PARTICLES}]"))


def is_grammar(c: Column) -> Column:
    t = trimmed(c)
    return t.isin(*GRAMMAR_WORDS) | t.rlike("(?:" + "|".join(GRAMMAR_ENDINGS) + ")$")


def reads_as_romaji(c: Column) -> Column:
    """Every token that is neither all digits nor one ASCII letter is a run of
    syllables, and there is one."""
    tokens = F.filter(F.split(F.lower(c), "[ ._\\-\u3000]+"), lambda x: (x != "") & ~x.rlike(r"^(?U)\p{N}+$") & ~x.rlike("^[a-z]$"))
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: t.rlike(ROMAJI_TOKEN))


def is_western_name(c: Column) -> Column:
    """One to four capitalised words, each with some lower case."""
    words = F.filter(F.split(c, " +"), lambda x: x != "")
    return F.size(words).between(1, 4) & F.forall(words, lambda w: w.rlike(r"\p{Ll}") & w.rlike(WESTERN_WORD))


def written_script(c: Column) -> Column:
    """kanji, hiragana, katakana or romaji; mixed for several; null for none. The
    text should be NFKC-folded already."""
    tests = (
        ("kanji", f"[{KANJI_MARKS}]"),
        ("hiragana", r"[\x{3041}-\x{3098}\x{309D}-\x{309F}]"),
        ("katakana", r"[\x{30A0}-\x{30F5}\x{30F7}-\x{30FF}]"),
        ("romaji", "[A-Za-z]"),
    )
    found = F.filter(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in tests]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 1, F.lit("mixed")).otherwise(F.get(found, F.lit(0)))


def lines(text: Column) -> Column:
    """(offset, text) of every line."""
    def placed(parts: Column) -> Column:
        before = prefix(F.transform(parts, lambda x: F.char_length(x) + 1), 0, lambda a, b: a + b)
        return F.zip_with(parts, before, lambda x, at: F.struct(at.alias("offset"), x.alias("text")))

    return let(F.split(text, "\n", -1), placed)


def japanese_lines(text: Column) -> Column:
    """(offset, text) of the lines with Japanese."""
    return F.when(has_japanese(text), F.filter(lines(text), lambda x: has_japanese(x["text"]))).otherwise(F.array().cast("array<struct<offset: int, text: string>>"))


def term_list(content: Column) -> Column:
    """Terms of a list: one a line, trimmed, without blanks and # comments."""
    return F.filter(F.transform(F.split(content, "\r?\n"), trimmed), lambda x: (x != "") & ~x.startswith("#"))
