"""Jobs that prepare name lists, splits and training rows.

A lexicon source is (surface, cost, pos1..pos4, reading), as sources.files reads it.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import FULL_DIGITS, is_kanji

#: Parts of speech of the lexicon, and the share of samples for dev.
PERSON, FAMILY, GIVEN = ("名詞", "固有名詞", "人名"), "姓", "名"
COMMON_NOUN = ("名詞", "普通名詞")
WORD_CLASSES = ("名詞", "代名詞", "接頭辞", "接尾辞")
DEV_SHARE = 0.37


def _pos(*values: str) -> Column:
    out = F.lit(True)
    for i, v in enumerate(values, 1):
        out = out & (F.col(f"pos{i}") == v)
    return out


def surnames(lexicon: DataFrame) -> DataFrame:
    """(list, surface): kanji family names of 2 or 3 kanji, and all katakana readings."""
    family = lexicon.where(_pos(*PERSON, FAMILY))
    kanji = family.where(is_kanji(F.col("surface")) & F.char_length("surface").between(2, 3)).select(F.lit("surname_kanji").alias("list"), "surface")
    kana = family.where(F.col("reading").rlike("^[ァ-ヺー]+$")).select(F.lit("surname_kana").alias("list"), F.col("reading").alias("surface"))
    return kanji.unionByName(kana).distinct()


def given_names(lexicon: DataFrame) -> DataFrame:
    """(list, surface): given names of 2 or more kanji."""
    return lexicon.where(_pos(*PERSON, GIVEN) & is_kanji(F.col("surface")) & (F.char_length("surface") >= 2)).select(F.lit("given_kanji").alias("list"), "surface").distinct()


def words_and_names(lexicon: DataFrame) -> DataFrame:
    """(list, surface): person names, and the words that are no person names."""
    names = lexicon.where(_pos(*PERSON)).select("surface").distinct()
    words = lexicon.where(F.col("pos1").isin(*WORD_CLASSES)).select("surface").distinct().join(names, "surface", "left_anti")
    return names.select(F.lit("name").alias("list"), "surface").unionByName(words.select(F.lit("word").alias("list"), "surface"))


def cost_quartiles(lexicon: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """(surface, cost, quartile): n names of each quartile of their least cost, picked
    by a seeded hash, so that a run repeats on any cluster. The quartile bounds are
    exact percentiles, so no window gathers the table."""
    least = lexicon.where(_pos(*PERSON, FAMILY)).groupBy("surface").agg(F.min("cost").alias("cost"))
    q = least.agg(F.percentile("cost", [0.25, 0.5, 0.75]).alias("q"))
    cut = least.join(F.broadcast(q), F.lit(True)).select("surface", "cost", (1 + sum((F.col("cost") > F.col("q")[i]).cast("int") for i in range(3))).alias("quartile"))
    rank = F.row_number().over(Window.partitionBy("quartile").orderBy(F.xxhash64("surface", F.lit(seed)), "surface"))
    return cut.withColumn("r", rank).where(F.col("r") <= n).drop("r")


def side(id_col: Column) -> Column:
    """dev or test, by the first 32 bits of the id's SHA-256."""
    share = F.conv(F.substring(F.sha2(id_col.cast("string"), 256), 1, 8), 16, 10).cast("long") / F.lit(0xFFFFFFFF)
    return F.when(share < DEV_SHARE, "dev").otherwise("test")


def held_out_names(names: DataFrame, column: str = "text") -> DataFrame:
    """Names and their parts."""
    parts = names.select(F.explode(F.concat(F.array(column), F.split(column, r"[\s　・._\-]+"))).alias("surface"))
    return parts.where("surface <> ''").distinct()


def union_detections(parts: list[DataFrame]) -> DataFrame:
    """(id, names): all detections (id, text, location, length) of several files."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("location", "length", "text"))).alias("names"))


def name_pools(lexicon: DataFrame, held: DataFrame) -> DataFrame:
    """(pool, surface): family, given and noun pools without held-out names; nouns
    also without anything that is a name."""
    family = lexicon.where(_pos(*PERSON, FAMILY)).select("surface").distinct()
    given = lexicon.where(_pos(*PERSON, GIVEN)).select("surface").distinct()
    noun = lexicon.where(_pos(*COMMON_NOUN)).select("surface").distinct().join(family.unionByName(given), "surface", "left_anti")
    out = None
    for pool, df in (("family", family), ("given", given), ("noun", noun)):
        df = df.join(held, "surface", "left_anti").select(F.lit(pool).alias("pool"), "surface")
        out = df if out is None else out.unionByName(df)
    return out


#: Templates of our own: {p} a person, {n} a noun, {d} digits.
TEMPLATES = (
    "担当: {p}", "{p} 様よりお問い合わせ（{d}）", "{n}の確認をお願いします。", "user={p} status={d}", "{p}さんと{p}さんに共有済み。",
    "{n}を更新しました。", "[{d}] {n}: OK", "- {p}：{n}を担当", "本日の{n}は中止です。", "From: {p}\n件名: {n}", "{n} {d} 件",
)
#: Forms of a person and their weights: family+given, spaced, family alone, given alone.
FORMS = (("{f}{g}", 4), ("{f} {g}", 3), ("{f}", 2), ("{g}", 1))


#: Entries that a numbering group has on average.
BUCKET_ENTRIES = 4096


def numbered_pools(pools: DataFrame, sizes: dict[str, int], bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """(pool, nth, surface): entries of each pool from 0, in the order of a hash."""
    buckets = F.create_map(*[F.lit(x) for pool, n in sizes.items() for x in (pool, max(1, -(-n // bucket_entries)))])
    keyed = pools.select("pool", "surface", F.xxhash64("surface").alias("h")).withColumn("bucket", F.pmod("h", buckets[F.col("pool")]))
    counts = keyed.groupBy("pool", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("pool").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pool", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("pool", "bucket").orderBy("h", "surface")) - 1
    return keyed.withColumn("rn", rank).join(offsets, ["pool", "bucket"]).select("pool", (F.col("offset") + F.col("rn")).alias("nth"), "surface")


def generate(spark: SparkSession, pools: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(id, text, spans) of n rows, in the order of id, with gold spans in code points.
    A row depends on its number, the seed and the pools only, so any partitioning gives
    the same rows. Workers draw numbers of entries, and a join brings the entries: pools
    of any size are used in full. A pool without entries is an error."""
    sizes = {r["pool"]: r["n"] for r in pools.groupBy("pool").agg(F.count(F.lit(1)).alias("n")).collect()}
    missing = [p for p in ("family", "given", "noun") if not sizes.get(p)]
    if missing:
        raise ValueError(f"no entries in the pools: {', '.join(missing)}")

    def row(i: int) -> list[tuple[int, int, int, str | None, int | None, str | None]]:
        """(id, place, number of the person or -1, pool, nth, literal) of each piece."""
        rng = random.Random(seed * 1_000_003 + i)
        out, rest, persons = [], rng.choice(TEMPLATES), 0

        def put(person: int, pool: str | None, nth: int | None, literal: str | None) -> None:
            out.append((i, len(out), person, pool, nth, literal))

        while rest:
            cut = min((rest.find(k) for k in ("{p}", "{n}", "{d}") if k in rest), default=-1)
            if cut < 0:
                put(-1, None, None, rest)
                break
            put(-1, None, None, rest[:cut])
            slot, rest = rest[cut : cut + 3], rest[cut + 3 :]
            if slot == "{p}":
                form = rng.choices([f for f, _ in FORMS], [w for _, w in FORMS])[0]
                for part in re.split(r"(\{f\}|\{g\})", form):
                    pool = {"{f}": "family", "{g}": "given"}.get(part)
                    put(persons, pool, rng.randrange(sizes[pool]) if pool else None, None if pool else part)
                persons += 1
            elif slot == "{n}":
                put(-1, "noun", rng.randrange(sizes["noun"]), None)
            else:
                put(-1, None, None, str(rng.randrange(10_000)))
        return out

    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string())

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [piece for i in batch.column(0).to_pylist() for piece in row(i)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pieces], t) for k, t in enumerate(kinds)], ["id", "place", "person", "pool", "nth", "literal"])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for pieces in batch.column(1).to_pylist():
                text, own = "", {}
                for x in pieces:
                    start, text = len(text), text + x["value"]
                    if x["person"] >= 0:
                        own[x["person"]] = [own.get(x["person"], [start])[0], len(text)]
                texts.append(text)
                spans.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32())))], ["id", "text", "spans"])

    pieces = spark.range(n).mapInArrow(draw, "id long, place int, person int, pool string, nth long, literal string")
    filled = pieces.join(numbered_pools(pools, sizes), ["pool", "nth"], "left").select("id", F.struct("place", "person", F.coalesce("surface", "literal").alias("value")).alias("piece"))
    rows = filled.groupBy("id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return rows.mapInArrow(put_together, "id long, text string, spans array<array<int>>").orderBy("id")


def leaks(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Gold names of training rows that are held out, whole or in a part; must be empty."""
    gold = rows.select(F.explode(F.transform("spans", lambda s: F.substring("text", s[0] + 1, s[1] - s[0]))).alias("surface")).distinct()
    parts = gold.select("surface", F.explode(F.concat(F.array("surface"), F.split("surface", r"[\s　・._\-]+"))).alias("part")).where("part <> ''")
    out = held.select(F.lower("surface").alias("part")).distinct()
    return parts.withColumn("part", F.lower("part")).join(out, "part", "left_semi").select("surface").distinct()


def bad_bounds(rows: DataFrame) -> DataFrame:
    """Rows with a span outside their text; must be empty."""
    return rows.where(F.exists("spans", lambda s: (s[0] < 0) | (s[1] <= s[0]) | (s[1] > F.char_length("text"))))


def empty_share(rows: DataFrame) -> DataFrame:
    """One row: the share of rows without a span."""
    return rows.agg(F.avg((F.size("spans") == 0).cast("double")).alias("share"))


# Transliteration, 1:1 maps by rule.
_KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
_HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))


def hiragana(c: Column) -> Column:
    return F.translate(c, _KATAKANA, _HIRAGANA)


def half_width_digits(c: Column) -> Column:
    return F.translate(c, FULL_DIGITS, "0123456789")


#: Consonants of the kana rows, in the order of the syllabary.
_VOWELS = "aiueo"
_ROWS = {"カ": "k", "サ": "s", "タ": "t", "ナ": "n", "ハ": "h", "マ": "m", "ラ": "r"}
_ODD = {"シ": "shi", "チ": "chi", "ツ": "tsu", "フ": "fu", "ジ": "ji", "ヂ": "ji", "ヅ": "zu", "ヤ": "ya", "ユ": "yu", "ヨ": "yo", "ワ": "wa", "ヲ": "o", "ン": "n"}


def _syllables() -> dict[str, str]:
    out = {}
    for row, k in (("アイウエオ", ""), ("カキクケコ", "k"), ("ガギグゲゴ", "g"), ("サシスセソ", "s"), ("ザジズゼゾ", "z"), ("タチツテト", "t"), ("ダヂヅデド", "d"), ("ナニヌネノ", "n"), ("ハヒフヘホ", "h"), ("バビブベボ", "b"), ("パピプペポ", "p"), ("マミムメモ", "m"), ("ラリルレロ", "r")):
        out |= {c: k + v for c, v in zip(row, _VOWELS)}
    return out | _ODD


def romaji(kana: str) -> str:
    """Katakana as romaji: contracted sounds and doubled consonants included, long
    marks dropped."""
    table, out, double = _syllables(), "", False
    for c in kana:
        if c == "ッ":
            double = True
        elif c in "ャュョ" and out.endswith("i"):
            small = {"ャ": "a", "ュ": "u", "ョ": "o"}[c]
            out = out[:-1] + (small if out[:-1].endswith(("sh", "ch", "j")) else "y" + small)
        elif c in table:
            s = table[c]
            out += (("t" if s.startswith("ch") else s[0]) if double and s[0] not in _VOWELS else "") + s
            double = False
    return out
