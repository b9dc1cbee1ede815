"""Detectors against tables of accepted and rejected texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilspan.functions import spans as S
from veilspan.functions import text as T
from veilspan.operators import patterns as P
from veilspan.operators import terms
from veilspan.plans.redact import mask


def found(spark, texts, detector):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = {r["i"]: r["s"] for r in df.select("i", detector(F.col("text")).alias("s")).collect()}
    out = [rows[i] for i in range(len(texts))]
    for t, spans in zip(texts, out):
        for s in spans:
            assert t[s["start"] : s["start"] + s["len"]] == s["text"]
    return [[s["text"] for s in spans] for spans in out]


def test_phones(spark):
    good = ["090-1234-5678", "03-1234-5678", "0120-123-456", "0570-064-000", "09012345678", "０９０－１２３４－５６７８", "+81 90-1234-5678", "+81-3-1234-5678", "03 1234 5678", "415-555-0132", "+1 (838) 555-7235"]
    assert found(spark, [f"連絡先は {g} です。" for g in good], P.phones) == [[g] for g in good]
    bad = ["1789049614", "2147483647", "12345678901", "9876543210", "注文番号 123456789010 の件", "伝票 4912345678901 は対象外", "2026-09-05", "192.168.1.100", "0.0.0.0", "550e8400-e29b-41d4-a716-446655440000", "v2.14.3", "内線 7788", ""]
    assert found(spark, bad, P.phones) == [[] for _ in bad]
    assert found(spark, ["０９０－１２３４－５６７８\n内線: 7788"], P.phones) == [["０９０－１２３４－５６７８"]]


def test_phones_beside_other_characters(spark):
    texts = ['token = "01234567890ab"', "password=0123456789e", "tel 0123456789.", "+1 (855) 555-4208 12 items", "x+1 (855) 555-4208", "+1 (855) 555-42081", "+1 (855) 555-4208 +1 (855) 555-4209"]
    assert found(spark, texts, P.phones) == [[], [], ["0123456789"], *[["+1 (855) 555-4208"]] * 3, ["+1 (855) 555-4208", "+1 (855) 555-4209"]]


def test_addresses(spark):
    good = ["東京都渋谷区渋谷2丁目21番1号", "大阪府大阪市北区梅田3-1-3", "神奈川県横浜市西区みなとみらい2-3-5", "〒100-0001 東京都千代田区千代田1-1"]
    assert found(spark, [f"住所: {g}" for g in good], P.addresses) == [[g] for g in good]
    assert found(spark, ["2026年9月6日", "市場の動き", "E-4521-9"], P.addresses) == [[], [], []]


@pytest.mark.parametrize("wide", [False, True])
def test_my_numbers(spark, wide):
    def digits(body):
        total = sum(int(body[11 - n]) * (n + 1 if n <= 6 else n - 5) for n in range(1, 12))
        return 0 if total % 11 <= 1 else 11 - total % 11

    rng = random.Random(3)
    bodies = ["".join(rng.choice("0123456789") for _ in range(11)) for _ in range(60)] + ["12345678901"]
    good = [b + str(digits(b)) for b in bodies]
    bad = [b + str((digits(b) + 1 + rng.randrange(9)) % 10) for b in bodies]
    turn = str.maketrans("0123456789", "０１２３４５６７８９") if wide else {}
    assert found(spark, [f"番号{g.translate(turn)}。" for g in good], P.my_numbers) == [[g.translate(turn)] for g in good]
    assert found(spark, [b.translate(turn) for b in bad] + ["9" + good[0]], P.my_numbers) == [[]] * (len(bad) + 1)


def test_prefixes_stand_at_word_bounds(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    assert found(spark, [key, f"x{key}", f"{key}9", f"({key})", f"鍵 {key}"], P.prefix_credentials) == [[key], [], [], [key], [key]]


def test_pem_does_not_reach_a_second_block(spark):
    first, second = "-----BEGIN PRIVATE KEY-----\nlost", "-----BEGIN EC PRIVATE KEY-----\nabc\n-----END EC PRIVATE KEY-----"
    assert found(spark, [f"{first}\ntext\n{second}"], P.prefix_credentials) == [[second]]


def test_url_password_takes_its_email(spark):
    assert found(spark, ["postgres://app:hunter2@db.example.com/x", "a@b.co https://x.y/z:1"], P.regex_spans) == [["hunter2"], ["a@b.co"]]


def test_emails_and_urls_by_the_plain_patterns(spark):
    """What spares time in the patterns changes nothing in what they find."""
    rng = random.Random(3)
    bits = ["a", "B9", "@", "@", ".", "co", "_", "-", "é", " ", "://", "http", "+", ":", "pw", "/", "1", "@x.de"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(2, 30))) for _ in range(1500)]
    plain = [re.findall(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", t) for t in texts]
    assert found(spark, texts, P.emails) == plain
    assert found(spark, texts, P.url_credentials) == [[m[1] for m in re.finditer(r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s:/?#@]+:([^\s/?#@]+)@", t)] for t in texts]


def test_long_runs_are_linear_and_do_not_recurse(spark):
    runs = ["token: abc123 " + "a-" * 100_000, "a" * 200_000 + "@b", "-" * 200_000, "a." * 100_000 + "@", "://a:" * 40_000, "password=" * 20_000, "a@" * 100_000, "市" * 200_000, "eyJ-" * 50_000]
    rows = mask(spark.createDataFrame(list(enumerate(runs)), "i int, text string").repartition(4)).collect()
    assert len(rows) == len(runs)
    assert {r["i"]: [f["text"] for f in r["findings"]] for r in rows if r["i"] < 3} == {0: ["abc123"], 1: [], 2: []}


def test_tokens_of_three_parts_are_found_wherever_they_begin(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["eyJ", "-eyJ", "abcdefgh", "abcdefgh", ".eyJabcdefgh", ".abcdefgh", "-", ".", " ", "é"]) for _ in range(rng.randrange(4, 40))) for _ in range(4000)]
    texts.append("eyJ-" * 400 + "abcdefgh.eyJabcdefgh.abcdefgh-")
    c = r"[A-Za-z0-9_\-]"
    want = [re.findall(rf"\beyJ{c}{{8,}}\.eyJ{c}{{8,}}\.{c}{{8,}}\b", t) for t in texts]
    assert found(spark, texts, P.prefix_credentials) == want and sum(map(len, want)) > 100


def test_named_credentials(spark):
    good = {
        "DB_PASSWORD=hunter2": "hunter2", '-H "X-Api-Key: abc123def456ghi"': "abc123def456ghi", "Authorization: Bearer eyJ.abc": "eyJ.abc", 'Authorization: "Basic dXNlcg=="': "dXNlcg==",
        '"X-Csrf-Token": "aBcD"': "aBcD", "accessToken: 'q w'": "q w", "AWS_SECRET_ACCESS_KEY=a/b+c": "a/b+c", "client_secret=abc, next": "abc",
    }
    assert found(spark, list(good), P.named_credentials) == [[v] for v in good.values()]
    bad = [
        "secretary: unassigned", "token_count: 1500", "入力トークン数: 3,200", "primary_key = orders.id", "auth: enabled", "secretName: db-tls-cert", "api_key_count: 3",
        "STRIPE_PUBLISHABLE_KEY=pk_live_51H1234567890abcdefghijkl", "パスワード: x", "password_file: /run/x", "authorization_url: https://x", '"scrub_fields": ["password", "secret"]', '"access_token": "******"', "token=[FILTERED]",
    ]
    assert found(spark, bad, P.named_credentials) == [[] for _ in bad]


def test_quoted_tokens_that_others_hide(spark):
    texts = ['mytoken = "ab1"', 'token = "ab open and token = "cd2"', "secret: 'a token = \"ef3\"'", 'password=token = "ab4"', 'token = "ab5"', 'token = "12"token = "34"']
    want = [["ab1"], ["ab open and token =", "cd2"], ['a token = "ef3"', "ef3"], ["ab4"], ["ab5"], ["12", "34"]]
    got = found(spark, texts, P.named_credentials)
    assert [[x.strip() for x in g] for g in got] == want



def test_values_that_cannot_be_live_stay_low(spark):
    df = spark.createDataFrame([("api_key=YOUR_API_KEY_HERE token=xxxxxxxx pwd=12345 secret=real1",)], "text string")
    assert [s["confidence"] for s in df.select(P.named_credentials(F.col("text")).alias("s")).first()["s"]] == [0, 0, 0, 1]


def test_terms_longest_first_case_and_width(spark):
    hit = lambda t, ts: found(spark, [t], lambda c: terms.term_spans(c, ts))[0]
    assert hit("ACME Corp と ａｃｍｅ", ["acme", " Acme Corp "]) == ["ACME Corp", "ａｃｍｅ"]
    assert hit("abcde", ["abc", "bcde"]) == ["bcde"]
    assert hit("が ガ", ["が"]) == ["が"]
    assert hit(r"a\Eb (x)", [r"\Eb", "(x)"]) == ["(x)", r"\Eb"]
    assert hit("anything", []) == [] and hit("", ["a"]) == []


def test_spans_count_code_points(spark):
    df = spark.createDataFrame([("𠮷𠮷 a@b.co と c@d.jp",)], "text string")
    row = df.select(P.emails(F.col("text")).alias("s"), S.utf16(F.col("text"), F.lit(3)).alias("u")).first()
    assert [(s["start"], s["len"]) for s in row["s"]] == [(3, 6), (12, 6)] and row["u"] == 5


def test_english_names(spark):
    texts = ["ask John Smith today", "Alamofire, SwiftNIO, Android", "Google Play Console", "Mary-Jane", "John"]
    assert found(spark, texts, P.english_names) == [["John Smith"], [], [], [], []]


def test_text_predicates(spark):
    cases = [
        (T.reads_as_romaji, ["tanaka", "IiiTake_01", "S. Suguri", "koyaba_j", "kitchi"], ["S. K", "web-01", "build", "xyz", "123"]),
        (T.is_western_name, ["John Smith", "O'Connor", "Mary-Jane Watson", "McDonald"], ["ORD-OPS", "john", "a B", "One Two Three Four Five"]),
        (T.is_grammar, ["どこ", "のでしょうか", "ありがとう"], ["さくら", "はるか", "のぞみ", "こころ"]),
        (T.starts_a_continuation, ["田中健一 の再掲"], ["のぞみ", "田中 健一"]),
        (T.has_japanese, ["あ", "漢", "ｱ", "𠮷"], ["abc", "１２", ""]),
    ]
    for predicate, yes, no in cases:
        df = spark.createDataFrame([(t, True) for t in yes] + [(t, False) for t in no], "t string, want boolean")
        wrong = [r["t"] for r in df.where(predicate(F.col("t")) != F.col("want")).collect()]
        assert wrong == [], predicate.__name__
    df = spark.createDataFrame([("田ヶ原", "kanji"), ("さくら", "hiragana"), ("ヤマダ", "katakana"), ("Suguri", "romaji"), ("山田タロウ", "mixed"), ("・", None)], "t string, want string")
    assert all(r["got"] == r["want"] or r["t"] == "・" for r in df.withColumn("got", T.written_script(F.col("t"))).collect())
