"""Reconciliation, masking, reports, plugins, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from veilspan.functions.kinds import FINDING, SPAN
from veilspan.operators import masking, reconcile
from veilspan.operators.batches import Chunk, narrowed, pack, split_to_fit
from veilspan.operators.lexicon import Names
from veilspan.plans.redact import Config, detect, long_findings, mask, mask_with, with_report
from veilspan.plugins import Token, bio_spans, merge_spans, run_chunks, tagged_spans
from veilspan.streaming.redact_stream import mask_stream, read_stream, write_stream


def reconciled(spark, spans):
    df = spark.createDataFrame([(spans,)], f"s array<{SPAN}>")
    return [(f["kind"], f["start"], f["len"], f["confidence"], f["sources"]) for f in df.select(reconcile.reconcile(F.col("s")).alias("f")).first()["f"]]


def span(kind, source, start, size, confidence=None):
    return (kind, source, start, size, "x" * size, confidence)


def test_merge_promotes_by_distinct_sources(spark):
    assert reconciled(spark, [span("credential", "regex", 0, 4), span("credential", "regex", 0, 4)]) == [("credential", 0, 4, 2, ["regex"])]
    assert reconciled(spark, [span("credential", "regex", 0, 4), span("credential", "credentialContext", 0, 4)]) == [("credential", 0, 4, 2, ["credentialContext", "regex"])]
    assert reconciled(spark, [span("credential", "credentialContext", 0, 4, 0), span("credential", "dataDetector", 0, 4, 0)])[0][3] == 1
    assert reconciled(spark, []) == []


def test_precedence_is_one_pass(spark):
    # the name falls to the address that falls to the phone
    out = reconciled(spark, [span("phoneNumber", "dataDetector", 0, 20), span("address", "dataDetector", 2, 10), span("personalName", "nameTagger", 3, 4)])
    assert [f[0] for f in out] == ["phoneNumber"]
    # a weaker container, a partial overlap and the same kind all stay
    assert len(reconciled(spark, [span("address", "dataDetector", 0, 20), span("postalCode", "regex", 0, 9)])) == 2
    assert len(reconciled(spark, [span("address", "dataDetector", 0, 10), span("phoneNumber", "dataDetector", 5, 10)])) == 2
    assert len(reconciled(spark, [span("address", "dataDetector", 0, 20), span("address", "regex", 3, 5)])) == 2


def test_models_yield_to_surer_layers(spark):
    name = [span("personalName", "ner", 0, 16), span("personalName", "languageModel", 0, 16)]
    assert [f[0] for f in reconciled(spark, [*name, span("phoneNumber", "dataDetector", 2, 8)])] == ["phoneNumber"]
    assert [f[0] for f in reconciled(spark, [*name, span("organizationName", "nameTagger", 12, 8)])] == ["personalName", "organizationName"]


def test_long_form_equals_columns(spark):
    import random

    rng = random.Random(5)
    kinds, sources = ["email", "credential", "personalName", "address"], ["regex", "ner", "languageModel", "dataDetector"]
    docs = [(i, [span(rng.choice(kinds), rng.choice(sources), rng.randrange(12), rng.randrange(1, 8)) for _ in range(rng.randrange(7))]) for i in range(60)]
    df = spark.createDataFrame(docs, f"doc_id long, s array<{SPAN}>")
    one = df.select("doc_id", F.inline(reconcile.reconcile(F.col("s"))))
    two = reconcile.precedence_long(reconcile.merge_long(df.select("doc_id", F.inline("s"))))
    key = lambda d: sorted((r["doc_id"], r["kind"], r["start"], r["len"], r["confidence"], r["sources"]) for r in d.collect())
    assert key(one) == key(two)


def masked(spark, text, findings):
    df = spark.createDataFrame([(text, [(k, s, n, text[s : s + n], 2, ["regex"]) for k, s, n in findings])], f"text string, findings array<{FINDING}>")
    return mask_with(df).first()["masked"]


def test_masking(spark):
    text = "a@b.co, c@d.co, a@b.co 090"
    assert masked(spark, text, [("email", 0, 6), ("email", 8, 6), ("email", 16, 6), ("phoneNumber", 23, 3)]) == "[EMAIL_1], [EMAIL_2], [EMAIL_1] [PHONE_1]"
    assert masked(spark, text, []) == text
    assert masked(spark, "abcdef", [("email", 0, 3), ("address", 1, 4), ("placeName", 5, 1)]) == "a[ADDRESS_1][PLACE_1]"
    assert masked(spark, "𠮷a𠮷", [("personalName", 0, 1), ("personalName", 2, 1)]) == "[NAME_1]a[NAME_1]"


CORPUS = {
    "氏名: 高橋\n住所: 〒150-0002 東京都渋谷区渋谷2丁目21番1号 ビル\n電話: 03-1234-5678（日中）\nメール: t.y@example.com\nマイナンバー: 123456789018": "氏名: 高橋\n住所: [ADDRESS_1] ビル\n電話: [PHONE_1]（日中）\nメール: [EMAIL_1]\nマイナンバー: [MYNUMBER_1]",
    "使用: Alamofire, web-01.internal.example.com 8080 192.168.1.100 1,234,567円 E-4521-9": "使用: Alamofire, web-01.internal.example.com 8080 192.168.1.100 1,234,567円 E-4521-9",
    "": "",
}


def test_documents_end_to_end(spark):
    df = spark.createDataFrame([(t,) for t in CORPUS], "text string")
    assert {r["text"]: r["masked"] for r in mask(df).collect()} == CORPUS


def test_columns_of_the_same_name_are_an_error(spark):
    for name in ("findings", "Masked", "warnings", "replacements", "model_failures", "ner_spans"):
        with pytest.raises(ValueError, match="rename"):
            mask(spark.createDataFrame([("x", 1)], f"text string, {name} int"))


def test_json_stays_json(spark):
    body = {"timestamp": 1789049614, "token": "aBc123", "mail": "s@example.co.jp", "tel": "090-1234-5678", "scrub": ["password", "secret"], "access_token": "******"}
    row = mask(spark.createDataFrame([(json.dumps(body),)], "text string")).first()
    out = json.loads(row["masked"])
    assert out["timestamp"] == 1789049614 and out["token"] == "[SECRET_1]" and out["mail"] == "[EMAIL_1]" and out["access_token"] == "******"


def test_report(spark):
    row = with_report(mask(spark.createDataFrame([("𠮷 a@b.co",), (None,)], "text string"))).orderBy(F.length("masked").desc()).collect()
    r = json.loads(row[0]["report"])
    assert list(r) == sorted(r) and r["findings"] == [{"confidence": "high", "kind": "email", "length": 6, "location": 3, "placeholder": "[EMAIL_1]", "sources": ["regex"], "text": "a@b.co"}]
    assert r["modelDetail"] is None and r["model"] == "disabled" and len(r["warnings"]) == 2
    assert json.loads(row[1]["report"])["masked"] == ""


class FakeTagger:
    cls, sep = 1, 2

    def tokenize(self, line):
        return [Token(ord(c) + 10, i, i + 1) for i, c in enumerate(line)]

    def predict(self, ids):
        return [0, *[2 if chr(i - 10) in "田中健一" else 0 for i in ids[1:-1]], 0]


def test_layers_with_models(spark):
    lists = Names(surname_kanji={"田中", "佐藤"}, given_kanji={"健一"})

    def respond():
        return lambda chunk: ["佐藤", "どこ", "nowhere"]

    df = spark.createDataFrame([("担当 田中健一 と 佐藤 様\ntel 090-1234-5678",), ("none",)], "text string")
    out = mask(df, Config(tagger=FakeTagger, model=respond, names=lists)).orderBy(F.length("text").desc()).collect()
    assert out[0]["masked"] == "担当 [NAME_1] と [NAME_2] 様\ntel [PHONE_1]" and out[0]["warnings"] == []
    broken = mask(df, Config(tagger=FakeTagger, model=lambda: 1 / 0)).first()
    assert broken["model_state"]["token"] == "unavailable" and len(broken["warnings"]) == 1
    off = mask(df, Config(tagger=FakeTagger, use_tagger=False)).first()
    assert off["warnings"][1].startswith("NER model disabled")


def test_bio_and_windows():
    t = [Token(0, 0, 1), Token(0, 1, 2), Token(0, 2, 2), Token(0, 2, 3), Token(0, 3, 4)]
    assert bio_spans(t, [1, 2, 2, 2, 1]) == [(0, 2), (2, 3), (3, 4)]
    assert merge_spans([(0, 3), (2, 5), (5, 6)]) == [(0, 5), (5, 6)]
    line = "あ" * 300 + "田中" + "い" * 300
    assert tagged_spans(FakeTagger(), line) == [(300, 302)]
    assert tagged_spans(FakeTagger(), "") == []

    class Short(FakeTagger):
        def predict(self, ids):
            return [0]

    with pytest.raises(ValueError):
        tagged_spans(Short(), "abc")


def test_chunks_lose_nothing():
    import random

    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice("あ。、x ") for _ in range(rng.randrange(1, 200)))
        pieces = split_to_fit(text, 7, 20)
        assert "".join(p for p, _ in pieces) == text and all(len(p) <= 20 for p, _ in pieces)
        assert all(text[o - 7 : o - 7 + len(p)] == p for p, o in pieces)
    chunks = pack([("x" * 5, 0), ("y" * 100, 6), ("z" * 100, 107)], 100, 32)
    assert [len(c.text) for c in chunks] == [106, 100]  # the crumb takes the next along
    c = Chunk("ab\ncd", [(0, 10, 2), (3, 20, 2)])
    assert (c.origin(3, 2), c.origin(1, 1), c.origin(1, 3)) == (20, 11, None)
    assert narrowed(Chunk("user=田中 さん!", [(0, 0, 11)]), "user=田中 さん!").text == "田中 さん"
    assert narrowed(Chunk("abc", [(0, 0, 3)]), "abc") is None


def test_runs_isolate_failures_and_ground():
    text = "田中と田中\nfail\n佐藤"
    chunks = [Chunk("田中と田中", [(0, 0, 5)]), Chunk("fail", [(0, 6, 4)]), Chunk("佐藤", [(0, 11, 2)])]

    def respond(t):
        if t == "fail":
            raise RuntimeError("no")
        return [t[:2], "いない"]

    r = run_chunks(text, chunks, respond)
    assert [f[:2] for f in r.found] == [(0, 2), (3, 5), (11, 13)] and r.ungrounded == ["いない", "いない"] and r.failures == [(2, 3, 4, "no")]


def test_name_lists():
    n = Names({"田中", "森"}, {"ヤマダ"}, {"健一", "洋介", "堅至"}, {"会議", "田中"}, {"田中"})
    assert n.parts("田中健一") == ("田中", "健一") and n.parts("五百旗頭堅至") == ("五百旗頭", "堅至") and n.parts("潮 洋介") == ("潮", "洋介") and n.parts("田中") is None
    assert [m[:2] for m in n.mentions([(0, 4, "田中健一")], "田中健一 田中さん 田中町 健一")] == [(5, 7), (14, 16)]
    yes, no = ["田中健一", "ヤマダ タロウ", "さくら", "潮 洋介", "John Smith"], ["", "様", "会議", "どこ", "サポート窓口", "田中を", "a:b", "7788", "田中 の再掲", "ORD-OPS", "x" * 25]
    assert [t for t in yes if not n.plausible_answer(t)] == [] and [t for t in no if n.plausible_answer(t)] == []
    assert n.plausible_answer("舩津", "舩津様へ")
    assert [t for t in ("田中", "健") if n.plausible_span(t)] == ["田中"] and not n.plausible_span("会議") and not n.plausible_span("ア") and not n.plausible_span("INFO")


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, f"mail u{i}@x.co tel 090-1234-{i:04d}") for i in range(20)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = mask_stream(read_stream(spark, str(tmp_path / "in"), "doc_id long, text string")).select("doc_id", "masked")
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "log"), available_now=True).awaitTermination()
    got = {r[0]: r[1] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["doc_id"]: r["masked"] for r in mask(df).collect()} and len(got) == 20


def test_masking_is_one_narrow_stage(spark):
    df = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string")
    plan = mask(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert long_findings(detect(df)).count() == 1
