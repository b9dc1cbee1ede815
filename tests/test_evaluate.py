"""Evaluation, files, jobs, command line."""

import hashlib
import json
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veilspan import cli, queries
from veilspan.operators import evaluate
from veilspan.plans import lexicon_jobs as jobs
from veilspan.sources import files


@pytest.fixture()
def corpus(spark, tmp_path):
    def name(text, *tags):
        return {"kind": "personalName", "text": text, "tags": list(tags)}

    body = {
        "version": 1, "dictionary": ["社"], "unknown": 1,
        "samples": [
            {"id": "a", "text": "林と小林さん\nJohn Smith 様", "expected": [name("林", "kanji", "familyOnly"), name("小林", "kanji", "familyOnly", "honorific"), name("John Smith", "romaji", "full")], "mustNotDetect": [], "genre": "log", "writer": "human"},
            {"id": "b", "text": "𠮷田 と E-1", "expected": [name("𠮷田", "kanji", "familyOnly"), name("なし", "hiragana", "full")], "mustNotDetect": ["E-1"], "genre": "email", "writer": "opus"},
            {"id": "b2", "text": "x", "expected": [{"kind": "email", "text": "x"}], "mustNotDetect": ["x"]},
        ],
    }
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps(body))
    return files.read_corpus(spark, str(path))


def test_names(spark, corpus, tmp_path):
    c, terms = corpus
    assert terms == ["社"]
    body = {"system": "s", "samples": {"a": {"names": [{"text": "小林"}, {"text": "John", "location": 7, "length": 4}, {"text": "x", "location": 900, "length": 1}, {"text": "林", "location": 0}], "rejected": ["𠮷田"]}, "b": {"names": [{"text": "と", "location": 4, "length": 1}], "rejected": ["𠮷田さん"]}, "zz": {"names": []}}}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(body))
    examined, names, rejected = files.read_detections(spark, str(path))
    out = {(r["id"], r["text"]): (r["outcome"], r["cause"]) for r in evaluate.name_outcomes(c, names, rejected, evaluate.late_text(c.samples)).collect()}
    assert out == {("a", "林"): ("missed", "neverReturned"), ("a", "小林"): ("covered", None), ("a", "John Smith"): ("partial", None), ("b", "𠮷田"): ("missed", "filterRejected")}
    problems = {(r["text"], r["problem"]) for r in evaluate.checked_detections(c.samples, names).where("problem is not null").collect()}
    assert problems == {("x", "out of bounds"), ("林", "length but no location") if False else ("林", "location but no length")}
    s = evaluate.name_summary(c, names).first()
    assert (s["expected"], s["covered"], s["partial"], s["detections"], s["false_positives"], s["recall"]) == (4, 1, 1, 3, 1, 0.25)
    assert [r["id"] for r in evaluate.unknown_samples(c, examined).collect()] == ["zz"]
    assert [r["id"] for r in evaluate.unexamined_samples(c, examined).collect()] == ["b2"]
    b = evaluate.breakdown(evaluate.name_outcomes(c, names))
    assert [r["label"] for r in b.collect()][:2] == ["all", "tag:kanji"]
    assert evaluate.comparison({"s": b, "t": b}).columns == ["label", "s", "t", "n"]


def test_nothing_expected_gives_null_ratios(spark, corpus):
    c, _ = corpus
    none = evaluate.Corpus(c.samples, c.expected.where("false"), c.forbidden)
    empty = spark.createDataFrame([], "id string, text string, location int, length int")
    s = evaluate.name_summary(none, empty).first()
    assert s["recall"] is None and s["precision"] is None


def test_kinds(spark, corpus):
    c, _ = corpus
    found = spark.createDataFrame([("b", "phoneNumber", "dataDetector", 5, 3, "E-1"), ("a", "personalName", "ner", 2, 2, "小林")], "id string, kind string, source string, start int, len int, text string")
    assert [tuple(r) for r in evaluate.kind_recall(c, found).collect()] == [("email", 1, 0, 1), ("personalName", 4, 2, 2)]
    assert [r["text"] for r in evaluate.violations(c, found).collect()] == ["E-1"] and [r["text"] for r in evaluate.unexpected(c, found).collect()] == ["E-1"]
    assert [r["text"] for r in evaluate.corpus_errors(c).collect()] == ["なし"]
    assert "E-1" in evaluate.render_kinds(c, found)


def test_lint(corpus):
    c, _ = corpus
    got = {(r["id"], r["problem"]) for r in evaluate.lint(c).collect()}
    assert got == {("b", "not in the text"), ("b2", "no genre"), ("b2", "no writer"), ("b2", "kind email in a name corpus")}


def test_unknown_values_fail(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"samples": [{"id": "a", "text": "x", "expected": [{"kind": "nonsense", "text": "x"}], "mustNotDetect": []}]}))
    with pytest.raises(PySparkException):
        files.read_corpus(spark, str(tmp_path / "c.json"))[0].expected.collect()


def test_files(spark, tmp_path):
    (tmp_path / "terms.txt").write_text(" a \n# no\n\nb c\r\n")
    assert files.read_terms(spark, str(tmp_path / "terms.txt")) == ["a", "b c"]
    with pytest.raises(PySparkException):
        files.read_terms(spark, str(tmp_path / "missing"))
    assert files.default_terms_path({"XDG_CONFIG_HOME": "/x"}) == "/x/veilspan/terms.txt" and files.default_terms_path({"HOME": "/h"}) == "/h/.config/veilspan/terms.txt"
    (tmp_path / "bad.txt").write_bytes(b"ok\xff")
    assert [(r["text"], r["valid"]) for r in files.read_texts(spark, str(tmp_path / "bad.txt")).collect()] == [(None, False)]
    names = spark.createDataFrame([("a", "x", 1, 1)], "id string, text string, location int, length int")
    files.write_detections(names, "sys", str(tmp_path / "out"))
    _, back, _ = files.read_detections(spark, str(tmp_path / "out"))
    assert [tuple(r) for r in back.collect()] == [("x", 1, 1)] or [r["text"] for r in back.collect()] == ["x"]


def entry(surface, cost, *pos, reading="ヨミ"):
    return ",".join([surface, "1", "1", str(cost), surface, *pos, *["*"] * (6 - len(pos)), reading])


def test_lexicon_in_a_pinned_archive(spark, tmp_path):
    lines = [entry("田中", 5, "名詞", "固有名詞", "人名", "姓", reading="タナカ"), entry('"a,b ""c"""', 3, "名詞", "普通名詞"), entry("森", -1, "名詞", "普通名詞")]
    (tmp_path / "lex.csv").write_text("\n".join(lines))
    with zipfile.ZipFile(tmp_path / "lex.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("release/notes.txt", "x")
        z.writestr("release/small_lex.csv", "\r\n".join(lines) + "\n\n")
    digest = hashlib.sha256((tmp_path / "lex.zip").read_bytes()).hexdigest()
    got = files.read_lexicon_zip(spark, str(tmp_path / "lex.zip"), digest).collect()
    assert sorted(got) == sorted(files.read_lexicon_csv(spark, str(tmp_path / "lex.csv")).collect()) and {r["surface"] for r in got} >= {"田中", "森"} and len(got) == 3
    with pytest.raises(Exception, match="SHA-256"):
        files.read_lexicon_zip(spark, str(tmp_path / "lex.zip"), "0" * 64).collect()
    with pytest.raises(Exception, match="no other.csv"):
        files.read_lexicon_zip(spark, str(tmp_path / "lex.zip"), digest, "other.csv").collect()


def test_jobs(spark, tmp_path):
    person = ("名詞", "固有名詞", "人名")
    rows = [entry("田中", 5, *person, "姓", reading="タナカ"), entry("田中", 3, *person, "姓", reading="タナカ"), entry("森", 1, *person, "姓", reading="モリ"), entry("健一", 4, *person, "名"), entry("会議", 4, "名詞", "普通名詞"), entry("田中", 9, "名詞", "普通名詞")]
    (tmp_path / "lex.csv").write_text("\n".join(rows))
    lex = files.read_lexicon_csv(spark, str(tmp_path / "lex.csv"))
    assert {tuple(r) for r in jobs.surnames(lex).collect()} == {("surname_kanji", "田中"), ("surname_kana", "タナカ"), ("surname_kana", "モリ")}
    assert {tuple(r) for r in jobs.words_and_names(lex).collect()} == {("name", "田中"), ("name", "森"), ("name", "健一"), ("word", "会議")}
    held = spark.createDataFrame([("森",)], "surface string")
    pools = jobs.name_pools(lex, held)
    assert {tuple(r) for r in pools.collect()} == {("family", "田中"), ("given", "健一"), ("noun", "会議")}
    out = jobs.generate(spark, pools, 200, seed=2)
    assert jobs.bad_bounds(out).isEmpty() and jobs.leaks(out, held).isEmpty() and 0.2 < jobs.empty_share(out).first()["share"] < 0.7
    assert out.collect() == jobs.generate(spark, pools, 200, seed=2).repartition(3).orderBy("id").collect()
    assert jobs.cost_quartiles(lex, 1).count() >= 1
    assert [jobs.romaji(k) for k in ("タナカ", "シュンイチ", "ハットリ", "マッチャ")] == ["tanaka", "shunichi", "hattori", "matcha"]


def test_generate_draws_from_whole_pools(spark):
    # more family names than the two million entries that once travelled; the nouns come last
    many = spark.range(2_000_010).select(F.lit("family").alias("pool"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("surface"))
    rows = jobs.generate(spark, many.unionByName(spark.createDataFrame([("given", "健一"), ("noun", "会議")], "pool string, surface string")), 300).collect()
    assert any("会議" in r["text"] for r in rows) and any(r["text"][a:b] != "健一" and r["text"][a:b].startswith("f") for r in rows for a, b in r["spans"])
    with pytest.raises(ValueError):
        jobs.generate(spark, many, 10)


def test_training_rows_reports_held_out_names(spark, tmp_path, monkeypatch):
    spark.range(30).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    counts = lambda: {r["what"]: r["n"] for r in queries.training_rows(spark, str(tmp_path)).collect()}
    assert counts() == {"leaks": 0, "bad_bounds": 0, "rows": 2000}
    clean = jobs.name_pools
    monkeypatch.setattr(jobs, "name_pools", lambda lexicon, held: clean(lexicon, held.where("false")))
    assert counts()["leaks"] > 0


def test_command_line(capsys):
    with pytest.raises(SystemExit) as e:
        cli.main(["--nonsense"])
    assert e.value.code == 2
    with pytest.raises(SystemExit) as e:
        cli.main(["--help"])
    assert e.value.code == 0
    assert cli.main([], stdin=b"") == 0 and cli.main([], stdin=b"\xff") == 1 and cli.score(["x"]) == 64


def test_command_line_masks(spark, capsys):
    assert cli.main(["--no-dictionary"], stdin="mail a@b.co".encode()) == 0
    out = capsys.readouterr()
    assert out.out == "mail [EMAIL_1]" and out.err.count("warning:") == 2
    assert cli.main(["--json", "--no-dictionary"], stdin="a@b.co".encode()) == 0
    assert json.loads(capsys.readouterr().out)["masked"] == "[EMAIL_1]"
