"""Tokenizer host, probes, Unicode."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.functions.unicode import keep_piece, nfkc
from veilspan.operators import evaluate
from veilspan.plans import probe
from veilspan.plans.redact import Config
from veilspan.tokenizer import UnigramTokenizer, fixture, labels_of, locate


@pytest.fixture()
def path(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    vocab = [("<s>", 0.0), ("</s>", 0.0), ("<unk>", -9.0), ("▁", -3.0), ("田中", -2.0), ("さん", -2.0), ("▁a", -1.0), ("b", -2.0)]
    t = Tokenizer(models.Unigram(vocab, unk_id=2, byte_fallback=False))
    t.normalizer = normalizers.NFKC()
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    t.save(str(tmp_path / "t.json"))
    return str(tmp_path / "t.json")


def test_tokens_have_places(path):
    t = UnigramTokenizer(path)
    line = "田中さん ab"
    tokens = t.tokenize(line)
    assert [line[x.start : x.end] for x in tokens] == ["", "田中", "さん", "a", "b"] and (t.cls, t.sep) == (0, 1)
    assert t.tokenize("") == []
    f = fixture(t, ["𠮷 田中"], "d")
    assert f["lines"][0]["offsets"][-1] == [3, 5]


def test_other_tokenizers_are_refused(path, tmp_path):
    spec = json.load(open(path))
    for change in ({"type": "BPE"}, {"byte_fallback": True}, {"unk_id": None}):
        (tmp_path / "x.json").write_text(json.dumps(spec | {"model": spec["model"] | change}))
        with pytest.raises(ValueError):
            UnigramTokenizer(str(tmp_path / "x.json"))


def test_small_helpers():
    assert labels_of(np.array([[0, 2, 2], [1, 0, 0]])) == [1, 0]
    assert locate("田 中##健", "a 田中 健", 1) == (2, 6) and locate(" ", "a") is None and locate("x", "a") is None
    assert [keep_piece(p) for p in ("▁abc", "田中", "한", "。", "é")] == [True, True, False, True, False]


def test_nfkc(spark):
    df = spark.createDataFrame([("ｶﾞ㈱ＡＢ",), (None,)], "t string")
    assert [r[0] for r in df.select(nfkc(F.col("t"))).collect()] == ["ガ(株)AB", None]


def test_probes(spark):
    samples = spark.createDataFrame([("a", "m a@b.co"), ("b", "none")], "id string, text string").withColumns({"genre": F.lit("log"), "writer": F.lit("human")})
    expected = spark.createDataFrame([("a", 0, "email", "a@b.co", None)], "id string, n int, kind string, text string, tags array<string>")
    c = evaluate.Corpus(samples, expected, spark.createDataFrame([], "id string, n int, text string"))
    assert "email" in probe.probe(c) and probe.latency(samples, Config()).first()["samples"] == 2
    found = probe.detections(c)
    assert probe.differing(found, found).isEmpty() and [r[0] for r in probe.differing(found, found.where("false")).collect()] == ["a"]
    assert probe.scaling("x a@b.co ", [1, 3], spark, Config()).count() == 2
