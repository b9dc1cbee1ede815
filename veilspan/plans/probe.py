"""Probes: a configuration over a corpus, its latency, and what two runs differ in."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate
from .redact import Config, detect, long_findings


def detections(corpus: evaluate.Corpus, config: Config | None = None) -> DataFrame:
    """(id, kind, source, start, len, text) of the pipeline over the samples; a finding
    of several sources is put under the first by name."""
    found = long_findings(detect(corpus.samples.select("id", "text"), config), "id")
    return found.select("id", "kind", F.get("sources", F.lit(0)).alias("source"), "start", "len", "text")


def probe(corpus: evaluate.Corpus, config: Config | None = None) -> str:
    """The evaluation report of a configuration."""
    return evaluate.render_kinds(corpus, detections(corpus, config))


def latency(samples: DataFrame, config: Config) -> DataFrame:
    """One row: samples, total, mean and max seconds. Each sample is masked alone, as
    an interactive caller would; for a corpus of test size."""
    rows = []
    for r in samples.select("id", "text").orderBy("id").toLocalIterator():
        one = samples.sparkSession.createDataFrame([(r["id"], r["text"])], "id string, text string")
        began = time.perf_counter()
        detect(one, config).select("findings").collect()
        rows.append((r["id"], time.perf_counter() - began))
    frame = samples.sparkSession.createDataFrame(rows, "id string, seconds double")
    return frame.agg(F.count(F.lit(1)).alias("samples"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"), F.max("seconds").alias("max"))


def scaling(text: str, times: list[int], spark, config: Config) -> DataFrame:
    """(characters, seconds) of growing copies of a text."""
    frames = [(i, text * k) for i, k in enumerate(times)]
    rows = []
    for _, t in frames:
        began = time.perf_counter()
        detect(spark.createDataFrame([(t,)], "text string"), config).select("findings").collect()
        rows.append((len(t), time.perf_counter() - began))
    return spark.createDataFrame(rows, "characters long, seconds double")


def differing(one: DataFrame, other: DataFrame) -> DataFrame:
    """Ids of samples whose detections differ between two runs."""
    key = ["id", "kind", "start", "len"]
    a, b = one.select(*key), other.select(*key)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select("id").distinct()
