"""Reading and writing, through Spark's readers and writers only."""

from __future__ import annotations

import atexit
import functools
import hashlib
import io
import itertools
import os
import re
import shutil
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import KINDS
from ..functions.text import term_list, trimmed
from ..operators.evaluate import GENRES, TAGS, WRITERS, Corpus

CORPUS_SCHEMA = (
    "version bigint, note string, dictionary array<string>, samples array<struct<id: string, note: string, text: string, "
    "expected: array<struct<kind: string, text: string, tags: array<string>>>, mustNotDetect: array<string>, genre: string, writer: string>>"
)
_LEXICON_SCHEMA = ", ".join(f"c{i} string" for i in range(12))
DETECTIONS_SCHEMA = "system string, samples map<string, struct<names: array<struct<text: string, location: int, length: int>>, rejected: array<string>>>"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset
    a local session gets one of its own, gone when the process ends; a cluster can't do
    without."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_own_folder()}"


@functools.cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="veilspan-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, valid): whole files. Bytes that are not UTF-8 give valid = false
    and a null text, rather than an empty one."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.col("content").cast("string")
    ok = F.is_valid_utf8(text)
    return raw.select("path", F.when(ok, text).alias("text"), ok.alias("valid"))


def default_terms_path(environment: dict[str, str] | None = None) -> str:
    """The user's term list under XDG_CONFIG_HOME or ~/.config."""
    env = os.environ if environment is None else environment
    home = env.get("XDG_CONFIG_HOME") or os.path.join(env.get("HOME", ""), ".config")
    return os.path.join(home, "veilspan", "terms.txt")


def read_terms(spark: SparkSession, path: str | None = None) -> list[str]:
    """Terms of a list, one a line. A missing default list is empty; a named one that
    can't be read is an error."""
    try:
        rows = spark.read.text(path or default_terms_path(), wholetext=True)
        return [t for r in rows.select(F.explode(term_list(F.col("value"))).alias("t")).collect() for t in r]
    except AnalysisException:
        if path:
            raise
        return []


def _closed(c: F.Column, allowed: tuple[str, ...] | dict, what: str) -> F.Column:
    return F.when(c.isNull() | c.isin(*allowed), c).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), c)))


def read_corpus(spark: SparkSession, path: str, lines: bool = False) -> tuple[Corpus, list[str]]:
    """A labelled corpus and its dictionary. Unknown kinds, tags, genres and writers
    are errors; unknown fields are ignored. ``lines``: an object a line, each with some
    of the samples, so that files can be read in parts."""
    raw = spark.read.schema(CORPUS_SCHEMA).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    samples = raw.select(F.explode("samples").alias("s")).select("s.*")
    s = samples.select("id", "text", _closed(F.col("genre"), GENRES, "genre").alias("genre"), _closed(F.col("writer"), WRITERS, "writer").alias("writer"))
    e = samples.select("id", F.posexplode("expected").alias("n", "e")).select(
        "id", "n", _closed(F.col("e.kind"), KINDS, "kind").alias("kind"), F.col("e.text").alias("text"),
        F.transform("e.tags", lambda t: _closed(t, TAGS, "tag")).alias("tags"),
    )
    f = samples.select("id", F.posexplode("mustNotDetect").alias("n", "text"))
    terms = [t for r in raw.select(F.explode("dictionary").alias("t")).distinct().sort("t").collect() for t in r]
    return Corpus(s, e, f), terms


def read_detections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(examined ids with system), (id, text, location, length), (id, rejected text)."""
    raw = spark.read.schema(DETECTIONS_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    entries = raw.select("system", F.explode("samples").alias("id", "v"))
    names = entries.select("id", F.inline("v.names"))
    rejected = entries.select("id", F.explode("v.rejected").alias("text"))
    return entries.select("id", "system"), names, rejected


def write_detections(names: DataFrame, system: str, path: str) -> None:
    """Detections (id, text, location, length) as one JSON object a system."""
    by_id = names.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("location", "length", "text"))).alias("names"))
    entry = F.map_from_entries(F.collect_list(F.struct("id", F.struct("names"))))
    by_id.agg(entry.alias("samples")).select(F.lit(system).alias("system"), "samples").write.mode("overwrite").json(path)


def read_word_list(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A lexicon (list, surface) of one entry a line, whatever ends the lines."""
    return spark.read.text(path).select(F.lit(name).alias("list"), F.regexp_replace("value", "\r$", "").alias("surface")).where("surface <> ''").distinct()


def read_lexicon_csv(spark: SparkSession, path: str) -> DataFrame:
    """(surface, cost, pos1 to pos4, reading) of a morphological lexicon: CSV without
    header, by position 0, 3, 5 to 8 and 11."""
    return _entries(spark.read.schema(_LEXICON_SCHEMA).option("escape", '"').csv(path))


def read_lexicon_zip(spark: SparkSession, path: str, sha256: str, member: str = "small_lex.csv") -> DataFrame:
    """``read_lexicon_csv`` of a member of a zip archive. An archive with another SHA-256
    than the one given, or without the member, is an error. One archive is one row of
    Spark's reader, 2 GB at most; its lines leave the worker in batches."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                if hashlib.sha256(content).hexdigest() != sha256.lower():
                    raise ValueError(f"the archive is not the one with SHA-256 {sha256}")
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    name = next((n for n in archive.namelist() if n.rsplit("/", 1)[-1] == member), None)
                    if name is None:
                        raise ValueError(f"the archive has no {member}")
                    with archive.open(name) as raw:
                        text = io.TextIOWrapper(raw, encoding="utf-8", newline="\n")
                        while some := [x.rstrip("\r\n") for x in itertools.islice(text, 10_000)]:
                            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["line"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "line string")
    return _entries(rows.where("line <> ''").select(F.from_csv("line", _LEXICON_SCHEMA, {"escape": '"'}).alias("x")).select("x.*"))


def _entries(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("c0").alias("surface"), F.col("c3").cast("int").alias("cost"), *[F.col(f"c{i}").alias(f"pos{i - 4}") for i in range(5, 9)], F.col("c11").alias("reading"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, for fixtures that name the file they belong to."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_masked(masked: DataFrame, path: str, column: str = "masked") -> None:
    """Masked texts as text files, one line break after each document. A text with line
    breaks goes on over lines; nothing else is written beside it."""
    masked.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_reports(reported: DataFrame, path: str) -> None:
    """Compact report JSON, a document a line. Reports hold the original values: they
    are as sensitive as the input."""
    reported.select(F.col("report").alias("value")).write.mode("overwrite").text(path)


def write_training_rows(rows: DataFrame, path: str) -> None:
    """(text, spans) as JSON lines."""
    rows.select("text", "spans").write.mode("overwrite").json(path)


def find_model_dir(environment: dict[str, str], executable: str, variable: str = "VEILSPAN_NER_DIR") -> str | None:
    """The tagger's files: the variable alone if it is set, else share/veilspan/ner
    beside the executable's folder; None if they are not there."""
    named = environment.get(variable)
    folder = named or os.path.join(os.path.dirname(os.path.dirname(os.path.realpath(executable))), "share", "veilspan", "ner")
    return folder if os.path.isdir(folder) else None


def clean_terms(df: DataFrame, column: str = "value") -> DataFrame:
    """A term list that is a table already."""
    t = trimmed(F.col(column))
    return df.select(t.alias("term")).where("term <> '' AND NOT startswith(term, '#')")


def write_split(samples: DataFrame, path: str, id_col: str = "id") -> None:
    """Samples as JSON lines in folders side=dev and side=test, by the hash of their id."""
    from ..plans.lexicon_jobs import side

    samples.withColumn("side", side(F.col(id_col))).write.mode("overwrite").partitionBy("side").json(path)
