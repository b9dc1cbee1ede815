"""Command line: mask a text from standard input, or score detections."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from . import __version__


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilspan", description="Mask sensitive values in the text on standard input.")
    p.add_argument("--json", action="store_true", help="print the report instead of the masked text")
    group = p.add_mutually_exclusive_group()
    group.add_argument("--dictionary", metavar="PATH", help="term list, one a line")
    group.add_argument("--no-dictionary", action="store_true", help="no term list")
    p.add_argument("--no-ner", action="store_true", help="without the name tagger")
    p.add_argument("--no-model", action="store_true", help="without the language model")
    p.add_argument("--version", action="version", version=__version__)
    return p


def main(argv: Sequence[str] | None = None, stdin: bytes | None = None) -> int:
    """0 on success (empty input too), 1 when something can't be read, 2 on wrong usage."""
    args = parser().parse_args(argv)
    raw = sys.stdin.buffer.read() if stdin is None else stdin
    if not raw:
        return 0
    try:
        text = raw.decode()
    except UnicodeDecodeError as e:
        print(f"veilspan: the input is no UTF-8: {e}", file=sys.stderr)
        return 1

    from pyspark.sql import SparkSession

    from .plans.redact import Config, mask, with_report
    from .sources.files import read_terms

    spark = SparkSession.builder.appName("veilspan").config("spark.ui.enabled", "false").getOrCreate()
    try:
        terms = [] if args.no_dictionary else read_terms(spark, args.dictionary)
    except Exception as e:
        print(f"veilspan: the term list can't be read: {e}", file=sys.stderr)
        return 1
    config = Config(terms=terms, use_tagger=not args.no_ner, use_model=not args.no_model)
    row = with_report(mask(spark.createDataFrame([(text,)], "text string"), config)).first()
    sys.stdout.write(row["report"] if args.json else row["masked"])
    for w in row["warnings"]:
        print(f"warning: {w}", file=sys.stderr)
    return 0


def score(argv: Sequence[str]) -> int:
    """CORPUS DETECTIONS...: recall and precision of names, a column per system."""
    if len(argv) < 2:
        print("usage: score CORPUS DETECTIONS...", file=sys.stderr)
        return 64
    from pyspark.sql import SparkSession

    from .operators import evaluate
    from .sources.files import read_corpus, read_detections

    spark = SparkSession.builder.appName("veilspan-score").config("spark.ui.enabled", "false").getOrCreate()
    corpus, _ = read_corpus(spark, argv[0])
    systems = {}
    for path in argv[1:]:
        examined, names, rejected = read_detections(spark, path)
        system = (examined.select("system").first() or [path])[0]
        systems[system] = (names, rejected)
        for title, ids in (("UNEXAMINED samples, scored as missed", evaluate.unexamined_samples(corpus, examined)), ("UNKNOWN sample ids, ignored", evaluate.unknown_samples(corpus, examined))):
            if found := [r["id"] for r in ids.orderBy("id").collect()]:
                print(f"{system}: {title}: {', '.join(found)}")
    print(evaluate.render_names(corpus, systems), end="")
    return 0


if __name__ == "__main__":
    sys.exit(score(sys.argv[2:]) if sys.argv[1:2] == ["score"] else main())
