"""python -m quillgraph ingest PATH | ask QUESTION | run COMMAND [--kb FOLDER]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quillgraph.plans.commands import Session
from quillgraph.plans.knowledge import KnowledgeBase
from quillgraph.sources import config, readers


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillgraph", description=__doc__)
    p.add_argument("verb", choices=("ingest", "ask", "run"))
    p.add_argument("what", nargs="+")
    p.add_argument("--kb")
    p.add_argument("--config")
    p.add_argument("--date")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("quillgraph").getOrCreate()
    kb = KnowledgeBase(spark, config.load(a.config, path=a.kb))
    if a.verb == "ingest":
        for path in a.what:
            print(kb.ingest_markdown(readers.markdown(spark, path, recursive=True), a.date))
    elif a.verb == "ask":
        got = kb.ask(" ".join(a.what))
        print(f"{got.text}\n(confidence {got.confidence:.2f})")
    else:
        print(Session(kb).run(" ".join(a.what)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
