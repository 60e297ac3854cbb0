"""Command line: ``python -m lectern run|diagnose|units|profiles|report FOLDER ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions.text import PROFILES
from .plans import evaluate, report
from .sources import corpus, sinks


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lectern", description="Scores of parser outputs against ground-truth documents in a folder.")
    sub = p.add_subparsers(dest="what", required=True)
    add = lambda name, text: sub.add_parser(name, help=text)
    for name, text in (("run", "scores per document and their summary"), ("diagnose", "what is behind one score"), ("units", "one document by slide or sheet"), ("profiles", "one document under all profiles"), ("report", "HTML pages: of one document, the first one by default, or of all")):
        c = add(name, text)
        c.add_argument("folder")
        if name in ("diagnose", "units", "profiles"):
            c.add_argument("doc_id")
        if name in ("diagnose", "units"):
            c.add_argument("stage", choices=corpus.STAGES, nargs="?", default="after")
        if name in ("run", "report"):
            c.add_argument("--out", help="a folder to write to" + (" pages" if name == "report" else " CSV files and pages"), required=name == "report")
        if name == "report":
            c.add_argument("--doc-id")
            c.add_argument("--all", action="store_true")
        if name in ("run", "units"):
            c.add_argument("--profile", choices=list(PROFILES), default="default")
    a = p.parse_args(args)
    gt, pred = corpus.scan(SparkSession.builder.appName("lectern").getOrCreate(), a.folder)

    if a.what == "run":
        wide, summary = evaluate.run(gt, pred, a.profile)
        sinks.print_report(wide, summary)
        if a.out:
            sinks.write_csv(wide, f"{a.out}/per_document")
            sinks.write_csv(summary, f"{a.out}/summary")
    elif a.what == "diagnose":
        for name, table in evaluate.diagnosis(gt, pred, a.doc_id, a.stage).items():
            print(name)
            table.show(1000, truncate=False)
    elif a.what == "units":
        own = gt.where((gt.doc_id == a.doc_id) & (gt.stage == a.stage))
        evaluate.slide_units(own, pred, a.profile).show(1000, truncate=False)
        evaluate.sheet_units(own, pred).show(1000, truncate=False)
    elif a.what == "profiles":
        evaluate.by_profile(gt.where(gt.doc_id == a.doc_id), pred).show(1000, truncate=False)
    else:
        doc = None if a.all else a.doc_id or gt.agg({"doc_id": "min"}).first()[0]
        own = gt if doc is None else gt.where(gt.doc_id == doc)
        sinks.write_html(report.pages(own, pred, evaluate.per_document(evaluate.scores(own, pred))), f"{a.out}/pages")


if __name__ == "__main__":
    main()
