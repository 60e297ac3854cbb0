"""Known scores of six documents, from their texts and tables, and again from office files in a folder."""

import json
import pathlib

import pytest

from lectern.plans import evaluate
from lectern.sources import corpus, render

GOLDEN = json.loads((pathlib.Path(__file__).parent / "fixtures" / "golden.json").read_text(encoding="utf-8"))
# document: (error rate before, table similarity before, error rate after, table similarity after)
WANT = {
    "ppt_slides": (10 / 34, None, 1 / 31, 1.0),
    "ppt_table_dup": (1.0, 1.0, 1.0, 1.0),
    "word_box_memo_strike": (31 / 50, None, 1 / 35, 1.0),
    "word_text_table": (11 / 60, 23 / 26, 0.0, 1.0),
    "xlsx_multisheet_linked": (0.0, 1.0, 0.0, 0.9971522582739439),
    "xlsx_single": (0.0, 13 / 21, 0.0, 1.0),
}
SUMMARY = [("wer", 0.3496, 0.1768, -0.1728, 49.42, "감소(개선)"), ("teds_content", 0.8759, 0.9995, 0.1236, 14.11, "증가(개선)")]


def check(gt, pred):
    wide, summary = evaluate.run(gt, pred)
    got = {r["doc_id"]: r for r in wide.collect()}
    assert set(got) == set(WANT)
    for doc, want in WANT.items():
        assert tuple(got[doc][c] for c in ("wer_before", "teds_before", "wer_after", "teds_after")) == want, doc
        assert got[doc]["dual_gt"] and got[doc]["type"] == {"w": "docx", "p": "pptx", "x": "xlsx"}[doc[0]]
    assert [tuple(r) for r in summary.collect()] == SUMMARY


def test_scores_of_texts_and_tables(spark):
    gt = spark.createDataFrame([(g["doc_id"], g["stage"], g["type"], True, g["text"], g["slides"], g["tables"]) for g in GOLDEN], "doc_id string, stage string, type string, dual_gt boolean, text string, slides array<string>, tables array<array<array<string>>>")
    check(gt, spark.createDataFrame([(g["doc_id"], g["stage"], g["raw"]) for g in GOLDEN], "doc_id string, stage string, raw string"))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("golden")
    for g in GOLDEN:
        (d / f"{g['doc_id']}_{g['stage']}_gt.{g['type']}").write_bytes(render.file(g["type"], g["text"], g["slides"], g["tables"]))
        (d / f"{g['doc_id']}_{g['stage']}.txt").write_text(g["raw"], encoding="utf-8")
    return str(d)


def test_scores_of_files(spark, folder):
    check(*corpus.scan(spark, folder))


def test_readers_give_back_what_was_rendered(spark, folder):
    gt, _ = corpus.scan(spark, folder)
    got = {(r["doc_id"], r["stage"]): r for r in gt.collect()}
    for g in GOLDEN:
        r = got[g["doc_id"], g["stage"]]
        assert r["text"] == g["text"] and r["tables"] == g["tables"] and r["slides"] == g["slides"]


def test_command_line(spark, folder, tmp_path, capsys):
    from lectern import __main__ as cli

    out = str(tmp_path / "out")
    cli.main(["run", folder, "--out", out])
    assert "word_text_table" in capsys.readouterr().out
    assert all(f.read_bytes().startswith(b"\xef\xbb\xbfdoc_id,type,dual_gt,") for f in pathlib.Path(out, "per_document").glob("part-*.csv"))
    cli.main(["units", folder, "ppt_slides", "before"])
    assert "match" in capsys.readouterr().out
    cli.main(["diagnose", folder, "word_text_table", "before"])
    assert "세부절차" in capsys.readouterr().out
    cli.main(["report", folder, "--out", out])
    pages = list(pathlib.Path(out, "pages").glob("doc_id=*"))
    assert len(pages) == 1
    cli.main(["profiles", folder, "word_text_table"])
    assert "content_only" in capsys.readouterr().out
