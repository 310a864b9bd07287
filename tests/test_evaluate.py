"""The report file: its parts in order are one JSON document."""

from __future__ import annotations

import glob
import json

from belegwerk.plans import evaluate, queries_score
from belegwerk.plans.bindings import Tables


def test_the_parts_of_a_report_are_one_json_text(spark, tmp_path):
    result = evaluate.evaluate(queries_score.corpus_of(t := Tables(spark, "/root/testdata/sf0.001")), {"careless": queries_score.careless(t), "exact": queries_score.exact})
    lines = evaluate.report_lines(result)
    for name in ("careless", "exact"):
        evaluate.write_report(lines.repartition(7), name, str(tmp_path / name))
        text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{tmp_path}/{name}/part-*")))
        report = json.loads(text)
        assert list(report) == ["summary", "terms", "rows"]
        assert len(report["rows"]) == report["summary"]["documents"] > 0
        assert sum(x["total"] for x in report["terms"]) == report["summary"]["fieldsTotal"] == sum(r["fieldsTotal"] for r in report["rows"])
        numbers = [int(x["term"].split("-")[1]) for x in report["terms"]]
        assert numbers == sorted(numbers)
    assert report["summary"]["fieldsCorrect"] == report["summary"]["fieldsTotal"] and report["summary"]["fieldsInvented"] == 0
