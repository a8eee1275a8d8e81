"""The commands, on small files."""

import json

import pytest

from veridane.__main__ import main
from veridane.operators import clean


def test_clean_then_validate(spark, tmp_path, capsys):
    source = tmp_path / "q.json"
    good = "This statement is long enough."
    records = [
        {"id": "2023_29", "original_question": f"<statements> (a) {good} (b) {good} <choices> x", "statements": {"statement_1": "x"}},
        {"id": "2025_05", "original_question": "", "statements": None},
        {"id": "zz", "original_question": good, "statements": {"statement_1": good}},
    ]
    source.write_text(json.dumps(records, indent=2))
    assert main(["validate", "--input", str(source), "--records", "3", "--statements", "9"], spark) == 1
    assert main(["clean", "--input", str(source), "--output", str(tmp_path / "out"), "--array"], spark) == 0
    assert main(["clean", "--input", str(source), "--output", str(tmp_path / "lines")], spark) == 0
    for name, more in (("out", []), ("lines", ["--lines"])):
        assert main(["validate", "--input", str(tmp_path / name), "--records", "3", "--statements", "6", *more], spark) == 0
    assert "Validation passed." in capsys.readouterr().out
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect())
    cleaned = {r["id"]: r["statements"] for r in json.loads(text)}
    assert cleaned["2023_29"] == {"statement_1": f"(a) {good}", "statement_2": f"(b) {good}"} and cleaned["2025_05"] == clean.MANUAL_PATCH


def test_prompt_and_decide(spark, tmp_path, capsys):
    assert main(["prompt", "--dsl", "odrl"], spark) == 0
    assert "<ODRL>" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["prompt", "--dsl", "other"], spark)
    spark.createDataFrame([('{"infringing_product_available": true, "substitute_product_available": false}',)], "raw string").write.parquet(str(tmp_path / "r"))
    assert main(["decide", "--input", str(tmp_path / "r"), "--output", str(tmp_path / "d")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "d")).first()["decision"] == "AWARDED"
