"""The command line: results, and flag errors that end with a code."""

import json

import pytest

from codestrata.__main__ import main


def test_json_of_one_source(spark, tmp_path):
    assert main(["-s", "package p; class A { void f() { } }", "-o", str(tmp_path), "--app-name", "x"]) == 0
    row = json.loads(next((tmp_path / "analysis").glob("part-*")).read_text().splitlines()[0])
    assert row["file_key"] == "<pseudo-path>" and row["types"][0]["type_id"] == "p.A"


@pytest.mark.parametrize("flags", [[], ["-i", "x"], ["-i", "x", "-s", "y", "-o", "z"], ["-i", "x", "-o", "z", "--eager"], ["--emit", "other"]])
def test_flag_errors(flags):
    with pytest.raises(SystemExit) as stop:
        main(flags)
    assert stop.value.code != 0


def test_schema(capsys):
    assert main(["--emit", "schema"]) == 0
    assert "JCallable" in capsys.readouterr().out
