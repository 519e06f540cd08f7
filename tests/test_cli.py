import pytest

from codeframes import cli


def test_usage(capsys):
    assert cli.main([]) == 2
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"])
    assert e.value.code == 0
    assert cli.main(["extract", "f", "--readings", "r", "--score-threshold", "2"]) == 1
    assert capsys.readouterr().err.strip().endswith("score_threshold must be from 0 to 1, not 2.0")


def test_missing_table(spark, tmp_path, capsys):
    assert cli.main(["extract", str(tmp_path / "no"), "--readings", str(tmp_path / "no")]) == 1
    assert capsys.readouterr().err.startswith("codeframes: error: ")


def test_extract(spark, tmp_path, capsys):
    spark.createDataFrame([("v", "/a", 0, 0), ("v", "/b", 1000, -1)], "video_id string, path string, timestamp_ms bigint, phash bigint").write.parquet(str(tmp_path / "f"))
    spark.createDataFrame([("v", "/a", "import os", 0.9), ("v", "/b", "prose", 0.9)], "video_id string, path string, text string, confidence double").write.parquet(str(tmp_path / "r"))
    assert cli.main(["extract", str(tmp_path / "f"), "--readings", str(tmp_path / "r"), "--out", str(tmp_path / "o"), "--fps", "1"]) == 0
    shown = capsys.readouterr().out
    assert "Passed scoring gate:" in shown and "Snippets merged:" in shown
    assert next((tmp_path / "o/scripts/video_id=v").glob("part-*")).read_text() == "import os\n"


def test_bench(spark, tmp_path, capsys):
    schema = "backend string, name string, truth string, text string, error string"
    spark.createDataFrame([("a", "1", "x = 1", "x", None), ("b", "1", "x = 1", "x = 1", None), ("c", "1", "x", "x", "gone")], schema).write.parquet(str(tmp_path / "p"))
    assert cli.main(["bench", str(tmp_path / "p")]) == 0
    assert "Winner: b  (recommended default, over 1 labeled frame(s))" in capsys.readouterr().out
    spark.createDataFrame([("c", "1", "x", "x", "gone")], schema).write.parquet(str(tmp_path / "q"))
    assert cli.main(["bench", str(tmp_path / "q")]) == 1
    assert "no backends benchmarked" in capsys.readouterr().out
