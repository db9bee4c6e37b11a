import json

import pytest

from quarry import cli


def test_guards():
    parse = cli.parser().parse_args
    assert parse(["search", "x", "--min-score", "0.5", "--top-k", "3"]).min_score == 0.5
    for bad in (["search", "x", "--min-score", "1.5"], ["extract", "x", "--max-chunks", "0"], ["sql"], ["convert", "a", "--format", "pdf"], []):
        with pytest.raises(SystemExit):
            parse(bad)


def test_index_list_sql_extract_delete(spark, tmp_path, capsys):
    (tmp_path / "one.txt").write_text("bread and butter\ncheese\n")
    (tmp_path / "two.txt").write_text("bread and jam\n")
    root = ["--root", str(tmp_path / "root")]
    assert cli.main([*root, "index", str(tmp_path / "*.txt")]) == 0
    cli.main([*root, "list"])
    assert "hashed-words-64" in capsys.readouterr().out
    cli.main([*root, "search", "bread butter", "--min-score", "0.1"])
    assert "bread and butter" in capsys.readouterr().out
    cli.main([*root, "sql", "SELECT * FROM search('bread butter') WHERE min_score >= 0.1", "--output", str(tmp_path / "sql")])
    assert "[1] one - one.txt:1-3" in "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "sql")).collect())
    cli.main(["sql", "SELECT * FROM search('a') EXCEPT SELECT * FROM search('b')", "--tree"])
    spec = json.loads(capsys.readouterr().out)
    assert spec == {"op": "difference", "left": {"query": "a"}, "right": {"query": "b"}}
    (tmp_path / "spec.json").write_text(json.dumps({"query": "bread butter", "exclude": "jam", "min_score": 0.1}))
    cli.main([*root, "query", str(tmp_path / "spec.json"), "--output", str(tmp_path / "query")])
    assert "one - one.txt:1-3" in "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "query")).collect())
    cli.main([*root, "index", str(tmp_path / "one.txt"), "--corpus", "mine"])
    assert "mine" in capsys.readouterr().out
    cli.main(["gpu-info"])
    assert json.loads(capsys.readouterr().out) == {"executor_gpus": 0, "used": False}
    cli.main([*root, "extract", "bread", "--exclude", "jam", "--min-score", "0.1", "--output", str(tmp_path / "cut")])
    cli.main([*root, "delete", "two"])
    cli.main([*root, "list"])
    assert "two" not in capsys.readouterr().out.split("+\n")[-2]
    cli.main(["convert", str(tmp_path / "one.txt"), "--output", str(tmp_path / "md")])
    assert any("# one.txt" == r["value"] for r in spark.read.text(str(tmp_path / "md")).collect())
