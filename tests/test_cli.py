from gridspark.cli import main


def test_exit_codes(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "rel_kpi" in capsys.readouterr().out
    assert main(["no_such_query", "--tables", "x"]) == 2
    assert main(["mart_dim_time"]) == 2
    assert main(["rel_kpi", "--tables", str(tmp_path / "none")]) == 3
    assert main(["mart_dim_time", "--tables", "x", "--out", str(tmp_path / "o"), "--format", "csv"]) == 0
