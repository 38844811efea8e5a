"""The shell commands on a small file."""

from logsense.__main__ import run


def test_commands(spark, tmp_path):
    log, table = str(tmp_path / "a.log"), str(tmp_path / "table")
    (tmp_path / "a.log").write_text("2024-01-01 00:00:01 INFO a 1.2.3.4\n2024-01-01 00:00:02 ERROR b 5.6.7.8\nnone {}\n")
    run(spark, ["store", log, table, "--level", "fast"])
    assert "log_levels\t2" in run(spark, ["info", table])
    assert run(spark, ["verify", table]).splitlines()[2].startswith("3\t")
    out = run(spark, ["query", table, "--select", "ipv4", "-w", "log_levels >= ERROR"])
    assert "5.6.7.8" in out and "1.2.3.4" not in out and out.endswith("(1 rows)")
    assert '"ipv4":"5.6.7.8"' in run(spark, ["query", table, "--select", "ipv4", "-w", "log_levels=ERROR", "--format", "json"])
    assert "5.6.7.8" in run(spark, ["query", table, "--select", "ipv4", "--format", "csv"])
    assert run(spark, ["query", table, "--columns"]).splitlines() == ["timestamps", "ipv4", "log_levels"]
    assert "compression_ratio" in run(spark, ["query", table, "--stats"])
    run(spark, ["restore", table, str(tmp_path / "text")])
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()] == (tmp_path / "a.log").read_text().splitlines()
    assert "quality" in run(spark, ["estimate", log])
