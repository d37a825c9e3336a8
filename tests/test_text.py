import subprocess
import sys

import pytest

from quaybook import cli
from quaybook.operators.analytics import analytics
from quaybook.operators.prediction import prediction_snapshots, summarize_horizons
from quaybook.schema import Backend
from quaybook.sinks.csv import backend_output_path, write_analytics, write_analytics_csv, write_prediction_report_csv
from quaybook.sources import text

GOOD = ["34200.123456,1,123456789,250,1254300,1", " 1 , 2,\t3 ,4, 5 , -1 \r", "+5.5e1,7,-9,-4,0,1", "1,4,007,5,+6,1", "nan,1,1,1,1,1", ".5,1,9223372036854775807,2147483647,1,1", "5.,1,1,1,1,1"]
BAD = [
    "34200.2,1,111,50,1254300", "34200.3,1,abc,50,1254300,1", "1,1,1,1,1,0", "1,0,1,1,1,1", "1,8,1,1,1,1", "", "1,1,1,1,1,1,", "1.0d,1,1,1,1,1", "1,1,1,2147483648,1,1",
    "1,1,9223372036854775808,1,1,1", "1e999,1,1,1,1,1", "1,1,5.7,1,1,1", "1,1,1e3,1,1,1", '"1",1,1,1,1,1', "x", "1,1,,1,1,1", "1e-999,1,1,1,1,1",
]


def write(path, lines):
    path.write_bytes("\n".join(lines).encode() + b"\n")
    return str(path)


def test_lines_are_validated_strictly(spark):
    rows = spark.createDataFrame([(i, line) for i, line in enumerate(GOOD + BAD)], "i int, value string")
    fine = {r["i"] for r in text.parse(rows).where("message is not null").collect()}
    assert fine == set(range(len(GOOD)))
    first = text.parse(rows).where("i = 0").first()["message"]
    assert tuple(first) == (34200.123456, 1, 123456789, 250, 1254300, 1)


HEXADECIMAL = [
    "0x1p0", "-0x1.8p3", "0X.8", "0x10", "0x1.fffffffffffff8p0", "0x1.fffffffffffff7ffffp0", "0x1.00000000000008p1", "0x1.000000000000080000001p1", "0x0.0000000000000000000001p+99",
    "0x1p1023", "0x1p-1074", "+0xABCDEF0123456789abcdefp-8", "0x0", "-0x0p9", "0x8.p1", "0x0000000000000000000000001.5",
]


def test_hexadecimal_times(spark):
    rows = spark.createDataFrame([(i, f"{x},1,1,1,1,1") for i, x in enumerate([*HEXADECIMAL, "0x", "0x1p", "0xg", "0x1p1024", "0x1p-1080", "0x.p1", "0x1p99999999999"])], "i int, value string")
    found = {r["i"]: r["message"]["timestamp"] for r in text.parse(rows).where("message is not null").collect()}
    assert found == {i: float.fromhex(x) for i, x in enumerate(HEXADECIMAL)}


def test_files_keep_their_order_and_are_counted(spark, tmp_path):
    lines = [f"{100 - i}.5,{i % 7 + 1},{i},1,1,1" for i in range(500)] + BAD
    path = write(tmp_path / "m.csv", lines)
    found = text.read_messages(spark, path, "s").orderBy("seq").collect()
    assert [r["order_id"] for r in found] == list(range(500))
    assert [r["seq"] for r in found] == list(range(500))
    assert tuple(text.line_counts(text.read_lines(spark, path)).first()) == (500, len(BAD))
    s = text.ingest_summary(text.read_lines(spark, path))
    assert s.lines()[:3] == ["Parsed: 500", f"Malformed: {len(BAD)}", "Time range: 100.500000 - -399.500000"]
    assert s.counts == (72, 72, 72, 71, 71, 71, 71)
    counts = {r["event_type"]: r["n"] for r in text.event_counts(text.read_messages(spark, path)).collect()}
    assert tuple(counts[k] for k in range(1, 8)) == s.counts


def test_several_files_and_splits_make_one_order(spark, tmp_path):
    for k in range(3):
        write(tmp_path / f"{k}.csv", [f"{k},1,{k * 1000 + i},1,1,1" for i in range(200)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = text.read_messages(spark, str(tmp_path / "*.csv")).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["order_id"] for r in found] == [k * 1000 + i for k in range(3) for i in range(200)]


def test_missing_and_empty_files_have_no_messages(spark, tmp_path):
    assert text.read_messages(spark, str(tmp_path / "none.csv")).isEmpty()
    path = tmp_path / "empty.csv"
    path.write_text("")
    assert tuple(text.line_counts(text.read_lines(spark, str(path))).first()) == (0, 0)
    assert text.ingest_summary(text.read_lines(spark, str(path))).lines()[2] == "Time range: n/a"


STREAM = ["1,1,1,10,100,1", "2,1,2,20,110,-1", "3,4,1,4,100,1", "4,7,0,0,0,1"]


def test_csv_files(spark, tmp_path):
    m = text.read_messages(spark, write(tmp_path / "m.csv", STREAM))
    rows = analytics(m)
    out = tmp_path / "a.csv"
    write_analytics_csv(rows, str(out))
    lines = out.read_text().splitlines()
    assert lines[0].startswith("timestamp,best_bid,best_ask,spread,mid,bid_depth_1")
    assert lines[1] == "1.000000,100,,,,10,10,10,0,0,0,1.000000,,,"
    assert lines[3] == "3.000000,100,110,10,105.000000,6,6,6,20,20,20,-0.538462,100.000000,1.000000,0.000000"
    assert len(lines) == 5
    write_analytics(rows, str(tmp_path / "folder"))
    assert sum(len(p.read_text().splitlines()) - 1 for p in (tmp_path / "folder").glob("part-*.csv")) == 4
    report = tmp_path / "r.csv"
    write_prediction_report_csv(summarize_horizons(prediction_snapshots(rows), [2, 1]), str(report))
    assert report.read_text().splitlines()[1] == "2,4,3,0,1,3,0,0,0,0,0,0.000000,0.000000,0.000000"
    with pytest.raises(OSError):
        write_analytics_csv(rows, str(tmp_path / "no" / "a.csv"))


def test_output_paths():
    assert backend_output_path("a/b.x/out.csv", "map", True) == "a/b.x/out_map.csv"
    assert backend_output_path("a.b/out", "map", True) == "a.b/out_map.csv"
    assert backend_output_path("out.csv", "map", False) == "out.csv"


@pytest.mark.parametrize("value", ["", "1,,2", "0", "-3", "x", "2147483648", "1.5"])
def test_bad_horizons(value):
    with pytest.raises(cli.BadArguments):
        cli.horizons(value)


def test_arguments():
    o = cli.parse(["f", "--prediction-report-out", "r", "--prediction-horizons", " 5, 10"], cli._FLAGS, cli.Options())
    assert (o.path, o.prediction_horizons) == ("f", (5, 10))
    for bad in (["f", "--depth", "0"], ["f", "--repeat", "-1"], ["f", "g"], [], ["f", "--depth"], ["f", "--what", "1"], ["f", "--prediction-horizons", "5"], ["f", "--prediction-report-out", "r"], ["f", "--realized-vol-window-seconds", "-1"]):
        with pytest.raises(cli.BadArguments):
            cli.parse(bad, cli._FLAGS, cli.Options())
    assert cli.parse(["--dataset", "f", "--reserve", "off"], cli._TIME_FLAGS, cli.Options()).reserve == "off"
    with pytest.raises(cli.BadArguments):
        cli.parse(["--dataset", "f", "--reserve", "maybe"], cli._TIME_FLAGS, cli.Options())
    assert cli.selected_backends("both") == [Backend.RELATIONAL, Backend.STATEFUL]
    assert cli.selected_backends("vector") == [Backend.STATEFUL]
    assert cli.selected_backends("tree") == []


def test_command_line(spark, tmp_path, capsys):
    path = write(tmp_path / "m.csv", [*STREAM, "bad"])
    out, report = str(tmp_path / "a.csv"), str(tmp_path / "p.csv")
    assert cli.main([path, "--backend", "both", "--analytics-out", out, "--prediction-report-out", report, "--prediction-horizons", "1,2"]) == 0
    said = capsys.readouterr().out
    assert "Parsed: 4\nMalformed: 1\nTime range: 1.000000 - 4.000000\nEvent type counts: 1:2 2:0 3:0 4:1 5:0 6:0 7:1" in said
    assert "Final top: bid=100 x 6 (1) ask=110 x 20 (1) active_orders=2" in said
    one, two = (tmp_path / f"a_{b}.csv" for b in ("map", "flat_vector"))
    assert "Replay backend=map repeats=1 processed=4" in said
    assert "Replay backend=flat_vector" in said
    assert one.read_text() == two.read_text()
    assert len(one.read_text().splitlines()) == 5
    assert cli.main(["time", "--dataset", path, "--backend", "both", "--repeat", "5"]) == 0
    said = capsys.readouterr().out
    assert "Reserve hints reserve=off expected_orders=0 expected_levels_per_side=0" in said
    assert "Reserve hints reserve=on expected_orders=2 expected_levels_per_side=1" in said
    for backend in ("map", "flat_vector"):
        for mode in ("off", "on"):
            assert f"Replay backend={backend} reserve={mode} repeats=5 processed=20 " in said
    assert "avg_ns_per_msg=" in said
    assert cli.main([str(tmp_path / "none")]) == 1
    assert cli.main([path, "--backend", "tree"]) == 1
    assert cli.main([path, "--depth", "x"]) == 1
    assert cli.main(["--help"]) == 0


def test_help_needs_no_session():
    done = subprocess.run([sys.executable, "-m", "quaybook.cli", "--help"], capture_output=True, text=True, timeout=60)
    assert done.returncode == 0
    assert "usage:" in done.stdout
