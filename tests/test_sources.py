"""Files: sweeps, reports, plan, results, sinks and the stream, on small written samples."""

import math

import pytest
from measured import result_files
from pyspark.sql import functions as F

from lumisweep.functions import formatting, rounding
from lumisweep.operators import rollup
from lumisweep.operators.readout import unpack_sweep
from lumisweep.plans import jobs, views
from lumisweep.sources import reports, sinks, sweeps, tables
from lumisweep.streaming import readout as stream

RESULTS = result_files()
LEVELS = [0, .1, 0, -.1, 0, -1, -2.9, -4, -6, -9]


def sweep_text(levels=LEVELS, end="\n", last=True):
    lines = ["Type;x", "Date;y", "Trace;1;"]
    lines += [f"{20_000_000 * (i + 1)};{str(float(a)).replace('.', ',')};"
              for i, a in enumerate(levels)]
    lines += ["end;0"] * 11
    return end.join(lines) + (end if last else "")


@pytest.fixture
def sweep_dir(tmp_path):
    def put(name, text):
        (tmp_path / name).write_bytes(text.encode())
    put("OPA_RO85_part6_001.CSV", sweep_text())
    put("OPA_RO85_part6_002.CSV", sweep_text(end="\r\n"))
    put("OPA_RO9_part10_001.CSV", sweep_text(last=False))
    put("OPB_RO90_part4_001.CSV", sweep_text())
    put("OPB_RO3_part14_001.CSV", sweep_text(["x"] and [0, 0, 0, 0, 0, -3, -9]))
    put("notes.CSV", "nothing")
    put("OPB_RO7_part7_001.CSV", "too;short\n")
    put("OPA_RO85_part6_003.txt", sweep_text())
    return str(tmp_path)


def test_sweep_files(spark, sweep_dir):
    files = sweeps.sweep_files(spark, sweep_dir)
    assert [r["file"] for r in sweeps.rejected_files(files).collect()] == ["notes.CSV"]
    packed = {r["file"]: r for r in sweeps.packed_sweeps(files).collect()}
    assert set(packed) == {"OPA_RO85_part6_001.CSV", "OPA_RO85_part6_002.CSV",
                           "OPA_RO9_part10_001.CSV", "OPB_RO3_part14_001.CSV",
                           "OPB_RO7_part7_001.CSV"}
    one = packed["OPA_RO85_part6_002.CSV"]
    assert (one["operator"], one["run_order"], one["part"], one["repeat"]) == ("OPA", 85, 6, "002")
    assert [p["a"] for p in one["points"]] == LEVELS
    assert [p["f"] for p in one["points"]][:2] == [20.0, 40.0]
    assert packed["OPB_RO7_part7_001.CSV"]["points"] == []
    assert packed["OPA_RO9_part10_001.CSV"]["points"] == one["points"]
    assert sweeps.read_sweeps(spark, sweep_dir).count() == 37
    single = sweeps.read_sweeps(spark, f"{sweep_dir}/OPA_RO85_part6_001.CSV", max_rows=4)
    assert single.count() == 4


def test_readout_jobs(spark, sweep_dir):
    rows = {(r["operator"], r["run_order"], r["part"]): r
            for r in jobs.readout_job(spark, sweep_dir).collect()}
    assert rows["OPA", 85, 6]["cutoff_mhz"] == 140 and rows["OPA", 85, 6]["risetime_ps"] == 2500
    assert rows["OPB", 7, 7]["cutoff_mhz"] is None
    mean = {r["part"]: r for r in jobs.averaged_readout_job(spark, sweep_dir, 8, 100).collect()}
    assert mean[6]["device"] == "2189_02" and mean[6]["cutoff_mhz"] == 140
    assert mean[4]["ubr_V"] == 118.0 and mean[14]["device"] is None


def test_stream_gives_the_batch_result(spark, sweep_dir, tmp_path):
    files = stream.stream_sweep_files(spark, sweep_dir)
    query = (stream.stream_readout(files).writeStream.format("memory").queryName("readout_stream")
             .outputMode("append").start())
    query.processAllAvailable()
    query.stop()
    got = {r["file"]: (r["cutoff_mhz"], r["risetime_ps"])
           for r in spark.table("readout_stream").collect()}
    assert got["OPA_RO85_part6_001.CSV"] == (140.0, 2500.0) and len(got) == 5


REPORT = """[Allgemein]
Datum:;01.02.2022
Bauteil:;PD {n}

Charge:;FA{n}
Wafer:;W1;ignored
Bauteil-Nr.:
Temperatur:;25,0
[Einstellungen Messung]
Filter Counts:;10
Delay:;0,1
[Messwerte]
Kurve
Wellenlänge [nm];Empfindlichkeit [A/W];{extra};
400;0,125;{n};
410;0,25;x;
"""


def test_reports(spark, tmp_path):
    (tmp_path / "a1.csv").write_text(REPORT.format(n=1, extra="RunOrder"), encoding="utf-8")
    (tmp_path / "a2.csv").write_text(REPORT.format(n=2, extra="Id Kanal-A"), encoding="utf-8")
    (tmp_path / "bad.csv").write_text("[Allgemein]\nDatum:;x\n", encoding="utf-8")
    (tmp_path / "latin.csv").write_bytes(REPORT.format(n=3, extra="").encode("latin-1"))
    lines = reports.report_lines(spark, str(tmp_path), pattern="{a*,bad}.csv")
    assert [tuple(r) [::2] for r in reports.report_errors(lines).collect()] == [
        ("bad.csv", "no recipe section")]
    header = {r["file"]: r for r in reports.report_header(lines).collect()}
    assert header["a1.csv"]["article_name"] == "PD 1" and header["a1.csv"]["wafer_batch"] == "W1"
    assert header["a2.csv"]["device_nr"] is None and header["a2.csv"]["temperature"] == "25,0"
    recipe = reports.report_recipe(lines).first()
    assert recipe["filter_counts"] == "10" and recipe["voltage"] is None
    assert sorted(r["name"] for r in reports.report_columns(lines).collect()) == ["empfindlichkeit", "id_kanal_a", "run_order",
                                             "wellenlange"]
    data = reports.report_data(lines, ["wellenlange", "empfindlichkeit", "run_order"])
    rows = sorted(tuple(r)[2:] for r in data.where("file = 'a1.csv'").collect())
    assert rows == [(0, 400.0, 0.125, 1.0), (1, 410.0, 0.25, None)]
    assert data.where("file = 'a2.csv' and run_order is not null").count() == 0
    assert reports.report_values(lines).count() == 12
    ids = {r["path"][-6:]: r["header_id"] for r in reports.header_ids(lines).collect()}
    assert ids == {"a1.csv": 1, "a2.csv": 2}
    joined = reports.measured_with_header(data, reports.report_header(lines))
    assert joined.where("fa_nr = 'FA2'").count() == 2
    latin = reports.report_lines(spark, str(tmp_path), "latin.csv", charset="ISO-8859-1")
    assert reports.report_data(latin).where("wellenlange is not null").count() == 2


def test_plan_and_assignment(spark, tmp_path):
    (tmp_path / "plan.csv").write_text("ï Run.Order;Parts;Std Order\n1;6;4\n2;11;5\n")
    plan = tables.read_run_plan(spark, str(tmp_path / "plan.csv"))
    assert plan.columns == ["RunOrder", "parts", "std_order"]
    done = tables.plan_with_devices(plan)
    assert done.columns == ["Runorder", "Parts", "Std_order", "Device", "Ubr_v", "Done"]
    assert [tuple(r)[3:] for r in done.orderBy("Runorder").collect()] == [
        ("2189_02", 149.0, ""), (None, None, "")]
    sinks.write_plan_table(done, str(tmp_path / "out"), "Runorder")
    text = next((tmp_path / "out").glob("part-*.csv")).read_text().splitlines()
    assert text[1].startswith('"1" "1" "6" "4" "2189_02"')
    (tmp_path / "z.csv").write_text("fa_nr;wafer_charge;wafer_nr;facility\n01;W;3;X\n")
    assert tuple(tables.read_assignment(spark, str(tmp_path / "z.csv")).first()) == (
        "01", "W", 3, "X")


@pytest.mark.skipif(not RESULTS["repeats"], reason="result files are not here")
def test_golden_rollup(spark):
    keys = ["Operators", "Runoders", "Part"]
    repeats = tables.read_results(spark, str(RESULTS["repeats"][0]))
    assert repeats.count() == 180
    got = rollup.rollup_ratio_of_means(repeats, keys, "Cutoff_MHz").orderBy(*keys).collect()

    def equal(path):
        want = tables.read_results(spark, str(path)).orderBy(*keys).collect()
        return len(got) == len(want) == 36 and all(
            tuple(a)[:3] == tuple(b)[:3] and tuple(a)[3:] == pytest.approx(tuple(b)[3:], abs=1e-9)
            for a, b in zip(got, want))

    # The rollups of another readout method lie next to the ones of this method.
    assert [equal(p) for p in RESULTS["rollups"]].count(True) == 2


@pytest.mark.skipif(not RESULTS["rollups"], reason="result files are not here")
def test_text_form_of_results(spark, tmp_path):
    for i, source in enumerate(RESULTS["rollups"]):
        out = tmp_path / str(i)
        sinks.write_decimal_comma_csv(tables.read_results(spark, str(source)), str(out),
                                      order=["Operators", "Runoders", "Part"], single_file=True)
        written = next(out.glob("part-*.csv")).read_text()
        assert written.splitlines() == source.read_text().splitlines()


def test_numbers_and_names(spark):
    df = spark.createDataFrame([(2.5, 0.285, 1.005)], "a double, b double, c double")
    row = df.select(rounding.round_even(F.col("a"), 0), rounding.round_even(F.col("b"), 2),
                    rounding.round_even(F.col("c"), 2)).first()
    assert tuple(row) == (2.0, 0.28, 1.0)
    values = [123456.0, 0.00012, 1.5e-6, 15e-9, 380e-6, 0.0, -2.5e4, 999.99999996]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(formatting.format_eng(F.col("x")), formatting.format_si(F.col("x"), "m"))
    assert [tuple(r) for r in got.collect()] == [
        ("123.456e3", "123.456km"), ("120e-6", "120um"), ("1.5e-6", "1.5um"), ("15e-9", "15nm"),
        ("380e-6", "380um"), ("0e0", "0m"), ("-25e3", "-25km"), ("1e3", "999.99999996m")]
    text = spark.createDataFrame([(1.5,), (12345678.25,), (0.00025,), (100.0,)], "x double").select(
        rounding.double_to_decimal_comma(F.col("x"))).collect()
    assert [r[0] for r in text] == ["1,5", "12345678,25", "0,00025", "100,0"]
    for raw, want in [("Wellenlänge [nm]", "wellenlange"), ("RunOrder", "run_order"),
                      ("Id Kanal A [A] ", "id_kanal_a")]:
        assert formatting.clean_name(raw) == want
        assert spark.range(1).select(formatting.clean_name_column(F.lit(raw))).first()[0] == want


def test_fit_and_comparison_jobs(spark, tmp_path):
    """Poles of 200 and 300 MHz are read back from files of 620 samples."""
    for name, pole in (("OPA_RO1_part5_001", 200.0), ("OPA_RO1_part5_002", 200.0),
                       ("OPB_RO2_part6_001", 300.0)):
        level = [-20 * math.log10(1 + (2.0 * i / pole) ** 2) for i in range(1, 621)]
        lines = ["a", "b", "Trace;1;"] + [
            f"{2_000_000 * i};{y:.8f};".replace(".", ",") for i, y in enumerate(level, 1)]
        (tmp_path / f"{name}.CSV").write_text("\n".join(lines + ["end;0"] * 11) + "\n")
    fitted = {r["part"]: r for r in jobs.lowpass_job(spark, str(tmp_path)).collect()}
    for part, pole in ((5, 200.0), (6, 300.0)):
        assert fitted[part]["cutoff_mhz"] == pytest.approx(pole, abs=0.11)
        assert fitted[part]["risetime_ps"] == pytest.approx(0.35e6 / pole, rel=1e-3)
    rational = {r["part"]: r["cutoff_mhz"] for r in jobs.rational_job(
        spark, str(tmp_path), fmin=20.0, fmax=40.0).collect()}
    assert set(rational) == {5, 6} and all(v > 0 for v in rational.values())
    tables = jobs.comparison_job(spark, str(tmp_path), fmin=2.0, fmax=20.0)
    assert tables["summary"].where("level = 'part'").count() == 2
    assert sum(r["n"] for r in tables["bands"].collect()) == 2


def test_line_ends_are_cut_as_by_one_pattern(spark):
    ends = ["", "\n", "\r\n", "\r", "\n\n", "\r\n\r\n", "\n\r\n", "\n\r", "\r\r\n", "\n\n\n"]
    texts = [(start + end,) for start in ("", "a", "ab;c", "a\nb\r\nc\rd", "\r\n\nx") for end in ends]
    rows = spark.createDataFrame([*texts, (None,)], "text string").select(
        "text", sweeps.lines_of(F.col("text")).alias("got"), F.split(F.regexp_replace(
            "text", "(?:\r\n|\n|\r)$", ""), "\r\n|\n|\r").alias("expected")).collect()
    assert [r["text"] for r in rows if r["got"] != r["expected"]] == []


def test_lines_become_rows_before_they_are_parsed(spark, sweep_dir):
    files = sweeps.sweep_files(spark, sweep_dir)
    for options in ({}, {"skip_foot": 0, "max_rows": 5, "round_after_unit": True},
                    {"exclude_parts": ()}):
        rows = sweeps.sweep_samples(files, **options)
        packed = unpack_sweep(sweeps.packed_sweeps(files, **options)).select(*rows.columns)
        assert rows.count() == packed.count() > 0
        assert rows.exceptAll(packed).isEmpty() and packed.exceptAll(rows).isEmpty()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan


def _expected_text(key, size, points):
    lines = ["Type;demo", "Date;none", "Trace;1;"]
    for i in range(1, points + 1):
        f = 10.0 * i
        ripple = (math.fmod(key * 37 + i * 101, 97) / 97 - 0.5) * 0.1
        a = -20 * math.log10(1 + (f / (200 + 5 * size)) ** 2) + ripple
        lines.append(f"{round(f * 1e6)};{a:.4f};".replace(".", ","))
    return "\n".join([*lines, *["end;0"] * 11]) + "\n"


def test_equal_texts_are_written_once(spark, tmp_path):
    # Keys of one remainder, far apart, negative, without a number, and rows that come twice.
    parts = [(k, s) for k in (5, 102, 199, 5 + 97 * 10_000, -92, -189) for s in (3, 4)]
    parts += [(5, 3), (102, 3), (None, 3), (7, None)]
    spark.createDataFrame([(k, "B", s) for k, s in parts],
                          "p_partkey long, p_brand string, p_size int").write.parquet(
        str(tmp_path / "part.parquet"))
    texts = views.sweep_texts(spark, str(tmp_path))
    got = sorted((r["file"], r["content"]) for r in texts.collect() if r["file"])
    name = "OP{0}_RO{1}_part{2:.0f}_{3:.0f}.CSV"
    expected = sorted((name.format(k, s, 1 + math.fmod(k, 10), 0).rsplit("_", 1)[0],
                       _expected_text(k, s, views.DEVICE_POINTS)) for k, s in parts
                      if k is not None and s is not None)
    assert [(f.rsplit("_", 1)[0], c) for f, c in got] == expected
    assert texts.count() == len(parts)
    # Three of the positive keys share a text for each size.
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and plan.index("Generate") < plan.index("transform(")
