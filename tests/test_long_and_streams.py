"""Sweeps read in blocks, and a rollup kept by a stream, against the plain jobs."""

import pytest
from pyspark.sql import functions as F

from lumisweep.operators.rollup import rollup_mean_of_ratios
from lumisweep.plans.jobs import SWEEP_KEYS
from lumisweep.sources import sweeps
from lumisweep.streaming import merge
from lumisweep.streaming import readout as stream


def _sweep(cutoff, points=60, end="\n", last=True):
    head = ["Type;demo", "Date;none", "Trace;1;"]
    rows = [f"{(i + 1) * 10_000_000};{0.0 if (i + 1) * 10 < cutoff else -3.0:.4f};".replace(".", ",")
            for i in range(points)]
    text = end.join(head + rows + ["end;0"] * 11)
    return text + end if last else text


@pytest.fixture
def folder(tmp_path):
    texts = {"OPA_RO85_part6_001.CSV": _sweep(140), "OPA_RO85_part6_002.CSV": _sweep(150, end="\r\n"),
             "OPA_RO9_part10_001.CSV": _sweep(200, 3000, last=False),
             "OPB_RO3_part14_001.CSV": _sweep(90, 2500, "\r\n"), "OPB_RO4_part4_001.CSV": _sweep(90),
             "OPB_RO7_part7_001.CSV": "too;short\n", "OPB_RO8_part8_001.CSV": "",
             "notes.CSV": "nothing"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    return tmp_path


@pytest.mark.parametrize("options", [
    {}, {"max_rows": 20, "skip_foot": 0}, {"round_after_unit": True, "exclude_parts": ()},
    {"to_mhz": False, "digits": None}])
@pytest.mark.parametrize("block", [512, 4099, 128 << 20])
def test_blocks_give_the_samples_of_whole_files(spark, folder, options, block):
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        found = sweeps.read_long_sweeps(spark, str(folder), **options)
        whole = sweeps.read_sweeps(spark, str(folder), **options)
        ours = sorted(map(tuple, found.select(*whole.columns).collect()), key=repr)
        assert ours == sorted(map(tuple, whole.collect()), key=repr)
        blocks = (spark.read.text(str(folder), pathGlobFilter="OPA_RO9_*")
                  .select("_metadata.file_block_start").distinct().count())
        assert blocks > 1 or block > 4099
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def _rows(df):
    return sorted((r["operator"], r["run_order"], r["part"], r["repeats"], round(r["cutoff_mhz"], 6),
                   round(r["risetime_ps"], 6)) for r in df.collect())


def test_stream_rollup_survives_restarts_and_repeated_files(spark, tmp_path):
    """Late repeats correct their key; a file fed twice, and a batch run twice, count once."""
    new, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def feed(folder, name, cutoff):
        (new / folder).mkdir(parents=True, exist_ok=True)
        (new / folder / name).write_text(_sweep(cutoff))

    def run():
        files = stream.stream_sweep_files(spark, f"{new}/*", files_per_trigger=2)
        query = merge.start_rollup(stream.stream_readout(files), out, state, availableNow=True)
        query.awaitTermination()

    feed("a", "OPA_RO1_part6_001.CSV", 140)
    feed("a", "OPA_RO1_part6_002.CSV", 160)
    feed("a", "OPA_RO2_part7_001.CSV", 100)
    run()
    assert [r[:4] for r in _rows(merge.current_rollup(spark, out))] == [
        ("OPA", 1, 6, 2), ("OPA", 2, 7, 1)]
    feed("b", "OPA_RO1_part6_003.CSV", 300)      # a late repeat
    feed("b", "OPA_RO2_part7_001.CSV", 100)      # fed again
    feed("b", "OPB_RO5_part9_001.CSV", 220)
    run()
    run()
    found = _rows(merge.current_rollup(spark, out))

    distinct = tmp_path / "all"
    distinct.mkdir()
    for path in sorted(new.glob("*/*.CSV")):
        (distinct / path.name).write_bytes(path.read_bytes())
    results = stream.stream_readout(sweeps.sweep_files(spark, str(distinct)))
    plain = rollup_mean_of_ratios(results, SWEEP_KEYS).join(
        results.groupBy(*SWEEP_KEYS).agg(F.count("*").alias("repeats")), SWEEP_KEYS)
    assert found == _rows(plain) and found[0][3] == 3

    # The last batch once more, as after a crash before its offset was committed.
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "files").glob("batch=*"))
    again = spark.read.parquet(f"{out}/files").where(F.col("batch") == last).drop("batch")
    rows = spark.createDataFrame(again.collect(), again.schema)
    merge.merge_into(out)(rows, last)
    assert _rows(merge.current_rollup(spark, out)) == found
