"""Fixed notation rounds the number, not its shortest text."""

from __future__ import annotations

from lumisweep.functions.formatting import format_fixed


def test_numbers_next_to_a_middle(spark):
    values = [0.06545, 0.03235, 0.30065, 0.06555, -0.06545, 2.0, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    found = rows.select("i", format_fixed(rows.x, 4).alias("t")).orderBy("i").collect()
    assert [r.t for r in found] == ["0.0654", "0.0323", "0.3006", "0.0656", "-0.0654",
                                    "2.0000", None]
