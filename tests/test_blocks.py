"""Wide matrices for more files than a plan can have columns."""

import csv

from mzloom.operators import quant
from mzloom.sources import sinks


def test_twenty_thousand_files(spark, tmp_path):
    n = 20_000
    cells = {("a,b", 0): 1.5, ("a,b", 255): 2.0, ("a,b", 256): 3.0, ("a,b", 19_999): 4.0, ("x", 10_000): 5.25, ("x", 19_968): 6.0}
    members = spark.createDataFrame([(c, f, v) for (c, f), v in cells.items()] + [("x", 10_000, 9.0)], "cluster_id string, file int, height double")
    places = spark.range(n).selectExpr("cast(id as int) file", "cast(id as int) place")
    blocks = quant.block_matrix(members, "height", places)
    assert blocks.count() == 5
    names = [f"run {k}" for k in range(n)]
    sinks.write_wide_csv(quant.wide_lines(blocks, n, "cluster_id"), ["cluster_id"], names, str(tmp_path / "wide"))
    rows = {}
    for f in (tmp_path / "wide").glob("part-*"):
        lines = list(csv.reader(f.read_text().splitlines()))
        if lines:
            assert lines[0] == ["cluster_id", *names]
            rows |= {r[0]: r[1:] for r in lines[1:]}
    assert rows.keys() == {"a,b", "x"} and all(len(r) == n for r in rows.values())
    assert {(c, k): float(v) for c, r in rows.items() for k, v in enumerate(r) if float(v)} == cells
    total = quant.sum_blocks(blocks.selectExpr("'all' what", "block", "values"), "what").collect()
    assert sum(sum(r["values"]) for r in total) == sum(cells.values()) and len(total) == 4


def test_blocks_of_some_files(spark):
    members = spark.createDataFrame([(1, k, float(k + 1)) for k in range(3)], "cluster_id long, file int, height double")
    places = spark.range(3).selectExpr("cast(id as int) file", "cast(id as int) place")
    assert quant.wide_lines(quant.block_matrix(members, "height", places), 3, "cluster_id").first().line == "1.0,2.0,3.0"
    assert quant.block_matrix(members.limit(0), "height", places).count() == 0
