"""Rows of pipe tables are found once, however many steps read them."""

from clausemill.operators import tables


def test_table_rows_are_found_once(spark):
    lines = spark.createDataFrame([(1, 0, "Description | Unit | Value"), (1, 1, "Pump | kW | 5"), (1, 2, "Notes"), (2, 0, None)], "doc long, line_no int, line string")
    got = tables.linearize_tables(lines)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [lag" not in plan and "lag(" not in plan
    said = {(r.doc, r.line_no): r.line for r in got.collect()}
    assert said == {(1, 0): "", (1, 1): "Pump: 5 kW.", (1, 2): "Notes", (2, 0): None}
