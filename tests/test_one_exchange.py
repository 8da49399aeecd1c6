"""The resolution map reads its cells once and exchanges them once per kernel."""

from tarnfield.operators import blocks
from tarnfield.operators.grid import GridSpec
from tarnfield.plans import adapters as A


def test_the_cell_table_is_read_once(spark):
    cells = A.scene(spark, "/root/testdata/sf0.001")
    final = blocks.balance(blocks.coarsen(blocks.ceilings(cells, GridSpec(40, 50), core_m=2.5, mid_m=5.5)))
    plan = final._jdf.queryExecution().sparkPlan().toString()
    ready = final._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("FlatMapGroupsInPandas") == 3 and plan.count("FileScan") == 1
    assert ready.count("Exchange hashpartitioning") <= 3 and "Join" not in plan
