"""Steps that look up the nodes of elements, and what they give to refinement, surfaces and patterns."""

from collections import Counter

import pytest
from fixtures import block

from trellis.model import Mesh, gather, with_points
from trellis.operators import select, stats, surface


def pts(df):
    return {r.eid: [tuple(p) for p in r.pts] for r in df.collect()}


def test_gather_sends_each_row_once_to_a_block(spark):
    rows = [(1, [5, 7]), (2, [7, 7, 5]), (3, [5, 99]), (4, []), (5, None), (None, [5]), (2**62 + 3, [8]), (-(2**40), [7]), (9, [6])]
    df = spark.createDataFrame(rows, "k long, ids array<long>")
    table = spark.createDataFrame([(5, 0.5), (6, 0.6), (6, 0.7), (7, None), (8, 0.8)], "id long, v double")
    got = {r.k: r.out for r in gather(df, "ids", "k", table, "out").collect()}
    assert got == {1: [0.5, None], 2: [None, None, 0.5], 2**62 + 3: [0.8], -(2**40): [None]}  # 6 is there twice, 99 not at all
    kept = {r.k: r.out for r in gather(df, "ids", "k", table, "out", whole=False).collect()}
    assert len(kept) == 8 and kept[3] == [0.5, None] and kept[4] == [] and kept[9] == [None]


@pytest.mark.parametrize("refine", [select.uniform_refinement, select.centre_refinement, lambda mesh: select.resample(mesh, 600.0)])
def test_refined_meshes_carry_their_points(spark, refine):
    """the points of the parts are those that a lookup gives."""
    fine = refine(block(spark))
    assert fine.spots is not None
    found = pts(fine.points)
    assert found == pts(with_points(fine.elements, "con", "eid", fine.nodes)) and len(found) == fine.elements.count() > 40
    assert fine.nodes.count() == fine.nodes.select("nid").distinct().count()


def test_boundary_sums_up_fixed_numbers(spark):
    """whole faces are not sorted; a face of three elements belongs to the greatest."""
    mesh = block(spark)
    more = spark.createDataFrame([(70, "Tt", [0, 1, 3, 26], 8, []), (71, "Hx", [0, 1, 4, 3, 9, 10, 13, 12], 9, [])], "eid long, etype string, con array<long>, tag long, fib array<double>")
    both = Mesh(mesh.nodes, mesh.elements.unionByName(more))
    rows = surface.boundary(both)
    assert "SortAggregate" not in rows._jdf.queryExecution().executedPlan().toString()
    seen = {}
    for r in both.faces.join(both.elements.select("eid", "tag"), "eid").collect():
        seen.setdefault(tuple(r.fkey), []).append((r.eid, r.fpos, r.tag, tuple(r.face)))
    want = {k: max(v) for k, v in seen.items() if len(v) % 2}
    assert {tuple(r.fkey): (r.eid, r.tag, tuple(r.face)) for r in rows.collect()} == {k: (e, t, f) for k, (e, _, t, f) in want.items()}


def test_pattern_makes_half_of_the_pairs(spark):
    """F27."""
    mesh = block(spark)
    df = stats.pattern(mesh, 3, 5)
    assert "<=" in df._jdf.queryExecution().optimizedPlan().toString()
    pairs = {(a, b) for r in mesh.elements.collect() for a in r.con for b in r.con}
    assert {(r.row, r.col): r.n for r in df.collect()} == Counter((a * 3 // 27, b * 5 // 27) for a, b in pairs)
