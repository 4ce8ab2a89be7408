"""Pairs of elements are met at their common nodes and summed up there: they are not written or shuffled one by one."""

import re
from collections import Counter

from fixtures import block
from pyspark.sql import functions as F

from trellis import session
from trellis.operators import attributes


def test_retag_writes_no_pairs(spark, monkeypatch):
    """tables written are no longer than the mesh, and tags are as by counting."""
    sizes, keep = [], session.cut
    monkeypatch.setattr(session, "cut", lambda df: sizes.append(df.count()) or keep(df))
    mesh = block(spark)
    mesh = mesh.with_elements(mesh.elements.withColumn("tag", F.when(F.col("eid") % 5 == 0, 7).otherwise(F.col("tag"))))
    rows = {r.eid: (set(r.con), r.tag) for r in mesh.elements.collect()}
    want = {}
    for e, (con, tag) in rows.items():
        near = [(len(con & c), t) for o, (c, t) in rows.items() if o != e and con & c]
        votes = Counter(t for _, t in near)
        top = min(votes, key=lambda t: (-votes[t], t))
        want[e] = tag if sum(n >= 3 and t == tag for n, t in near) >= 1 else top
    assert {r.eid: r.tag for r in attributes.retag(mesh, 1, 3, rounds=1).elements.collect()} == want
    assert max(sizes) <= 40


def test_meshdata_shuffles_no_pairs(spark):
    """an element takes the source of most common nodes, without an aggregate over all pairs."""
    mesh = block(spark)
    source = mesh.with_elements(mesh.elements.withColumn("eid", F.lit(100) - F.col("eid")).withColumn("tag", F.col("eid")))
    rows = {r.eid: set(r.con) for r in source.elements.collect()}
    half = mesh.with_elements(mesh.elements.withColumn("con", F.when(F.col("eid") % 2 == 0, F.array(F.get("con", F.lit(0)), F.lit(13).cast("long"), F.get("con", F.lit(1)), F.lit(26).cast("long"))).otherwise(F.col("con"))))
    for least in (1, 2, 4):
        got = attributes.insert_meshdata(half, source, "tags", least).elements
        assert not re.search(r"Aggregate \[eid#\d+L?, src#", got._jdf.queryExecution().optimizedPlan().toString())
        for r in half.elements.join(got.select("eid", F.col("tag").alias("new")), "eid").collect():
            shared = {s: len(set(r.con) & c) for s, c in rows.items() if len(set(r.con) & c) >= least}
            if len(set(r.con)) == 4:
                assert r.new == (min(shared, key=lambda s: (-shared[s], s)) if shared else r.tag)
