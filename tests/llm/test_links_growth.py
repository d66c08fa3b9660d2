"""Probes and points of fingerprints are joined by shuffles: Spark takes them for as few as the fingerprints are."""

from colweave.llm import simhash as H


def test_probes_arent_broadcast(spark, monkeypatch):
    plans, plain = [], H.settle

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(H, "settle", kept)
    fps = plain(spark.createDataFrame([(x,) for x in (0, 1, 3, 7, 1 << 40, 1 << 41, -1)], "fp bigint"), "fps")
    found = H.links(fps, bucket=2)
    assert "Broadcast" not in "".join([*plans, found._jdf.queryExecution().executedPlan().toString()])
    from colweave.llm.components import components

    groups = {r.node: r.component for r in components(found).collect()}
    assert groups == {x: 0 for x in (0, 1, 3, 7, 1 << 40, 1 << 41)}
