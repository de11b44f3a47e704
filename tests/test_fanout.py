"""Messages to subscriptions: pairs of lists, dealt over tasks."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.operators import alerts as A


@pytest.mark.parametrize("sizes", [(256, 1000, 16), (2, 3, 1)])
def test_pairs_come_from_many_tasks(spark, monkeypatch, sizes):
    for name, value in zip(("GROUPS", "SLICE", "CHUNKS"), sizes, strict=True):
        monkeypatch.setattr(A, name, value)
    subs = [(f"c{i % 37}" if i % 9 else None, "u" if i % 10 == 0 else "t", f"a{i % 4}" if i % 3 else None) for i in range(90)] + [("c1", None, None)]
    messages = [(f"m{i % 50}" if i % 8 else None, "t" if i % 6 else None, f"a{i % 5}" if i % 7 else None) for i in range(120)] + [("m0", "u", "a1"), ("m0", "v", "a1")]
    s = spark.createDataFrame(subs, "connection_id string, subscription_type string, agent_filter string")
    m = spark.createDataFrame(messages, "message_id string, message_type string, agent_id string")
    want = Counter((x, t, a, c) for x, t, a in messages for c, u, f in subs if t is not None and t == u and (a is None or f is None or f == a))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for long lists of connections
    try:
        rows = A.route_to_subscriptions(m, s).select("*", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert Counter(tuple(r)[:4] for r in rows) == want
    assert len({r["task"] for r in rows}) > 2
