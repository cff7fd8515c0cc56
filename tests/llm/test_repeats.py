"""Repeated query ids and hot rows in top-k; slots without a second exchange of the rows."""

from tidewire.llm import sharding, topk


def brute(rows, asks, k):
    """(query vector, rank, vec_id, score) by the definition."""
    x = [(j, [int(256 * c) for c in v]) for j, v in rows]
    out = set()
    for q, v in asks:
        own = [int(256 * c) for c in v]
        scored = sorted((-sum(a * b for a, b in zip(own, w)), j) for j, w in x if j != q)
        out |= {(q, tuple(v), rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)}
    return out


def test_rows_of_one_query_id_are_asked_apart(spark):
    rows = [(i, [float(i % 7), float(i % 5), float(-i % 3)]) for i in range(60)] + [(9, [8.0, 8.0, 8.0])] * 300
    asks = [(50, [1.0, 0.0, 0.0]), (50, [0.0, -1.0, 0.5]), (50, [1.0, 0.0, 0.0]), (9, [1.0, 1.0, 1.0])]
    df = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>")
    got = topk.top_k(df(rows), df(asks)).collect()
    # queries of an id are numbered in the order of their vectors
    numbered = {}
    for q, v in sorted({(q, tuple(v)) for q, v in asks}):
        numbered[len(numbered)] = (q, v)
    assert {(*numbered[r.asked], r.rank, r.vec_id, r.score) for r in got} == brute(rows, asks, topk.K)
    assert len(got) == 3 * topk.K


def test_places_of_queries_are_the_same_in_every_shard(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 8)
    monkeypatch.setattr(topk, "QUERIES", 2)
    test_rows_of_one_query_id_are_asked_apart(spark)


def test_slots_are_given_without_a_second_exchange_of_the_rows(spark):
    rows = spark.range(500).selectExpr("id as doc_id", "repeat('x ', cast(id % 40 as int)) as text")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = sharding.shard_documents(rows, piece_bytes=200)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    got = out.select("doc_id", "shard", "slot").toPandas()
    assert got.doc_id.nunique() == 500 and all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
