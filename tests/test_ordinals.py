from pyspark.sql import functions as F

from tagweave.operators import sampling as SA


def _skewed(spark):
    # group 0 holds most rows; order values are distinct inside each group
    rows = [(0, i, float((i * 37) % 101)) for i in range(700)] + [(g, i, float(i)) for g in range(1, 6)
                                                                    for i in range(20)]
    return spark.createDataFrame(rows, "g long, t long, v double")


def test_dense_ids_many_partitions(spark):
    df = _skewed(spark)
    got = SA.dense_ids(df, ["g", "t"], "id", num_partitions=7).select("g", "t", "id").collect()
    exp = {(g, t): i for i, (g, t) in enumerate(sorted((r.g, r.t) for r in df.collect()))}
    assert {(r.g, r.t): r.id for r in got} == exp


def test_group_dense_ids_hot_group(spark):
    df = _skewed(spark)
    got = SA.group_dense_ids(df, ["g"], ["t"], "k", num_partitions=7).collect()
    assert all(r.k == r.t for r in got)          # t runs 0..n-1 inside every group
    assert len(got) == 800


def test_group_running_max_before(spark):
    df = _skewed(spark)
    got = {(r.g, r.t): r.m for r in SA.group_running_max_before(df, ["g"], ["t"], "v", "m", num_partitions=7)
           .collect()}
    rows = sorted((r.g, r.t, r.v) for r in df.collect())
    best = {}
    for g, t, v in rows:
        assert got[(g, t)] == best.get(g)
        best[g] = v if g not in best else max(best[g], v)


def test_prefix_offsets(spark):
    df = spark.createDataFrame([(i, i % 5 + 1) for i in range(50)], "k long, w long")
    got = {r.k: r.offset for r in SA.prefix_offsets(df, "k", "w", "offset", num_partitions=6).collect()}
    run = 0
    for i in range(50):
        assert got[i] == run
        run += i % 5 + 1


def test_file_order_ids(spark, tmp_path):
    p = tmp_path / "lines"
    p.mkdir()
    for j in range(3):
        (p / f"part-{j}.txt").write_text("".join(f"f{j}-{i}\n" for i in range(5)))
    raw = (spark.read.text(str(p)).select("value", F.col("_metadata.file_path").alias("__file"),
                                          F.col("_metadata.file_block_start").alias("__blk")))
    got = sorted((r.id, r.value) for r in SA.file_order_ids(raw, "id").collect())
    assert [v for _, v in got] == [f"f{j}-{i}" for j in range(3) for i in range(5)]
    assert [i for i, _ in got] == list(range(15))
