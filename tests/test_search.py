import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.functions import types as T
from quiver.functions import vectors as V
from quiver.operators import hnsw, ivf, knn, projection, quantize
from quiver.plans import planner, queries
from quiver.sources import files
from quiver.streaming import ingest

SMALL = [(1, [0.0, 0.0, 0.0]), (2, [1.0, 2.0, 3.0]), (3, [1.0, 1.0, 1.0]), (4, None), (5, [1.0, 2.0, 4.0])]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(SMALL, "id long, v array<float>")


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(3).random((4000, 3)).astype(np.float32)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").cache()


@pytest.mark.parametrize(("metric", "order"), [("l2", [2, 5, 3, 1, 4]), ("ip", [5, 2, 3, 1, 4]), ("l1", [2, 5, 3, 1, 4])])
def test_exact_order(small, metric, order):
    assert [r.id for r in knn.knn(small, "v", [3.0, 3.0, 3.0], 5, metric).collect()] == order


def test_cosine_puts_nan_after_numbers(small):
    assert [r.id for r in knn.knn(small, "v", [3.0, 3.0, 3.0], 5, "cosine").collect()] == [3, 2, 5, 1, 4]


def test_null_query(small):
    got = knn.knn(small, "v", None, 10).collect()
    assert len(got) == 5 and all(r.distance is None for r in got)


def test_plan_is_a_partial_top_k(small):
    plan = knn.knn(small, "v", [3.0, 3.0, 3.0], 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_knn_join_is_exact(cloud):
    asked = cloud.where("id % 400 = 0")
    for metric in ("l2", "ip", "cosine", "l1"):
        got = {(r.qid, r.id) for r in knn.knn_join(cloud, asked, "v", "id", 7, metric).collect()}
        for q in asked.collect():
            want = [r.id for r in knn.knn(cloud, "v", q.v, 7, metric).collect()]
            assert {i for a, i in got if a == q.id} == set(want)


@pytest.fixture(scope="module")
def index(cloud, tmp_path_factory):
    return ivf.build(cloud, str(tmp_path_factory.mktemp("ivf")), "v", "id", lists=50)


def test_ivf_recall(cloud, index):
    asked = cloud.where("id % 200 = 0")
    truth = knn.knn_join(cloud, asked, "v", "id", 20)
    floors = {1: 0.5, 10: 0.95, 50: 1.0}
    for probes, floor in floors.items():
        assert knn.recall(index.search_many(asked, 20, probes, "v"), truth, 20).first()[0] >= floor


def test_ivf_scan_prunes_partitions(index):
    plan = index.search([0.5, 0.5, 0.5], 5, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list_id" in plan


def test_ivf_iterative(index):
    few = index.search([0.5, 0.5, 0.5], 11, 1, "relaxed_order", where=lambda d: d.where("id % 400 = 0")).collect()
    assert len(few) == 10
    assert len(index.search([0.5, 0.5, 0.5], 11, 1, "relaxed_order", 2, where=lambda d: d.where("id % 400 = 0")).collect()) < 10


def test_ivf_options(cloud, small, tmp_path):
    with pytest.raises(ValueError, match="out of bounds"):
        ivf.build(cloud, str(tmp_path / "a"), "v", lists=0)
    index = ivf.build(small, str(tmp_path / "b"), "v", "id", 3, "cosine")
    assert index.notices == [] and sorted(r.id for r in index.table().collect()) == [2, 3, 5]  # neither null nor zero
    assert index.search(None, 10, 3).count() == 3


def test_ivf_insert_vacuum_and_stream(spark, cloud, tmp_path):
    index = ivf.build(cloud.where("id < 1000"), str(tmp_path / "i"), "v", "id", 8)
    cloud.where("id >= 1000 and id < 1500").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cloud.schema).parquet(str(tmp_path / "in"))
    ingest.append_stream(stream, index, str(tmp_path / "ck"), "v", "id").awaitTermination()
    assert index.table().count() == 1500
    index.vacuum(cloud.where("id < 100"))
    assert index.table().count() == 1400


def test_kmeans_edge_cases():
    same = np.ones((10, 3))
    assert np.isfinite(ivf.kmeans(same, 4)).all()
    assert np.allclose(np.linalg.norm(ivf.kmeans(np.random.default_rng(0).normal(size=(50, 3)), 5, True), axis=1), 1)
    assert set(np.unique(ivf.kmeans(np.random.default_rng(0).integers(0, 2, (50, 3)).astype(float), 4, bits=True)[:1])) <= {0.0, 1.0}


def test_hnsw_recall_and_duplicates(spark, cloud, tmp_path):
    index = hnsw.build(cloud.where("id < 1200"), str(tmp_path / "h"), "v", shards=2)
    asked = cloud.where("id % 200 = 0")
    truth = knn.knn_join(cloud.where("id < 1200"), asked, "v", "id", 20)
    assert knn.recall(index.search_many(asked, 20, 40, "off", "v"), truth, 20).first()[0] >= 0.97
    g = hnsw.Graph()
    for i in range(20):
        g.add(i, np.ones(3), 0.5)
    assert len(g.search(np.ones(3), 1, 20)) == 10
    with pytest.raises(ValueError, match="ef_construction"):
        hnsw.build(cloud, str(tmp_path / "x"), "v", m=16, ef_construction=31)


def test_hnsw_finds_all_copies():
    g, rng = hnsw.Graph(), np.random.default_rng(1)
    for i in range(1000):
        g.add(i, np.ones(3), rng.random())
    for i in range(1000, 1100):
        g.add(i, 2 + rng.random(3), rng.random())
    assert all(r < 1000 for _, r in g.search(np.ones(3), 40, 100)) and len(g.search(np.ones(3), 2, 20)) == 20
    assert [r for _, r in g.search(np.ones(3), 1, 3, "strict_order", {500, 700, 999})] == [500, 700, 999]


def test_hnsw_iterative():
    g, rng = hnsw.Graph(), np.random.default_rng(1)
    x = rng.random((600, 3))
    for i, v in enumerate(x):
        g.add(i, v, rng.random())
    keep = set(range(0, 600, 50))
    assert len(g.search(x[0], 10, 12, "off", keep)) < 12
    relaxed = g.search(x[0], 10, 12, "relaxed_order", keep)
    strict = [d for d, _ in g.search(x[0], 10, 12, "strict_order", keep)]
    assert len(relaxed) == 12 and strict == sorted(strict)


def test_projection_keeps_distances():
    x = np.random.default_rng(0).normal(size=(200, 128))
    for r in (projection.rademacher(128, 64), projection.gaussian(128, 64), projection.sparse_signs(128, 64)):
        y = x @ r.T
        ratio = np.linalg.norm(y[1:] - y[:-1], axis=1) / np.linalg.norm(x[1:] - x[:-1], axis=1)
        assert 0.85 < ratio.mean() < 1.15
    assert set(np.unique(projection.ternary(50, 20))) == {-1.0, 0.0, 1.0}


def test_quantizers(cloud):
    wide = cloud.select("id", F.concat("v", F.slice("v", 1, 1)).alias("v")).where("id < 1000")
    errors = []
    for how in ({}, {"rotate": True}, {"layers": 2}):
        q = quantize.train(wide, "v", m=2, k=16, **how)
        back = quantize.decode(quantize.encode(wide, q, "v"), q).join(wide, "id")
        errors.append(back.agg(F.avg(V.l2_squared(F.col("v"), F.col("vec")))).first()[0])
    assert errors[2] < errors[0] < 0.1 and errors[1] < 0.1


def test_files(spark, tmp_path):
    v = np.arange(12, dtype=np.float32).reshape(4, 3)
    (tmp_path / "a.fvecs").write_bytes(files.pack_fvecs(v))
    (tmp_path / "a.ivecs").write_bytes(files.pack_fvecs(v.astype(np.int32), "<i4"))
    assert [r.embedding for r in files.read_fvecs(spark, str(tmp_path / "a.fvecs"), 3).orderBy("id").collect()] == v.tolist()
    assert [r.neighbours for r in files.read_ivecs(spark, str(tmp_path / "a.ivecs"), 3).orderBy("id").collect()] == v.astype(int).tolist()
    with pytest.raises(Exception, match="no multiple|expected"):
        files.read_fvecs(spark, str(tmp_path / "a.fvecs"), 4).collect()
    (tmp_path / "v.csv").write_text('"[1,2,3]"\n"[4,5,6]"\n')
    assert files.read_vector_csv(spark, str(tmp_path / "v.csv")).count() == 2


def test_large_files_are_split(spark, tmp_path, monkeypatch):
    v = np.random.default_rng(0).random((4000, 8)).astype(np.float32)
    (tmp_path / "b.fvecs").write_bytes(files.pack_fvecs(v))
    monkeypatch.setattr(files, "PIECE", 20_000)
    df = files.read_fvecs(spark, str(tmp_path / "b.fvecs"), 8)
    assert df.rdd.getNumPartitions() > 4
    got = df.orderBy("id").collect()
    assert [r.id for r in got] == list(range(4000)) and np.array_equal(np.array([r.embedding for r in got], dtype=np.float32), v)
    near = knn.knn_join(df, df.where("id < 5"), "embedding", "id", 3).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id")))["id"].alias("neighbours"))
    truth = near.select(F.col("qid").alias("id"), "neighbours")
    assert files.check_truth(truth, df, df.where("id < 5"), 3).count() == 0
    wrong = truth.select("id", F.when(F.col("id") == 2, F.array(F.lit(2), F.lit(17).cast("long"), F.lit(18))).otherwise(F.col("neighbours")).alias("neighbours"))
    assert [r.qid for r in files.check_truth(wrong, df, df.where("id < 5"), 3).collect()] == [2]


def test_codes_read_back():
    codes = np.array([[1, 2, 3], [0, 255, 7]])
    assert np.array_equal(quantize.codes_in(quantize.codes_out(codes)), codes)
    for bad in (["1,2"], ["{1}", "{1,2}"]):
        with pytest.raises(ValueError):
            quantize.codes_in(bad)


def test_planner(spark, small, cloud, index):
    s = planner.Settings()
    with pytest.raises(ValueError, match=r'0 is outside the valid range for parameter "ivfflat.probes" \(1 .. 32768\)'):
        s.put("ivfflat.probes", 0)
    with pytest.raises(ValueError):
        s.put("hnsw.iterative_scan", "on")
    assert s["hnsw.ef_search"] == 40
    t = planner.VectorTable(cloud, "v", "id", ivf=index, rows=1_000_000)
    assert t.choose(10, s) == "ivf" and t.choose(None, s) == "exact" and t.choose(10, s, 0.001) == "exact"
    assert planner.VectorTable(cloud, "v", "id", ivf=index).choose(10, s) == "exact"
    assert t.search([0.5] * 3, 5, "ivf").count() == 5
    assert planner.rewrite("SELECT v <=> array(1,2) AS d") == "SELECT cosine_distance(v, array(1,2)) AS d"
    planner.register(spark)
    small.createOrReplaceTempView("small")
    q = "array(3f,3f,3f)"
    rows = spark.sql(f"SELECT id, l2_distance(v, {q}) AS d, cosine_distance(v, {q}) AS c FROM small ORDER BY d NULLS LAST").collect()
    assert [r.id for r in rows] == [2, 5, 3, 1, 4]
    assert rows[3].c != rows[3].c


def test_sql_functions(spark):
    planner.register(spark)
    spark.createDataFrame([(1, [1.0, 2.0, 3.0], [4.0, 5.0, 6.0], "1011", "0011"), (2, None, [1.0, 1.0, 1.0], None, "1")], "id long, a array<float>, b array<float>, x string, y string").createOrReplaceTempView("pairs")
    r = spark.sql(planner.rewrite("""
        SELECT a <-> b AS l2, a <#> '[4,5,6]' AS ip, (a <=> vector_add(a, array(0f, 0f, float(abs(-1)))) ) AS c, a <+> b AS l1, x <~> y AS h, x <%> '0011' AS j, 'a <-> b' AS s, -- a <-> b
               vector_concat(a, b) AS both, subvector(b, 0, 3) AS part, l2_normalize(a) AS n, binary_quantize(vector_sub(a, b)) AS q, vector_cmp(a, b) AS cmp, vector_dims(b) AS d,
               sparsevec_l2_distance(vector_to_sparsevec(a), vector_to_sparsevec(b)) AS sl2, sparsevec_cosine_distance(vector_to_sparsevec(a), vector_to_sparsevec(a)) AS sc, array_to_vector(array(1, 2), 2) AS v, vector_to_halfvec(array(0.1f)) AS hv
        FROM pairs ORDER BY id""")).collect()  # fmt: skip
    a = r[0]
    assert (a.ip, a.l1, a.h, a.s, a.cmp, a.d, a.q) == (-32.0, 9.0, 1.0, "a <-> b", -1, 3, "000")
    assert a.l2 == pytest.approx(27**0.5) and a.sl2 == a.l2 and abs(a.sc) < 1e-12 and a.j == pytest.approx(1 / 3) and a.c == pytest.approx(1 - 17 / (14 * 21) ** 0.5)
    assert a.both == [1, 2, 3, 4, 5, 6] and a.part == [4.0, 5.0] and a.v == [1.0, 2.0] and a.hv[0] == pytest.approx(0.0999755859375, abs=0)
    assert r[1].l2 is None and r[1].h is None and r[1].d == 3
    with pytest.raises(Exception, match="different vector dimensions 3 and 1"):
        spark.sql(planner.rewrite("SELECT a <-> '[1]' FROM pairs")).collect()


@pytest.mark.parametrize(("sql", "want"), [
    ("SELECT f(g(v), 1) <-> h(k(w)) FROM t", "SELECT l2_distance(f(g(v), 1), h(k(w))) FROM t"),
    ("SELECT (a) <-> (b)", "SELECT l2_distance((a), (b))"),
    ("WHERE a.v<->'[1,2]'::vector < 3 AND x", "WHERE l2_distance(a.v, array(float(1), float(2))) < 3 AND x"),
    ("ORDER BY v[1] <+> w[2], id", "ORDER BY l1_distance(v[1], w[2]), id"),
    ("SELECT `a b` <=> c /* a <=> b */", "SELECT cosine_distance(`a b`, c) /* a <=> b */"),
])
def test_rewrite(sql, want):
    assert planner.rewrite(sql) == want


@pytest.mark.parametrize("mode", ["relaxed_order", "strict_order"])
def test_filtered_index_searches(spark, cloud, index, tmp_path, mode):
    """A filter that one row in 400 passes: all ten are found by iterative scans, in order; limits end them early."""
    graph = hnsw.build(cloud, str(tmp_path / "g"), "v", m=8, ef_construction=32, shards=4)
    t = planner.VectorTable(cloud, "v", "id", ivf=index, hnsw=graph, rows=1_000_000)
    s, few, passing = planner.Settings(), planner.Settings(), F.col("id") % 400 == 0
    s.put("ivfflat.iterative_scan", "relaxed_order")
    s.put("hnsw.iterative_scan", mode)
    few.put("ivfflat.iterative_scan", "relaxed_order")
    few.put("ivfflat.max_probes", 2)
    few.put("hnsw.iterative_scan", mode)
    few.put("hnsw.max_scan_tuples", 50)
    exact = [r.id for r in t.search([0.5] * 3, 11, "exact", where=passing).collect()]
    assert len(exact) == 10
    got = [r.id for r in t.search([0.5] * 3, 11, "ivf", s, passing, "post").collect()]
    assert sorted(got) == sorted(exact)
    assert len(t.search([0.5] * 3, 11, "ivf", few, passing, "post").collect()) < 10
    rows = t.search([0.5] * 3, 11, "hnsw", s, passing, "post").collect()
    assert [r.distance for r in rows] == sorted(r.distance for r in rows)
    assert len(rows) >= (10 if mode == "relaxed_order" else 8) and {r.id for r in rows} <= set(exact)
    assert len(t.search([0.5] * 3, 11, "hnsw", few, passing, "post").collect()) < 10
    assert t.search([0.5] * 3, 11, "hnsw", None, passing, "post").count() < 10


def test_join_is_exact_with_ties_and_large_values(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(200)] + [(200 + i, [1.0, 2.0 + i]) for i in range(1, 20)], "id long, v array<float>").repartition(5)
    asked = spark.createDataFrame([(0, [1.0, 2.0]), (1, None)], "id long, v array<float>")
    for metric in ("l2", "ip", "cosine", "l1"):
        got = [r.id for r in knn.knn_join(same, asked, "v", "id", 5, metric).orderBy("rank").collect()]
        assert got == [r.id for r in knn.knn(same, "v", [1.0, 2.0], 5, metric).collect()], metric
    rng = np.random.default_rng(5)
    far = [(i, (1e8 + rng.random(3) * 1e3).tolist()) for i in range(500)]
    rows = spark.createDataFrame(far, "id long, v array<double>")
    for packed in (False, True):
        before, knn.QUERY_BYTES = knn.QUERY_BYTES, 0 if packed else knn.QUERY_BYTES
        try:
            got = [(r.qid, r.id) for r in knn.knn_join(rows, rows.where("id < 40"), "v", "id", 5).orderBy("qid", "rank").collect()]
        finally:
            knn.QUERY_BYTES = before
        x = np.array([v for _, v in far])
        want = [(q, i) for q in range(40) for i in np.lexsort((np.arange(500), np.sqrt(((x - x[q]) ** 2).sum(1))))[:5].tolist()]
        assert got == want


def test_unknown_metrics_and_taken_names_are_refused(cloud, tmp_path):
    for work in (lambda: knn.knn(cloud, "v", [0.0] * 3, 1, "hamming"), lambda: knn.knn_join(cloud, cloud, "v", "id", 1, "L2"), lambda: ivf.build(cloud, str(tmp_path), "v", metric="jaccard"), lambda: hnsw.build(cloud, str(tmp_path), "v", metric="hamming")):
        with pytest.raises(ValueError, match="unknown metric"):
            work()
    with pytest.raises(ValueError, match="distance"):
        knn.knn(cloud.withColumn("distance", F.lit(1)), "v", [0.0] * 3, 1)


def test_stored_index_opens_again(spark, cloud, tmp_path):
    path = str(tmp_path / "i")
    index = ivf.build(cloud.where("id < 900"), path, "v", "id", 6)
    again = ivf.open_index(spark, path)
    assert np.array_equal(again.centers, index.centers) and (again.metric, again.dim, again.projection) == ("l2", 3, None)
    q = [0.1, 0.2, 0.3]
    assert again.search(q, 5, 2).collect() == index.search(q, 5, 2).collect()
    again.vacuum(cloud.where("id < 100"))
    again.vacuum(cloud.where("id < 200"))
    third = ivf.open_index(spark, path)
    assert third.version == 2 and third.table().count() == 700
    spark.range(1).write.parquet(f"{path}/lists-3/list_id=0/load=0")  # a rewrite that never ended
    assert ivf.open_index(spark, path).table().count() == 700
    for _ in range(2):  # a load that is repeated
        third.insert(cloud.where("id >= 900 and id < 950"), "v", "id", "x", "overwrite")
    assert third.table().count() == 750
    with pytest.raises(ValueError, match="no index"):
        ivf.open_index(spark, str(tmp_path / "none"))


def test_bit_lists(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, "".join(rng.choice(list("01"), 52))) for i in range(2000)] + [(5000, None)]
    df = spark.createDataFrame(rows, "id long, v string")
    index = ivf.build(df, str(tmp_path / "b"), "v", "id", 5, "hamming")
    q = rows[3][1]
    want = sorted((sum(a != b for a, b in zip(q, v, strict=True)), i) for i, v in rows[:-1])
    got = index.search(q, 20, 5).collect()
    assert [(int(r.distance), r.id) for r in got] == want[:20]
    assert len({r.id for r in index.search(q, 20, 2).collect()} & {i for _, i in want[:20]}) >= 6
    assert ivf.open_index(spark, str(tmp_path / "b")).search(q, 1, 1).first().id == 3
    with pytest.raises(ValueError, match="different bit lengths 52 and 3"):
        index.search("101", 1)


@pytest.mark.parametrize(("kind", "metric"), [("bit", "hamming"), ("bit", "jaccard"), ("sparsevec", "l2"), ("sparsevec", "cosine"), ("sparsevec", "ip"), ("sparsevec", "l1"), ("halfvec", "l2"), ("vector", "cosine")])
def test_graph_kinds(spark, tmp_path, kind, metric):
    rng = np.random.default_rng(4)
    x = rng.random((300, 12)).round(2) * (rng.random((300, 12)) < 0.5)
    x[0, 0] = 1
    if kind == "bit":
        df = spark.createDataFrame([(i, "".join("01"[int(b > 0)] for b in v)) for i, v in enumerate(x)], "id long, v string")
        b = (x > 0).astype(float)
        both = (b * b[0]).sum(1)
        want = np.abs(b - b[0]).sum(1) if metric == "hamming" else np.where(both == 0, 1.0, 1 - both / np.maximum(1, ((b + b[0]) > 0).sum(1)))
        q = df.first().v
    else:
        y = x.astype(np.float16).astype(float) if kind == "halfvec" else x.astype(np.float32).astype(float)
        want = knn.exact_distance(y[0], y, metric)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
        q = x[0].tolist()
        if kind == "sparsevec":
            df = df.select("id", T.vector_to_sparsevec(F.col("v")).alias("v"))
            q = (np.flatnonzero(x[0]).tolist(), x[0][x[0] != 0].tolist())
    g = hnsw.build(df, str(tmp_path / "g"), "v", metric=metric, m=8, ef_construction=32, shards=2, kind=kind)
    got = g.search(q, 10, 400).collect()
    near = np.sort(want[~np.isnan(want)])[:10]
    assert np.allclose([r.distance for r in got], near, atol=1e-6) and all(abs(want[r.id] - r.distance) < 1e-6 for r in got)


def test_graph_insert_and_vacuum(spark, cloud, tmp_path):
    g = hnsw.build(cloud.where("id < 400"), str(tmp_path / "g"), "v", m=8, ef_construction=32, shards=3)
    g.insert(cloud.where("id >= 400 and id < 600"), "v")
    g.vacuum(cloud.where("id % 10 = 0"))
    left = cloud.where("id < 600 and id % 10 <> 0")
    truth = knn.knn_join(left, cloud.where("id < 20"), "v", "id", 10)
    found = g.search_many(cloud.where("id < 20"), 10, 100, "off", "v")
    assert knn.recall(found, truth, 10).first()[0] >= 0.97 and found.where("id % 10 = 0").count() == 0
    g.vacuum(left)
    assert g.search([0.5] * 3, 5).count() == 0
    g.insert(cloud.where("id < 50"), "v")
    assert g.search([0.5] * 3, 5, 60).count() == 5


def test_graph_exact_check():
    g, rng = hnsw.Graph("l2", 4, 16, "sparsevec"), np.random.default_rng(6)
    x = rng.integers(0, 4, (90, 6)).astype(float)
    points = [np.array([np.flatnonzero(v), v[v != 0]]) for v in x]
    for i in rng.permutation(90).tolist():
        g.add(i, points[i], rng.random())
    lost = set(range(0, len(g.points), 4)) - {g.enter}
    g.links = [[[j for j in level if j not in lost] for level in links] for links in g.links]  # points that no link leads to
    for keep in (None, set(range(0, 90, 2))):
        d = np.sqrt(((x - x[3]) ** 2).sum(1))
        want = sorted((d[i], i) for i in range(90) if keep is None or i in keep)
        for k in (12, 60, 200):
            got = g.search(points[3], 4, k, keep=keep, exact=True)
            assert [r for _, r in got] == [r for _, r in want[:k]] and np.allclose([d for d, _ in got], [d for d, _ in want[:k]])
            assert [r for _, r in g.search(points[3], 200, k, keep=keep)] != [r for _, r in want[:k]]
    assert hnsw.Graph(kind="sparsevec").search(points[3], 4, 5, exact=True) == []


def test_sparse_distances(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 30)) * (rng.random((40, 30)) < 0.3)
    x[1] = 0
    points = [np.array([1e8 * np.flatnonzero(v), v[v != 0]]) for v in x]
    for metric in ("l2", "l1", "ip", "cosine"):
        for i in (0, 1):
            assert np.allclose(hnsw._sparse(points[i][:, ::-1], points, metric), knn.exact_distance(x[i], x, metric), equal_nan=True)
    links = []
    for most in (hnsw.SPREAD, 0):
        monkeypatch.setattr(hnsw, "SPREAD", most)
        g = hnsw.Graph("l2", 4, 8, "sparsevec")
        for i, p in enumerate(points):
            g.add(i, p, 0.5)
        links.append(g.links)
    assert links[0] == links[1]


def test_hnsw_sparse_far_cluster(spark, tmp_path):
    """Each shard has more points in a far cluster than its search visits."""
    import duckdb

    rng, q = np.random.default_rng(7), np.array(queries.QUERY)
    v = np.concatenate([q + 1 + rng.normal(size=(20, 64)) * 0.2, -4 * q + rng.normal(size=(2600, 64)) * 0.01])
    spark.createDataFrame([(i, y.tolist(), 0) for i, y in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["hnsw_sparse"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert [tuple(r) for r in got] == db.execute(queries.ORACLES["hnsw_sparse"]).fetchall()
