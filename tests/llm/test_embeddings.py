import duckdb
import numpy as np
import pytest

from leafwork.llm import embeddings

KIND = "vec_id long, embedding array<float>, label int, node string"


@pytest.mark.parametrize("options", [{}, {"roots": 1, "block": 16, "sample": 10}])
def test_links_against_brute_force(spark, options):
    rng = np.random.default_rng(0)
    base, rows = rng.normal(size=(40, 16)), []
    for i in range(500):
        v = base[rng.integers(40)] + rng.normal(size=16) * rng.choice([0, 0.03, 0.12, 0.2])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2)), "clash"))
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [None] + [1.0] * 15, 1), (1003, [float("nan")] + [1.0] * 15, 1), (1004, [1.0] * 16, None)]
    odd += [(1005, [1.0, 2.0], 1), (1006, [2.0, 4.0], 1), (1007, [], 1), (1008, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows + [(*r, None) for r in odd], KIND)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, **options).collect()}
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (v @ v.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    reach = np.arange(500)
    while True:
        new = np.array([min(reach[i], reach[near[i]].min() if near[i].any() else i) for i in range(500)])
        if (new == reach).all():
            break
        reach = new
    assert all(got[i].n_links == near[i].sum() for i in range(500))
    assert all(got[i].component_id == reach[i] for i in range(500))
    assert all(got[i].kept == (reach[i] == i) for i in range(500))
    alone = {i: (got[i].n_links, got[i].component_id) for i in (1000, 1001, 1002, 1003, 1004, 1007, 1008)}
    assert alone == {i: (0, i) for i in alone}
    assert (got[1005].n_links, got[1006].component_id) == (1, 1005)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [r[:3] for r in rows + odd if r[0] < 250 or r[0] >= 1000])
    some = embeddings.near_duplicates(df.where("vec_id < 250 or vec_id >= 1000"), **options).collect()
    assert sorted(map(tuple, some)) == sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({embeddings.near_duplicates_sql()})").fetchall())


def test_cells_grow_with_the_root():
    assert [embeddings.cells_for(n) for n in (0, 1, 63, 64, 500, 2000, 10**6, 10**12)] == [0, 0, 1, 2, 5, 11, 250, embeddings.CELLS]


def test_visits_miss_no_pair():
    rng = np.random.default_rng(1)
    v = embeddings.unit(rng.normal(size=(400, 5)))
    centroids = embeddings.spherical_kmeans(v, 12)
    home, rows, cells = embeddings.cells_of(v, centroids, 0.95)
    member = {(i, int(c)) for i, c in enumerate(home)} | set(zip(rows.tolist(), cells.tolist(), strict=True))
    for i, j in zip(*np.nonzero(v @ v.T >= 0.95), strict=True):
        c = min(home[i], home[j])
        assert (i, int(c)) in member
        assert (j, int(c)) in member


def test_copies_and_empty_tables(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], KIND)).count() == 0
    rows = [(i, [1.0, 2.0, 3.0], 5, None) for i in range(50)] + [(7, [1.0, 2.0, 3.0], 5, None), (None, [1.0, 2.0, 3.0], 5, None)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, KIND)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(51, 0)}
    assert [r.vec_id for r in got if r.kept] == [0]
