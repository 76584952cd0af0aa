"""Whitening beside a dense eigensolver, and its edge cases."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SF

from vigilog.llm import whitening
from vigilog.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, n string, x string, whitened string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "n", "x", "w") for i, v in rows], SCHEMA)


def expected(rows, k=4):
    """n, S, eigenvalues, vectors and x of the rows that count, from all numbers at once."""
    x = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows}
    listed = np.unique(np.floor(256 * np.array([v for _, v in rows])).astype(np.int64), axis=0)
    away = listed - listed.mean(axis=0)
    values, columns = np.linalg.eigh(away.T @ away / len(listed))
    return len(listed), listed.sum(axis=0), values[::-1], columns[:, ::-1][:, :k], x


MATRICES = {
    "zero": np.zeros((6, 6)), "one": np.eye(7), "single": np.array([[3.0]]), "two": np.diag([2.0, 2]),
    "ties": np.diag([5.0, 5, 5, 5, 5, 1, 1]), "near": np.diag([1 + 1e-12, 1, 1 - 1e-12, 0.5, 0.5, 0.4999999]),
    "rank": np.outer(np.arange(5.0), np.arange(5.0)), "steep": np.diag([1e30, 1e20, 1, 1]),
    "dense": np.diag(1 - np.arange(40) * 1e-3), "halving": np.diag(2.0 ** -np.arange(30.0)),
}


@pytest.mark.parametrize("name", list(MATRICES))
@pytest.mark.parametrize("turned", [False, True])
def test_components_of_matrices(name, turned):
    v = MATRICES[name]
    if turned:
        q = np.linalg.qr(np.random.default_rng(3).standard_normal(v.shape))[0]
        v = q @ v @ q.T
        v = (v + v.T) / 2
    values, at = whitening.largest_components(v, 4)
    k, size = min(4, len(v)), max(np.linalg.norm(v, 2), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1][:k]).max() <= 1e-13 * size
    assert np.abs(v @ at - at * values).max() <= 1e-13 * size
    assert np.abs(at.T @ at - np.eye(k)).max() <= 1e-13


def test_inertia_counts():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 17):
        a = rng.standard_normal((d, d))
        a = a + a.T
        tri, values = whitening.tridiagonal(a), np.linalg.eigvalsh(a)
        for shift in [*rng.standard_normal(20) * 4, 0.0]:
            assert whitening.above(tri, shift) == (values > shift).sum()


def test_packed_rows_come_back():
    rows = np.array([[0, -1], [32767, -32768], [32768, 0], [-(2**31), 5], [2**40, -1], [2**63 - 1, -(2**63)]])
    packed = whitening._packed(rows)
    assert (whitening._unpacked(packed, 2) == rows).all()
    assert [len(b) for b in packed.to_pylist()] == [4, 4, 8, 8, 16, 16]


def test_scaled():
    got = whitening.scaled(np.array([0.999, -0.001, -0.0, 1.5, 1e30, -1e30]))
    assert got.tolist() == [255, -1, 0, 384, 2**63 - 1, -(2**63)]


def test_op12(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    n, sums, values, columns, x = expected(rows)
    got = QUERIES["op12_whitening"](spark, SF).collect()
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted((i, k) for i, _ in rows for k in range(1, 5))
    sign = {}
    for r in got:
        k, own = r["component"] - 1, x[r["vec_id"]]
        want = (own - sums / n) @ columns[:, k] / np.sqrt(values[k])
        sign.setdefault(k, np.sign(want * r["whitened"]))
        assert r["whitened"] * sign[k] == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(own, sums))
        assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-9


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.standard_normal(5).tolist()) for i in range(30)]
    good += [(7, good[3][1]), (31, good[4][1]), (None, good[5][1]), (32, [c + 1e-9 for c in good[6][1]])]
    bad = [(40, None), (41, [1.0, None, 1.0, 1.0, 1.0]), (42, [float("nan")] * 5), (43, [float("inf")] * 5), (44, []), (45, [1.0] * 4)]
    got = whitening.whiten(vectors(spark, good + bad)).collect()
    assert sorted((r["vec_id"] for r in got), key=repr) == sorted((i for i, _ in good), key=repr)
    assert {r["n"] for r in got} == {expected(good)[0]}
    assert all(len(r["whitened"]) == len(r["explained"]) == 4 for r in got)


@pytest.mark.parametrize(
    "rows, found",
    [
        ([], 0),
        ([(1, None), (2, [])], 0),
        ([(1, [1.0, 2.0])], 1),
        ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 2),
        ([(1, [1.0]), (2, [3.0])], 2),
    ],
)
def test_few_vectors(spark, rows, found):
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == found
    assert all(len(r["whitened"]) == (1 if rows == [(1, [1.0]), (2, [3.0])] else 0) for r in got)


def test_huge_entries(spark):
    rows = [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [0.5e12, 7.0])]
    n, sums, values, _, x = expected(rows)
    got = {r["vec_id"]: r for r in whitening.whiten(vectors(spark, rows)).collect()}
    for i, own in x.items():
        exact = sum((n * int(a) - int(s)) ** 2 for a, s in zip(own, sums))
        assert got[i]["deviation"] == (exact if exact < 2**63 else None)
    assert got[1]["explained"][0] == pytest.approx(1.0)


def test_lists_of_slices():
    column = pa.array([[9.0], None, [1.0, 2.0], [], [None, 3.0], [4.0, 5.0]], pa.list_(pa.float32())).slice(1)
    rows, x = whitening._whole_rows(column, 2)
    assert rows.tolist() == [1, 4] and x.tolist() == [[256, 512], [1024, 1280]]
