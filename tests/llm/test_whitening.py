import numpy as np
import pytest

from tidemark.llm import whitening as W

IN = "vec_id long, embedding array<float>, label int, component string, x array<long>, n double"


def plain(vectors, wanted=16):
    """Whitening by a dense solver: values, whitened rows, deviations (Python's whole numbers) of every vector."""
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    values, q = np.linalg.eigh((fit - sums / n).T @ (fit - sums / n) / n)
    own = np.flatnonzero(values[::-1] > W.RANK * values[-1])[:wanted]
    values, q = values[::-1][own], q[:, ::-1][:, own]
    deviations = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    return n, values, (x - sums / n) @ q / np.sqrt(values), deviations, np.cov(fit.T, bias=True).trace()


def held(got, ids, vectors):
    n, values, white, deviations, trace = plain(vectors)
    k = len(values)
    assert len(got) == len(ids) * k and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    assert all(r.identity_error <= 1e-10 and r.identity_error == got[0].identity_error for r in got)
    assert all(abs(r.explained / (values[r.component - 1] / trace) - 1) < 1e-10 for r in got)
    mine = np.array([[r.whitened for r in got if r.component == j] for j in range(1, k + 1)]).T
    for j in range(k):
        sign = np.sign(mine[:, j] @ white[:, j])
        assert np.allclose(mine[:, j] * sign, white[:, j], atol=1e-8)
    assert [r.deviation for r in got if r.component == 1] == deviations


def test_whole_table_against_a_dense_solver(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    got = sorted(W.whitened(rows).collect(), key=lambda r: (r.vec_id, r.component))
    told = sorted(rows.collect())
    held(got, [r.vec_id for r in told], [r.embedding for r in told])


def test_odd_rows(spark):
    """Nulls, non-finite and short vectors go; copies, equal vectors and null ids stay and count once in the fit."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((20, 5)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(3, base[3]), (100, base[4]), (None, base[5])] + [(50 + i, base[6]) for i in range(30)]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (204, []), (205, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, None, "c", [1], 0.5) for i, v in rows + bad], IN).repartition(3)
    rank = lambda i: -1 if i is None else i
    got = sorted(W.whitened(frame).collect(), key=lambda r: (rank(r.vec_id), r.component))
    told = sorted(rows, key=lambda r: rank(r[0]))
    assert [r.vec_id for r in got if r.component == 1] == [i for i, _ in told]
    assert {r.n for r in got} == {20}
    # equal ids with equal vectors are ties: their rows are equal too
    held(got, [i for i, _ in told], [v for _, v in told])


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[1.0, 2.0]] * 3])
def test_nothing_to_whiten(spark, vectors):
    frame = spark.createDataFrame([(i, v, None, None, None, None) for i, v in enumerate(vectors)], IN)
    out = W.whitened(frame)
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deficient_rank(spark):
    """Vectors on a line have one component."""
    frame = spark.createDataFrame([(i, [i / 2.0, float(i), 3.0], None, None, None, None) for i in range(9)], IN)
    got = W.whitened(frame).collect()
    assert len(got) == 9 and abs(got[0].explained - 1) < 1e-12 and abs(np.var([r.whitened for r in got]) - 1) < 1e-12


def test_iteration_in_many_dimensions():
    """With far more dimensions than the basis, near-equal values included, residuals are certified and values right."""
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((400, 400)))[0]
    values = np.r_[[9.0, 9.0 - 1e-6, 8.0, 8.0], np.linspace(5, 1, 396)]
    a = (q * values) @ q.T
    got, x, rounds = W.lobpcg(lambda b: a @ b, 400)
    assert rounds > 3 and np.allclose(got, np.sort(values)[::-1][:16], rtol=1e-12)
    assert np.linalg.norm(a @ x - x * got, axis=0).max() <= 2 * W.TOL * 9 and np.allclose(x.T @ x, np.eye(16), atol=1e-12)
    with pytest.raises(RuntimeError):
        W.lobpcg(lambda b: a @ b, 400, most=2)


def test_too_large_deviation_raises(spark):
    frame = spark.createDataFrame([(0, [1e9], None, None, None, None), (1, [-1e9], None, None, None, None)], IN)
    with pytest.raises(Exception, match="64 bits"):
        W.whitened(frame).collect()
