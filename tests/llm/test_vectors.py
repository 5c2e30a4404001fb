"""Embedding near-dedup by sorted projection passes: brute force, cuts between tasks, edge rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from veilspark.llm import projection_passes as pp
from veilspark.llm.common import Scratch, read
from veilspark.llm.graph import components
from veilspark.llm.queries import QUERIES


def _brute(rows, cosine):
    """``[(id, label, vec)]`` -> sorted ``(id, n_links, component, kept)``."""
    def ok(label, v):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    link = [[] for _ in range(n)]
    unit = [np.array(v, float) / max(abs(x) for x in v) if ok(label, v) else None for _, label, v in rows]
    unit = [None if v is None else v / np.linalg.norm(v) for v in unit]
    for i in range(n):
        for j in range(n):
            if i != j and unit[i] is not None and unit[j] is not None and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                link[i].append(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        comp = min(ids, default=None)
        out.append((rows[i][0], len(link[i]), comp, rows[i][0] == comp))
    return Counter(out)


def _cloud(rnd, n, dim, spread):
    return (rnd.standard_normal(dim) + spread * rnd.standard_normal((n, dim))).tolist()


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.RandomState(5)
    out = []
    for label in (0, 1, 2):
        out += [(label, v) for v in _cloud(rnd, 25, 16, 0.15) + _cloud(rnd, 20, 16, 0.3) + rnd.standard_normal((30, 16)).tolist()]
    turn = [0.2 * k for k in range(30)]  # a chain: neighbours are linked, the ends are not
    out += [(3, [float(np.cos(a)), float(np.sin(a)), 0.0]) for a in turn]
    copy = out[0][1]
    out += [(0, copy)] * 40 + [(1, copy)] * 3 + [(0, [2 * x for x in copy])] * 2 + [(0, copy[:8]), (0, copy[:8])]
    out = [(i, *r) for i, r in enumerate(out)]
    return out + [(None, 0, copy), (None, 5, [1.0, 0.0]), (None, 5, [1.0, 0.0]), (900, None, copy), (901, 0, None), (902, 0, []), (903, 0, [0.0] * 16),
                  (904, 0, [None] + copy[1:]), (905, 0, [float("nan")] + copy[1:]), (906, 0, [float("inf")] + copy[1:]), (7, 0, copy), (7, 0, copy),
                  (907, 4, [-0.0, 1.0]), (908, 4, [0.0, 3.0])]


@pytest.mark.parametrize("kind", ["double", "float"])
def test_equals_brute_force(spark, rows, kind):
    if kind == "float":
        rows = [(i, n, v and [x if x is None else float(np.float32(x)) for x in v]) for i, n, v in rows]
    df = spark.createDataFrame([(i, n, v, 0, 0, "z") for i, n, v in rows], f"vec_id long, label int, embedding array<{kind}>, id int, root int, v string")
    got = pp.near_vectors(df)
    assert got.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    want = _brute(rows, 0.93)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert max(r[1] for r in want) > 60
    assert pp.near_vectors(df.limit(0)).count() == 0
    assert {tuple(r) for r in pp.near_vectors(df.where("vec_id in (900, 903)")).collect()} == {(900, 0, 900, True), (903, 0, 903, True)}


def test_huge_and_tiny_components(spark):
    rows = [(0, "a", [1e300, 1e300]), (1, "a", [1e-300, 1e-300]), (2, "a", [1e-320, 2e-320])]
    got = pp.near_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>"))
    assert Counter(tuple(r) for r in got.collect()) == _brute(rows, 0.93)


def test_small_balls_and_large_components(spark, rows, monkeypatch):
    """Many balls a component: surely linked, surely not, and compared."""
    monkeypatch.setattr(pp, "BALL", 4)
    scratch = Scratch(spark, "test")
    for cosine in (0.93, 0.8, 0.99):
        data = [(k, 0, v) for k, (_, n, v) in enumerate(r for r in rows if r[1] == 3 and r[2])] + [(100 + k, 1, v) for k, (_, n, v) in enumerate(r for r in rows[:45])]
        members = spark.createDataFrame([(i, r, k % 7, bytearray(np.array(v).tobytes()), 1 + k % 3) for k, (i, r, v) in enumerate(data)],
                                        "vid long, root long, bits long, v binary, m long").repartition(3)
        got = {r.vid: r.linked for r in pp.count_links(members, scratch, cosine, "<f8").collect()}
        for k, (i, r, v) in enumerate(data):
            near = [1 + j % 3 for j, (_, s, w) in enumerate(data) if r == s and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= cosine - 1e-12]
            assert got[i] == sum(near), (cosine, i)


def test_cuts_between_tasks_lose_nothing(spark):
    """Components of the edges are those of one walk over each whole order."""
    rnd = np.random.RandomState(2)
    v = rnd.standard_normal((150, 4)).astype("<f4")
    group = np.arange(150) % 2
    table = spark.createDataFrame([(int(g), i, bytearray(x.tobytes())) for i, (g, x) in enumerate(zip(group, v, strict=True))], "group long, vid long, v binary")
    u = pp.unit(v)
    sides = pp._sides(u, 3)
    for window, parts in ((3, 40), (9, 40), (200, 60)):
        want = list(range(150))
        for p in range(3):
            for g in (0, 1):
                order = sorted((int(sides[i, p]), i) for i in range(150) if group[i] == g)
                for k, (_, i) in enumerate(order):
                    for _, j in order[k + 1:k + 1 + window]:
                        if u[i] @ u[j] >= 0.93 and want[i] != want[j]:
                            a, b = sorted((want[i], want[j]))
                            want = [a if x == b else x for x in want]
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            scratch = Scratch(spark, "test")
            root = {r.node: r.root for r in components(pp.pass_edges(table, scratch, 0.93, "<f4", 3, window), scratch).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
        assert [root.get(i, i) for i in range(150)] == want, window


def test_one_label_with_a_third_of_all_rows(spark):
    """Large groups of near copies: every row knows all its partners."""
    rnd = np.random.RandomState(3)
    near = _cloud(rnd, 1500, 24, 0.05)
    rows = [(i, 1, v) for i, v in enumerate(near)] + [(5000 + i, i % 9, v) for i, v in enumerate(rnd.standard_normal((3000, 24)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = pp.near_vectors(df)
    assert got.where((F.col("vec_id") < 1500) & (F.col("n_links") == 1499) & (F.col("component_id") == 0)).count() == 1500


def test_query(spark):
    got = QUERIES["op13_embedding_dedup"](spark, SF_CHECK)
    rows = [tuple(r) for r in read(spark, SF_CHECK, "embeddings").select("vec_id", "label", "embedding").collect()]
    assert Counter(tuple(r) for r in got.collect()) == _brute(rows, 0.93)
