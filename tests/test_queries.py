"""Every query against its SQL; those without SQL give rows."""

import numpy as np
import pytest
from conftest import DATA, normal

from histoplane.plans.queries import ORACLE_SQL, QUERIES
from histoplane.plans.views import small_cells


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    assert normal(QUERIES[name](spark, DATA).toPandas()) == normal(duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, name):
    assert len(QUERIES[name](spark, DATA).columns) > 0
    QUERIES[name](spark, DATA).count()


def empty_circle_pairs(xy):
    """Pairs of points that some circle through both holds no other point of: for each pair the range of centres on its bisector."""
    out = set()
    for i in range(len(xy)):
        for j in range(i + 1, len(xy)):
            half, at = (xy[j] - xy[i]) / 2, np.delete(xy, (i, j), 0) - (xy[i] + xy[j]) / 2
            side, room = at @ np.array([-half[1], half[0]]), ((at**2).sum(1) - (half**2).sum()) / 2
            least = (room[side < 0] / side[side < 0]).max(initial=-np.inf)
            most = (room[side > 0] / side[side > 0]).min(initial=np.inf)
            if least <= most and (room[side == 0] >= 0).all():
                out.add((i, j))
    return out


def test_delaunay_of_all_cells(spark):
    cells = small_cells(spark, DATA).orderBy("cell_id").collect()
    ids, xy = [r.cell_id for r in cells], np.array([(r.X, r.Y) for r in cells])
    got = QUERIES["edges_delaunay_all"](spark, DATA).collect()
    pairs = {(min(r["from"], r["to"]), max(r["from"], r["to"])) for r in got}
    assert len(ids) > 60 and len(pairs) == len(got) and {i for p in pairs for i in p} == set(ids)
    assert pairs == {(ids[i], ids[j]) for i, j in empty_circle_pairs(xy)}
    at = dict(zip(ids, xy))
    assert all(abs(r.dist - np.hypot(*(at[r["from"]] - at[r["to"]]))) < 1e-9 for r in got)


def test_merge_protein_of_all_cells(spark):
    got = {r.Cell_ID: (r.p2, r.p3) for r in QUERIES["merge_protein_all"](spark, DATA).collect()}
    want = {str(r.vec_id): (r.embedding[2], r.embedding[3]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    assert got == want and all(None not in v for v in got.values())
