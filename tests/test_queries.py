"""Queries held against closed forms over whole tables."""

import pandas as pd
import pytest

from terrane import queries

SMALL = "/root/testdata/sf0.001"


def boxes():
    b = pd.read_parquet(f"{SMALL}/lineitem.parquet")
    b["x0"], b["y0"] = b.l_linenumber * 10.0, (b.l_discount * 100).round()
    b["x1"], b["y1"] = b.x0 + b.l_quantity, b.y0 + (b.l_tax * 100).round() + 1
    return b


def test_set_operations_and_buffers_take_every_row(spark):
    b = boxes()
    i = (b.x1.clip(upper=45) - b.x0.clip(lower=15)).clip(lower=0) * (b.y1.clip(upper=8) - b.y0.clip(lower=2)).clip(lower=0)
    area = (b.x1 - b.x0) * (b.y1 - b.y0)
    want = sorted(zip(b.l_orderkey, b.l_linenumber, area + 180 - i, i, area - i, area + 180 - 2 * i))
    got = sorted((r.l_orderkey, r.l_linenumber, r.u, r.i, r.d, r.x) for r in queries.QUERIES["st_set_operations"](spark, SMALL).collect())
    assert len(got) == len(want)
    assert [v for r in got for v in r] == pytest.approx([v for r in want for v in r], abs=1e-3)
    keys = pd.read_parquet(f"{SMALL}/customer.parquet").c_custkey
    assert sorted(map(tuple, queries.QUERIES["st_buffer_simplify"](spark, SMALL).collect())) == sorted((k, 3.0, 3) for k in keys)


def deal(b, value):
    """value and count by cell of 7 by 3, from every box."""
    out = {}
    for r in b.itertuples():
        for ix in range(int(r.x0 // 7), int(r.x1 // 7) + 1):
            for iy in range(int(r.y0 // 3), int(r.y1 // 3) + 1):
                q = (min(r.x1, ix * 7 + 7) - max(r.x0, ix * 7)) * (min(r.y1, iy * 3 + 3) - max(r.y0, iy * 3))
                if min(r.x1, ix * 7 + 7) > max(r.x0, ix * 7) and min(r.y1, iy * 3 + 3) > max(r.y0, iy * 3):
                    w, cell = q / ((r.x1 - r.x0) * (r.y1 - r.y0)), out.setdefault((ix, iy), [0.0, 0.0])
                    cell[0] += w * getattr(r, value)
                    cell[1] += w
    return out


@pytest.mark.parametrize("name", ["grid_apportion_boxes", "grid_apportion_polygons"])
def test_apportionment_deals_every_box(spark, name):
    want = deal(boxes(), "l_extendedprice")
    got = {(r.ix, r.iy): (r.value, r["count"]) for r in queries.QUERIES[name](spark, SMALL).collect()}
    assert got.keys() == want.keys()
    for cell, w in want.items():
        assert got[cell] == pytest.approx(w, rel=1e-6, abs=0.02)


def test_overlap_metric_takes_4096_boxes(spark):
    b = boxes()
    b["id"] = b.l_orderkey * 10 + b.l_linenumber
    b = b.sort_values("id").head(4096)
    x0, y0, x1, y1 = (b[c].to_numpy() for c in ("x0", "y0", "x1", "y1"))
    ids = b["id"].to_numpy()  # boxes of equal ids are not held against each other
    met = sum(int(((x0 <= x1[i]) & (x0[i] <= x1) & (y0 <= y1[i]) & (y0[i] <= y1) & (ids != ids[i])).sum()) for i in range(len(b)))
    got = queries.QUERIES["bbox_overlap_metric"](spark, SMALL).first()
    assert len(b) == 4096 and got.avg_overlaps == pytest.approx(met / len(b), abs=1e-6)
