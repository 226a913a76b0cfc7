"""Registered model queries do the whole job of the notebook."""
import math

import __spark_entry__ as E
from gearlens.plans import booster, catalog

SF = "/root/testdata/sf0.001"


def test_random_search_fits_what_it_draws(spark, monkeypatch):
    """The registered search on a small table: real fits over the whole spaces, of which
    fewer draws are taken here; the spaces and draws are the notebook's."""
    assert [(n, len(space)) for _, n, space in booster.SPACES.values()] == [(20, 8), (50, 6)]
    monkeypatch.setattr(booster, "SPACES", {k: (base, 3, space) for k, (base, _, space) in booster.SPACES.items()})
    got = E.queries()["random_search"](spark, SF).collect()
    assert [r.search for r in got] == ["depthwise"] * 3 + ["leafwise"] * 3
    assert all(-5 < r.mean_cv_r2 < 1 for r in got) and len({r.params for r in got}) == 6


def test_vif_of_all_encoded_columns(spark):
    got = {r.feature: r.vif for r in E.queries()["vif_encoded"](spark, SF).collect()}
    ff = catalog.PL.explore_features(catalog.inspections(spark, SF))
    assert set(got) - {"const"} <= set(ff.features) and len(got) > len(catalog._VIF_COLS) + 1
    assert any(math.isfinite(v) for v in got.values())
