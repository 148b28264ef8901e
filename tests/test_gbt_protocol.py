"""The registered GBT queries fit the trees of the protocol."""

import pytest

from perfweave.config import GBT_DEFAULTS
from perfweave.plans import catalog


@pytest.mark.parametrize("key", ["oof_gbt", "logo_gbt"])
def test_registered_gbt_fits_the_whole_protocol(spark, monkeypatch, key):
    seen = []

    class Fitted(Exception):
        pass

    def fit(*args, params=None, **kw):
        seen.append({**GBT_DEFAULTS, **(params or {})})
        raise Fitted

    monkeypatch.setattr(catalog.gbt, "oof_gbt", fit)
    with pytest.raises(Fitted):
        catalog.REGISTRY[key](spark, "/root/testdata/sf0.001")
    assert seen == [GBT_DEFAULTS] and GBT_DEFAULTS["max_iter"] == 800 and GBT_DEFAULTS["max_depth"] == 9
