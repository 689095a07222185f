"""The entry points named after the original helpers give the library's results."""

import pytest

from contactlift import api
from contactlift.plans import fixtures as FX
from paths import SF_SMALL


def test_seeds(spark):
    assert len(api.SEED_LIST) == 121 and api.SEED_LIST[0] == 123457
    assert [r["seed"] for r in api.get_seeds(spark, 3).collect()] == [123457, 102191, 253751]


def test_facade_matches_library(spark):
    scored = FX.scored(spark, SF_SMALL)
    p = api.score_prediction(scored).first()["profit"]
    from contactlift.operators import metrics as M
    assert p == M.profit_score(scored).first()["profit"]
    auc, curve = api.get_roc_data(scored)
    assert 0 <= auc.first()["auc"] <= 1 and curve.count() > 1
    cards = FX.cards(spark, SF_SMALL)
    parts = api.split_train_test_df(cards)
    assert parts["train"].count() + parts["test"].count() == cards.count()
    h = api.holder(cards)
    assert h.mean == pytest.approx(h.df.where("clase01 = 1").count() / h.df.count())
    assert api.summary_group(cards, "clase").count() == 2
