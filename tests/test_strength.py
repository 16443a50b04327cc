"""Queries with fitted models keep the library's rounds and history minimums."""

import inspect
from types import SimpleNamespace
from unittest.mock import MagicMock

import pytest

from foreslate.catalog import REGISTRY, model_queries as MQ
from foreslate.plans import models as M
from foreslate.plans import walkforward as WF

FITS = {
    "m3_winner_boost": (M, "fit_winner"), "m8_total_fit": (M, "fit_total"),
    "m12_player_fit": (M, "fit_players"), "m13_player_projection": (M, "fit_players"),
    "m14_walk_forward": (WF, "walk_forward"), "m14_backtest_summary": (WF, "walk_forward"),
    "m15_track_season": (WF, "track_season"), "m16_slate_forecast": (WF, "predict_slate"),
    "m17_slate_players": (WF, "project_players"), "m18_evaluate_season": (WF, "evaluate_season"),
}


@pytest.mark.parametrize("key", FITS)
def test_fits_at_full_strength(key, monkeypatch):
    module, name = FITS[key]
    told = inspect.signature(getattr(module, name))

    class Fitted(Exception):
        pass

    def stop(*args, **kwargs):
        raise Fitted(told.bind(*args, **kwargs).arguments)

    monkeypatch.setattr(module, name, stop)
    monkeypatch.setattr(MQ, "R", MagicMock())
    monkeypatch.setattr(MQ, "player_history", lambda fx: (MagicMock(), MagicMock()))
    with pytest.raises(Fitted) as found:
        REGISTRY[key].build(SimpleNamespace(player_weeks=None, games=None, injuries=None))
    given = found.value.args[0]
    for option in ("boost", "options", "minimum", "min_boost"):
        if option in told.parameters and option in given:
            assert given[option] == told.parameters[option].default


def test_slate_players_below_the_minimum(spark, monkeypatch):
    monkeypatch.setattr(MQ, "R", MagicMock())
    monkeypatch.setattr(WF, "project_players", lambda *args, **kwargs: None)
    rows = REGISTRY["m17_slate_players"].build(SimpleNamespace(spark=spark, games=None))
    assert rows.columns == ["player_id", "game_id", "team", "availability", *MQ.PROJECTIONS] and not rows.collect()
