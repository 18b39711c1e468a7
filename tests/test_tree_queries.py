"""The tree queries run the models' own defaults."""

import pytest

from seriesloom.catalogue import modelling


@pytest.mark.parametrize("name", ["forest_forecast", "boosted_forecast", "split_predictions", "grid_search"])
def test_no_reduced_parameters(monkeypatch, name):
    asked = []

    class Frame:
        def __getattr__(self, _):
            return lambda *args, **kwargs: self

    def record(df, **given):
        asked.append(set(given) - {"ts", "y", "keys", "kind"})
        return None, None

    monkeypatch.setattr(modelling, "daily_by_priority", lambda *args: Frame())
    monkeypatch.setattr(modelling.split, "chrono_split", lambda *args, **given: Frame())
    monkeypatch.setattr(modelling.trees, "fit_trees", record)
    monkeypatch.setattr(modelling.trees, "grid_search", record)
    monkeypatch.setattr(modelling.trees, "forecast_trees", lambda *args, **given: None)
    monkeypatch.setattr(modelling.trees, "predict_split", lambda *args, **given: None)
    getattr(modelling, name)(None, None)
    assert asked == [set()]
