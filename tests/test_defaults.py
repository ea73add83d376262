from unittest.mock import MagicMock

from brisa.operators import cox
from brisa.plans import queries_forecast, queries_statistics, queries_survival


def test_queries_run_at_the_defaults_of_their_operators(spark, monkeypatch):
    penalised, interval, of_cv, importance = MagicMock(), MagicMock(), MagicMock(), MagicMock()
    monkeypatch.setattr(cox, "fit_penalised", penalised)
    monkeypatch.setattr(queries_survival.A, "cohort", MagicMock())
    monkeypatch.setattr(queries_statistics, "table", MagicMock())
    monkeypatch.setattr(queries_statistics.T, "interval", interval)
    monkeypatch.setattr(queries_statistics.T, "bootstrap_interval", of_cv)
    queries_survival.cox_penalised(spark, "")
    queries_statistics.confidence_intervals(MagicMock(), "")
    queries_statistics.bootstrap_interval_of_cv(MagicMock(), "")
    assert "k" not in penalised.call_args.kwargs and len(of_cv.call_args.args) == 4
    assert all("replicates" not in c.kwargs for c in interval.call_args_list)
    model = queries_forecast._boosting()
    assert (model.trees, model.depth) == (60, 5)
    monkeypatch.setattr(queries_forecast, "_series", MagicMock())
    monkeypatch.setattr(queries_forecast, "_boosting", lambda: importance)
    queries_forecast.boosting_importance(spark, "")
    assert "repeats" not in importance.importance.call_args.kwargs
