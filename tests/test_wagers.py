"""Money columns of the registered bankroll queries."""

from boutline.plans import wagers


def test_path_and_report_name_their_own_columns(spark, sf):
    money = ["bankroll_before", "bankroll", "max_bankroll", "min_bankroll"]
    assert wagers.bankroll_path(spark, sf).columns == ["strategy", "red", "bout_id", *money]
    logs = [f"log_{side}_{kind}" for side in ("favourite", "underdog") for kind in ("gain", "loss")]
    assert set(logs) < set(wagers.bankroll_report(spark, sf).columns)
