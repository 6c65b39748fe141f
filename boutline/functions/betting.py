"""Odds, Kelly stakes and probability reconciliation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECONCILE_MODES = ("closer", "independent", "b_decides", "average")


def implied_prob(odds: Column) -> Column:
    return F.when(odds >= 0, F.lit(100.0) / (odds + 100)).otherwise(-odds / (-odds + F.lit(100.0)))


def net_return(odds: Column) -> Column:
    """Profit per unit staked when the bet wins."""
    return F.when(odds < 0, F.lit(100.0) / -odds).otherwise(odds / F.lit(100.0))


def kelly(odds: Column, p: Column) -> Column:
    n = net_return(odds)
    return F.try_divide(n * p - (1 - p), n)


def reconcile(mode: str, p_ab: Column, p_ba: Column, odds_a: Column, odds_b: Column) -> tuple[Column, Column]:
    """Win probabilities of both sides from the two corner orders of one matchup.

    ``closer`` lets each side keep the estimate nearer to its implied probability and falls back to the
    average when the sides disagree; ``independent`` stops before that check; ``b_decides`` derives A
    from B; ``average`` ignores the odds.
    """
    q_ab, q_ba = 1 - p_ab, 1 - p_ba
    mean_a = (p_ab + q_ba) / 2
    if mode == "average":
        return mean_a, 1 - mean_a
    ia, ib = implied_prob(odds_a), implied_prob(odds_b)
    a_other = F.abs(p_ab - ia) > F.abs(q_ba - ia)
    b_other = F.abs(p_ba - ib) > F.abs(q_ab - ib)
    if mode == "independent":
        return F.when(a_other, q_ba).otherwise(p_ab), F.when(b_other, q_ab).otherwise(p_ba)
    if mode == "b_decides":
        b = F.when(b_other, q_ab).otherwise(p_ba)
        return 1 - b, b
    if mode != "closer":
        raise ValueError(f"unknown mode {mode!r}")
    a = F.when(b_other, 1 - q_ab).when(a_other, q_ba).otherwise(p_ab)
    b = F.when(b_other, q_ab).when(a_other, 1 - q_ba).otherwise(p_ba)
    agree = F.abs(a + b - 1) <= 1e-9
    return F.when(agree, a).otherwise(mean_a), F.when(agree, b).otherwise(1 - mean_a)


def stake_share(
    k: Column, fraction: Column | float, cap: Column | float, flat: Column | float, rule: str = "kelly"
) -> Column:
    """Share of the bankroll to stake, NULL for no bet.

    ``kelly``: capped fraction with a flat floor, flat down to -0.5; ``tenth``: fraction of Kelly, else
    flat; ``positive``: capped fraction of positive Kelly only; ``flat``: flat whenever Kelly is
    positive.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    fraction, cap, flat = lit(fraction), lit(cap), lit(flat)
    if rule == "kelly":
        return F.when(k > 0, F.greatest(F.least(fraction * k, cap), flat)).when(k > -0.5, flat)
    if rule == "tenth":
        return F.when(k > 0, fraction * k).when(k.isNotNull(), flat)
    if rule == "positive":
        return F.when(k > 0, F.least(fraction * k, cap))
    if rule == "flat":
        return F.when(k > 0, flat)
    raise ValueError(f"unknown rule {rule!r}")


def settle(share: Column, odds: Column, pick: Column, winner: Column) -> Column:
    """Return as a share of the bankroll: profit, 0 for a draw or no bet, minus the stake."""
    return (
        F.when(share.isNull() | winner.isNull(), F.lit(0.0))
        .when(pick == winner, share * net_return(odds))
        .otherwise(-share)
    )
