"""Small bout tables and plain loops that state the expected results."""

import datetime as dt
import random

BOUT_SCHEMA = (
    "bout_id bigint, d date, red string, blue string, winner string, method string, is_title boolean, minutes double, "
    "red_kd double, blue_kd double, red_sig double, blue_sig double, red_sig_pct double, blue_sig_pct double, "
    "red_ctrl double, blue_ctrl double"
)


def random_bouts(count, names=6, seed=1, hot=None, days=10):
    """``hot`` is a name that takes part in every other bout."""
    rng = random.Random(seed)
    pool = [f"e{i}" for i in range(names)]
    rows = []
    for i in range(count):
        red, blue = rng.sample(pool, 2)
        if hot and i % 2 == 0:
            red, blue = hot, rng.choice([p for p in pool if p != hot])
        winner = rng.choice([red, blue, red, blue, None])
        num = lambda hi: None if rng.random() < 0.1 else float(rng.randint(0, hi))
        rows.append(
            (
                i, dt.date(2024, 1, 1) + dt.timedelta(days=i * days // count), red, blue, winner, rng.choice("AB"), rng.random() < 0.3,
                rng.choice([0.0, 5.0, 12.5]), num(3), num(3), num(50), num(50), rng.random(), rng.random(), num(5), num(5),
            )
        )
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, BOUT_SCHEMA)


def pyramid(n):
    return n * (n + 1) * (2 * n + 1) / 6


def replay_features(rows):
    """Pre-bout features by a plain loop: {(bout_id, side): {...}}."""
    state, out = {}, {}

    def fresh():
        return {"n": 0, "w": 0, "l": 0, "wins": 0, "titles": 0, "last": None, "kd_rate": 0.0, "kd_diff": 0.0, "def": 0.0}

    for r in rows:
        (i, d, red, blue, winner, _, title, minutes, rkd, bkd, _, _, rp, bp, _, _) = r
        for side, me in (("red", red), ("blue", blue)):
            s = state.setdefault(me, fresh())
            n = s["n"]
            out[i, side] = {
                "prior_bouts": n, "win_streak": s["w"], "lose_streak": s["l"], "wins": s["wins"], "title_wins": s["titles"],
                "layoff_days": None if s["last"] is None else (d - s["last"]).days,
                "kd_rate": s["kd_rate"] / pyramid(n) if n else None,
                "kd_diff": s["kd_diff"] / pyramid(n) if n else None,
                "sig_pct_def": s["def"] / pyramid(n) if n else None,
            }
        for me, own, opp, opp_pct in ((red, rkd, bkd, bp), (blue, bkd, rkd, rp)):
            s = state[me]
            s["n"] += 1
            sq = s["n"] ** 2
            if own is not None and opp is not None and minutes > 0:
                s["kd_rate"] += own * sq / minutes
                s["kd_diff"] += (own - opp) * sq
            if minutes > 0:
                s["def"] += (1 - opp_pct) * sq
            s["last"] = d
            if winner == me:
                s["w"], s["l"], s["wins"] = s["w"] + 1, 0, s["wins"] + 1
                s["titles"] += title
            elif winner is not None:
                s["w"], s["l"] = 0, s["l"] + 1
    return out


def replay_ratings(rows, pool_of=lambda r: r[5], frozen=False, fixed_k=None):
    """Pre-bout Elo ratings by a plain loop: {bout_id: (red, blue)}."""
    rating, bouts, out, waiting, day = {}, {}, {}, [], None

    def k(n):
        return fixed_k or (40 if n < 5 else 35 if n < 10 else 30 if n < 20 else 25)

    for r in rows:
        if frozen and r[1] != day:
            for key, change in waiting:
                rating[key] = rating.get(key, 1000.0) + change
            waiting, day = [], r[1]
        a, b = (pool_of(r), r[2]), (pool_of(r), r[3])
        ra, rb = rating.get(a, 1000.0), rating.get(b, 1000.0)
        out[r[0]] = (ra, rb)
        bouts[a], bouts[b] = bouts.get(a, 0) + 1, bouts.get(b, 0) + 1
        e = 1 / (1 + 10 ** ((rb - ra) / 400))
        s = 0.5 if r[4] is None else float(r[4] == r[2])
        moves = ((a, k(bouts[a]) * (s - e)), (b, k(bouts[b]) * (e - s)))
        if frozen:
            waiting += moves
        else:
            for key, change in moves:
                rating[key] = rating.get(key, 1000.0) + change
    return out
