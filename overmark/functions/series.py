"""Best-of-N series helpers as Column expressions.

``series_win_prob`` replaces the literal enumeration of all 2^n win/loss
paths (n·2^n rows per series and team, then two windows and an aggregate)
with a distribution fold over the n scheduled games: one Column, no
explode, no shuffle.  Because every schedule has n = 2·need − 1 games and
games after a clinch are still "played", exactly one side reaches ``need``
wins on every path, so the clinch probability equals P(wins ≥ need).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .safe import ColumnOrName, _c, greatest_nn, least_nn, slug

# Series formats by era (wins needed, venue sequence from the
# higher seed's point of view).  Rows are tested in order; the last is the
# default.  ``label`` is a LIKE pattern on the lower-cased round label.
SERIES_FORMATS = [
    # (first_year, last_year, label_like, wins_needed, schedule)
    (1977, 1983, "%first%", 2, ["H", "A", "H"]),
    (1984, 2002, "%first%", 3, ["H", "H", "A", "A", "H"]),
    (1985, 2013, "%final%", 4, ["H", "H", "A", "A", "A", "H", "H"]),
]
DEFAULT_FORMAT = (4, ["H", "H", "A", "A", "H", "A", "H"])


def series_key(ts: ColumnOrName, label: ColumnOrName,
               team_a: ColumnOrName | None = None, team_b: ColumnOrName | None = None) -> Column:
    """Series id: slug of year ‖ label [‖ min(team) ‖ max(team)].

    Any NULL part makes the id NULL (concat and least/greatest propagate).
    """
    parts = [F.year(_c(ts).cast("timestamp")).cast("string"), _c(label)]
    if team_a is not None:
        a, b = _c(team_a).cast("bigint"), _c(team_b).cast("bigint")
        parts += [least_nn(a, b).cast("string"), greatest_nn(a, b).cast("string")]
    return slug(F.concat(*parts))


def _format_case(year: Column, label: Column, pick):
    y = year.try_cast("bigint")
    lab = F.lower(label)
    expr = None
    for lo, hi, like, need, sched in SERIES_FORMATS:
        cond = y.between(lo, hi) & lab.like(like)
        val = pick(need, sched)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(pick(*DEFAULT_FORMAT))


def series_required_wins(year: ColumnOrName, label: ColumnOrName) -> Column:
    # The wins column only distinguishes the first-round rules; a final in
    # 1985–2013 still needs 4 wins, like the default.
    return _format_case(_c(year), _c(label), lambda need, sched: F.lit(need))


def series_schedule(year: ColumnOrName, label: ColumnOrName) -> Column:
    return _format_case(_c(year), _c(label),
                        lambda need, sched: F.array(*[F.lit(s) for s in sched]))


def scheduled_probs(schedule: ColumnOrName, first_game_prob: ColumnOrName,
                    player_home: ColumnOrName, mirror_venue: bool = False) -> Column:
    """Per-game win probability of the player's side along the schedule.

    Faithful default: a side that is at home in game 1 (``player_home = 1``)
    wins 'H' games with ``p`` and 'A' games with ``1 - p``; the visitor wins
    'A' games with ``p`` and 'H' games with ``1 - p``, where ``p`` is its own
    game-1 probability.  ``mirror_venue=True`` instead gives the visitor
    ``1 - p`` at its own home venue, so both sides' series odds sum to 1.
    """
    p = _c(first_game_prob)
    h = _c(player_home)

    def per_game(loc):
        if mirror_venue:
            return (F.when((loc == "H") & (h == 1), p)
                    .when((loc == "A") & (h == 0), F.lit(1) - p)
                    .when((loc == "H") & (h == 0), p)
                    .when((loc == "A") & (h == 1), F.lit(1) - p))
        return (F.when((loc == "H") & (h == 1), p)
                .when((loc == "A") & (h == 0), p)
                .when((loc == "H") & (h == 0), F.lit(1) - p)
                .when((loc == "A") & (h == 1), F.lit(1) - p))

    return F.transform(_c(schedule), per_game)


def series_win_prob(probs: ColumnOrName, need: ColumnOrName) -> Column:
    """P(at least ``need`` wins) over independent games with ``probs``.

    Folds the win-count distribution game by game:
    v'[i] = v[i]·(1−q) + v[i−1]·q, starting from v = [1, 0, …, 0], then sums
    v[need..n].  NULL if any probability is NULL.
    """
    probs = _c(probs)
    n = F.size(probs)
    init = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == 0, F.lit(1.0)).otherwise(F.lit(0.0)))

    def step(v, q):
        return F.transform(
            v, lambda x, i: x * (F.lit(1.0) - q)
            + F.when(i == 0, F.lit(0.0)).otherwise(F.get(v, i - 1)) * q)

    dist = F.aggregate(probs, init, step)
    tail = F.slice(dist, _c(need) + 1, n + 1)
    return F.aggregate(tail, F.lit(0.0), lambda acc, x: acc + x)


def series_forecast(schedule: ColumnOrName, first_game_prob: ColumnOrName,
                    player_home: ColumnOrName, need: ColumnOrName,
                    mirror_venue: bool = False) -> Column:
    """Series win probability; 0 (not NULL) when the game-1 probability or
    the venue flag is unknown, as in the reference."""
    probs = scheduled_probs(schedule, first_game_prob, player_home, mirror_venue)
    return F.coalesce(series_win_prob(probs, need), F.lit(0.0))
