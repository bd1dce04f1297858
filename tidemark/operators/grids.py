"""Grids of classification rules, every cell of them over one sort of the days.

A series has one row a calendar day, so a group of rows is bounded by the calendar.
The days of a series are sent once for each block of cells; inside, the states of all
cells of a block are columns of one matrix, worked out together in numpy.  What comes
back is a row a cell, and ranking, choice and budgets are DataFrame steps.

States are numbered as in STATES.  Scores that are null have the state ANOMALY.
Quantiles are linear between neighbours and rounded to six places.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the states by number.
STATES = ("CENTER", "I", "II", "III", "IV", "ANOMALY")
CENTER, ANOMALY = 0, 5
#: States with a name, by number.
NAMED = (1, 2, 3, 4)
#: Cells of one block.
BLOCK = 64


def quantile(values: np.ndarray, q: float) -> float:
    """Linear quantile of sorted values, NaN if there are none."""
    if not len(values):
        return float("nan")
    at = (len(values) - 1) * q
    low = int(np.floor(at))
    high = min(low + 1, len(values) - 1)
    return round(float(values[low] + (values[high] - values[low]) * (at - low)), 6)


def latched(x: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Signs with memory, a column a cell: entered at |x| >= high, left at |x| < low; NaN keeps the memory.  As series.hysteresis."""
    day = np.arange(1, len(x) + 1)[:, None]
    after = lambda hit: np.maximum.accumulate(np.where(hit, day, 0), axis=0)
    v = x[:, None]
    with np.errstate(invalid="ignore"):
        up = after(v >= high) > after((v < low) & ~(v >= high))
        down = after(v <= -high) > after((v > -low) & ~(v <= -high))
    return up.astype(np.int8) - down.astype(np.int8)


def quadrants(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Named state of two signs: (+, -) I, (+, +) II, (-, -) III, (-, +) IV."""
    return np.where(a > 0, np.where(b > 0, 2, 1), np.where(b > 0, 4, 3)).astype(np.int8)


def runs(states: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State and length in calendar days of each run of one column; the last ends a day after its last date."""
    first = np.flatnonzero(np.append(True, states[1:] != states[:-1]))
    return states[first], np.diff(np.append(day[first], day[-1] + 1))


def run_lengths(states: np.ndarray, day: np.ndarray) -> tuple[int, float, float, float]:
    """(number, mean, median) of the runs of named states, and the mean of all runs."""
    if not len(day):
        return 0, 0.0, 0.0, 0.0
    kind, size = runs(states, day)
    named = size[np.isin(kind, NAMED)]
    return len(named), float(named.mean()) if len(named) else 0.0, float(np.median(named)) if len(named) else 0.0, float(size.mean())


def delays(base: np.ndarray, test: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last, first) delays in days of test's reversals behind base's; 0 stands for null too.  As series.reversal_delays."""
    held = np.flatnonzero(base)
    if not len(held):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = held[np.append(True, base[held][1:] != base[held][:-1])]
    start, turn = start[:-1], start[1:]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index, n = np.arange(len(base)), len(base)
    sign = np.zeros(n, dtype=base.dtype)
    episode = np.searchsorted(start, index, "right") - 1
    sign[episode >= 0] = base[start][episode[episode >= 0]]
    sign[turn[-1] :] = 0
    last = lambda hit: np.maximum.accumulate(np.where(hit, index, -1))[turn - 1]
    lost = lambda hit: np.minimum(np.append(np.minimum.accumulate(np.where(hit, n, index)[::-1])[::-1], n)[start + 1], turn)
    b, t = base == sign, test == sign
    return day[last(b | t) + 1] - day[last(b) + 1], day[lost(t)] - day[lost(b)]


def _summary(values: np.ndarray, name: str) -> dict[str, float]:
    v = np.sort(values).astype(float)
    at = lambda q: quantile(v, q) if len(v) else 0.0
    return {f"{name}_median": at(0.5), f"{name}_q25": at(0.25), f"{name}_q75": at(0.75), f"{name}_max": int(v[-1]) if len(v) else 0}


def _counts(states: np.ndarray) -> dict[str, int]:
    return {f"n_{s.lower()}": int((states == k).sum()) for k, s in enumerate(STATES)}


def _pairs(states: np.ndarray, pairs: Sequence[Sequence[int]], at_least: int) -> int:
    return sum(int(np.isin(states, p).sum()) >= at_least for p in pairs)


def _sorted_days(rows: pd.DataFrame, day: str) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Rows by day, day numbers, month numbers, and the places of each month's last row."""
    rows = rows.sort_values(day).reset_index(drop=True)
    stamp = pd.to_datetime(rows[day])
    number = (stamp - pd.Timestamp("1970-01-01")).dt.days.to_numpy()
    month = (stamp.dt.year * 12 + stamp.dt.month - 1).to_numpy()
    return rows, number, month, np.flatnonzero(np.append(month[1:] != month[:-1], True))


def _blocks(df: DataFrame, n: int) -> DataFrame:
    """df once for each of n blocks of cells."""
    return df.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


_HYSTERESIS = "q double, kappa double, theta_a double, theta_b double, center_share double, quad_share double, n_center long, n_i long, n_ii long, n_iii long, n_iv long, n_anomaly long, daily_center_share double, daily_quad_share double, n_spells long, spell_mean double, spell_median double, pairs_ok long, delay_n long, delay_median double, delay_q25 double, delay_q75 double, delay_max long, hold_median double, hold_q25 double, hold_q75 double, hold_max long, held_share double, early_quad long, late_quad long"


def _fields(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"{k} {kinds[k]}, " for k in keys)


def hysteresis_grid(df: DataFrame, keys: list[str], day: str, a: str, b: str, qs: Sequence[float], kappas: Sequence[float], pairs: Sequence[Sequence[int]], at_least: int, early: str, late: str) -> DataFrame:
    """A row for each key, q and kappa: thresholds at quantile q of |score|, left at kappa times them.

    Of months, by their last day: counts of states, shares of CENTER and of named
    states, named months up to the month of early and from that of late on, and how
    many pairs have at_least months with a sign.  Of days: shares, runs of named states,
    delays of reversals behind kappa = 1 (delay: last, hold: first, both axes together)
    and the share of days whose signs differ from those.
    """
    cells = [(q, k) for q in qs for k in kappas]
    blocks = [cells[i : i + BLOCK] for i in range(0, len(cells), BLOCK)]
    split = lambda text: int(text[:4]) * 12 + int(text[5:7]) - 1

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows, number, month, ends = _sorted_days(rows, day)
        x = [rows[c].to_numpy(dtype=float) for c in (a, b)]
        size = [np.sort(np.abs(v[~np.isnan(v)])) for v in x]
        mine = blocks[int(rows["block"].iloc[0])]
        high = [np.array([quantile(s, q) for q, _ in mine]) for s in size]
        kappa = np.array([k for _, k in mine])
        missing = np.isnan(x[0]) | np.isnan(x[1])
        sign = [latched(v, h, kappa * h) for v, h in zip(x, high, strict=True)]
        base = [latched(v, h, h) for v, h in zip(x, high, strict=True)]
        state = np.where(missing[:, None], ANOMALY, np.where((sign[0] == 0) | (sign[1] == 0), CENTER, quadrants(*sign)))
        out = []
        for c, (q, k) in enumerate(mine):
            months = state[ends, c]
            named = np.isin(months, NAMED)
            spells = run_lengths(state[:, c], number)
            own = [[np.where(np.isnan(v), 0, s[:, c]) for v, s in zip(x, side, strict=True)] for side in (base, sign)]
            found = [delays(p, t, number) for p, t in zip(*own, strict=True)]
            last, first = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            held = (own[0][0] != own[1][0]) | (own[0][1] != own[1][1])
            out.append(
                {"q": q, "kappa": k, "theta_a": high[0][c], "theta_b": high[1][c], "center_share": (months == CENTER).sum() / len(months), "quad_share": named.sum() / len(months)}
                | _counts(months)
                | {"daily_center_share": (state[:, c] == CENTER).mean(), "daily_quad_share": np.isin(state[:, c], NAMED).mean(), "n_spells": spells[0], "spell_mean": spells[1], "spell_median": spells[2], "pairs_ok": _pairs(months, pairs, at_least), "delay_n": len(last)}
                | _summary(last, "delay")
                | _summary(first, "hold")
                | {"held_share": held.mean(), "early_quad": int((named & (month[ends] <= split(early))).sum()), "late_quad": int((named & (month[ends] >= split(late))).sum())}
            )
        done = pd.DataFrame(out)
        for i, key in enumerate(keys):
            done.insert(i, key, rows[key].iloc[0])
        return done

    rows = _blocks(df.select(*keys, day, a, b), len(blocks))
    return rows.groupBy(*keys, "block").applyInPandas(of, _fields(df, keys) + _HYSTERESIS)


def ranked(cells: DataFrame, keys: list[str], order: Sequence[Column]) -> DataFrame:
    """cells with their rank, from 1; the order has to leave no ties."""
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))  # a row a cell
    return cells.withColumn("rank", F.row_number().over(by.orderBy(*order)))


def choose(cells: DataFrame, keys: list[str], low: float, high: float, days: float, target: float) -> DataFrame:
    """cells with req_a (share of CENTER in low .. high), req_b (mean run of days at least), rank and kind; rank 1 is the chosen one.

    Among cells that meet both: greatest kappa, then CENTER nearest to target, then least
    q (kind solution).  If there are none, among those that meet req_a, or else among
    all: longest mean run, then as before (kind support).  Cells outside that set come
    after it, in the same order.
    """
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    out = cells.withColumns({"req_a": F.col("center_share").between(low, high), "req_b": F.col("spell_mean") >= days})
    solved, some = F.max(F.col("req_a") & F.col("req_b")).over(by), F.max("req_a").over(by)
    out = out.withColumns({"solved": solved, "some": some})
    inside = F.when(F.col("solved"), F.col("req_a") & F.col("req_b")).when(F.col("some"), F.col("req_a")).otherwise(F.lit(True))
    order = [F.desc("inside"), F.asc(F.when(F.col("solved"), F.lit(0.0)).otherwise(-F.col("spell_mean"))), F.desc("kappa"), F.asc(F.abs(F.col("center_share") - target)), F.asc("q")]
    out = ranked(out.withColumn("inside", inside), keys, order)
    return out.withColumn("kind", F.when(F.col("solved"), "solution").otherwise("support")).drop("solved", "some", "inside")


def limit_of_memory(cells: DataFrame, keys: list[str], low: float, high: float, days: float) -> DataFrame:
    """Of cells at kappa = 0, which no choice may take: which q has the longest mean run among those with CENTER in low .. high, and by how much it misses days."""
    by = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy(F.desc(F.col("center_share").between(low, high)), F.desc("spell_mean"), "q")
    out = cells.withColumn("within", F.col("center_share").between(low, high)).withColumn("best", (F.row_number().over(by) == 1) & F.col("within"))
    return out.select(*keys, "q", "center_share", "n_spells", "spell_mean", "within", "best", (F.lit(float(days)) - F.col("spell_mean")).alias("short"))


#: Which reading of the curve must agree with the named state (A), which quantile is taken (Q), which axes have to be small (B), how days make a month (C).
A_LEVELS = ("A0", "A1", "A2", "A3", "A4", "A5")
Q_LEVELS = ("Bq_B", "Bq_A20", "Bq_JOINT", "Bq_BQUAD")
B_LEVELS = ("OR", "AND")
C_LEVELS = ("C_M", "C_D", "C_W")
#: Codes of shapes beyond those of the states.
PARALLEL, TWIST, NO_AGREEMENT, NO_SHAPE = 6, 7, 8, 9
_RULES = "d string, a string, bc string, bq string, c string, q double, theta_a double, theta_b double, no_admissible boolean, center_share double, quad_share double, n_center long, n_i long, n_ii long, n_iii long, n_iv long, n_anomaly long, iii_any_day long, n_spells long, spell_mean double, spell_median double, spell_all double, smallest_share double, pairs_ok long, lift10 double, lift30 double"


def agrees(level: str, named: np.ndarray, shapes: dict[str, np.ndarray]) -> np.ndarray:
    """Whether the reading of the curve confirms the named state."""
    if level in ("A3", "A4"):
        return np.ones(len(named), dtype=bool)
    if level == "A1":
        return shapes["vote"] == named
    if level == "A2":
        return (shapes["s5"] == named) | (shapes["s10"] == named) | (shapes["s30"] == named)
    return shapes["n10" if level == "A5" else "s10"] == named


def vote(shapes: Sequence[np.ndarray]) -> np.ndarray:
    """Shape on which two of three windows agree; NO_AGREEMENT if none, NO_SHAPE if fewer than two windows have one."""
    x, y, z = shapes
    there = sum((s != NO_SHAPE).astype(int) for s in shapes)
    two = np.where((x == y) | (x == z), x, np.where(y == z, y, NO_AGREEMENT))
    two = np.where((two == NO_SHAPE) & (there == 2), NO_AGREEMENT, two)
    return np.where(there < 2, NO_SHAPE, two)


def modal(states: np.ndarray, month: np.ndarray, months: np.ndarray) -> np.ndarray:
    """Most frequent state of each month, the least number on ties; ANOMALY for months without rows."""
    place = np.searchsorted(months, month)
    counts = np.zeros((len(months), 16), dtype=np.int64)
    np.add.at(counts, (place, states), 1)
    return np.where(counts.sum(axis=1) > 0, counts.argmax(axis=1), ANOMALY)


def lift(states: np.ndarray, shape: np.ndarray) -> float:
    """Agreement of two namings over what independence would give, on months that both name; NaN without."""
    both = np.isin(states, NAMED) & np.isin(shape, NAMED)
    n = int(both.sum())
    by_chance = sum(int((states[both] == s).sum()) * int((shape[both] == s).sum()) for s in NAMED)
    return int((states[both] == shape[both]).sum()) / n / (by_chance / n / n) if by_chance else float("nan")


class _Days:
    """The sorted days of one series and scores D, with what its cells have in common."""

    def __init__(self, rows: pd.DataFrame, day: str, calibration: str):
        self.rows, self.number, self.month, self.ends = _sorted_days(rows, day)
        self.a, self.b = (self.rows[c].to_numpy(dtype=float) for c in ("a", "b"))
        self.missing = np.isnan(self.a) | np.isnan(self.b)
        self.named = quadrants(self.a, self.b)
        self.shapes = {c: self.rows[c].to_numpy(dtype=np.int64) for c in ("s5", "s10", "s30", "n10")}
        self.shapes["vote"] = vote([self.shapes[c] for c in ("s5", "s10", "s30")])
        self.early = (pd.to_datetime(self.rows[day]) <= pd.Timestamp(calibration)).to_numpy()
        # last day of each week
        week = (self.number + 3) // 7
        self.weeks = np.append(week[1:] != week[:-1], True)

    def states(self, level: str, both: bool, theta_a, theta_b) -> np.ndarray:
        """States at each pair of thresholds, a column each."""
        with np.errstate(invalid="ignore"):
            low_a, low_b = np.abs(self.a)[:, None] < theta_a, np.abs(self.b)[:, None] < theta_b
        small = low_a & low_b if both else low_a | low_b
        ok = agrees(level, self.named, self.shapes)
        return np.where(self.missing[:, None], ANOMALY, np.where(small | ~ok[:, None], CENTER, self.named[:, None]))

    def monthly(self, values: np.ndarray, rule: str) -> np.ndarray:
        if rule == "C_M":
            return values[self.ends]
        months = self.month[self.ends]
        return modal(values, self.month, months) if rule == "C_D" else modal(values[self.weeks], self.month[self.weeks], months)


def _calibrated(days: _Days, level: str, both: bool, qs: Sequence[float], spell: float, target: float) -> dict[str, tuple]:
    """(place in qs, not admissible) by rule of Q_LEVELS, from the days of calibration; empty without scores there."""
    size = [np.sort(np.abs(v[days.early & ~np.isnan(v)])) for v in (days.a, days.b)]
    theta = [np.array([quantile(s, q) for q in qs]) for s in size]
    state = days.states(level, both, *theta)[days.early]
    if not len(state) or not len(size[0]) or not len(size[1]):
        return {}
    lengths = [run_lengths(state[:, i], days.number[days.early]) for i in range(len(qs))]
    centre = (state == CENTER).mean(axis=0)
    enough = {"Bq_B": [x[3] >= spell for x in lengths], "Bq_BQUAD": [x[1] >= spell for x in lengths]}
    out = {k: (v.index(True), False) if any(v) else (len(qs) - 1, True) for k, v in enough.items()}
    out["Bq_A20"] = (int(np.argmin(np.abs(np.array(qs) - target))), False)
    nearest = int(np.argmin(np.round(np.abs(centre - target), 9)))
    out["Bq_JOINT"] = (nearest, bool(abs(centre[nearest] - target) > 0.05))
    return {k: (i, bad, float(theta[0][i]), float(theta[1][i])) for k, (i, bad) in out.items()}


def rule_grid(df: DataFrame, keys: list[str], day: str, levels: Sequence[str], qs: Sequence[float], pairs: Sequence[Sequence[int]], at_least: int, calibration: str, spell: float, target: float = 0.2) -> DataFrame:
    """A row for each key and cell (d, a, bc, bq, c) of the rules; df: keys, day, d (one of levels), scores a and b, codes of shapes s5, s10, s30 and n10.

    Thresholds are quantiles of |score| on the days up to calibration: the least q whose
    runs (Bq_B: all, Bq_BQUAD: of named states) have a mean of spell days, else the last;
    the q nearest to target (Bq_A20); the q whose share of CENTER is nearest to it
    (Bq_JOINT), not admissible if that is farther than 0.05.  Without scores there, all
    days are ANOMALY and the thresholds null.
    """

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        days, out = _Days(rows, day, calibration), []
        shape = {(c, w): days.monthly(days.shapes[w], c) for c in C_LEVELS for w in ("s10", "s30")}
        for a in A_LEVELS:
            for bc in B_LEVELS:
                chosen = _calibrated(days, a, bc == "AND", qs, spell, target)
                for bq in Q_LEVELS:
                    at, bad, ta, tb = chosen.get(bq, (None, True, float("nan"), float("nan")))
                    daily = days.states(a, bc == "AND", np.array([ta]), np.array([tb]))[:, 0] if at is not None else np.full(len(days.a), ANOMALY)
                    n, mean, mid, every = run_lengths(daily, days.number)
                    any_day = len(np.unique(days.month[daily == 3]))
                    for c in C_LEVELS:
                        months = days.monthly(daily, c)
                        counts = _counts(months)
                        named = [int((months == s).sum()) for s in NAMED]
                        out.append(
                            {"d": days.rows["d"].iloc[0], "a": a, "bc": bc, "bq": bq, "c": c, "q": float("nan") if at is None else qs[at], "theta_a": ta, "theta_b": tb, "no_admissible": bad, "center_share": counts["n_center"] / len(months), "quad_share": sum(named) / len(months)}
                            | counts
                            | {"iii_any_day": any_day, "n_spells": n, "spell_mean": mean, "spell_median": mid, "spell_all": every, "smallest_share": min(named) / sum(named) if sum(named) else 0.0, "pairs_ok": _pairs(months, pairs, at_least), "lift10": lift(months, shape[c, "s10"]), "lift30": lift(months, shape[c, "s30"])}
                        )
        done = pd.DataFrame(out)
        for i, key in enumerate(keys):
            done.insert(i, key, rows[key].iloc[0])
        return done

    rows = df.where(F.col("d").isin(*levels)).select(*keys, day, "d", "a", "b", "s5", "s10", "s30", "n10")
    done = rows.groupBy(*keys, "d").applyInPandas(of, _fields(df, keys) + _RULES)
    null = lambda c: F.when(~F.isnan(c), F.col(c))
    return done.withColumns({c: null(c) for c in ("q", "theta_a", "theta_b", "lift10", "lift30")})


def scored(cells: DataFrame, least_share: float, spell: float, least_state: float, least_pairs: int) -> DataFrame:
    """cells with what they meet: s1 share of named months, s2 mean run, s3 every state named and none under a share, s4 pairs; and met, their number."""
    every = (F.col("n_i") > 0) & (F.col("n_ii") > 0) & (F.col("n_iii") > 0) & (F.col("n_iv") > 0)
    out = cells.withColumns({"s1": F.col("quad_share") >= least_share, "s2": F.col("spell_mean") >= spell, "s3": every & (F.col("smallest_share") >= least_state), "s4": F.col("pairs_ok") >= least_pairs})
    return out.withColumn("met", sum((F.col(s).cast("int") for s in ("s1", "s2", "s3", "s4")), F.lit(0)))


def rank_rules(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Ranking of scored cells: most criteria met, most pairs, most named months, then the cell's name A|Bq|Bc|C|D."""
    name = F.concat_ws("|", "a", "bq", "bc", "c", "d")
    return ranked(cells.withColumn("cell", name), keys, [F.desc("met"), F.desc("pairs_ok"), F.desc("quad_share"), F.asc("cell")])


#: What is taken away, as (name, reading of the curve, share of the thresholds that stays).
REMOVALS = (("none", "A0", 1.0), ("reading", "A4", 1.0), ("parallel rule", "A5", 1.0), ("thresholds", "A0", 0.0), ("thresholds and reading", "A4", 0.0))


def silence_budget(df: DataFrame, keys: list[str], day: str, thresholds: DataFrame) -> DataFrame:
    """(keys, removed, months, named, iii, spell_mean): named months when one restraint goes and the others stay.

    df as for rule_grid, of one d; thresholds: (keys, theta_a, theta_b), a row a series.
    """

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        days, out = _Days(rows, day, "1970-01-01"), []
        for name, level, share in REMOVALS:
            daily = days.states(level, False, np.array([share * rows["theta_a"].iloc[0]]), np.array([share * rows["theta_b"].iloc[0]]))[:, 0]
            months = daily[days.ends]
            out.append({"removed": name, "months": len(months), "named": int(np.isin(months, NAMED).sum()), "iii": int((months == 3).sum()), "spell_mean": run_lengths(daily, days.number)[1]})
        done = pd.DataFrame(out)
        for i, key in enumerate(keys):
            done.insert(i, key, rows[key].iloc[0])
        return done

    rows = df.join(thresholds, keys)
    return rows.groupBy(*keys).applyInPandas(of, _fields(df, keys) + "removed string, months long, named long, iii long, spell_mean double")


def shape_code(shape: Column) -> Column:
    """Number of a curve's shape."""
    names = [F.lit(x) for i, s in enumerate((*STATES, "PARALLEL", "TWIST", "NOAGREE")) for x in (s, i)]
    return F.coalesce(F.try_element_at(F.create_map(*names), shape), F.lit(NO_SHAPE)).cast("int")


def shape_vote(shapes: Sequence[Column]) -> Column:
    """Shape on which two or more of three windows agree, NOAGREE if none do, null with fewer than two windows."""
    x, y, z = shapes
    there = sum((s.isNotNull().cast("int") for s in shapes), F.lit(0))
    return F.when(there < 2, None).when((x == y) | (x == z), x).when(y == z, y).otherwise("NOAGREE")
