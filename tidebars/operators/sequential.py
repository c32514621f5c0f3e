"""Operators whose next value needs the last one: recursions and stateful policies, grouped by run, day or account.

Each is one pass over a group's ordered rows in Arrow batches. Groups are continuity runs, dates or policies, whose
number grows with the data and whose size doesn't.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_group(rows: DataFrame, keys: list[str], order: list[str], add: dict[str, str], step: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> DataFrame:
    """rows with the columns `add` (name to type) that step computes from a group in order."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"{n} {t}" for n, t in add.items())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        return pdf.assign(**step(pdf))

    return rows.groupBy(*keys).applyInPandas(run, schema)


def ema_values(x: np.ndarray, n: int) -> np.ndarray:
    """Exponential mean with factor 2 / (n + 1), seeded with the mean of the first n."""
    out = np.full(len(x), np.nan)
    if len(x) < n:
        return out
    out[n - 1] = x[:n].mean()
    a = 2.0 / (n + 1)
    for i in range(n, len(x)):
        out[i] = out[i - 1] + a * (x[i] - out[i - 1])
    return out


def rsi_values(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's index: 100 where there is no loss but a gain, 50 where there is neither."""
    out = np.full(len(x), np.nan)
    if len(x) <= n:
        return out
    d = np.diff(x)
    gain, loss = np.maximum(d, 0), np.maximum(-d, 0)
    g, l = gain[:n].mean(), loss[:n].mean()  # noqa: E741
    for i in range(n, len(x)):
        if i > n:
            g, l = (g * (n - 1) + gain[i - 1]) / n, (l * (n - 1) + loss[i - 1]) / n  # noqa: E741
        out[i] = 100 - 100 / (1 + g / l) if l > 0 else (100.0 if g > 0 else 50.0)
    return out


def variance_path(shocks: np.ndarray, omega: float, alpha: float, beta: float, initial: float) -> np.ndarray:
    """s[t] = omega + alpha e[t-1]^2 + beta s[t-1]; a missing shock is zero."""
    out, s, e = np.empty(len(shocks)), initial, 0.0
    for i, x in enumerate(shocks):
        if i:
            s = omega + alpha * e * e + beta * s
        out[i] = s
        e = 0.0 if math.isnan(x) else x
    return out


def garch_likelihood(x: np.ndarray, omega: float, alpha: float, beta: float) -> float:
    s = variance_path(x, omega, alpha, beta, float(np.nanvar(x)))
    return float(0.5 * np.nansum(np.log(s) + x * x / s))


def fit_garch(x: np.ndarray, rounds: int = 60) -> tuple[float, float, float]:
    """(omega, alpha, beta) by a pattern search of the Gaussian likelihood with the variance targeted; alpha + beta < 1."""
    target = float(np.nanvar(x))
    at, step = np.array([0.08, 0.85]), 0.05
    value = lambda p: garch_likelihood(x, target * (1 - p.sum()), *p) if (p > 0).all() and p.sum() < 0.999 else math.inf
    best = value(at)
    for _ in range(rounds):
        for move in ((step, 0), (-step, 0), (0, step), (0, -step), (step, -step), (-step, step)):
            if (v := value(at + np.array(move))) < best:
                at, best = at + np.array(move), v
                break
        else:
            step /= 2
            if step < 1e-4:
                break
    return target * (1 - at.sum()), float(at[0]), float(at[1])


def kalman_level(x: np.ndarray, q: float, r: float, hide: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local level: prior state, standardised innovation and gain; the first rows are withheld."""
    prior, innovation, gain = (np.full(len(x), np.nan) for _ in range(3))
    level, p = (x[0], r) if len(x) else (0.0, r)
    for i, v in enumerate(x):
        p += q
        s = p + r
        if i >= hide:
            prior[i], innovation[i], gain[i] = level, (v - level) / math.sqrt(s), p / s
        level += p / s * (v - level)
        p *= 1 - p / s
    return prior, innovation, gain


def thin(minutes: np.ndarray, horizon: int) -> np.ndarray:
    """Keep a row when at least horizon minutes have passed since the last one kept."""
    keep, last = np.zeros(len(minutes), bool), -math.inf
    for i, m in enumerate(minutes):
        if m - last >= horizon:
            keep[i], last = True, m
    return keep


@dataclass(frozen=True)
class ExitRules:
    """Distances in price; a trailing stop or break-even move made by a bar holds from the next bar on."""

    stop: float
    target: float
    trail: float | None = None
    break_even: float | None = None
    hold: int = 12
    stop_first: bool = True


def flex_exit(side: int, entry: float, path: np.ndarray, rules: ExitRules) -> tuple[int, str, float, float, float]:
    """Offset, reason, price, best and worst excursion; path: high, low, close rows from the entry bar on."""
    stop, target = entry - side * rules.stop, entry + side * rules.target
    best = worst = 0.0
    for i, (high, low, close) in enumerate(path[: rules.hold]):
        good, bad = (high - entry, entry - low) if side == 1 else (entry - low, high - entry)
        best, worst = max(best, good), max(worst, bad)
        stopped = low <= stop if side == 1 else high >= stop
        reached = high >= target if side == 1 else low <= target
        if stopped and (rules.stop_first or not reached):
            return i, "stop", stop, best, worst
        if reached:
            return i, "target", target, best, worst
        if rules.break_even is not None and best >= rules.break_even:
            stop = max(stop, entry) if side == 1 else min(stop, entry)
        if rules.trail is not None:
            stop = max(stop, entry + best - rules.trail) if side == 1 else min(stop, entry - best + rules.trail)
        last = close
    full = len(path) >= rules.hold
    return min(len(path), rules.hold) - 1, "time_exit" if full else "boundary_exit", float(last), best, worst


def simulate_flex(bars: DataFrame, stop_atr: float, target_atr: float, trail_atr: float | None, break_even_atr: float | None, hold: int = 12) -> DataFrame:
    """One position at a time within each (product, date): long entries at the open after every in-session bar."""
    keep = bars.select("product", "trade_date", "run_id", "bar_id", "open", "high", "low", "close", "session", "atr20")
    schema = "product string, trade_date date, entry_bar long, exit_bar long, exit_reason string, gross_r double, mfe_r double, mae_r double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_id").reset_index(drop=True)
        path, run_id, out, free = pdf[["high", "low", "close"]].to_numpy(), pdf["run_id"].tolist(), [], -1
        for d in range(len(pdf) - 1):
            e, atr = d + 1, pdf["atr20"][d]
            if e <= free or run_id[e] != run_id[d] or pdf["session"][e] is None or not atr > 0:
                continue
            end = e
            while end < len(pdf) and run_id[end] == run_id[e]:
                end += 1
            rules = ExitRules(stop_atr * atr, target_atr * atr, None if trail_atr is None else trail_atr * atr, None if break_even_atr is None else break_even_atr * atr, hold)
            entry = float(pdf["open"][e])
            offset, reason, price, best, worst = flex_exit(1, entry, path[e:end], rules)
            free = e + offset
            out.append((pdf["product"][0], pdf["trade_date"][0], int(pdf["bar_id"][e]), int(pdf["bar_id"][free]), reason, (price - entry) / rules.stop, best / rules.stop, worst / rules.stop))
        return pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return keep.groupBy("product", "trade_date").applyInPandas(run, schema)


@dataclass(frozen=True)
class Policy:
    """An evaluation account: profit target, daily loss, drawdown that stands or trails, share of profit one day may make."""

    name: str
    balance: float = 50_000.0
    target: float = 3_000.0
    daily_loss: float = 1_200.0
    drawdown: float = 2_500.0
    trailing: bool = True
    best_day_share: float = 0.5
    least_days: int = 5


def evaluate_account(pnl: np.ndarray, policy: Policy) -> tuple[str, int, float]:
    """Outcome, day it came on (from 1) and equity: daily loss and floor are looked at before the target."""
    equity = peak = policy.balance
    best = 0.0
    for i, x in enumerate(pnl, 1):
        equity += x
        best = max(best, x)
        if x <= -policy.daily_loss:
            return "daily_loss", i, equity
        floor = (peak if policy.trailing else policy.balance) - policy.drawdown
        if equity <= floor:
            return "drawdown", i, equity
        peak = max(peak, equity)
        gain = equity - policy.balance
        if gain >= policy.target and i >= policy.least_days and best <= policy.best_day_share * gain:
            return "passed", i, equity
    return "open", len(pnl), equity


def prop_firm(daily: DataFrame, policies: list[Policy]) -> DataFrame:
    """policy, account, outcome, day, equity; daily: account, trade_date, pnl."""
    table = {p.name: p for p in policies}
    rows = daily.withColumn("policy", F.explode(F.array(*[F.lit(p.name) for p in policies])))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trade_date")
        outcome, day, equity = evaluate_account(pdf["pnl"].to_numpy(), table[pdf["policy"].iloc[0]])
        return pd.DataFrame([(pdf["policy"].iloc[0], pdf["account"].iloc[0], outcome, day, equity)], columns=["policy", "account", "outcome", "day", "equity"])

    return rows.groupBy("policy", "account").applyInPandas(run, "policy string, account string, outcome string, day long, equity double")


def challenge_rotation(pnl: np.ndarray, policy: Policy, accounts: int) -> list[tuple[int, int, str, float]]:
    """(attempt, days, outcome, equity) of accounts used one after the other until the days end."""
    out, at = [], 0
    for attempt in range(1, accounts + 1):
        if at >= len(pnl):
            break
        outcome, days, equity = evaluate_account(pnl[at:], policy)
        out.append((attempt, days, outcome, equity))
        at += days
    return out


def equity_curve(r: np.ndarray, start: float, risk: float) -> np.ndarray:
    """Account after each trade when a share of the current equity is at risk."""
    return start * np.cumprod(1 + risk * r)
