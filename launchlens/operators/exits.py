"""Exit rules replayed on the price path of each position."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from launchlens.functions import nz
from launchlens.operators.policy import FEE, NETWORK_SOL

RULE_SCHEMA = (
    "rule_set string, tier_triggers array<double>, tier_sells array<double>, trail_pct double, trail_steps array<array<double>>, "
    "stop_loss_pct double, max_hold_min double, realized_lock boolean, reserve_share double, timeouts boolean, "
    "reentry_dip_pct double, reentry_share double"
)
OUT_SCHEMA = (
    "id long, rule_set string, mint_address int, exit_ms long, reason string, realized_sol double, cost_sol double, pnl_sol double, pnl_pct double, "
    "peak_pct double, tokens_left double, tiers_hit array<string>"
)


@dataclass
class ExitRules:
    """One row of the rule table. Percentages are percent, sells are shares of what is left.

    trail_steps: (peak from, retrace) pairs; the last pair reached applies and replaces trail_pct.
    """

    rule_set: str
    tier_triggers: list[float] = field(default_factory=list)
    tier_sells: list[float] = field(default_factory=list)
    trail_pct: float | None = None
    trail_steps: list[list[float]] = field(default_factory=list)
    stop_loss_pct: float = 40.0
    max_hold_min: float = 480.0
    realized_lock: bool = False
    reserve_share: float = 0.0
    timeouts: bool = False
    reentry_dip_pct: float | None = None
    reentry_share: float = 0.0


def exit_rule_sets(spark: SparkSession, rules: list[ExitRules]) -> DataFrame:
    """Rule table (P21); a handful of rows."""
    return spark.createDataFrame([tuple(asdict(r).values()) for r in rules], RULE_SCHEMA)


def price_path(trades: DataFrame, tick_ms: int) -> DataFrame:
    """Last price per token and tick: the policy looks at the market once per tick."""
    return (
        trades.filter("price_sol > 0").groupBy("mint_address", F.floor(F.col("ts_ms") / tick_ms).alias("tick"))
        .agg(F.max(F.struct("ts_ms", "trade_id", "price_sol")).alias("l"), F.count(F.lit(1)).alias("n"))
        .select("mint_address", "tick", F.col("l.ts_ms").alias("ts_ms"), F.col("l.price_sol").alias("price"), "n")
    )


#: Positions that enter one token in one block of time are dealt to groups of about this many.
GROUP_ROWS = 20_000


def _meet(positions: DataFrame, path: DataFrame, hold_ms: int, tick_ms: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Positions and ticks with common keys under which each position finds all ticks of its holding time: (positions, ticks, keys).

    A block is as long as the holding time, so a position needs the ticks of its own block and of the next; ticks are copied
    to those two, positions never. Where a block of a token holds many positions they are dealt over parts, each with its ticks."""
    width = hold_ms // tick_ms + 1
    tick = F.floor(F.col("entered_ms") / tick_ms)
    p = positions.withColumn("_block", F.floor(tick / width).cast("long"))
    own = F.floor(F.col("tick") / width).cast("long")
    ticks = path.filter("tick IS NOT NULL").withColumn("_block", F.explode(F.array(own - 1, own))).drop("tick")
    where = ["mint_address", "_block"]
    crowded = p.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("_parts")).filter("_parts > 1")
    crowded = F.broadcast(crowded)  # one row per GROUP_ROWS positions at most
    parts = F.coalesce("_parts", F.lit(1))
    p = p.join(crowded, where, "left").withColumn("_part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("_parts")
    ticks = ticks.join(crowded, where, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return p, ticks, [*where, "_part"]


def replay_exits(
    positions: DataFrame, trades: DataFrame, rules: DataFrame, as_of_ms: int, tick_ms: int = 5_000
) -> DataFrame:
    """Outcome of every (position, rule set): exit time and reason, realised SOL, peak, tiers.

    A position meets only the ticks of its own holding time, which is the longest of the rule table. Columns
    tier1..tier3 triggers and trail of the position (P6) are used by rule sets without tiers of their own.
    The ticks of a block stand in a task once for all its positions and rules; a fold stops where its position closes.
    Rows with the same id, token and entry meet each tick once per row.
    """
    table = [r.asDict() for r in rules.collect()]  # a handful of rules
    max_hold_ms = int(max((r["max_hold_min"] or 0 for r in table), default=0) * 60_000)
    tiers = [c for c in ("t1_trig", "t2_trig", "t3_trig", "trail_pct") if c in positions.columns]
    own = F.array(*[F.col(c) for c in tiers]).cast("array<double>") if len(tiers) == 4 else F.lit(None).cast("array<double>")
    rows = positions.select(
        "id", F.col("mint_address").cast("int").alias("mint_address"), "entered_ms", "entry_price", "entry_sol", "token_amount", own.alias("own_tiers"))
    path = price_path(trades, tick_ms).filter(F.col("ts_ms") <= as_of_ms).withColumn("mint_address", F.col("mint_address").cast("int"))
    p, ticks, keys = _meet(rows, path, max_hold_ms, tick_ms)

    def run(held: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        seen = seen.sort_values("ts_ms")
        ts, prices, counts = (seen[c].to_numpy() for c in ("ts_ms", "price", "n"))
        first = ts.searchsorted(held["entered_ms"].to_numpy(), "right")
        last = ts.searchsorted(held["entered_ms"].to_numpy() + max_hold_ms, "right")
        times = held.groupby(["id", "entered_ms"], dropna=False)["id"].transform("size").to_numpy()
        out = []
        for r, i, j, k in zip(held.to_dict("records"), first, last, times):
            for rule in table:
                out.append(_replay({**r, **rule}, as_of_ms, ts, prices, counts, i, j, k))
        return pd.DataFrame(out, columns=OUT_COLUMNS)

    return p.groupBy(*keys).cogroup(ticks.groupBy(*keys)).applyInPandas(run, OUT_SCHEMA)


OUT_COLUMNS = [c.split()[0] for c in OUT_SCHEMA.split(", ")]


def _missing(x) -> bool:
    return x is None or (isinstance(x, float) and x != x)


class PositionFold:
    """Small state machine of one position under one rule set: feed ticks in order, read the outcome.

    Used per row by the batch replay and per group by the streaming version.
    """

    STATE = ("left", "realized", "cost", "peak", "price", "last_ms", "seen", "reloaded", "n_hit")

    def __init__(self, r: dict, state: tuple | None = None):
        self.id, self.rule_set, self.token = int(r["id"]), r["rule_set"], int(r["mint_address"])
        self.entry, self.t_in, self.stake, self.tokens = r["entry_price"], int(r["entered_ms"]), r["entry_sol"], r["token_amount"]
        self.trig, self.sells = list(r["tier_triggers"]), list(r["tier_sells"])
        trail = r["trail_pct"]
        if not self.trig and r.get("own_tiers") is not None:
            *self.trig, trail = list(r["own_tiers"])
            self.sells = [0.4, 0.3, 0.3]
        self.trail = None if _missing(trail) else trail
        self.steps = [list(x) for x in r["trail_steps"]]
        self.dip = None if _missing(r["reentry_dip_pct"]) else r["reentry_dip_pct"]
        self.reentry, self.stop, self.hold_ms = r["reentry_share"], r["stop_loss_pct"], int(r["max_hold_min"] * 60_000)
        self.lock, self.timeouts, self.reserve = bool(r["realized_lock"]), bool(r["timeouts"]), r["reserve_share"] * self.tokens
        start = (self.tokens, 0.0, self.stake, 0.0, self.entry, self.t_in, 0, False, 0)
        for name, value in zip(self.STATE, state or start):
            setattr(self, name, value)

    def state(self) -> tuple:
        return tuple(getattr(self, n) for n in self.STATE)

    @property
    def hit(self) -> list[str]:
        return [f"T{i + 1}" for i in range(len(self.trig)) if self.n_hit >> i & 1]

    def _sell(self, n: float) -> float:
        return max(0.0, n * self.price * (1 - FEE) - NETWORK_SOL)

    def outcome(self, at: int, why: str) -> tuple:
        closing = why != "OPEN" and self.left > self.reserve
        total = self.realized + (self._sell(self.left - self.reserve) if closing else 0.0)
        pnl = total - self.cost
        return (
            self.id, self.rule_set, self.token, int(at), why, total, self.cost, pnl, pnl / self.cost * 100 if self.cost > 0 else 0.0, self.peak,
            self.reserve if closing else self.left, self.hit,
        )

    def waiting(self, until: int) -> tuple | None:
        """Outcome of the earliest waiting rule that fires before `until`, with price and peak unchanged."""
        cur = (self.price / self.entry - 1) * 100
        minute = lambda x: self.t_in + x * 60_000 + 1
        out = [(self.t_in + self.hold_ms, 4, "TIME_EXIT")]
        if self.timeouts:
            if self.peak < 10:
                out.append((max(self.last_ms + (10 if self.seen < 50 else 15) * 60_000 + 1, minute(10)), 0, "STALE_DATA"))
                out.append((max(minute(90), self.last_ms), 2, "NO_PUMP_TIMEOUT"))
            if self.peak < 5 and abs(cur) < 15:
                out.append((max(minute(60), self.last_ms), 1, "STALE_FLAT"))
            if 10 <= self.peak < 30 and cur < -10:
                out.append((max(minute(90), self.last_ms), 3, "STALLED_PUMP"))
        at, _, why = min(out)
        return self.outcome(at, why) if at < until else None

    def step(self, now: int, price: float, n: int) -> tuple | None:
        """One tick; returns the outcome when the position closes."""
        late = self.waiting(now)
        if late:
            return late
        self.price, self.last_ms, self.seen = price, now, self.seen + n
        cur = (price / self.entry - 1) * 100
        self.peak = max(self.peak, cur)
        if cur < -self.stop:
            return self.outcome(now, "STOP_LOSS")
        if self.dip is not None and not self.reloaded and self.peak >= 1 and cur <= -self.dip and now - self.t_in <= 1_800_000:
            add = self.reentry * self.stake
            self.reloaded, self.cost = True, self.cost + add
            self.left += max(0.0, add - NETWORK_SOL) * (1 - FEE) / price
            return None
        due = next((i for i, x in enumerate(self.trig) if not self.n_hit >> i & 1 and cur >= x), None)
        if due is not None:
            free = self.left - self.reserve
            part = free * min(1.0, self.sells[due])
            self.realized += self._sell(part)
            self.left, self.n_hit = self.left - part, self.n_hit | 1 << due
            return self.outcome(now, "TIERED_FULL") if self.left <= self.reserve + 1e-12 else None
        if self.lock and self.realized >= 0.5 * self.cost and cur <= 20:
            return self.outcome(now, "REALIZED_LOCK")
        give = next((s[1] for s in reversed(self.steps) if self.peak >= s[0]), None) if self.steps else (self.trail if self.n_hit else None)
        return self.outcome(now, "TRAIL_STOP") if give is not None and cur < self.peak - give else None


def _replay(r: dict, as_of_ms: int, ts, prices, counts, first: int, last: int, times: int) -> tuple:
    """Outcome of one position under one rule set over the ticks first..last, each taken `times` times."""
    fold = PositionFold(r)
    if _missing(fold.entry) or fold.entry <= 0:
        return fold.outcome(fold.t_in, "OPEN")
    for i in range(first, last):
        for _ in range(times):
            closed = fold.step(int(ts[i]), float(prices[i]), int(counts[i]))
            if closed:
                return closed
    end = min(as_of_ms, fold.t_in + fold.hold_ms)
    return fold.waiting(end + 1) or fold.outcome(end, "OPEN")


def first_barrier(
    positions: DataFrame, trades: DataFrame, take_profit_pct: float, stop_loss_pct: float, max_hold_ms: int, as_of_ms: int, tick_ms: int = 5_000
) -> DataFrame:
    """id, reason, exit_ms, realized_sol under one take-profit, one stop and one time limit: the barrier reached first decides.

    The ticks of a block stand in one row, which each of its positions reads; nothing is gathered per position. Positions without
    an id meet no ticks."""
    path = price_path(trades, tick_ms).filter(F.col("ts_ms") <= as_of_ms).drop("n")
    p, ticks, keys = _meet(positions.select("id", "mint_address", "entered_ms", "entry_price", "token_amount"), path, max_hold_ms, tick_ms)
    rows = ticks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ts_ms", "price"))).alias("path"))
    usable = (F.col("entry_price") > 0) & F.col("id").isNotNull()
    held = F.filter("path", lambda t: (t["ts_ms"] > F.col("entered_ms")) & (t["ts_ms"] <= F.col("entered_ms") + max_hold_ms))
    pct = lambda t: (t["price"] / F.col("entry_price") - 1) * 100
    beyond = F.filter("held", lambda t: (pct(t) < -stop_loss_pct) | (pct(t) >= take_profit_pct))
    x = p.join(rows, keys, "left").withColumn("held", F.when(usable, held)).drop("path")
    x = x.withColumn("hit", F.get(beyond, F.lit(0))).withColumn("last", F.try_element_at("held", F.lit(-1))).drop("held")
    x = x.withColumn("hit", F.when(F.col("hit").isNotNull(), F.struct("hit.ts_ms", "hit.price", pct(F.col("hit")).alias("pct"))))
    end = F.col("entered_ms") + max_hold_ms
    reason = (
        F.when(nz("entry_price") <= 0, "OPEN").when(F.col("hit").isNotNull(), F.when(F.col("hit.pct") < -stop_loss_pct, "STOP_LOSS").otherwise("TIERED_FULL"))
        .when(end <= as_of_ms, "TIME_EXIT").otherwise("OPEN")
    )
    exit_ms = F.when(nz("entry_price") <= 0, F.col("entered_ms")).otherwise(F.coalesce("hit.ts_ms", F.least(end, F.lit(as_of_ms))))
    price = F.coalesce("hit.price", "last.price", "entry_price")
    sold = F.greatest(F.lit(0.0), F.col("token_amount") * price * (1 - FEE) - NETWORK_SOL)
    return x.select("id", reason.alias("reason"), exit_ms.cast("long").alias("exit_ms"), F.when(reason == "OPEN", 0.0).otherwise(sold).alias("realized_sol"))


def ladder_value(trades: DataFrame, anchors: DataFrame, rules: DataFrame, as_of_ms: int, tick_ms: int, stake_sol: float = 0.1) -> DataFrame:
    """SOL gained per migrated token by entering at migration under an exit ladder."""
    p = anchors.filter("p > 0").select(
        F.col("mint_address").cast("long").alias("id"), "mint_address", F.col("anchor_ms").alias("entered_ms"), F.col("p").alias("entry_price"),
        F.lit(stake_sol).alias("entry_sol"), ((F.lit(stake_sol) - NETWORK_SOL) * (1 - FEE) / F.col("p")).alias("token_amount"),
    )
    out = replay_exits(p, trades, rules, as_of_ms, tick_ms)
    due = F.col("exit_ms").isNotNull() & (F.col("reason") != "OPEN")
    return out.select("mint_address", "rule_set", F.when(due, F.col("pnl_sol")).alias("post_mig_ev_with_ladder_sol"), "reason", nz("exit_ms", 0).alias("exit_ms"))
