"""Point-in-time features over trailing windows, compiled from specifications.

A feature of an event at t is an aggregate over the same entity's events in [t - window, t), the far
edge floored to the resolution if there is one. An event never sees itself nor another of its instant;
an empty window gives -1; a null counts as one value of a distinct count.

Plan. An event at s is visible to moments in (s, expiry(s)], so it is two changes of a running total:
plus at s, minus at its expiry. Counts, sums and means of all windows of all entities are then running
sums over changes, linear in the events however dense a window is. A distinct count is the same with
one interval per value: an event adds the value if the one before it has expired, and takes it away if
the next one comes later. Greatest values of a window with a resolution are in-bucket running values
and those of the buckets before. An entity's events are exchanged once, by blocks of time; an event also
goes to the next block if it can be seen there, so nothing else has to move, and an entity with a third
of all events is spread over its blocks. The values of several entities meet in one aggregation by event.
Windows without an end have a running sum in two levels, inside blocks and over block totals; an extreme's
window without a resolution is the end of one window-long block and the start of the next.

Defined cases: an event without an entity's id has -1 for its features; a null field adds nothing to
sums, means and extremes (an empty rest gives -1); rows without event id or time are left out; events
are expected once (see `first_wins`): copies of an id may share one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.times import DAY, HOUR, MINUTE, floor_to
from tidemark.session import written

EMPTY = -1.0
NULL_VALUE = "\x00null"
AGGREGATIONS = ("count", "sum", "mean", "max", "min", "distinct_count", "seconds_since_last")
#: Length of the blocks that a hot entity is split into.
BLOCK = 6 * HOUR


@dataclass(frozen=True)
class FeatureSpec:
    """entity: the id column's name without _id. Lengths in microseconds; window None looks back for ever."""

    name: str
    entity: str
    aggregation: str
    field: str | None = None
    window: int | None = HOUR
    resolution: int | None = None

    def __post_init__(self):
        if self.aggregation not in AGGREGATIONS:
            raise ValueError(f"{self.name}: unknown aggregation {self.aggregation}")
        if (self.field is None) != (self.aggregation in ("count", "seconds_since_last")):
            raise ValueError(f"{self.name}: {self.aggregation} with field {self.field}")
        if self.window is not None and self.window <= 0:
            raise ValueError(f"{self.name}: a window is positive")
        if self.resolution is not None and (self.window is None or self.window % self.resolution or DAY % self.resolution):
            raise ValueError(f"{self.name}: a resolution divides its window and a day")

    @property
    def lane(self) -> str:
        return f"{self.window}_{self.resolution}"

    def start(self, us: Column) -> Column | None:
        """The first moment in the window of an event at us."""
        if self.window is None:
            return None
        return us - self.window if self.resolution is None else floor_to(us - self.window, self.resolution)

    def expiry(self, us: Column) -> Column | None:
        """The last moment that sees an event at us."""
        if self.window is None:
            return None
        return us + self.window if self.resolution is None else floor_to(us, self.resolution) + (self.resolution + self.window - 1)


def validate(specs: Sequence[FeatureSpec]) -> None:
    names = [s.name for s in specs]
    if len(set(names)) != len(names):
        raise ValueError("feature names repeat")


def features_on(specs: Sequence[FeatureSpec], columns: Sequence[str]) -> list[FeatureSpec]:
    """The specifications whose entity and field a source has."""
    return [s for s in specs if f"{s.entity}_id" in columns and (s.field is None or s.field in columns)]


#: The platform's sixteen features, in their order.
FEATURE_SET = (
    FeatureSpec("card_txn_count_1h", "card", "count"),
    FeatureSpec("card_txn_count_24h", "card", "count", None, DAY, HOUR),
    FeatureSpec("card_amount_sum_1h", "card", "sum", "amount_cents"),
    FeatureSpec("card_amount_mean_24h", "card", "mean", "amount_cents", DAY, HOUR),
    FeatureSpec("card_amount_max_24h", "card", "max", "amount_cents", DAY, HOUR),
    FeatureSpec("card_seconds_since_last", "card", "seconds_since_last", None, DAY, HOUR),
    FeatureSpec("card_distinct_merchants_24h", "card", "distinct_count", "merchant_id", DAY, HOUR),
    FeatureSpec("device_txn_count_1h", "device", "count"),
    FeatureSpec("device_distinct_cards_1h", "device", "distinct_count", "card_id"),
    FeatureSpec("device_distinct_cards_24h", "device", "distinct_count", "card_id", DAY, HOUR),
    FeatureSpec("device_amount_mean_1h", "device", "mean", "amount_cents"),
    FeatureSpec("merchant_txn_count_1h", "merchant", "count"),
    FeatureSpec("merchant_distinct_cards_1h", "merchant", "distinct_count", "card_id"),
    FeatureSpec("merchant_amount_mean_1h", "merchant", "mean", "amount_cents"),
    FeatureSpec("session_txn_count", "session", "count", None, 30 * MINUTE),
    FeatureSpec("session_amount_sum", "session", "sum", "amount_cents", 30 * MINUTE),
)
FEATURE_NAMES = tuple(s.name for s in FEATURE_SET)


def compute(txn: DataFrame, specs: Sequence[FeatureSpec] = FEATURE_SET, keep: Sequence[str] = ()) -> DataFrame:
    """(event_id, us, keep, a double for each specification). txn: event_id, us (micros), ids and fields.

    The columns needed are written to the shared folder once: they are read for each entity, and what made
    them (deduplication, say) would otherwise run as often."""
    validate(specs)
    needed = dict.fromkeys(["event_id", "us", *[f"{s.entity}_id" for s in specs], *[s.field for s in specs if s.field], *keep])
    return compute_again(written(txn.select(*needed), "events"), specs, keep)


def compute_again(txn: DataFrame, specs: Sequence[FeatureSpec], keep: Sequence[str] = ()) -> DataFrame:
    """compute over events that are cheap to read again and again: nothing is written."""
    validate(specs)
    own = {k: [s for s in specs if s.entity == k and _local(s)] for k in dict.fromkeys(s.entity for s in specs)}
    rest = [s for s in specs if not _local(s)]
    if not rest and len(own) == 1:
        # All of an event's values are made in one place.
        (entity,) = own
        nameless = txn.where(_usable() & F.col(f"{entity}_id").isNull()).select("event_id", "us", *keep, *[F.lit(EMPTY).alias(s.name) for s in specs])
        return _of_entity(txn, entity, specs, keep).unionByName(nameless)
    parts = [_of_entity(txn, k, of, ()) for k, of in own.items() if of]
    if rest:
        parts.append(assemble(txn, _results(txn, rest), rest, ()))
        if len(rest) == len(specs) and not keep:
            return parts[0]
    both = txn.where(_usable()).select("event_id", "us", *keep)
    for p in parts:
        both = both.unionByName(p.drop("us"), allowMissingColumns=True)
    return both.groupBy("event_id").agg(F.max("us").alias("us"), *[F.max(c).alias(c) for c in keep], *[F.coalesce(F.max(s.name), F.lit(EMPTY)).alias(s.name) for s in specs])


def narrow(txn: DataFrame, specs: Sequence[FeatureSpec]) -> DataFrame:
    """(event_id, us, entity, entity_id, features as a map): one row per event and entity that it has."""
    wide = compute(txn, specs, keep=sorted({f"{s.entity}_id" for s in specs}))
    kinds = sorted({s.entity for s in specs})
    rows = [
        F.struct(F.lit(k).alias("entity"), F.col(f"{k}_id").alias("entity_id"), F.create_map(*[x for s in specs if s.entity == k for x in (F.lit(s.name), F.col(s.name))]).alias("features"))
        for k in kinds
    ]
    return wide.select("event_id", "us", F.inline(F.array(*rows))).where(F.col("entity_id").isNotNull())


def _local(s: FeatureSpec) -> bool:
    """Whether the feature is made inside a block of time and what its events see of the block before."""
    return s.window is not None and (s.aggregation not in ("max", "min") or s.resolution is not None)


def _of_entity(txn: DataFrame, entity: str, specs: Sequence[FeatureSpec], keep: Sequence[str]) -> DataFrame:
    """(event_id, us, keep, features) of the events that have the entity's id, from one exchange of them. All windows
    below stay inside an entity's block, as it lies after that exchange."""
    reach = max(s.window + (s.resolution or 0) for s in specs)
    length = max(DAY, 5 * reach)
    us, block, zero = F.col("us"), floor_to(F.col("us"), length), F.lit(0).cast("long")
    fields = {s.field: f"f{i}" for i, s in enumerate(specs) if s.field}
    kept = {c: "id" if c == f"{entity}_id" else f"k{i}" for i, c in enumerate(keep)}
    # An event also goes to the next block if an event there can see it.
    blocks = F.array_compact(F.array(block, F.when(us + reach >= block + length, block + length)))
    rows = txn.where(_usable()).select(
        F.col(f"{entity}_id").alias("id"), "us", "event_id", *[F.col(c).alias(n) for c, n in fields.items()], *[F.col(c).alias(n) for c, n in kept.items() if n != "id"], F.explode(blocks).alias("block")
    ).where(F.col("id").isNotNull()).repartition("id", "block")
    # The hash leads, so that sorting seldom compares names.
    rows = rows.withColumn("h", F.xxhash64("id", "block"))
    keys = ["h", "id", "block"]

    plus, minus = {}, {}  # by lane: what an event adds where it comes into view and takes away where it leaves
    extremes = {}
    for i, s in enumerate(specs):
        field = F.col(fields[s.field]) if s.field else None
        if s.aggregation in ("max", "min"):
            best = F.max if s.aggregation == "max" else F.min
            bucket, v = f"b_{s.resolution}", field.cast("double")
            rows = rows.withColumn(bucket, floor_to(us, s.resolution))
            # Rows in order of time inside their bucket are in order of buckets: one sort serves both. The second
            # frame moves by whole buckets, so it is added up once for each.
            rows = rows.withColumn(f"i{i}", best(v).over(W.partitionBy(*keys, bucket).orderBy("us").rangeBetween(W.unboundedPreceding, -1)))
            before = best(v).over(W.partitionBy(*keys).orderBy(bucket).rangeBetween(-s.window, -1))
            rows = rows.withColumn(f"e{i}", before).withColumn(f"e{i}", (F.greatest if s.aggregation == "max" else F.least)(f"e{i}", f"i{i}")).drop(f"i{i}")
            extremes[f"e{i}"] = F.col(f"e{i}")
            continue
        adds, takes = plus.setdefault(s.lane, {}), minus.setdefault(s.lane, {})
        if s.aggregation == "count":
            adds[f"c_{s.lane}"] = takes[f"c_{s.lane}"] = F.lit(1).cast("long")
        elif s.aggregation in ("sum", "mean"):
            v = field.cast("long")
            for n, x in ((f"s_{s.lane}_{fields[s.field]}", F.coalesce(v, zero)), (f"n_{s.lane}_{fields[s.field]}", v.isNotNull().cast("long"))):
                adds[n] = takes[n] = x
        elif s.aggregation == "distinct_count":
            f = fields[s.field]
            if f"prev_{f}" not in rows.columns:
                same = W.partitionBy(*keys, F.coalesce(F.col(f).cast("string"), F.lit(NULL_VALUE))).orderBy("us")
                rows = rows.withColumns({f"prev_{f}": F.lag("us").over(same), f"next_{f}": F.lead("us").over(same)})
            prev, following = F.col(f"prev_{f}"), F.col(f"next_{f}")
            adds[f"d_{s.lane}_{f}"] = (prev.isNull() | (s.expiry(prev) < us)).cast("long")
            takes[f"d_{s.lane}_{f}"] = (following.isNull() | (following > s.expiry(us))).cast("long")
    sums = [n for of in plus.values() for n in of]

    def change(key: Column, asked: bool, of: dict[str, Column], sign: int) -> Column:
        carried = ["event_id", *[n for n in kept.values() if n != "id"]]
        return F.struct(
            key.alias("key"), F.lit(asked).alias("asked"), *[(F.col(c) if asked else F.lit(None).cast(dict(rows.dtypes)[c])).alias(c) for c in carried],
            *[(c if asked else F.lit(None).cast("double")).alias(n) for n, c in extremes.items()], *[(of[n] * sign if n in of else zero).alias(n) for n in sums],
        )

    changes = [change(us, True, {n: c for of in plus.values() for n, c in of.items()}, 1)]
    lanes = {s.lane: s for s in specs}
    changes += [change(lanes[lane].expiry(us), False, of, -1) for lane, of in minus.items() if of]
    # What leaves after the block's end is seen by none of its events.
    deltas = rows.select(*keys, F.inline(F.array(*changes))).where(F.col("key") < F.col("block") + length)
    asked = F.col("asked")
    inside = W.partitionBy(*keys).orderBy("key").rangeBetween(W.unboundedPreceding, -1)
    seen = {"seen": F.max(F.when(asked, F.col("key"))).over(inside)} if any(s.aggregation == "seconds_since_last" for s in specs) else {}
    running = deltas.withColumns({f"r_{n}": F.coalesce(F.sum(n).over(inside), zero) for n in sums} | seen).where(asked & (F.col("block") == floor_to(F.col("key"), length)))
    out = []
    for i, s in enumerate(specs):
        c, d = F.col(f"r_c_{s.lane}"), F.col(f"r_d_{s.lane}_{fields.get(s.field)}")
        t, n = (F.col(f"r_{x}_{s.lane}_{fields.get(s.field)}") for x in "sn")
        value = {
            "count": lambda c=c: F.when(c > 0, c.cast("double")), "sum": lambda t=t, n=n: F.when(n > 0, t.cast("double")), "mean": lambda t=t, n=n: F.when(n > 0, t.cast("double") / n),
            "distinct_count": lambda d=d: F.when(d > 0, d.cast("double")), "max": lambda i=i: F.col(f"e{i}"), "min": lambda i=i: F.col(f"e{i}"),
            "seconds_since_last": lambda s=s: F.when(F.col("seen") >= s.start(F.col("key")), (F.col("key") - F.col("seen")) / 1e6),
        }[s.aggregation]()
        out.append(F.coalesce(value, F.lit(EMPTY)).alias(s.name))
    return running.select("event_id", F.col("key").alias("us"), *[F.col(n).alias(c) for c, n in kept.items()], *out)


def assemble(txn: DataFrame, results: DataFrame, specs: Sequence[FeatureSpec], keep: Sequence[str]) -> DataFrame:
    """One row per event from its own row and its results' rows, one per window group."""
    base = txn.where(_usable()).select("event_id", "us", *keep)
    kinds = dict(base.dtypes)
    blank = {c: F.lit(None).cast(k).alias(c) for c, k in kinds.items()}
    numbers = [F.lit(None).cast(k).alias(c) for c, k in _RESULT]
    both = base.select("event_id", "us", *keep, *numbers).unionByName(results.select("event_id", blank["us"], *[blank[c] for c in keep], *[c for c, _ in _RESULT]))
    groups, slots = _groups([s for s in specs if s.aggregation not in ("max", "min")])
    out = []
    for i, s in enumerate(specs):
        if s.aggregation in ("max", "min"):
            of = F.when(F.col("g") == _EXTREME + i, F.col("v"))
            out.append(F.min(of) if s.aggregation == "min" else F.max(of))
            continue
        c, t, n, d, seen = (F.col(x) for x in ("c", "s", "n", "d", "seen"))
        value = {
            "count": F.when(c > 0, c.cast("double")), "sum": F.when(n > 0, t.cast("double")), "mean": F.when(n > 0, t.cast("double") / n),
            "distinct_count": F.when(d > 0, d.cast("double")), "seconds_since_last": F.when(F.lit(True) if s.window is None else seen >= s.start(F.col("key")), (F.col("key") - seen) / 1e6),
        }[s.aggregation]
        out.append(F.max(F.when(F.col("g") == slots[s.name], value)))
    return both.groupBy("event_id").agg(F.max("us").alias("us"), *[F.max(c).alias(c) for c in keep], *[F.coalesce(v, F.lit(EMPTY)).alias(s.name) for v, s in zip(out, specs, strict=True)])


#: A result's row: its window group, the sums, the last event seen, the event's time, and an extreme's value.
_RESULT = (("g", "int"), ("c", "bigint"), ("s", "bigint"), ("n", "bigint"), ("d", "bigint"), ("seen", "bigint"), ("key", "bigint"), ("v", "double"))
_EXTREME = 1000


def _usable() -> Column:
    return F.col("event_id").isNotNull() & F.col("us").isNotNull()


@dataclass
class _Group:
    """What runs in one pass: an entity's windows of one length, with at most one summed and one distinct field."""

    spec: FeatureSpec
    counts: bool = False
    summed: str | None = None
    distinct: str | None = None


def _groups(specs: Sequence[FeatureSpec]) -> tuple[list[_Group], dict[str, int]]:
    groups: list[_Group] = []
    slots: dict[str, int] = {}
    for s in specs:
        own = [(i, g) for i, g in enumerate(groups) if (g.spec.entity, g.spec.lane) == (s.entity, s.lane)]
        slot = {"sum": "summed", "mean": "summed", "distinct_count": "distinct"}.get(s.aggregation)
        found = next(((i, g) for i, g in own if slot is None or getattr(g, slot) in (None, s.field)), None)
        if found is None:
            found = (len(groups), _Group(s))
            groups.append(found[1])
        i, g = found
        g.counts = g.counts or s.aggregation == "count"
        if slot:
            setattr(g, slot, s.field)
        slots[s.name] = i
    return groups, slots


def _results(txn: DataFrame, specs: Sequence[FeatureSpec]) -> DataFrame:
    txn = txn.where(_usable())
    additive = [s for s in specs if s.aggregation not in ("max", "min")]
    parts = [_additive(txn, additive)] if additive else []
    parts += [_extreme(txn, s, _EXTREME + i) for i, s in enumerate(specs) if s.aggregation in ("max", "min")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _additive(txn: DataFrame, specs: Sequence[FeatureSpec]) -> DataFrame:
    groups, _ = _groups(specs)
    zero = F.lit(0).cast("long")

    def change(i: int, g: _Group, key: Column, sign: int) -> Column:
        v = F.col(g.summed).cast("long") if g.summed else None
        return F.struct(
            F.lit(i).alias("g"), F.col(f"{g.spec.entity}_id").alias("id"), key.alias("key"), (F.col("event_id") if sign > 0 else F.lit(None).cast("string")).alias("event_id"),
            F.lit(sign if g.counts else 0).cast("long").alias("c"), (F.coalesce(v, zero) * sign if g.summed else zero).alias("s"),
            (v.isNotNull().cast("long") * sign if g.summed else zero).alias("n"), zero.alias("d"),
        )

    rows = []
    for i, g in enumerate(groups):
        rows.append(change(i, g, F.col("us"), 1))
        if g.spec.window is not None and (g.counts or g.summed):
            rows.append(change(i, g, g.spec.expiry(F.col("us")), -1))
    deltas = txn.select(F.inline(F.array(*rows))).where(F.col("id").isNotNull())
    for i, g in enumerate(groups):
        if g.distinct:
            deltas = deltas.unionByName(_distinct_changes(txn, g, i))
    # Both uses below read this one exchange: the running sums, and the totals of the blocks.
    keys = ["g", "id", "block"]
    deltas = deltas.withColumn("block", F.expr(f"key div {BLOCK}")).where(F.col("block").isNotNull()).repartition(*keys)
    sums = ["c", "s", "n", "d"]
    asked = F.col("event_id").isNotNull()
    inside = W.partitionBy(*keys).orderBy("key").rangeBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("g", "id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = deltas.groupBy(*keys).agg(*[F.sum(c).alias(f"t_{c}") for c in sums], F.max(F.when(asked, F.col("key"))).alias("t_seen"))
    offsets = totals.select(*keys, "t_seen", *[F.coalesce(F.sum(f"t_{c}").over(before), zero).alias(f"b_{c}") for c in sums], F.max("t_seen").over(before).alias("b_seen")).where("t_seen IS NOT NULL").drop("t_seen")
    running = deltas.withColumns({f"i_{c}": F.coalesce(F.sum(c).over(inside), zero) for c in sums} | {"i_seen": F.max(F.when(asked, F.col("key"))).over(inside)}).where(asked)
    found = running.join(offsets, keys)
    return found.select("event_id", "g", *[(F.col(f"i_{c}") + F.col(f"b_{c}")).alias(c) for c in sums], F.greatest("i_seen", "b_seen").alias("seen"), "key", F.lit(None).cast("double").alias("v"))


def _distinct_changes(txn: DataFrame, g: _Group, number: int) -> DataFrame:
    """Plus one where a value comes into view for an entity, minus one where it leaves."""
    s = g.spec
    value = F.coalesce(F.col(g.distinct).cast("string"), F.lit(NULL_VALUE))
    bucket = s.resolution or s.window
    spans = (
        txn.select(F.col(f"{s.entity}_id").alias("id"), value.alias("v"), "us", (F.floor(F.col("us") / bucket) if bucket else F.lit(0)).alias("b"))
        .where(F.col("id").isNotNull())
        .groupBy("id", "v", "b")
        .agg(F.min("us").alias("first"), F.max("us").alias("last"))
        .withColumn("until", s.expiry(F.col("last")) if s.window else F.lit(None).cast("long"))
    )
    w = W.partitionBy("id", "v").orderBy("b")
    joined = spans.withColumns({"prev": F.lag("until").over(w), "next": F.lead("first").over(w)})
    comes = F.when(F.col("prev").isNull() | (F.col("prev") < F.col("first")), F.struct(F.col("first").alias("key"), F.lit(1).cast("long").alias("d")))
    goes = F.when(F.col("until").isNotNull() & (F.col("next").isNull() | (F.col("next") > F.col("until"))), F.struct(F.col("until").alias("key"), F.lit(-1).cast("long").alias("d")))
    rows = joined.select("id", F.inline(F.array_compact(F.array(comes, goes))))
    zero = F.lit(0).cast("long")
    return rows.select(F.lit(number).alias("g"), "id", "key", F.lit(None).cast("string").alias("event_id"), zero.alias("c"), zero.alias("s"), zero.alias("n"), "d")


def _extreme(txn: DataFrame, s: FeatureSpec, number: int) -> DataFrame:
    best = F.max if s.aggregation == "max" else F.min
    rows = txn.select("event_id", "us", F.col(f"{s.entity}_id").alias("id"), F.col(s.field).cast("double").alias("v")).where(F.col("id").isNotNull())
    blank = [(F.lit(number) if c == "g" else F.lit(None)).cast(k).alias(c) for c, k in _RESULT if c != "v"]
    if s.window is None:
        # In-block running value, and the totals of the blocks before.
        rows = rows.withColumn("b", F.floor(F.col("us") / BLOCK))
        prior = rows.groupBy("id", "b").agg(best("v").alias("t"))
        prior = prior.withColumn("t", best("t").over(W.partitionBy("id").orderBy("b").rowsBetween(W.unboundedPreceding, -1)))
        inside = W.partitionBy("id", "b").orderBy("us").rangeBetween(W.unboundedPreceding, -1)
        found = rows.withColumn("i", best("v").over(inside)).join(prior, ["id", "b"])
        return found.select("event_id", *blank, (F.greatest("i", "t") if s.aggregation == "max" else F.least("i", "t")).alias("v"))
    # The window of t is the end of one window-long block, from t - window on, and the start of the next.
    probes = rows.select("event_id", (F.col("us") - s.window).alias("key"), "id", F.lit(None).cast("double").alias("v"), F.lit(True).alias("probe"))
    data = rows.select("event_id", F.col("us").alias("key"), "id", "v", F.lit(False).alias("probe"))
    w = W.partitionBy("id", F.floor(F.col("key") / s.window)).orderBy("key")
    ends = best("v").over(w.rangeBetween(0, W.unboundedFollowing))
    starts = best("v").over(w.rangeBetween(W.unboundedPreceding, -1))
    found = data.unionByName(probes).withColumns({"ends": ends, "starts": starts})
    return found.select("event_id", *blank, F.when(F.col("probe"), F.col("ends")).otherwise(F.col("starts")).alias("v"))


def range_join_features(txn: DataFrame, specs: Sequence[FeatureSpec]) -> DataFrame:
    """The definition itself, as an oracle: every event joined with its window, blocks of window + resolution
    at a time. Quadratic in the window; for audits and tests. (event_id, features)"""
    out = txn.select("event_id")
    for s in specs:
        if s.window is None:
            raise ValueError("the definition is evaluated for bounded windows")
        size = s.window + (s.resolution or 0)
        value = F.coalesce(F.col(s.field).cast("string"), F.lit(NULL_VALUE)) if s.aggregation == "distinct_count" else (F.col(s.field).cast("double") if s.field else F.lit(1.0))
        past = txn.select(F.col(f"{s.entity}_id").alias("p_id"), F.col("us").alias("p_us"), F.floor(F.col("us") / size).alias("p_block"), value.alias("p_v"))
        now = txn.select("event_id", "us", F.col(f"{s.entity}_id").alias("id"), F.explode(F.sequence(F.floor(F.col("us") / size) - 1, F.floor(F.col("us") / size))).alias("block"))
        seen = now.join(past, (F.col("id") == F.col("p_id")) & (F.col("block") == F.col("p_block")) & (F.col("p_us") < F.col("us")) & (F.col("p_us") >= s.start(F.col("us"))))
        value = {
            "count": F.count("p_v").cast("double"), "sum": F.sum("p_v"), "mean": F.avg("p_v"), "max": F.max("p_v"), "min": F.min("p_v"),
            "distinct_count": F.count_distinct("p_v").cast("double"), "seconds_since_last": (F.max("us") - F.max("p_us")) / 1e6,
        }[s.aggregation]
        out = out.join(seen.groupBy("event_id").agg(value.alias(s.name)), "event_id", "left").withColumn(s.name, F.coalesce(s.name, F.lit(EMPTY)))
    return out


def first_row(rows: DataFrame, columns: Sequence[str], order: Sequence[str | Column]) -> Column:
    """An aggregate: the struct of `columns` of a group's first row by `order`, the other columns deciding ties.
    Columns that have no order of their own (maps) count by their JSON."""
    kinds = dict(rows.dtypes)
    named = {o for o in order if isinstance(o, str)}
    rest = [c for c in columns if c not in named]
    lead = [(F.col(o) if isinstance(o, str) else o).alias(f"__o{i}") for i, o in enumerate(order)]
    if not any("map<" in kinds[c] or "variant" in kinds[c] for c in columns):
        # The struct is its own order: the lead, then the columns.
        return F.min(F.struct(*lead, *columns))
    ranked = [F.to_json(F.struct(c)).alias(c) if "map<" in kinds[c] or "variant" in kinds[c] else F.col(c) for c in rest]
    return F.min_by(F.struct(*columns), F.struct(*lead, *ranked))


def first_wins(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in the order given; the rest of the columns decide ties. Rows are combined
    before the shuffle. Rows without key are left out."""
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(first_row(rows, [c for c in rows.columns if c != key], order).alias("b"))
    return best.select(*[F.col(key) if c == key else F.col("b")[c].alias(c) for c in rows.columns])


def latest_values(narrow_rows: DataFrame, as_of: int | None = None, ttl: int | None = None) -> DataFrame:
    """(entity, entity_id, us, features): each entity's newest row, none older than ttl before as_of."""
    rows = narrow_rows
    if as_of is not None:
        rows = rows.where(F.col("us") <= as_of)
        if ttl is not None:
            rows = rows.where(F.col("us") >= as_of - ttl)
    best = rows.groupBy("entity", "entity_id").agg(F.max_by(F.struct("event_id", "us", "features"), F.struct("us", "event_id")).alias("b"))
    return best.select("entity", "entity_id", "b.*")


def as_of_values(queries: DataFrame, states: DataFrame, id_col: str, at: str, state_at: str, values: Sequence[str], ttl: int) -> DataFrame:
    """queries with each state value as it was at or before the query's moment, not older than ttl; -1 if
    there is none. Queries and states are sorted together by entity and block; a block starts from the
    last state of the blocks before it, so a hot entity is spread over its blocks."""
    q = queries.select(*queries.columns, F.lit(1).alias("__q"), F.lit(None).cast("struct<us:bigint," + ",".join(f"{v}:double" for v in values) + ">").alias("__s"))
    blank = [F.lit(None).cast(kind).alias(c) for c, kind in queries.dtypes if c not in (id_col, at)]
    s = states.select(
        F.col(id_col), F.col(state_at).alias(at), *blank, F.lit(0).alias("__q"), F.struct(F.col(state_at).alias("us"), *[F.col(v).cast("double").alias(v) for v in values]).alias("__s")
    ).select(q.columns)
    both = q.unionByName(s).withColumn("__b", F.floor(F.col(at) / DAY))
    inside = W.partitionBy(id_col, "__b").orderBy(at, "__q").rowsBetween(W.unboundedPreceding, 0)
    ends = both.where("__q = 0").groupBy(id_col, "__b").agg(F.max("__s").alias("__end"))
    asked = both.where("__q = 1").select(id_col, "__b", F.lit(None).cast(ends.schema["__end"].dataType).alias("__end")).distinct()
    before = W.partitionBy(id_col).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    start = ends.unionByName(asked).groupBy(id_col, "__b").agg(F.max("__end").alias("__end")).select(id_col, "__b", F.last("__end", ignorenulls=True).over(before).alias("__before"))
    found = both.withColumn("__now", F.last("__s", ignorenulls=True).over(inside)).where("__q = 1").join(start, [id_col, "__b"], "left")
    state = F.coalesce("__now", "__before")
    fresh = state["us"] >= F.col(at) - ttl
    return found.select(*queries.columns, *[F.coalesce(F.when(fresh, state[v]), F.lit(EMPTY)).alias(v) for v in values])
