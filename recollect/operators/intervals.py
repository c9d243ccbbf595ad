"""Points against the spans that hold them, and attested runs against the audit: joins by equality only.

A span is cut into dyadic cells (a cell of level l is 2^l long and begins at a multiple of that): at most two of each
level, none overlapping, together the span exactly. A point lies in one cell of each level, so a point and a span that
holds it have exactly one cell in common: an equality join on (keys, level, cell) gives each pair once, with nothing to
check afterwards, whether spans are long or short. Cells with more than CELL_SPANS spans are dealt into lanes, and the
points of such a cell go to all of its lanes.

Keys with FEW spans and less are joined as they are, each point with its key's few spans: that moves every row once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import temporal as D

CELL_SPANS, FEW = 100_000, 64
#: Days, hours, minutes, seconds and milliseconds in microseconds.
UNITS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000)


def _cells(low: Column, high: Column, levels: int) -> Column:
    """The dyadic cells (level, cell) that make up [low, high)."""

    def of(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level).cast("long")
        a, b = F.floor((low + size - 1) / size).cast("long"), F.floor(high / size).cast("long")
        cell = lambda at: F.struct(level.cast("int").alias("level"), at.alias("cell"))
        none = F.lit(None).cast("struct<level:int,cell:bigint>")
        return F.array(F.when((a < b) & (a % 2 == 1), cell(a)).otherwise(none), F.when((a < b) & (b % 2 == 1), cell(b - 1)).otherwise(none))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of)))


def stabbed(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Every point beside every span of its keys with start <= at < end; a null start or end is open. Instants are whole
    numbers (less than 2^52 from the first to the last); columns of both sides but the keys must differ in name. Points
    with a null key or instant, spans with a null key and empty spans meet nothing."""
    full = spans.groupBy(*keys).agg(F.count("*").alias("_held")).filter(F.col("_held") > FEW).select(*keys)
    # exploded rows are many more than their estimate says: no join of points and spans may ship a side whole
    light = points.join(spans.join(full, keys, "left_anti").hint("merge"), keys)
    light = light.filter(F.col(at).isNotNull() & (F.col(start).isNull() | (F.col(start) <= F.col(at))) & (F.col(end).isNull() | (F.col(end) > F.col(at))))
    if full.isEmpty():
        return light
    return light.unionByName(_by_cells(points.join(full, keys, "left_semi"), spans.join(full, keys, "left_semi"), keys, at, start, end))


def _by_cells(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """``stabbed`` by the cells that points and spans have in common."""
    edges = points.agg(F.min(at).alias("lo"), F.max(at).alias("hi"), *((F.min(F.pmod(at, F.lit(u))) == F.max(F.pmod(at, F.lit(u)))).alias(f"u{u}") for u in UNITS)).first()
    if edges["lo"] is None:
        return points.join(spans, keys).limit(0)
    # in the largest unit that all points are whole numbers of, counted from the first one, there are fewer levels
    unit, lowest = next((u for u in UNITS if edges[f"u{u}"]), 1), edges["lo"]
    levels = max(1, int((edges["hi"] - lowest) // unit + 1).bit_length())
    # nothing lies before the first point or after the last
    place = lambda edge: F.ceil((F.col(edge) - lowest) / unit)
    low = F.greatest(F.coalesce(place(start), F.lit(0)), F.lit(0)).cast("long")
    high = F.least(F.coalesce(place(end), F.lit(1 << levels)), F.lit(1 << levels)).cast("long")
    cut = spans.withColumn("_c", F.explode(_cells(low, high, levels))).select("*", F.col("_c.level").alias("_level"), F.col("_c.cell").alias("_cell")).drop("_c")
    used = sorted(r[0] for r in cut.select("_level").distinct().collect())  # at most 53 numbers
    if not used:
        return points.join(spans, keys).limit(0)
    own = [*keys, "_level", "_cell"]
    lanes = cut.groupBy(*own).agg(F.ceil(F.count("*") / CELL_SPANS).cast("int").alias("_lanes")).filter("_lanes > 1")
    cut = cut.join(lanes, own, "left").withColumn("_lane", F.pmod(F.xxhash64(start, end, F.monotonically_increasing_id()), F.coalesce("_lanes", F.lit(1)).cast("long")).cast("int")).drop("_lanes")
    placed = points.withColumn("_level", F.explode(F.array(*map(F.lit, used))))
    placed = placed.withColumn("_cell", F.floor((F.col(at) - lowest) / unit / F.pow(F.lit(2.0), "_level")).cast("long"))
    placed = placed.join(lanes, own, "left").withColumn("_lane", F.explode(F.sequence(F.lit(0), F.coalesce("_lanes", F.lit(1)) - 1))).drop("_lanes")
    return placed.join(cut.hint("merge"), [*own, "_lane"]).drop("_level", "_cell", "_lane")


def instant(text: Column) -> Column:
    """Microseconds of a day or instant in text."""
    return F.unix_micros(F.to_timestamp(D.temporal_key(text)))


def valid_then(events: DataFrame, facts: DataFrame, at: str = "at") -> DataFrame:
    """Each event (subject, at in text, ...) beside every fact (subject, valid_from, valid_to, ...) of its subject that is
    valid at its instant: from valid_from on, before valid_to, open where null."""
    timed = facts.withColumns({"_from": instant(F.col("valid_from")), "_to": instant(F.col("valid_to"))})
    return stabbed(events.withColumn("_at", instant(F.col(at))), timed, ["subject"], "_at", "_from", "_to").drop("_at", "_from", "_to")


def matched_runs(attested: DataFrame, audit: DataFrame, columns: list[str]) -> DataFrame:
    """(doc, n, start, fault): for attested runs (doc, place from 0, columns), the least seq from which the audit (seq,
    columns) holds all of their records, equal in every column and in order, with nothing between; where there is none,
    whether the first record is missing or the run isn't contiguous. Records meet on all their columns, and agreeing
    places are counted by where the run would begin, so a record that recurs costs its pairs only."""
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns]
    pairs = attested.alias("a").join(audit.alias("b"), same).select("a.doc", "a.place", (F.col("b.seq") - F.col("a.place")).alias("start"))
    sizes = attested.groupBy("doc").agg(F.count("*").alias("n"))
    starts = pairs.groupBy("doc", "start").agg(F.count("*").alias("agree"), F.count_if(F.col("place") == 0).alias("first")).join(sizes, "doc")
    found = starts.groupBy("doc").agg(F.min(F.when(F.col("agree") == F.col("n"), F.col("start"))).alias("start"), F.max("first").alias("first"))
    out = sizes.join(found, "doc", "left")
    fault = F.when(F.col("start").isNotNull(), None).when(F.coalesce("first", F.lit(0)) == 0, "no such record").otherwise("not contiguous")
    return out.select("doc", "n", "start", fault.alias("fault"))


def marks_after(runs: DataFrame, marks: DataFrame) -> DataFrame:
    """Matched runs with ``later``: how many marks (seq; few, such as changes of a key) come after them."""
    spans = runs.filter("start is not null").select("doc", (F.col("start") + F.col("n")).alias("_from"), F.lit(None).cast("long").alias("_to"), F.lit(0).alias("_k"))
    held = stabbed(marks.select("seq", F.lit(0).alias("_k")), spans, ["_k"], "seq", "_from", "_to").groupBy("doc").agg(F.count("*").alias("later"))
    return runs.join(held, "doc", "left").withColumn("later", F.when(F.col("start").isNotNull(), F.coalesce("later", F.lit(0).cast("long"))))
