"""Queries of the date functions over events, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import table_functions as TF
from recollect.functions import temporal as D
from recollect.plans.register import ORACLES, query
from recollect.sources.tables import table


def _stamped(spark, sf_dir):
    """Events with an RFC 3339 instant in varying offsets."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    zone = F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+05:30").otherwise("-08:00")
    return e.withColumn("at", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone))


_ZONES = "(SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+05:30' ELSE '-08:00' END AS stamp FROM events)"


@query(f"SELECT event_id, substr(stamp, 1, 10) AS local_date, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 330 ELSE -480 END AS minutes, event_id % 3 = 0 AS utc FROM {_ZONES}")
def q_anchor(spark, sf_dir):
    """Local date and offset of instants."""
    at = F.col("at")
    return _stamped(spark, sf_dir).select("event_id", D.anchor(at).cast("string").alias("local_date"), D.offset_minutes(at).alias("minutes"), D.same_frame(at, F.lit("2024-01-01T00:00:00Z")).alias("utc"))


def _pairs(spark, sf_dir):
    """Each order with its customer's next."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return o.withColumn("next", F.lead("o_orderdate").over(w)).filter("next is not null")


_PAIRS = "(SELECT * FROM (SELECT o_orderkey, o_orderdate AS a, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b IS NOT NULL)"
_WEEKS = "abs(date_diff('day', date_trunc('week', a), date_trunc('week', b)) // 7)"
_MONTHS = "((year(b) * 12 + month(b)) - (year(a) * 12 + month(a)))"


@query(f"SELECT o_orderkey, date_diff('day', a, b) AS days, CAST(trunc((epoch(b) - epoch(a)) / 3600) AS BIGINT) AS hours, date_diff('day', date_trunc('week', a), date_trunc('week', b)) // 7 AS weeks, {_MONTHS} AS months FROM {_PAIRS}")
def q_intervals(spark, sf_dir):
    """Days, hours, weeks and months between consecutive orders."""
    a, b = F.col("o_orderdate"), F.col("next")
    return _pairs(spark, sf_dir).select("o_orderkey", D.days_between(a, b).alias("days"), D.hours_between(a, b).alias("hours"), D.weeks_between(F.to_date(a), F.to_date(b)).alias("weeks"), D.months_between(a, b).alias("months"))


@query(f"""SELECT o_orderkey, CASE WHEN n = 0 THEN 'same day' ELSE c || ' ' || u || CASE WHEN c = 1 THEN '' ELSE 's' END || ' after' END AS said FROM (
SELECT o_orderkey, n, CASE WHEN n < 14 THEN n WHEN n < 180 THEN w WHEN n < 730 THEN m ELSE m // 12 END AS c, CASE WHEN n < 14 THEN 'day' WHEN n < 180 THEN 'week' WHEN n < 730 THEN 'month' ELSE 'year' END AS u
FROM (SELECT o_orderkey, date_diff('day', a, b) AS n, {_WEEKS} AS w, {_MONTHS} AS m FROM {_PAIRS}))""")
def q_interval_describe(spark, sf_dir):
    """Intervals between consecutive orders, in words."""
    return _pairs(spark, sf_dir).select("o_orderkey", D.describe_interval(F.to_date("o_orderdate"), F.to_date("next")).alias("said"))


@query("""SELECT o_orderkey, strftime(d + INTERVAL 3 MONTH, '%Y-%m-%d') AS later, strftime(date_trunc('week', d), '%Y-%m-%d') AS monday, strftime(d - CAST((dayofweek(d) % 7) AS INTEGER), '%Y-%m-%d') AS sunday,
strftime(d - CAST((isodow(d) - 1 - 4 - 1 + 7) % 7 + 1 AS INTEGER), '%Y-%m-%d') AS last_friday, strftime(d + CAST((4 - 1 - (isodow(d) - 1) + 7) % 7 + 1 AS INTEGER), '%Y-%m-%d') AS next_friday FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def q_shift_dates(spark, sf_dir):
    """Months clamped to their last day, week starts and neighbouring Fridays."""
    d = F.to_date("o_orderdate")
    found = {"later": D.shift_months(d, 3), "monday": D.week_start(d), "sunday": D.week_start(d, "sunday"), "last_friday": D.previous_weekday(d, 4), "next_friday": D.following_weekday(d, 4)}
    return table(spark, sf_dir, "orders").select("o_orderkey", *(c.cast("string").alias(n) for n, c in found.items()))


@query("SELECT event_id, CAST(event_id AS VARCHAR) AS digits FROM events")
def q_digits(spark, sf_dir):
    """Arabic-Indic digits as ASCII."""
    arabic = F.translate(F.col("event_id").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    return table(spark, sf_dir, "events").select("event_id", D.ascii_digits(arabic).alias("digits"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' AS key FROM orders")
def q_temporal_key(spark, sf_dir):
    """Dates promoted to instants that compare as text."""
    return table(spark, sf_dir, "orders").select("o_orderkey", D.temporal_key(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("key"))


@query("""SELECT event_id, unnest([
  {'kind': 'absolute', 'resolved': strftime(ts, '%Y-%m-%d')},
  {'kind': 'relative', 'resolved': strftime(CAST(ts AS DATE) - 1, '%Y-%m-%d')},
  {'kind': 'relative', 'resolved': strftime(CAST(ts AS DATE) - 21, '%Y-%m-%d')},
  {'kind': 'relative', 'resolved': strftime(date_trunc('month', ts) - INTERVAL 1 MONTH, '%Y-%m-%d')}], recursive := true) FROM events""")
def q_mentions_en(spark, sf_dir):
    """English date mentions, written from each event's date."""
    text = F.concat(F.lit("Seen "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" and yesterday, three weeks ago, and all of last month."))
    found = table(spark, sf_dir, "events").select("event_id", F.explode(D.mentions()(text, F.to_date("ts"))).alias("m"))
    return found.select("event_id", "m.kind", "m.resolved")


@query(ORACLES["q_mentions_en"])
def q_mentions_sql(spark, sf_dir):
    """The same by a table function in Spark SQL."""
    TF.register(spark)
    return spark.sql("""SELECT e.event_id, m.kind, m.resolved FROM {events} e,
        LATERAL mentions_of(concat('Seen ', date_format(e.ts, 'yyyy-MM-dd'), ' and yesterday, three weeks ago, and all of last month.'), to_date(e.ts), language => 'en') m""", events=table(spark, sf_dir, "events"))


@query("""SELECT event_id, unnest([
  {'kind': 'relative', 'resolved': strftime(CAST(ts AS DATE) - 1, '%Y-%m-%d')},
  {'kind': 'relative', 'resolved': strftime(CAST(ts AS DATE) - 2, '%Y-%m-%d')},
  {'kind': 'relative', 'resolved': strftime(CAST(ts AS DATE) - 3, '%Y-%m-%d')},
  {'kind': 'relative', 'resolved': strftime(date_trunc('week', ts) - INTERVAL 7 DAY, '%Y-%m-%d')},
  {'kind': 'absolute', 'resolved': '2019-05-07'}], recursive := true) FROM events""")
def q_mentions_ar(spark, sf_dir):
    """Arabic date mentions, resolved against each event's date."""
    text = F.lit("رأيته أمس ثم قبل يومين ثم قبل ٣ أيام و الأسبوع الماضي في ٧ مايو ٢٠١٩")
    found = table(spark, sf_dir, "events").select("event_id", F.explode(D.mentions(D.Locale("ar"))(text, F.to_date("ts"))).alias("m"))
    return found.select("event_id", "m.kind", "m.resolved")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS buddhist, strftime(o_orderdate, '%Y-%m-%d') AS minguo FROM orders")
def q_calendars(spark, sf_dir):
    """Dates written with Buddhist and Minguo years, read back."""
    o, rest = table(spark, sf_dir, "orders"), F.date_format("o_orderdate", "-MM-dd")
    day = F.to_date("o_orderdate")
    thai = F.concat(F.lit("พ.ศ. "), (F.year("o_orderdate") + 543).cast("string"), rest)
    roc = F.concat((F.year("o_orderdate") - 1911).cast("string"), rest)
    first = lambda text, loc: F.element_at(D.mentions(loc)(text, day), 1)["resolved"]
    return o.select("o_orderkey", first(thai, D.Locale()).alias("buddhist"), first(roc, D.Locale(calendar="minguo")).alias("minguo"))


#: First days of the months of 1446 and 1447 in the civil calendar (fixed values).
_LUNAR = ["2024-07-07", "2024-08-05", "2024-09-04", "2024-10-04", "2024-11-03", "2024-12-02", "2025-01-01", "2025-01-31", "2025-03-01", "2025-03-30", "2025-04-29", "2025-05-28", "2025-06-26"]


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN '2025-06-26' ELSE [" + ", ".join(f"'{d}'" for d in _LUNAR[:12]) + "][CAST(o_orderkey % 12 + 1 AS INTEGER)] END AS resolved FROM orders")
def q_lunar_months(spark, sf_dir):
    """For every order the first day of a lunar month of 1446 under a declared calendar, or of 1447 with an era."""
    o, day = table(spark, sf_dir, "orders"), F.lit("2025-01-01").cast("date")
    declared = D.mentions(D.Locale(calendar="hijri"))(F.format_string("1446-%02d-01", F.col("o_orderkey") % 12 + 1), day)
    found = F.when(F.col("o_orderkey") % 13 == 0, D.mentions()(F.lit("1447-01-01 هـ"), day)).otherwise(declared)
    return o.select("o_orderkey", F.element_at(found, 1)["resolved"].alias("resolved"))


@query("""WITH j AS (SELECT o_orderkey, o_orderdate, 1370 + o_orderkey % 50 AS y, 1 + o_orderkey % 12 AS m, 1 + o_orderkey % 29 AS d FROM orders)
SELECT o_orderkey, strftime(DATE '0001-01-01' + CAST(226893 + 365 * (y - 1) + (8 * y + 21) // 33 + CASE WHEN m <= 7 THEN 31 * (m - 1) ELSE 30 * (m - 1) + 6 END + d AS INTEGER), '%Y-%m-%d') AS jalali,
strftime(o_orderdate, '%Y-%m-%d') AS heisei, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate - INTERVAL 30 YEAR, '%Y-%m-%d') END AS showa FROM j WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)""")
def q_era_calendars(spark, sf_dir):
    """Dates under a declared Jalali calendar, and in years of Japanese eras; a year that the era didn't have is no date."""
    o = table(spark, sf_dir, "orders").filter("not (month(o_orderdate) = 2 and day(o_orderdate) = 29)")
    day, rest, k = F.to_date("o_orderdate"), F.date_format("o_orderdate", "-MM-dd"), F.col("o_orderkey")
    first = lambda text, calendar: F.try_element_at(D.mentions(D.Locale(calendar=calendar))(text, day), F.lit(1))["resolved"]
    jalali = F.format_string("%d-%02d-%02d", 1370 + k % 50, 1 + k % 12, 1 + k % 29)
    heisei = F.concat(F.lpad((F.year("o_orderdate") - 1988).cast("string"), 4, "0"), rest)
    showa = F.concat(F.lpad(F.when(k % 2 == 0, F.year("o_orderdate") - 1955).otherwise(99).cast("string"), 4, "0"), rest)
    return o.select("o_orderkey", first(jalali, "jalali").alias("jalali"), first(heisei, "heisei").alias("heisei"), first(showa, "showa").alias("showa"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(CAST(ts AS DATE) - 1, '%Y-%m-%d') END AS resolved FROM events")
def q_claimed_span(spark, sf_dir):
    """A claimed date resolves only where the text says it."""
    text = F.when(F.col("event_id") % 2 == 0, "we met yesterday at noon").otherwise("we met at noon")
    return table(spark, sf_dir, "events").select("event_id", D.claimed_span(F.lit("yesterday"), text, F.to_date("ts"))["resolved"].alias("resolved"))


@query("SELECT event_id, date_diff('day', CAST(ts AS DATE), DATE '2025-01-01') AS days FROM events")
def q_elapsed(spark, sf_dir):
    """Days elapsed between the mention in each text and a reading date."""
    text = F.concat(F.lit("noted on "), F.date_format("ts", "yyyy-MM-dd"))
    found = table(spark, sf_dir, "events").select("event_id", F.element_at(D.mentions()(text, F.lit(None).cast("date")), 1)["resolved"].alias("d"))
    return found.select("event_id", D.days_between(F.to_date("d"), F.lit("2025-01-01").cast("date")).alias("days"))
