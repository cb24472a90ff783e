"""Queries of the function library, over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import names as N
from ..functions import semantics as S

c = F.col


def register(query) -> None:
    """Adds every query of this module by ``query(sql)``, the catalogue's decorator."""

    # --- durations ------------------------------------------------------------------------------

    @query("""SELECT o_orderkey, a // 12 AS years, a % 12 AS months, a + b AS added, a - b AS less, CAST(floor(a * 1.5 + 0.5) AS BIGINT) AS times, CAST(floor(a / 4.0 + 0.5) AS BIGINT) AS part,
    round(a / nullif(b, 0)::DOUBLE, 6) AS ratio, a < b AS lt, a > b AS gt, a = b AS eq FROM (SELECT o_orderkey, o_custkey % 50 AS a, o_orderkey % 7 AS b FROM orders)""")
    def fn_year_month_durations(t):
        a, b = D.year_month(c("o_custkey") % 50), D.year_month(c("o_orderkey") % 7)
        long = lambda x: D.months_of(x).cast("long")
        return t.orders.select(
            "o_orderkey", D.component(a, "years").cast("long").alias("years"), D.component(a, "months").cast("long").alias("months"),
            long(D.add(a, b)).alias("added"), long(D.subtract(a, b)).alias("less"), long(D.multiply_months(a, F.lit(1.5))).alias("times"), long(D.divide_months(a, F.lit(4.0))).alias("part"),
            F.round(D.months_ratio(a, b), 6).alias("ratio"), (a < b).alias("lt"), (a > b).alias("gt"), (a == b).alias("eq"),
        )

    @query("""SELECT o_orderkey, a // 86400 AS days, (a // 3600) % 24 AS hours, (a // 60) % 60 AS minutes, CAST(a % 60 AS DOUBLE) AS seconds, CAST(a + b AS DOUBLE) AS added, CAST(a - b AS DOUBLE) AS less,
    CAST(a * 2.5 AS DOUBLE) AS times, round(a / 8.0, 6)::DOUBLE AS part, round(a / b::DOUBLE, 6) AS ratio, a < b AS lt, a > b AS gt, a = b AS eq
    FROM (SELECT o_orderkey, o_custkey * 997 AS a, (o_orderkey % 90 + 1) * 3600 AS b FROM orders)""")
    def fn_day_time_durations(t):
        a, b = D.day_time(c("o_custkey") * 997), D.day_time((c("o_orderkey") % 90 + 1) * 3600)
        double = lambda x: D.seconds_of(x).cast("double")
        return t.orders.select(
            "o_orderkey", *[D.component(a, p).cast("long").alias(p) for p in ("days", "hours", "minutes")], D.component(a, "seconds").cast("double").alias("seconds"),
            double(D.add(a, b)).alias("added"), double(D.subtract(a, b)).alias("less"), double(D.multiply_seconds(a, F.lit(2.5))).alias("times"), double(D.divide_seconds(a, F.lit(8.0))).alias("part"),
            F.round(D.seconds_ratio(a, b), 6).alias("ratio"), (a < b).alias("lt"), (a > b).alias("gt"), (a == b).alias("eq"),
        )

    @query("""SELECT o_orderkey, d + to_months(m) AS plus_ym, d - to_months(m) AS minus_ym, d + to_seconds(s) AS plus_dt, d - to_seconds(s) AS minus_dt,
    CAST(epoch(d - TIMESTAMP '1995-03-01') AS DOUBLE) AS apart, CAST(CAST(d AS DATE) - DATE '1995-03-01' AS BIGINT) AS days_apart, CAST(CAST(CAST(d AS DATE) + to_months(m) AS DATE) AS VARCHAR) AS date_plus_ym,
    CAST(CAST(CAST(d AS DATE) - to_months(m) AS DATE) AS VARCHAR) AS date_minus_ym, CAST(CAST(date_trunc('day', CAST(d AS DATE) + to_seconds(s)) AS DATE) AS VARCHAR) AS date_plus_dt, CAST(CAST(date_trunc('day', CAST(d AS DATE) - to_seconds(s)) AS DATE) AS VARCHAR) AS date_minus_dt
    FROM (SELECT o_orderkey, o_orderdate AS d, CAST(o_custkey % 30 AS INTEGER) AS m, CAST(o_custkey * 1000 AS BIGINT) AS s FROM orders)""")
    def fn_date_arithmetic(t):
        d, ym, dt = c("o_orderdate"), D.year_month(c("o_custkey") % 30), D.day_time(c("o_custkey") * 1000)
        day = F.date_trunc("DAY", d).cast("timestamp_ntz")
        mark = F.lit("1995-03-01").cast("timestamp_ntz")
        date = lambda x: x.cast("date").cast("string")
        return t.orders.select(
            "o_orderkey", (d + ym).alias("plus_ym"), (d - ym).alias("minus_ym"), (d + dt).alias("plus_dt"), (d - dt).alias("minus_dt"),
            D.seconds_of(d - mark).cast("double").alias("apart"), D.component(day - mark, "days").cast("long").alias("days_apart"), date(day + ym).alias("date_plus_ym"),
            date(day - ym).alias("date_minus_ym"), date(day + dt).alias("date_plus_dt"), date(day - dt).alias("date_minus_dt"),
        )

    @query("""SELECT event_id, s AS at, (s + d) % 86400 AS later, (s - d + 864000) % 86400 AS earlier, s - 43200 AS from_noon, s = 43200 AS noon, s < 43200 AS am, s > 43200 AS pm
    FROM (SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS BIGINT) AS s, CAST(event_id % 100000 AS BIGINT) AS d FROM events)""")
    def fn_times(t):
        at = D.time_of(F.date_trunc("SECOND", c("ts")))
        noon, d = D.day_time(F.lit(43_200)), D.day_time(c("event_id") % 100_000)
        long = lambda x: D.seconds_of(x).cast("long")
        return t.events.select(
            "event_id", long(at).alias("at"), long(D.time_plus(at, d)).alias("later"), long(D.time_plus(at, D.day_time(-(c("event_id") % 100_000)))).alias("earlier"),
            long(D.time_minus(at, noon)).alias("from_noon"), (at == noon).alias("noon"), (at < noon).alias("am"), (at > noon).alias("pm"),
        )

    # --- time zones -----------------------------------------------------------------------------

    zones = """(SELECT o_orderkey, o_orderdate + to_seconds(CAST(o_custkey * 61 AS BIGINT)) AS d, CAST(o_custkey % 25 - 12 AS INTEGER) * 60 AS z FROM orders)"""

    def zoned_orders(t):
        local = c("o_orderdate") + D.day_time(c("o_custkey") * 61)
        hours = (c("o_custkey") % 25 - 12).cast("int")
        zone = F.when(hours == 0, "Z").otherwise(F.format_string("%s%02d:00", F.when(hours < 0, "-").otherwise("+"), F.abs(hours)))
        return t.orders.select("o_orderkey", F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), zone).alias("text"))

    @query(f"""SELECT o_orderkey, z AS zone, z AS date_zone, z AS time_zone, CAST(d + to_minutes(120 - z) AS VARCHAR) AS adjusted, CAST(CAST(date_trunc('day', date_trunc('day', d) + to_minutes(120 - z)) AS DATE) AS VARCHAR) AS date_adjusted,
    strftime(d + to_minutes(120 - z), '%H:%M:%S') AS time_adjusted, CAST(d AS VARCHAR) AS bare, d - to_minutes(z) = TIMESTAMP '1995-03-01 00:00:00' AS eq, d - to_minutes(z) < TIMESTAMP '1995-03-01 00:00:00' AS lt FROM {zones}""")
    def fn_timezones(t):
        v = D.parse_datetime(c("text"))
        date = D.parse_date(F.concat(F.substring("text", 1, 10), F.substring("text", 20, 6)))
        time = D.parse_time(F.substring("text", 12, 14))
        minutes = lambda x: (D.seconds_of(D.zone_of(x)) / 60).cast("int")
        two, mark = F.lit(120), F.lit("1995-03-01").cast("timestamp_ntz")
        text = lambda x: F.date_format(x["local"], "yyyy-MM-dd HH:mm:ss")
        return zoned_orders(t).select(
            "o_orderkey", minutes(v).alias("zone"), minutes(date).alias("date_zone"), minutes(time).alias("time_zone"), text(D.adjust(v, two)).alias("adjusted"),
            F.date_format(D.adjust_date(date, two)["local"], "yyyy-MM-dd").alias("date_adjusted"), F.date_format(D.adjust(time, two)["local"], "HH:mm:ss").alias("time_adjusted"),
            text(D.adjust(v, None)).alias("bare"), (D.instant(v) == mark).alias("eq"), (D.instant(v) < mark).alias("lt"),
        )

    @query(f"""SELECT o_orderkey, CAST(year(d) AS INTEGER) AS y, CAST(month(d) AS INTEGER) AS mo, CAST(day(d) AS INTEGER) AS da, CAST(hour(d) AS INTEGER) AS h, CAST(minute(d) AS INTEGER) AS mi, CAST(second(d) AS INTEGER) AS s,
    CAST(hour(d) AS INTEGER) AS th, CAST(minute(d) AS INTEGER) AS tm, CAST(second(d) AS INTEGER) AS ts FROM {zones}""")
    def fn_components(t):
        v, time = D.parse_datetime(c("text"))["local"], D.parse_time(F.substring("text", 12, 14))["local"]
        date = D.parse_date(F.substring("text", 1, 10))["local"]
        p = S.parts_of(v)
        return zoned_orders(t).select(
            "o_orderkey", F.year(date).alias("y"), F.month(date).alias("mo"), F.day(date).alias("da"), *[p[k].cast("int").alias(a) for k, a in (("hours", "h"), ("minutes", "mi"), ("seconds", "s"))],
            F.hour(time).alias("th"), F.minute(time).alias("tm"), F.second(time).alias("ts"),
        )

    @query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') = '1995-03' AS ym, strftime(o_orderdate, '%Y') = '1995' AS y, strftime(o_orderdate, '--%m-%d') = '--03-01' AS md, strftime(o_orderdate, '--%m') = '--03' AS m,
    strftime(o_orderdate, '---%d') = '---01' AS d, strftime(o_orderdate, '%Y-%m') AS text FROM orders""")
    def fn_gregorian(t):
        a, b = c("o_orderdate"), F.lit("1995-03-01").cast("timestamp_ntz")
        kinds = (("gYearMonth", "ym"), ("gYear", "y"), ("gMonthDay", "md"), ("gMonth", "m"), ("gDay", "d"))
        return t.orders.select("o_orderkey", *[D.gregorian_equal(a, b, k).alias(n) for k, n in kinds], D.gregorian(a, "gYearMonth").alias("text"))

    @query("SELECT true AS date_is_that_of_now, true AS time_is_that_of_now, true AS stable, 0 AS implicit, 'codepoint' AS collation, count(*) AS n FROM region")
    def fn_context(t):
        """The clock is read once for a whole query, so its date, time and instant agree on every row."""
        now = F.current_timestamp()
        rows = t.region.select(now.alias("now"), F.current_date().alias("today"), D.seconds_of(D.time_of(now)).alias("time"))
        return rows.agg(
            F.bool_and(c("now").cast("date") == c("today")).alias("date_is_that_of_now"), F.bool_and(c("time") == D.seconds_into_day(c("now"))).alias("time_is_that_of_now"),
            (F.min("now") == F.max("now")).alias("stable"), F.lit(0).alias("implicit"), F.lit("codepoint").alias("collation"), F.count("*").alias("n"),
        )

    # --- strings --------------------------------------------------------------------------------

    @query(r"""SELECT p_partkey, regexp_replace(trim(s), '\s+', ' ', 'g') AS normal, lower(p_name) AS low, upper(p_name) AS up, ends_with(p_name, '1') AS ends, contains(p_name, 'a') AS has, starts_with(p_name, 'a') AS starts,
    CASE WHEN contains(p_name, ' ') THEN substr(p_name, 1, instr(p_name, ' ') - 1) ELSE '' END AS before, CASE WHEN contains(p_name, ' ') THEN substr(p_name, instr(p_name, ' ') + 1) ELSE '' END AS after,
    regexp_matches(p_name, '^[a-m]') AS matched, CASE WHEN p_name < p_type THEN -1 WHEN p_name > p_type THEN 1 ELSE 0 END AS ordered, p_brand = p_type AS same, ascii(p_name) AS first_point, p_name AS again, nfc_normalize(p_name) AS nfc
    FROM (SELECT *, '  ' || replace(p_name, ' ', '   ') || ' ' AS s FROM part)""")
    def fn_strings(t):
        s, n, space = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit(" ")), c("p_name"), F.lit(" ")
        points = S.codepoints(n)
        return t.part.select(
            "p_partkey", S.normalize_space(s).alias("normal"), F.lower(n).alias("low"), F.upper(n).alias("up"), n.endswith("1").alias("ends"), n.contains("a").alias("has"), n.startswith("a").alias("starts"),
            S.substring_before(n, space).alias("before"), S.substring_after(n, space).alias("after"), F.regexp_like(n, F.lit("^[a-m]")).alias("matched"), S.compare(n, c("p_type")).alias("ordered"),
            (c("p_brand") == c("p_type")).alias("same"), S.at(points, 0).alias("first_point"), S.from_codepoints(points).alias("again"), S.normalize_unicode(n).alias("nfc"),
        )

    @query("SELECT n_nationkey, x, p, p AS back FROM (SELECT n_nationkey, chr(CAST(8364 + n_nationkey AS INTEGER)) || chr(CAST(128512 + n_nationkey AS INTEGER)) AS x, 8364 + n_nationkey AS p FROM nation)")
    def fn_codepoints(t):
        x = S.from_codepoints(F.array(c("n_nationkey") + 8364, c("n_nationkey") + 128_512))
        return t.nation.select("n_nationkey", x.alias("x"), (c("n_nationkey") + 8364).alias("p")).withColumn("back", S.at(S.codepoints(c("x")), 0))

    @query("""SELECT n_nationkey, replace(n_name, ' ', '%20') || '~b%2Ac%2Fd%C3%A9' AS encoded, replace(n_name, ' ', '%20') || '~b*c/d%C3%A9' AS iri, n_name || '~b*c/d%C3%A9' AS html,
    'http://a/b/' || replace(n_name, ' ', '_') || '/x?q' AS resolved, 'http://a/e' AS up, 'http://o/p' AS other FROM nation""")
    def fn_uris(t):
        s, base = F.concat("n_name", F.lit("~b*c/dé")), F.lit("http://a/b/c/d?q#f")
        return t.nation.select(
            "n_nationkey", N.encode_for_uri(s).alias("encoded"), N.iri_to_uri(s).alias("iri"), N.escape_html_uri(s).alias("html"),
            N.resolve_uri(F.concat(F.lit(".././"), F.replace("n_name", F.lit(" "), F.lit("_")), F.lit("/x?q")), base).alias("resolved"), N.resolve_uri(F.lit("../../../e"), base).alias("up"), N.resolve_uri(F.lit("http://o/p"), base).alias("other"),
        )

    @query("""SELECT n_nationkey, n_name AS local, CASE WHEN n_regionkey = 0 THEN 'urn:zero' WHEN n_regionkey = 1 THEN 'urn:one' END AS uri, n_regionkey = 0 AS same, CASE WHEN n_regionkey = 0 THEN 'urn:zero' END AS found, 'a,b,xml' AS prefixes,
    n_regionkey = 2 AS lang FROM nation""")
    def fn_qnames(t):
        scope = F.create_map(F.lit("a"), F.lit("urn:zero"), F.lit("b"), F.lit("urn:one"))
        prefix = F.when(c("n_regionkey") == 0, "a").when(c("n_regionkey") == 1, "b").otherwise("")
        name = N.resolve_qname(F.concat(prefix, F.when(prefix != "", ":").otherwise(""), F.regexp_replace("n_name", ":", "_")), scope)
        other = N.qname(F.lit("urn:zero"), F.concat(F.lit("z:"), c("n_name")))
        tag = F.element_at(F.array(F.lit("fr"), F.lit("eng"), F.lit("EN-gb"), F.lit("e"), F.lit("de")), c("n_regionkey") + 1)
        return t.nation.select(
            "n_nationkey", name["local"].alias("local"), F.nullif(name["uri"], F.lit("")).alias("uri"), N.same_name(name, other).alias("same"),
            F.when(prefix == "a", N.namespace_for(F.lit("a"), scope)).alias("found"), F.array_join(N.in_scope_prefixes(scope), ",").alias("prefixes"), N.has_language(tag, F.lit("en")).alias("lang"),
        )

    @query("SELECT p_partkey, true AS hex_same, p_size = 7 AS hex_other, true AS base64_same, p_brand = p_type AS notation FROM part")
    def fn_binary(t):
        hexed, coded = F.hex(F.encode("p_name", "UTF-8")), F.base64(F.encode("p_name", "UTF-8"))
        byte = lambda x: F.lpad(F.hex(x), 2, "0")
        return t.part.select(
            "p_partkey", N.hex_equal(hexed, F.lower(hexed)).alias("hex_same"), N.hex_equal(byte(c("p_size").cast("long")), F.lit("07")).alias("hex_other"),
            N.base64_equal(coded, F.concat(F.lit(" "), coded, F.lit("\n"))).alias("base64_same"), (c("p_brand") == c("p_type")).alias("notation"),
        )

    # --- sequences, logic, numbers --------------------------------------------------------------

    @query("""SELECT s_suppkey, [k % 3, k % 5, k % 3] AS a, list_distinct_in_order AS distinct_values, [k % 3, 99, k % 5, k % 3] AS inserted, [k % 3, k % 3] AS removed, CASE WHEN k % 3 = k % 5 THEN [1, 2, 3] ELSE [1, 3] END AS places,
    3 AS last, [k % 3, k % 5, k % 3] = [k % 3, k % 5, k % 3] AS deep, range(k % 3, k % 3 + 3) AS range, [k % 3, k % 5, k % 3] AS back, k % 3 AS one, k % 3 AS at_most_one, CAST(k % 3 AS VARCHAR) AS data, 3 AS at_least_one
    FROM (SELECT s_suppkey, s_suppkey AS k, CASE WHEN s_suppkey % 3 = s_suppkey % 5 THEN [s_suppkey % 3] ELSE [s_suppkey % 3, s_suppkey % 5] END AS list_distinct_in_order FROM supplier)""")
    def fn_sequences(t):
        x, y = c("s_suppkey") % 3, c("s_suppkey") % 5
        a = F.array(x, y, x)
        return t.supplier.select(
            "s_suppkey", a.alias("a"), S.distinct_values(a).alias("distinct_values"), S.insert_before(a, 2, F.lit(99)).alias("inserted"), S.remove_at(a, 2).alias("removed"), S.index_of(a, x).alias("places"), S.last(a).alias("last"),
            S.deep_equal(a, F.array(x, y, x)).alias("deep"), S.to(x, x + 2).alias("range"), F.reverse(a).alias("back"), S.exactly_one(F.array(x)).alias("one"), S.zero_or_one(F.array(x)).alias("at_most_one"),
            S.data(x).alias("data"), F.size(S.one_or_more(a)).alias("at_least_one"),
        )

    @query("""SELECT c_custkey, c_acctbal > 0 AND length(c_name) > 0 AS both, c_acctbal <> 0 AS of_number, true AS of_string, NOT (c_acctbal > 0) AS negated, (c_acctbal > 0) = (c_custkey % 2 = 0) AS eq, (NOT c_acctbal > 0) AND c_custkey % 2 = 0 AS lt,
    c_acctbal > 0 AND NOT c_custkey % 2 = 0 AS gt, true AS yes, false AS no, false AS nilled, CAST(c_custkey AS VARCHAR) AS text, CAST(c_custkey AS DOUBLE) AS number, TRY_CAST(c_name AS DOUBLE) AS no_number, TRY_CAST(c_name AS DOUBLE) IS NOT NULL AS castable FROM customer""")
    def fn_booleans(t):
        a, b = c("c_acctbal") > 0, c("c_custkey") % 2 == 0
        return t.customer.select(
            "c_custkey", S.all_of(a, S.boolean(c("c_name"))).alias("both"), S.boolean(c("c_acctbal"), "number").alias("of_number"), S.boolean(c("c_name")).alias("of_string"), S.negate(a).alias("negated"), (a == b).alias("eq"),
            (a < b).alias("lt"), (a > b).alias("gt"), F.lit(True).alias("yes"), F.lit(False).alias("no"), S.nilled(F.lit(None).cast("string")).alias("nilled"), c("c_custkey").cast("string").alias("text"),
            S.number(c("c_custkey")).alias("number"), S.number(c("c_name")).alias("no_number"), S.castable(c("c_name"), "double").alias("castable"),
        )

    @query("""SELECT p_partkey, CAST(floor(x + 0.5) AS BIGINT) AS rounded, CAST(round_even(x, 0) AS BIGINT) AS even, CAST(k // 7 AS BIGINT) AS idiv, 9007199254740993 AS exact, k % 7 AS mod, round(x / 3, 6) AS div, x + k AS plus, x - k AS minus, x * 2 AS times,
    -x AS neg, 0 AS tie_below FROM (SELECT p_partkey, p_partkey AS k, p_partkey / 2.0::DOUBLE AS x FROM part)""")
    def fn_numbers(t):
        k = c("p_partkey")
        x = k / F.lit(2.0)
        return t.part.select(
            "p_partkey", S.round_up_ties(x).cast("long").alias("rounded"), S.round_half_even(x).cast("long").alias("even"), S.idiv(k, F.lit(7)).alias("idiv"), S.idiv(F.lit(9007199254740993), F.lit(1)).alias("exact"),
            S.mod(k, F.lit(7)).alias("mod"), F.round(F.try_divide(x, F.lit(3)), 6).alias("div"), (x + k).alias("plus"), (x - k).alias("minus"), (x * 2).alias("times"), (-x).alias("neg"),
            S.round_up_ties(F.lit(0.49999999999999994)).cast("int").alias("tie_below"),
        )
