"""Registered queries of the log analytics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trolley.operators import trends as R
from trolley.operators import windows as W
from trolley.plans.bindings import AS_OF, EVENTS_AS_OF, Tables, with_tables

DAYS = 730
_RECENT = f"recent as (select * from logs where ts >= timestamp '{AS_OF}' - interval {DAYS} day)"


def _recent(t: Tables):
    return R.lookback_filter(t.logs(), AS_OF, DAYS)


QUERIES = {
    "lookback_filter": lambda t: _recent(t).select("log_id", "user_id"),
    "half_open_window": lambda t: R.half_open_window(t.logs(), F.lit("1998-01-01").cast("timestamp"), F.lit("1999-01-01").cast("timestamp")).select("log_id"),
    "explode_lookup": lambda t: R.explode_lookup(t.logs(), t.log_items(), t.products()).select("log_id", "town", "product_id", "name"),
    "count_by_town_product": lambda t: R.count_by_town_product(_recent(t), t.log_items(), t.products()),
    "top_n_per_group": lambda t: R.top_products_by_town(_recent(t), t.log_items(), t.products()),
    "volume_by_hour": lambda t: R.volume_by_hour(t.traffic()),
    "rough_total_queries": lambda t: R.rough_total_queries(t.traffic()),
    "peak_hours": lambda t: R.peak_hours(t.traffic()),
    "basket_size_distribution": lambda t: R.basket_size_distribution(t.baskets()),
    "basket_size_summary": lambda t: R.basket_size_summary(t.baskets()),
    "seasonal_patterns": lambda t: R.seasonal_patterns(t.logs(), "dow"),
    "seasonal_months": lambda t: R.seasonal_patterns(t.logs(), "month"),
    "busiest_day": lambda t: R.busiest_and_quietest(t.logs()),
    "distinct_users_by_season": lambda t: R.distinct_users_by_season(t.logs()),
    "term_momentum": lambda t: R.term_momentum(t.logs(), t.log_items(), t.products(), AS_OF, 1600),
    "daily_counts": lambda t: R.daily_counts(R.lookback_filter(t.traffic(), EVENTS_AS_OF, 30)),
    "popular_queries": lambda t: R.popular_queries(t.logs()),
    "hourly_traffic": lambda t: R.hourly_traffic(R.lookback_filter(t.traffic(), EVENTS_AS_OF, 2)),
    "weekday_traffic": lambda t: R.weekday_traffic(R.lookback_filter(t.traffic(), EVENTS_AS_OF, 3)),
    "usage_stats": lambda t: R.usage_stats(t.traffic(), "2024-01-30 00:00:00"),
    "table_counts": lambda t: R.table_counts({"products": t.products(), "stores": t.stores(), "prices": t.prices()}),
    "share_of_total": lambda t: W.share_of_total(t.logs().groupBy("town").agg(F.count(F.lit(1)).alias("n")), "n"),
    "non_empty_text": lambda t: t.raw("documents").where(F.length("text") > 0).select("doc_id", "lang"),
    "stream_query_volume": lambda t: R.stream_query_volume(t.traffic()),
    "distinct_values": lambda t: t.logs().select("user_id").distinct(),
    "week_of_year": lambda t: t.logs().select("log_id", R.week_of_year(F.col("ts")).alias("week"), F.dayofweek("ts").cast("long").alias("weekday"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_trunc("month", "ts").alias("month_start")),
}

ORACLES = {
    "lookback_filter": with_tables(f"select log_id, user_id from logs where ts >= timestamp '{AS_OF}' - interval {DAYS} day", "logs"),
    "half_open_window": with_tables("select log_id from logs where ts >= timestamp '1998-01-01' and ts < timestamp '1999-01-01'", "logs"),
    "explode_lookup": with_tables("select log_id, town, product_id, name from logs join log_items using (log_id) join products using (product_id)", "logs", "log_items", "products"),
    "count_by_town_product": with_tables(f"with {_RECENT} select town, product_id, name, count(*) as query_count from recent join log_items using (log_id) join products using (product_id) group by all", "logs", "log_items", "products"),
    "top_n_per_group": with_tables(f"with {_RECENT}, c as (select town, product_id, name, count(*) as query_count from recent join log_items using (log_id) join products using (product_id) group by all) select *, row_number() over (partition by town order by query_count desc, product_id) as rank from c qualify rank <= 20", "logs", "log_items", "products"),
    "volume_by_hour": with_tables("with d as (select hour(ts) as hour, dayofweek(ts) as dow, count(*) as n from traffic group by all) select hour, round(avg(n), 4) as mean_count, cast(sum(n) as bigint) as total, count(*) as weekdays from d group by hour", "traffic"),
    "rough_total_queries": with_tables("with d as (select hour(ts) as hour, dayofweek(ts) as dow, count(*) as n from traffic group by all), h as (select hour, round(avg(n), 4) as m, sum(n) as total from d group by hour) select round(sum(m) * 24, 2) as rough_total_queries, cast(sum(total) as bigint) as true_total from h", "traffic"),
    "peak_hours": with_tables("with d as (select hour(ts) as hour, dayofweek(ts) as dow, count(*) as n from traffic group by all) select hour, round(avg(n), 4) as mean_count, cast(sum(n) as bigint) as total, count(*) as weekdays from d group by hour order by mean_count desc, hour limit 5", "traffic"),
    "basket_size_distribution": with_tables("with s as (select log_id, count(product_id) as basket_size from logs left join log_items using (log_id) group by log_id), c as (select basket_size, count(*) as n from s group by all) select basket_size, n, case when basket_size <= 2 then 'small' when basket_size <= 5 then 'medium' else 'large' end as kind, round(n * 100.0 / sum(n) over (), 2) as percent from c", "logs", "log_items"),
    "basket_size_summary": with_tables("with s as (select log_id, count(product_id) as s from logs left join log_items using (log_id) group by log_id) select count(*) as total, round(avg(s), 2) as average, count(*) filter (s <= 2) as small, count(*) filter (s between 3 and 5) as medium, count(*) filter (s >= 6) as large from s", "logs", "log_items"),
    "seasonal_patterns": with_tables("with c as (select dayofweek(ts) + 1 as dow, strftime(ts, '%U') as week, month(ts) as month, count(*) as n from logs group by all) select dow, round(avg(n), 4) as mean_count, cast(sum(n) as bigint) as total from c group by dow", "logs"),
    "seasonal_months": with_tables("with c as (select dayofweek(ts) + 1 as dow, strftime(ts, '%U') as week, month(ts) as month, count(*) as n from logs group by all) select month, round(avg(n), 4) as mean_count, cast(sum(n) as bigint) as total from c group by month", "logs"),
    "busiest_day": with_tables("with c as (select dayofweek(ts) + 1 as dow, strftime(ts, '%U') as week, month(ts) as month, count(*) as n from logs group by all), d as (select dow, round(avg(n), 4) as m from c group by dow) select (select dow from d order by m desc, dow limit 1) as busiest, (select dow from d order by m, dow limit 1) as quietest", "logs"),
    "distinct_users_by_season": with_tables("select year(ts) as year, month(ts) as month, count(distinct user_id) as users from logs group by all", "logs"),
    "term_momentum": with_tables(f"""with b as (select timestamp '{AS_OF}' - interval 1600 day as a, timestamp '{AS_OF}' as z), m as (select a, a + interval 800 day as mid, z from b),
old as (select name as term, count(*) as previous_count from logs join log_items using (log_id) join products using (product_id), m where ts >= a and ts < mid group by name order by previous_count desc, term limit 50),
new as (select name as term, count(*) as current_count from logs join log_items using (log_id) join products using (product_id), m where ts >= mid and ts < z group by name order by current_count desc, term limit 50),
j as (select coalesce(old.term, new.term) as term, coalesce(previous_count, 0) as previous_count, coalesce(current_count, 0) as current_count from old full join new on old.term = new.term),
g as (select *, case when previous_count > 0 then (current_count - previous_count) / previous_count else 'inf'::double end as growth from j where current_count >= 5),
l as (select *, case when growth > 0.5 then 'up' when growth < -0.3 then 'down' else 'stable' end as label from g),
r as (select *, row_number() over (partition by label order by case label when 'up' then -growth when 'down' then growth else -(previous_count + current_count) / 2 end, term) as rank from l)
select term, previous_count, current_count, round(growth, 2) as growth_rate, label, rank from r where rank <= 20""", "logs", "log_items", "products"),
    "daily_counts": with_tables(f"select cast(ts as date) as day, count(*) as n from traffic where ts >= timestamp '{EVENTS_AS_OF}' - interval 30 day group by all", "traffic"),
    "popular_queries": with_tables("select text, count(*) as n from logs where length(text) > 0 group by text order by n desc, text limit 20", "logs"),
    "hourly_traffic": with_tables(f"with c as (select hour(ts) as hour, count(*) as n from traffic where ts >= timestamp '{EVENTS_AS_OF}' - interval 2 day group by all) select r.hour, coalesce(n, 0) as n from range(24) r(hour) left join c using (hour)", "traffic"),
    "weekday_traffic": with_tables(f"with c as (select dayofweek(ts) + 1 as weekday, count(*) as n from traffic where ts >= timestamp '{EVENTS_AS_OF}' - interval 3 day group by all) select r.weekday, coalesce(n, 0) as n from range(1, 8) r(weekday) left join c using (weekday)", "traffic"),
    "usage_stats": with_tables("select count(*) as total, count(*) filter (ts >= timestamp '2024-01-29') as today, count(distinct user_id) filter (ts >= timestamp '2024-01-29') as users_today, count(distinct user_id) as users from traffic", "traffic"),
    "table_counts": with_tables("select 'products' as table_name, count(*) as n from products union all select 'stores', count(*) from stores union all select 'prices', count(*) from prices", "products", "stores", "prices"),
    "share_of_total": with_tables("with c as (select town, count(*) as n from logs group by town) select town, n, round(n * 100.0 / sum(n) over (), 2) as percent from c", "logs"),
    "non_empty_text": "select doc_id, lang from documents where length(text) > 0",
    "stream_query_volume": with_tables("select date_trunc('hour', ts) as hour_start, count(*) as n from traffic group by all", "traffic"),
    "distinct_values": with_tables("select distinct user_id from logs", "logs"),
    "week_of_year": with_tables("select log_id, cast(strftime(ts, '%U') as bigint) as week, cast(dayofweek(ts) + 1 as bigint) as weekday, strftime(ts, '%Y-%m-%d') as day, date_trunc('month', ts) as month_start from logs", "logs"),
}
