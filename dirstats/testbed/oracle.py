"""DuckDB SQL for every registered query, written independently of the plans.

Each statement starts from the driver's base tables. Conventions shared with
the Spark side: rounding is half away from zero on a decimal image of the value,
ratings are summed in tenths, and every limit, rank and survivor has a total
order. ``{...}`` markers below are Python format fields.
"""

from __future__ import annotations

# The raw export seen through the base tables.
RAW = """
raw AS (
  SELECT '/listing/' || l_orderkey || '/' || l_linenumber AS url,
         s_name || ', ' || n_name AS address,
         ' ' || p_name || ' #' || p_partkey AS name,
         CASE WHEN (l_returnflag = 'R' AND n_nationkey % 3 <> 0)
                OR (l_returnflag = 'A' AND n_nationkey % 4 = 0)
              THEN 'No' ELSE 'Yes' END AS online_order,
         CASE WHEN l_linestatus = 'F' AND l_extendedprice > 50000
              THEN 'Yes' ELSE 'No' END AS book_table,
         CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O'
              THEN CASE WHEN l_linenumber % 2 = 0 THEN 'NEW' ELSE '-' END
              ELSE (rt // 10) || '.' || (rt % 10)
                   || CASE WHEN l_linenumber % 2 = 0 THEN '/5' ELSE ' /5' END END AS rate,
         CAST(floor(qty * qty * qty / 8.0) AS BIGINT) AS votes,
         CASE WHEN l_suppkey % 10 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS phone,
         n_name AS location,
         CASE WHEN l_partkey % 97 <> 0 THEN p_type END AS rest_type,
         CASE WHEN l_linenumber % 2 <> 0 THEN p_name END AS dish_liked,
         p_brand || ', ' || p_type AS cuisines,
         CASE WHEN cst >= 1000
              THEN (cst // 1000) || ',' || lpad(CAST(cst % 1000 AS VARCHAR), 3, '0')
              ELSE CAST(cst AS VARCHAR) END AS "approx_cost(for two people)",
         '[]' AS reviews_list,
         '[]' AS menu_item,
         l_returnflag AS "listed_in(type)",
         CAST(n_regionkey AS VARCHAR) AS "listed_in(city)",
         l_orderkey, l_linenumber, l_suppkey
  FROM (
    SELECT *,
           CAST(l_quantity AS BIGINT) AS qty,
           CAST(floor(l_extendedprice / 50) AS BIGINT) AS cst,
           least(49, 14 + 2 * CAST(round(l_discount * 100, 0) AS INTEGER)
                 + CAST(round(l_tax * 100, 0) AS INTEGER)
                 + 2 * (n_nationkey % 4)
                 + 2 * (CAST(replace(p_brand, 'Brand#', '') AS INTEGER) % 4)
                 + CASE WHEN l_extendedprice > 40050 THEN 3 ELSE 0 END) AS rt
    FROM lineitem
    JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey
    JOIN part ON l_partkey = p_partkey
  ) bound
)"""

PARSED = (
    RAW
    + """,
parsed AS (
  SELECT trim(name) AS name,
         CASE online_order WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS online_order,
         CASE book_table WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS book_table,
         CASE WHEN rate NOT IN ('NEW', '-')
              THEN CAST(split_part(replace(rate, ' ', ''), '/', 1) AS DOUBLE) END AS rate,
         votes, trim(location) AS location, trim(rest_type) AS rest_type,
         trim(coalesce(dish_liked, 'Not Available')) AS dish_liked,
         trim(cuisines) AS cuisines,
         CAST(replace("approx_cost(for two people)", ',', '') AS INTEGER) AS approx_cost,
         "listed_in(type)" AS listed_type, "listed_in(city)" AS listed_city,
         l_orderkey, l_linenumber, l_suppkey
  FROM raw
),
complete AS (
  SELECT * FROM parsed
  WHERE approx_cost IS NOT NULL AND rest_type IS NOT NULL
    AND cuisines IS NOT NULL AND location IS NOT NULL
),
first_row AS (
  SELECT name, location, coalesce(online_order, 0) AS online_order,
         coalesce(book_table, 0) AS book_table
  FROM parsed
  QUALIFY row_number() OVER (
    PARTITION BY name, location
    ORDER BY l_orderkey, l_linenumber, l_suppkey,
             online_order NULLS FIRST, book_table NULLS FIRST) = 1
)"""
)

_FEATURES = """
  CASE WHEN approx_cost <= 0 THEN NULL WHEN approx_cost <= 400 THEN 'Budget'
       WHEN approx_cost <= 800 THEN 'Mid-range' WHEN approx_cost > 800 THEN 'Premium'
       END AS price_category,
  CASE WHEN rate IS NULL THEN 'Unrated' WHEN rate < 3.0 THEN 'Poor'
       WHEN rate < 3.5 THEN 'Average' WHEN rate <= 4.0 THEN 'Good'
       ELSE 'Excellent' END AS rating_label,
  trim(split_part(cuisines, ',', 1)) AS primary_cuisine,
  CAST(len(string_split(cuisines, ',')) AS INTEGER) AS cuisine_count"""

_CLEAN = """d.name, f.online_order, f.book_table, d.rate, d.votes, d.location, d.rest_type,
         d.dish_liked, d.cuisines, d.approx_cost, d.listed_type, d.listed_city"""

LISTINGS = (
    PARSED
    + f""",
clean AS (
  SELECT {_CLEAN}
  FROM (SELECT DISTINCT * EXCLUDE (l_orderkey, l_linenumber, l_suppkey) FROM complete) d
  LEFT JOIN first_row f ON d.name IS NOT DISTINCT FROM f.name AND d.location = f.location
),
listings AS (SELECT *, {_FEATURES} FROM clean)"""
)

ORDERED_LISTINGS = (
    PARSED
    + f""",
ordered_listings AS (
  SELECT *, {_FEATURES} FROM (
    SELECT {_CLEAN}, d.first_order
    FROM (
      SELECT * EXCLUDE (l_orderkey, l_linenumber, l_suppkey),
             min({{'a': l_orderkey, 'b': l_linenumber, 'c': l_suppkey}}) AS first_order
      FROM complete GROUP BY ALL
    ) d
    LEFT JOIN first_row f ON d.name IS NOT DISTINCT FROM f.name AND d.location = f.location
  ) c
)"""
)

ENTITIES = (
    LISTINGS
    + """,
entities AS (
  SELECT * EXCLUDE (listed_type) FROM listings
  QUALIFY row_number() OVER (
    PARTITION BY name, location
    ORDER BY votes DESC NULLS LAST, rate DESC NULLS LAST, rest_type DESC NULLS LAST,
             dish_liked DESC NULLS LAST, cuisines DESC NULLS LAST,
             approx_cost DESC NULLS LAST, listed_city DESC NULLS LAST) = 1
)"""
)

COORDINATES = """
dim AS (
  SELECT n_name AS location, CAST(12.70 AS DOUBLE) + CAST(0.03 AS DOUBLE) * n_nationkey AS latitude,
         CAST(77.30 AS DOUBLE) + CAST(0.02 AS DOUBLE) * n_nationkey AS longitude
  FROM nation WHERE n_nationkey % 10 <> 9
),
coords AS (
  SELECT * FROM dim WHERE location <> 'NATION_9'
    AND latitude BETWEEN 12.7 AND 13.3 AND longitude BETWEEN 77.3 AND 77.9
  UNION ALL
  SELECT 'NATION_9', CAST(12.95 AS DOUBLE), CAST(77.55 AS DOUBLE)
)"""


def rnd(expr: str, digits: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def pct(part: str, whole: str, digits: int = 1) -> str:
    return rnd(f"CAST(100 * ({part}) AS DOUBLE) / nullif({whole}, 0)", digits)


def mean(column: str, where: str = "TRUE") -> str:
    chosen = f"CASE WHEN {where} THEN {column} END"
    return f"CAST(sum({chosen}) AS DOUBLE) / nullif(count({chosen}), 0)"


def mean_rate(where: str = "TRUE") -> str:
    exact = f"CASE WHEN {where} THEN CAST(rate * 10000 AS DECIMAL(28,12)) END"
    return f"CAST(sum({exact}) AS DOUBLE) / nullif(10000 * count({exact}), 0)"


def count_if(where: str) -> str:
    return f"count(*) FILTER (WHERE {where})"


def label_pct(label: str) -> str:
    return pct(count_if(f"rating_label = '{label}'"), "count(*)")


N = "count(*)"
AVG_RATE = rnd(mean_rate(), 2)
AVG_COST = rnd(mean("approx_cost"), 0)
AVG_VOTES = rnd(mean("votes"), 0)
QUALITY = pct(count_if("rating_label IN ('Good', 'Excellent')"), "count(rate)")
UNRATED_PCT = pct(count_if("rate IS NULL"), N)
ONLINE_PCT = rnd(f"{mean('online_order')} * 100", 1)
BOOKING_PCT = rnd(f"{mean('book_table')} * 100", 1)
VALUE = rnd(f"(({mean_rate()}) * 100) / ({mean('approx_cost')})", 3)
DIGITAL = rnd(f"({mean('online_order')}) * 70 + ({mean('book_table')}) * 30", 1)
PERFORMANCE = rnd(f"({mean_rate()}) * log10(({mean('votes')}) + 1)", 2)
PLATFORM_RATE = f"(SELECT {mean_rate()} FROM entities)"
PLATFORM_ONLINE = f"(SELECT {mean('online_order')} FROM entities)"
LABELS = ("Excellent", "Good", "Average", "Poor", "Unrated")
TIERS = "(VALUES ('Budget', 1), ('Mid-range', 2), ('Premium', 3)) t(price_category, o)"
SERVICE = "CASE WHEN online_order = 1 THEN 'Online Ordering' ELSE 'Dine-in Only' END"
TIER_ORDER = "CASE price_category WHEN 'Budget' THEN 1 WHEN 'Mid-range' THEN 2 WHEN 'Premium' THEN 3 END"
GEM = "price_category = 'Budget' AND rate >= 4.0 AND votes >= 100"


def over(base: str, statement: str, *ctes: str) -> str:
    return f"WITH {', '.join([base, *ctes])}\n{statement}"


def from_entities(statement: str, *ctes: str) -> str:
    return over(ENTITIES, statement, *ctes)


def from_listings(statement: str, *ctes: str) -> str:
    return over(LISTINGS, statement, *ctes)


def from_raw(statement: str, *ctes: str) -> str:
    return over(RAW, statement, *ctes)


def _summaries() -> dict[str, str]:
    def adoption(flag: str, name: str) -> str:
        return from_entities(
            f"SELECT CAST(sum({flag}) AS BIGINT) AS with_{name}, "
            f"CAST(count(*) - sum({flag}) AS BIGINT) AS without_{name}, "
            f"{pct(f'sum({flag})', N)} AS pct_with_{name} FROM entities"
        )

    def dist(column: str) -> str:
        return from_entities(
            f"SELECT {column}, count(*) AS restaurant_count, "
            f"{pct(N, '(SELECT count(*) FROM entities)')} AS pct_of_total "
            f"FROM entities GROUP BY {column}"
        )

    def distinct(column: str, out: str) -> str:
        return from_entities(f"SELECT count(DISTINCT {column}) AS {out} FROM entities")

    return {
        "sum_01_total": from_entities("SELECT count(*) AS total_restaurants FROM entities"),
        "sum_02_locations": distinct("location", "total_locations"),
        "sum_03_cuisines": distinct("primary_cuisine", "total_cuisines"),
        "sum_04_rest_types": distinct("rest_type", "total_rest_types"),
        "sum_05_rating_range": from_entities(
            f"SELECT min(rate) AS min_rate, max(rate) AS max_rate, {AVG_RATE} AS avg_rate, "
            "count(*) AS rated_count FROM entities WHERE rate IS NOT NULL"
        ),
        "sum_06_unrated": from_entities(
            f"SELECT {count_if('rate IS NULL')} AS unrated_count, {UNRATED_PCT} AS pct_of_total "
            "FROM entities"
        ),
        "sum_07_cost_range": from_entities(
            "SELECT min(approx_cost) AS min_cost, max(approx_cost) AS max_cost, "
            f"{AVG_COST} AS avg_cost, quantile_cont(approx_cost, 0.5) AS median_cost FROM entities"
        ),
        "sum_08_votes_range": from_entities(
            f"SELECT min(votes) AS min_votes, max(votes) AS max_votes, {AVG_VOTES} AS avg_votes "
            "FROM entities"
        ),
        "sum_09_online": adoption("online_order", "online_order"),
        "sum_10_booking": adoption("book_table", "table_booking"),
        "sum_11_price_dist": dist("price_category"),
        "sum_12_label_dist": dist("rating_label"),
        "kpi_snapshot": from_entities(
            f"SELECT count(*) AS total_restaurants, {AVG_RATE} AS avg_rating, "
            f"{AVG_COST} AS avg_cost, {ONLINE_PCT} AS online_order_pct, "
            f"{BOOKING_PCT} AS book_table_pct, {UNRATED_PCT} AS unrated_pct, "
            "count(DISTINCT location) AS unique_locations, "
            "count(DISTINCT primary_cuisine) AS unique_cuisines FROM entities"
        ),
        "table_check": from_listings(
            "SELECT count(*) AS total_rows, count(DISTINCT location) AS unique_locations, "
            f"count(DISTINCT primary_cuisine) AS unique_cuisines, {AVG_RATE} AS avg_rating, "
            "min(approx_cost) AS min_cost, max(approx_cost) AS max_cost FROM listings"
        ),
    }


_VOTE_BUCKET = """CASE WHEN votes BETWEEN 0 AND 10 THEN '1. Minimal   (0 – 10)'
  WHEN votes BETWEEN 11 AND 100 THEN '2. Low       (11 – 100)'
  WHEN votes BETWEEN 101 AND 500 THEN '3. Moderate  (101 – 500)'
  WHEN votes BETWEEN 501 AND 1000 THEN '4. Good      (501 – 1,000)'
  WHEN votes BETWEEN 1001 AND 5000 THEN '5. High      (1,001 – 5,000)'
  ELSE '6. Very High  (5,001+)' END"""


def _rating() -> dict[str, str]:
    cells = ", ".join(
        f"{count_if(f'''rating_label = '{x}' ''')} AS {x.lower()}_count, "
        f"{label_pct(x)} AS {x.lower()}_pct"
        for x in LABELS
    )
    return {
        "q1_credible": from_entities(
            "SELECT name, location, primary_cuisine, rest_type, rate, votes, "
            "approx_cost AS cost_for_two, price_category, online_order, book_table, "
            f"{rnd('rate * log10(votes + 1)', 2)} AS credibility_score FROM entities "
            "WHERE rate >= 4.0 AND votes >= 500 "
            "ORDER BY credibility_score DESC, votes DESC, name, location LIMIT 10"
        ),
        "q2_rating_crosstab": from_entities(
            f"SELECT price_category, count(*) AS total_restaurants, {AVG_RATE} AS avg_rate, "
            f"{cells}, {QUALITY} AS quality_score_pct FROM entities GROUP BY price_category"
        ),
        "q3_vote_buckets": from_entities(
            f"SELECT {_VOTE_BUCKET} AS vote_bucket, count(*) AS total_restaurants, "
            f"{AVG_VOTES} AS avg_votes, {AVG_RATE} AS avg_rating, "
            f"{count_if('rate IS NULL')} AS unrated_count, {UNRATED_PCT} AS unrated_pct, "
            f"{QUALITY} AS quality_score_pct, min(rate) AS min_rating, max(rate) AS max_rating "
            "FROM entities GROUP BY 1"
        ),
    }


def _location() -> dict[str, str]:
    vs_online = rnd(f"{ONLINE_PCT} - {PLATFORM_ONLINE} * 100", 1)
    market = (
        f"CASE WHEN {ONLINE_PCT} >= 70 THEN 'Heavy Delivery' WHEN {ONLINE_PCT} >= 55 "
        f"THEN 'Balanced' WHEN {ONLINE_PCT} >= 40 THEN 'Dine-in Leaning' ELSE 'Traditional' END"
    )
    floors = f"count(*) >= 100 AND count(rate) >= 50 AND {mean_rate()} >= 3.5"
    q4 = (
        "SELECT location, count(*) AS total_restaurants, "
        f"{pct(N, '(SELECT count(*) FROM entities)')} AS market_share_pct, "
        f"{AVG_RATE} AS avg_rating, {AVG_COST} AS avg_cost, {QUALITY} AS quality_score_pct, "
        f"{ONLINE_PCT} AS online_order_pct, {UNRATED_PCT} AS unrated_pct "
        "FROM entities GROUP BY location HAVING count(*) >= 100"
    )
    q5 = (
        f"SELECT location, count(*) AS total_restaurants, {AVG_RATE} AS avg_rating, "
        f"{AVG_COST} AS avg_cost, {QUALITY} AS quality_score_pct, "
        f"{ONLINE_PCT} AS online_order_pct, {UNRATED_PCT} AS unrated_pct, "
        f"{VALUE} AS value_score FROM entities GROUP BY location HAVING {floors}"
    )
    q6 = (
        f"SELECT location, count(*) AS total_restaurants, {ONLINE_PCT} AS online_order_pct, "
        f"{BOOKING_PCT} AS book_table_pct, {vs_online} AS vs_platform_avg, "
        f"{DIGITAL} AS digital_score, {AVG_RATE} AS avg_rating, {AVG_COST} AS avg_cost, "
        f"{market} AS market_type FROM entities GROUP BY location HAVING count(*) >= 100"
    )
    return {
        "q4_location_leaderboard": from_entities(
            f"{q4} ORDER BY total_restaurants DESC, location LIMIT 15"
        ),
        "q5_value_locations": from_entities(
            "SELECT rank() OVER (ORDER BY value_score DESC) AS value_rank, * FROM v "
            "ORDER BY value_score DESC, location LIMIT 15",
            f"v AS ({q5})",
        ),
        "q6_digital_adoption": from_entities(
            "SELECT rank() OVER (ORDER BY online_order_pct DESC) AS digital_rank, * FROM d "
            "ORDER BY online_order_pct DESC, location LIMIT 15",
            f"d AS ({q6})",
        ),
        "location_scorecard": from_entities(
            "SELECT q4.location, q4.total_restaurants, q4.market_share_pct, q4.avg_rating, "
            "q4.avg_cost, q4.quality_score_pct, v.value_rank, v.value_score, d.digital_rank, "
            "d.online_order_pct, d.vs_platform_avg, d.digital_score, d.market_type "
            "FROM q4 LEFT JOIN v USING (location) LEFT JOIN d USING (location)",
            f"q4 AS ({q4})",
            f"v AS (SELECT rank() OVER (ORDER BY value_score DESC) AS value_rank, * FROM ({q5}) x)",
            "d AS (SELECT rank() OVER (ORDER BY online_order_pct DESC) AS digital_rank, * "
            f"FROM ({q6}) y)",
        ),
    }


def _cuisine() -> dict[str, str]:
    dominant = (
        "cells AS (SELECT location, primary_cuisine, count(*) AS n, "
        f"{AVG_RATE} AS avg_rating FROM entities GROUP BY ALL)",
        "dominant AS (SELECT *, CAST(sum(n) OVER (PARTITION BY location) AS BIGINT) AS total "
        "FROM cells QUALIFY row_number() OVER "
        "(PARTITION BY location ORDER BY n DESC, primary_cuisine) = 1)",
    )
    stats = (
        "measured AS (SELECT primary_cuisine, count(*) AS total_count, count(rate) AS rated_count, "
        f"{AVG_RATE} AS avg_rating, {rnd(f'{AVG_RATE} - {PLATFORM_RATE}', 2)} AS vs_platform_avg, "
        f"{AVG_COST} AS avg_cost, {AVG_VOTES} AS avg_votes, {QUALITY} AS quality_score_pct, "
        f"{ONLINE_PCT} AS online_order_pct, {UNRATED_PCT} AS unrated_pct, "
        f"{PERFORMANCE} AS performance_index FROM entities GROUP BY primary_cuisine "
        "HAVING count(*) >= 50)",
        "stats AS (SELECT *, rank() OVER (ORDER BY total_count DESC) AS popularity_rank, "
        "rank() OVER (ORDER BY avg_rating DESC NULLS LAST) AS quality_rank, "
        "CASE WHEN avg_rating >= 3.9 THEN 'Star Performer' WHEN avg_rating >= 3.7 "
        "THEN 'Above Average' WHEN avg_rating >= 3.5 THEN 'At Par' ELSE 'Below Average' END "
        "AS performance_tier FROM measured)",
    )
    return {
        "q7a_dominant_cuisine": from_entities(
            "SELECT location, primary_cuisine AS dominant_cuisine, n AS dominant_cuisine_count, "
            f"total AS total_restaurants, {pct('n', 'total')} AS cuisine_share_pct, "
            "avg_rating AS cuisine_avg_rating FROM dominant ORDER BY total DESC, location LIMIT 20",
            *dominant,
        ),
        "q7b_dominance_summary": from_entities(
            "SELECT primary_cuisine AS dominant_cuisine, count(*) AS locations_dominated, "
            f"{pct(N, '(SELECT count(*) FROM dominant)')} AS pct_of_all_locations, "
            "CAST(sum(n) AS BIGINT) AS total_restaurants_as_dominant, "
            f"{rnd(mean('n'), 0)} AS avg_count_per_location FROM dominant GROUP BY primary_cuisine "
            "ORDER BY locations_dominated DESC, dominant_cuisine LIMIT 10",
            *dominant,
        ),
        "q8a_cuisine_popularity": from_entities(
            "SELECT popularity_rank, quality_rank, primary_cuisine, total_count, rated_count, "
            "avg_rating, vs_platform_avg, avg_cost, avg_votes, quality_score_pct, "
            "online_order_pct, unrated_pct, performance_index, performance_tier FROM stats "
            "ORDER BY total_count DESC, primary_cuisine LIMIT 15",
            *stats,
        ),
        "q8b_cuisine_quality": from_entities(
            "SELECT quality_rank, popularity_rank, primary_cuisine, total_count, avg_rating, "
            "vs_platform_avg, avg_cost, avg_votes, quality_score_pct, online_order_pct, "
            "performance_index, performance_tier FROM stats "
            "ORDER BY avg_rating DESC NULLS LAST, primary_cuisine LIMIT 15",
            *stats,
        ),
        "cuisine_rank_gap": from_entities(
            "SELECT primary_cuisine, total_count, avg_rating, popularity_rank, quality_rank, "
            "popularity_rank - quality_rank AS rank_gap FROM stats",
            *stats,
        ),
    }


def _pricing() -> dict[str, str]:
    tiers = (
        f"tiers AS (SELECT price_category, {TIER_ORDER} AS o, count(*) AS total_restaurants, "
        f"{AVG_RATE} AS avg_rating, {AVG_COST} AS avg_cost, {AVG_VOTES} AS avg_votes, "
        f"{QUALITY} AS quality_score_pct, {label_pct('Excellent')} AS excellent_pct, "
        f"{label_pct('Poor')} AS poor_pct, {ONLINE_PCT} AS online_order_pct, "
        f"{BOOKING_PCT} AS book_table_pct, {UNRATED_PCT} AS unrated_pct, {VALUE} AS value_score "
        "FROM entities GROUP BY price_category)"
    )

    def jump(metric: str, digits: int) -> str:
        return rnd(f"{metric} - lag({metric}) OVER (ORDER BY o NULLS LAST)", digits)

    below = (
        "(SELECT count(*) FROM entities r WHERE r.rate < g.rate)",
        "(SELECT count(rate) FROM entities)",
    )
    return {
        "q9_price_tier": from_entities(
            "SELECT price_category, total_restaurants, "
            f"{pct('total_restaurants', 'sum(total_restaurants) OVER ()')} AS market_share_pct, "
            f"avg_rating, {jump('avg_rating', 2)} AS rating_jump_vs_prev, avg_cost, "
            f"{jump('avg_cost', 0)} AS cost_jump_vs_prev, avg_votes, "
            f"{jump('avg_votes', 0)} AS votes_jump_vs_prev, quality_score_pct, excellent_pct, "
            "poor_pct, online_order_pct, book_table_pct, unrated_pct, value_score, "
            "CASE WHEN o = 1 THEN 'Baseline tier' "
            f"WHEN {jump('avg_rating', 2)} > 0.25 THEN 'Justified — large quality gain' "
            f"WHEN {jump('avg_rating', 2)} > 0.10 THEN 'Marginal — small quality gain' "
            "ELSE 'Not justified — minimal quality gain' END AS price_jump_verdict FROM tiers",
            tiers,
        ),
        "q10a_hidden_gems": from_entities(
            "SELECT rank() OVER (ORDER BY votes DESC) AS gem_rank, "
            "ntile(3) OVER (ORDER BY votes DESC, name, location) AS proof_bucket, name, location, "
            "primary_cuisine, rest_type, rate, votes, approx_cost AS cost_for_two, "
            f"{rnd('rate * 100 / approx_cost', 2)} AS value_index, "
            f"{pct(*below)} AS beats_pct_of_platform, online_order, book_table, "
            "CASE WHEN rate >= 4.5 THEN 'Exceptional' WHEN rate >= 4.2 THEN 'Excellent' "
            f"ELSE 'Very Good' END AS gem_tier FROM entities g WHERE {GEM} "
            "ORDER BY votes DESC, name, location LIMIT 15"
        ),
        "gem_proof_buckets": from_entities(
            "SELECT name, location, votes, ntile(3) OVER (ORDER BY votes DESC, name, location) "
            f"AS proof_bucket FROM entities WHERE {GEM}"
        ),
        "rating_percentiles": from_entities(
            f"SELECT name, location, rate, {pct(*below)} AS beats_pct_of_platform "
            "FROM entities g WHERE rate IS NOT NULL"
        ),
        "q10b_gem_rarity": from_entities(
            "SELECT count(*) AS total_budget_restaurants, count(rate) AS rated_budget, "
            f"{count_if('rate >= 4.0')} AS rated_4_plus, "
            f"{pct(count_if('rate >= 4.0'), 'count(rate)')} AS pct_of_rated_budget, "
            f"{count_if('rate >= 4.0 AND votes >= 100')} AS proven_gems, "
            f"{pct(count_if('rate >= 4.0 AND votes >= 100'), N)} AS pct_of_all_budget, "
            f"{rnd(mean('approx_cost', 'rate >= 4.0 AND votes >= 100'), 0)} AS gems_avg_cost, "
            f"{rnd(mean_rate('rate >= 4.0 AND votes >= 100'), 2)} AS gems_avg_rating "
            "FROM entities WHERE price_category = 'Budget'"
        ),
    }


def _service() -> dict[str, str]:
    segment = (
        "CASE WHEN online_order = 1 AND book_table = 1 THEN '1. Both Services' "
        "WHEN online_order = 1 AND book_table = 0 THEN '2. Online Only' "
        "WHEN online_order = 0 AND book_table = 1 THEN '3. Table Only' ELSE '4. Neither' END"
    )
    verdict = (
        f"CASE WHEN {AVG_RATE} >= 3.90 THEN 'Strong signal' WHEN {AVG_RATE} >= 3.75 "
        f"THEN 'Moderate signal' WHEN {AVG_RATE} >= 3.60 THEN 'Weak signal' ELSE 'No signal' END"
    )
    tail = (
        f"{AVG_COST} AS avg_cost, {AVG_VOTES} AS avg_votes, {QUALITY} AS quality_score_pct, "
        f"{label_pct('Excellent')} AS excellent_pct, {label_pct('Poor')} AS poor_pct, "
        f"{UNRATED_PCT} AS unrated_pct"
    )
    premium = pct(count_if("price_category = 'Premium'"), N)
    median_rate = rnd("quantile_cont(rate, 0.5)", 2)

    def part(online: int, book: int) -> str:
        return pct(count_if(f"online_order = {online} AND book_table = {book}"), N)

    return {
        "q11a_online_vs_dinein": from_entities(
            f"SELECT {SERVICE} AS service_type, count(*) AS total_restaurants, "
            f"{pct(N, '(SELECT count(*) FROM entities)')} AS pct_of_platform, "
            f"{AVG_RATE} AS avg_rating, {median_rate} AS median_rating, "
            f"{rnd(f'{mean_rate()} - {PLATFORM_RATE}', 2)} AS vs_platform_avg, "
            f"{rnd('quantile_cont(approx_cost, 0.5)', 0)} AS median_cost, "
            f"{BOOKING_PCT} AS also_book_table_pct, {tail}, {VALUE} AS value_score "
            "FROM entities GROUP BY online_order"
        ),
        "q11b_tier_composition": from_entities(
            f"SELECT {SERVICE} AS service_type, price_category, restaurant_count, "
            f"{pct('restaurant_count', 'sum(restaurant_count) OVER (PARTITION BY online_order)')} "
            "AS pct_within_service, avg_rating, avg_cost, avg_votes FROM c",
            "c AS (SELECT online_order, price_category, count(*) AS restaurant_count, "
            f"{AVG_RATE} AS avg_rating, {AVG_COST} AS avg_cost, {AVG_VOTES} AS avg_votes "
            "FROM entities GROUP BY ALL)",
        ),
        "q12a_service_segments": from_entities(
            f"SELECT {segment} AS service_segment, count(*) AS total_restaurants, "
            f"{pct(N, '(SELECT count(*) FROM entities)')} AS pct_of_platform, "
            f"{AVG_RATE} AS avg_rating, {median_rate} AS median_rating, "
            f"{rnd(f'{AVG_RATE} - {PLATFORM_RATE}', 2)} AS vs_platform_avg, {tail}, "
            f"{premium} AS premium_pct, {VALUE} AS value_score, {verdict} AS digital_verdict "
            "FROM entities GROUP BY 1 UNION ALL "
            f"SELECT '— Platform Average', count(*), CAST(100.0 AS DOUBLE), {AVG_RATE}, "
            f"{median_rate}, CAST(0.0 AS DOUBLE), {tail}, {premium}, {VALUE}, 'Benchmark' "
            "FROM entities"
        ),
        "q12b_service_by_tier": from_entities(
            f"SELECT price_category, count(*) AS total_in_tier, {part(1, 1)} AS both_services_pct, "
            f"{part(1, 0)} AS online_only_pct, {part(0, 1)} AS table_only_pct, "
            f"{part(0, 0)} AS neither_pct, {AVG_RATE} AS tier_avg_rating "
            "FROM entities GROUP BY price_category"
        ),
    }


_CLEAN_NAMES = (
    "name, online_order, book_table, rate, votes, location, rest_type, dish_liked, cuisines, "
    "approx_cost, listed_type, listed_city"
)
_FEATURE_NAMES = "price_category, rating_label, primary_cuisine, cuisine_count"
RAW_COLUMNS = (
    "url",
    "address",
    "name",
    "online_order",
    "book_table",
    "rate",
    "votes",
    "phone",
    "location",
    "rest_type",
    "dish_liked",
    "cuisines",
    "approx_cost(for two people)",
    "reviews_list",
    "menu_item",
    "listed_in(type)",
    "listed_in(city)",
)


def _cleaning() -> dict[str, str]:
    raw_names = ", ".join(f'"{c}"' for c in RAW_COLUMNS)
    missing = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {count_if(f'''"{c}" IS NULL''')} AS missing_count, "
        f"{pct(count_if(f'''"{c}" IS NULL'''), N, 2)} AS missing_pct FROM raw"
        for c in RAW_COLUMNS
    )
    kept = "approx_cost IS NOT NULL AND rest_type IS NOT NULL AND cuisines IS NOT NULL AND location IS NOT NULL"
    tops = {
        "rate": 30,
        "approx_cost(for two people)": 20,
        "online_order": None,
        "book_table": None,
        "listed_in(type)": None,
        "location": 20,
        "rest_type": 15,
        "cuisines": 15,
    }
    frequent = " UNION ALL ".join(
        f"(SELECT '{c}' AS column_name, \"{c}\" AS value, count(*) AS row_count FROM raw "
        f"WHERE \"{c}\" IS NOT NULL GROUP BY \"{c}\" ORDER BY row_count DESC, value"
        + (f" LIMIT {n})" if n else ")")
        for c, n in tops.items()
    )

    def duplicates(source: str) -> str:
        return (
            f"SELECT total AS total_rows, total - uniq AS duplicate_rows, "
            f"{pct('total - uniq', 'total', 2)} AS pct_of_total, uniq AS rows_after FROM ("
            f"SELECT (SELECT count(*) FROM {source}) AS total, "
            f"(SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS uniq)"
        )

    nulls = " + ".join(f"{count_if(f'{c.strip()} IS NULL')}" for c in _CLEAN_NAMES.split(","))
    return {
        "parse_listings": over(PARSED, f"SELECT {_CLEAN_NAMES} FROM parsed"),
        "clean_listings": from_listings(f"SELECT {_CLEAN_NAMES} FROM clean"),
        "engineer_features": from_listings(
            f"SELECT {_CLEAN_NAMES}, {_FEATURE_NAMES} FROM listings"
        ),
        "csv_listings": from_listings(f"SELECT {_CLEAN_NAMES}, {_FEATURE_NAMES} FROM listings"),
        "csv_clean_listings": from_listings(f"SELECT {_CLEAN_NAMES} FROM clean"),
        "csv_malformed_report": (
            "SELECT count(*) AS records, "
            f"{count_if('c_custkey % 7 <> 0 AND c_custkey % 11 <> 0')} AS good, "
            f"{count_if('c_custkey % 7 = 0')} AS wrong_fields, "
            f"{count_if('c_custkey % 7 <> 0 AND c_custkey % 11 = 0')} AS wrong_values FROM customer"
        ),
        "first_rows": over(
            PARSED,
            f"SELECT {_CLEAN_NAMES} FROM parsed ORDER BY l_orderkey, l_linenumber, l_suppkey LIMIT 5",
        ),
        "column_profile": from_listings(
            " UNION ALL ".join(
                f"SELECT CAST({i} AS BIGINT) AS position, '{c.strip()}' AS column_name, "
                f"'{_TYPES.get(c.strip(), 'string')}' AS data_type, count({c.strip()}) AS non_null, "
                f"count(*) - count({c.strip()}) AS nulls FROM clean"
                for i, c in enumerate(_CLEAN_NAMES.split(","), 1)
            )
        ),
        "profile_missing": from_raw(f"SELECT * FROM ({missing}) WHERE missing_count > 0"),
        "profile_frequencies": from_raw(frequent),
        "duplicate_rows": from_raw(
            duplicates("r"), f"r AS (SELECT {raw_names} FROM raw)"
        ),
        "null_drop_report": over(
            PARSED,
            f"SELECT count(*) AS rows_before, count(*) - {count_if(kept)} AS rows_dropped, "
            f"{pct(f'count(*) - {count_if(kept)}', N, 2)} AS pct_dropped, "
            f"{count_if(kept)} AS rows_after FROM parsed",
        ),
        "row_dedup_report": over(
            PARSED,
            duplicates("c"),
            "c AS (SELECT * EXCLUDE (l_orderkey, l_linenumber, l_suppkey) FROM complete)",
        ),
        "reject_report": over(
            RAW,
            "SELECT unnest(['rate', 'approx_cost', 'online_order', 'book_table']) AS column_name, "
            "unnest([r, c, o, b]) AS rejected FROM (SELECT "
            + count_if(
                "rate NOT IN ('NEW', '-') AND "
                "TRY_CAST(split_part(replace(rate, ' ', ''), '/', 1) AS DOUBLE) IS NULL"
            )
            + " AS r, "
            + count_if(
                "\"approx_cost(for two people)\" IS NOT NULL AND TRY_CAST("
                "replace(\"approx_cost(for two people)\", ',', '') AS INTEGER) IS NULL"
            )
            + f" AS c, {count_if('''online_order NOT IN ('Yes', 'No')''')} AS o, "
            f"{count_if('''book_table NOT IN ('Yes', 'No')''')} AS b FROM raw)",
        ),
        "cleaned_profile": from_listings(
            f"SELECT count(*) AS total_rows, CAST(12 AS BIGINT) AS total_columns, "
            f"{nulls} AS null_cells, min(approx_cost) AS min_cost, max(approx_cost) AS max_cost, "
            f"min(rate) AS min_rate, max(rate) AS max_rate, "
            f"{pct('sum(online_order)', 'count(online_order)')} AS online_pct, "
            f"{pct('sum(book_table)', 'count(book_table)')} AS booking_pct FROM clean"
        ),
        "write_verify": from_listings(
            "SELECT count(*) AS rows_expected, count(*) AS rows_written, "
            "CAST(16 AS BIGINT) AS columns_written, TRUE AS same_columns, "
            "CAST(0 AS BIGINT) AS rows_missing, CAST(0 AS BIGINT) AS rows_unexpected FROM listings"
        ),
        "listings_by_sql": from_listings(
            "SELECT listed_type, count(*) AS row_count, CAST(sum(votes) AS BIGINT) AS total_votes "
            "FROM listings WHERE approx_cost > 400 GROUP BY listed_type"
        ),
        "distinct_locations": from_listings(
            "SELECT DISTINCT location FROM listings WHERE location IS NOT NULL"
        ),
    }


def _entity() -> dict[str, str]:
    firsts = ", ".join(
        f"first({c} ORDER BY first_order, {c}) FILTER (WHERE {c} IS NOT NULL) AS {c}"
        for c in (
            "rest_type",
            "dish_liked",
            "cuisines",
            "listed_city",
            "price_category",
            "rating_label",
            "primary_cuisine",
        )
    )
    means = ", ".join(
        f"{mean(c)} AS {c}"
        for c in ("online_order", "book_table", "votes", "approx_cost", "cuisine_count")
    )
    sizes = (
        "sizes AS (SELECT name, location, count(*) AS listings FROM listings "
        "WHERE name IS NOT NULL AND location IS NOT NULL GROUP BY name, location)"
    )
    votes_spread = "max(votes) - min(votes)"
    rate_spread = "max(CAST(rate AS DECIMAL(28,12))) - min(CAST(rate AS DECIMAL(28,12)))"
    return {
        "entity_dedup_max_votes": from_entities("SELECT * FROM entities"),
        "entity_dedup_mean": over(
            ORDERED_LISTINGS,
            f"SELECT name, location, {means}, {mean_rate()} AS rate, {firsts} "
            "FROM ordered_listings GROUP BY name, location",
        ),
        "entity_dup_report": from_listings(
            "SELECT total AS total_rows, uniq AS unique_entities, total - uniq AS duplicate_rows, "
            f"{rnd('CAST(total AS DOUBLE) / uniq', 2)} AS avg_listings_per_entity FROM (SELECT "
            "(SELECT count(*) FROM listings) AS total, "
            "(SELECT count(*) FROM (SELECT DISTINCT name, location FROM listings)) AS uniq)"
        ),
        "entity_listing_distribution": from_listings(
            "SELECT listings, count(*) AS entities FROM sizes GROUP BY listings", sizes
        ),
        "entity_most_duplicated": from_listings(
            "SELECT name, location, listed_type, votes, rate FROM listings JOIN ("
            "SELECT name, location FROM sizes ORDER BY listings DESC, name, location LIMIT 1) t "
            "USING (name, location)",
            sizes,
        ),
        "entity_consistency": from_listings(
            "SELECT 'votes' AS column_name, count(*) FILTER (WHERE v > 0) AS inconsistent_entities, "
            f"{rnd('CAST(max(v) AS DOUBLE)', 2)} AS max_spread FROM s UNION ALL "
            "SELECT 'rate', count(*) FILTER (WHERE r > 0), "
            f"{rnd('max(r)', 2)} FROM s",
            f"s AS (SELECT {votes_spread} AS v, {rate_spread} AS r FROM listings "
            "WHERE name IS NOT NULL AND location IS NOT NULL GROUP BY name, location)",
        ),
        "entity_named_rows": from_entities(
            "SELECT name, location, votes, rate FROM entities WHERE name IN (SELECT n FROM top)",
            "top AS (SELECT name AS n FROM entities GROUP BY name "
            "ORDER BY sum(votes) DESC, name LIMIT 3)",
        ),
        "entity_spot_check": from_entities(
            "SELECT q.name, q.location, q.votes, q.rate, a.votes AS actual_votes, "
            "a.rate AS actual_rate, (a.votes IS NOT DISTINCT FROM q.votes "
            "AND a.rate IS NOT DISTINCT FROM q.rate) AS matches "
            "FROM q LEFT JOIN entities a USING (name, location)",
            "most AS (SELECT name, location, max(votes) AS votes FROM listings GROUP BY ALL)",
            "own AS (SELECT l.name, l.location, l.votes, max(l.rate) AS rate FROM listings l "
            "JOIN most USING (name, location, votes) GROUP BY ALL)",
            "q AS (SELECT * FROM own WHERE rate >= 4.0 AND votes >= 500 ORDER BY "
            f"{rnd('rate * log10(votes + 1)', 2)} DESC, votes DESC, name, location LIMIT 10)",
        ),
        "reconcile_totals": from_entities(
            "SELECT coalesce(l.name, e.name) AS name, coalesce(l.location, e.location) AS location, "
            "coalesce(l.n, 0) AS listing_rows, coalesce(l.v, 0) AS listing_votes, "
            "coalesce(e.n, 0) AS entity_rows, coalesce(e.v, 0) AS entity_votes, "
            "coalesce(l.n, 0) - coalesce(e.n, 0) AS rows_difference, "
            "coalesce(l.v, 0) - coalesce(e.v, 0) AS votes_difference "
            "FROM l FULL JOIN e ON l.name IS NOT DISTINCT FROM e.name AND l.location = e.location",
            "l AS (SELECT name, location, count(*) AS n, CAST(sum(votes) AS BIGINT) AS v "
            "FROM listings GROUP BY name, location)",
            "e AS (SELECT name, location, count(*) AS n, CAST(sum(votes) AS BIGINT) AS v "
            "FROM entities GROUP BY name, location)",
        ),
    }


def _explore() -> dict[str, str]:
    all_rows = "(SELECT count(*) FROM listings)"

    def shares(column: str, top: int) -> str:
        return from_listings(
            f"SELECT {column}, count(*) AS row_count, {pct(N, all_rows)} AS pct_of_total "
            f"FROM listings WHERE {column} IS NOT NULL GROUP BY {column} "
            f"ORDER BY row_count DESC, {column} LIMIT {top}"
        )

    def leaders(column: str) -> str:
        return from_listings(
            "SELECT (SELECT count(*) FROM c) AS unique_values, "
            "first(v ORDER BY n DESC, v) AS top_value, max(n) AS top_rows, "
            f"{pct('max(n)', all_rows)} AS top_pct, {pct('sum(n)', all_rows)} AS top_coverage_pct "
            "FROM (SELECT * FROM c ORDER BY n DESC, v LIMIT 3)",
            f"c AS (SELECT {column} AS v, count(*) AS n FROM listings "
            f"WHERE {column} IS NOT NULL GROUP BY {column})",
        )

    labels = ", ".join(f"('{x}')" for x in LABELS)
    columns = ("online_order", "book_table", "rate", "votes", "approx_cost", "cuisine_count")
    corr = " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
        + (
            f"CASE WHEN min({a}) < max({a}) THEN CAST(1.0 AS DOUBLE) END AS corr FROM listings"
            if a == b
            else rnd(f"CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN corr({a}, {b}) END", 6)
            + " AS corr FROM listings"
        )
        for a in columns
        for b in columns
    )
    by_location = (
        "loc AS (SELECT location, count(*) AS n, "
        f"{mean_rate()} AS r FROM listings WHERE location IS NOT NULL GROUP BY location)"
    )
    top15 = "top15 AS (SELECT * FROM loc ORDER BY n DESC, location LIMIT 15)"
    lead = "(SELECT {0} FROM listings WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY count(*) DESC, {0} LIMIT 1)"
    lead_n = "(SELECT count(*) AS n FROM listings WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY n DESC LIMIT 1)"
    best = "(SELECT {0} FROM loc WHERE n >= 100 AND r IS NOT NULL ORDER BY r DESC, location LIMIT 1)"
    return {
        "feature_price_tiers": from_listings(
            f"SELECT t.price_category, coalesce(x.n, 0) AS row_count, "
            "coalesce(x.p, 0) AS pct_of_total, x.lo AS min_cost, x.hi AS max_cost, x.av AS avg_cost "
            f"FROM {TIERS} LEFT JOIN (SELECT price_category, count(*) AS n, {pct(N, all_rows)} AS p, "
            f"min(approx_cost) AS lo, max(approx_cost) AS hi, {AVG_COST} AS av "
            "FROM listings GROUP BY price_category) x USING (price_category)"
        ),
        "feature_rating_labels": from_listings(
            "SELECT t.rating_label, coalesce(x.n, 0) AS row_count, coalesce(x.p, 0) AS pct_of_total "
            f"FROM (VALUES {labels}) t(rating_label) LEFT JOIN (SELECT rating_label, "
            f"count(*) AS n, {pct(N, all_rows)} AS p FROM listings GROUP BY rating_label) x "
            "USING (rating_label)"
        ),
        "feature_top_cuisines": shares("primary_cuisine", 20),
        "feature_cuisine_counts": from_listings(
            f"SELECT cuisine_count, count(*) AS row_count, {pct(N, all_rows)} AS pct_of_total "
            "FROM listings WHERE cuisine_count IS NOT NULL GROUP BY cuisine_count"
        ),
        "feature_cuisine_summary": from_listings(
            "SELECT count(DISTINCT primary_cuisine) AS unique_cuisines, "
            f"{rnd(mean('cuisine_count'), 2)} AS avg_cuisines, max(cuisine_count) AS max_cuisines "
            "FROM listings"
        ),
        "eda_rating_histogram": from_listings(
            "SELECT CAST(b + 1 AS BIGINT) AS bin, "
            "CAST(lo * 25 + (hi - lo) * b AS DOUBLE) / 250000 AS bin_from, "
            "CAST(lo * 25 + (hi - lo) * (b + 1) AS DOUBLE) / 250000 AS bin_to, "
            "(SELECT count(*) FROM t WHERE (t.u - lo) * 25 >= (hi - lo) * b "
            "AND (b = 24 OR (t.u - lo) * 25 < (hi - lo) * (b + 1))) AS row_count "
            "FROM e CROSS JOIN range(25) g(b)",
            "t AS (SELECT CAST(rate * 10000 AS DECIMAL(18,6)) AS u FROM listings "
            "WHERE rate IS NOT NULL)",
            "e AS (SELECT min(u) AS lo, max(u) AS hi FROM t)",
        ),
        "eda_rating_summary": from_listings(
            f"SELECT {AVG_RATE} AS mean_rating, "
            f"{pct(count_if('rate >= 3.5'), 'count(rate)')} AS pct_rated_good, "
            f"{count_if('rate IS NULL')} AS unrated_count FROM listings"
        ),
        "eda_price_tiers": from_listings(
            "SELECT t.price_category, coalesce(x.n, 0) AS row_count, "
            "coalesce(x.p, 0) AS pct_of_total, x.r AS avg_rating "
            f"FROM {TIERS} LEFT JOIN (SELECT price_category, count(*) AS n, {pct(N, all_rows)} AS p, "
            f"{AVG_RATE} AS r FROM listings GROUP BY price_category) x USING (price_category)"
        ),
        "eda_cost_summary": from_listings(
            f"SELECT {AVG_COST} AS avg_cost, {rnd('quantile_cont(approx_cost, 0.5)', 0)} "
            "AS median_cost, min(approx_cost) AS min_cost, max(approx_cost) AS max_cost "
            "FROM listings"
        ),
        "eda_location_top": shares("location", 15),
        "eda_location_ratings": from_listings(
            f"SELECT location, n AS row_count, {rnd('r', 2)} AS avg_rating FROM top15 "
            "WHERE n >= 100",
            by_location,
            top15,
        ),
        "eda_location_summary": from_listings(
            "SELECT (SELECT count(*) FROM loc) AS total_locations, "
            "first(location ORDER BY n DESC, location) AS top_location, "
            "max(n) AS top_location_rows, "
            "first(location ORDER BY r DESC, location) FILTER (WHERE ok) AS best_location, "
            f"{rnd('max(r) FILTER (WHERE ok)', 2)} AS best_avg_rating, "
            "first(location ORDER BY r, location) FILTER (WHERE ok) AS worst_location, "
            f"{rnd('min(r) FILTER (WHERE ok)', 2)} AS worst_avg_rating FROM "
            "(SELECT *, n >= 100 AND r IS NOT NULL AS ok FROM top15)",
            by_location,
            top15,
        ),
        "eda_cuisine_top": shares("primary_cuisine", 15),
        "eda_cuisine_ratings": from_listings(
            "SELECT primary_cuisine, count(*) AS row_count, "
            f"{AVG_RATE} AS avg_rating FROM listings WHERE primary_cuisine IS NOT NULL "
            "GROUP BY primary_cuisine ORDER BY row_count DESC, primary_cuisine LIMIT 10"
        ),
        "eda_cuisine_summary": leaders("primary_cuisine"),
        "eda_online_by_tier": from_listings(
            "SELECT t.price_category, x.p AS online_order_pct, x.o AS overall_online_pct "
            f"FROM {TIERS} LEFT JOIN (SELECT price_category, {ONLINE_PCT} AS p, "
            f"(SELECT {ONLINE_PCT} FROM listings) AS o FROM listings GROUP BY price_category) x "
            "USING (price_category)"
        ),
        "eda_rating_by_service": from_listings(
            f"SELECT {rnd('a', 2)} AS online_avg_rating, {rnd('b', 2)} AS dinein_avg_rating, "
            f"{rnd('abs(a - b)', 2)} AS difference, "
            "CASE WHEN a - b > 0 THEN 'higher' ELSE 'lower' END AS online_is FROM ("
            f"SELECT {mean_rate('online_order = 1')} AS a, {mean_rate('online_order = 0')} AS b "
            "FROM listings)"
        ),
        "eda_rest_types": shares("rest_type", 10),
        "eda_rest_type_summary": leaders("rest_type"),
        "eda_correlation": from_listings(corr),
        "eda_rate_correlation": from_listings(
            "SELECT col_b AS column_name, corr, CASE WHEN corr > 0 THEN 'positive' "
            "WHEN corr IS NOT NULL THEN 'negative' END AS direction, "
            "CASE WHEN abs(corr) > 0.3 THEN 'strong' WHEN abs(corr) > 0.1 THEN 'moderate' "
            "WHEN corr IS NOT NULL THEN 'weak' END AS strength "
            "FROM m WHERE col_a = 'rate' AND col_b <> 'rate'",
            f"m AS ({corr})",
        ),
        "eda_key_insights": from_listings(
            f"SELECT {AVG_RATE} AS mean_rating, "
            f"{pct(count_if('rate >= 3.5'), 'count(rate)')} AS pct_rated_3_5_plus, "
            f"{pct(count_if('rate < 3.0'), 'count(rate)')} AS pct_rated_poor, "
            f"{count_if('''rating_label = 'Unrated' ''')} AS unrated_count, "
            + ", ".join(
                f"{count_if(f'''price_category = '{t}' ''')} AS {s}_count, "
                f"{pct(count_if(f'''price_category = '{t}' '''), N)} AS {s}_pct"
                for t, s in (
                    ("Budget", "budget"),
                    ("Mid-range", "mid_range"),
                    ("Premium", "premium"),
                )
            )
            + f", {AVG_COST} AS avg_cost, count(DISTINCT location) AS total_locations, "
            f"{lead.format('location')} AS top_location, "
            f"{lead_n.format('location')} AS top_location_rows, "
            f"{best.format('location')} AS best_rated_location, "
            f"{rnd(best.format('r'), 2)} AS best_location_rating, "
            "count(DISTINCT primary_cuisine) AS unique_cuisines, "
            f"{lead.format('primary_cuisine')} AS top_cuisine, "
            f"{lead_n.format('primary_cuisine')} AS top_cuisine_rows, "
            f"{lead.format('rest_type')} AS top_rest_type, "
            f"{lead_n.format('rest_type')} AS top_rest_type_rows, "
            f"{rnd(mean('cuisine_count'), 1)} AS avg_cuisines, {ONLINE_PCT} AS online_order_pct, "
            f"{BOOKING_PCT} AS book_table_pct, "
            f"{rnd(mean_rate('online_order = 1'), 2)} AS online_avg_rating, "
            f"{rnd(mean_rate('online_order = 0'), 2)} AS dinein_avg_rating FROM listings",
            by_location,
        ),
        "rows_in_active_locations": from_listings(
            "SELECT name, location, listed_type, votes, rate FROM listings WHERE location IN "
            "(SELECT location FROM loc WHERE n >= 100)",
            by_location,
        ),
        "rows_of_top_cuisines": from_listings(
            "SELECT name, location, primary_cuisine, rate FROM listings WHERE primary_cuisine IN ("
            "SELECT primary_cuisine FROM listings WHERE primary_cuisine IS NOT NULL "
            "GROUP BY primary_cuisine ORDER BY count(*) DESC, primary_cuisine LIMIT 10)"
        ),
    }


def _cross() -> dict[str, str]:
    def tier(name: str, slug: str) -> str:
        where = f"price_category = '{name}'"
        return (
            f"{count_if(where)} AS {slug}_count, {rnd(mean_rate(where), 2)} AS {slug}_avg_rating"
        )

    tiers = ", ".join(
        tier(n, s)
        for n, s in (("Budget", "budget"), ("Mid-range", "mid_range"), ("Premium", "premium"))
    )
    return {
        "attach_coordinates": from_entities(
            "SELECT name, e.location, rate, approx_cost, latitude, longitude "
            "FROM entities e LEFT JOIN coords c ON e.location = c.location",
            COORDINATES,
        ),
        "location_map": from_entities(
            "SELECT e.location, e.total_restaurants, e.avg_rating, e.avg_cost, latitude, longitude "
            f"FROM (SELECT location, count(*) AS total_restaurants, {AVG_RATE} AS avg_rating, "
            f"{AVG_COST} AS avg_cost FROM entities GROUP BY location) e "
            "LEFT JOIN coords c ON e.location = c.location",
            COORDINATES,
        ),
        "unresolved_locations": from_listings(
            "SELECT DISTINCT location FROM listings WHERE location NOT IN "
            "(SELECT location FROM coords)",
            COORDINATES,
        ),
        "tier_by_location_pivot": from_entities(
            f"SELECT location, {tiers} FROM entities GROUP BY location"
        ),
        "cuisine_by_location_quality": from_entities(
            "SELECT primary_cuisine, location, count(*) AS total_restaurants, "
            f"{AVG_RATE} AS avg_rating, {QUALITY} AS quality_score_pct FROM entities GROUP BY ALL"
        ),
    }


_TYPES = {
    "online_order": "int", "book_table": "int", "rate": "double", "votes": "bigint",
    "approx_cost": "int",
}


def statements() -> dict[str, str]:
    parts = (
        _summaries(),
        _rating(),
        _location(),
        _cuisine(),
        _pricing(),
        _service(),
        _cleaning(),
        _entity(),
        _explore(),
        _cross(),
    )
    found = {name: sql for part in parts for name, sql in part.items()}
    same = {"csv_attach_coordinates": "attach_coordinates", "csv_result": "q9_price_tier"}
    return found | {name: found[of] for name, of in same.items()}
