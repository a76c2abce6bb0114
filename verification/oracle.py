"""The same questions in DuckDB SQL over the raw test tables."""

from __future__ import annotations

import re

MARKET = """
per_order AS (
    SELECT l_orderkey,
           string_agg(DISTINCT p_name, ', ' ORDER BY p_name) AS cuisines,
           (SUM(CAST(ROUND(l_discount * 100) AS INTEGER)) % 51)::DOUBLE / 10::DOUBLE AS rating,
           CAST(SUM(l_quantity) AS BIGINT) AS votes,
           MAX(l_returnflag) AS flag
    FROM lineitem JOIN part ON l_partkey = p_partkey
    GROUP BY l_orderkey
), market AS (
    SELECT o_orderkey AS restaurant_id, c_name AS restaurant_name, n_regionkey AS country_code,
           n_name AS city, c_name AS address, r_name AS locality, n_name || ', ' || r_name AS locality_verbose,
           (o_orderkey * 7919 % 361 - 180)::DOUBLE AS longitude,
           (o_orderkey * 104729 % 181 - 90)::DOUBLE AS latitude,
           cuisines,
           CASE WHEN o_orderkey % 500 = 0 THEN 0::DOUBLE ELSE FLOOR(o_totalprice * 4) / 4 END AS average_cost_for_two,
           c_mktsegment AS currency,
           CASE WHEN flag = 'R' THEN 'Yes' WHEN flag IS NOT NULL THEN 'No' END AS has_table_booking,
           CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'No' END AS has_online_delivery,
           'No' AS is_delivering_now, 'No' AS switch_to_order_menu,
           CASE WHEN TRY_CAST(o_orderpriority[1] AS INTEGER) BETWEEN 1 AND 4
                THEN TRY_CAST(o_orderpriority[1] AS INTEGER) END AS price_range,
           COALESCE(rating, 0::DOUBLE) AS aggregate_rating,
           CASE WHEN COALESCE(rating, 0) > 0 THEN 'Rated' ELSE 'White' END AS rating_color,
           CASE WHEN COALESCE(rating, 0) > 0 THEN 'Rated' ELSE 'Not rated' END AS rating_text,
           COALESCE(votes, 0) AS votes
    FROM orders
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN per_order ON o_orderkey = l_orderkey
)"""


def _features(source: str) -> str:
    """Listings with the eleven features, from any frame of the 21 base columns."""
    return f"""
priced AS (
    SELECT restaurant_id, COUNT(*) OVER g AS n,
           ROW_NUMBER() OVER (PARTITION BY currency ORDER BY average_cost_for_two, restaurant_id) AS r
    FROM {source} WHERE average_cost_for_two > 0 AND currency IS NOT NULL
    WINDOW g AS (PARTITION BY currency)
), listings AS (
    SELECT s.*,
           CAST(COALESCE(len(list_filter(string_split(cuisines, ','), lambda t: trim(t) <> '')), 0) AS INTEGER) AS cuisine_count,
           COALESCE(aggregate_rating > 0, false) AS is_rated,
           COALESCE(aggregate_rating >= 4.0, false) AS is_high_rated,
           COALESCE(aggregate_rating BETWEEN 0.1 AND 2.9, false) AS is_low_rated,
           COALESCE(price_range = 1, false) AS is_affordable,
           COALESCE(price_range = 4, false) AS is_expensive,
           COALESCE(has_online_delivery = 'Yes', false) OR COALESCE(is_delivering_now = 'Yes', false)
               OR COALESCE(switch_to_order_menu = 'Yes', false) AS has_digital_service,
           COALESCE(has_table_booking = 'Yes', false) OR COALESCE(has_online_delivery = 'Yes', false) AS has_booking_or_delivery,
           CASE WHEN aggregate_rating <= 0 THEN 'Not rated' WHEN aggregate_rating <= 2.9 THEN 'Low'
                WHEN aggregate_rating <= 3.4 THEN 'Fair' WHEN aggregate_rating <= 3.9 THEN 'Good'
                WHEN aggregate_rating <= 4.4 THEN 'Very good' WHEN aggregate_rating <= 5 THEN 'Excellent' END AS rating_category,
           CASE WHEN votes <= 0 THEN 'No votes' WHEN votes <= 10 THEN '1-10' WHEN votes <= 100 THEN '11-100'
                WHEN votes <= 500 THEN '101-500' WHEN votes > 500 THEN '501+' END AS vote_category,
           CASE WHEN NOT COALESCE(average_cost_for_two > 0, false) THEN 'Unknown'
                WHEN COALESCE(n, 0) < 2 THEN 'Insufficient currency group'
                ELSE CASE GREATEST((4 * (r - 1) + n - 2) // (n - 1), 1)
                     WHEN 1 THEN 'Low within currency' WHEN 2 THEN 'Lower-middle within currency'
                     WHEN 3 THEN 'Upper-middle within currency' ELSE 'High within currency' END END AS cost_category
    FROM {source} AS s LEFT JOIN priced USING (restaurant_id)
)"""


LABELS = """
labels AS (
    SELECT * FROM (
        SELECT restaurant_id, country_code, city, locality, currency, average_cost_for_two, price_range,
               aggregate_rating, votes, has_table_booking, has_online_delivery,
               trim(unnest(string_split(cuisines, ','))) AS cuisine
        FROM listings
    ) WHERE cuisine <> ''
)"""

RAW = """
raw AS (
    SELECT CAST(restaurant_id AS VARCHAR) AS restaurant_id, restaurant_name,
           CAST(country_code AS VARCHAR) AS country_code,
           CASE WHEN restaurant_id % 11 = 0 THEN chr(9) || ' ' || city || ' ' || chr(12288) ELSE city END AS city,
           address, CASE WHEN restaurant_id % 13 = 0 THEN '   ' ELSE locality END AS locality, locality_verbose,
           CASE WHEN restaurant_id % 29 = 0 THEN '0' WHEN restaurant_id % 31 = 0 THEN '181'
                ELSE CAST(longitude AS VARCHAR) END AS longitude,
           CASE WHEN restaurant_id % 29 = 0 THEN '0' WHEN restaurant_id % 43 = 0 THEN '91'
                ELSE CAST(latitude AS VARCHAR) END AS latitude,
           cuisines,
           CASE WHEN restaurant_id % 23 = 0 THEN '-1' ELSE CAST(average_cost_for_two AS VARCHAR) END AS average_cost_for_two,
           currency,
           CASE WHEN restaurant_id % 7 = 0 THEN 'maybe' WHEN restaurant_id % 5 = 0 THEN ' YES '
                ELSE has_table_booking END AS has_table_booking,
           lower(has_online_delivery) AS has_online_delivery, is_delivering_now, switch_to_order_menu,
           CASE WHEN restaurant_id % 17 = 0 THEN '0' WHEN restaurant_id % 37 = 0 THEN 'two'
                ELSE CAST(price_range AS VARCHAR) END AS price_range,
           CASE WHEN restaurant_id % 101 = 0 THEN '5.5' WHEN restaurant_id % 103 = 0 THEN '-'
                ELSE CAST(aggregate_rating AS VARCHAR) END AS aggregate_rating,
           rating_color, rating_text,
           CASE WHEN restaurant_id % 19 = 0 THEN '-1' ELSE CAST(votes AS VARCHAR) END AS votes
    FROM market
)"""

_TEXT = [
    "restaurant_id", "restaurant_name", "country_code", "city", "address", "locality", "locality_verbose",
    "longitude", "latitude", "cuisines", "average_cost_for_two", "currency", "has_table_booking",
    "has_online_delivery", "is_delivering_now", "switch_to_order_menu", "price_range", "aggregate_rating",
    "rating_color", "rating_text", "votes",
]
_NUMBERS = ["country_code", "longitude", "latitude", "average_cost_for_two", "price_range", "aggregate_rating", "votes"]
_FLAGS = ["has_table_booking", "has_online_delivery", "is_delivering_now", "switch_to_order_menu"]


def _strip(c: str) -> str:
    return f"NULLIF(regexp_replace({c}, '^[\\s\\x{{3000}}]+|[\\s\\x{{3000}}]+$', '', 'g'), '')"


def _flag(c: str) -> str:
    return f"CASE lower({_strip(c)}) WHEN 'yes' THEN 'Yes' WHEN 'no' THEN 'No' END"


TRIMMED = "trimmed AS (SELECT " + ", ".join(f"{_strip(c)} AS {c}" for c in _TEXT) + " FROM raw)"
NUMERIC = "nums AS (SELECT * REPLACE (" + ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in _NUMBERS) + ") FROM raw)"
CLEANED = f"""
cleaned AS (
    SELECT CAST(restaurant_id AS BIGINT) AS restaurant_id, restaurant_name,
           TRY_CAST(country_code AS INTEGER) AS country_code, city, address, locality, locality_verbose,
           CASE WHEN NOT (lon = 0 AND lat = 0) AND lon BETWEEN -180 AND 180 THEN lon END AS longitude,
           CASE WHEN NOT (lon = 0 AND lat = 0) AND lat BETWEEN -90 AND 90 THEN lat END AS latitude,
           cuisines,
           CASE WHEN cost >= 0 THEN cost END AS average_cost_for_two, currency,
           {", ".join(f"{_flag(c)} AS {c}" for c in _FLAGS)},
           CAST(CASE WHEN price IN (1, 2, 3, 4) THEN price END AS INTEGER) AS price_range,
           CASE WHEN rating BETWEEN 0 AND 5 THEN rating END AS aggregate_rating,
           rating_color, rating_text,
           CAST(CASE WHEN vote >= 0 THEN vote END AS BIGINT) AS votes
    FROM (SELECT *, TRY_CAST(longitude AS DOUBLE) AS lon, TRY_CAST(latitude AS DOUBLE) AS lat,
                 TRY_CAST(average_cost_for_two AS DOUBLE) AS cost, TRY_CAST(price_range AS DOUBLE) AS price,
                 TRY_CAST(aggregate_rating AS DOUBLE) AS rating, TRY_CAST(votes AS DOUBLE) AS vote
          FROM trimmed)
)"""

PLACES = """
places AS (
    SELECT vec_id AS restaurant_id, label AS country_code, 'X' AS city,
           embedding[1]::DOUBLE AS latitude, embedding[2]::DOUBLE AS longitude
    FROM embeddings
), near AS (
    SELECT p.restaurant_id AS a, q.restaurant_id AS b
    FROM places AS p JOIN places AS q ON p.country_code = q.country_code
    WHERE 2 * asin(sqrt(least(1, pow(sin(radians(p.latitude - q.latitude) / 2), 2)
          + cos(radians(p.latitude)) * cos(radians(q.latitude)) * pow(sin(radians(p.longitude - q.longitude) / 2), 2))))
          <= 8000 / 6371008.8
), core AS (SELECT a AS id FROM near GROUP BY a HAVING COUNT(*) >= 5)"""

CLUSTERS = PLACES + """
, reach(id, root) AS (
    SELECT id, id FROM core
    UNION
    SELECT near.b, reach.root FROM reach JOIN near ON near.a = reach.id JOIN core ON core.id = near.b
), component AS (SELECT id, MIN(root) AS root FROM reach GROUP BY id
), member AS (
    SELECT id, root FROM component
    UNION ALL
    SELECT near.a, MIN(component.root) FROM near JOIN component ON component.id = near.b
    WHERE near.a NOT IN (SELECT id FROM core) GROUP BY near.a
), numbered AS (
    SELECT root, DENSE_RANK() OVER (PARTITION BY country_code ORDER BY root) - 1 AS cluster_label
    FROM (SELECT DISTINCT root FROM member) JOIN places ON restaurant_id = root
), clustered AS (
    SELECT p.*, COALESCE(cluster_label, -1) AS cluster_label,
           CASE WHEN cluster_label IS NULL THEN 0 ELSE COUNT(*) OVER (PARTITION BY p.country_code, cluster_label) END AS cluster_size
    FROM places AS p LEFT JOIN member ON id = restaurant_id LEFT JOIN numbered USING (root)
)"""

L = [MARKET, _features("market")]
LL = [*L, LABELS]
R = [MARKET, RAW]


def _sql(parts: list[str], body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(parts) + "\n" + body


def mean(x: str, where: str | None = None) -> str:
    return f"AVG({x})" + (f" FILTER (WHERE {where})" if where else "")


# Digits to which means of ratings, and what is computed from them, are compared: sums of tenths
# differ in the last bits with their order. Costs are quarters, so their means need no rounding.
MEAN_DIGITS = 9
RATING_MEANS = ["average_rating", "market_rating", "rating_gap", "opportunity_score", "mean_yes", "mean_no"]


def _compared(sql: str) -> str:
    means = [c for c in RATING_MEANS if re.search(rf"\bAS {c}\b", sql)]
    return f"SELECT * REPLACE ({', '.join(f'ROUND({c}, {MEAN_DIGITS}) AS {c}' for c in means)}) FROM ({sql})" if means else sql


RATED_MEAN = mean("aggregate_rating", "is_rated")
COST_MEAN = mean("average_cost_for_two")


def quantile(x: str, p: float, where: str | None = None) -> str:
    return f"quantile_cont({x}, {p})" + (f" FILTER (WHERE {where})" if where else "")


def _union_counts(table: str, cells: list[tuple[str, str]], key: str, value: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS {key}, {v} AS {value} FROM {table}" for k, v in cells)


_TYPES = {
    "restaurant_id": "bigint", "country_code": "int", "longitude": "double", "latitude": "double",
    "average_cost_for_two": "double", "price_range": "int", "aggregate_rating": "double", "votes": "bigint",
    "cuisine_count": "int",
} | {c: "boolean" for c in (
    "is_rated", "is_high_rated", "is_low_rated", "is_affordable", "is_expensive", "has_digital_service",
    "has_booking_or_delivery",
)}
_LISTING = _TEXT + [
    "cuisine_count", "is_rated", "is_high_rated", "is_low_rated", "is_affordable", "is_expensive",
    "has_digital_service", "has_booking_or_delivery", "rating_category", "vote_category", "cost_category",
]
_SERVICES = {
    "has_online_delivery": "Online delivery", "has_table_booking": "Table booking",
    "is_delivering_now": "Delivering now", "switch_to_order_menu": "Order menu",
}
SERVICE_ROWS = "service_rows AS (" + " UNION ALL ".join(
    f"SELECT restaurant_id, votes, aggregate_rating, is_rated, '{n}' AS service, {c} AS availability FROM listings WHERE {c} IS NOT NULL"
    for c, n in _SERVICES.items()
) + ")"

SLICED = """
sliced AS (
    SELECT * FROM listings
    WHERE country_code IN (0, 1, 2) AND currency IN ('BUILDING', 'MACHINERY') AND price_range IN (1, 2, 3)
      AND aggregate_rating BETWEEN 0.5 AND 4.9 AND has_table_booking = 'Yes' AND has_online_delivery = 'No'
      AND restaurant_id IN (SELECT restaurant_id FROM labels WHERE cuisine IN ('small ring', 'red widget'))
)"""

CELL_SLICED = """
sliced AS (
    SELECT * FROM listings
    WHERE country_code IN (0, 1, 2) AND currency IN ('BUILDING', 'MACHINERY') AND price_range IN (1, 2, 3)
      AND aggregate_rating BETWEEN 0.5 AND 4.9 AND has_table_booking = 'Yes' AND has_online_delivery = 'No'
)"""

LABEL_CURRENCY_JOIN = _sql(LL, f"""
SELECT c.cuisine, r.currency, COUNT(DISTINCT r.restaurant_id) AS restaurant_count,
       {mean("r.aggregate_rating", "r.is_rated")} AS average_rating,
       {mean("r.average_cost_for_two", "r.average_cost_for_two > 0")} AS mean_local_cost
FROM labels AS c JOIN listings AS r USING (restaurant_id) GROUP BY c.cuisine, r.currency
HAVING COUNT(DISTINCT r.restaurant_id) >= 178""")

OPTION_LISTS = _sql(LL, """
SELECT DISTINCT 'country_code' AS filter_name, CAST(country_code AS VARCHAR) AS option_value FROM listings WHERE country_code IS NOT NULL
UNION ALL SELECT DISTINCT 'currency', currency FROM listings WHERE country_code IN (0, 1) AND currency IS NOT NULL
UNION ALL SELECT DISTINCT 'city', city FROM listings WHERE country_code IN (0, 1) AND currency = 'BUILDING' AND city IS NOT NULL
UNION ALL SELECT DISTINCT 'cuisine', cuisine FROM labels WHERE restaurant_id IN (
    SELECT restaurant_id FROM listings WHERE country_code IN (0, 1) AND currency = 'BUILDING')""")

CITY_RANK = f"""
SELECT *, CAST(DENSE_RANK() OVER (PARTITION BY country_code ORDER BY restaurants DESC) AS INTEGER) AS city_rank
FROM (SELECT country_code, city, COUNT(*) AS restaurants, {RATED_MEAN} AS average_rating, CAST(SUM(votes) AS BIGINT) AS total_votes
      FROM {{rows}} GROUP BY country_code, city)"""


def _opportunities(listings: str, labels: str, minimum: int) -> str:
    return f"""
SELECT *, average_rating - market_rating AS rating_gap,
       (RANK() OVER (PARTITION BY currency ORDER BY restaurant_count)
        + (COUNT(*) OVER (PARTITION BY currency, restaurant_count) - 1) / 2.0::DOUBLE)
        / COUNT(*) OVER (PARTITION BY currency) AS presence_percentile,
       rating_gap * (1 - presence_percentile) AS opportunity_score
FROM (SELECT currency, cuisine, COUNT(DISTINCT restaurant_id) AS restaurant_count,
             {mean("aggregate_rating")} AS average_rating, COALESCE(CAST(SUM(votes) AS BIGINT), 0) AS total_votes
      FROM {labels} WHERE aggregate_rating > 0 AND currency IS NOT NULL GROUP BY currency, cuisine
      HAVING COUNT(DISTINCT restaurant_id) >= {minimum})
LEFT JOIN (SELECT currency, {mean("aggregate_rating")} AS market_rating FROM {listings} WHERE is_rated GROUP BY currency)
USING (currency)"""


def _fence(q: str) -> str:
    return f"{q}3 + 1.5 * ({q}3 - {q}1)"


RANKED_PAIRS = """
pairs AS (
    SELECT 'All currencies' AS currency, 'votes' AS variable_x, 'aggregate_rating' AS variable_y,
           votes::DOUBLE AS x, aggregate_rating AS y FROM listings WHERE is_rated
    UNION ALL
    SELECT currency, 'average_cost_for_two', 'aggregate_rating', average_cost_for_two, aggregate_rating
    FROM listings WHERE is_rated AND average_cost_for_two > 0
    UNION ALL
    SELECT currency, 'average_cost_for_two', 'votes', average_cost_for_two, votes::DOUBLE
    FROM listings WHERE average_cost_for_two > 0
), ranked AS (
    SELECT currency, variable_x, variable_y,
           RANK() OVER (PARTITION BY currency, variable_x, variable_y ORDER BY x)
             + (COUNT(*) OVER (PARTITION BY currency, variable_x, variable_y, x) - 1) / 2.0::DOUBLE AS rx,
           RANK() OVER (PARTITION BY currency, variable_x, variable_y ORDER BY y)
             + (COUNT(*) OVER (PARTITION BY currency, variable_x, variable_y, y) - 1) / 2.0::DOUBLE AS ry
    FROM pairs
)"""

WELCH = " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, COUNT(*) FILTER (WHERE {c} = 'Yes') AS n_yes, COUNT(*) FILTER (WHERE {c} = 'No') AS n_no,
       {mean("aggregate_rating", f"{c} = 'Yes'")} AS mean_yes, {mean("aggregate_rating", f"{c} = 'No'")} AS mean_no,
       var_samp(aggregate_rating) FILTER (WHERE {c} = 'Yes') / n_yes AS e1,
       var_samp(aggregate_rating) FILTER (WHERE {c} = 'No') / n_no AS e2
       FROM listings WHERE is_rated"""
    for c in ("has_online_delivery", "has_table_booking")
)



def _beyond(x: str, density: str) -> str:
    """Integral of a density of ``x`` from the given point on, by midpoints of u in x + u / (1 - u)."""
    return f"""(SELECT SUM({density.replace("$x", f"({x} + u / (1 - u))")} / ((1 - u) * (1 - u))) / 20000
            FROM (SELECT (i + 0.5::DOUBLE) / 20000 AS u FROM range(20000) AS g(i)))"""


def _t_tail(t: str, df: str) -> str:
    front = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi())"
    return f"2 * {front} * {_beyond(f'abs({t})', f'pow(1 + $x * $x / {df}, -({df} + 1) / 2)')}"


def _chi2_tail(x: str, df: str) -> str:
    return f"{_beyond(x, f'exp(({df} / 2 - 1) * ln($x) - $x / 2)')} / exp({df} / 2 * ln(2::DOUBLE) + lgamma({df} / 2))"


SPEARMAN = f"""
SELECT currency, variable_x, variable_y, test, n, rho AS statistic, {_t_tail("(rho * sqrt(f / ((1 + rho) * (1 - rho))))", "f")} AS p_value
FROM (SELECT currency, variable_x, variable_y, 'Spearman rank correlation' AS test, COUNT(*) AS n, corr(rx, ry) AS rho, (COUNT(*) - 2)::DOUBLE AS f
      FROM ranked GROUP BY currency, variable_x, variable_y)"""
WELCH_TEST = f"""
SELECT variable, 'Welch independent t-test' AS test, n_yes, n_no, mean_yes, mean_no, t AS statistic, {_t_tail("t", "f")} AS p_value
FROM (SELECT *, (mean_yes - mean_no) / sqrt(e1 + e2) AS t,
             (e1 + e2) * (e1 + e2) / (e1 * e1 / (n_yes - 1) + e2 * e2 / (n_no - 1)) AS f FROM ({WELCH}))"""
KRUSKAL_TABLES = ["""k AS (
    SELECT price_range, RANK() OVER (ORDER BY aggregate_rating) + (COUNT(*) OVER (PARTITION BY aggregate_rating) - 1) / 2.0::DOUBLE AS r
    FROM listings WHERE is_rated AND price_range IS NOT NULL
), s AS (SELECT SUM(r) * SUM(r) / COUNT(*) AS part, COUNT(*) AS m FROM k GROUP BY price_range
), t AS (SELECT SUM(c * c * c - c) AS ties FROM (SELECT COUNT(*)::DOUBLE AS c FROM k GROUP BY r)
), n AS (SELECT SUM(m)::DOUBLE AS n, (COUNT(*) - 1)::DOUBLE AS freedom, SUM(part) AS part FROM s)"""]
KRUSKAL_TEST = f"""
SELECT 'price_range' AS variable, 'Kruskal-Wallis test' AS test, CAST(n AS BIGINT) AS n_yes, h AS statistic, {_chi2_tail("h", "freedom")} AS p_value
FROM (SELECT n, freedom, (12 / (n * (n + 1)) * part - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM n CROSS JOIN t)"""

_DESCRIBED = ["longitude", "latitude", "average_cost_for_two", "aggregate_rating", "votes"]
_PROFILED = ["country_code", "city", "currency", *_FLAGS, "price_range", "rating_text"]
_PICK = """SELECT restaurant_id, restaurant_name, city, currency, average_cost_for_two, price_range, aggregate_rating, votes
FROM listings WHERE is_rated AND price_range = {band} AND aggregate_rating >= 4.0"""


def _flag_rating(c: str) -> str:
    return f"""SELECT {c}, COUNT(*) FILTER (WHERE is_rated) AS rated_restaurants, {RATED_MEAN} AS average_rating,
       AVG(votes) AS average_votes FROM listings GROUP BY {c}"""


def _coverage(order: str) -> str:
    return f"""SELECT city, COUNT(DISTINCT restaurant_id) AS restaurants, COUNT(*) FILTER (WHERE is_rated) AS rated_restaurants,
       {mean("aggregate_rating")} AS average_rating, CAST(SUM(votes) AS BIGINT) AS votes_proxy
FROM listings GROUP BY city ORDER BY restaurants, votes_proxy {order}, city LIMIT 20"""


CITY_COSTS = f"""SELECT city, currency, {COST_MEAN} AS mean_cost, COUNT(DISTINCT restaurant_id) AS restaurants
FROM listings WHERE average_cost_for_two > 0 GROUP BY city, currency"""
LOCATION = f"""SELECT city, currency, COUNT(DISTINCT restaurant_id) AS restaurants, {RATED_MEAN} AS average_rating,
       {quantile("average_cost_for_two", 0.5)} AS median_cost
FROM listings GROUP BY city, currency"""


def oracle_sql() -> dict[str, str]:
    return {name: sql if name in ("write_report_tables", "write_quality_report", "write_chart_tables") else _compared(sql) for name, sql in _answers().items()}


def _report_line(source: str, section: str, subject: str, measure: str, **held: str) -> str:
    kinds = {"amount": "BIGINT", "number": "DOUBLE", "content": "VARCHAR"}
    values = ", ".join(f"CAST({held.get(c, 'NULL')} AS {t}) AS {c}" for c, t in kinds.items())
    return f"SELECT '{section}' AS section, CAST({subject} AS VARCHAR) AS subject, '{measure}' AS measure, {values} FROM {source}"


def _quality_report() -> str:
    bad = """COALESCE(longitude NOT BETWEEN -180 AND 180, true) OR COALESCE(latitude NOT BETWEEN -90 AND 90, true)
             OR COALESCE(longitude = 0 AND latitude = 0, false)"""
    counters = {
        "rows": "true", "invalid_coordinate_rows": bad, "zero_cost_rows": "average_cost_for_two = 0", "negative_cost": "average_cost_for_two < 0",
        "unrated_rows": "aggregate_rating = 0", "invalid_ratings": "COALESCE(aggregate_rating NOT BETWEEN 0 AND 5, true)",
        "invalid_price_ranges": "COALESCE(price_range NOT IN (1, 2, 3, 4), true)", "negative_votes": "votes < 0",
        "rating_text_mismatches_for_zero_ratings": "COALESCE(aggregate_rating = 0, false) <> COALESCE(rating_text = 'Not rated', false)",
    }
    lines = [_report_line("nums", "counter", f"'{c}'", "count", amount=f"COUNT(*) FILTER (WHERE {w})") for c, w in counters.items()]
    lines += [
        _report_line("(SELECT 1)", "counter", "'columns'", "count", amount="21"),
        _report_line("raw", "counter", "'exact_duplicate_rows'", "count", amount="COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM raw))"),
        _report_line("raw", "counter", "'unique_restaurant_ids'", "count", amount="COUNT(DISTINCT restaurant_id)"),
        _report_line("raw", "counter", "'duplicate_restaurant_ids'", "count", amount="COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT restaurant_id FROM raw))"),
    ]
    for k, c in enumerate(_TEXT, 1):
        lines += [
            _report_line("(SELECT 1)", "column", f"'{c}'", "position", amount=str(k)), _report_line("(SELECT 1)", "column", f"'{c}'", "dtype", content="'string'"),
            _report_line("raw", "column", f"'{c}'", "missing", amount=f"COUNT(*) FILTER (WHERE {c} IS NULL)"),
        ]
    lines.append(_report_line("raw GROUP BY currency", "currency", "currency", "rows", amount="COUNT(*)"))
    pairs = "(SELECT DISTINCT CAST(country_code AS INTEGER) AS code, currency FROM nums WHERE country_code IS NOT NULL AND currency IS NOT NULL)"
    lines.append(_report_line(pairs, "country_currency", "code", "value", content="currency"))
    lines += [_report_line(f"(SELECT DISTINCT {c} AS v FROM raw WHERE {c} IS NOT NULL)", "flag", f"'{c}'", "value", content="v") for c in _FLAGS]
    costs = "(SELECT currency, quantile_cont(c, 0.25) AS q1, quantile_cont(c, 0.75) AS q3 FROM (SELECT currency, CASE WHEN average_cost_for_two > 0 THEN average_cost_for_two END AS c FROM nums) GROUP BY currency)"
    rated = "(SELECT quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.75) AS q3 FROM (SELECT aggregate_rating AS r FROM nums WHERE aggregate_rating > 0))"
    votes = "(SELECT quantile_cont(votes, 0.25) AS q1, quantile_cont(votes, 0.75) AS q3 FROM nums WHERE votes IS NOT NULL)"
    low, high = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"
    judged = f"{costs} AS f LEFT JOIN (SELECT * FROM nums WHERE average_cost_for_two > 0) AS n ON n.currency IS NOT DISTINCT FROM f.currency GROUP BY f.currency"
    for section, subject, fences, rows, flagged in (
        ("cost_fence", "currency", costs, (judged, "f.currency", "COUNT(average_cost_for_two)"), (judged, f"COUNT(*) FILTER (WHERE average_cost_for_two > {high})")),
        ("numeric_fence", "'aggregate_rating_rated_only'", rated, ("nums", "'aggregate_rating_rated_only'", "COUNT(*) FILTER (WHERE aggregate_rating > 0)"),
         (f"nums, {rated}", f"COUNT(*) FILTER (WHERE aggregate_rating > 0 AND (aggregate_rating < {low} OR aggregate_rating > {high}))")),
        ("numeric_fence", "'votes'", votes, ("nums", "'votes'", "COUNT(votes)"), (f"nums, {votes}", f"COUNT(*) FILTER (WHERE votes < {low} OR votes > {high})")),
    ):
        lines += [
            _report_line(fences, section, subject, "iqr_lower_fence", number=low), _report_line(fences, section, subject, "iqr_upper_fence", number=high),
            _report_line(rows[0], section, rows[1], "rows", amount=rows[2]), _report_line(flagged[0], section, rows[1], "flagged_rows", amount=flagged[1]),
        ]
    return "\nUNION ALL ".join(lines)


def _report_tables() -> str:
    opportunities = _opportunities("listings", "labels", 5)
    low_rated = """SELECT restaurant_id, restaurant_name, city, aggregate_rating, votes
FROM listings CROSS JOIN (SELECT quantile_cont(votes, 0.75) AS hi, quantile_cont(aggregate_rating, 0.25) AS lo FROM listings WHERE is_rated)
WHERE is_rated AND votes >= hi AND aggregate_rating <= lo"""
    tables = {
        "correlation_tests": (SPEARMAN, ["currency", "variable_x", "variable_y"], ["n", "statistic", "p_value"], ["test"]),
        "group_comparison_tests": (f"({WELCH_TEST}) UNION ALL BY NAME ({KRUSKAL_TEST})", ["variable"], ["n_yes", "n_no", "mean_yes", "mean_no", "statistic", "p_value"], ["test"]),
        "cuisine_opportunities": (opportunities, ["currency", "cuisine"], ["restaurant_count", "average_rating", "total_votes", "market_rating", "rating_gap", "presence_percentile", "opportunity_score"], []),
        "high_votes_low_ratings": (low_rated, ["restaurant_id"], ["aggregate_rating", "votes"], ["restaurant_name", "city"]),
    }
    cells = []
    for name, (body, keys, numbers, texts) in tables.items():
        line = f"concat_ws('|', {', '.join(keys)})"
        for c in (*numbers, *texts):
            number, content = (f"ROUND({c}::DOUBLE, {6 if c in ('statistic', 'p_value') else 9})", "NULL::VARCHAR") if c in numbers else ("NULL::DOUBLE", c)
            cells.append(f"SELECT '{name}' AS table_name, {line} AS line, '{c}' AS column_name, {number} AS number, {content} AS content FROM ({body}) WHERE {c} IS NOT NULL")
    return "\nUNION ALL ".join(cells)


def _charts() -> str:
    def line(chart: str, source: str, **held: str) -> str:
        kinds = {"label": "VARCHAR", "series": "VARCHAR", "x": "DOUBLE", "y": "DOUBLE", "z": "DOUBLE", "restaurants": "BIGINT"}
        digits = 5 if chart == "cost_by_city_currency" else 9
        shown = [f"ROUND(CAST({held.get(c, 'NULL')} AS {t}), {digits}) AS {c}" if t == "DOUBLE" else f"CAST({held.get(c, 'NULL')} AS {t}) AS {c}" for c, t in kinds.items()]
        return f"SELECT '{chart}' AS chart, {', '.join(shown)} FROM {source}"

    def bars(chart: str, column: str, names: list[str]) -> str:
        values = ", ".join(f"('{n}')" for n in names)
        return line(chart, f"(VALUES {values}) AS v(name) LEFT JOIN listings ON CAST({column} AS VARCHAR) = name GROUP BY name", label="name", restaurants=f"COUNT({column})")

    cities = "(SELECT city, COUNT(*) AS n FROM listings WHERE city IS NOT NULL GROUP BY city ORDER BY n DESC, city LIMIT {})"
    best = "(SELECT {0}, AVG(aggregate_rating) AS y, COUNT(DISTINCT restaurant_id) AS n FROM {1} WHERE {2} AND {0} IS NOT NULL GROUP BY {0} HAVING n >= {3} ORDER BY y DESC, {0} LIMIT 15)"
    costs = "SELECT city, currency, AVG(average_cost_for_two) AS y, COUNT(DISTINCT restaurant_id) AS n FROM listings WHERE average_cost_for_two > 0 AND city IS NOT NULL AND currency IS NOT NULL GROUP BY ALL HAVING n >= 10"
    share = """(SELECT price_range, aggregate_rating, is_rated, (RANK() OVER (PARTITION BY currency ORDER BY average_cost_for_two)
        + (COUNT(*) OVER (PARTITION BY currency, average_cost_for_two) - 1) / 2.0::DOUBLE) / COUNT(*) OVER (PARTITION BY currency) AS x
        FROM listings WHERE average_cost_for_two > 0 AND currency IS NOT NULL)"""
    boxed = "(SELECT CASE has_online_delivery WHEN 'Yes' THEN 'Online delivery' ELSE 'No online delivery' END AS s, aggregate_rating AS r FROM listings WHERE is_rated AND has_online_delivery IN ('Yes', 'No'))"
    box = f"(SELECT s AS t, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.5) AS median, quantile_cont(r, 0.75) AS q3 FROM {boxed} GROUP BY s)"
    inside = "r BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
    leading = "(SELECT cuisine FROM labels GROUP BY cuisine ORDER BY COUNT(*) DESC, cuisine LIMIT 12)"
    lines = [
        line("restaurants_by_city", cities.format(15), label="city", restaurants="n"),
        line("restaurants_by_country", "listings WHERE country_code IS NOT NULL GROUP BY country_code", label="country_code", restaurants="COUNT(*)"),
        bars("price_range_distribution", "price_range", ["1", "2", "3", "4"]),
        bars("rating_distribution", "rating_category", ["Not rated", "Low", "Fair", "Good", "Very good", "Excellent"]),
        bars("online_delivery_adoption", "has_online_delivery", ["Yes", "No"]), bars("table_booking_adoption", "has_table_booking", ["Yes", "No"]),
        line("average_rating_by_city", best.format("city", "listings", "is_rated", 607), label="city", y="y", restaurants="n"),
        line("average_rating_by_cuisine", best.format("cuisine", "labels", "aggregate_rating > 0", 50), label="cuisine", y="y", restaurants="n"),
        line("top_cuisines", "(SELECT cuisine, COUNT(DISTINCT restaurant_id) AS n FROM labels GROUP BY cuisine ORDER BY n DESC, cuisine LIMIT 15)", label="cuisine", restaurants="n"),
        line("cost_by_city_currency", f"({costs}) WHERE currency IN (SELECT currency FROM ({costs}) GROUP BY currency ORDER BY SUM(n) DESC, currency LIMIT 6)", label="city", series="currency", y="y", restaurants="n"),
        line("votes_vs_rating", "listings WHERE is_rated GROUP BY votes, aggregate_rating", x="votes", y="aggregate_rating", restaurants="COUNT(*)"),
        line("geographic_distribution", "listings WHERE longitude IS NOT NULL AND latitude IS NOT NULL GROUP BY longitude, latitude, aggregate_rating", x="longitude", y="latitude", z="aggregate_rating", restaurants="COUNT(*)"),
        line("relative_cost_vs_rating", f"{share} WHERE is_rated GROUP BY price_range, x, aggregate_rating", series="price_range", x="x", y="aggregate_rating", restaurants="COUNT(*)"),
        line("cuisine_by_city_heatmap", f"labels WHERE cuisine IN {leading} AND city IN (SELECT city FROM {cities.format(12)}) GROUP BY city, cuisine", label="city", series="cuisine", restaurants="COUNT(DISTINCT restaurant_id)"),
    ]
    for c in ("q1", "median", "q3"):
        lines.append(line("rating_by_digital_services", box, label="t", series=f"'{c}'", y=c))
    joined = f"{boxed} JOIN {box} ON s = t GROUP BY s"
    for c, value in (("whisker_low", "MIN"), ("whisker_high", "MAX")):
        lines.append(line("rating_by_digital_services", joined, label="s", series=f"'{c}'", y=f"{value}(r) FILTER (WHERE {inside})"))
    lines.append(line("rating_by_digital_services", joined, label="s", series="'rated'", restaurants="COUNT(*)"))
    lines.append(line("rating_by_digital_services", joined, label="s", series="'outliers'", restaurants=f"COUNT(*) FILTER (WHERE NOT ({inside}))"))
    return "\nUNION ALL ".join(lines)


def _answers() -> dict[str, str]:
    every = ", ".join(_LISTING)
    base = ", ".join(_TEXT)
    cleaned = [*R, TRIMMED, CLEANED]
    clean_features = [*cleaned, _features("cleaned")]
    number_row = "(SELECT COUNT(*) FROM nums)"
    return {
        # sources and sinks
        "load_raw": _sql(R, f"SELECT {base} FROM raw"),
        "load_raw_shared": _sql(R, f"SELECT {base} FROM raw"),
        "load_processed": _sql(L, f"SELECT {every} FROM listings"),
        "write_clean": _sql(clean_features, f"SELECT {every} FROM listings"),
        "write_labels": _sql([*clean_features, LABELS], "SELECT * FROM labels"),
        "write_quality_report": _sql([*R, NUMERIC], _quality_report()),
        "write_report_tables": _sql([*LL, RANKED_PAIRS, *KRUSKAL_TABLES], _report_tables()),
        "write_chart_tables": _sql(LL, _charts()),
        "register_views": _sql(LL, """
SELECT r.currency, COUNT(DISTINCT r.restaurant_id) AS restaurants, COUNT(*) AS cuisine_rows
FROM labels JOIN listings AS r USING (restaurant_id) GROUP BY r.currency"""),
        "ensure_materialised": _sql([*clean_features, LABELS], """
SELECT 'listings' AS table_name, COUNT(*) AS row_count FROM listings UNION ALL SELECT 'labels', COUNT(*) FROM labels"""),
        # cleaning
        "snake_case_columns": _sql(R, f"SELECT {base} FROM raw"),
        "trim_blank_to_null": _sql([*R, TRIMMED], "SELECT * FROM trimmed"),
        "normalise_flags": _sql(R, "SELECT restaurant_id, " + ", ".join(f"{_flag(c)} AS {c}" for c in _FLAGS) + " FROM raw"),
        "coerce_numeric": _sql([*R, NUMERIC], "SELECT restaurant_id, " + ", ".join(_NUMBERS) + " FROM nums"),
        "null_out_of_domain": _sql([*R, NUMERIC], """
SELECT restaurant_id, CASE WHEN aggregate_rating BETWEEN 0 AND 5 THEN aggregate_rating END AS aggregate_rating,
       CASE WHEN price_range IN (1, 2, 3, 4) THEN price_range END AS price_range,
       CASE WHEN votes >= 0 THEN votes END AS votes,
       CASE WHEN average_cost_for_two >= 0 THEN average_cost_for_two END AS average_cost_for_two
FROM nums"""),
        "null_bad_coordinates": _sql([*R, NUMERIC], """
SELECT restaurant_id,
       CASE WHEN NOT (longitude = 0 AND latitude = 0) AND longitude BETWEEN -180 AND 180 THEN longitude END AS longitude,
       CASE WHEN NOT (longitude = 0 AND latitude = 0) AND latitude BETWEEN -90 AND 90 THEN latitude END AS latitude
FROM nums"""),
        "clean": _sql(clean_features, f"SELECT {every} FROM listings"),
        "clean_and_write": _sql([*clean_features, LABELS], """
SELECT COUNT(*) AS listing_rows, CAST(SUM(cuisine_count) AS BIGINT) AS label_tokens, COUNT(aggregate_rating) AS ratings,
       (SELECT COUNT(*) FROM labels) AS label_rows, (SELECT COUNT(*) FROM raw) AS reported_rows
FROM listings"""),
        # features
        "label_count": _sql(L, "SELECT restaurant_id, cuisine_count FROM listings"),
        "rating_flags": _sql(L, "SELECT restaurant_id, is_rated, is_high_rated, is_low_rated FROM listings"),
        "price_flags": _sql(L, "SELECT restaurant_id, is_affordable, is_expensive FROM listings"),
        "any_flag": _sql(L, "SELECT restaurant_id, has_digital_service, has_booking_or_delivery FROM listings"),
        "rating_category": _sql(L, "SELECT restaurant_id, rating_category FROM listings"),
        "vote_category": _sql(L, "SELECT restaurant_id, vote_category FROM listings"),
        "cost_category": _sql(L, "SELECT restaurant_id, cost_category FROM listings"),
        "explode_labels": _sql(LL, "SELECT * FROM labels"),
        "cost_percentile": _sql(L, """
SELECT restaurant_id, restaurant_name, currency, average_cost_for_two, price_range, aggregate_rating, cost_percentile
FROM (SELECT *, (RANK() OVER (PARTITION BY currency ORDER BY average_cost_for_two)
                 + (COUNT(*) OVER (PARTITION BY currency, average_cost_for_two) - 1) / 2.0::DOUBLE)
                / COUNT(*) OVER (PARTITION BY currency) AS cost_percentile
      FROM listings WHERE average_cost_for_two > 0)
WHERE is_rated"""),
        "relabel_flag": _sql(L, """
SELECT restaurant_id, aggregate_rating,
       CASE has_online_delivery WHEN 'Yes' THEN 'Online delivery' WHEN 'No' THEN 'No online delivery' END AS digital_services
FROM listings WHERE is_rated"""),
        # quality
        "profile_shape": _sql(L, "SELECT (SELECT COUNT(*) FROM listings) AS row_count, 32 AS column_count, * FROM (VALUES "
            + ", ".join(f"({i}, '{c}', '{_TYPES.get(c, 'string')}')" for i, c in enumerate(_LISTING, 1))
            + ") AS v(position, column_name, dtype)"),
        "missing_by_column": _sql(L, _union_counts("listings", [(c, f"COUNT(*) - COUNT({c})") for c in _LISTING], "column_name", "missing")),
        "exact_duplicate_rows": """
SELECT (SELECT COUNT(*) FROM documents) - COUNT(*) AS exact_duplicate_rows
FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)""",
        "id_uniqueness": """
SELECT COUNT(*) AS restaurant_rows, COUNT(DISTINCT l_orderkey) AS unique_restaurant_ids,
       COUNT(*) - COUNT(DISTINCT l_orderkey) AS duplicate_id_rows FROM lineitem""",
        "duplicate_id_groups": """
SELECT COUNT(*) AS exact_duplicate_id_rows FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING COUNT(*) > 1)""",
        "invalid_coordinates": _sql([*R, NUMERIC], """
SELECT COUNT(*) FILTER (WHERE longitude IS NULL OR latitude IS NULL OR longitude NOT BETWEEN -180 AND 180
                        OR latitude NOT BETWEEN -90 AND 90 OR (longitude = 0 AND latitude = 0)) AS invalid_coordinate_rows,
       COUNT(*) FILTER (WHERE longitude IS NULL OR latitude IS NULL) AS missing_coordinates FROM nums"""),
        "zero_coordinate_pairs": _sql([*R, NUMERIC], "SELECT COUNT(*) AS zero_coordinate_pairs FROM nums WHERE longitude = 0 AND latitude = 0"),
        **{name: _sql(parts, f"""
SELECT COUNT(*) FILTER (WHERE cuisines IS NULL OR trim(cuisines) = '') AS missing_cuisine,
       COUNT(*) FILTER (WHERE average_cost_for_two = 0) AS zero_cost_rows,
       COUNT(*) FILTER (WHERE average_cost_for_two < 0) AS negative_cost,
       COUNT(*) FILTER (WHERE aggregate_rating = 0) AS unrated_rows,
       COUNT(*) FILTER (WHERE aggregate_rating IS NULL OR aggregate_rating NOT BETWEEN 0 AND 5) AS invalid_ratings,
       COUNT(*) FILTER (WHERE price_range IS NULL OR price_range NOT IN (1, 2, 3, 4)) AS invalid_price_ranges,
       COUNT(*) FILTER (WHERE aggregate_rating NOT BETWEEN 0 AND 5) AS out_of_range_rating,
       COUNT(*) FILTER (WHERE price_range NOT BETWEEN 1 AND 4) AS out_of_range_price,
       COUNT(*) FILTER (WHERE votes < 0) AS negative_votes
FROM {rows}""") for name, parts, rows in (
            ("domain_violations", [*R, NUMERIC], "nums"), ("domain_violations_clean", L, "listings"))},
        "iqr_fences_by_group": f"""
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
           FROM events WHERE value > 0 GROUP BY event_type)
SELECT event_type AS currency, COUNT(*) FILTER (WHERE value > 0) AS row_count, ANY_VALUE(q1 - 1.5 * (q3 - q1)) AS iqr_lower_fence,
       ANY_VALUE({_fence("q")}) AS iqr_upper_fence, COUNT(*) FILTER (WHERE value > {_fence("q")}) AS flagged_rows
FROM events JOIN q USING (event_type) GROUP BY event_type""",
        "iqr_report": _sql([*L, """v AS (
    SELECT 'aggregate_rating_rated_only' AS measure, aggregate_rating AS value FROM listings WHERE aggregate_rating > 0
    UNION ALL SELECT 'votes', votes::DOUBLE FROM listings WHERE votes IS NOT NULL
), q AS (SELECT measure, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY measure)"""], f"""
SELECT measure, COUNT(*) AS row_count, ANY_VALUE(q1 - 1.5 * (q3 - q1)) AS iqr_lower_fence, ANY_VALUE({_fence("q")}) AS iqr_upper_fence,
       COUNT(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > {_fence("q")}) AS flagged_rows
FROM v JOIN q USING (measure) GROUP BY measure"""),
        "code_currency_map": _sql(L, """
SELECT country_code, string_agg(DISTINCT currency, ', ' ORDER BY currency) AS currencies
FROM listings WHERE country_code IS NOT NULL GROUP BY country_code"""),
        "zero_rating_text_mismatch": _sql([*R, NUMERIC], """
SELECT COUNT(*) FILTER (WHERE COALESCE(aggregate_rating = 0, false) <> COALESCE(rating_text = 'Not rated', false)) AS rating_text_mismatches
FROM nums"""),
        "flag_domains": _sql(L, _union_counts("listings", [(c, f"string_agg(DISTINCT {c}, ', ' ORDER BY {c})") for c in _FLAGS], "column_name", "flag_values")),
        "value_counts": _sql(L, "SELECT currency, COUNT(*) AS row_count FROM listings GROUP BY currency"),
        "flag_value_counts": _sql(L, """
SELECT flag_name, flag_value, COUNT(*) AS row_count
FROM listings CROSS JOIN LATERAL (VALUES ('has_table_booking', has_table_booking), ('has_online_delivery', has_online_delivery),
     ('is_delivering_now', is_delivering_now), ('switch_to_order_menu', switch_to_order_menu)) AS f(flag_name, flag_value)
GROUP BY flag_name, flag_value"""),
        "cost_outliers": f"""
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
           FROM events WHERE value > 0 GROUP BY event_type)
SELECT event_id AS restaurant_id, event_type AS currency, value AS average_cost_for_two, q1, q3, {_fence("q")} AS upper_iqr_fence
FROM events JOIN q USING (event_type) WHERE value > {_fence("q")}""",
        "column_profile": _sql(L, " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, '{_TYPES.get(c, 'string')}' AS dtype, COUNT(*) - COUNT({c}) AS missing, "
            f"COUNT(DISTINCT {c}) + CAST(COUNT(*) > COUNT({c}) AS INTEGER) AS unique_values FROM listings" for c in _LISTING)),
        "top_values": _sql(L, "SELECT * FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY row_count DESC, value NULLS LAST) AS INTEGER) AS position FROM ("
            + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS row_count FROM listings GROUP BY {c}" for c in _PROFILED)
            + ")) WHERE position <= 15"),
        "describe_percentiles": _sql(L, " UNION ALL ".join(
            f"SELECT '{c}' AS measure, COUNT({c}) AS value_count, ROUND(AVG({c}::DOUBLE), 6) AS mean_value, ROUND(stddev_samp({c}::DOUBLE), 6) AS std_value, "
            f"MIN({c})::DOUBLE AS min_value, MAX({c})::DOUBLE AS max_value, "
            + ", ".join(f"ROUND(quantile_cont({c}::DOUBLE, {p}), 6) AS p{round(p * 100)}" for p in (0.01, 0.25, 0.5, 0.75, 0.95, 0.99))
            + " FROM listings" for c in _DESCRIBED)),
        "post_clean_counters": _sql(L, """
SELECT COUNT(*) AS restaurant_rows, COUNT(DISTINCT restaurant_id) AS unique_ids, COUNT(*) FILTER (WHERE cuisines IS NULL) AS missing_cuisines,
       COUNT(*) FILTER (WHERE longitude IS NULL OR latitude IS NULL) AS missing_coordinates,
       COUNT(*) FILTER (WHERE average_cost_for_two = 0) AS zero_costs, COUNT(*) FILTER (WHERE aggregate_rating = 0) AS unrated_records,
       CAST(SUM(cuisine_count) AS BIGINT) AS cuisine_rows FROM listings"""),
        "constraint_checks": _sql(LL, """
SELECT 'listing_key_unique' AS constraint_name, COUNT(*) AS violations
FROM (SELECT restaurant_id FROM listings GROUP BY restaurant_id HAVING COUNT(*) > 1 OR restaurant_id IS NULL)
UNION ALL SELECT 'label_has_listing', COUNT(*) FROM labels WHERE restaurant_id NOT IN (SELECT restaurant_id FROM listings)
UNION ALL SELECT 'label_not_null', COUNT(*) FROM labels WHERE cuisine IS NULL"""),
        "quality_contract": _sql(cleaned, _union_counts("cleaned", [
            ("ids_unique", "COUNT(DISTINCT restaurant_id) = COUNT(*)"),
            ("rating_valid", "bool_and(COALESCE(aggregate_rating BETWEEN 0 AND 5, true))"),
            ("price_valid", "bool_and(COALESCE(price_range IN (1, 2, 3, 4), true))"),
            ("longitude_valid", "bool_and(COALESCE(longitude BETWEEN -180 AND 180, true))"),
            ("latitude_valid", "bool_and(COALESCE(latitude BETWEEN -90 AND 90, true))"),
            *[(f"{c}_valid", f"bool_and(COALESCE({c} IN ('Yes', 'No'), true))") for c in _FLAGS],
            ("rows_preserved", "COUNT(*) = (SELECT COUNT(*) FROM raw)"),
        ], "check_name", "passed")),
        # market
        "market_summary": _sql(LL, f"""
SELECT COUNT(DISTINCT restaurant_id) AS restaurants, COUNT(DISTINCT country_code) AS countries, COUNT(DISTINCT city) AS cities,
       CAST(SUM(votes) AS BIGINT) AS total_votes, {RATED_MEAN} AS average_rating, COUNT(*) FILTER (WHERE is_rated) AS rated_restaurants,
       (SELECT COUNT(DISTINCT cuisine) FROM labels) AS cuisines FROM listings"""),
        "scope_totals": _sql(L, """
SELECT COUNT(*) AS restaurants, COUNT(DISTINCT country_code) AS country_codes, COUNT(DISTINCT city) AS cities, CAST(SUM(votes) AS BIGINT) AS total_votes
FROM listings"""),
        "country_counts": _sql(L, "SELECT country_code, COUNT(*) AS restaurants FROM listings GROUP BY country_code"),
        "city_counts_topk": _sql(L, """
SELECT city, COUNT(*) AS restaurants, COUNT(*) FILTER (WHERE is_rated) AS rated_restaurants
FROM listings GROUP BY city ORDER BY restaurants DESC, city LIMIT 15"""),
        "price_band_share": _sql(L, """
SELECT price_range, COUNT(*) AS restaurants, CAST(ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 2) AS DOUBLE) AS share_percent
FROM listings GROUP BY price_range"""),
        "price_band_counts": _sql(L, """
SELECT band AS price_range, COUNT(price_range) AS restaurants
FROM (VALUES (1), (2), (3), (4)) AS v(band) LEFT JOIN listings ON price_range = band GROUP BY band"""),
        "rating_category_counts": _sql(L, "SELECT rating_category, COUNT(*) AS restaurants FROM listings GROUP BY rating_category"),
        "city_rank": _sql(L, CITY_RANK.format(rows="listings")),
        "city_screen": _sql(L, f"""
SELECT country_code, city, COUNT(*) AS restaurant_count, COUNT(*) FILTER (WHERE is_rated) AS rated_restaurants,
       {RATED_MEAN} AS average_rating, CAST(SUM(votes) AS BIGINT) AS votes_proxy_not_revenue
FROM listings GROUP BY country_code, city HAVING COUNT(*) >= 607"""),
        "city_coverage": _sql(L, _coverage("DESC")),
        "city_coverage_fewest_votes": _sql(L, _coverage("ASC")),
        "city_rating_topk": _sql(L, f"""
SELECT city, {mean("aggregate_rating")} AS average_rating, COUNT(DISTINCT restaurant_id) AS restaurants
FROM listings WHERE is_rated GROUP BY city HAVING COUNT(DISTINCT restaurant_id) >= 590
ORDER BY average_rating DESC, city LIMIT 15"""),
        "city_currency_location": _sql(L, LOCATION),
        "city_currency_topk": _sql(L, LOCATION + " ORDER BY restaurants DESC, city, currency LIMIT 15"),
        # ratings
        "overall_rating": _sql(L, f"SELECT {RATED_MEAN} AS average_rating, COUNT(*) FILTER (WHERE NOT is_rated) AS unrated_restaurants FROM listings"),
        "top_rated": _sql(L, """
SELECT restaurant_id, restaurant_name, city, aggregate_rating, votes, cuisines, price_range FROM listings WHERE is_rated
ORDER BY aggregate_rating DESC, votes DESC NULLS LAST, restaurant_id LIMIT 25"""),
        "top_voted": _sql(L, """
SELECT restaurant_id, restaurant_name, city, aggregate_rating, votes FROM listings
ORDER BY votes DESC NULLS LAST, restaurant_id LIMIT 25"""),
        "rating_by_price": _sql(L, f"""
SELECT price_range, COUNT(*) FILTER (WHERE is_rated) AS rated_restaurants, {RATED_MEAN} AS average_rating,
       {quantile("aggregate_rating", 0.5, "is_rated")} AS median_rating FROM listings GROUP BY price_range"""),
        "rating_by_price_mean": _sql(L, f"""
SELECT price_range, {mean("aggregate_rating")} AS average_rating FROM listings WHERE is_rated AND price_range IS NOT NULL GROUP BY price_range"""),
        "rating_by_delivery": _sql(L, _flag_rating("has_online_delivery")),
        "rating_by_booking": _sql(L, _flag_rating("has_table_booking")),
        "high_votes_low_ratings": _sql(L, """
SELECT restaurant_id, restaurant_name, city, aggregate_rating, votes
FROM listings CROSS JOIN (SELECT quantile_cont(votes, 0.75) AS hi, quantile_cont(aggregate_rating, 0.25) AS lo FROM listings WHERE is_rated)
WHERE is_rated AND votes >= hi AND aggregate_rating <= lo"""),
        "high_rating_low_votes": _sql(L, """
SELECT restaurant_id, restaurant_name, city, cuisines, aggregate_rating, votes FROM listings
WHERE is_rated AND aggregate_rating >= 2.5 AND votes <= (SELECT quantile_cont(votes, 0.25) FROM listings)
ORDER BY aggregate_rating DESC, restaurant_id LIMIT 15"""),
        "votes_rating_points": _sql(L, "SELECT restaurant_id, restaurant_name, votes, aggregate_rating, price_range FROM listings WHERE is_rated"),
        "rating_box_stats": _sql([*L, """b AS (
    SELECT has_online_delivery, quantile_cont(aggregate_rating, 0.25) AS q1, quantile_cont(aggregate_rating, 0.5) AS median,
           quantile_cont(aggregate_rating, 0.75) AS q3
    FROM listings WHERE is_rated AND has_online_delivery IS NOT NULL GROUP BY has_online_delivery
), t AS (SELECT *, aggregate_rating BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
         FROM listings JOIN b USING (has_online_delivery) WHERE is_rated)"""], """
SELECT has_online_delivery, ROUND(ANY_VALUE(q1), 9) AS q1, ROUND(ANY_VALUE(median), 9) AS median, ROUND(ANY_VALUE(q3), 9) AS q3,
       MIN(aggregate_rating) FILTER (WHERE inside) AS whisker_low, MAX(aggregate_rating) FILTER (WHERE inside) AS whisker_high,
       COUNT(*) AS rated_restaurants, COUNT(*) FILTER (WHERE NOT inside) AS outliers
FROM t GROUP BY has_online_delivery"""),
        "rating_histogram": _sql(L, """
SELECT bin, COUNT(*) AS restaurants, ROUND(bin * 0.25::DOUBLE, 9) AS bin_low, ROUND((bin + 1) * 0.25::DOUBLE, 9) AS bin_high
FROM (SELECT LEAST(CAST(floor(aggregate_rating * 20 / 5) AS INTEGER), 19) AS bin FROM listings WHERE aggregate_rating IS NOT NULL)
GROUP BY bin"""),
        # pricing
        "city_currency_cost": _sql(L, f"""
SELECT city, currency, COUNT(*) AS restaurants, {COST_MEAN} AS mean_cost_for_two, {quantile("average_cost_for_two", 0.5)} AS median_cost_for_two
FROM listings WHERE average_cost_for_two > 0 GROUP BY city, currency HAVING COUNT(*) >= 117"""),
        "city_cost_panels": _sql([*L, f"kept AS ({CITY_COSTS} HAVING COUNT(DISTINCT restaurant_id) >= 117)"], """
SELECT * FROM kept WHERE currency IN (
    SELECT currency FROM kept GROUP BY currency ORDER BY SUM(restaurants) DESC, currency LIMIT 3)"""),
        "city_cost_topk": _sql(L, CITY_COSTS + " ORDER BY restaurants DESC, city, currency LIMIT 20"),
        "currency_price_band": _sql(L, f"""
SELECT currency, price_range, COUNT(*) AS restaurants, {COST_MEAN} AS mean_cost_for_two, {RATED_MEAN} AS average_rating
FROM listings GROUP BY currency, price_range"""),
        "value_picks": _sql(L, _PICK.format(band=1)),
        "premium_picks": _sql(L, _PICK.format(band=4)),
        "cost_rating_observations": _sql(L, """
SELECT currency, average_cost_for_two, aggregate_rating, votes FROM listings WHERE average_cost_for_two > 0 AND is_rated"""),
        "label_currency_cost": _sql(LL, f"""
SELECT cuisine, currency, {COST_MEAN} AS mean_cost, COUNT(DISTINCT restaurant_id) AS restaurants
FROM labels WHERE average_cost_for_two > 0 GROUP BY cuisine, currency HAVING COUNT(DISTINCT restaurant_id) >= 178
ORDER BY restaurants DESC, cuisine, currency LIMIT 15"""),
        **{name: _sql(L, f"""
SELECT CASE WHEN n = 0 THEN 'N/A' WHEN n > 1 THEN 'Multiple currencies' WHEN m IS NULL THEN 'N/A' ELSE 'Single currency' END AS status,
       CASE WHEN n = 1 AND m IS NOT NULL THEN c END AS currency, CASE WHEN n = 1 THEN m END AS mean_cost
FROM (SELECT COUNT(DISTINCT currency) AS n, MIN(currency) AS c, {mean("average_cost_for_two", "average_cost_for_two > 0")} AS m
      FROM listings WHERE {where})""") for name, where in (
            ("single_currency_mean", "true"),
            ("single_currency_mean_slice", "currency = 'BUILDING' AND price_range IN (1, 2, 3, 4) AND aggregate_rating BETWEEN 0 AND 4.9"))},
        # labels
        "top_labels": _sql(LL, """
SELECT cuisine, COUNT(DISTINCT restaurant_id) AS restaurant_count, CAST(SUM(votes) AS BIGINT) AS associated_votes
FROM labels GROUP BY cuisine ORDER BY restaurant_count DESC, cuisine LIMIT 30"""),
        "label_rating": _sql(LL, f"""
SELECT cuisine, COUNT(DISTINCT restaurant_id) AS restaurants, {mean("aggregate_rating", "aggregate_rating > 0")} AS average_rating,
       CAST(SUM(votes) AS BIGINT) AS associated_votes
FROM labels GROUP BY cuisine HAVING COUNT(DISTINCT restaurant_id) >= 900"""),
        "label_rating_topk": _sql(LL, f"""
SELECT cuisine, {mean("aggregate_rating")} AS average_rating, COUNT(DISTINCT restaurant_id) AS restaurants
FROM labels WHERE aggregate_rating > 0 GROUP BY cuisine HAVING COUNT(DISTINCT restaurant_id) >= 880
ORDER BY average_rating DESC, cuisine LIMIT 15"""),
        "top3_labels_per_city": _sql(LL, """
SELECT city, cuisine, restaurants, associated_votes FROM (
    SELECT city, cuisine, COUNT(DISTINCT restaurant_id) AS restaurants, CAST(SUM(votes) AS BIGINT) AS associated_votes,
           RANK() OVER (PARTITION BY city ORDER BY COUNT(DISTINCT restaurant_id) DESC) AS k
    FROM labels GROUP BY city, cuisine) WHERE k <= 3"""),
        "label_currency_join": LABEL_CURRENCY_JOIN,
        "city_label_pivot": _sql([*LL, """c AS (SELECT city FROM listings GROUP BY city ORDER BY COUNT(*) DESC, city LIMIT 12
), k AS (SELECT cuisine FROM labels GROUP BY cuisine ORDER BY COUNT(*) DESC, cuisine LIMIT 12)"""], """
SELECT city, cuisine, COUNT(DISTINCT restaurant_id) AS restaurants
FROM c CROSS JOIN k LEFT JOIN labels USING (city, cuisine) GROUP BY city, cuisine"""),
        "distinct_labels": _sql(LL, "SELECT DISTINCT cuisine FROM labels"),
        # services
        "flag_adoption": _sql(L, " UNION ALL ".join(
            f"SELECT '{c}' AS flag_name, '{v}' AS availability, COUNT(*) FILTER (WHERE {c} = '{v}') AS restaurants FROM listings"
            for c in ("has_online_delivery", "has_table_booking") for v in ("Yes", "No"))),
        "adoption_share": _sql([*L, SERVICE_ROWS], """
SELECT service, availability, COUNT(*) AS restaurants,
       COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY service)::DOUBLE * 100 AS share_percent
FROM service_rows GROUP BY service, availability"""),
        "service_comparison": _sql([*L, SERVICE_ROWS], f"""
SELECT service, availability, COUNT(DISTINCT restaurant_id) AS restaurants, AVG(votes) AS average_votes, {RATED_MEAN} AS average_rating
FROM service_rows GROUP BY service, availability"""),
        "price_service_crosstab": _sql(L, """
SELECT price_range, has_online_delivery, COUNT(DISTINCT restaurant_id) AS restaurants
FROM listings WHERE price_range IS NOT NULL AND has_online_delivery IS NOT NULL GROUP BY price_range, has_online_delivery"""),
        # statistics
        "spearman": _sql([*L, RANKED_PAIRS], f"SELECT * REPLACE (ROUND(statistic, 9) AS statistic, ROUND(p_value, 6) AS p_value) FROM ({SPEARMAN})"),
        "welch_t": _sql(L, f"SELECT * REPLACE (ROUND(statistic, 6) AS statistic, ROUND(p_value, 6) AS p_value) FROM ({WELCH_TEST})"),
        "kruskal": _sql([*L, *KRUSKAL_TABLES], f"SELECT * REPLACE (ROUND(statistic, 6) AS statistic, ROUND(p_value, 6) AS p_value) FROM ({KRUSKAL_TEST})"),
        "statistical_report": _sql([*L, RANKED_PAIRS, *KRUSKAL_TABLES], f"""
SELECT * REPLACE (ROUND(statistic, 6) AS statistic, ROUND(p_value, 6) AS p_value)
FROM (({SPEARMAN}) UNION ALL BY NAME ({WELCH_TEST}) UNION ALL BY NAME ({KRUSKAL_TEST}))"""),
        # scoring and geography
        "label_opportunities": _sql(LL, _opportunities("listings", "labels", 178)),
        "label_opportunities_sql": _sql(LL, f"""
SELECT *, rating_gap * (1 - presence_percentile) AS opportunity_score
FROM (SELECT *, average_rating - market_rating AS rating_gap,
             percent_rank() OVER (PARTITION BY currency ORDER BY restaurant_count) AS presence_percentile
      FROM (SELECT currency, cuisine, COUNT(DISTINCT restaurant_id) FILTER (WHERE aggregate_rating > 0) AS restaurant_count,
                   {mean("aggregate_rating", "aggregate_rating > 0")} AS average_rating, CAST(SUM(votes) AS BIGINT) AS total_votes
            FROM labels GROUP BY currency, cuisine
            HAVING COUNT(DISTINCT restaurant_id) FILTER (WHERE aggregate_rating > 0) >= 178)
      JOIN (SELECT currency, {mean("aggregate_rating")} AS market_rating FROM listings WHERE is_rated GROUP BY currency) USING (currency))"""),
        "neighbours_within": _sql([PLACES], """
SELECT restaurant_id, country_code, city, restaurant_id IN (SELECT id FROM core) AS is_core FROM places"""),
        "spatial_clusters": _sql([CLUSTERS], "SELECT * FROM clustered", recursive=True),
        "cluster_summary": _sql([CLUSTERS], """
SELECT country_code, city, cluster_label, COUNT(DISTINCT restaurant_id) AS restaurants,
       ROUND(AVG(latitude), 9) AS latitude, ROUND(AVG(longitude), 9) AS longitude
FROM clustered WHERE cluster_label >= 0 GROUP BY country_code, city, cluster_label
ORDER BY restaurants DESC, country_code, city, cluster_label LIMIT 15""", recursive=True),
        "valid_points": _sql(cleaned, """
SELECT restaurant_id, restaurant_name, city, locality, currency, longitude, latitude, aggregate_rating
FROM cleaned WHERE longitude IS NOT NULL AND latitude IS NOT NULL"""),
        # slicing
        "slice_listings": _sql([*LL, SLICED], f"SELECT {every} FROM sliced"),
        "slice_listings_default": _sql(L, f"""
SELECT {every} FROM listings WHERE price_range IN (1, 2, 3, 4) AND aggregate_rating BETWEEN 0.0 AND 4.9"""),
        "filter_by_label": _sql(LL, """
SELECT restaurant_id, cuisines FROM listings WHERE restaurant_id IN (SELECT restaurant_id FROM labels WHERE cuisine = 'small ring')"""),
        "slice_labels": _sql([*LL, SLICED], "SELECT * FROM labels WHERE restaurant_id IN (SELECT restaurant_id FROM sliced)"),
        "option_lists": OPTION_LISTS,
        "sliced_city_rank": _sql([*LL, SLICED], CITY_RANK.format(rows="sliced")),
        "sliced_label_opportunities": _sql([*LL, """s AS (
    SELECT * FROM listings WHERE currency IN ('BUILDING', 'MACHINERY') AND has_online_delivery = 'No'
       AND price_range IN (1, 2, 3, 4) AND aggregate_rating BETWEEN 0 AND 4.9
), sl AS (SELECT * FROM labels WHERE restaurant_id IN (SELECT restaurant_id FROM s))"""], _opportunities("s", "sl", 30)),
        # roll-ups and bucketed tables
        "rollup_summary": _sql([*LL, CELL_SLICED], f"""
SELECT COUNT(DISTINCT restaurant_id) AS restaurants, COUNT(DISTINCT country_code) AS countries, COUNT(DISTINCT city) AS cities,
       CAST(COALESCE(SUM(votes), 0) AS BIGINT) AS total_votes, {RATED_MEAN} AS average_rating, COUNT(*) FILTER (WHERE is_rated) AS rated_restaurants,
       (SELECT COUNT(DISTINCT cuisine) FROM labels WHERE restaurant_id IN (SELECT restaurant_id FROM sliced)) AS cuisines FROM sliced"""),
        "rollup_counts": _sql(L, f"""
SELECT country_code, city, COUNT(*) AS listing_rows, COUNT(DISTINCT restaurant_id // 64) AS restaurants,
       COUNT(*) FILTER (WHERE is_rated) AS rated_restaurants, CAST(SUM(votes) AS BIGINT) AS total_votes, {RATED_MEAN} AS average_rating
FROM listings WHERE currency IN ('BUILDING', 'MACHINERY') AND has_online_delivery = 'No' AND price_range IN (1, 2, 3, 4)
    AND aggregate_rating BETWEEN 0 AND 4.9 GROUP BY country_code, city"""),
        "rollup_option_lists": OPTION_LISTS,
        "bucketed_label_currency_join": LABEL_CURRENCY_JOIN,
        "bucketed_slice_labels": _sql([*LL, SLICED], "SELECT * FROM labels WHERE restaurant_id IN (SELECT restaurant_id FROM sliced)"),
    }
