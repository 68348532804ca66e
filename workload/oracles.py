"""The expected result of each query as DuckDB SQL, formulated independently of the Spark side."""

from __future__ import annotations

# Fixed values, written out here so that a wrong one in the library is seen: rounding, words, categories, features.
TIE = 3.3e-9
LOOSE = 1e-4
PART_WORDS = ["ring", "widget", "bolt", "gear", "gizmo", "small", "red", "blue", "hot"]
TOP_CATEGORIES = [
    "restaurants", "food", "nightlife", "bars", "shopping", "beauty & spas", "health & medical", "home services",
    "local services", "automotive", "active life", "event planning & services", "coffee & tea", "sandwiches",
    "american (traditional)", "american (new)", "pizza", "breakfast & brunch", "mexican", "italian", "chinese",
    "japanese", "seafood", "fast food",
]
STACKED_FEATURES = """
user_mean item_mean pair_mean pair_mean_sq user_profile_mean item_profile_mean user_mean_c5 user_mean_c15
item_mean_c10 item_mean_c35 user_conf item_conf log_user_cnt log_item_cnt log_user_reviews log_item_reviews mean_gap
abs_mean_gap user_bias item_bias user_var item_var user_range item_range user_cold item_cold log_fans log_useful
log_compliments log_friends elite_count fans_per_review useful_per_review account_years item_stars latitude
longitude is_open price category_count log_checkins log_photos log_item_tips log_user_tips item_tip_likes
user_tip_likes mean_product bias_product gap_x_user_var gap_x_item_var var_product log_cnt_product user_mean_x_price
item_var_x_log_cnt user_mean_x_conf item_mean_x_conf gap_x_conf pair_mean_x_item_conf cf_pred n_neighbours cf_conf
cf_minus_user cf_minus_item cf_minus_pair cf_x_cf_conf cf_x_item_conf cf_x_user_conf cf_abs_minus_user
""".split()
RICH_FEATURES = """
user_mean item_mean pair_mean pair_mean_sq user_profile_mean item_profile_mean user_mean_c5 user_mean_c15
item_mean_c10 item_mean_c35 user_conf item_conf log_user_cnt log_item_cnt log_user_reviews log_item_reviews mean_gap
abs_mean_gap user_bias item_bias user_var item_var user_range item_range user_cold item_cold log_fans log_useful
log_compliments log_friends elite_count fans_per_review useful_per_review account_years item_stars latitude
longitude is_open price category_count log_checkins log_photos log_item_tips log_user_tips item_tip_likes
user_tip_likes mean_product bias_product gap_x_user_var gap_x_item_var var_product log_cnt_product user_mean_x_price
item_var_x_log_cnt user_mean_x_conf item_mean_x_conf gap_x_conf pair_mean_x_item_conf cf_pred n_neighbours cf_conf
cf_minus_user cf_minus_item cf_minus_pair cf_x_cf_conf cf_x_item_conf cf_x_user_conf cf_abs_minus_user alcohol kids
outdoor noise wifi tv attire weekly_hours weekend_open evening_ratio weekend_ratio user_low_rate user_high_rate
item_low_rate item_high_rate low_rate_product high_rate_product user_one_rate user_five_rate item_one_rate
item_five_rate one_rate_product five_rate_product user_one_x_item_low user_five_x_item_high
""".split()
RICH_FEATURES += [f"cat_{i:02d}" for i in range(1, 25)]

ORDER = "(l_orderkey, l_linenumber, l_partkey)"
SEQ_LIST = "seq"
STATS = ["avg", "cnt", "var", "min", "max", "low_rate", "high_rate", "one_rate", "five_rate"]

RATINGS = """
ratings AS (
  SELECT o_custkey AS user_id, l_suppkey AS item_id, CAST(1 + floor((l_quantity - 1) / 10) AS DOUBLE) AS stars,
         l_orderkey, l_linenumber, l_partkey, l_orderkey * 16777216 + l_linenumber * 2097152 + l_partkey AS seq,
         CAST((l_orderkey * 31 + l_partkey * 7 + l_linenumber) % 5 AS INTEGER) AS fold,
         o_orderdate >= TIMESTAMP '2000-06-01' OR c_nationkey = 19 OR s_nationkey = 15 AS is_test
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
),
train AS (SELECT * EXCLUDE (is_test) FROM ratings WHERE NOT is_test),
test AS (SELECT * EXCLUDE (is_test, fold) FROM ratings WHERE is_test)
"""

USERS = """
users AS (
  SELECT *, CASE WHEN review_count > 0 THEN fans / review_count ELSE 0.0 END AS fans_per_review,
         CASE WHEN review_count > 0 THEN useful / review_count ELSE 0.0 END AS useful_per_review
  FROM (
    SELECT c_custkey AS user_id, CAST(1 + c_nationkey * 0.125 AS DOUBLE) AS average_stars,
      CAST(floor(abs(c_acctbal) / 50) AS BIGINT) AS review_count,
      CASE WHEN c_mktsegment = 'MACHINERY' THEN 0 ELSE CAST(floor(abs(c_acctbal) / 600) AS BIGINT) END AS fans,
      CAST(floor(abs(c_acctbal) / 100) AS BIGINT) AS useful, CAST(0 AS BIGINT) AS funny, CAST(0 AS BIGINT) AS cool,
      CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 2000 ELSE 2004 + c_nationkey // 2 END AS BIGINT) AS since_year,
      CAST(c_nationkey * 2 + CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 0 ELSE c_nationkey END AS BIGINT) AS compliments,
      CAST(CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'HOUSEHOLD' THEN 4 ELSE 0 END AS BIGINT) AS friend_count,
      CAST(CASE WHEN c_nationkey > 12 THEN 2 ELSE 0 END AS BIGINT) AS elite_count
    FROM customer WHERE c_acctbal >= 0
  )
)
"""

CATEGORY_TEXT = """CASE s_nationkey % 6 WHEN 0 THEN 'Restaurants, Food' WHEN 1 THEN 'Bars,, Nightlife ' WHEN 2 THEN ''
      WHEN 3 THEN 'Pizza' WHEN 5 THEN 'Coffee & Tea,Fast Food' END"""

_CATEGORY_FLAGS = ",\n".join(
    f"      CAST(coalesce(list_contains(list_transform(string_split(cats, ','), lambda x: lower(trim(x))), '{name}'), false) AS INTEGER) AS cat_{i:02d}"
    for i, name in enumerate(TOP_CATEGORIES, start=1)
)

# An overnight span gains a day; '22:0-2:30' is 4.5 h.
ITEMS = f"""
items AS (
  SELECT item_id, item_stars, item_review_count, latitude, longitude, is_open, price,
      CASE WHEN cats IS NULL OR cats = '' THEN 0 ELSE length(cats) - length(replace(cats, ',', '')) + 1 END AS category_count,
      alcohol, kids, outdoor, noise, wifi, tv, attire, weekly_hours, weekend_open,
{_CATEGORY_FLAGS}
  FROM (
    SELECT s_suppkey AS item_id, CAST(1 + s_nationkey * 0.125 AS DOUBLE) AS item_stars,
      CAST(floor(s_acctbal / 40) AS BIGINT) AS item_review_count,
      s_acctbal / 128 AS latitude, CAST(-s_nationkey * 1.5 AS DOUBLE) AS longitude,
      CAST(CASE WHEN s_nationkey % 3 = 0 THEN 1 ELSE s_nationkey % 2 END AS BIGINT) AS is_open,
      CAST(CASE WHEN s_nationkey = 3 THEN 0 ELSE floor(s_acctbal / 2500) END AS BIGINT) AS price,
      CASE WHEN s_nationkey <> 3 AND s_nationkey % 4 IN (1, 2) THEN 1 ELSE 0 END AS alcohol,
      CASE WHEN s_nationkey <> 3 AND s_nationkey % 3 = 0 THEN 1 ELSE 0 END AS kids,
      CASE WHEN s_nationkey <> 3 AND s_nationkey % 2 = 1 THEN 1 ELSE 0 END AS outdoor,
      CASE WHEN s_nationkey <> 3 AND s_nationkey % 6 < 4 THEN s_nationkey % 6 ELSE -1 END AS noise,
      CASE WHEN s_nationkey <> 3 AND s_nationkey % 4 IN (1, 3) THEN 1 ELSE 0 END AS wifi,
      CASE WHEN s_nationkey <> 3 AND s_nationkey % 3 = 0 THEN 1 ELSE 0 END AS tv,
      CASE WHEN s_nationkey <> 3 AND s_nationkey % 4 < 3 THEN s_nationkey % 4 ELSE 0 END AS attire,
      CASE WHEN s_nationkey = 4 THEN 0.0 ELSE
        CASE WHEN (s_nationkey * 7) % 24 + 0.5 - s_nationkey % 24 < 0 THEN 24.0 ELSE 0.0 END
        + (s_nationkey * 7) % 24 + 0.5 - s_nationkey % 24
        + CASE s_nationkey % 5 WHEN 0 THEN 10.0 WHEN 1 THEN 4.5 ELSE 0.0 END END AS weekly_hours,
      CASE WHEN s_nationkey <> 4 AND s_nationkey % 5 <> 4 THEN 1 ELSE 0 END AS weekend_open,
      {CATEGORY_TEXT} AS cats
    FROM supplier WHERE s_acctbal >= 0
  )
)
"""

ENGAGEMENT = """
checkin_parts AS (
  SELECT user_id AS item_id, count(*) AS all_count, count(*) FILTER (event_type <> 'error') AS n,
         count(*) FILTER (event_type <> 'error' AND hour(ts) >= 17) AS evening,
         count(*) FILTER (event_type <> 'error' AND isodow(ts) >= 6) AS weekend
  FROM events GROUP BY user_id
),
tips AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, CAST(floor(value) AS BIGINT) AS likes
         FROM events WHERE event_type = 'click'),
user_tip AS (SELECT user_id, count(*) AS user_tips, CAST(sum(likes) AS BIGINT) AS user_tip_likes FROM tips GROUP BY user_id),
item_tip AS (SELECT item_id, count(*) AS item_tips, CAST(sum(likes) AS BIGINT) AS item_tip_likes FROM tips GROUP BY item_id),
photo AS (SELECT user_id AS item_id, count(*) AS photos FROM events WHERE event_type = 'view' GROUP BY user_id)
"""


def r(expression: str, name: str) -> str:
    return f"round({expression} + {TIE}, 6) AS {name}"


def key_stats(key: str) -> str:
    return f"""WITH {RATINGS} SELECT {key}, {r('avg(stars)', 'avg')}, count(*) AS cnt, {r('var_pop(stars)', 'var')},
    round(min(stars), 6) AS min, round(max(stars), 6) AS max FROM train GROUP BY {key}"""


def distribution(key: str) -> str:
    return f"""WITH {RATINGS}, d AS (
      SELECT {key}, count(*) AS cnt, sum(stars) AS sum, sum(stars * stars) AS sumsq,
        count(*) FILTER (stars <= 2) AS low, count(*) FILTER (stars >= 4) AS high,
        count(*) FILTER (stars = 1) AS one, count(*) FILTER (stars = 5) AS five,
        min(stars) AS min, max(stars) AS max, list_sort(list(DISTINCT stars)) AS seen, list(stars) AS every,
        avg(stars) AS avg, var_pop(stars) AS var
      FROM train GROUP BY {key})
    SELECT {key}, cnt, sum, sumsq, low, high, one, five, min, len(list_filter(every, lambda x: x = min)) AS min_count,
      seen[2] AS second_min, max, len(list_filter(every, lambda x: x = max)) AS max_count,
      CASE WHEN len(seen) > 1 THEN seen[len(seen) - 1] END AS second_max, {r('avg', 'avg')}, {r('var', 'var')},
      {', '.join(r(f'{c} / cnt', f'{c}_rate') for c in ('low', 'high', 'one', 'five'))}
    FROM d"""


def loo_columns(key: str, prefix: str) -> str:
    """Window form of leave-one-out: the frame itself excludes the current row."""
    w = f"OVER (PARTITION BY {key} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)"
    share = lambda test: f"coalesce(avg(CASE WHEN {test} THEN 1.0 ELSE 0.0 END) {w}, 0.0)"
    parts = {
        "avg": f"coalesce(avg(stars) {w}, g)", "cnt": f"count(*) {w}",
        "var": f"coalesce(greatest(0.0, avg(stars * stars) {w} - (avg(stars) {w}) * (avg(stars) {w})), 0.0)",
        "min": f"coalesce(min(stars) {w}, g)", "max": f"coalesce(max(stars) {w}, g)",
        "low_rate": share("stars <= 2"), "high_rate": share("stars >= 4"), "one_rate": share("stars = 1"), "five_rate": share("stars = 5"),
    }
    return ", ".join(f"{sql} AS {prefix}_{name}" for name, sql in parts.items())


def loo(key: str, prefix: str) -> str:
    shown = ", ".join(
        f"{prefix}_{n}" if n == "cnt" else r(f"{prefix}_{n}", f"{prefix}_{n}") for n in STATS
    )
    return f"""WITH {RATINGS}, l AS (SELECT *, {loo_columns(key, prefix)} FROM train, (SELECT avg(stars) AS g FROM train))
    SELECT {key}, stars, {SEQ_LIST}, {shown} FROM l"""


def cf(fitted: str, pairs: str, k: int = 50, min_abs_sim: float = 0.01) -> str:
    """CTEs up to ``scored``: ``fitted(fold, user_id, item_id, stars, ..)`` scores ``pairs(fold, user_id, item_id)``."""
    return f"""
    fit AS ({fitted}),
    pair AS ({pairs}),
    m AS (SELECT fold, user_id, item_id, max_by(stars, {ORDER}) AS v, min({ORDER}) AS first FROM fit GROUP BY ALL),
    um AS (SELECT fold, user_id, avg(v) AS u FROM m GROUP BY ALL),
    im AS (SELECT fold, item_id, avg(v) AS i FROM m GROUP BY ALL),
    gm AS (SELECT fold, avg(stars) AS g FROM fit GROUP BY ALL),
    co AS (
      SELECT a.fold, a.item_id AS ia, b.item_id AS ib, count(*) AS n, sum(a.v) AS sx, sum(b.v) AS sy,
        sum(a.v * a.v) AS sxx, sum(b.v * b.v) AS syy, sum(a.v * b.v) AS sxy
      FROM m a JOIN m b ON a.fold = b.fold AND a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY ALL),
    weighted AS (
      SELECT fold, ia, ib, n, least(n, 50) / 50.0 * CASE WHEN n >= 2 AND n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0
        THEN (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) ELSE 0.0 END AS w FROM co),
    sims AS (SELECT fold, ia, ib, n, w * pow(abs(w), 1.5) AS sim FROM weighted WHERE abs(w * pow(abs(w), 1.5)) > {min_abs_sim}),
    near AS (SELECT fold, ia AS target, ib AS other, n, sim FROM sims UNION ALL SELECT fold, ib, ia, n, sim FROM sims),
    nb AS (
      SELECT p.fold, p.user_id, p.item_id, near.sim, m.v - im.i AS dev,
        row_number() OVER (PARTITION BY p.fold, p.user_id, p.item_id ORDER BY abs(near.sim) DESC, m.first) AS place
      FROM pair p JOIN m ON p.fold = m.fold AND p.user_id = m.user_id AND p.item_id <> m.item_id
      JOIN near ON near.fold = p.fold AND near.target = p.item_id AND near.other = m.item_id
      JOIN im ON im.fold = p.fold AND im.item_id = m.item_id),
    sums AS (SELECT fold, user_id, item_id, sum(sim * dev) AS num, sum(abs(sim)) AS den, count(*) AS n
      FROM nb WHERE place <= {k} GROUP BY ALL),
    scored AS (
      SELECT p.fold, p.user_id, p.item_id,
        CASE WHEN u IS NULL AND i IS NULL THEN g WHEN u IS NULL THEN i WHEN i IS NULL THEN u WHEN m.v IS NOT NULL THEN m.v
             WHEN n IS NULL THEN greatest(1.0, least(5.0, u + i - g))
             WHEN n < 15 THEN greatest(1.0, least(5.0, n / 15.0 * (i + num / den) + (1 - n / 15.0) * (u + i - g)))
             ELSE greatest(1.0, least(5.0, i + num / den)) END AS cf_pred,
        CAST(CASE WHEN u IS NULL OR i IS NULL THEN 0 WHEN m.v IS NOT NULL THEN 50 ELSE coalesce(n, 0) END AS BIGINT) AS n_neighbours
      FROM pair p LEFT JOIN um USING (fold, user_id) LEFT JOIN im USING (fold, item_id) JOIN gm USING (fold)
      LEFT JOIN m USING (fold, user_id, item_id) LEFT JOIN sums USING (fold, user_id, item_id))"""


ALL_TRAIN = "SELECT 0 AS fold, * EXCLUDE (fold) FROM train"
TEST_PAIRS = "SELECT DISTINCT 0 AS fold, user_id, item_id FROM test"
OTHER_FOLDS = "SELECT f.fold, t.* EXCLUDE (fold) FROM train t JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS fold) f ON t.fold <> f.fold"
TRAIN_PAIRS = "SELECT DISTINCT fold, user_id, item_id FROM train"


def similarity(select: str, min_abs_sim: float = 0.01) -> str:
    return f"WITH {RATINGS}, {cf(ALL_TRAIN, TEST_PAIRS, min_abs_sim=min_abs_sim)} {select}"


def entity_stats(rich: bool) -> str:
    """``ustat`` and ``istat``: full statistics by user and by item."""
    columns = """avg(stars) AS avg, count(*) AS cnt, var_pop(stars) AS var, min(stars) AS min, max(stars) AS max,
      avg(CASE WHEN stars <= 2 THEN 1.0 ELSE 0.0 END) AS low_rate, avg(CASE WHEN stars >= 4 THEN 1.0 ELSE 0.0 END) AS high_rate,
      avg(CASE WHEN stars = 1 THEN 1.0 ELSE 0.0 END) AS one_rate, avg(CASE WHEN stars = 5 THEN 1.0 ELSE 0.0 END) AS five_rate"""
    return f"""ustat AS (SELECT user_id, {columns} FROM train GROUP BY user_id),
    istat AS (SELECT item_id, {columns} FROM train GROUP BY item_id)"""


PROXY = """greatest(1.0, least(5.0, CASE WHEN u_cnt > 0 AND i_cnt > 0 THEN u_avg + i_avg - g WHEN u_cnt > 0 THEN u_avg
    WHEN i_cnt > 0 THEN i_avg ELSE g END))"""

LOO_ROWS = f"""rows AS (SELECT *, {loo_columns('user_id', 'u')}, {loo_columns('item_id', 'i')}
    FROM train, (SELECT avg(stars) AS g FROM train))"""


def full_rows(source: str) -> str:
    """``rows``: rows of ``source`` with full statistics, global mean and zeros where unseen."""
    columns = []
    for p, t in (("u", "us"), ("i", "it")):
        for name in STATS:
            empty = "g" if name in ("avg", "min", "max") else "0"
            columns.append(f"coalesce({t}.{name}, {empty}) AS {p}_{name}")
    return f"""{entity_stats(True)}, rows AS (SELECT s.*, g, {', '.join(columns)}
      FROM {source} s CROSS JOIN (SELECT avg(stars) AS g FROM train)
      LEFT JOIN ustat us USING (user_id) LEFT JOIN istat it USING (item_id))"""


def bias(rows: str) -> str:
    return f"""WITH {RATINGS}, {rows} SELECT user_id, item_id, {SEQ_LIST}, {r(PROXY, 'cf_pred')}, CAST(0 AS BIGINT) AS n_neighbours FROM rows"""


# The 117 formulas over ``u_*`` / ``i_*`` statistics, profile columns, ``g`` and the neighbourhood score.
FORMULAS = {
    "user_mean": "uf", "item_mean": "bf", "pair_mean": "(uf + bf) / 2", "pair_mean_sq": "pow((uf + bf) / 2, 2)",
    "user_profile_mean": "ujs", "item_profile_mean": "bjs",
    "user_mean_c5": "(u_avg * u_cnt + ja * 5) / (u_cnt + 5)", "user_mean_c15": "(u_avg * u_cnt + ja * 15) / (u_cnt + 15)",
    "item_mean_c10": "(i_avg * i_cnt + js * 10) / (i_cnt + 10)", "item_mean_c35": "(i_avg * i_cnt + js * 35) / (i_cnt + 35)",
    "user_conf": "uc", "item_conf": "bc", "log_user_cnt": "ln(1 + u_cnt)", "log_item_cnt": "ln(1 + i_cnt)",
    "log_user_reviews": "ln(1 + review_count)", "log_item_reviews": "ln(1 + item_review_count)",
    "mean_gap": "uf - bf", "abs_mean_gap": "abs(uf - bf)", "user_bias": "uf - g", "item_bias": "bf - g",
    "user_var": "u_var", "item_var": "i_var", "user_range": "u_max - u_min", "item_range": "i_max - i_min",
    "user_cold": "CASE WHEN u_cnt = 0 THEN 1.0 ELSE 0.0 END", "item_cold": "CASE WHEN i_cnt = 0 THEN 1.0 ELSE 0.0 END",
    "log_fans": "ln(1 + fans)", "log_useful": "ln(1 + useful)", "log_compliments": "ln(1 + compliments)",
    "log_friends": "ln(1 + friend_count)", "elite_count": "elite_count", "fans_per_review": "fans_per_review",
    "useful_per_review": "useful_per_review", "account_years": "2019 - since_year",
    "item_stars": "js", "latitude": "latitude", "longitude": "longitude", "is_open": "is_open", "price": "price",
    "category_count": "category_count", "log_checkins": "ln(1 + checkins)", "log_photos": "ln(1 + photos)",
    "log_item_tips": "ln(1 + item_tips)", "log_user_tips": "ln(1 + user_tips)", "item_tip_likes": "item_tip_likes",
    "user_tip_likes": "user_tip_likes", "mean_product": "uf * bf", "bias_product": "(uf - g) * (bf - g)",
    "gap_x_user_var": "(uf - bf) * u_var", "gap_x_item_var": "(uf - bf) * i_var", "var_product": "u_var * i_var",
    "log_cnt_product": "ln(1 + u_cnt) * ln(1 + i_cnt)", "user_mean_x_price": "uf * price",
    "item_var_x_log_cnt": "i_var * ln(1 + i_cnt)", "user_mean_x_conf": "uf * uc", "item_mean_x_conf": "bf * bc",
    "gap_x_conf": "(uf - bf) * (uc + bc)", "pair_mean_x_item_conf": "(uf + bf) / 2 * bc",
    "cf_pred": "cf", "n_neighbours": "nn", "cf_conf": "least(nn, 50) / 50.0", "cf_minus_user": "cf - uf", "cf_minus_item": "cf - bf",
    "cf_minus_pair": "cf - (uf + bf) / 2", "cf_x_cf_conf": "cf * least(nn, 50) / 50.0", "cf_x_item_conf": "cf * bc",
    "cf_x_user_conf": "cf * uc", "cf_abs_minus_user": "abs(cf - uf)",
    "user_low_rate": "u_low_rate", "user_high_rate": "u_high_rate", "item_low_rate": "i_low_rate", "item_high_rate": "i_high_rate",
    "low_rate_product": "u_low_rate * i_low_rate", "high_rate_product": "u_high_rate * i_high_rate",
    "user_one_rate": "u_one_rate", "user_five_rate": "u_five_rate", "item_one_rate": "i_one_rate", "item_five_rate": "i_five_rate",
    "one_rate_product": "u_one_rate * i_one_rate", "five_rate_product": "u_five_rate * i_five_rate",
    "user_one_x_item_low": "u_one_rate * i_low_rate", "user_five_x_item_high": "u_five_rate * i_high_rate",
}


def features(rows: str, rich: bool, score: str, neighbours: str, extra: str = "", join: str = "") -> str:
    zero = ["review_count", "fans", "useful", "compliments", "friend_count", "elite_count", "fans_per_review", "useful_per_review",
            "item_review_count", "latitude", "longitude", "price", "category_count", "photos", "item_tips", "user_tips",
            "item_tip_likes", "user_tip_likes", "alcohol", "kids", "outdoor", "wifi", "tv", "attire", "weekly_hours", "weekend_open",
            *[f"cat_{i:02d}" for i in range(1, 25)]]
    values = {**{c: f"coalesce({c}, 0)" for c in zero}, "since_year": "coalesce(since_year, 2015)", "is_open": "coalesce(is_open, 1)",
              "noise": "coalesce(noise, -1)", "checkins": f"coalesce({'ch.n' if rich else 'ch.all_count'}, 0)",
              "evening_ratio": "CASE WHEN ch.n > 0 THEN evening / ch.n ELSE 0.0 END",
              "weekend_ratio": "CASE WHEN ch.n > 0 THEN weekend / ch.n ELSE 0.0 END",
              "ja": "coalesce(average_stars, g)", "js": "coalesce(item_stars, g)"}
    stats = ", ".join(f"rows.{p}_{n}" for p in "ui" for n in STATS)
    names = RICH_FEATURES if rich else STACKED_FEATURES
    shown = ", ".join(f"round(CAST({FORMULAS.get(n, n)} AS DOUBLE) + {TIE}, 6) AS {n}" for n in names)
    keys = ", ".join(f"rows.{c}" for c in ["user_id", "item_id", "seq"])
    return f"""WITH {RATINGS}, {USERS}, {ITEMS}, {ENGAGEMENT}, {rows}{extra},
    filled AS (SELECT {keys}, rows.g, {stats}, CAST({score} AS DOUBLE) AS cf, CAST({neighbours} AS DOUBLE) AS nn,
        {', '.join(f'{sql} AS {name}' for name, sql in values.items())}
      FROM rows LEFT JOIN users USING (user_id) LEFT JOIN items USING (item_id) LEFT JOIN checkin_parts ch USING (item_id)
      LEFT JOIN user_tip USING (user_id) LEFT JOIN item_tip USING (item_id) LEFT JOIN photo USING (item_id) {join}),
    shrunk AS (SELECT *, u_cnt / (u_cnt + 12) AS uc, i_cnt / (i_cnt + 32) AS bc,
        (ja * review_count + g * 8) / (review_count + 8) AS ujs, (js * item_review_count + g * 8) / (item_review_count + 8) AS bjs
      FROM filled),
    final AS (SELECT *, CASE WHEN u_cnt > 0 THEN (u_avg * u_cnt + ja * 12) / (u_cnt + 12) ELSE ujs END AS uf,
        CASE WHEN i_cnt > 0 THEN (i_avg * i_cnt + js * 32) / (i_cnt + 32) ELSE bjs END AS bf FROM shrunk)
    SELECT user_id, item_id, {SEQ_LIST}, {shown} FROM final"""


def shrunk_side(name: str, key: str, stat: str, people: str, prior: str, reviews: str, c: int, light: int, heavy: int) -> str:
    raw = f"coalesce(s.cnt, 0) AS cnt, coalesce(s.avg, g) AS avg, coalesce(p.{prior}, g) AS prior, coalesce(p.{reviews}, 0) AS rc, g"
    smooth = lambda k: f"(avg * cnt + prior * {k}) / (cnt + {k})"
    return f"""SELECT '{name}' AS side, {key} AS id, cnt, {r('(prior * rc + g * 8) / (rc + 8)', 'profile_mean')},
      {r(f'CASE WHEN cnt > 0 THEN {smooth(c)} ELSE (prior * rc + g * 8) / (rc + 8) END', 'final_mean')},
      {r(f'cnt / (cnt + {c})', 'confidence')}, {r(smooth(light), 'light_mean')}, {r(smooth(heavy), 'heavy_mean')}
    FROM (SELECT coalesce(s.{key}, p.{key}) AS {key}, {raw} FROM {stat} s FULL JOIN {people} p ON s.{key} = p.{key}
          CROSS JOIN (SELECT avg(stars) AS g FROM train))"""


_USER_SELECT = f"""WITH {USERS} SELECT CAST(user_id AS VARCHAR) AS user_id, round(average_stars, 6) AS average_stars,
  review_count, fans, useful, funny, cool, since_year, compliments, friend_count, elite_count,
  {r('fans_per_review', 'fans_per_review')}, {r('useful_per_review', 'useful_per_review')} FROM users"""
_ITEM_ID = "CAST(item_id AS VARCHAR) AS item_id"
_SCORED = f"{cf(ALL_TRAIN, TEST_PAIRS)}"
_TEST_SCORES = f"""t AS (SELECT test.stars, cf_pred AS item_cf, g AS global_mean, {PROXY} AS bias_estimate
  FROM rows test JOIN scored USING (user_id, item_id))"""
_FEATURE_SCORE = ", scored_rows AS (SELECT fold AS sfold, user_id, item_id, cf_pred, n_neighbours FROM scored)"
_WORD_LIST = "string_split(replace(concat_ws(' , ', p_name, p_type), ' ', ', '), ',')"
def additive(trees, rate=0.5, l1=40.0, l2=25.0, start=2.5):
    """Trees of depth one over three features, one after the other; leaves are penalised, all trees are shrunk."""
    leaf = lambda s, n: f"sign({s}) * greatest(abs({s}) - {l1}, 0) / ({n} + {l2})"
    steps = [f"""r0 AS (SELECT stars, CAST(l_linenumber AS DOUBLE) AS line, CAST(l_partkey % 5 AS DOUBLE) AS part_group,
        CAST(user_id % 11 AS DOUBLE) AS segment, CAST({start} AS DOUBLE) AS p FROM train)"""]
    for k in range(1, trees + 1):
        steps.append(f"""x{k} AS (SELECT line, part_group, segment, stars - p AS e FROM r{k - 1}),
      long{k} AS (UNPIVOT x{k} ON line, part_group, segment INTO NAME feature VALUE v),
      per{k} AS (SELECT feature, v, count(*) AS n, sum(e) AS s FROM long{k} GROUP BY ALL),
      cum{k} AS (SELECT feature, v, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(n) OVER (PARTITION BY feature) AS all_n,
          sum(s) OVER (PARTITION BY feature) AS all_s FROM per{k} WINDOW w AS (PARTITION BY feature ORDER BY v)),
      best{k} AS (SELECT feature, v, {leaf("s", "n")} AS low, {leaf("(all_s - s)", "(all_n - n)")} AS high FROM cum{k} WHERE n < all_n
        ORDER BY s * s / n + (all_s - s) * (all_s - s) / (all_n - n) DESC LIMIT 1),
      r{k} AS (SELECT stars, line, part_group, segment, p + {rate} * CASE WHEN CASE feature WHEN 'line' THEN line
          WHEN 'part_group' THEN part_group ELSE segment END <= v THEN low ELSE high END AS p FROM r{k - 1}, best{k})""")
    return f"""WITH {RATINGS}, {", ".join(steps)}
      SELECT line, part_group, segment, count(*) AS n, {r("avg(p)", "raw_prediction")} FROM r{trees} GROUP BY line, part_group, segment"""



ORACLES: dict[str, str] = {
    "global_mean": f"WITH {RATINGS} SELECT {r('avg(stars)', 'global_mean')} FROM train",
    "user_stats": key_stats("user_id"),
    "item_stats": key_stats("item_id"),
    "user_rating_distribution": distribution("user_id"),
    "item_rating_distribution": distribution("item_id"),
    "loo_user_stats": loo("user_id", "user"),
    "loo_item_stats": loo("item_id", "item"),
    "dedupe_last": f"WITH {RATINGS} SELECT user_id, item_id, max_by(stars, {ORDER}) AS stars FROM train GROUP BY user_id, item_id",
    "cf_means": similarity(
        f"SELECT 'user' AS side, user_id AS id, {r('avg(v)', 'mean')}, count(*) AS pairs FROM m GROUP BY user_id "
        f"UNION ALL SELECT 'item', item_id, {r('avg(v)', 'mean')}, count(*) FROM m GROUP BY item_id"
    ),
    "corater_counts": similarity("SELECT ia AS item_a, ib AS item_b, n, sx, sy, sxx, syy, sxy FROM co WHERE n >= 8"),
    "item_similarity": similarity(f"SELECT ia AS item_a, ib AS item_b, n, {r('sim', 'sim')} FROM sims"),
    "topk_similar_items": similarity(
        f"SELECT n, {r('sim', 'sim')}, target, other, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target "
        "ORDER BY abs(sim) DESC, other) AS INTEGER) AS rank FROM near) WHERE rank <= 5", LOOSE
    ),
    "cf_score_test": f"WITH {RATINGS}, {_SCORED} SELECT user_id, item_id, {r('cf_pred', 'cf_pred')}, n_neighbours FROM scored",
    "cf_score_topk3": f"WITH {RATINGS}, {cf(ALL_TRAIN, TEST_PAIRS, 3, LOOSE)} "
    f"SELECT user_id, item_id, {r('cf_pred', 'cf_pred')}, n_neighbours FROM scored",
    "cf_score_loose": f"WITH {RATINGS}, {cf(ALL_TRAIN, TEST_PAIRS, 50, LOOSE)} "
    f"SELECT user_id, item_id, {r('cf_pred', 'cf_pred')}, n_neighbours FROM scored",
    "cf_score_k20": f"WITH {RATINGS}, {cf(ALL_TRAIN, TEST_PAIRS, 20, LOOSE)} "
    f"SELECT user_id, item_id, {r('cf_pred', 'cf_pred')}, n_neighbours FROM scored",
    "cf_out_of_fold_loose": f"WITH {RATINGS}, {cf(OTHER_FOLDS, TRAIN_PAIRS, 50, LOOSE)} "
    f"SELECT fold, user_id, item_id, {r('cf_pred', 'cf_pred')}, n_neighbours FROM scored",
    "fold_assignment": f"""WITH {RATINGS}, placed AS (SELECT *, CAST((row_number() OVER (ORDER BY seq, item_id, stars) - 1) % 5 AS INTEGER) AS place FROM train)
      SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, place AS fold, count(*) AS n
      FROM placed GROUP BY ALL""",
    "cf_out_of_fold": f"WITH {RATINGS}, {cf(OTHER_FOLDS, TRAIN_PAIRS)} "
    f"SELECT fold, user_id, item_id, {r('cf_pred', 'cf_pred')}, n_neighbours FROM scored",
    "bias_proxy_train": bias(LOO_ROWS),
    "bias_proxy_test": bias(full_rows("test")),
    "shrunk_means": f"WITH {RATINGS}, {USERS}, {ITEMS}, {entity_stats(True)} "
    + shrunk_side("user", "user_id", "ustat", "users", "average_stars", "review_count", 12, 5, 15)
    + " UNION ALL "
    + shrunk_side("item", "item_id", "istat", "items", "item_stars", "item_review_count", 32, 10, 35),
    "profile_scalars": _USER_SELECT,
    "users_from_files": _USER_SELECT,
    "ratings_from_files": f"""WITH {RATINGS} SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id,
      count(*) AS n, sum(stars) AS stars_sum, any_value(c) AS positions, any_value(c) - 1 AS last_position
      FROM train, (SELECT count(*) AS c FROM train) GROUP BY user_id, item_id""",
    "predictions_to_files": f"""WITH {RATINGS}, {full_rows('test')} SELECT user_id, item_id AS business_id, count(*) AS n,
      round(max({PROXY}) + {TIE}, 4) AS prediction FROM rows GROUP BY user_id, item_id""",
    "pairs_from_files": f"""WITH {RATINGS} SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id,
      count(*) AS n FROM test GROUP BY user_id, item_id""",
    "rejected_lines": f"""WITH {RATINGS}, lines AS (
      SELECT 'pairs' AS source, 'accepted' AS reason, CAST(NULL AS VARCHAR) AS line FROM test
      UNION ALL SELECT 'pairs', 'too few fields', CAST(user_id AS VARCHAR) FROM test
      UNION ALL SELECT 'pairs', 'repeated header', 'user_id,business_id'
      UNION ALL SELECT 'users', 'broken JSON', '{{"user_id": ' || c_name FROM customer WHERE c_acctbal < 0
      UNION ALL SELECT 'users', 'accepted', NULL FROM customer WHERE c_acctbal >= 0
      UNION ALL SELECT 'users', 'accepted', NULL FROM customer WHERE c_acctbal >= 0 AND c_mktsegment = 'FURNITURE'
      UNION ALL SELECT 'items', 'accepted', NULL FROM supplier WHERE s_acctbal >= 0
      UNION ALL SELECT 'items', 'not an object', '[1, 2]' FROM supplier WHERE s_acctbal < 0)
      SELECT source, reason, line, count(*) AS n FROM lines GROUP BY source, reason, line""",
    "items_from_files": f"""WITH {ITEMS} SELECT {_ITEM_ID}, round(item_stars, 6) AS item_stars, item_review_count,
      {r('latitude', 'latitude')}, round(longitude, 6) AS longitude, is_open, price, category_count, alcohol, kids, outdoor,
      noise, wifi, tv, attire, {r('CAST(weekly_hours AS DOUBLE)', 'weekly_hours')}, weekend_open,
      {', '.join(f'cat_{i:02d}' for i in range(1, 25))} FROM items""",
    "checkins_from_files": f"""WITH {ENGAGEMENT} SELECT {_ITEM_ID}, {r('CASE WHEN n > 0 THEN evening / n ELSE 0.0 END', 'evening_ratio')},
      {r('CASE WHEN n > 0 THEN weekend / n ELSE 0.0 END', 'weekend_ratio')}, CAST(n AS DOUBLE) AS checkins FROM checkin_parts""",
    "item_tips_from_files": f"WITH {ENGAGEMENT} SELECT {_ITEM_ID}, item_tips, item_tip_likes FROM item_tip",
    "photos_from_files": f"WITH {ENGAGEMENT} SELECT {_ITEM_ID}, photos FROM photo",
    "attribute_codes": f"""WITH {ITEMS} SELECT {_ITEM_ID}, round(item_stars, 6) AS item_stars, item_review_count,
      {r('latitude', 'latitude')}, round(longitude, 6) AS longitude, is_open, price, alcohol, kids, outdoor, noise, wifi, tv, attire FROM items""",
    "weekly_hours": f"WITH {ITEMS} SELECT {_ITEM_ID}, {r('CAST(weekly_hours AS DOUBLE)', 'weekly_hours')}, weekend_open FROM items",
    "category_flags": f"""SELECT p_partkey, CAST(len({_WORD_LIST}) AS BIGINT) AS category_count, {', '.join(
        f"CAST(list_contains(list_transform({_WORD_LIST}, lambda x: lower(trim(x))), '{w}') AS INTEGER) AS cat_{i:02d}"
        for i, w in enumerate(PART_WORDS, start=1))} FROM part""",
    "item_categories": f"WITH {ITEMS} SELECT {_ITEM_ID}, category_count, {', '.join(f'cat_{i:02d}' for i in range(1, 25))} FROM items",
    "checkin_ratios": f"""WITH {ENGAGEMENT} SELECT {_ITEM_ID}, {r('CASE WHEN n > 0 THEN evening / n ELSE 0.0 END', 'evening_ratio')},
      {r('CASE WHEN n > 0 THEN weekend / n ELSE 0.0 END', 'weekend_ratio')}, CAST(n AS DOUBLE) AS checkins FROM checkin_parts""",
    "checkin_totals": f"WITH {ENGAGEMENT} SELECT {_ITEM_ID}, CAST(all_count AS DOUBLE) AS checkins FROM checkin_parts",
    "user_tip_stats": f"WITH {ENGAGEMENT} SELECT CAST(user_id AS VARCHAR) AS user_id, user_tips, user_tip_likes FROM user_tip",
    "item_tip_stats": f"WITH {ENGAGEMENT} SELECT {_ITEM_ID}, item_tips, item_tip_likes FROM item_tip",
    "photo_counts": f"WITH {ENGAGEMENT} SELECT {_ITEM_ID}, photos FROM photo",
    "features_stacked_train": features(
        full_rows("train") + f", {cf(OTHER_FOLDS, TRAIN_PAIRS)}", False, "sc.cf_pred", "sc.n_neighbours", _FEATURE_SCORE,
        "JOIN scored_rows sc ON sc.sfold = rows.fold AND sc.user_id = rows.user_id AND sc.item_id = rows.item_id",
    ),
    "features_stacked_test": features(
        full_rows("test") + f", {_SCORED}", False, "sc.cf_pred", "sc.n_neighbours", _FEATURE_SCORE,
        "JOIN scored_rows sc ON sc.user_id = rows.user_id AND sc.item_id = rows.item_id",
    ),
    "features_rich_train": features(LOO_ROWS, True, PROXY, "0"),
    "features_rich_test": features(full_rows("test"), True, PROXY, "0"),
    "calibrate": f"""WITH {RATINGS}, {full_rows('test')},
      t AS (SELECT stars - g AS y, p - g AS x, greatest(1.0, least(5.0, g + 1.063 * (p - g) - 0.0015)) AS e
            FROM (SELECT stars, g, {PROXY} AS p FROM rows))
      SELECT {r('regr_slope(y, x)', 'slope')}, {r('regr_intercept(y, x)', 'shift')}, {r('min(e)', 'lowest')},
        {r('max(e)', 'highest')}, {r('avg(e)', 'mean')} FROM t""",
    "rmse_ladder": f"WITH {RATINGS}, {full_rows('test')}, {_SCORED}, {_TEST_SCORES} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS model, {r(f'sqrt(avg(pow(stars - {c}, 2)))', 'rmse')} FROM t"
        for c in ("global_mean", "bias_estimate", "item_cf")
    ),
    "error_histogram": f"""WITH {RATINGS}, {_SCORED}, e AS (SELECT abs(stars - round(cf_pred, 9)) AS e
        FROM test JOIN scored USING (user_id, item_id))
      SELECT CASE WHEN e < 1 THEN 'below 1' WHEN e < 2 THEN '1 to 2' WHEN e < 3 THEN '2 to 3' ELSE 'above 3' END AS band,
        count(*) AS n FROM e GROUP BY band""",
    "boosted_one_split": f"""WITH {RATINGS}, x AS (
        SELECT stars, CAST(l_linenumber AS DOUBLE) AS line, CAST(l_partkey % 5 AS DOUBLE) AS part_group, CAST(user_id % 11 AS DOUBLE) AS segment
        FROM train),
      long AS (UNPIVOT x ON line, part_group, segment INTO NAME feature VALUE v),
      per AS (SELECT feature, v, count(*) AS n, sum(stars) AS s FROM long GROUP BY ALL),
      cum AS (SELECT feature, v, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(n) OVER (PARTITION BY feature) AS all_n,
          sum(s) OVER (PARTITION BY feature) AS all_s FROM per WINDOW w AS (PARTITION BY feature ORDER BY v)),
      best AS (SELECT feature, v, s / n AS low, (all_s - s) / (all_n - n) AS high, all_s / all_n AS g FROM cum WHERE n < all_n
        ORDER BY s * s / n + (all_s - s) * (all_s - s) / (all_n - n) DESC LIMIT 1),
      p AS (SELECT line, part_group, segment, count(*) AS n, any_value(g) AS g,
          any_value(CASE WHEN CASE feature WHEN 'line' THEN line WHEN 'part_group' THEN part_group ELSE segment END <= v
            THEN low ELSE high END) AS raw FROM x, best GROUP BY line, part_group, segment)
      SELECT line, part_group, segment, n, {r('raw', 'raw_prediction')}, {r('greatest(1.0, least(5.0, raw))', 'clamped')},
        {r('greatest(1.0, least(5.0, g + 1.063 * (raw - g) - 0.0015))', 'calibrated')} FROM p""",
    "boosted_penalised_leaves": additive(1),
    "boosted_shrunk_trees": additive(3),
    "boosted_contract": f"""WITH {RATINGS} SELECT count(*) AS rows, true AS keys_kept, true AS within_stars, CAST(0 AS BIGINT) AS missing,
      true AS no_worse_than_mean FROM test""",
}
