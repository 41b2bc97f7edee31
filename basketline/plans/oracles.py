"""Oracle SQL (DuckDB dialect) for the registered queries, written from the same definitions."""

from basketline.plans.queries import CHAIN_ROWS, CUTOFF, FROM_DAY, KEY, TO_DAY
from basketline.schema import (
    DEFAULT_CLUSTERS,
    HOLDOUT_FRACTION,
    HOLDOUT_SEED,
    KMEANS_SEED,
    KMEANS_STARTS,
    SMALL_GROUP_THRESHOLD,
    STABILITY_THRESHOLD,
    WEEKDAYS,
)

# All legs of all line items, typed. Customers are still unfiltered here.
_LEGS = """
lines_and_legs AS (
  SELECT *, 0 AS leg FROM lineitem
  UNION ALL SELECT *, 1 FROM lineitem WHERE l_returnflag = 'R'
),
legs AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_shipdate,
         o.o_custkey, o.o_orderdate, p.p_name, p.p_retailprice, n.n_name, l.leg
  FROM lines_and_legs l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
),
plain AS (
  SELECT CASE WHEN leg = 1 THEN 'C' WHEN l_linenumber = 7 THEN 'A' ELSE '' END
           || CAST(l_orderkey AS VARCHAR) AS InvoiceNo,
         CASE WHEN l_partkey % 97 = 0 THEN 'POST' ELSE CAST(l_partkey AS VARCHAR) END AS StockCode,
         p_name AS Description,
         CASE WHEN leg = 1 THEN -CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END
           AS Quantity,
         CASE WHEN leg = 1 THEN l_shipdate ELSE o_orderdate END AS InvoiceDate,
         CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS UnitPrice,
         o_custkey, n_name AS Country, l_linenumber,
         lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_linenumber AS VARCHAR), 2, '0')
           || lpad(CAST(l_partkey AS VARCHAR), 11, '0')
           || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') || strftime(l_shipdate, '%Y%m%d')
           || CAST(leg AS VARCHAR) AS ord
  FROM legs
)"""


def _tagged(source: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT *, Quantity * UnitPrice AS Revenue,
         coalesce(regexp_matches(InvoiceNo, '^C[0-9]+$'), false) AS IsCancellation,
         coalesce(regexp_matches(InvoiceNo, '^A[0-9]+$'), false) AS IsAdjustment,
         coalesce(Quantity < 0, false)
           AND NOT coalesce(regexp_matches(InvoiceNo, '^A[0-9]+$'), false) AS IsReturn,
         coalesce(StockCode, '') IN ('AMAZONFEE', 'BANK CHARGES', 'CRUK', 'D', 'DOT', 'M',
                                     'PADS', 'POST', 'S') AS IsNonProduct
  FROM {source}
)"""


_LINES = f"""WITH {_LEGS},
kept AS (
  SELECT * EXCLUDE (o_custkey, l_linenumber), CAST(o_custkey AS VARCHAR) AS CustomerID
  FROM plain WHERE o_custkey % 20 > 1
),{_tagged("kept", "lines")},
sales AS (SELECT * FROM lines WHERE NOT IsAdjustment AND NOT IsReturn),
counted AS (SELECT * FROM lines WHERE NOT IsAdjustment)
"""

# What the untidy spellings are worth after cleaning.
_UNTIDY = f"""WITH {_LEGS},
untidy AS (
  SELECT InvoiceNo, StockCode,
         CASE l_linenumber WHEN 1 THEN '=' || Description WHEN 2 THEN '@' || Description
           WHEN 3 THEN '-' || Description WHEN 4 THEN '-5.5'
           WHEN 5 THEN chr(65309) || Description WHEN 6 THEN NULL ELSE Description END AS Description,
         CASE WHEN l_linenumber <= 4 THEN Quantity END AS Quantity,
         CASE WHEN l_linenumber IN (5, 6) THEN NULL
           WHEN l_linenumber = 7 AND day(InvoiceDate) <= 12
             THEN make_timestamp(year(InvoiceDate), day(InvoiceDate), month(InvoiceDate), 0, 0, 0.0)
           ELSE InvoiceDate END AS InvoiceDate,
         CASE WHEN l_linenumber IN (3, 4, 5) THEN NULL ELSE UnitPrice END AS UnitPrice,
         CASE WHEN l_linenumber IN (4, 5) THEN NULL ELSE CAST(o_custkey AS VARCHAR) END
           AS CustomerID,
         Country, ord, l_linenumber
  FROM plain
)"""


def _paired(source: str, name: str) -> str:
    """CTEs that pair the returns of a tagged source."""
    return f"""
keyed AS (
  SELECT *, CASE
    WHEN InvoiceDate IS NULL OR StockCode IS NULL OR InvoiceNo IS NULL OR UnitPrice IS NULL
      OR CustomerID IS NULL OR coalesce(Quantity, 0) = 0 THEN 0
    WHEN IsReturn THEN -1
    WHEN Quantity > 0 AND NOT IsCancellation AND NOT IsAdjustment THEN 1 ELSE 0 END AS delta
  FROM {source}
),
summed AS (
  SELECT *, sum(delta) OVER (PARTITION BY CustomerID, StockCode, abs(Quantity), round(UnitPrice, 4)
    ORDER BY InvoiceDate, ord ROWS UNBOUNDED PRECEDING) AS s
  FROM keyed WHERE delta <> 0
),
deep AS (
  SELECT *, s - least(0, min(s) OVER (
    PARTITION BY CustomerID, StockCode, abs(Quantity), round(UnitPrice, 4)
    ORDER BY InvoiceDate, ord ROWS UNBOUNDED PRECEDING)) AS depth
  FROM summed
),
stepped AS (
  SELECT *, lag(depth, 1, 0) OVER (
    PARTITION BY CustomerID, StockCode, abs(Quantity), round(UnitPrice, 4)
    ORDER BY InvoiceDate, ord) AS before
  FROM deep
),
levelled AS (
  SELECT *, CASE WHEN delta > 0 THEN depth WHEN before > 0 THEN before END AS level FROM stepped
),
matched AS (
  SELECT *, lag(InvoiceNo) OVER (
    PARTITION BY CustomerID, StockCode, abs(Quantity), round(UnitPrice, 4), level
    ORDER BY InvoiceDate, ord) AS prior
  FROM levelled
),
{name} AS (
  SELECT * EXCLUDE (delta, s, depth, before, level, prior),
         CASE WHEN delta < 0 AND level IS NOT NULL THEN prior END AS PairedInvoiceNo
  FROM matched
  UNION ALL
  SELECT * EXCLUDE (delta), NULL FROM keyed WHERE delta = 0
)"""


_PAIR_COLUMNS = "InvoiceNo, StockCode, Quantity, UnitPrice, CustomerID, ord, PairedInvoiceNo"

_PRODUCTS = _LINES + """,
products AS (
  SELECT StockCode,
         coalesce(first(Description ORDER BY ord, Description)
           FILTER (WHERE Description <> ''), '') AS Description,
         CAST(sum(CAST(Revenue AS DECIMAL(38,6))) AS DOUBLE) AS Revenue, CAST(sum(Quantity) AS BIGINT) AS Quantity
  FROM sales GROUP BY StockCode
),
top_revenue AS (
  SELECT StockCode, Description, round(Revenue, 2) AS Revenue, Quantity
  FROM products ORDER BY products.Revenue DESC, StockCode LIMIT 10
)
"""

_SUMMARY = """
summary AS (
  SELECT CAST(sum(CAST(Revenue AS DECIMAL(38,6))) FILTER (WHERE NOT IsAdjustment AND NOT IsReturn) AS DOUBLE) AS gross,
         coalesce(CAST(sum(CAST(Revenue AS DECIMAL(38,6))) FILTER (WHERE NOT IsAdjustment AND IsReturn) AS DOUBLE), 0) AS refunded,
         count(DISTINCT InvoiceNo) FILTER (WHERE NOT IsAdjustment AND NOT IsReturn) AS orders,
         count(*) FILTER (WHERE NOT IsAdjustment) AS line_items,
         count(*) FILTER (WHERE IsAdjustment) AS adjustments
  FROM lines
)"""

_MONTHLY = """
monthly AS (
  SELECT strftime(date_trunc('month', InvoiceDate), '%Y-%m-%d') AS month,
         round(CAST(sum(CAST(Revenue AS DECIMAL(38,6))) AS DOUBLE), 2) AS revenue,
         count(DISTINCT CASE WHEN NOT IsReturn THEN InvoiceNo END) AS orders
  FROM counted GROUP BY 1
)"""

_COUNTRIES = """
countries AS (
  SELECT Country, round(CAST(sum(CAST(Revenue AS DECIMAL(38,6))) AS DOUBLE), 2) AS revenue,
         count(DISTINCT CASE WHEN NOT IsReturn THEN InvoiceNo END) AS orders
  FROM counted GROUP BY Country
)"""

_REPEAT = """
per_customer AS (
  SELECT CustomerID, count(DISTINCT InvoiceNo) AS orders FROM sales GROUP BY CustomerID
),
repeats AS (
  SELECT count(*) AS customers, count(*) FILTER (WHERE orders >= 2) AS repeat_customers,
         round(count(*) FILTER (WHERE orders >= 2) / count(*), 4) AS repeat_rate
  FROM per_customer
)"""

_WEEKDAYS = """
weekdays AS (
  SELECT d.weekday, coalesce(round(CAST(sum(CAST(Revenue AS DECIMAL(38,6))) AS DOUBLE), 2), 0.0) AS revenue
  FROM (SELECT unnest(range(7)) AS weekday) d
  LEFT JOIN counted ON isodow(InvoiceDate) - 1 = d.weekday GROUP BY d.weekday
)"""

_RFM = _LINES + """,
totals AS (
  SELECT CustomerID, max(InvoiceDate) FILTER (WHERE NOT IsReturn) AS last_sale,
         count(DISTINCT InvoiceNo) FILTER (WHERE NOT IsReturn) AS frequency,
         CAST(sum(CAST(Revenue AS DECIMAL(38,6))) AS DOUBLE) AS monetary
  FROM counted GROUP BY CustomerID
),
rfm AS (
  SELECT CustomerID,
         CAST(floor(date_diff('second', last_sale, max(last_sale) OVER ()) / 86400) AS BIGINT)
           AS recency, frequency, monetary
  FROM totals WHERE last_sale IS NOT NULL
),
scaled AS (
  SELECT CustomerID, recency AS days,
         (recency - avg(recency) OVER ()) / stddev_pop(recency) OVER () AS recency,
         (frequency - avg(frequency) OVER ()) / stddev_pop(frequency) OVER () AS frequency,
         (monetary - avg(monetary) OVER ()) / stddev_pop(monetary) OVER () AS monetary
  FROM rfm
)
"""

_REQUESTS = """WITH requests AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS actor,
         CASE user_id % 4 WHEN 0 THEN 'viewer' WHEN 1 THEN 'analyst' WHEN 2 THEN 'admin'
           ELSE 'guest' END AS role,
         CASE event_type WHEN 'view' THEN 'revenue' WHEN 'click' THEN 'products'
           WHEN 'purchase' THEN 'customers' WHEN 'signup' THEN 'time' ELSE 'ledger' END AS view
  FROM events
),
decided AS (
  SELECT *,
         CASE WHEN view = 'customers' THEN 'analyst' WHEN view <> 'ledger' THEN 'viewer' END
           AS minimum_role,
         CASE WHEN view = 'ledger' OR role = 'guest' THEN NULL
           ELSE view <> 'customers' OR role <> 'viewer' END AS allowed
  FROM requests
)
"""


def _pads() -> tuple[str, str]:
    padded = KEY.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in padded).hex(), bytes(b ^ 0x5C for b in padded).hex()


def _hmac(text: str) -> str:
    inner, outer = _pads()
    first = f"unhex(sha256(unhex('{inner}') || CAST({text} AS BLOB)))"
    return f"sha256(unhex('{outer}') || {first})"


_VISIBLE = """InvoiceNo, StockCode, Description, Quantity,
  strftime(InvoiceDate, '%Y-%m-%d %H:%M') AS InvoiceDate, UnitPrice, CustomerID, Country, ord,
  IsCancellation, IsAdjustment, IsReturn, Revenue, IsNonProduct"""

_GROUPS = _LINES + """,
sizes AS (
  SELECT StockCode, IsReturn, count(DISTINCT CustomerID) AS cohort_size,
         count(DISTINCT CustomerID) >= 7 AS allowed
  FROM lines GROUP BY StockCode, IsReturn
)
"""


def _chain(events: str, chain: str, name: str) -> str:
    """CTEs that link numbered events (id, chain, payload) within their chains."""
    return f"""
{name}_numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {chain} ORDER BY id) AS place FROM {events}
),
{name} AS (
  SELECT id, {chain} AS link_chain, place, CAST(NULL AS VARCHAR) AS previous_hash,
         sha256(chr(0) || payload) AS event_hash
  FROM {name}_numbered WHERE place = 1
  UNION ALL
  SELECT n.id, n.{chain}, n.place, c.event_hash, sha256(c.event_hash || chr(0) || n.payload)
  FROM {name} c JOIN {name}_numbered n ON n.{chain} = c.link_chain AND n.place = c.place + 1
)"""


_EVENTS = f"""WITH RECURSIVE typed AS (
  SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS timestamp,
         CAST(user_id AS VARCHAR) AS actor,
         CASE event_type WHEN 'signup' THEN 'login_success' WHEN 'error' THEN 'login_failure'
           WHEN 'view' THEN 'protected_store_read' WHEN 'purchase' THEN 'protected_store_write'
           ELSE 'audit_log_verified' END AS action,
         CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome,
         nullif(event_type, 'click') AS resource,
         replace(props, ' ', '') AS details_json
  FROM events
),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY timestamp, event_id) AS id FROM typed
),
chained AS (
  SELECT *, (id - 1) // {CHAIN_ROWS} AS chain,
         timestamp || chr(0) || actor || chr(0) || action || chr(0) || outcome || chr(0)
           || coalesce(resource, '') || chr(0) || details_json AS payload
  FROM numbered
),{_chain("chained", "chain", "links")},
audit AS (
  SELECT n.id, n.chain, timestamp, actor, action, outcome, resource, details_json,
         l.previous_hash, l.event_hash, payload
  FROM chained n JOIN links l ON n.id = l.id
)
"""

# Nodes over the heads of closed chains, of the log as it is and of one with another actor.
_RANGES = f"""{_EVENTS},
changed AS (
  SELECT id, chain, timestamp || chr(0) || CASE actor WHEN '7' THEN '8' ELSE actor END || chr(0) || action
           || chr(0) || outcome || chr(0) || coalesce(resource, '') || chr(0) || details_json AS payload
  FROM chained
),{_chain("changed", "chain", "changed_links")},
heads AS (
  SELECT 'kept' AS log, chain, max_by(event_hash, id) AS head FROM audit GROUP BY chain
  UNION ALL
  SELECT 'rewritten', link_chain, max_by(event_hash, id) FROM changed_links GROUP BY link_chain
),
sizes AS (
  SELECT greatest(0, (count(*) - 1) // {CHAIN_ROWS}) AS size,
         greatest(0, (count(*) FILTER (WHERE timestamp < '{CUTOFF}') - 1) // {CHAIN_ROWS}) AS kept_size
  FROM audit
),
nodes AS (
  SELECT log, 0 AS level, chain AS place, sha256('leaf' || chr(0) || chain || chr(0) || head) AS hash
  FROM heads, sizes WHERE chain < size
  UNION ALL
  SELECT log, level + 1, place // 2,
         sha256('node' || chr(0) || min_by(hash, place) || chr(0) || max_by(hash, place))
  FROM nodes GROUP BY log, level, place // 2 HAVING count(*) = 2
),
roots AS (
  SELECT log, n, sha256('root' || chr(0) || n || coalesce(string_agg(chr(0) || hash, '' ORDER BY level DESC), '')) AS root
  FROM (SELECT DISTINCT log, n FROM (VALUES ('kept'), ('rewritten')) l(log),
        (SELECT size AS n FROM sizes UNION SELECT kept_size FROM sizes))
  LEFT JOIN nodes USING (log)
  WHERE place IS NULL OR ((n >> level) & 1 = 1 AND place = (n >> level) - 1)
  GROUP BY log, n
)
"""

_DAYS = f"InvoiceDate >= DATE '{FROM_DAY}' AND InvoiceDate < DATE '{TO_DAY}' + INTERVAL 1 DAY"

_UNTIDY_KEPT = f"""{_UNTIDY},
usable AS (SELECT * FROM untidy WHERE CustomerID IS NOT NULL),{_tagged("usable", "tagged")},
{_paired("tagged", "paired")}
"""


def _stage_metrics() -> str:
    before = {
        ("type_coercion", "rows_in"): "count(*)",
        ("type_coercion", "rows_out"): "count(*)",
        ("type_coercion", "quantity_missing"): "count(*) FILTER (WHERE l_linenumber = 6)",
        ("type_coercion", "quantity_uncoerced"): "count(*) FILTER (WHERE l_linenumber IN (5, 7))",
        ("type_coercion", "unit_price_missing"): "count(*) FILTER (WHERE l_linenumber = 5)",
        ("type_coercion", "unit_price_uncoerced"):
            "count(*) FILTER (WHERE l_linenumber IN (3, 4))",
        ("type_coercion", "customer_id_missing"): "0 * count(*)",
        ("type_coercion", "customer_id_uncoerced"):
            "count(*) FILTER (WHERE l_linenumber IN (4, 5))",
        ("type_coercion", "invoice_date_missing"): "count(*) FILTER (WHERE l_linenumber = 6)",
        ("type_coercion", "invoice_date_uncoerced"): "count(*) FILTER (WHERE l_linenumber = 5)",
        ("null_customer_drop", "rows_in"): "count(*)",
        ("null_customer_drop", "customer_id_rows_dropped"):
            "count(*) FILTER (WHERE CustomerID IS NULL)",
    }
    keyless = (
        "(StockCode IS NULL OR InvoiceNo IS NULL OR UnitPrice IS NULL OR coalesce(Quantity, 0) = 0)"
    )
    plain = "NOT IsReturn AND NOT IsCancellation AND NOT IsAdjustment"
    tagging = {
        "cancellations": "IsCancellation",
        "adjustments": "IsAdjustment",
        "returns": "IsReturn",
        "paired_cancellations": "IsCancellation AND PairedInvoiceNo IS NOT NULL",
        "unpaired_cancellations": "IsCancellation AND PairedInvoiceNo IS NULL",
        "paired_returns": "IsReturn AND PairedInvoiceNo IS NOT NULL",
        "unpaired_returns": "IsReturn AND PairedInvoiceNo IS NULL",
        "pairing_ineligible_returns": f"IsReturn AND (InvoiceDate IS NULL OR {keyless})",
        "pairing_ineligible_originals":
            f"{plain} AND (InvoiceDate IS NULL OR ({keyless} AND Quantity > 0))",
        "cancellations_without_negative_quantity":
            "IsCancellation AND NOT coalesce(Quantity < 0, false)",
    }
    after = {("null_customer_drop", "rows_out"): "count(*)"}
    for stage in ("cancellation_tagging", "revenue_derivation", "non_product_tagging"):
        after[(stage, "rows_in")] = after[(stage, "rows_out")] = "count(*)"
    for name, condition in tagging.items():
        after[("cancellation_tagging", name)] = f"count(*) FILTER (WHERE {condition})"
    after[("revenue_derivation", "negative_revenue_rows")] = "count(*) FILTER (WHERE Revenue < 0)"
    after[("revenue_derivation", "zero_revenue_rows")] = "count(*) FILTER (WHERE Revenue = 0)"
    after[("non_product_tagging", "non_product_rows")] = "count(*) FILTER (WHERE IsNonProduct)"
    selects = [
        f"SELECT '{stage}' AS stage, '{metric}' AS metric, CAST({count} AS BIGINT) AS value "
        f"FROM {source}"
        for source, counts in (("untidy", before), ("paired", after))
        for (stage, metric), count in counts.items()
    ]
    return _UNTIDY_KEPT + " UNION ALL ".join(selects)


_DISTANCES = """,
banded AS (
  SELECT *, CASE WHEN days < 50 THEN 0 WHEN days < 150 THEN 1 ELSE 2 END AS band FROM scaled
),
moments AS (
  SELECT band AS other, count(*) AS n, sum(recency) AS r, sum(frequency) AS f, sum(monetary) AS m,
         sum(power(recency, 2) + power(frequency, 2) + power(monetary, 2)) AS q
  FROM banded GROUP BY band
),
means AS (
  SELECT CustomerID, band = other AS own,
         (n * (power(b.recency, 2) + power(b.frequency, 2) + power(b.monetary, 2))
           - 2 * (b.recency * r + b.frequency * f + b.monetary * m) + q)
         / (n - CASE WHEN band = other THEN 1 ELSE 0 END) AS mean
  FROM banded b, moments
),
sides AS (
  SELECT CustomerID, max(mean) FILTER (WHERE own) AS a, min(mean) FILTER (WHERE NOT own) AS b
  FROM means GROUP BY CustomerID
)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette_squared FROM sides"""

_PAIRS_OF_CUSTOMERS = """,
banded AS (
  SELECT *, CASE WHEN days < 50 THEN 0 WHEN days < 150 THEN 1 ELSE 2 END AS band FROM scaled
),
means AS (
  SELECT one.CustomerID, one.band = other.band AS own,
         sum(sqrt(power(one.recency - other.recency, 2) + power(one.frequency - other.frequency, 2)
                  + power(one.monetary - other.monetary, 2)))
           / (count(*) - CASE WHEN one.band = other.band THEN 1 ELSE 0 END) AS mean
  FROM banded one, banded other GROUP BY one.CustomerID, one.band, other.band
),
sides AS (
  SELECT CustomerID, max(mean) FILTER (WHERE own) AS a, min(mean) FILTER (WHERE NOT own) AS b
  FROM means GROUP BY CustomerID
)
SELECT round(avg((b - a) / greatest(a, b)), 4) AS silhouette FROM sides"""


def _squares(point: str, centre: str) -> str:
    return " + ".join(f"({point}[{i}] - {centre}[{i}]) * ({point}[{i}] - {centre}[{i}])" for i in (1, 2, 3))


# K-Means with the draws and the whole-number steps of the operator: ten starts for all customers
# (fit 0) and for those that are not held out (fit 1).
_SEGMENTS = f"""{_RFM.replace("WITH ", "WITH RECURSIVE ", 1)},
placed AS (
  SELECT CustomerID, row_number() OVER (ORDER BY md5(CustomerID || '|{HOLDOUT_SEED}'), CustomerID) AS place,
         [CAST(floor(recency * 10000 + 0.5) AS BIGINT), CAST(floor(frequency * 10000 + 0.5) AS BIGINT),
          CAST(floor(monetary * 10000 + 0.5) AS BIGINT)] AS q
  FROM scaled
),
held AS (
  SELECT count(*) AS customers, CAST(round_even(count(*) * {HOLDOUT_FRACTION}, 0) AS BIGINT) AS holdout FROM placed
),
members AS (
  SELECT fit, CustomerID, q FROM placed, held, range(2) f(fit)
  WHERE fit = 0 OR place <= customers - holdout
),
seeds AS (
  SELECT fit, start, 0 AS step, CAST([] AS BIGINT[][]) AS cs FROM range(2) f(fit), range({KMEANS_STARTS}) s(start)
  UNION ALL
  SELECT fit, start, step + 1, list_append(cs, arg_min(q, race)) FROM (
    SELECT s.fit, s.start, s.step, s.cs, m.q,
           -ln((CAST('0x' || substr(md5(CustomerID || '|{KMEANS_SEED}|' || s.start || '|' || s.step), 1, 13)
                     AS BIGINT) + 1) / 4503599627370496.0)
             / nullif(coalesce(list_min(list_transform(s.cs, lambda c: {_squares("m.q", "c")})), 1), 0) AS race
    FROM seeds s JOIN members m ON m.fit = s.fit WHERE s.step < {DEFAULT_CLUSTERS}
  ) GROUP BY fit, start, step, cs
),
steps AS (
  SELECT fit, start, 0 AS step, cs, CAST(NULL AS HUGEINT) AS cost, false AS done
  FROM seeds WHERE step = {DEFAULT_CLUSTERS}
  UNION ALL
  SELECT fit, start, step + 1, moved, cost,
         list_sum(list_transform(range(1, {DEFAULT_CLUSTERS} + 1), lambda j: {_squares("moved[j]", "cs[j]")})) <= 10000
  FROM (
    SELECT fit, start, step, cs, sum(cost) AS cost,
           list_transform(range(1, {DEFAULT_CLUSTERS} + 1), lambda j: coalesce(map(list(place), list(centre))[j], cs[j])) AS moved
    FROM (
      SELECT fit, start, step, cs, place, sum(least) AS cost,
             [CAST(floor((2 * sum(q[1]) + count(*)) / (2 * count(*))) AS BIGINT),
              CAST(floor((2 * sum(q[2]) + count(*)) / (2 * count(*))) AS BIGINT),
              CAST(floor((2 * sum(q[3]) + count(*)) / (2 * count(*))) AS BIGINT)] AS centre
      FROM (
        SELECT fit, start, step, cs, q, list_min(ds) AS least, list_position(ds, list_min(ds)) AS place
        FROM (
          SELECT s.fit, s.start, s.step, s.cs, m.q, list_transform(s.cs, lambda c: {_squares("m.q", "c")}) AS ds
          FROM steps s JOIN members m ON m.fit = s.fit WHERE NOT s.done AND s.step < 100
        )
      ) GROUP BY fit, start, step, cs, place
    ) GROUP BY fit, start, step, cs
  )
),
best AS (
  SELECT fit, list_sort(cs) AS cs FROM (
    SELECT *, row_number() OVER (PARTITION BY fit ORDER BY cost, start) AS rank FROM steps WHERE done
  ) WHERE rank = 1
),
labels AS (
  SELECT CustomerID, fit, list_position(ds, list_min(ds)) - 1 AS label FROM (
    SELECT p.CustomerID, b.fit, list_transform(b.cs, lambda c: {_squares("p.q", "c")}) AS ds FROM placed p, best b
  )
),
labelled AS (
  SELECT a.CustomerID, CAST(a.label AS BIGINT) AS cluster, b.label AS refit
  FROM labels a JOIN labels b ON a.CustomerID = b.CustomerID AND a.fit = 0 AND b.fit = 1
),
cells AS (SELECT cluster, refit, count(*) AS n FROM labelled GROUP BY ALL),
pairs AS (
  SELECT (SELECT sum(CAST(n AS DOUBLE) * (n - 1) / 2) FROM cells) AS together,
         (SELECT sum(CAST(n AS DOUBLE) * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY cluster)) AS a,
         (SELECT sum(CAST(n AS DOUBLE) * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY refit)) AS b,
         (SELECT CAST(customers AS DOUBLE) * (customers - 1) / 2 FROM held) AS every
),
agreement AS (
  SELECT (together - a * b / every) / ((a + b) / 2 - a * b / every) AS score FROM pairs
),
sizes AS (SELECT cluster, count(*) AS n FROM labelled GROUP BY cluster),
kept_clusters AS (SELECT cluster FROM sizes WHERE n >= {SMALL_GROUP_THRESHOLD}),
segmented AS (
  SELECT CustomerID, r.recency, r.frequency, r.monetary, l.cluster
  FROM rfm r JOIN labelled l USING (CustomerID) WHERE l.cluster IN (SELECT cluster FROM kept_clusters)
)
"""

_COUNTRY_SQL = f"{_LINES},{_COUNTRIES} SELECT * FROM countries"
_REVENUE_COUNTS = (
    "'{\"adjustments\":' || adjustments || ',\"returns_value\":' "
    "|| CAST(round(refunded, 0) AS BIGINT) || '}'"
)

ORACLES: dict[str, str] = {
    "revenue_summary": f"""{_LINES},{_SUMMARY}
SELECT round(gross, 2) AS gross_revenue, round(gross + refunded, 2) AS net_revenue,
       round(refunded, 2) AS returns_value, orders, round(gross / orders, 2) AS aov, line_items,
       adjustments FROM summary""",
    "top_products_by_revenue": f"{_PRODUCTS} SELECT * FROM top_revenue",
    "top_products_by_quantity": f"""{_PRODUCTS}
SELECT StockCode, Description, round(Revenue, 2) AS Revenue, Quantity
FROM products ORDER BY Quantity DESC, StockCode LIMIT 10""",
    "product_return_rates": f"""{_LINES},
sold AS (SELECT StockCode, sum(Quantity) AS sold FROM sales GROUP BY StockCode),
back AS (SELECT StockCode, sum(Quantity) AS back FROM counted WHERE IsReturn GROUP BY StockCode)
SELECT StockCode, CASE WHEN sold > 0 THEN round(abs(coalesce(back, 0)) / sold, 9) END AS return_rate
FROM sold LEFT JOIN back USING (StockCode)""",
    "monthly_revenue": f"{_LINES},{_MONTHLY} SELECT * FROM monthly",
    "weekday_revenue": f"{_LINES},{_WEEKDAYS} SELECT weekday, revenue FROM weekdays",
    "country_metrics": _COUNTRY_SQL,
    "repeat_rate": f"{_LINES},{_REPEAT} SELECT * FROM repeats",
    "type_coercion": f"""{_UNTIDY}
SELECT InvoiceNo, StockCode, Description, Quantity,
       strftime(InvoiceDate, '%Y-%m-%d %H:%M') AS InvoiceDate, UnitPrice, CustomerID, Country, ord
FROM untidy""",
    "cleaned_lines": f"""{_LINES},{_paired("lines", "paired")}
SELECT {_VISIBLE}, PairedInvoiceNo FROM paired""",
    "stage_metrics": _stage_metrics(),
    "return_pairs": f"""{_LINES},{_paired("lines", "paired")}
SELECT {_PAIR_COLUMNS} FROM paired WHERE IsReturn""",
    "untidy_return_pairs": f"{_UNTIDY_KEPT} SELECT {_PAIR_COLUMNS} FROM paired WHERE IsReturn",
    "row_numbers": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS row FROM events",
    "filtered_lines": f"""{_LINES}
SELECT InvoiceNo, StockCode, Country, strftime(InvoiceDate, '%Y-%m-%d') AS InvoiceDate, Revenue
FROM lines WHERE {_DAYS} AND Country IN ('NATION_1', 'NATION_2', 'NATION_3')
  AND StockCode IN ('POST', '1', '12', '123')""",
    "lines_of_members": f"""{_RFM}
SELECT InvoiceNo, CustomerID, ord FROM lines
WHERE CustomerID IN (SELECT CustomerID FROM rfm WHERE frequency >= 12)""",
    "country_options": f"{_LINES} SELECT DISTINCT Country FROM lines",
    "stock_code_options":
        f"{_LINES} SELECT DISTINCT StockCode FROM lines",
    "date_bounds": f"""{_LINES}
SELECT strftime(min(InvoiceDate), '%Y-%m-%d') AS first_day,
       strftime(max(InvoiceDate), '%Y-%m-%d') AS last_day FROM lines""",
    "rfm_table": f"""{_RFM}
SELECT CustomerID, recency, frequency, round(monetary, 2) AS monetary FROM rfm""",
    "rfm_standardized": f"""{_RFM}
SELECT CustomerID, round(recency, 6) AS recency, round(frequency, 6) AS frequency,
       round(monetary, 6) AS monetary FROM scaled""",
    "segment_facts": f"""{_RFM}
SELECT count(*) AS customers, CAST(round(count(*) * 0.1) AS BIGINT) AS holdout,
       CAST(0.7 AS DOUBLE) AS threshold, 1 AS stability_rows, true AS score_in_range,
       true AS small_clusters_gone, true AS kept_as_reported FROM rfm""",
    "customer_silhouettes": _RFM + _DISTANCES,
    "silhouette_euclidean": _RFM + _PAIRS_OF_CUSTOMERS,
    "rfm_segments": f"""{_SEGMENTS}
SELECT CustomerID, recency, frequency, round(monetary, 2) AS monetary, cluster,
       round(score, 9) AS stability_score, holdout AS stability_holdout_size,
       CAST({STABILITY_THRESHOLD} AS DOUBLE) AS stability_threshold,
       score >= {STABILITY_THRESHOLD} AS stability_flag, '' AS stability_reason
FROM segmented, agreement, held""",
    "chart_segments": f"""{_SEGMENTS}
SELECT 'rfm_scatter' AS kind,
       'Customers grouped by recency, frequency and monetary value. Adjusted Rand index '
         || format('{{:.2f}}', score) || ' against a refit without ' || holdout || ' customers ('
         || CASE WHEN score >= {STABILITY_THRESHOLD} THEN 'stable' ELSE 'unstable' END || ').' AS formula,
       '{{"clusters_rendered":' || (SELECT count(*) FROM kept_clusters) || ',"small_group_clusters":'
         || ((SELECT count(*) FROM sizes) - (SELECT count(*) FROM kept_clusters)) || ',"stability_flag":'
         || (score >= {STABILITY_THRESHOLD}) || ',"stability_holdout_size":' || holdout
         || ',"stability_reason":null,"stability_score":' || score || '}}' AS exclusions,
       '{{"customers":"those with an id and a dated sale",'
         || '"monetary":"sales less returns, no adjustments"}}' AS filters,
       (SELECT count(*) FROM segmented) AS row_count
FROM agreement, held""",
    "adjusted_rand": """WITH cells AS (
  SELECT c_mktsegment, n_regionkey, count(*) AS n
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
),
counts AS (
  SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS together,
         (SELECT sum(m * (m - 1) / 2) FROM
           (SELECT sum(n) AS m FROM cells GROUP BY c_mktsegment)) AS a,
         (SELECT sum(m * (m - 1) / 2) FROM
           (SELECT sum(n) AS m FROM cells GROUP BY n_regionkey)) AS b,
         (SELECT sum(n) FROM cells) AS total
)
SELECT round((together - a * b / (total * (total - 1) / 2))
       / ((a + b) / 2 - a * b / (total * (total - 1) / 2)), 9) AS adjusted_rand FROM counts""",
    "pseudonymized_lines": f"""{_LINES}
SELECT InvoiceNo, {_hmac("CustomerID")} AS CustomerID, ord FROM lines""",
    "pseudonymized_customers":
        f"SELECT c_name, {_hmac('CAST(c_custkey AS VARCHAR)')} AS pseudonym FROM customer",
    "access_decisions": f"""{_REQUESTS}
SELECT event_id, actor, role, view, minimum_role, allowed,
       CASE WHEN view = 'ledger' THEN 'unknown_view' WHEN role = 'guest' THEN 'unknown_role'
         WHEN allowed THEN 'role_ok' ELSE 'role_insufficient' END AS reason
FROM decided""",
    "access_audit_events": f"""{_REQUESTS}
SELECT event_id, actor,
       CASE WHEN allowed THEN 'protected_store_read' ELSE 'access_denied' END AS action,
       CASE WHEN allowed THEN 'success' ELSE 'failure' END AS outcome, view AS resource,
       '{{"actor_role":"' || role || '","minimum_role":"' || minimum_role || '","reason":"'
         || CASE WHEN allowed THEN 'role_ok' ELSE 'role_insufficient' END || '"}}' AS details_json
FROM decided WHERE allowed IS NOT NULL""",
    "viewer_products_view": f"""{_LINES}
SELECT StockCode, Description, Quantity, UnitPrice, Revenue, IsReturn, IsAdjustment FROM lines""",
    "small_groups": f"{_GROUPS} SELECT * FROM sizes",
    "lines_of_large_groups": f"""{_GROUPS}
SELECT InvoiceNo, StockCode, IsReturn, CustomerID, ord
FROM lines JOIN sizes USING (StockCode, IsReturn) WHERE allowed""",
    "suppression_events": f"""{_GROUPS}
SELECT 'access_denied' AS action, 'failure' AS outcome, 'stock_' || StockCode AS resource,
       '{{"actor_role":"viewer","cohort_size":' || cohort_size
         || ',"reason":"small_group_suppressed","threshold":7}}' AS details_json
FROM sizes WHERE NOT allowed""",
    "snapshot_round_trip": f"""{_LINES}
SELECT {_VISIBLE.replace("CustomerID", _hmac("CustomerID") + " AS CustomerID")} FROM lines""",
    "snapshot_time_view": f"""{_LINES}
SELECT InvoiceNo, strftime(InvoiceDate, '%Y-%m-%d %H:%M') AS InvoiceDate, Quantity, UnitPrice,
       Revenue, IsReturn, IsAdjustment FROM lines""",
    "snapshot_list": f"""{_LINES}
SELECT count(*) AS lines, '20260101T000000Z,20260102T000000Z' AS ids FROM lines WHERE IsReturn""",
    "bootstrap_country_metrics": _COUNTRY_SQL,
    "audit_chain": f"{_EVENTS} SELECT * EXCLUDE (payload) FROM audit",
    "audit_appended": f"{_EVENTS} SELECT id, chain, event_hash FROM audit",
    "audit_problems": f"""{_EVENTS},
left_over AS (
  SELECT *, lag(event_hash) OVER (PARTITION BY chain ORDER BY id) AS expected
  FROM audit WHERE details_json <> '{{"k":13}}'
)
SELECT id, CASE WHEN previous_hash IS DISTINCT FROM expected THEN 'previous_hash mismatch'
  ELSE 'event_hash mismatch' END AS problem
FROM left_over WHERE previous_hash IS DISTINCT FROM expected OR actor = '7'""",
    "audit_lost_chain": f"""{_EVENTS},
whole AS (SELECT chain, min(id) AS first_id, count(*) AS n FROM audit GROUP BY chain),
rest AS (SELECT chain, count(*) AS n FROM audit WHERE chain <> 1 AND id <> 1000 GROUP BY chain)
SELECT first_id AS id, CASE WHEN rest.n IS NULL THEN 'chain is missing'
  ELSE 'chain differs from the manifest' END AS problem
FROM whole LEFT JOIN rest USING (chain) WHERE rest.n IS DISTINCT FROM whole.n""",
    "audit_bad_times": """SELECT event_id,
  CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'
    WHEN 1 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS timestamp,
  CASE WHEN event_id % 4 > 1 THEN 'no time zone or no time' END AS problem
FROM events""",
    "audit_seal": f"""{_EVENTS},
heads AS (SELECT chain, max_by(event_hash, id) AS h FROM audit GROUP BY chain)
SELECT sha256(string_agg(h, chr(0) ORDER BY chain)) AS seal FROM heads""",
    "audit_purged": f"""{_EVENTS},
late AS (SELECT id, chain, payload FROM audit WHERE timestamp >= '{CUTOFF}'),
{_chain("late", "chain", "relinked")}
SELECT id, link_chain AS chain, previous_hash, event_hash FROM relinked""",
    "audit_store_appended": f"{_EVENTS} SELECT id, chain, actor, previous_hash, event_hash FROM audit",
    "audit_store_purged": f"""{_EVENTS},
late AS (SELECT id, chain, payload FROM audit WHERE timestamp >= '{CUTOFF}'),
{_chain("late", "chain", "relinked")}
SELECT id, link_chain AS chain, previous_hash, event_hash,
       (SELECT min(timestamp) FROM audit WHERE timestamp >= '{CUTOFF}') AS first_on_disk FROM relinked""",
    "audit_store_manifest": f"""{_EVENTS},
late AS (SELECT id, payload FROM audit WHERE timestamp >= '{CUTOFF}'),
more AS (
  SELECT id, payload FROM late UNION ALL
  SELECT (SELECT count(*) FROM audit) + row_number() OVER (ORDER BY id), payload FROM late
),
dealt AS (SELECT id, (id - 1) // {CHAIN_ROWS} AS chain, payload FROM more),
{_chain("dealt", "chain", "relinked")}
SELECT link_chain AS chain, min(id) AS first_id, max(id) AS last_id, count(*) AS rows,
       max_by(event_hash, id) AS head FROM relinked GROUP BY link_chain""",
    "audit_nodes": f"{_RANGES} SELECT level, place, hash FROM nodes WHERE log = 'kept'",
    "audit_seals_compared": f"""{_RANGES}
SELECT r.log, kept_size, k.root AS kept_root, size, r.root AS root, o.root = k.root AS adds
FROM sizes, roots r, roots k, roots o
WHERE r.n = size AND k.log = 'kept' AND k.n = kept_size AND o.log = r.log AND o.n = kept_size""",
    "audit_of_operators": f"""{_SEGMENTS},
cohorts AS (
  SELECT StockCode, IsReturn, count(DISTINCT CustomerID) AS n FROM lines GROUP BY ALL
),
said AS (
  SELECT 1 AS step, 'pipeline' AS actor, 'protected_store_write' AS action, 'success' AS outcome,
         '20260101T000000Z' AS resource,
         '{{"actor_role":"pipeline","columns":14,"rows":' || (SELECT count(*) FROM lines) || '}}' AS details
  UNION ALL SELECT 2, 'alice', 'protected_store_read', 'success', 'time',
         '{{"actor_role":"viewer","minimum_role":"viewer","reason":"role_ok"}}'
  UNION ALL SELECT 3, 'alice', 'access_denied', 'failure', 'customers',
         '{{"actor_role":"viewer","minimum_role":"analyst","reason":"role_insufficient"}}'
  UNION ALL SELECT 4, 'alice', 'access_denied', 'failure', coalesce(StockCode, '') || '_' || IsReturn,
         '{{"actor_role":"viewer","cohort_size":' || n || ',"reason":"small_group_suppressed","threshold":7}}'
  FROM cohorts WHERE n < 7
  UNION ALL SELECT 5, 'pipeline', 'access_denied', 'failure', 'rfm_cluster_' || cluster,
         '{{"actor_role":"pipeline","cohort_size":' || n || ',"reason":"small_group_suppressed","threshold":200}}'
  FROM sizes WHERE n < 200
  UNION ALL SELECT 6, 'pipeline', 'protected_store_read', 'success', 'rfm_segments', CAST(customers AS VARCHAR) FROM held
  UNION ALL SELECT 7, 'pipeline', 'audit_log_verified', 'success', 'audit', '{{"actor_role":"pipeline"}}'
)
SELECT row_number() OVER (ORDER BY step, action, resource, details) AS id, * EXCLUDE (step) FROM said""",
    "audit_recent": f"""{_EVENTS}
SELECT id, timestamp, actor, action, outcome, resource, details_json
FROM audit WHERE timestamp >= '{CUTOFF}' ORDER BY id LIMIT 500""",
    "audit_stored": f"""{_EVENTS}
SELECT id, timestamp, actor, action, outcome, resource, details_json
FROM audit WHERE timestamp >= '{CUTOFF}'""",
    "metric_use_event": f"""{_LINES},{_REPEAT}
SELECT 'pipeline' AS actor, 'protected_store_read' AS action, 'success' AS outcome,
       'repeat_rate' AS resource,
       '{{"actor_role":"pipeline","customers":' || customers || ',"repeat_customers":'
         || repeat_customers || ',"repeat_rate":' || repeat_rate || '}}' AS details_json
FROM repeats""",
    "capped_files": f"""WITH {_LEGS}
SELECT Country AS place, count(*) AS rows, 'too_large' AS below, 'accepted' AS "at" FROM plain GROUP BY Country""",
    "ingested_files": f"""WITH {_LEGS}
SELECT InvoiceNo, StockCode, Description, CAST(Quantity AS VARCHAR) AS Quantity,
       strftime(InvoiceDate, '%-m/%-d/%Y ') || hour(InvoiceDate) || strftime(InvoiceDate, ':%M')
         AS InvoiceDate,
       CAST(CAST(UnitPrice AS DECIMAL(18,2)) AS VARCHAR) AS UnitPrice,
       CASE o_custkey % 20 WHEN 0 THEN NULL WHEN 1 THEN 'x' || o_custkey
         ELSE CAST(o_custkey AS VARCHAR) END AS CustomerID, Country
FROM plain""",
    "file_verdicts": f"""WITH {_LEGS}
SELECT DISTINCT 'home=' || Country AS place, 'accepted' AS verdict, 'UTF-8' AS encoding FROM plain
UNION ALL SELECT 'nation', 'schema_violation', 'UTF-8'
UNION ALL SELECT 'part', 'unsupported_extension', 'ISO-8859-1'""",
    "header_verdicts": f"""WITH {_LEGS}
SELECT DISTINCT 'Country=' || Country AS place,
       CASE WHEN CAST(regexp_extract(Country, '([0-9]+)$', 1) AS INTEGER) % 6 < 2 THEN 'accepted'
         ELSE 'schema_violation' END AS verdict FROM plain
UNION ALL SELECT 'none', 'empty'""",
    "formula_issues": f"""{_UNTIDY}
SELECT ord, 3 AS position, 'Description' AS column, 'FORMULA_INJECTION' AS code,
       'error' AS severity
FROM untidy WHERE l_linenumber IN (1, 2, 3, 5)
UNION ALL
SELECT ord, 4, 'Quantity', 'FORMULA_INJECTION', 'error'
FROM untidy WHERE l_linenumber IN (2, 7) AND InvoiceNo LIKE 'C%'""",
    "quality_report": f"""{_UNTIDY}
SELECT count(*) AS total_rows,
       count(*) FILTER (WHERE l_linenumber NOT IN (1, 2, 3, 5)
         AND NOT (l_linenumber = 7 AND InvoiceNo LIKE 'C%')) AS accepted_rows,
       count(*) FILTER (WHERE l_linenumber IN (1, 2, 3, 5))
         + count(*) FILTER (WHERE l_linenumber IN (2, 7) AND InvoiceNo LIKE 'C%') AS error_count,
       CAST(0 AS BIGINT) AS warning_count, true AS has_errors
FROM untidy""",
    "streamed_lines": f"""{_LINES}
SELECT InvoiceNo, StockCode, Quantity, CustomerID, Revenue, IsReturn FROM lines""",
    "chart_month": f"{_LINES},{_MONTHLY} SELECT * FROM monthly",
    "chart_weekday": f"""{_LINES},{_WEEKDAYS}
SELECT weekday, revenue, {list(WEEKDAYS)}[weekday + 1] AS day FROM weekdays""",
    "chart_products": f"{_PRODUCTS} SELECT * FROM top_revenue",
    "chart_countries":
        f"{_LINES},{_COUNTRIES} SELECT * FROM countries ORDER BY revenue DESC, Country LIMIT 15",
    "chart_repeat_rate":
        f"{_LINES},{_REPEAT} SELECT round(repeat_rate * 100, 2) AS percent FROM repeats",
    "chart_explanations": f"""{_LINES},{_SUMMARY},{_MONTHLY},{_COUNTRIES},{_REPEAT}
SELECT 'revenue_by_month' AS kind, {_REVENUE_COUNTS} AS exclusions,
       (SELECT count(*) FROM monthly) AS row_count FROM summary
UNION ALL SELECT 'revenue_by_weekday', {_REVENUE_COUNTS}, 7 FROM summary
UNION ALL SELECT 'top_products_bar', '{{}}', 10
UNION ALL SELECT 'country_bar', '{{"lower_ranked_countries":'
  || greatest((SELECT count(*) FROM countries) - 15, 0) || '}}',
  least((SELECT count(*) FROM countries), 15)
UNION ALL SELECT 'repeat_rate_gauge', '{{"unidentified_customers":' || (
  SELECT count(DISTINCT InvoiceNo) FROM plain
  WHERE o_custkey % 20 <= 1 AND Quantity >= 0 AND InvoiceNo NOT LIKE 'A%') || '}}', customers
FROM repeats""",
    "dashboard_request": f"""{_LINES}
SELECT Country, round(CAST(sum(CAST(Revenue AS DECIMAL(38,6))) AS DOUBLE), 2) AS revenue,
       count(DISTINCT CASE WHEN NOT IsReturn THEN InvoiceNo END) AS orders
FROM counted WHERE {_DAYS} AND Country IN ('NATION_1', 'NATION_4') GROUP BY Country""",
}
ORACLES["return_pairs_in_blocks"] = ORACLES["return_pairs"]
