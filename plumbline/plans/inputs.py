"""Derived input tables with injected defects, in SQL that Spark and DuckDB both run.

The given tables are clean, so defects are derived from their rows; every statement covers a
whole table.
"""

DIRTY_ORDERS = """
SELECT o_orderkey AS order_id,
       o_custkey  AS customer_id,
       CASE WHEN o_orderkey % 97  = 1 THEN '31/02/2024'
            WHEN o_orderkey % 101 = 2 THEN 'garbage'
            WHEN o_orderkey % 103 = 3 THEN 'N/A'
            WHEN o_orderkey % 3 = 0 THEN concat(cast(year(o_orderdate) AS string), '-', lpad(cast(month(o_orderdate) AS string), 2, '0'), '-', lpad(cast(day(o_orderdate) AS string), 2, '0'))
            WHEN o_orderkey % 3 = 1 THEN concat(lpad(cast(day(o_orderdate) AS string), 2, '0'), '/', lpad(cast(month(o_orderdate) AS string), 2, '0'), '/', cast(year(o_orderdate) AS string))
            ELSE concat('Jan ', cast(1 + o_orderkey % 28 AS string), ', ', cast(year(o_orderdate) AS string)) END AS order_date_text,
       CASE WHEN o_orderkey % 89 = 4 THEN 'not available'
            WHEN o_orderkey % 83 = 5 THEN 'free'
            WHEN o_orderkey % 4 = 0 THEN concat('$', cast(cast(floor(o_totalprice / 1000) AS bigint) AS string), ',', lpad(cast(cast(floor(o_totalprice) AS bigint) % 1000 AS string), 3, '0'))
            WHEN o_orderkey % 4 = 1 THEN concat('USD ', cast(cast(floor(o_totalprice) AS bigint) AS string))
            WHEN o_orderkey % 4 = 2 THEN concat('(', cast(cast(floor(o_totalprice) AS bigint) AS string), ')')
            ELSE cast(cast(floor(o_totalprice) AS bigint) AS string) END AS amount_text,
       CASE WHEN o_orderkey % 11 = 0 THEN 'abc' ELSE cast(o_orderkey % 7 AS string) END AS qty_text,
       CASE WHEN o_orderkey % 19 = 0 THEN concat(' ', lower(o_orderpriority))
            WHEN o_orderkey % 23 = 0 THEN lower(o_orderpriority)
            WHEN o_orderkey % 29 = 0 THEN 'Unknown'
            ELSE o_orderpriority END AS priority,
       cast(o_orderkey % 130 AS int) AS age,
       cast(o_orderkey % 5 - CASE WHEN o_orderkey % 31 = 0 THEN 10 ELSE 0 END AS int) AS quantity,
       cast(o_orderkey % 1000 AS double) AS subtotal,
       cast(o_orderkey % 10 AS double) AS tax,
       CASE WHEN o_orderkey % 17 = 0 THEN cast(NULL AS double)
            WHEN o_orderkey % 13 = 0 THEN cast(o_orderkey % 1000 + o_orderkey % 10 + 1 AS double)
            ELSE cast(o_orderkey % 1000 + o_orderkey % 10 AS double) END AS total,
       'Y' AS const_flag,
       cast(NULL AS string) AS empty_note
FROM orders
UNION ALL
SELECT o_orderkey, o_custkey, '2024-01-15', '100', '1', 'dup', 30, 1, 10.0, 1.0, 11.0, 'Y', cast(NULL AS string)
FROM orders WHERE o_orderkey % 50 = 7
UNION ALL
SELECT o_orderkey, o_custkey, '2024-01-15', '100', '1', 'dup', 30, 1, 10.0, 1.0, 11.0, 'Y', cast(NULL AS string)
FROM orders WHERE o_orderkey % 50 = 7"""

DIRTY_CUSTOMER = """
SELECT CASE WHEN c_custkey % 200 = 9 THEN c_custkey - 1 ELSE c_custkey END AS customer_id,
       CASE WHEN c_custkey % 10 = 1 THEN concat('Person ', lpad(cast(c_custkey - 1 AS string), 6, '0'), 'x')
            WHEN c_custkey % 37 = 0 THEN concat('  Person  ', lpad(cast(c_custkey AS string), 6, '0'))
            ELSE concat('Person ', lpad(cast(c_custkey AS string), 6, '0')) END AS full_name,
       CASE WHEN c_custkey % 61 = 0 THEN 'kiran@'
            WHEN c_custkey % 67 = 0 THEN 'two@@example.com'
            WHEN c_custkey % 71 = 0 THEN cast(NULL AS string)
            WHEN c_custkey % 10 = 1 THEN concat('p', lpad(cast(c_custkey - 1 AS string), 6, '0'), '@example.com')
            ELSE concat('p', lpad(cast(c_custkey AS string), 6, '0'), '@example.com') END AS email,
       concat('+1 (555) ', lpad(cast(c_custkey % 1000 AS string), 3, '0'), '-', lpad(cast(c_custkey % 9973 AS string), 4, '0')) AS phone,
       CASE WHEN c_custkey % 6 = 0 THEN lower(c_mktsegment)
            WHEN c_custkey % 41 = 0 THEN 'N/A'
            ELSE c_mktsegment END AS segment,
       lpad(cast(c_custkey % 100 AS string), 5, '0') AS zip_code,
       c_acctbal AS balance
FROM customer"""

# People with varied names: every tenth repeats the previous one with a typo and the same
# e-mail or phone, and one switchboard number and one shared mailbox are used by very many.
CONTACTS = """
SELECT c_custkey AS contact_id,
       CASE WHEN c_custkey % 10 = 1 THEN concat(substr(md5(cast(c_custkey - 1 AS string)), 1, 12), 'x')
            ELSE substr(md5(cast(c_custkey AS string)), 1, 12) END AS full_name,
       CASE WHEN c_custkey % 3 = 0 THEN 'office@example.com'
            WHEN c_custkey % 10 = 1 THEN concat(substr(md5(cast(c_custkey - 1 AS string)), 1, 6), '@example.com')
            WHEN c_custkey % 17 = 0 THEN cast(NULL AS string)
            ELSE concat(substr(md5(cast(c_custkey AS string)), 1, 6), '@example.com') END AS email,
       CASE WHEN c_custkey % 4 = 0 THEN '+1 555 0100'
            ELSE concat('+1 555 ', lpad(cast(c_custkey % 9973 AS string), 6, '0')) END AS phone
FROM customer"""

# Orders whose reference table misses some customers.
LINKED_ORDERS = "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS amount FROM orders"
LINKED_CUSTOMERS = (
    "SELECT c_custkey AS customer_id, c_name AS name FROM customer WHERE c_custkey % 7 <> 0")

# Versions of one dataset over time: later versions lose and gain columns and shift.
ORDER_VERSIONS = {
    "1997": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority"
            " FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00'",
    "1998": "SELECT o_orderkey, o_custkey, o_totalprice * 1.5 AS o_totalprice,"
            " CASE WHEN o_orderkey % 5 = 0 THEN cast(NULL AS string) ELSE lower(o_orderstatus) END"
            " AS o_orderstatus, 'web' AS channel"
            " FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'",
    "1999": "SELECT o_orderkey, cast(o_custkey AS string) AS o_custkey, o_totalprice * 1.5 AS o_totalprice,"
            " CASE WHEN o_orderkey % 5 = 0 THEN cast(NULL AS string) ELSE lower(o_orderstatus) END"
            " AS o_orderstatus, 'web' AS channel"
            " FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'",
}
