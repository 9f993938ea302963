"""groovehouse: retail and supply-chain analytics for a record shop, on Spark.

DataFrame-in / DataFrame-out operators over catalogue, cart, customer-order,
purchase-order and dispatch tables.  Sub-packages:

* ``sources``    table scans with declared schemas, form/array/message readers
* ``functions``  Column expressions (formatting, pricing, slugs, durations)
* ``operators``  catalogue, accounts, supply, change (DML-as-snapshot), audits
* ``plans``      the registered queries and their DuckDB oracle SQL
* ``streaming``  Structured Streaming jobs for cart and dispatch state
"""

PAGE_SIZE = 8
