"""Spark analytics over business-directory listings.

Layers, lowest first:

* ``functions`` - Column expressions (parsing, labels, scores, exact rounding)
* ``operators`` - DataFrame -> DataFrame building blocks
* ``plans``     - the named business questions, composed from the above
* ``sources``   - readers, writers and staging
* ``testbed``   - binding of the driver's tables to a listing export, plus the SQL oracle
"""
