"""Evidence analytics on Spark: scholarly records from ingest to evidence tables.

``functions`` holds Column expressions, ``operators`` DataFrame operators, ``sources`` readers
and writers, ``streaming`` the incremental forms, ``plans`` the end-to-end runs, and
``catalog`` the registered queries with their SQL twins.
"""
