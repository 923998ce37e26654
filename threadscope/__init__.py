"""threadscope: community-discussion corpus analytics as Spark DataFrame transformations.

Every public operator is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``) or a ``Column`` builder; the heavy lifting is done by Spark SQL
expressions, joins, windows and aggregates so Catalyst can push down, prune and
plan the shuffles.
"""

__version__ = "0.1.0"
