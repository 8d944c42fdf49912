"""reedmill: a corpus-analytics engine whose operators are Spark logical plans.

Sub-packages: ``functions`` (Column builders), ``operators`` (DataFrame builders), ``sources`` (readers and
sinks), ``streaming`` (feeds and state), ``plans`` (query catalogue with its SQL oracle).
"""
