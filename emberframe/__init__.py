"""emberframe: profile and runtime-telemetry analytics on Spark DataFrames.

Frame tables (one row per flame-graph node), trace events, runtime counters, spans, retention and
alert rules, each as a function from DataFrame to DataFrame.
"""
