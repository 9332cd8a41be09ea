"""Training-data operators: mixing, scoring, scanning, near-duplicates, packing.

One module per operator.  Nothing else in the library imports this package;
the registered queries are in ``riskframe.llm.queries``.
"""
