"""softgrove: a Spark-native engine for soft decision trees on labelled tables.

Entry points: ``sources.catalog.prepare_table``, ``plans.trials.run_trials``,
and the operators under ``operators``.
"""

__version__ = "0.1.0"
