"""Telemetry analytics on Spark: contract, bronze, silver, rollups, boards.

Every public function takes DataFrames and returns DataFrames.  Nothing is collected
inside an operator; time never comes from the clock but from an ``as_of`` argument.
"""
