"""All queries of the engine's own operators, by name, and the SQL that gives the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracklens.operators import assembly, catalogue, deterministic, evaluation, exports, feedback, graphs, hybrids, inference, joins, listening, measures, navigable, personas, rankings, scalars, selection, sequences, stations, styles, training, vectors, walks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _family in (feedback, catalogue, vectors, evaluation, stations, personas, scalars, joins, sequences, measures, rankings, graphs, selection, assembly, walks, navigable, listening, inference, deterministic, exports, training, styles, hybrids):
    QUERIES |= _family.QUERIES
    ORACLES |= _family.ORACLES
