"""All registered queries of the risk engine and their SQL twins."""

from . import queries_control, queries_history, queries_streams, queries_tracks

QUERIES: dict = {**queries_tracks.QUERIES, **queries_history.QUERIES, **queries_control.QUERIES, **queries_streams.QUERIES}
ORACLE: dict = {**queries_tracks.ORACLE, **queries_history.ORACLE, **queries_control.ORACLE, **queries_streams.ORACLE}
FLAGSHIP = "assessments"
