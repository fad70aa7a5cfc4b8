"""A training corpus from raw documents; its stages are in ``tidelog.llm.pipeline``."""

from tidelog.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
