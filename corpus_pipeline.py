"""The corpus pipeline: its stages in order, what SQL can say of it, and the run over a folder of tables."""

from kadastra.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
