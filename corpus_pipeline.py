"""From raw documents to tokens: the stages of ``terrastrata.llm.pipeline``."""

from terrastrata.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
