"""The corpus pipeline as the driver calls it; its stages are in ``framelake.llm.corpus``."""

from framelake.llm.corpus import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
