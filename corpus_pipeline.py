"""From raw documents to packed training sequences: see framelake/llm/pipeline.py."""

from framelake.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
