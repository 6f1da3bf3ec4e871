"""A corpus from documents to token files: quality, near duplicates, decontamination, mixing, token ids (see the stages)."""

from stratalode.llm.stages import STAGES, run

#: The scores, the hashes and the tokenizer of the stages are not in SQL; tests hold them against brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
