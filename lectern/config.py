"""Settings whose values are part of the semantics; all can be replaced."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    chunk_size: int = 800
    chunk_overlap: int = 150
    top_k: int = 2
    context_chars: int = 5000
    context_chunk_chars: int = 1800
    answer_words: int = 120
    good_quality: float = 0.65
    usable_quality: float = 0.35
    language_bonus: float = 0.005
    distance_gap: float = 0.02
    weak_match: float = 0.18
    context_chunks: int = 4
    ocr_ratio_limit: float = 0.5
    low_quality_limit: float = 0.5
    eval_k: int = 3
    official_hosts: tuple[str, ...] = ()  # of the deployment; the last is the canonical one


DEFAULT = EngineConfig()


def shared_folder(spark, name: str) -> str:
    """A new folder's path below the one that driver and executors share (spark.checkpoint.dir).

    Only a session of one process, which may have none, gets a temporary folder.
    """
    import re
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lectern-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
