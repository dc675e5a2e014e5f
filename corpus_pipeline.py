"""The corpus pipeline: stages applied one after the other to `documents`.

Each stage works on all rows that the one before it kept, which are written as Parquet to the shared folder and read
again in between. All stages but the last return the columns of `documents`; the last returns the token ids.
"""

from __future__ import annotations

from marlstream.llm import language, leaks, line_copies, near_copies, pieces
from marlstream.llm.common import table, written
from marlstream.llm.registry import shipped

STAGES = [
    ("language_id", shipped(language.keep_known_languages)),
    ("line_dedup", shipped(line_copies.drop_repeated_lines)),
    ("near_dedup", shipped(near_copies.keep_one_of_each)),
    ("decontamination", shipped(leaks.drop_leaks)),
    ("sentencepiece", shipped(pieces.encode_kept)),
]

#: SQL can't express the language model, the hash minima or the segmentation; tests hold run() against brute force
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
