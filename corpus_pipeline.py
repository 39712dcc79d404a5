"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, packing; part of subpackage llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; each works on all that its predecessor kept. All but
the last return the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from promptmeter.llm import langid, linededup, minmax, mixing, packing
from promptmeter.llm.shared import read_table, written


def language_stage(spark, docs, sf_dir):
    """Documents whose language can be told."""
    return langid.reject_unclear(docs)


def line_stage(spark, docs, sf_dir):
    """Documents without the chunks of lines that stand elsewhere before."""
    return linededup.drop_repeats(docs)


def near_stage(spark, docs, sf_dir):
    """One document of each group of near duplicates."""
    return minmax.drop_near_duplicates(docs)


def mix_stage(spark, docs, sf_dir):
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pack_stage(spark, docs, sf_dir):
    """Pieces of the mix with the place of each in a sequence; a document that the mix repeats has its pieces as often."""
    tokens = packing.tokenised(docs.select("doc_id", "text"))
    return packing.pack(tokens)


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("source_mix", mix_stage), ("packing", pack_stage)]

#: No SQL expresses a trained language model or min-max hashing.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
