"""From raw documents to token ids: the corpus pipeline.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a frame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents. A null text is
empty for every stage; repeated rows count as rows of their own; an empty table passes through all stages as an empty one.
"""

from __future__ import annotations

import public_tokenizers

from creditlens.llm import bpe, exact, jaccard, mixing, toxicity
from creditlens.session import new_path

VOCABULARY = "byte_bpe_50k.json"


def not_toxic(spark, docs, sf_dir):
    """Documents with a toxicity score below the threshold; learned from the labels of these documents."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_ordinary(docs, model)


def distinct_texts(spark, docs, sf_dir):
    """Of documents with equal texts (A-Z lower-cased) the one with the largest id."""
    return exact.deduplicate(docs)


def one_of_near_copies(spark, docs, sf_dir):
    """Of each group of documents that links of similar word shingles connect, the one with the smallest id."""
    return jaccard.one_per_component(docs)


def mixed_sources(spark, docs, sf_dir):
    """Each document as often as the mix of its source takes it."""
    return mixing.mix(docs)


def token_ids(spark, docs, sf_dir):
    """The documents with their token ids, the numbers of these, and the digests of ids and decoded texts."""
    return bpe.encode_frame(docs, public_tokenizers.path(VOCABULARY), keep_ids=True)


STAGES = [
    ("toxicity", not_toxic),
    ("exact_dedup", distinct_texts),
    ("jaccard_join", one_of_near_copies),
    ("mixing", mixed_sources),
    ("bpe", token_ids),
]

# The scores of the first stage are learned; tests hold every stage against a plain version instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage, all stages applied to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
