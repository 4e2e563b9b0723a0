"""A training corpus from ``documents``: five stages, each on all that the one before kept.

1. quality rules: failing lines go, then documents that lost too much with them;
2. language identification: documents without a language, or without a main one, go;
3. near duplicates: one document of each group stays;
4. personal data: protected spans and disclosing terms are replaced in the texts;
5. packing: the texts' tokens are packed into sequences; one row per piece.

Stages 1 to 4 return the columns of ``documents``.  Each stage is written as Parquet to
the shared folder and read again before the next one.
"""

import uuid

from graticule.llm import disclosure, language_mix, packing, quality_rules, simhash
from graticule.llm.common import short_batches, table
from graticule.llm.queries import language_model, tokenizer
from graticule.session import scratch_folder, ship_package


def _prepared(stage):
    def run(spark, docs, sf_dir):
        ship_package(spark)
        short_batches(spark)
        return stage(spark, docs, sf_dir)

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


@_prepared
def clean(spark, docs, sf_dir):
    """Documents that pass the quality rules, without their failing lines."""
    return quality_rules.keep_good(docs, replace=True)


@_prepared
def identify(spark, docs, sf_dir):
    """Documents with a main language, learned from the rows that are not held out."""
    return language_mix.keep_identified(docs, language_model(docs))


@_prepared
def deduplicate(spark, docs, sf_dir):
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


@_prepared
def sanitise(spark, docs, sf_dir):
    """All documents, with personal data replaced in their texts."""
    return disclosure.sanitise(docs)


@_prepared
def pack(spark, docs, sf_dir):
    """One row per piece of a document in a sequence."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), ids=False)


STAGES = [
    ("quality_rules", clean),
    ("language_mix", identify),
    ("simhash", deduplicate),
    ("disclosure", sanitise),
    ("packing", pack),
]

# n-gram models, fingerprints and tokens are beyond SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark, sf_dir):
    """The packed pieces of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
