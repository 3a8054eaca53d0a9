"""A training-data pipeline over ``documents``, stage by stage through Parquet.

Language ID drops what is in no learned language, near-duplicates leave one document of
each group, decontamination drops documents that hold benchmark passages, mixing repeats
documents towards the sources' targets, and the last stage writes token ids and returns
what it reads back: ``doc_id, start, n_tokens, ids_crc32`` of every document written.

Edge cases: null, empty, blank and letterless texts are in no language and go at the first
stage, as does everything where no row has a label; a null source is a source of the mix;
null and repeated ids are rows like others, and of rows equal in id and text one stays at
the second stage; ties are decided by id and then by a hash of the text; a very long text
goes through whole, in blocks and spans; an empty table gives no rows at any stage; extra
columns, whatever their names, stay as they are up to the last stage.
"""

from __future__ import annotations

from folioscope.llm import decontaminate, langid, minhash, mixing, shared, token_output


def identify_languages(spark, docs, sf_dir):
    """Learns from the labelled rows and keeps documents in one of these languages."""
    return langid.accepted(docs, langid.samples(docs))


def drop_near_duplicates(spark, docs, sf_dir):
    """Five-word shingles, similarity 0.8 or more; the document with the least id stays."""
    return minhash.one_of_each(docs, words=5, percent=80)


def drop_contaminated(spark, docs, sf_dir):
    """Documents of whose words a twentieth or more lie in passages of the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark, docs, sf_dir):
    """Capped water-filling over the sources; documents are repeated as the mix takes them."""
    return mixing.mix(docs)


def write_tokens(spark, docs, sf_dir):
    """Token ids in Arrow files of equal-length sequences, read back per document."""
    return token_output.encoded(docs)


STAGES = [
    ("language-id", identify_languages),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token-output", write_tokens),
]
ORACLE_SQL = None  # no stage but mixing and decontamination can be said in SQL; tests compare with plain Python


def run(spark, sf_dir: str):
    """All stages over ``documents``; what a stage returns is written, and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
