"""From raw documents to packed sequences, in five stages.

Every stage takes what its predecessor kept, as a table, and its decisions take
effect: documents without recognisable language go, of each group of near copies
one stays, contaminated documents go, secrets are masked in the text, and what
remains is packed. Null texts have no language and go first; rows with a null
doc_id go through like any other but are no one's copy. An empty table gives an
empty result. Columns beyond those used are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftframe.llm import decontamination, language, near, packing, secrets
from siftframe.llm.queries import public_tokenizer, table
from siftframe.llm.storage import stored

#: A document of which no language has this share of the n-grams it knows is rejected.
LEAST_SHARE = 0.3
TOKENIZER = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with letters and a recognised language."""
    model = language.train(docs, key=F.col("doc_id"))
    found = language.identify(docs, model, into="__language__")
    known = (F.col("__language__.lang_pred") != language.UNKNOWN) & (F.col("__language__.score") >= LEAST_SHARE)
    return found.where(known).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the least doc_id of each class (ties: the least digest of the text);
    of rows with the same doc_id and text, one. Rows without doc_id stay."""
    return near.drop_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth of the words is in passages of test items."""
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), into="__found__")
    return found.where(~decontamination.is_contaminated("__found__")).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; n_chars follows where a text has changed."""
    found = secrets.find_secrets(docs, into="__secrets__")
    clean = secrets.redact(found, spans_col="__secrets__")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        n_chars = F.when(F.size("__secrets__") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars"))
        clean = clean.withColumn("n_chars", n_chars)
    return clean.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every token piece in the packed sequences."""
    return packing.pack(docs, public_tokenizer(TOKENIZER))


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]
#: The language model and the token ids can't be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
