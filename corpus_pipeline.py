"""The corpus pipeline over ``documents``: five stages, each on all that the one before it kept.

Documents are read as alerts: ``doc_id`` is the id, ``text`` the description, ``source`` the publisher and
``lang`` its section. All stages but the last return the columns of ``documents``. Rows without an id pass
every filter. No SQL can express the classifier, the min-hashes or the tokenizer: ``tests/llm`` holds the
stages against a plain version on a small fixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm.common import components, text_of
from kerbside.llm.leaks import leaked_lines
from kerbside.llm.lines import drop_repeated_lines
from kerbside.llm.packing import pack_announcements
from kerbside.llm.quality import alert_quality
from kerbside.llm.simhash import near_groups
from kerbside.llm.similar import similar_groups
from kerbside.session import configure, stored

AS_ALERT = {"doc_id": "alert_id", "text": "description", "source": "publisher", "lang": "section"}
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.distinct(), "doc_id", "left_anti").select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps: good enough and not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "alert_id")
    scored = alert_quality(docs.withColumnsRenamed(AS_ALERT), labels)
    return _without(docs, scored.where("not keep").select(F.col("alert_id").alias("doc_id")))


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier one has."""
    cut = drop_repeated_lines(docs, "doc_id", "text", carry=("lang", "source"))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies: SimHash fingerprints of five-word shingles within 4 bits connect,
    and so do sets of five-word shingles of similarity 0.8 or more.

    Both operators group texts by their hash, so that only texts connect groups, not ids that several texts have.
    """
    versions = docs.select("doc_id", F.xxhash64(text_of("text")).alias("version"), "text")
    near = near_groups(versions, "version", "text", words=5).select("version", "group_id")
    similar = similar_groups(versions, "version", "text", words=5, similarity=0.8).select("version", "group_id")
    links = near.unionByName(similar).where("version <> group_id").distinct()
    member = components(links.toDF("a", "b")).withColumnRenamed("node", "version")
    firsts = versions.groupBy("version").agg(F.min("doc_id").alias("first")).join(member, "version", "left")
    firsts = stored(firsts.withColumn("component", F.coalesce("component", "version")), "first-of-text")
    leads = firsts.groupBy("component").agg(F.min("first").alias("lead"))
    lead = firsts.join(leads, "component").select("version", "lead")
    return _without(docs, versions.join(lead, "version").where("doc_id <> lead").select("doc_id"))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    leaks = leaked_lines(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "doc_id", "text", "item_id", "text")
    return _without(docs, leaks.select("doc_id"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of token sequences."""
    import public_tokenizers

    return pack_announcements(docs, public_tokenizers.path("word_bpe_49k.json"), "doc_id", "text")


STAGES = [("quality", good_quality), ("lines", own_lines), ("near copies", one_of_each_group), ("leaks", without_leaks), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result stored in the shared folder and read again as the next one's documents."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
