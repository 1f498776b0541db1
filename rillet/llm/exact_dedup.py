"""Exact deduplication by 128-bit content hash, confirmed on bytes.

Texts are equal when identical after each run of white space is one space;
null counts as empty, so null and empty texts form one group. Rows are grouped
by the hash of their text, which shuffles hashes and ids alone. Only texts whose
hash occurs more than once (or seems to, by a bitmap of bounded size) are then
compared: they are counted by hash and bytes, so that texts of one hash that
differ stay apart, and each map task sends a text once, however many copies it
holds. So neither long texts nor large groups gather in a task.

Rows that repeat a doc_id are rows of their own; in ``classes`` all that share
the smallest id of a group are kept. ``keep`` decides by row: of those it takes
one, and a row goes whose own text has a row of a smaller id, whatever other
rows have its id. Rows without a doc_id never give their group its id; a group
of only such rows has a null keep_id; ``keep`` never drops a row without one.
Empty tables give empty results; other columns pass through ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillet.llm.common import fingerprint, join_groups, marked
from rillet.scratch import cut, shared_dir

SPACE = r"[\x20\x09-\x0D]+"


def normal(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``."""
    folder = shared_dir(docs.sparkSession)
    texts = docs.select(F.col(doc_id).alias("doc_id"), normal(text).alias("_t")).withColumn("_h", F.unhex(F.md5("_t")))
    rows = cut(texts.select("doc_id", "_h", F.sha2("_t", 256).alias("text_sha256")), folder, "rows")
    several = cut(rows.groupBy("_h").count().where("count > 1").select("_h"), folder, "several")
    groups = marked(texts, "_h", several).where("_in").groupBy("_h", "_t").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = cut(groups.select("_h", F.sha2("_t", 256).alias("text_sha256"), "keep_id", "group_size"), folder, "groups")
    told = marked(rows, "_h", several)
    alone = told.where("not _in").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    joined = join_groups(told.where("_in").drop("_in"), groups, ["_h", "text_sha256"], "group_size", rows.count()).select(*alone.columns)
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return joined.unionByName(alone).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with all their columns.

    Only rows that may go are shuffled with their texts.
    """
    folder = shared_dir(docs.sparkSession)
    rows = cut(classes(docs, doc_id, text), folder, "classes").where("doc_id is not null")
    gone = rows.where("not kept").select("doc_id", "text_sha256").distinct().withColumn("_state", F.lit("gone"))
    again = rows.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").select("doc_id", "text_sha256", F.lit("again").alias("_state"))
    open_ = cut(gone.unionByName(again).withColumnsRenamed({"doc_id": "_id", "text_sha256": "_sha"}), folder, "open")
    told = marked(docs, doc_id, open_.select("_id"))
    maybe = told.where("_in").drop("_in").withColumn("_text", F.sha2(normal(text), 256))
    maybe = maybe.join(open_.hint("shuffle_merge"), (F.col(doc_id) == F.col("_id")) & (F.col("_text") == F.col("_sha")), "left")
    order = fingerprint(docs)
    one = maybe.where("_state = 'again'").groupBy("_id", "_sha").agg(F.min_by(F.struct(*docs.columns), F.struct(*order)).alias("_row")).select("_row.*")
    return told.where("not _in").drop("_in").unionByName(maybe.where("_state is null").select(*docs.columns)).unionByName(one)


def query(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
