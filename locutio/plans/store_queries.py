"""Queries of the store of speeches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store
from ..operators.stored import scratch
from .inputs import table
from .queries import query


@query("select doc_id, lang, n_chars, case when doc_id % 3 = 0 then 2 else 1 end as version, 'm' as modelo from documents where doc_id % 2 = 0 or doc_id % 3 = 0")
def store_upsert(spark, sf):
    """Two runs over the documents into one store: the second replaces what it shares with the first, and each keeps what is its own."""
    path = scratch(spark)
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    for version, step in ((1, 2), (2, 3)):
        rows = docs.where(F.col("doc_id") % step == 0).withColumn("version", F.lit(version))
        store.upsert(rows, rows, path, "rows", {"modelo": "m"})
    return store.read(spark, path, "rows").select("doc_id", "lang", "n_chars", "version", "modelo")


@query("select doc_id, case when doc_id % 4 = 0 then 'kept' else 'parsed' end as did from documents")
def store_reuse(spark, sf):
    """What a run takes from a store that an older and the present version have written, and what it makes anew."""
    path = scratch(spark)
    docs = table(spark, sf, "documents").select("doc_id")
    held = docs.where("doc_id % 2 = 0").withColumn("version_parseo", F.when(F.col("doc_id") % 4 == 0, 2).otherwise(1))
    store.upsert(held, held, path, "transcripts", {})
    kept = store.current(store.read(spark, path, "transcripts"), {"version_parseo": 2}).select("doc_id", F.lit("kept").alias("did"))
    return kept.unionByName(docs.join(kept, "doc_id", "left_anti").withColumn("did", F.lit("parsed")))
