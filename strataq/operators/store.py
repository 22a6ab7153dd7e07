"""The store as a table: incremental ingest of changed files, and the merge of an index with a staged part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.common import materialise, small
from strataq.operators import chunking as C
from strataq.operators import retrieval as R


def file_states(pages: DataFrame) -> DataFrame:
    """(path, file_name, mtime, size) of the files that pages belong to: latest load and bytes of text."""
    named = pages.where("source is not null").groupBy(F.col("source").alias("path"))
    return named.agg(F.min("file_name").alias("file_name"), F.max("loaded_at").alias("mtime"), F.sum(F.coalesce(F.octet_length("page_content"), F.lit(0))).alias("size"))


def file_status(known: DataFrame, now: DataFrame) -> DataFrame:
    """now with `status`: new if the manifest lacks the path, unchanged if both time and size are the same, else changed."""
    old = known.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_known"))
    same = F.col("mtime").eqNullSafe(F.col("_m")) & F.col("size").eqNullSafe(F.col("_s"))
    return now.join(old, "path", "left").withColumn("status", F.when(F.col("_known").isNull(), "new").when(same, "unchanged").otherwise("changed")).drop("_m", "_s", "_known")


def delete_by_file(store: DataFrame, gone: DataFrame) -> DataFrame:
    """The store without the rows of gone (path, file_name): those of its source, or without a source and of its name."""
    empty = F.coalesce("source", F.lit("")) == ""
    paths, names = gone.select(F.col("path").alias("source")).distinct(), gone.where("file_name is not null").select("file_name").distinct()
    return store.where(~empty).join(paths, "source", "left_anti").select(*store.columns).unionByName(store.where(empty).join(names, "file_name", "left_anti").select(*store.columns))


def replace_files(store: DataFrame, pages: DataFrame, todo: DataFrame) -> DataFrame:
    """The store's rows after the files of todo (path, file_name) were ingested anew from their pages.

    Rows have the columns that chunks and pages share; new rows have no row_id yet. Their files' rows are deleted, their
    pages are chunked, the first chunk of an id is kept, and a new chunk takes the place of an older row with its id
    (case apart). Rows without an id stay. A new row counts as indexed when its page was loaded.
    """
    files = small(todo)
    docs = pages.join(files.select(F.col("path").alias("source")), "source", "left_semi")
    chunks = materialise(R.keep_first(materialise(C.chunk_documents(docs)), ["chunk_id"], ["row_id", "chunk_index"]))
    own = ["chunk_index", "section_title", "chunk_id"]
    meta = [c for c in pages.columns if c in store.columns and c not in ("row_id", "page_content", *own)]
    new = chunks.select("row_id", F.col("content").alias("page_content"), *own).join(docs.select("row_id", *meta, F.col("loaded_at").alias("indexed_at")), "row_id")
    kept = delete_by_file(store, todo)
    ids = small(materialise(chunks.select(F.lower("chunk_id").alias("_k")).distinct()))
    kept = kept.join(ids, F.lower(kept["chunk_id"]) == ids["_k"], "left_anti")
    out = ["row_id", *meta, *own, "page_content", "indexed_at"]
    return kept.select(*out).unionByName(new.withColumn("row_id", F.lit(None).cast("bigint")).select(*out))


def ingest(store: DataFrame, pages: DataFrame, known: DataFrame) -> DataFrame:
    """The store's rows after an ingest: files that the manifest `known` (path, mtime, size) has unchanged go before anything is chunked.

    Uploading one file is an ingest of its pages alone.
    """
    todo = file_status(known, file_states(pages)).where("status <> 'unchanged'").select("path", "file_name")
    return replace_files(store, pages, materialise(todo))


def reset(table: DataFrame) -> DataFrame:
    """The table without rows, with the same columns: what a reset writes over store, index and manifest."""
    return table.where(F.lit(False))


def manifest(store: DataFrame) -> DataFrame:
    """(path, chunk_id): one row a file and id."""
    return store.where("source is not null and chunk_id is not null").select(F.col("source").alias("path"), F.lower("chunk_id").alias("chunk_id")).distinct()


def newest(entries: DataFrame, id_col: str, key_col: str, at_col: str) -> DataFrame:
    """Entries with the latest time of their key (case apart), undated ones last, ties to the smallest id; null keys are each kept."""
    dated = entries.withColumn("_k", F.lower(key_col)).withColumn("_at", -F.coalesce(F.unix_micros(F.col(at_col).cast("timestamp")), F.lit(-(1 << 62))))
    return R.keep_first(dated, ["_k"], ["_at", id_col]).drop("_k", "_at")


def merge_staged(base: DataFrame, delta: DataFrame, id_col: str, key_col: str, at_col: str, text_col: str) -> DataFrame:
    """(term, doc, tf) of base and staged delta as one index: of each key only the newest entry, from whichever part it comes."""
    cols = [id_col, key_col, at_col]
    live = small(materialise(newest(base.select(*cols).unionByName(delta.select(*cols)), id_col, key_col, at_col).select(id_col)))
    part = lambda df: R.postings(df.join(live, id_col, "left_semi"), id_col, text_col)
    return part(base).unionByName(part(delta))


class Postings:
    """An index kept in a folder: a base and staged parts, merged on read; compaction rewrites the base.

    An entry is a document with its key and time; of one key the newest entry counts, from whichever part it comes.
    Parts are parquet tables of entries and postings; a part counts once its entries, which come last, are written. Should
    a compaction end between writing and deleting, old and new part hold the same entries and a read gives them once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, df: DataFrame, part: str, id_col: str, key_col: str, at_col: str, text_col: str) -> None:
        """Stages the documents of df under a name of the part; a part written twice is replaced."""
        post = R.postings(df, id_col, text_col)
        post.write.mode("overwrite").parquet(f"{self.path}/{part}/postings")
        df.select(F.col(id_col).alias("doc"), F.lower(key_col).alias("key"), F.col(at_col).cast("timestamp").alias("at")).write.mode("overwrite").parquet(f"{self.path}/{part}/entries")

    def parts(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = lambda p: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p.toString() + "/entries/_SUCCESS"))
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if done(s.getPath())) if fs.exists(path) else []

    def entries(self) -> DataFrame:
        """(doc, key, at) of the live entries."""
        return newest(self.spark.read.parquet(*[f"{self.path}/{p}/entries" for p in self.parts()]), "doc", "key", "at")

    def read(self) -> DataFrame:
        """(term, doc, tf) of the live entries, of all parts."""
        live = small(materialise(self.entries().select("doc")))
        post = self.spark.read.parquet(*[f"{self.path}/{p}/postings" for p in self.parts()]).join(live, "doc", "left_semi")
        return post.groupBy("term", "doc").agg(F.max("tf").alias("tf"))  # an entry may lie in two parts after a broken compaction

    def compact(self, part: str) -> None:
        """Writes the live entries of all parts as one new part and deletes the others."""
        old = self.parts()
        entries, post = materialise(self.entries()), self.read()
        post.repartition("term").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{self.path}/{part}/postings")
        entries.write.mode("overwrite").parquet(f"{self.path}/{part}/entries")
        self._delete([p for p in old if p != part])

    def reset(self) -> None:
        self._delete(self.parts())

    def _delete(self, names: list[str]) -> None:
        for p in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
