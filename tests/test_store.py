"""Ingest and index merge on small tables with known results."""

from datetime import datetime

from strataq.operators import store

CHUNKS = "row_id bigint, source string, file_name string, page int, doc_type string, page_content string, chunk_id string, chunk_index int, section_title string, indexed_at timestamp"
PAGES = "row_id bigint, source string, file_name string, page int, doc_type string, page_content string, loaded_at timestamp"
T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def test_ingest(spark):
    from strataq.plans import catalog

    assert {"incremental_ingest", "repair_run", "incremental_ingest_manifest", "incremental_ingest_index", "incremental_ingest_stale"} <= set(catalog.QUERIES)
    have = [(1, "same", "same.md", 1, "text", "alpha", "A1", 0, "", T1), (2, "changed", "changed.md", 1, "text", "old words", "B1", 0, "", T1), (3, None, "loose.md", 1, "text", "loose", None, 0, "", T1), (4, "gone", "changed.md", 1, "text", "gamma", None, 0, "", T1), (6, "", "changed.md", 1, "text", "no source", "C1", 0, "", T1)]
    pages = [(1, "same", "same.md", 1, "text", "alpha", T1), (2, "changed", "changed.md", 1, "text", "new words", T2), (3, "changed", "changed.md", 2, "text", "more words", T2), (4, "fresh", "fresh.md", 1, "text", "delta", T2), (5, "fresh", "fresh.md", 1, "text", "delta", T2), (6, "fresh", "fresh.md", 2, "text", " ", T2), (7, None, "nameless.md", 1, "text", "nameless", T2)]
    known = spark.createDataFrame([("same", T1, 5), ("changed", T1, 19)], "path string, mtime timestamp, size bigint")
    p = spark.createDataFrame(pages, PAGES)
    once = store.ingest(spark.createDataFrame(have, CHUNKS), p, known)
    got = once.collect()
    assert sorted((r["source"] or "", r["page_content"]) for r in got) == [("", "loose"), ("changed", "more words"), ("changed", "new words"), ("fresh", "delta"), ("gone", "gamma"), ("same", "alpha")]
    assert {r["row_id"] for r in got} == {None, 1, 3, 4} and all(r["indexed_at"] == (T1 if r["row_id"] else T2) for r in got)
    assert store.manifest(once).count() == 4
    # A row of another file with an id that comes in anew is replaced.
    cid = next(r["chunk_id"] for r in got if r["source"] == "fresh")
    again = store.ingest(spark.createDataFrame([*have, (5, "elsewhere", "e.md", 1, "text", "stale", cid.upper(), 0, "", T1)], CHUNKS), p, known).collect()
    assert [r["source"] for r in again if (r["chunk_id"] or "").lower() == cid] == ["fresh"]


def test_merge_staged(spark):
    from strataq.plans import catalog

    assert "bm25_merge_staged" in catalog.QUERIES
    cols = "row_id bigint, chunk_id string, indexed_at timestamp, page_content string"
    base = spark.createDataFrame([(1, "A", T1, "red red"), (2, "B", T2, "blue"), (3, None, T1, "grey"), (4, "C", None, "pink")], cols)
    delta = spark.createDataFrame([(5, "a", T2, "red green"), (6, "b", T1, "black"), (7, None, T1, "grey"), (8, "c", T1, "teal"), (9, "D", T2, "lime"), (10, "d", T2, "mint")], cols)
    got = {tuple(r) for r in store.merge_staged(base, delta, "row_id", "chunk_id", "indexed_at", "page_content").collect()}
    assert got == {("red", 5, 1), ("green", 5, 1), ("blue", 2, 1), ("grey", 3, 1), ("grey", 7, 1), ("teal", 8, 1), ("lime", 9, 1)}


def test_file_status_needs_time_and_size(spark):
    cols = "path string, mtime timestamp, size bigint"
    known = spark.createDataFrame([("a", T1, 5), ("b", T1, 5), ("c", T1, 5)], cols)
    now = spark.createDataFrame([("a", T1, 5), ("b", T2, 5), ("c", T1, 6), ("d", T1, 1)], cols)
    assert {r["path"]: r["status"] for r in store.file_status(known, now).collect()} == {"a": "unchanged", "b": "changed", "c": "changed", "d": "new"}


def test_postings_on_disk(spark, tmp_path):
    cols = "row_id bigint, chunk_id string, indexed_at timestamp, page_content string"
    index = store.Postings(spark, str(tmp_path / "index"))
    args = ("row_id", "chunk_id", "indexed_at", "page_content")
    index.append(spark.createDataFrame([(1, "A", T1, "red red"), (2, "B", T2, "blue"), (3, None, T1, "grey")], cols), "base", *args)
    index.append(spark.createDataFrame([(5, "a", T2, "red green"), (6, "b", T1, "black")], cols), "staged-1", *args)
    want = {("red", 5, 1), ("green", 5, 1), ("blue", 2, 1), ("grey", 3, 1)}
    assert {tuple(r) for r in index.read().collect()} == want and index.parts() == ["base", "staged-1"]
    index.compact("base-2")
    assert {tuple(r) for r in index.read().collect()} == want and index.parts() == ["base-2"]
    index.reset()
    assert index.parts() == []
    assert store.reset(spark.createDataFrame([(1,)], "a int")).count() == 0
