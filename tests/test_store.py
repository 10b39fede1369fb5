"""The versioned corpus store: merges, replays, lost checkpoints, reads of older versions, deletion and clean-up."""

import os

from pyspark.sql import functions as F

from granary.operators.chunking import ingest
from granary.operators.text import clean_pages
from granary.sources.store import CorpusStore
from granary.streaming import jobs as X

PAGES = "doc_id string, file_name string, source_path string, page_num int, text string"


def pages(spark, docs, word="word", numbers=(1, 2)):
    rows = [(f"d{d}", f"d{d}.pdf", f"corpus/d{d}.pdf", p, f"Page of document {d}\n" + f"{word}{d} and {p} more text here " * 30) for d in docs for p in numbers]
    return spark.createDataFrame(rows, PAGES)


def chunk_rows(df):
    return {(r.strategy, r.doc_id, r.section_index, r.piece_index, r.text) for r in df.collect()}


def folders(path):
    return set(os.listdir(f"{path}/data"))


def test_merge_rewrites_only_the_buckets_of_changed_documents(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"), buckets=8)
    assert store.version() == 0 and store.read("pages").count() == 0
    assert store.merge(pages(spark, range(20))) == 1
    before = store._entries(1)
    assert store.merge(pages(spark, [3, 40], "other")) == 2
    after = store._entries(2)
    wanted = {r.b for r in pages(spark, [3, 40]).select(store.bucket().alias("b")).distinct().collect()}
    assert {b for (n, b), f in after.items() if before.get((n, b)) != f} == wanted and len(wanted) < 8
    want = pages(spark, [d for d in range(20) if d != 3]).union(pages(spark, [3, 40], "other"))
    assert chunk_rows(store.read("chunks")) == chunk_rows(ingest(clean_pages(want)))
    assert store.read("chunks", 1).filter("text like '%other3%'").count() == 0 and store.read("pages", 1).count() == 40
    got = {(r.doc_id, r.page_num, r.change) for r in store.changes(1, 2).collect()}
    assert got == {("d3", 1, "changed"), ("d3", 2, "changed"), ("d40", 1, "added"), ("d40", 2, "added")}
    assert CorpusStore(spark, str(tmp_path / "s"), buckets=99).buckets == 8


def test_replays_and_broken_commits_change_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    store = CorpusStore(spark, path, buckets=4)
    batch = pages(spark, range(6))
    assert [store.merge(batch), store.merge(batch), store.merge(batch.union(batch))] == [1, 1, 1]
    seen = chunk_rows(store.read("chunks"))
    os.makedirs(f"{path}/commits/000000002/_temporary/0")  # a writer that died before its commit appeared
    os.makedirs(f"{path}/data/pages-dead/bucket=0")
    again = CorpusStore(spark, path)
    assert again.version() == 1 and chunk_rows(again.read("chunks")) == seen
    assert again.merge(pages(spark, [1], "new")) == 2 and again.numbers() == (2, 2)
    assert again.vacuum(keep=1) >= 1 and "pages-dead" not in folders(path)
    assert again.version() == 2 and again.read("pages").count() == 12


def test_stream_with_a_lost_checkpoint(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "s")
    parts = [pages(spark, [1, 2], numbers=(1,)), pages(spark, [1], "late", (1,)).union(pages(spark, [2], numbers=(2,)))]
    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    stream = stream.select("*", F.col("_metadata.file_modification_time").alias("updated_at"))

    def run(checkpoint, part=None):
        if part is not None:
            parts[part].coalesce(1).write.mode("append").parquet(str(source / f"p={part}"))
        q = X.ingest_stream(stream, path, str(tmp_path / checkpoint), buckets=4, trigger={"availableNow": True})
        assert q.awaitTermination(120)
        return CorpusStore(spark, path)

    assert [run("c", k).version() for k in range(2)] == [1, 2]
    seen = chunk_rows(CorpusStore(spark, path).read("chunks"))
    assert run("lost").version() == 2  # every file again, from batch 0: older pages do not undo later ones
    assert seen == chunk_rows(CorpusStore(spark, path).read("chunks"))
    want = pages(spark, [1], "late", (1,)).union(pages(spark, [2]))
    assert seen == chunk_rows(ingest(clean_pages(want)))


def _shared(spark):
    from granary.sources.tables import _shared_folder

    return _shared_folder(spark)


def test_no_scratch_table_is_left(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"), buckets=4)
    before = set(os.listdir(_shared(spark)))
    store.merge(pages(spark, range(5)))
    store.delete("file_name", "d1.pdf")
    assert set(os.listdir(_shared(spark))) == before


def test_delete_force_and_nulls(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"), buckets=4)
    odd = spark.createDataFrame([(None, "x", "x", 1, "lost"), ("e", "e.pdf", "corpus/e.pdf", None, "lost"), ("e", "e.pdf", "corpus/e.pdf", 1, None)], PAGES)
    store.merge(pages(spark, range(4)).union(odd))
    assert store.read("pages").count() == 9
    n = store.read("chunks").filter("file_name = 'd2.pdf' and strategy = 'fixed_size'").count()
    version, gone = store.delete("file_name", "d2.pdf")
    assert version == 2 and gone["fixed_size"] == n > 0 and store.read("pages").filter("doc_id = 'd2'").count() == 0
    assert store.delete("source_path", "nowhere") == (2, {"fixed_size": 0, "structure_aware": 0})
    assert store.merge(pages(spark, [9]), force=True) == 3
    assert {r.doc_id for r in store.read("pages").collect()} == {"d9"} and store.read("pages", 2).count() == 7
    s = store.status().first()
    assert s.ready and (s.corpus_version, s.index_version) == (3, 3) and s.pages == 2
