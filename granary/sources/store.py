"""A versioned corpus store: tables in hash buckets of a key, and a log of commits that name the folder of every bucket."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.sources.tables import scratch

PAGES = "doc_id string, file_name string, source_path string, page_num int, text string, clean_text string, likely_scanned boolean, updated_at timestamp, digest long"
CHUNKS = (
    "chunk_id string, doc_id string, file_name string, source_path string, strategy string, text string, page_start int, page_end int, "
    "section_title string, word_count int, char_count int, section_index int, piece_index int"
)
ENTRY = "name string, bucket int, folder string, corpus_version int, index_version int, buckets int"


class CorpusStore:
    """Pages and chunks of a corpus under one folder, of which every version stays readable until vacuum().

    A commit is one file that lists, for each table and bucket, the folder of its rows. It appears by one rename, so readers
    see a version whole or not at all, and a writer that dies leaves nothing but a folder that no commit names. A merge
    reads and rewrites only the buckets of documents whose pages it changes; pages that are stored already change nothing,
    so a batch that is sent again, or a stream that starts again without its checkpoint, makes no new version.
    One writer at a time; any number of readers.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """buckets holds for a new store; one that exists keeps its own number."""
        self.spark, self.path = spark, path.rstrip("/")
        known = self._versions()
        self.buckets = self.spark.read.schema(ENTRY).json(f"{self.path}/commits/{known[-1]:09d}").first().buckets if known else buckets

    # --- folders ---

    def _folder(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> list[str]:
        path, fs = self._folder(f"{self.path}/{name}")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _delete(self, name: str) -> None:
        path, fs = self._folder(f"{self.path}/{name}")
        fs.delete(path, True)

    def _versions(self) -> list[int]:
        """Versions whose commit is complete, in order."""
        names = [n for n in self._listed("commits") if any(x.startswith("part-") for x in self._listed(f"commits/{n}"))]
        return [int(n) for n in names]

    # --- commits ---

    def version(self) -> int:
        """The latest version, 0 where nothing was committed."""
        return max(self._versions(), default=0)

    def _entries(self, version: int) -> dict[tuple[str, int], str | None]:
        rows = self.spark.read.schema(ENTRY).json(f"{self.path}/commits/{version:09d}").collect() if version else []
        return {(r.name, r.bucket): r.folder for r in rows}

    def numbers(self, version: int | None = None) -> tuple[int, int]:
        """(corpus version, index version): how often pages, and chunks, have changed up to a version of the store."""
        version = self.version() if version is None else version
        if not version:
            return 0, 0
        r = self.spark.read.schema(ENTRY).json(f"{self.path}/commits/{version:09d}").first()
        return r.corpus_version, r.index_version

    def _commit(self, entries: dict[tuple[str, int], str | None], base: int, pages: bool, chunks: bool) -> int:
        corpus, index = self.numbers(base)
        rows = [(n, b, f, corpus + pages, index + chunks, self.buckets) for (n, b), f in sorted(entries.items())]
        made = self.spark.createDataFrame(rows, ENTRY).coalesce(1)
        made.write.mode("overwrite").option("ignoreNullFields", False).json(f"{self.path}/commits/{base + 1:09d}")
        return base + 1

    # --- reading ---

    def bucket(self, key: Column | str = "doc_id") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """pages or chunks as of a version (the latest), of some buckets or of all; files of other buckets are not opened."""
        version = self.version() if version is None else version
        if version and version not in self._versions():
            raise ValueError(f"no version {version}")
        entries = self._entries(version)
        wanted = set(range(self.buckets) if buckets is None else buckets)
        paths = [f"{self.path}/{f}/bucket={b}" for (n, b), f in entries.items() if n == name and f and b in wanted]
        schema = {"pages": PAGES, "chunks": CHUNKS}[name]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def status(self, version: int | None = None) -> DataFrame:
        """index_status of a version, with the store's own version numbers."""
        from granary.sources.tables import index_status

        version = self.version() if version is None else version
        return index_status(self.read("chunks", version), self.read("pages", version), *self.numbers(version))

    # --- writing ---

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """rows dealt by document and bucket, with _deal: a task holds some documents of one bucket, and a bucket is some tasks and files."""
        parts = -(-2 * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        deal = self.bucket() * parts + F.pmod(F.hash("doc_id"), F.lit(parts))
        return rows.withColumn("_deal", deal).repartitionById(self.buckets * parts, "_deal")

    def _written(self, name: str, rows: DataFrame, buckets: list[int], entries: dict[tuple[str, int], str | None]) -> None:
        """Writes the new rows of the buckets, as they are dealt, and puts their folders into entries; a bucket left without rows has none."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        rows.withColumn("bucket", self.bucket()).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        there = {int(x.split("=")[1]) for x in self._listed(folder) if x.startswith("bucket=")}
        for b in buckets:
            entries[name, b] = folder if b in there else None

    @staticmethod
    def _digest(pages: DataFrame) -> DataFrame:
        return pages.withColumn("digest", F.xxhash64("file_name", "source_path", "text"))

    def merge(self, pages: DataFrame, force: bool = False) -> int:
        """The version with these pages merged in by (doc_id, page_num) and the chunks of their documents made anew.

        pages: doc_id, file_name, source_path, page_num, text and, if there is one, updated_at: a page that is stored with a later time
        stays as it is. Pages whose doc_id or page_num is null are left out; of pages that repeat a key within one call the
        latest stays, of equally late ones that of the greatest digest. force starts from an empty corpus; older versions stay readable.
        """
        from granary.operators.chunking import ingest

        with scratch(self.spark) as keep:
            base = self.version()
            known = {} if force else self._entries(base)
            at = F.col("updated_at") if "updated_at" in pages.columns else F.lit(None).cast("timestamp")
            sent = pages.filter("doc_id is not null and page_num is not null")
            sent = self._digest(sent.select("doc_id", "file_name", "source_path", "page_num", "text", at.alias("updated_at")))
            # what has changed is found by digests, so texts are read twice and shuffled once
            latest = F.max(F.struct("updated_at", "digest")).alias("p")
            last = keep(sent.groupBy("doc_id", "page_num").agg(latest).select("doc_id", "page_num", "p.*"), "sent")
            old = last.limit(0) if force else self.read("pages", base, self._buckets_of(last))
            there = old.select("doc_id", "page_num", F.col("digest").alias("_digest"), F.col("updated_at").alias("_at"))
            newer = F.coalesce(F.col("updated_at") >= F.col("_at"), F.lit(True))
            changed = last.join(there, ["doc_id", "page_num"], "left").filter(~F.col("digest").eqNullSafe(F.col("_digest")) & newer)
            docs = keep(changed.select("doc_id").distinct(), "changed")
            touched = self._buckets_of(docs)
            if not touched and not (force and base):
                return base
            entries = dict(known)
            self._written("pages", self._merged(sent, base, touched, force), touched, entries)
            now = self._at(entries, "pages", touched, ", _new boolean").filter("_new")
            columns = [c.split()[0] for c in CHUNKS.split(", ")]
            made = ingest(self._dealt(now), force=True).select(*columns)
            if not force:
                # documents that are chunked anew stand among the old chunks as rows of their own, so that only these are shuffled
                old = self.read("chunks", base, touched).withColumn("_gone", F.lit(False))
                both = self._dealt(old.unionByName(docs.withColumn("_gone", F.lit(True)), allowMissingColumns=True))
                rest = both.withColumn("_gone", F.max("_gone").over(Window.partitionBy("_deal", "doc_id"))).filter("not _gone")
                made = rest.select(*columns).unionByName(made)
            self._written("chunks", made, touched, entries)
            return self._commit(entries, base, True, True)

    def _merged(self, sent: DataFrame, base: int, touched: list[int], force: bool) -> DataFrame:
        """All pages of the touched buckets with those sent merged in, and _new: whether a page of their document has changed."""
        from granary.operators.text import looks_scanned, with_clean

        own = [c.split()[0] for c in PAGES.split(", ")]
        rows = sent.filter(self.bucket().isin(touched)).withColumns({"clean_text": F.lit(None).cast("string"), "likely_scanned": F.lit(None).cast("boolean"), "_sent": F.lit(True)})
        rows = rows if force else rows.unionByName(self.read("pages", base, touched).withColumn("_sent", F.lit(False)))
        rows = self._dealt(rows)
        page = Window.partitionBy("_deal", "doc_id", "page_num")
        first = F.row_number().over(page.orderBy(*map(F.desc, ("_sent", "updated_at", "digest", "file_name", "source_path", "text")))) == 1
        stored = [F.max(F.when(~F.col("_sent"), F.col(c))).over(page) for c in ("digest", "updated_at")]
        rows = rows.withColumns({"_first": first, "_digest": stored[0], "_at": stored[1]})
        takes = F.col("_sent") & F.col("_first") & ~F.col("digest").eqNullSafe(F.col("_digest")) & F.coalesce(F.col("updated_at") >= F.col("_at"), F.lit(True))
        rows = rows.withColumn("_takes", takes).withColumn("_any", F.max("_takes").over(page)).filter("_takes or not (_sent or _any)")
        rows = rows.withColumn("_new", F.max("_takes").over(Window.partitionBy("_deal", "doc_id")))
        # only pages that come in are cleaned
        rows = with_clean(rows.withColumn("_text", F.when(F.col("_takes"), F.col("text"))), "_text", "_clean")
        fresh = {"clean_text": F.col("_clean"), "likely_scanned": looks_scanned(F.col("_text"))}
        return rows.withColumns({c: F.when(F.col("_takes"), v).otherwise(F.col(c)) for c, v in fresh.items()}).select(*own, "_new")

    def _at(self, entries: dict[tuple[str, int], str | None], name: str, buckets: list[int], more: str = "") -> DataFrame:
        paths = [f"{self.path}/{entries[name, b]}/bucket={b}" for b in buckets if entries.get((name, b))]
        schema = {"pages": PAGES, "chunks": CHUNKS}[name] + more
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _buckets_of(self, rows: DataFrame) -> list[int]:
        """At most as many numbers as the store has buckets."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def delete(self, column: str, value: str) -> tuple[int, dict[str, int]]:
        """(version, chunks deleted by strategy) without the documents whose file_name or source_path is value."""
        base = self.version()
        hit = F.coalesce(F.col(column) == value, F.lit(False))
        with scratch(self.spark) as keep:
            docs = keep(self.read("pages", base).filter(hit).select("doc_id").distinct(), "gone")
            touched = self._buckets_of(docs)
            counts = {"fixed_size": 0, "structure_aware": 0}
            if not touched:
                return base, counts
            gone = self.read("chunks", base, touched).join(docs, "doc_id", "left_semi").groupBy("strategy").count().collect()
            entries = self._entries(base)
            for name in ("pages", "chunks"):
                kept = self._dealt(self.read(name, base, touched).join(docs, "doc_id", "left_anti"))
                self._written(name, kept.drop("_deal"), touched, entries)
            return self._commit(entries, base, True, True), counts | {r["strategy"]: r["count"] for r in gone}

    def changes(self, old: int, new: int) -> DataFrame:
        """(doc_id, page_num, change): pages added, removed or changed from one version to another.

        Only buckets whose folder differs between the two are read.
        """
        a, b = self._entries(old), self._entries(new)
        moved = sorted({k for n, k in {**a, **b} if n == "pages" and a.get((n, k)) != b.get((n, k))})
        before, after = (self.read("pages", v, moved).select("doc_id", "page_num", F.col("digest").alias(d)) for v, d in ((old, "a"), (new, "b")))
        change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
        return before.join(after, ["doc_id", "page_num"], "full").select("doc_id", "page_num", change.alias("change")).filter("change is not null")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes versions but the last `keep`, and folders that none of those names; returns the number of folders deleted."""
        versions = self._versions()
        for v in versions[:-keep]:
            self._delete(f"commits/{v:09d}")
        used = {f.split("/")[1] for v in versions[-keep:] for f in self._entries(v).values() if f}
        gone = [f for f in self._listed("data") if f not in used]
        for f in gone:
            self._delete(f"data/{f}")
        return len(gone)
