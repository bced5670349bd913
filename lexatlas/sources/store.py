"""A store on a shared folder: folders of immutable rows, and for each snapshot a manifest that says which belong to it.

A write makes the next snapshot's new folders first and its manifest last, under a name of its own and only if no other
has it, so readers see all of an ingest or nothing: there is no pointer to move, and the snapshot with the highest
manifest is the current one. A table that an ingest only adds to keeps its folders, and gets one more. A lost executor or driver leaves the
old snapshot in place. Files go through Spark's own file systems.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexatlas import schema
from lexatlas.errors import AlreadyIngested, ModelMismatch, NotFound
from lexatlas.functions import lexical
from lexatlas.operators import chunking, extract, tree
from lexatlas.operators.lookup import page_count
from lexatlas.operators.retrieve import Store
from lexatlas.work import settled

_MANIFEST = "_SNAPSHOT."


def numbered(df: DataFrame, order: list[str], base: int, name: str = "id") -> DataFrame:
    """``df`` with whole numbers from ``base`` + 1 in the order of ``order``, whose rows are distinct.

    Rows are dealt by ranges of the order and numbered within each; only the ranges' sizes, one row each, meet in one task.
    """
    dealt = settled(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    rank = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return dealt.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + rank + base).cast("long")).drop("__part", "__before")


def firsts(files: DataFrame) -> DataFrame:
    """(sha256, path, copies): of files (path, sha256) with one content the first path counts."""
    return files.groupBy("sha256").agg(F.min("path").alias("path"), F.count("*").alias("copies"))


def cascade(tables: dict[str, DataFrame], documents: DataFrame) -> dict[str, DataFrame]:
    """``tables`` without ``documents`` (id) and what belongs to them; references to their sections dangle again."""
    gone = documents.select(F.col("id").alias("document_id"))
    gone_sections = tables["sections"].join(gone, "document_id", "left_semi").select(F.col("id").alias("section_id"))
    gone_chunks = tables["chunks"].join(gone_sections, "section_id", "left_semi").select(F.col("id").alias("key"))
    refs = tables["cross_refs"].join(gone_sections.withColumnRenamed("section_id", "from_section_id"), "from_section_id", "left_anti")
    marked = refs.join(gone_sections.select(F.col("section_id").alias("to_section_id"), F.lit(True).alias("lost")), "to_section_id", "left")
    return {
        "documents": tables["documents"].join(gone.withColumnRenamed("document_id", "id"), "id", "left_anti"),
        "sections": tables["sections"].join(gone, "document_id", "left_anti"),
        "chunks": tables["chunks"].join(gone_sections, "section_id", "left_anti"),
        "postings": tables["postings"].join(gone_chunks, "key", "left_anti"),
        "cross_refs": marked.withColumn("to_section_id", F.when(F.col("lost").isNull(), F.col("to_section_id"))).drop("lost"),
    }


class Repository:
    """Tables under ``root``: folders root/v=N/<table> and manifests root/_SNAPSHOT.N, which name each table's folders."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # -- files

    def _path(self, name: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        """The highest snapshot with a whole manifest."""
        p, fs = self._path("")
        if not fs.exists(p):
            return None
        found = [f.getPath().getName() for f in fs.listStatus(p) if f.getLen() > 0]
        return max((int(n.removeprefix(_MANIFEST)) for n in found if n.startswith(_MANIFEST) and n.removeprefix(_MANIFEST).isdigit()), default=None)

    def _folders(self, version: int) -> dict[str, list[str]]:
        p, fs = self._path(f"{_MANIFEST}{version}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, folders: dict[str, list[str]]) -> None:
        # written under another name, then renamed, so that no reader sees a part of it
        new, fs = self._path(f"_writing-{uuid.uuid4().hex}")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        p, _ = self._path(f"{_MANIFEST}{version}")
        if fs.exists(p) or not fs.rename(new, p):
            fs.delete(new, False)
            raise OSError(f"snapshot {version} was written by another run")

    # -- tables

    def _table(self, name: str, folders: list[str]) -> DataFrame:
        kind = schema.schema(name)
        if not folders:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self, name: str) -> DataFrame:
        v = self.version()
        if v is None:
            raise NotFound("no store here; init() makes one")
        return self._table(name, self._folders(v).get(name, []))

    def commit(self, changed: dict[str, DataFrame], added: dict[str, DataFrame] | None = None) -> int:
        """The next snapshot: ``changed`` tables as given, ``added`` rows beside what their tables have, others as they are."""
        now = self.version()
        folders = {} if now is None else self._folders(now)
        new = (now or 0) + 1
        for name, df in {**changed, **(added or {})}.items():
            fit = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.schema(name)])
            # a folder of its own, so that what a lost run left is never read
            folder = f"v={new}/{name}-{uuid.uuid4().hex}"
            fit.write.parquet(f"{self.root}/{folder}")
            folders[name] = [folder] if name in changed else [*folders.get(name, []), folder]
        self._publish(new, folders)
        return new

    def init(self, provider: str = "hashed", model: str = "hashed-bow", dimensions: int = 768, query_prefix: str = "", doc_prefix: str = "") -> None:
        """Empty tables; an existing store stays, and must have been made with the same model."""
        if self.version() is None:
            self.commit({"embedding_config": self.spark.createDataFrame([(provider, model, dimensions, query_prefix, doc_prefix)], schema.schema("embedding_config"))})
        self.check_model(model, dimensions)

    def check_model(self, model: str, dimensions: int) -> None:
        c = self.read("embedding_config").first()
        if (c["model"], c["dimensions"]) != (model, dimensions):
            raise ModelMismatch(f"the store holds {c['model']} vectors of width {c['dimensions']}, not {model} of {dimensions}")

    def reset(self) -> None:
        p, fs = self._path("")
        fs.delete(p, True)

    def open(self) -> Store:
        return Store(*[self.read(n) for n in ("corpora", "documents", "sections", "chunks", "cross_refs", "postings")])

    # -- ingest

    def ensure_corpus(self, corpus: str, title: str, grammar: str, jurisdiction: str | None = None) -> DataFrame:
        """The corpora with this one among them."""
        have = self.read("corpora")
        one = self.spark.createDataFrame([(corpus, title, jurisdiction, grammar)], "id string, title string, jurisdiction string, profile string").withColumn("created_at", F.current_timestamp())
        return have.unionByName(one.join(have, "id", "left_anti"))

    def without(self, documents: DataFrame) -> dict[str, DataFrame]:
        """All tables without ``documents`` (id) and what belongs to them."""
        return cascade({n: self.read(n) for n in ("documents", "sections", "chunks", "postings", "cross_refs")}, documents)

    def delete(self, document_id: int) -> None:
        d = self.read("documents").where(F.col("id") == document_id)
        if d.first() is None:
            raise NotFound(f"document {document_id} not found")
        self.commit(self.without(d))

    def ingest(self, files: DataFrame, blocks: Callable[[DataFrame], DataFrame], corpus: str, corpus_title: str, grammar: str = "code", layer: str = "base", embedder: object | None = None, force: bool = False, naive: bool = False, version: str | None = None) -> dict:
        """Ingest scanned files (path, content, sha256) into a corpus as one snapshot; returns counts.

        Bytes that the corpus holds already are refused, or replaced with ``force``. Where ``blocks`` tells errors, as :func:`files.parsed`
        does, files that can't be parsed are recorded in ingest_runs, each with its error, and the others are ingested. Any other failure leaves
        the tables as they are and is recorded in ingest_runs.
        """
        if layer not in schema.LAYERS:
            raise ValueError(f"layer must be one of {schema.LAYERS}")
        try:
            return self._ingest(files, blocks, corpus, corpus_title, grammar, layer, embedder, force, naive, version)
        except AlreadyIngested:
            raise
        except Exception as e:
            self.commit({}, {"ingest_runs": self._failures(self.spark.createDataFrame([(str(e)[:2000],)], "error string"))})
            raise

    def _failures(self, errors: DataFrame) -> DataFrame:
        """Rows of ingest_runs for ``errors`` (error)."""
        none = F.lit(None)
        return errors.select((F.lit(time.time_ns()) + F.monotonically_increasing_id()).alias("id"), none.cast("long").alias("document_id"), F.current_timestamp().alias("started_at"), F.current_timestamp().alias("finished_at"), F.lit("failed").alias("status"), none.cast(schema.schema("ingest_runs")["stats"].dataType).alias("stats"), "error")

    def _ingest(self, files, blocks, corpus, corpus_title, grammar, layer, embedder, force, naive, version) -> dict:  # noqa: ANN001
        known = self.read("documents").where(F.col("corpus_id") == corpus)
        twice = known.join(files.select("sha256").distinct(), "sha256", "left_semi")
        tables = {n: self.read(n) for n in ("documents", "sections", "chunks", "cross_refs", "postings")}
        if twice.first() is not None:
            if not force:
                raise AlreadyIngested(f"already ingested into {corpus}: {', '.join(r[0] for r in twice.select('source_path').limit(3).collect())}")
            tables = self.without(twice)
        replaced = twice.first() is not None
        top = lambda t: (t.agg(F.max("id")).first()[0] or 0)
        bases = {n: top(tables[n]) for n in tables if n != "postings"}
        found = blocks(files)
        if "error" in found.columns:
            found = settled(found)
            broken = settled(found.where("error is not null").select(F.col("document").alias("path"), "error"))
            if not broken.isEmpty():
                self.commit({}, {"ingest_runs": self._failures(broken.select(F.concat("path", F.lit(": "), "error").alias("error")))})
                files = files.join(broken, "path", "left_anti")
                if files.select("path").isEmpty():
                    return dict.fromkeys([f.name for f in schema.schema("ingest_runs")["stats"].dataType], 0)
            found = found.where("error is null").drop("error")
        # ids follow the paths' order
        first = settled(firsts(files).drop("copies"))
        files = files.join(first, ["sha256", "path"], "left_semi")
        listed = settled(numbered(first.select("path", "sha256"), ["path"], bases["documents"], "document_id"))
        # blocks were made of all files, those of the same bytes among them
        found = found.join(first.select(F.col("path").alias("document")), "document", "left_semi")
        made = tree.tag_amendments(tree.build(found, grammar, corpus_title), layer)
        made = made.join(listed.withColumnRenamed("path", "document"), "document")
        made = settled(numbered(made, ["document_id", "ordinal"], bases["sections"]))
        if naive:
            windows = chunking.windows(chunking.section_tokens(made))
            chunked = made.withColumn("clean_body", F.array_join("paragraphs", "\n\n")).withColumn("refs", F.array().cast("array<struct<ref_text:string,number:string,kind:string>>"))
            own = windows.join(made.select("document", F.col("ordinal").alias("owner"), F.col("id").alias("section_id"), "page_start", "page_end"), ["document", "owner"])
            pieces = own.select("section_id", F.lit("body").alias("kind"), (F.row_number().over(W.partitionBy("section_id").orderBy("window")) - 1).alias("ordinal"), "text", F.col("text").alias("content"), F.col("n_tokens").alias("token_count"), "page_start", "page_end")
        else:
            chunked = settled(chunking.chunk_sections(made, grammar))
            pieces = chunked.select(F.col("id").alias("section_id"), F.explode("chunks").alias("c"), "page_start", "page_end").select("section_id", "c.kind", "c.ordinal", "c.text", "c.content", "c.token_count", "page_start", "page_end")
        parents = made.select(F.col("document_id"), F.col("ord").alias("parent"), F.col("id").alias("parent_id"))
        sections = chunked.join(parents, ["document_id", "parent"], "left").select("id", "document_id", F.lit(corpus).alias("corpus_id"), "parent_id", "number", "number_norm", "title", "depth", "path", F.col("clean_body").alias("body"), "page_start", "page_end", "ordinal", F.col("supersedes").alias("supersedes_number"))
        vector = embedder.documents(F.col("text")) if embedder is not None else F.lit(None).cast("array<float>")
        chunks = numbered(pieces, ["section_id", "kind", "ordinal"], bases["chunks"]).withColumn("corpus_id", F.lit(corpus)).withColumn("embedding", vector).withColumn("terms", lexical.terms(F.col("text")))
        documents = listed.join(made.groupBy("document_id").agg(page_count(F.col("page_end")).alias("page_count")), "document_id", "left").select(F.col("document_id").alias("id"), F.lit(corpus).alias("corpus_id"), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("title"), F.lit(layer).alias("layer"), F.lit(version).cast("string").alias("version"), F.col("path").alias("source_path"), "sha256", "page_count", F.current_timestamp().alias("ingested_at"))
        refs = chunked.select(F.col("id").alias("from_section_id"), F.posexplode("refs").alias("at", "r")).select("from_section_id", "at", F.col("r.ref_text"), F.col("r.number").alias("ref_number"), F.col("r.kind").alias("ref_kind"), F.lit(corpus).alias("corpus_id"))
        layers = tables["documents"].unionByName(documents).select(F.col("id").alias("document_id"), "layer")
        all_sections = tables["sections"].unionByName(sections)
        refs = extract.resolved(refs, all_sections.join(layers, "document_id"))
        refs = numbered(refs, ["from_section_id", "at"], bases["cross_refs"])
        of = tables["sections"].select(F.col("id").alias("from_section_id"), "corpus_id")
        older = extract.backfilled(tables["cross_refs"].join(of, "from_section_id", "left"), sections)
        columns = ["id", "from_section_id", "ref_text", "ref_number", "ref_kind", "to_section_id"]
        kinds = [F.count(F.when(F.col("kind") == k, 1)).alias(n) for k, n in (("table", "tables"), ("exception", "exceptions"), ("definition", "definitions"))]
        fit = lambda name, df: df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.schema(name)])
        chunks = settled(fit("chunks", chunks))
        new = {"documents": fit("documents", documents), "sections": fit("sections", sections), "chunks": chunks, "postings": lexical.postings(chunks)}
        changed = {"corpora": self.ensure_corpus(corpus, corpus_title, grammar), "cross_refs": older.select(*columns).unionByName(fit("cross_refs", refs))}
        if replaced:
            changed |= {n: tables[n].select(*new[n].columns).unionByName(new[n]) for n in new}
            self.commit(changed)
        else:
            self.commit(changed, new)
        new = lambda name: self.read(name).where(F.col("id") > bases[name])
        row = new("chunks").agg(F.count("*").alias("chunks"), *kinds).first()
        r = new("cross_refs").agg(F.count("*").alias("cross_refs"), F.count(F.when(F.col("to_section_id").isNull(), 1)).alias("unresolved_refs")).first()
        pages = new("documents").agg(F.sum("page_count")).first()[0]
        stats = {"sections": new("sections").count(), **row.asDict(), **r.asDict(), "page_count": pages}
        order = [f.name for f in schema.schema("ingest_runs")["stats"].dataType]
        run = self.spark.createDataFrame([(time.time_ns(), bases["documents"] + 1, tuple(stats[n] for n in order))], f"id long, document_id long, stats {schema.schema('ingest_runs')['stats'].dataType.simpleString()}")
        done = run.select("id", "document_id", F.current_timestamp().alias("started_at"), F.current_timestamp().alias("finished_at"), F.lit("ok").alias("status"), "stats", F.lit(None).cast("string").alias("error"))
        self.commit({}, {"ingest_runs": done})
        return stats
