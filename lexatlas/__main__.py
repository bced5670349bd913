"""Command line: init, ingest, corpora, search, section, remove and evaluate on a store."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from lexatlas.errors import guarded
from lexatlas.functions.vectors import embedder
from lexatlas.operators import evaluate, lookup, retrieve
from lexatlas.settings import Settings
from lexatlas.sources import files
from lexatlas.sources.store import Repository


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexatlas")
    p.add_argument("--store", required=True)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("init")
    sub.add_parser("reset")
    sub.add_parser("corpora")
    i = sub.add_parser("ingest")
    for name in ("path", "corpus", "title"):
        i.add_argument(name)
    i.add_argument("--grammar", default="code")
    i.add_argument("--layer", default="base")
    i.add_argument("--force", action="store_true")
    i.add_argument("--naive", action="store_true", help="fixed windows, into the corpus <corpus>__naive")
    r = sub.add_parser("remove")
    r.add_argument("document", type=int)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--corpus", action="append")
    s.add_argument("-k", type=int, default=8)
    s.add_argument("--mode", default="hybrid")
    g = sub.add_parser("section")
    g.add_argument("number")
    g.add_argument("--corpus")
    e = sub.add_parser("eval")
    e.add_argument("golden")
    e.add_argument("--gate", action="append", default=[])
    a = p.parse_args(argv)
    settings = Settings.load()
    spark = SparkSession.builder.appName("lexatlas").getOrCreate()
    repo, emb = Repository(spark, a.store), embedder(settings.provider, settings.dimensions, settings.allow_remote)

    def work() -> int:
        if a.what == "init":
            repo.init(settings.provider, emb.name, settings.dimensions)
        elif a.what == "reset":
            repo.reset()
        elif a.what == "ingest":
            corpus = f"{a.corpus}__naive" if a.naive else a.corpus
            print(json.dumps(repo.ingest(files.scan(spark, a.path), files.parsed, corpus, a.title, a.grammar, a.layer, emb, a.force, a.naive)))
        elif a.what == "remove":
            repo.delete(a.document)
        elif a.what == "corpora":
            st = repo.open()
            for row in lookup.list_corpora(st.corpora, st.documents, st.sections, st.chunks).toJSON().toLocalIterator():
                print(row)
        elif a.what == "search":
            out = retrieve.search(repo.open(), emb, a.query, a.corpus, a.k, mode=a.mode, settings=settings)
            print(json.dumps({k: v for k, v in out.items() if k != "hits"} | {"hits": [json.loads(x) for x in out["hits"].toJSON().collect()]}))
        elif a.what == "section":
            print(lookup.section_markdown(retrieve.get_section(repo.open(), a.number, a.corpus)).first()["markdown"])
        else:
            return _evaluate(spark, repo, emb, settings, a)
        return 0

    code, message = guarded(work)
    if message:
        print(message, file=sys.stderr)
    return 1 if message else int(code or 0)


def _evaluate(spark: SparkSession, repo: Repository, emb: object, settings: Settings, a: argparse.Namespace) -> int:
    questions = files.golden(spark, a.golden)
    store = repo.open()

    def ask(mode: str, question: str, corpus: str | None) -> tuple[list[dict], bool]:
        where = f"{corpus}__naive" if mode == "naive" and corpus else corpus
        out = retrieve.search(store, emb, question, [where] if where else None, 10, mode="hybrid" if mode == "naive" else mode, settings=settings)
        rows = out["hits"].select("section.number", "matched_chunks.kind").collect()
        return [{"number": r[0], "kinds": r[1] or []} for r in rows], out["abstain"]

    summary = evaluate.summarize(evaluate.score(evaluate.run(ask, questions, ("naive", "vector", "lexical", "hybrid")), questions))
    print(evaluate.report(summary))
    broken = evaluate.gate(summary, "hybrid", a.gate)
    print("\n".join(broken), file=sys.stderr)
    return int(bool(broken))


if __name__ == "__main__":
    sys.exit(main())
