"""The engine from files to hits, on small documents written for these tests."""

import pytest
from pyspark.sql import functions as F

from lexatlas.errors import AlreadyIngested, NotFound
from lexatlas.functions import lexical, numbers, vectors
from lexatlas.operators import chunking, evaluate, extract, grammar, lookup, retrieve, tree
from lexatlas.sources import files
from lexatlas.sources.store import Repository

CODE = """Foreword about this booklet.

# CHAPTER 10 WAYS OUT
## SECTION 1004 CROWD SIZE
### 1004.1 General
Rooms are counted by Section 1004.5 and Table 1004.5. See Chapter 3 for uses.

Exception: Sheds of less than nine square metres

1. without heating
### 1004.5 Floor shares
TABLE 1004.5 SHARES BY USE

| use | share |
|---|---|
| reading hall | 5 |

Each guest of a reading hall needs five square metres of floor. Lamps hang high.
### 1004.9 Lanterns
Lanterns glow amber beside every stair.
# CHAPTER 2 WORDS
## SECTION 202 DEFINITIONS
LANTERN. A lamp that is carried.

STAIR. A flight of steps between floors.
"""
CHANGES = """# CHAPTER 10 WAYS OUT
### 1004.5 Floor shares
Each guest of a reading hall needs six square metres of floor.
"""


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    (root / "in").mkdir()
    (root / "in" / "code.md").write_text(CODE)
    (root / "am").mkdir()
    (root / "am" / "changes.md").write_text(CHANGES)
    repo = Repository(spark, f"{root}/repo")
    repo.init(dimensions=64)
    emb = vectors.HashedEmbedder(64)
    stats = repo.ingest(files.scan(spark, f"{root}/in"), files.file_blocks, "town", "Town Code", "code", "base", emb)
    repo.ingest(files.scan(spark, f"{root}/am"), files.file_blocks, "town", "Town Code", "code", "amendment", emb)
    return repo, emb, stats, root


def test_numbers(spark):
    rows = spark.createDataFrame([("1004.5.1",), ("10",), ("4101:1-10-04",), ("12345.1",)], "n string").select(numbers.normalize_number(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["1004.0005.0001", "0010", "4101:0001-0010-0004", "12345.0001"]
    raw = ["Section 1004.5", "§1004.5.", "Table 7", "sec. 9", " chapter 10 "]
    rows = spark.createDataFrame([(x,) for x in raw], "n string").select(numbers.strip_ref_prefix(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["1004.5", "1004.5", "7", "9", "10"]
    assert spark.range(1).select(numbers.title_case(F.lit("FIRE-RATED DOORS (NET)"))).first()[0] == "Fire-Rated Doors (Net)"


@pytest.mark.parametrize(
    ("kind", "text", "want"),
    [
        ("heading", "CHAPTER 10 WAYS OUT", ("10", "Ways Out", 0, "section")),
        ("heading", "SECTION BC 1004 CROWDS", ("1004", "Crowds", 1, "section")),
        ("paragraph", "TABLE 1004.5 Shares", ("1004.5", "Shares", 2, "table-caption")),
        ("heading", "1004.5 Floor shares", ("1004.5", "Floor shares", 2, "section")),
        ("paragraph", "1004.6 Seats. Count seats.", ("1004.6", "Seats", 2, "section")),
        ("paragraph", "Chapter 11 shall apply", None),
    ],
)
def test_grammar(spark, kind, text, want):
    h = spark.range(1).select(grammar.numbered_code(F.lit(kind), F.lit(text), F.lit(1), F.lit(0))).first()[0]
    assert (h and (h["number"], h["title"], h["depth"], h["kind"])) == want


def test_other_grammars(spark):
    h = spark.range(1).select(grammar.rule_code(F.lit("heading"), F.lit("(A) Modify Section 1001.1 to add steps"), F.lit(1), F.lit(0))).first()[0]
    assert (h["number"], h["supersedes"], h["alias"], h["depth"]) == ("1001.1", "1001.1", "A", 1)
    h = spark.range(1).select(grammar.plain(F.lit("heading"), F.lit("Purpose"), F.lit(2), F.lit(7))).first()[0]
    assert (h["number"], h["depth"]) == ("H2-0007", 1)
    with pytest.raises(ValueError, match="available: code, rules, plain"):
        grammar.grammar("x")


def test_backwards_paragraph_is_body(spark):
    text = "# CHAPTER 9 X\n### 901.5 Five\nText.\n\n901.2 Two. This line goes backwards.\n\n901.7 Seven. Onwards it goes."
    blocks = files.markdown_blocks(spark.createDataFrame([("d", text)], "document string, text string"))
    got = [(r["number"], r["paragraphs"]) for r in tree.build(blocks, "code").orderBy("ordinal").collect()]
    assert got == [("9", []), ("901.5", ["Text.", "901.2 Two. This line goes backwards."]), ("901.7", ["Onwards it goes."])]


def test_repeated_numbers_and_late_title(spark):
    text = "# CHAPTER 9\n# WAYS OUT\n### 901.5 Five\nA.\n### 901.5 Five again\nB."
    blocks = files.markdown_blocks(spark.createDataFrame([("d", text)], "document string, text string"))
    rows = tree.build(blocks, "code").orderBy("ordinal").collect()
    assert [(r["number"], r["title"]) for r in rows] == [("9", "Ways Out"), ("901.5", "Five"), ("901.5(2)", "Five again")]


def test_exceptions_and_definitions(spark):
    ps = ["Body.", "Exception: sheds", "goes on.", "1. item.", "After all."]
    r = spark.range(1).select(extract.split_exceptions(F.array(*[F.lit(p) for p in ps])).alias("x")).first()["x"]
    assert (r["body"], r["exceptions"]) == (["Body.", "After all."], ["Exception: sheds\ngoes on.\n1. item."])
    d = spark.range(1).select(extract.split_definitions(F.lit("Intro.\nLAMP. A light.\n\nSTAIR. Steps."))).first()[0]
    assert [(x["term"], x["definition"]) for x in d] == [("LAMP", "A light."), ("STAIR", "Steps.")]
    assert spark.range(1).select(extract.split_definitions(F.lit("LAMP. A light."))).first()[0] == []


def test_cross_refs(spark):
    t = "Section 1004.5, Sections 1004.5 and Table 1004.5; Chapter 3, Chapter 100, Section 12 and 1005.1."
    got = [(x["number"], x["kind"]) for x in spark.range(1).select(extract.cross_refs(F.lit(t))).first()[0]]
    assert got == [("1004.5", "section"), ("1004.5", "table"), ("3", "chapter")]
    got = [x["number"] for x in spark.range(1).select(extract.references_in(F.lit(t))).first()[0]]
    assert got[-1] == "1005.1"


def test_packing_loses_nothing(spark):
    long = " ".join(f"Sentence number {i} says little." for i in range(400))
    pieces = spark.range(1).select(chunking.pack(F.array(F.lit("Short."), F.lit(long)), F.lit("A > B"))).first()[0]
    assert " ".join(" ".join(pieces).split()) == " ".join(f"Short. {long}".split())
    assert all(len(p.split()) < 900 and p.endswith(".") for p in pieces)


def test_html_blocks():
    html = "<nav>x</nav><h1>Top</h1><p>One <b>two</b></p><ul><li>item</li></ul><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"
    assert files.parse_html(html) == [("heading", "Top", 1), ("paragraph", "Onetwo", None), ("list-item", "item", None), ("table", "| a | b |\n|---|---|\n| 1 | 2 |", None)]


def test_pdf_line_rules(spark):
    rows = [("d", p, 0, "Running head", 8.0, False, False) for p in (1, 2, 3)]
    rows += [("d", 1, 1, "Big title that", 14.0, True, False), ("d", 1, 2, "wraps here", 14.0, True, False), ("d", 1, 3, "Body one", 10.0, False, False), ("d", 1, 4, "body two.", 10.0, False, False), ("d", 2, 1, "New page.", 10.0, False, False)]
    lines = spark.createDataFrame(rows, files.LINE_DDL)
    got = [(r["kind"], r["text"]) for r in files.pdf_blocks(lines).orderBy("ord").collect()]
    assert got == [("heading", "Big title that wraps here"), ("paragraph", "Body one body two."), ("paragraph", "New page.")]


def test_ingest_and_tree(store):
    repo, _, stats, _ = store
    assert (stats["exceptions"], stats["definitions"], stats["tables"]) == (1, 2, 1)
    s = {(r["number"], r["document_id"]): r for r in repo.read("sections").collect()}
    assert s["FRONT", 1]["depth"] == 0
    assert s["1004.5", 1]["path"] == "Town Code > 10 Ways Out > 1004 Crowd Size > 1004.5 Floor shares"
    assert s["1004.5", 1]["parent_id"] == s["1004", 1]["id"]
    assert s["1004.5", 2]["supersedes_number"] == "1004.5"
    assert "Sheds" in s["1004.1", 1]["body"]
    kinds = {(r["kind"]) for r in repo.read("chunks").where(F.col("section_id") == s["1004.1", 1]["id"]).collect()}
    assert kinds == {"body", "exception"}


def test_same_bytes_are_refused(store, spark):
    repo, emb, _, root = store
    with pytest.raises(AlreadyIngested):
        repo.ingest(files.scan(spark, f"{root}/in"), files.file_blocks, "town", "Town Code", "code", "base", emb)


def test_search_modes(store):
    repo, emb, _, _ = store
    st = repo.open()
    for mode in retrieve.MODES:
        out = retrieve.search(st, emb, "lanterns glow amber beside stairs", ["town"], 3, mode=mode)
        assert "1004.9" in [r["section"]["number"] for r in out["hits"].collect()], mode
    with pytest.raises(ValueError):
        retrieve.search(st, emb, "x", mode="other")
    with pytest.raises(NotFound, match="available: town"):
        retrieve.search(st, emb, "x", ["city"])


def test_number_first_and_amendment_above(store):
    repo, emb, _, _ = store
    out = retrieve.search(repo.open(), emb, "what does 1004.5 say about guests", ["town"], 4, mode="lexical")
    hits = [(r["section"]["number"], r["document"]["layer"], r["scores"]["overlay"]) for r in out["hits"].collect()]
    assert hits[0][0] == "1004.5"
    base = hits.index(("1004.5", "base", False))
    assert hits[base - 1][:2] == ("1004.5", "amendment")


def test_abstains(store):
    repo, emb, _, _ = store
    assert retrieve.search(repo.open(), emb, "zebra quantum pudding", mode="lexical")["abstain"]


def test_lookup_and_context(store, spark):
    repo, _, _, _ = store
    st = repo.open()
    d = retrieve.get_section(st, "Section 1004.5", "town").first()
    assert d["layer"] == "amendment"
    with pytest.raises(NotFound, match="close to it: .*1004"):
        retrieve.get_section(st, "1004.7", "town")
    c = retrieve.get_context(st, "1004.5", "town")
    assert [a["number"] for a in c["ancestors"]] == ["10", "1004"]
    assert (c["previous"]["number"], c["next"]["number"]) == ("1004.1", "1004.9")
    assert c["citation"].startswith("code §1004.5")
    refs = retrieve.resolve_references(st, spark.createDataFrame([(1, "See Section 1004.9 and 999.9.")], "id int, text string")).collect()
    assert [(r["number"], r["found"]) for r in refs] == [("1004.9", True), ("999.9", False)]
    rows = lookup.list_corpora(st.corpora, st.documents, st.sections, st.chunks).collect()
    assert rows[0]["id"] == "town" and len(rows[0]["documents"]) == 2


def test_delete_cascades(store, spark, tmp_path):
    repo, emb, _, root = store
    other = Repository(spark, str(tmp_path / "r"))
    other.init(dimensions=64)
    other.ingest(files.scan(spark, f"{root}/in"), files.file_blocks, "t", "T", "code", "base", emb)
    other.delete(1)
    assert [other.read(t).count() for t in ("documents", "sections", "chunks", "cross_refs")] == [0, 0, 0, 0]


def test_query_syntax():
    q = lexical.parse('fire "exit door" OR ramp -steel')
    assert (q.groups, q.without) == ([[["fire"], ["exit", "door"]], [["ramp"]]], [["steel"]])


def test_lexical_matching(spark):
    rows = [(1, "fire exit door"), (2, "door exit fire"), (3, "ramp of steel"), (4, "ramp")]
    index = lexical.postings(spark.createDataFrame(rows, "id long, text string"))
    got = {r["key"]: round(r["score"], 4) for r in lexical.matching(index, lexical.parse('fire "exit door" OR ramp -steel')).collect()}
    assert got == {1: 0.1, 4: 0.1}


def test_evaluation(spark):
    q = spark.createDataFrame([("a", ["10.1"], ["body"], ["x"]), ("b", ["10.2"], None, []), ("c", [], None, [])], "id string, expected_sections array<string>, expected_kinds array<string>, tags array<string>")
    h = spark.createDataFrame([("m", "a", 1, "9", [], False), ("m", "a", 2, "10.1", ["body"], False), ("m", "b", 1, "10", [], False), ("m", "c", 1, "1", [], True)], "mode string, id string, rank int, number string, kinds array<string>, abstain boolean")
    s = {r["tag"]: r for r in evaluate.summarize(evaluate.score(h, q)).collect()}
    assert (s[None]["hit@1"], s[None]["hit@3"], s[None]["mrr"], s[None]["kind@5"], s[None]["abstain"]) == (0.25, 0.75, 0.5, 1.0, 1.0)
    assert s["x"]["n"] == 1 and s["untagged"]["n"] == 2


def test_fixed_windows_and_watching(spark, tmp_path):
    from lexatlas.streaming.watch import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "code.md").write_text(CODE)
    repo = Repository(spark, str(tmp_path / "r"))
    repo.init(dimensions=16)
    emb = vectors.HashedEmbedder(16)
    seen = []

    def take(df):
        seen.append(repo.ingest(df, files.file_blocks, "t__naive", "T", "code", "base", emb, naive=True))

    for _ in range(2):  # the second time there is nothing new
        watch(spark, str(tmp_path / "in"), take, str(tmp_path / "cp")).awaitTermination(120)
    assert len(seen) == 1 and seen[0]["exceptions"] == 0
    chunks = repo.read("chunks").collect()
    assert [c["kind"] for c in chunks] == ["body"] * len(chunks) and chunks
    with pytest.raises(ValueError, match="allow_remote"):
        vectors.embedder("openai", 16)


def test_a_lost_commit_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    """A run that is lost before its manifest is whole changes nothing, and the next one isn't hurt by what it left."""
    from lexatlas.sources.store import Repository

    repo = Repository(spark, f"file://{tmp_path}/s")
    assert repo.version() is None
    repo.init(dimensions=8)
    one = repo.ensure_corpus("a", "A", "code")
    monkeypatch.setattr(Repository, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        repo.commit({"corpora": one})
    monkeypatch.undo()
    (tmp_path / "s" / "_SNAPSHOT.9").touch()  # a manifest that was never written
    assert repo.version() == 1 and repo.read("corpora").count() == 0
    assert repo.commit({}, {"corpora": one}) == 2 and repo.read("corpora").count() == 1
    assert repo.commit({}, {"corpora": repo.ensure_corpus("b", "B", "code").where("id = 'b'")}) == 3 and repo.read("corpora").count() == 2
    with pytest.raises(OSError):
        repo._publish(3, {})


def test_numbers_are_given_without_one_task(spark):
    from lexatlas.sources.store import numbered

    df = spark.range(1000).selectExpr("id % 37 AS a", "id AS b")
    out = numbered(df, ["a", "b"], 50)
    got = [(r["a"], r["b"]) for r in out.orderBy("id").collect()]
    assert got == sorted(got) and sorted(r["id"] for r in out.collect()) == list(range(51, 1051))


def test_files_that_no_parser_takes_are_told(spark):
    from lexatlas.sources import files

    known = spark.createDataFrame([("a.md", bytearray(b"# A"), "x")], "path string, content binary, sha256 string")
    other = spark.createDataFrame([("b.xyz", bytearray(b"?"), "y")], known.schema)
    assert files.all_blocks(known).count() == 1
    with pytest.raises(Exception, match="no parser for b.xyz"):
        files.file_blocks(known.unionByName(other)).collect()


def test_split_exceptions_reads_each_paragraph_once(spark):
    """Long sections: 3,000 paragraphs took a pass over all for each before; the parts are those of a plain walk, in an expression that is not named over and over."""
    import random

    rng = random.Random(5)
    ps = [rng.choice(("Exception: a.", "1. b.", "- c", "d.", " e ", "f;")) for _ in range(3000)]
    body, out, runs = [], [], []
    for i, p in enumerate(ps):
        item = p.startswith(("1.", "- "))
        if p.startswith("Exception") or i == 0 or not (item or ps[i - 1].rstrip()[-1] not in ".;:"):
            runs.append([])
        runs[-1].append(p)
    for r in runs:
        if r[0].startswith("Exception"):
            out.append("\n".join(p.strip() for p in r))
        else:
            body += r
    found = spark.createDataFrame([(ps,), (None,), ([],)], "ps array<string>").select(extract.split_exceptions(F.col("ps")).alias("x"))
    got = [r["x"] for r in found.collect()]
    assert got[0]["body"] == body and got[0]["exceptions"] == out
    assert all(g["body"] == [] and g["exceptions"] == [] for g in got[1:])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("(?i)^") == 1


def test_windows_within_rows(spark):
    """Windows made within a row are those of dealt tokens: owners by most tokens, of equals the first; blank windows left out."""
    from pyspark.sql import functions as F

    from lexatlas.operators import chunking

    docs = [(1, [(0, "a"), (1, "b"), (1, "c"), (0, "d"), (2, "e")]), (2, [(0, " "), (0, " "), (0, " "), (0, " "), (3, "x")]), (3, [])]
    frame = spark.createDataFrame(docs, "document long, tokens array<struct<owner:int,token:string>>")
    dealt = frame.select("document", F.posexplode("tokens").alias("pos", "x")).select("document", "pos", "x.owner", "x.token")
    names = ["document", "window", "owner", "n_tokens", "text"]
    within = frame.select("document", F.inline(chunking.windows_within(F.col("tokens"), 4)))
    assert sorted(map(tuple, within.select(names).collect())) == sorted(map(tuple, chunking.windows(dealt, 4).select(names).collect()))
    assert "Exchange" not in within._jdf.queryExecution().executedPlan().toString()
