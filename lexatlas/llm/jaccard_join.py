"""N-gram Jaccard join: a size-aware heavy-light set similarity join over word shingles.

Light sets, up to a boundary, enumerate subsets: two sets of sizes a and b whose similarity reaches the threshold share
c(a, b) = ceil(t (a + b) / (1 + t)) elements, so they share a subset of just that size, keyed by the two sizes. A key links
its sets of the smaller size with all others that have it, as c(a, b) is enough for each such pair; two sets of the larger
size may need more and aren't linked by it, so nothing is left to verify. Heavy sets scan inverted lists: of each set only the
a - ceil(t a) + 1 rarest shingles are listed, by exact document counts over the whole corpus, and those that no other
document has are not listed at all. The boundary minimises the cost over the histogram of sizes.

Within a list pairs aren't enumerated. Rounds of stars come first: all members of a list are held against one of them,
and what links is one component. Only members that still lie in different components are then compared, all of them, each
pair of which one lies outside the list's largest component. So a group of thousands of near copies costs a few rows per
member, and no link between components can be lost. Candidates must pass exact bounds from sizes and parity sketches
before their sets meet; the verdict is on whole sets.

Equal shingle sets are one node, keyed by a 64-bit hash of the set, whatever the number of their copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._counts import BLOCK_BYTES, answers, count_blocks, known, tally, with_block
from ._text import mix, run_hashes, signed, slices, word_hashes
from ._work import blocks_of, drop, saved
from .components import components

_U = np.uint64
#: 64-bit words of a parity sketch: one bit for each shingle, toggled; two sets differ in as many shingles at least.
SKETCH = 8
#: Largest size that may be a light set's; subsets grow fast beyond.
LIGHT = 20
#: Lists of a set up to which its pairs are made once each.
MANY = 256
#: Rounds of stars before the remaining members are compared with each other.
ROUNDS = 2


def need(a: int, b: int, percent: int) -> int:
    """Shared elements at least of two linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def partners(a: int, percent: int) -> range:
    return range(-(-percent * a // 100), a * 100 // percent + 1)


def subsets_of(a: int, percent: int) -> int:
    """Keys that a light set of size a enumerates."""
    return sum(comb(a, need(a, b, percent)) for b in partners(a, percent) if need(a, b, percent) <= min(a, b))


def listed(a: int, percent: int) -> int:
    """Shingles of a set of size a that are listed."""
    return a - -(-percent * a // 100) + 1


def boundary(sizes: dict[int, int], percent: int) -> int:
    """Largest light size: least sum of enumerated subsets below and of counted and listed shingles above; sets just above
    and below a boundary meet in the lists, so those below within reach of it are counted on both sides."""
    def cost(x: int) -> int:
        low = -(-percent * (x + 1) // 100)
        return sum(n * ((subsets_of(a, percent) if a <= x else 0) + (a + listed(a, percent) if a > x or a >= low else 0)) for a, n in sizes.items() if a <= LIGHT)

    return min(range(LIGHT + 1), key=lambda x: (cost(x), x))


def shingle_sets(texts: pa.Array, words: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text: (per text, all, first of each text). A text with fewer words is one
    shingle of all of them; one without words has none."""
    h, firsts = word_hashes(texts, True)
    g = run_hashes(h, words)
    out = []
    for s, e in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if e - s >= words:
            out.append(np.unique(g[s : e - words + 1]))
        elif e > s:
            out.append(run_hashes(h[s:e], e - s))
        else:
            out.append(g[:0])
    sizes = np.array([len(x) for x in out], np.int64)
    return out, (np.concatenate(out) if out else g[:0]), np.concatenate([[0], np.cumsum(sizes)])


def set_key(s: np.ndarray) -> int:
    """A set's node: 64 bits of all its elements."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        x = mix(np.array([np.add.reduce(mix(s ^ _U(0x2545F4914F6CDD1D))) + _U(len(s))], _U))
    return int(signed(x)[0])


def sketch_of(s: np.ndarray) -> np.ndarray:
    bits = np.bincount((s >> _U(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def _differ(x: str, y: str) -> Column:
    """Elements in which two sets differ at least, from their sketches."""
    return sum((F.bit_count(F.col(f"{x}.k{i}").bitwiseXOR(F.col(f"{y}.k{i}"))) for i in range(SKETCH)), F.lit(0))


def _possible(x: str, y: str, percent: int) -> Column:
    """Whether sizes and sketches leave room for a link: |A xor B| <= (1 - t) (a + b) / (1 + t)."""
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * _differ(x, y) <= (100 - percent) * (a + b))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose sets reach the threshold, by whole sets."""
    one = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(judge, "a long, b long")


def _spread(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows`` (key, t) with ``deal``, by which they are dealt into blocks: copies of a text share one unless they fill more,
    else their keys deal them over as many as they fill. At most ``blocks`` texts can fill a block each, so these are broadcast."""
    h = F.xxhash64("t")
    size = rows.groupBy(h.alias("h")).agg(F.sum(F.octet_length("t")).alias("size"))
    hot = saved(size.where(F.col("size") > BLOCK_BYTES).select("h", F.ceil(F.col("size") / BLOCK_BYTES).alias("parts")), "jaccard-hot")
    share = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("key"), F.col("parts"))).otherwise(F.lit(0).cast("long"))
    found = rows.withColumn("h", h).join(F.broadcast(hot), "h", "left")
    return found.select("key", "t", F.xxhash64("h", share).alias("deal"))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``docs``.

    A text's set is its distinct shingles of ``words`` words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; with fewer words, the
    whole sequence. Two rows are linked when 100 * intersection >= percent * union; ``component_id`` is the smallest key
    reachable by links. A null, empty or blank text has no shingles and no links. Null keys take part and show the
    smallest key of their component, null if there is none. Repeated rows link as copies do. Other columns, whatever
    their names, are left out. An empty table gives an empty one.
    """
    kind = docs.schema[key].dataType.simpleString()
    blocks = blocks_of(docs, text, BLOCK_BYTES)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    dealt = with_block(_spread(rows, blocks), F.col("deal"), blocks)

    def items_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        # documents are counted once for each distinct text of the batch
        _, flat, _ = shingle_sets(b.column("t").unique(), words)
        flat = flat & ~_U(1)
        return flat, np.ones(len(flat), np.int32)

    answered = answers(count_blocks(dealt, "t", items_of, blocks), "jaccard-counts")
    words_of = F.least(F.coalesce(F.regexp_count("t", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), F.lit(LIGHT + words))
    short = rows.where(F.octet_length("t") < 40 * (LIGHT + words)).groupBy(words_of.alias("w")).count().collect()
    sizes: dict[int, int] = {}
    for r in short:  # of at most LIGHT + words rows; a text's words bound its shingles
        if r["w"]:
            sizes[max(1, r["w"] - words + 1)] = sizes.get(max(1, r["w"] - words + 1), 0) + r["count"]
    light = boundary(sizes, percent)
    low = -(-percent * (light + 1) // 100)

    def list_block(own: pa.Table, answer: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        batches = list(slices(iter(own.combine_chunks().to_batches()), "t"))
        flat = [shingle_sets(b.column("t").unique(), words)[1] & ~_U(1) for b in batches]
        items, counts = tally(np.concatenate(flat or [np.zeros(0, _U)]), np.ones(sum(map(len, flat)), np.int32))
        totals = known(answer, items, counts, blocks)
        seen: set[int] = set()
        for b in batches:
            coded = b.column("t").dictionary_encode()
            sets, _, _ = shingle_sets(coded.dictionary, words)
            nodes = np.array([set_key(s) for s in sets], np.int64)
            n = np.array([len(s) for s in sets], np.int64)
            code = coded.indices.to_numpy(zero_copy_only=False)
            k = len(code)
            cols: dict[str, list] = {"what": [0] * k, "node": nodes[code].tolist(), "n": n[code].tolist(), "item": [None] * k, "items": [None] * k}
            keys = b.column("key").to_pylist()
            sketches: list = [np.zeros(SKETCH, np.int64)] * k
            for s, node in zip(sets, nodes.tolist(), strict=True):
                a = len(s)
                if not a or node in seen:
                    continue
                seen.add(node)
                found: list[tuple[int, int]] = []
                if a <= light:
                    for p in partners(a, percent):
                        c = need(a, p, percent)
                        if c <= min(a, p) and p <= light:
                            code_ab = (min(a, p) << 16 | max(a, p)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
                            for part in combinations(s.tolist(), c):
                                x = int(mix(np.array([(sum(part) * 0xD6E8FEB86659FD93 + code_ab) & (1 << 64) - 1], _U)).view(np.int64)[0])
                                found.append((1 if a <= p else 4, x))
                if a > light or a >= low:
                    df = totals[np.searchsorted(items, s & ~_U(1))]
                    order = np.lexsort((s, df))[: listed(a, percent)]
                    found += [(2, int(x)) for x in signed(s[order][df[order] > 1])]
                if not found:
                    continue
                heavy = any(w == 2 for w, _ in found)
                sketch = sketch_of(s)
                m = len(found) + heavy
                cols["what"] += [w for w, _ in found] + [3] * heavy
                cols["item"] += [x for _, x in found] + [None] * heavy
                cols["node"] += [node] * m
                cols["n"] += [a] * m
                cols["items"] += [None] * len(found) + [s.tobytes()] * heavy
                keys += [None] * m
                sketches += [sketch] * m
            kinds = pa.array(keys, own.schema.field("key").type)
            grid = np.array(sketches, np.int64).reshape(len(sketches), SKETCH)
            out.append(pa.RecordBatch.from_arrays([pa.array(cols["what"], pa.int32()), kinds, pa.array(cols["node"], pa.int64()), pa.array(cols["n"], pa.int64()), pa.array(cols["item"], pa.int64()), pa.array(cols["items"], pa.binary()), *[pa.array(grid[:, i]) for i in range(SKETCH)]], ["what", "key", "node", "n", "item", "items", *[f"k{i}" for i in range(SKETCH)]]))
        schema = pa.schema([("what", pa.int32()), ("key", own.schema.field("key").type), ("node", pa.int64()), ("n", pa.int64()), ("item", pa.int64()), ("items", pa.binary()), *[(f"k{i}", pa.int64()) for i in range(SKETCH)]])
        return pa.Table.from_batches(out, schema)

    back = answered.where("block >= 0").select("block", "part", "places", "totals")
    sketch = ", ".join(f"k{i} long" for i in range(SKETCH))
    made = saved(dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(list_block, f"what int, key {kind}, node long, n long, item long, items binary, {sketch}"), "jaccard-lists")
    drop(answered)
    members = made.where("what = 0").select("key", "node", "n")
    sets = made.where("what = 3").select("node", "items").dropDuplicates(["node"])
    # light sets: those of a key's smaller size (1) are linked with each other and with those of the larger (4), which
    # aren't by themselves; one star around one of the smaller says so
    shared = made.where("what in (1, 4)").select("item", "node", "what").distinct()
    # aggregates are written before they are joined, here and below, so that a hot key's join can be split
    hub = shared.groupBy("item").agg(F.min(F.when(F.col("what") == 1, F.col("node"))).alias("a"), F.count("*").alias("m")).where("m > 1 and a is not null").select("item", "a")
    hub = saved(hub, "jaccard-hubs")
    edges = saved(shared.join(hub, "item").where("node != a").select("a", F.col("node").alias("b")).distinct(), "jaccard-edges")
    # heavy sets: lists of two members at least
    cols = ["node", "n", *[f"k{i}" for i in range(SKETCH)]]
    entries = made.where("what = 2").select("item", *cols).dropDuplicates(["item", "node"])
    long_lists = saved(entries.groupBy("item").agg(F.count("*").alias("m")).where("m > 1").select("item"), "jaccard-long")
    lists = saved(entries.join(long_lists, "item"), "jaccard-entries")
    drop(hub, long_lists)
    tables = [edges]
    for turn in range(ROUNDS + 1):
        linked = components(tables[0] if len(tables) == 1 else _all(tables))
        roots = saved(linked, "jaccard-roots")
        of = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if turn == ROUNDS:
            break
        member = F.struct("root", *cols)
        split = of.groupBy("item").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min_by(member, F.xxhash64("node", F.lit(turn), "item") if turn else F.struct("n", "node")).alias("q")).where("r0 != r1").select("item", "q")
        split = saved(split, "jaccard-stars")
        pairs = of.alias("p").join(split.alias("s"), "item").where("p.root != s.q.root").select(F.struct(*[F.col(f"p.{c}") for c in cols]).alias("p"), F.col("s.q").alias("q"))
        pairs = pairs.where(_possible("p", "q", percent)).select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()
        tables.append(saved(_verified(pairs, sets, percent), "jaccard-edges"))
        drop(roots, split)
    # the rest: members outside their list's largest component against all members of other components
    weight = of.groupBy("item", "root").agg(F.count("*").alias("m"))
    largest = weight.groupBy("item").agg(F.max_by("root", F.struct("m", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1").select("item", "top")
    largest = saved(largest, "jaccard-largest")
    left = saved(of.join(largest, "item"), "jaccard-left")
    # a pair that meets in many lists is made in the first of them only; for sets in very many lists that isn't looked up
    held = left.groupBy("node").agg(F.count("*").alias("m"), F.collect_list("item").alias("in")).where(F.col("m") <= MANY).select("node", "in")
    held = saved(held, "jaccard-held")
    left = saved(left.join(held, "node", "left"), "jaccard-left")
    p, q = left.where("root != top").alias("p"), left.alias("q")
    first = F.coalesce(F.array_min(F.array_intersect("p.in", "q.in")) == F.col("p.item"), F.lit(True))
    rest = p.join(q, (F.col("p.item") == F.col("q.item")) & (F.col("p.root") != F.col("q.root")) & _possible("p", "q", percent) & first)
    rest = rest.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()
    tables.append(saved(_verified(rest, sets, percent), "jaccard-edges"))
    drop(roots, left, largest, held)
    roots = components(_all(tables))
    node_of = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # without shingles there are no links, so each such row is its own
    linked = node_of.where("n > 0")
    # written before it is joined, so that the join can be split
    least = saved(linked.groupBy("root").agg(F.min("key").alias("least")), "jaccard-least")
    out = linked.join(least, "root").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return out.unionByName(members.where("n = 0").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("key").alias("component_id")))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
