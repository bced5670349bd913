"""Quality classifier: overlapping heuristic labellers, expectation-maximisation of their accuracies, and a hashed
linear scorer trained on the posterior labels.

Each labeller votes for (1) or against a class (-1) or abstains (0) on a document; human labels, where there are any, are
one more among them, whose accuracy is set rather than estimated, and which others may outvote. One labeller of toxicity
has learnt its words from a sample of the labelled documents. Votes are counted by pattern over the whole corpus, a table whose
size depends on the number of labellers alone, and expectation-maximisation finds how often each labeller votes in
either class from these counts (Dawid and Skene, 1979). The posterior is log-linear in the votes. Of hashed words and binned signals, those whose share of the class differs from the
sample's by some standard errors are found by distributed counts, so that the thousands of words of a long text don't add up
to noise; a linear model over them is then fitted to the posteriors of a bounded sample, drawn by hash from all documents, and scores every
whole document. The same is done twice, for quality and for toxicity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import PLAIN, buffer_of, mix, prefix_hashes, slices, word_hashes
from ._work import drop, saved
from .decontamination import plain_words

#: Documents of the sample that the scorer is fitted on, at most about; buckets of its features; of a feature with a
#: weight the least number of sample documents and of standard errors.
SAMPLE, BUCKETS, LEAST, STRONG = 12000, 1 << 18, 4, 4.5
#: Common English insults, nouns and adjectives, one list for each of two labellers.
NOUNS = ("idiot", "moron", "imbecile", "loser", "scum", "clown", "trash", "jerk", "fool", "creep", "bastard", "bitch", "asshole", "retard", "freak", "pig", "whore", "slut")
ADJECTIVES = ("stupid", "dumb", "pathetic", "worthless", "disgusting", "ugly", "filthy", "brainless", "despicable", "useless", "vile", "hateful")

_U = np.uint64
#: Signals, each with the value from which a document looks bad.
SIGNALS = {"symbols": 0.06, "capitals": 0.45, "exclaims": 0.2, "pipes": 0.1, "same_word": 0.3, "stutter": 0.1, "same_line": 0.45, "long_words": 0.2}
#: Words that the learning labeller keeps at most, the strongest first; share of toxic documents among those that have one, at least.
LEARNT, MOSTLY = 4096, 0.9
#: Accuracy of human labels.
TRUST = 0.98
#: Bytes of the beginnings of words that are features as words are: compounds and inflections share them.
HEADS = (4, 6, 7)
QUALITY = (*SIGNALS, "label")
TOXICITY = ("nouns", "adjectives", "learnt", "label")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER, _LETTER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = 1
_SYMBOL, _SPACE = _class("#$%&*+<=>@[]^_`{}~\\/"), _class(" \t\n\r\x0b\x0c")


def _lexicon(words: tuple[str, ...]) -> np.ndarray:
    return np.unique(plain_words(pa.array(words, pa.string()))[0])


_LEXICONS = _lexicon(NOUNS), _lexicon(ADJECTIVES)


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash of 36 bits, how often) for the distinct hashes of each text; a batch has fewer than 2**28 texts."""
    key = np.sort(doc.astype(_U) << _U(36) | h >> _U(28))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[at] >> _U(36)).astype(np.int64), key[at] & _U((1 << 36) - 1), np.diff(np.append(at, len(key)))


def describe(texts: pa.Array, words_too: bool = True, learnt: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signals by text in the order of SIGNALS, hits of both word lists and of ``learnt`` words by text, text and bucket of each feature).

    Features are a text's distinct words, their first letters, and its signals in bins; without ``words_too`` none.
    """
    n = len(texts)
    offsets, data = buffer_of(texts)
    low = pc.utf8_lower(texts.cast(pa.large_string()))
    words, heads, firsts = prefix_hashes(low, HEADS if words_too else (), PLAIN)
    raw, raw_firsts = word_hashes(texts, True)
    raw_doc = np.repeat(np.arange(n), np.diff(raw_firsts))
    size = np.maximum(np.diff(raw_firsts), 1)
    h = np.array([np.bincount(data[s:e], minlength=256) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]).reshape(n, 256)
    solid, letters = np.maximum(1, h.sum(1) - h @ _SPACE), np.maximum(1, h @ _LETTER)
    again = np.concatenate([[False], (raw[1:] == raw[:-1]) & (raw_doc[1:] == raw_doc[:-1])]) if len(raw) else np.zeros(0, bool)
    stutter = np.bincount(raw_doc[again], minlength=n) / size
    top = np.zeros(n, np.int64)
    t, _, often = _distinct(raw_doc, raw)
    np.maximum.at(top, t, often)
    lines = np.zeros(n)
    for i, x in enumerate(texts):
        parts = [y for y in (x.as_py() or "").split("\n") if len(y) > 20]
        lines[i] = 1 - len(set(parts)) / len(parts) if len(parts) >= 4 else 0.0
    values = np.stack([h @ _SYMBOL / solid, h @ _UPPER / letters, h[:, 33] / size, h[:, 124] / size, np.where(size >= 8, top / size, 0), stutter, lines, np.maximum(0.0, solid / size - 25) / 25], 1)
    doc = np.repeat(np.arange(n), np.diff(firsts))
    hits = np.stack([np.bincount(doc[np.isin(words, x)], minlength=n) for x in (*_LEXICONS, np.zeros(0, _U) if learnt is None else learnt)], 1)
    if not words_too:
        return values, hits, doc[:0], doc[:0]
    bins = np.concatenate([np.minimum(15, np.ceil(np.log2(1 + 256 * values)) + 4 * (values >= list(SIGNALS.values()))).astype(np.int64), np.minimum(hits[:, : len(_LEXICONS)], 3)], 1)
    tokens = mix(((np.arange(bins.shape[1]) + 1) * 64 + bins).astype(_U) * _U(0x9E3779B97F4A7C15))
    found = [_distinct(doc, words)[:2], *[_distinct(doc[at], x)[:2] for at, x in heads], _distinct(np.repeat(np.arange(n), bins.shape[1]), tokens.ravel())[:2]]
    where, what = (np.concatenate(x) for x in zip(*found, strict=True))
    return values, hits, where, (mix(what) % _U(BUCKETS)).astype(np.int32)


def votes(values: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(quality votes: -1 bad, toxicity votes: 1 toxic) by text, without the label's; heuristics speak up or abstain."""
    return -(values >= np.array(list(SIGNALS.values()))).astype(np.int64), (hits > 0).astype(np.int64)


def accuracies(patterns: np.ndarray, counts: np.ndarray, trusted: int, positive: float, rounds: int = 200) -> tuple[float, np.ndarray]:
    """(log-odds of the prior, weights[labeller, vote + 1]: what each vote adds to the log-odds) by EM over vote patterns.

    Labeller ``trusted`` has a set accuracy. Abstaining says nothing: kinds of junk exclude each other, so one labeller's
    silence is no evidence against another. A heuristic that speaks up never counts against what it says, by half a
    unit of log-odds at least. All probabilities are smoothed, so a labeller that never
    votes, or a corpus of one class, has finite weights.
    """
    m = patterns.shape[1]
    weights = np.zeros((m, 3))
    weights[:, 0], weights[:, 2] = -4.0, 4.0
    sure = np.log(TRUST / (1 - TRUST))
    weights[trusted] = -sure, 0, sure
    prior = float(np.log(positive / (1 - positive)))
    p = np.zeros(len(counts))
    said = patterns[:, trusted] != 0
    for turn in range(rounds):
        z = prior + sum(weights[j][patterns[:, j] + 1] for j in range(m))
        # what a person said settles the class while accuracies are estimated, or labellers could confirm each other
        z = np.where(said, patterns[:, trusted] * sure, z)
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        done, p = np.abs(new - p).max(initial=0) < 1e-6, new
        if done:
            break
        # the first turn learns from what people said, where that is something
        n = counts * said if turn == 0 and (counts * said).sum() >= 50 else counts
        a, b = n * p, n * (1 - p)
        for j in range(m):
            if j != trusted:
                x, y = (np.bincount(patterns[:, j] + 1, w, minlength=3) + 0.5 for w in (a, b))
                weights[j] = np.log(x / x.sum()) - np.log(y / y.sum())
                weights[j] = min(weights[j, 0], -0.5), 0, max(weights[j, 2], 0.5)
        prior = float(np.log((a.sum() + 1) / (b.sum() + 1)))
    return prior, weights


def fit(rows: np.ndarray, cols: np.ndarray, target: np.ndarray, rounds: int = 300, shrink: float = 0.5) -> tuple[float, np.ndarray]:
    """(bias, weights by bucket) of a logistic ridge regression of ``target`` (probabilities) on the features ``cols`` of texts
    ``rows``, by accelerated steps under a separable bound of the curvature, which can't overshoot."""
    out, n = np.zeros(BUCKETS, np.float32), len(target)
    if not n:
        return 0.0, out
    share = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    used, cols = np.unique(cols, return_inverse=True)
    each = np.bincount(rows, minlength=n) + 1.0
    step = 1 / (0.25 * np.bincount(cols, each[rows], minlength=len(used)) + shrink)
    step_b = 1 / (0.25 * each.sum())
    w = v = np.zeros(len(used))
    b = c = float(np.log(share / (1 - share)))
    for t in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(np.bincount(rows, v[cols], minlength=n) + c, -30, 30))) - target
        w_new, b_new = v - step * (np.bincount(cols, r[rows], minlength=len(used)) + shrink * v), c - step_b * r.sum()
        go = t / (t + 3)
        v, c = w_new + go * (w_new - w), b_new + go * (b_new - b)
        w, b = w_new, b_new
    out[used] = w
    return b, out


def posterior(labellers: tuple[float, np.ndarray], votes_: np.ndarray) -> np.ndarray:
    """Probability of the class for rows of votes, the label's last and one among them."""
    prior, weights = labellers
    z = prior + sum(weights[j][votes_[:, j] + 1] for j in range(votes_.shape[1]))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn_words(labelled: DataFrame) -> np.ndarray:
    """Hashes of words that stand in toxic documents far more often than in others, of rows (t, x): text and 1, toxic, or -1.

    Counted by word over all rows; only words that pass the bounds reach the driver, LEARNT at most."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            words, firsts = plain_words(b.column("t"))
            doc = np.repeat(np.arange(len(b)), np.diff(firsts))
            toxic = b.column("x").to_numpy() > 0
            found: dict[str, list] = {"word": [], "n": [], "toxic": []}
            order = np.lexsort((doc, words))
            w, d = words[order], doc[order]
            new = np.concatenate([[True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])]) if len(w) else np.zeros(0, bool)
            w, d = w[new], d[new]
            at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
            found["word"], found["n"] = w[at].view(np.int64), np.diff(np.append(at, len(w)))
            found["toxic"] = np.add.reduceat(toxic[d].astype(np.int64), at) if len(at) else at
            # of the whole batch, under a word that is none
            yield pa.RecordBatch.from_arrays([pa.array(np.append(found["word"], 0)), pa.array(np.append(found["n"], len(b))), pa.array(np.append(found["toxic"], int(toxic.sum())))], ["word", "n", "toxic"])

    counted = saved(labelled.mapInArrow(tables, "word long, n long, toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")), "quality-words")
    whole = counted.where("word = 0").first()
    if not whole or not 0 < whole["toxic"] < whole["n"]:
        drop(counted)
        return np.zeros(0, _U)
    share = whole["toxic"] / whole["n"]
    z = (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1)
    strong = counted.where((F.col("word") != 0) & (F.col("n") >= LEAST) & (F.col("toxic") >= MOSTLY * F.col("n")) & (z >= STRONG))
    got = [r["word"] for r in strong.orderBy(z.desc(), "word").limit(LEARNT).select("word").collect()]
    drop(counted)
    return np.unique(np.array(got, np.int64).view(_U))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> dict:
    """The two models: bias and weights for ``quality`` and ``toxic``, and the labellers' weights.

    ``labels`` has (key, quality, toxic), 1 or 0, nulls and missing rows abstaining; of several for a key the mean counts,
    above or below a half. Vote patterns cover all documents. The scorer is fitted to the posteriors of about ``sample`` of
    them, drawn by the hash of their key, and the learning labeller sees about as many labelled ones: both bounded samples,
    drawn alike at every size.
    """
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("lk")).agg(*[F.signum(F.avg(F.col(c)) - 0.5).cast("int").alias(c) for c in ("quality", "toxic")])
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    names = [f"q{i}" for i in range(len(QUALITY) - 1)] + [f"x{i}" for i in range(len(TOXICITY) - 1)]
    share = lambda n: int((1 << 20) * min(1.0, sample / max(n, 1.0)))
    taught = known.where("toxic != 0").select("lk", F.col("toxic").alias("x"))
    drawn = lambda c, what, n: F.pmod(F.xxhash64(c, F.lit(what)), F.lit(1 << 20)) < share(n)
    n_taught = taught.count()
    learnt = learn_words(rows.where(drawn("key", "words", n_taught)).join(taught.where(drawn("lk", "words", n_taught)), F.col("key") == F.col("lk")).select("t", "x"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            values, hits, _, _ = describe(b.column("t"), False, learnt)
            q, x = votes(values, hits)
            yield pa.RecordBatch.from_arrays([b.column("key"), *[pa.array(c.astype(np.int32)) for c in np.concatenate([q, x], 1).T]], ["key", *names])

    voted = rows.mapInArrow(vote, f"key {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} int" for n in names))
    joined = voted.join(known, F.col("key") == F.col("lk"), "left")
    ql, xl = F.coalesce("quality", F.lit(0)).alias("ql"), F.coalesce("toxic", F.lit(0)).alias("xl")
    table = joined.groupBy(*names, ql, xl).count().toPandas()  # at most 3 ** labellers rows
    counts = table["count"].to_numpy(float)
    model: dict = {}
    for what, cols, positive in (("quality", [*names[: len(QUALITY) - 1], "ql"], 0.85), ("toxic", [*names[len(QUALITY) - 1 :], "xl"], 0.1)):
        model[what] = {"labellers": accuracies(table[cols].to_numpy(int).reshape(-1, len(cols)), counts, len(cols) - 1, positive)}
    n = float(counts.sum())
    picked = rows.where(drawn("key", "fit", n)).join(known.where(drawn("lk", "fit", n)), F.col("key") == F.col("lk"), "left").select("t", ql, xl)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            values, hits, where, what = describe(b.column("t"), learnt=learnt)
            o = np.argsort(where, kind="stable")
            f = np.split(what[o], np.searchsorted(where[o], np.arange(1, len(b))))
            q, x = votes(values, hits)
            every = np.concatenate([q, b.column("ql").to_numpy()[:, None], x, b.column("xl").to_numpy()[:, None]], 1).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in every], pa.binary()), pa.array([r.tobytes() for r in f], pa.binary())], ["votes", "f"])

    held = saved(picked.mapInArrow(sampled, "votes binary, f binary"), "quality-sample")
    kinds = ("quality", "toxic")

    def targets(b: pa.RecordBatch) -> list[np.ndarray]:
        every = np.array([np.frombuffer(x.as_py(), np.int8) for x in b.column("votes")], np.int64).reshape(len(b), len(QUALITY) + len(TOXICITY))
        return [posterior(model[k]["labellers"], part) for k, part in zip(kinds, (every[:, : len(QUALITY)], every[:, len(QUALITY) :]), strict=True)]

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per bucket the texts that have it, and their sums of both classes; bucket -1 has all texts."""
        sums = np.zeros((3, BUCKETS + 1))
        for b in batches:
            both = targets(b)
            for i, f in enumerate(b.column("f")):
                at = np.frombuffer(f.as_buffer(), np.int32)
                for k, x in enumerate((1.0, both[0][i], both[1][i])):
                    sums[k][at] += x
                    sums[k][-1] += x
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.where(some == BUCKETS, -1, some).astype(np.int32)), *[pa.array(x[some]) for x in sums]], ["bucket", "n", "quality", "toxic"])

    counted = held.coalesce(8).mapInArrow(tables, "bucket int, n double, quality double, toxic double").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", *kinds)])
    # at most as many rows as there are buckets
    got = counted.where(F.col("n") >= LEAST).toPandas().set_index("bucket")
    whole = got.loc[-1] if -1 in got.index else None
    got = got[got.index >= 0]
    strong = {}
    for k in kinds:
        share = float(np.clip(whole[k] / whole["n"], 1e-3, 1 - 1e-3)) if whole is not None else 0.5
        z = (got[k] - got["n"] * share) / np.sqrt(got["n"] * share * (1 - share) + 1)
        strong[k] = np.sort(got.index[np.abs(z) >= STRONG].to_numpy())
    keep = np.union1d(strong["quality"], strong["toxic"]).astype(np.int32)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = targets(b)
            f = [x[np.isin(x, keep)].tobytes() for x in (np.frombuffer(y.as_buffer(), np.int32) for y in b.column("f"))]
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(f, pa.binary())], ["quality", "toxic", "f"])

    fitted = held.mapInArrow(narrowed, "quality double, toxic double, f binary").toPandas()
    drop(held)
    lists = [np.frombuffer(x, np.int32) for x in fitted["f"]]
    at, cols = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists]), np.concatenate(lists or [np.zeros(0, np.int32)])
    for k in kinds:
        own = np.isin(cols, strong[k])
        model[k]["bias"], model[k]["weights"] = fit(at[own], cols[own], fitted[k].to_numpy(float))
    return model


def classify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with p_quality, p_toxic (doubles) and keep (good and not toxic, both by a half).

    Every row is scored on its whole text, alone. Null and empty texts are scored by their signals and kept or not as the
    model says. Columns of the new names are replaced, others kept.
    """
    new = ["p_quality", "p_toxic", "keep"]
    kept = [c for c in docs.columns if c not in new]
    schema = docs.select(*kept).schema.add("p_quality", "double").add("p_toxic", "double").add("keep", "boolean")
    heads = [(model[k]["bias"], model[k]["weights"]) for k in ("quality", "toxic")]  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            t = pc.fill_null(b.column(text), "")
            _, _, where, what = describe(t)
            p = [1 / (1 + np.exp(-np.clip(bias + np.bincount(where, w[what], minlength=len(b)), -30, 30))) for bias, w in heads]
            keep = (p[0] >= 0.5) & (p[1] < 0.5)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(p[0]), pa.array(p[1]), pa.array(keep)], [*kept, *new])

    return docs.select(*kept).mapInArrow(run, schema)
