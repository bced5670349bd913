"""LM scoring: a smoothed n-gram model as a weighted backoff automaton.

States are contexts of up to two words; an arc (state, word) carries the smoothed log-probability of a word seen in that context; a
state without the arc follows its failure arc to the next shorter context, pays that arc's backoff weight, and so on down to
the root, which has an arc for every word. One left-to-right traversal carries the state and adds up weights, all documents of a block in step.

Smoothing is by a Dirichlet prior on the next shorter order, P(w | v) = (c(vw) + m P(w)) / (c(v) + m), so an unseen
pair costs exactly m / (c(v) + m) times P(w): the failure arc's weight. Triples are arcs where both their pairs stand
twice at least in the training texts, as every triple does that is seen twice; P(w | uv) = (c(uvw) + m P(w | v)) / (t(uv) + m), t(uv)
being the sum over the context's arcs. The unigrams are absolutely discounted,
P(w) = (c - d) / N, and the mass d V / N goes to the one unknown word. All sum to one. Counts are exact over all training
documents (see ``_counts``), in one round for words and pairs and one for triples and contexts: no table of fixed size, nothing broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._counts import BLOCK_BYTES, RUNS, answers, count_blocks, in_block, known, placed, runs, statistics, tally, with_block
from ._text import mix, slices, trim, word_hashes
from ._work import blocks_of

_U = np.uint64
_RUNS = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("items", pa.binary()), ("counts", pa.binary())])
#: The hash of the end of a text, which is also the context of its first word.
END = _U(0x51ED270B27D4EB2F)
#: Weights of the priors of contexts of one and of two words, in observations. Chosen on held-out text.
PRIOR, PRIOR_TWO = 300.0, 20.0
#: Times that both pairs of a triple are seen at least.
LEAST = 2


def _one(h: np.ndarray) -> np.ndarray:
    return h & ~_U(1)


def _two(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * _U(0x9E3779B97F4A7C15) + word) | _U(1)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with each text's end, its predecessor's hash, first token of each text and one past the last)."""
    words, firsts = word_hashes(texts, True)
    firsts = firsts + np.arange(len(firsts))
    out = np.full(firsts[-1], END, _U)
    inner = np.ones(len(out), bool)
    inner[firsts[1:] - 1] = False
    out[inner] = words
    before = np.empty_like(out)
    before[1:] = out[:-1]
    if len(out):
        before[firsts[:-1]] = END
    return _one(out), _one(before), firsts


@dataclass
class Automaton:
    """The part of the model that a block can reach.

    State 0 is the root, then come one for each word and one for each context of two words. ``pair_keys`` and
    ``triple_keys`` name arcs by state and word, with a weight and the state after; the last of each is none. ``fail`` is the state
    that a failure arc leads to, ``fail_weight`` what it costs. The root has an arc for every word, the last word being
    the unknown one: ``word_weight`` and ``word_next``.
    """

    pair_keys: np.ndarray
    pair_weight: np.ndarray
    pair_next: np.ndarray
    triple_keys: np.ndarray
    triple_weight: np.ndarray
    triple_next: np.ndarray
    fail: np.ndarray
    fail_weight: np.ndarray
    word_weight: np.ndarray
    word_next: np.ndarray

    def key(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        return state.astype(np.int64) * len(self.word_weight) + word

    def traverse(self, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, firsts: np.ndarray, start: int) -> np.ndarray:
        """log10-probability of each text: all texts advance by one token at a time, each in its own state.

        ``pairs`` and ``triples`` say for each token which arcs it would be with the one and the two tokens before; an arc is taken only
        when its key is that of the state that the text is in, else the failure arc is.
        """
        sizes = np.diff(firsts)
        order = np.argsort(-sizes, kind="stable")
        sizes, at = sizes[order], firsts[:-1][order]
        score = np.zeros(len(sizes))
        state = np.full(len(sizes), start, np.int64)
        # texts still on their way, for each step
        active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0]) if len(sizes) else 0), "right")
        for t, n in enumerate(active.tolist()):
            here = at[:n] + t
            w, s = words[here], state[:n]
            gain, after = np.zeros(n), np.full(n, -1, np.int64)
            for keys, weights, nexts, arcs in ((self.triple_keys, self.triple_weight, self.triple_next, triples), (self.pair_keys, self.pair_weight, self.pair_next, pairs)):
                i = arcs[here]
                hit = (after < 0) & (keys[i] == self.key(s, w)) & (s > 0)
                gain += np.where(hit, weights[i], 0.0)
                after = np.where(hit, nexts[i], after)
                # states of the order of these arcs fail to the next shorter context
                missed = (after < 0) & (self.fail[s] < s) & ((s >= len(self.word_weight)) | (keys is self.pair_keys))
                gain += np.where(missed, self.fail_weight[s], 0.0)
                s = np.where(missed, self.fail[s], s)
            score[:n] += gain + np.where(after < 0, self.word_weight[w], 0.0)
            state[:n] = np.where(after < 0, self.word_next[w], after)
        out = np.empty(len(sizes))
        out[order] = score
        return out


@dataclass
class Block:
    """A block's tokens with the corpus' counts: distinct ``words`` and ``pairs`` with ``word_counts`` and ``pair_counts``; of each
    token its word, its pair with the token before, and the word before; the texts' first tokens; which tokens are learnt."""

    words: np.ndarray
    word_counts: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray
    word: np.ndarray
    pair: np.ndarray
    previous: np.ndarray
    firsts: np.ndarray
    learn: np.ndarray
    begin: int

    def longer(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens after a pair that is seen often enough, hashes of these pairs as contexts, which of the tokens end a triple
        whose second pair is, too, hashes of their triples)."""
        second = np.ones(len(self.word), bool)
        second[self.firsts[:-1]] = False
        at = np.flatnonzero(second).astype(np.int32)
        often = self.pair_counts >= LEAST
        at = at[often[self.pair[at - 1]]]
        ends = np.flatnonzero(often[self.pair[at]]).astype(np.int32)
        before = self.pairs[self.pair[at - 1]]
        triple = mix(before[ends] * _U(0xC2B2AE3D27D4EB4F) + self.words[self.word[at[ends]]]) | _U(1)
        return at, _one(mix(before ^ _U(0x165667B19E3779F9))), ends, triple

    def tallied(self, longer: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(contexts and triples of ``longer``, how often each is learnt); a context counts for each triple that it begins."""
        at, context, ends, triple = longer
        learn = self.learn[at[ends]].astype(np.int32)
        begins = np.zeros(len(at), np.int32)
        begins[ends] = learn
        return np.concatenate([triple, context]), np.concatenate([learn, begins])


def _rank(odd: np.ndarray) -> np.ndarray:
    """The place of each item among those of its kind."""
    return np.where(odd, np.cumsum(odd, dtype=np.int32), np.cumsum(~odd, dtype=np.int32)) - np.int32(1)


def block_of(own: pa.Table, answer: pa.Table, parts: int) -> Block:
    batches = list(slices(iter(own.combine_chunks().to_batches()), "t"))
    found = [tokens_of(b.column("t")) for b in batches]
    sizes = np.concatenate([np.diff(p[2]) for p in found] or [np.zeros(0, np.int64)])
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    n = int(firsts[-1])
    both, at = np.empty(2 * n, _U), 0  # words, then their pairs
    word = before = None
    while found:
        word, before, _ = found.pop(0)
        both[at : at + len(word)] = word
        both[n + at : n + at + len(word)] = _two(before, word)
        at += len(word)
    del batches, word, before
    out = pc.fill_null(own.column("out"), False).combine_chunks().to_numpy(zero_copy_only=False)
    learn = np.repeat(~out, sizes)
    items, counts, place = placed(both, np.concatenate([learn, learn]))
    del both
    totals = known(answer, items, counts, parts)
    double = items & _U(1) == 1
    place = _rank(double)[place]
    index, pair = place[:n], place[n:]
    begin = int(np.searchsorted(items[~double], END & ~_U(1)))  # every text has an end
    previous = np.empty_like(index)
    previous[1:] = index[:-1]
    previous[firsts[:-1]] = begin
    return Block(items[~double], totals[~double], items[double], totals[double], index, pair, previous, firsts, learn, begin)


def triples_of(b: Block, answer: pa.Table, parts: int) -> tuple[np.ndarray, ...]:
    """What :func:`automaton` takes of a block's triples, with the corpus' counts."""
    more = b.longer()
    items, counts, place = placed(*b.tallied(more))
    at, ends, n = more[0], more[2], len(more[3])
    del more
    totals = known(answer, items, counts, parts)
    odd = items & _U(1) == 1
    place = _rank(odd)[place]
    return at, place[n:], ends, place[:n], totals[~odd], totals[odd]


def automaton(b: Block, triples: tuple[np.ndarray, ...], total: int, kinds: int, discount: float, prior: float, prior_two: float) -> tuple[Automaton, np.ndarray]:
    """(the part of the model that a block can reach, which triple's arc each token would be).

    ``triples``: tokens after a context, place of each one's context among the distinct ones, which of them end a triple, place
    of each one's triple, and the counts of contexts and of triples.
    """
    n, counts = len(b.words), b.word_counts
    p = np.append(np.where(counts > 0, (counts - discount) / max(total, 1), 0.0), 0.0)
    unknown = discount * kinds / total if total else 1.0
    p[:-1][counts <= 0] = unknown
    p[-1] = unknown
    with np.errstate(divide="ignore"):
        uni = np.log10(p)
    # a word with a count is a context: state 1 + its index; others lead back to the root
    following = np.append(np.where(counts > 0, np.arange(1, n + 1), 0), 0).astype(np.int32)
    # each array goes as soon as it has been used: a block's memory is a task's
    last = lambda x, v: np.append(x, v)
    at, context, ends, triple, context_counts, triple_counts = triples
    some = np.empty(len(b.pairs), np.int32)  # a place where each pair stands
    some[b.pair] = np.arange(len(b.pair), dtype=np.int32)
    first, second = b.previous[some], b.word[some]
    del some
    # pairs that only unlearnt texts have are no arcs: no state has their key
    seen = b.pair_counts > 0
    two = (b.pair_counts + prior * p[second]) / (counts[first] + prior)
    keys = last(np.where(seen, (first.astype(np.int64) + 1) * (n + 1) + second, -1), -1)
    del first
    nexts = np.full(len(b.pairs) + 1, -1, np.int32)  # the state of each pair that is a context
    nexts[b.pair[at - 1]] = n + 1 + context
    nexts[:-1] = np.where(nexts[:-1] >= 0, nexts[:-1], following[second])
    nexts[-1] = 0
    del second
    fail = np.zeros(n + 1 + len(context_counts), np.int32)
    fail[n + 1 + context] = following[b.word[at - 1]]
    fail_weight = np.concatenate([[0.0], np.log10(prior / (counts + prior)), np.log10(prior_two / (context_counts + prior_two))])
    some = np.empty(len(triple_counts), np.int32)
    some[triple] = ends
    end, state = at[some], context[some]
    del some
    three = (triple_counts + prior_two * two[b.pair[end]]) / (context_counts[state] + prior_two)
    three = last(np.log10(np.maximum(three, 1e-300)), 0.0)
    two = last(np.log10(np.where(seen, two, 1.0)), 0.0)
    triple_keys = last(np.where(triple_counts > 0, (state.astype(np.int64) + n + 1) * (n + 1) + b.word[end], -1), -1)
    triple_next = last(nexts[b.pair[end]], np.int32(0))
    del end, state, seen
    arcs = np.full(len(b.word), len(triple_counts), np.int32)
    arcs[at[ends]] = triple
    return Automaton(keys, two, nexts, triple_keys, three, triple_next, fail, fail_weight, uni, following), arcs


def held_out(key: Column) -> Column:
    """Documents that the model doesn't learn from: crc32 of the id as text leaves 2 modulo 7."""
    return F.coalesce(F.crc32(key.cast("string")) % 7 == 2, F.lit(False))


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", prior: float = PRIOR, order: int = 3, prior_two: float = PRIOR_TWO) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all documents that aren't held out and scores all whole texts with their end token. Lower-cases A-Z
    only. ``n_known`` counts tokens with a training count; ``base_score`` is the add-one unigram score, ``score`` the
    automaton's log10-probability, of words in contexts of ``order`` - 1 words, one or two. Null and empty texts are their end token. A null key isn't held out. Repeated rows
    count and score as often as they stand; other columns, whatever their names, are left out; an empty table gives
    an empty one. Without any training text all mass is the unknown word's.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"), held_out(F.col(key)).alias("out"))
    blocks = blocks_of(docs, text, BLOCK_BYTES)
    dealt = with_block(rows, F.xxhash64("key", "t"), blocks)

    def items_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        word, before, firsts = tokens_of(b.column("t"))
        learn = np.repeat(~b.column("out").to_numpy(zero_copy_only=False), np.diff(firsts)).astype(np.int32)
        return np.concatenate([word, _two(before, word)]), np.concatenate([learn, learn])

    answered = answers(count_blocks(dealt, "t", items_of, blocks), "lm-counts")
    total, kinds, once, twice = statistics(answered, 0)
    discount = once / (once + 2 * twice) if once else 0.5

    def longer(own: pa.Table, answer: pa.Table) -> pa.Table:
        if not len(own):
            return pa.Table.from_batches([], _RUNS)
        b = block_of(own, answer, blocks)
        return pa.Table.from_batches([runs(own.column("block")[0].as_py(), *tally(*b.tallied(b.longer())), blocks)]).cast(_RUNS)

    def judge(own: pa.Table, answer: pa.Table) -> pa.Table:
        if not len(own):
            return pa.Table.from_batches([], scores)
        level = lambda k: answer.filter(pc.equal(answer.column("level"), k))
        b = block_of(own, level(1), blocks)
        nothing = np.zeros(0, np.int64)
        found = (nothing,) * 6
        if order > 2:
            found = triples_of(b, level(2), blocks)
        m, arcs = automaton(b, found, total, kinds, discount, prior, prior_two)
        # the walk needs arcs and states only
        del found
        b.pairs = b.pair_counts = b.previous = nothing
        trim()
        result = m.traverse(b.word, b.pair, arcs, b.firsts, int(m.word_next[b.begin]))
        del m, arcs
        base = np.log10((b.word_counts + 1) / (total + kinds + 1))[b.word]
        per = b.word_counts[b.word]
        add = lambda x: np.add.reduceat(x, b.firsts[:-1])
        sizes = np.diff(b.firsts).astype(np.int64)
        return pa.table([own.column("key"), own.column("out"), pa.array(sizes), pa.array(add((per > 0).astype(np.int64))), pa.array(np.full(len(sizes), total, np.int64)), pa.array(add(base)), pa.array(result)], scores)

    columns = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scores = pa.schema([(key, to_arrow_type(docs.schema[key].dataType)), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")], ("base_score", pa.float64()), ("score", pa.float64())])
    # the two passes after it deal the texts by block themselves
    own, back = in_block(rows, F.xxhash64("key", "t"), blocks).groupBy("block"), answered.where("block >= 0").select("block", "part", "places", "totals")
    if order > 2:
        more = answers(own.cogroup(back.groupBy("block")).applyInArrow(longer, RUNS), "lm-triples")
        both = back.withColumn("level", F.lit(1)).unionByName(more.where("block >= 0").select("block", "part", "places", "totals", F.lit(2).alias("level")))
    else:
        both = back.withColumn("level", F.lit(1))
    return own.cogroup(both.groupBy("block")).applyInArrow(judge, columns)
