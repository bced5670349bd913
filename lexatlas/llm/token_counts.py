"""Token counts: the exact number of BPE tokens of every prefix of a text, by dynamic programming.

A BPE encoding is the only token sequence in which every two neighbours are *compatible*: merging the bytes
of the pair gives the pair back. The encoding of a word's first ``i`` bytes therefore ends in the one token
``t`` that is compatible with the last token of the encoding of the first ``i - len(t)`` bytes, and

    count[i] = count[i - len(t)] + 1

so one pass over a word gives its token count at every prefix. Words (pieces between white space, which this
vocabulary drops) don't influence each other, so a text's prefix counts are running sums, and each distinct
word is solved once per worker. Truncation ("how much of this text fits in k tokens") and budget questions
are then look-ups in the array: see :func:`fits` and :func:`count_at`.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import slices

#: Bytes, about, of solved words that a worker keeps, and of pieces; when they are full all are solved again as they recur.
KEEP = 240 << 20
#: Code points of the longest word that is kept (its counts fit in bytes); longer ones are solved where they stand.
CACHED = 60
#: Letters after which a word's state is kept for others.
HEAD = 7
#: Such states that a worker keeps.
HEADS = 600_000

_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_GAP = regex.compile(r"\s+")
_LETTER, _DIGIT = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")


def _cost(text: str) -> int:
    """Bytes, about, of a cache's entry for a word: its code points, its counts and the entry."""
    return 160 + 5 * len(text)


def _starts(ch: str) -> bool:
    """Whether a code point never combines with what stands before it: no mark, no vowel or tail of a Hangul syllable."""
    return not (unicodedata.category(ch)[0] == "M" or unicodedata.combining(ch) or "\u1160" <= ch <= "\u11ff" or "\ud7b0" <= ch <= "\ud7ff")


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


class PrefixCounter:
    """Counts tokens at every prefix under a byte-level BPE vocabulary with word ends (a tokenizers .json file)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.odd = "|".join([r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F]", *map(regex.escape, self.special)])
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.vocab = set(model["vocab"])
        self.letter = _byte_alphabet()
        self.inner = self._lengths(t for t in self.vocab if not (self.end and t.endswith(self.end)))
        self.final = self._lengths(t[: len(t) - len(self.end)] for t in self.vocab if t.endswith(self.end))
        self.stable: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.held = {"words": 0, "pieces": 0}
        self.heads: dict[str, tuple[tuple[str, ...], bytes, bytes]] = {}

    @staticmethod
    def _lengths(tokens: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """For the last three letters of tokens: the lengths of tokens that end so, longest first, then 2 and 1."""
        found: dict[str, set[int]] = {}
        for t in tokens:
            if len(t) > 2:
                found.setdefault(t[-3:], set()).add(len(t))
        return {k: (*sorted(v, reverse=True), 2, 1) for k, v in found.items()}

    def merged(self, parts: list[str]) -> list[str]:
        """Plain BPE of a short symbol sequence."""
        while len(parts) > 1:
            best = min(((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def compatible(self, a: str, b: str) -> bool:
        """Whether token b may follow token a (at a word's start: "") in an encoding."""
        if len(self.stable) > 3_000_000:
            self.stable.clear()
        ok = self.stable[a, b] = self.merged([*a, *self.symbols(b)]) == ([a, b] if a else [b])
        return ok

    def piece(self, text: str) -> bytes:
        """Token count of each prefix (in code points) of one pre-token, each prefix taken as a whole pre-token."""
        got = self.pieces.get(text)
        if got is not None:
            return got
        letter = self.letter
        if text.isascii():
            ends = self.solve("".join([letter[b] for b in text.encode()]))
        else:
            data, stops = [], []
            for ch in text:
                data += [letter[b] for b in ch.encode()]
                stops.append(len(data) - 1)
            ends = self.solve("".join(data))
            ends = [ends[i] for i in stops]
        if len(text) > CACHED:
            return ends
        return self.keep("pieces", text, bytes(ends))

    def keep(self, name: str, text: str, counts: bytes) -> bytes:
        cache = getattr(self, name)
        self.held[name] += _cost(text)
        if self.held[name] > KEEP:
            cache.clear()
            self.held[name] = _cost(text)
        cache[text] = counts
        return counts

    def solve(self, word: str) -> list[int]:
        """The dynamic programme: tokens of word[:i] as a finished word, for each i. All depends on prefixes alone, so
        the state after HEAD letters serves every word that begins alike."""
        head = word[:HEAD]
        known = self.heads.get(head) if len(word) > HEAD else None
        if known:
            last, count, ends = list(known[0]), list(known[1]), list(known[2])
        else:
            last, count, ends = [""], [0], []
        stable, vocab, end, inner, final = self.stable, self.vocab, self.end, self.inner, self.final
        for i in range(len(last), len(word) + 1):
            tail = word[i - 3 : i] if i > 2 else ""
            for n in inner.get(tail, (2, 1)):
                j = i - n
                if j >= 0:
                    t = word[j:i]
                    if t in vocab:
                        ok = stable.get((last[j], t))
                        if ok if ok is not None else self.compatible(last[j], t):
                            last.append(t)
                            count.append(count[j] + 1)
                            break
            for n in final.get(tail, (2, 1)):
                j = i - n
                if j >= 0:
                    t = word[j:i] + end
                    if t in vocab:
                        ok = stable.get((last[j], t))
                        if ok if ok is not None else self.compatible(last[j], t):
                            ends.append(count[j] + 1)
                            break
            if i == HEAD and len(word) > HEAD:
                if len(self.heads) >= HEADS:
                    self.heads.clear()
                self.heads[head] = (tuple(last), bytes(count), bytes(ends))
        return ends

    def plain(self, text: str) -> list[int]:
        """Prefix counts of normalised text without white space."""
        out: list[int] = []
        base = 0
        for m in _PIECE.finditer(text):
            p = m.group()
            if p[0] == "'" and len(p) > 1 and p[1].isalpha():
                # before its last letter arrives, a contraction is an apostrophe (and letters) of its own
                own = []
                for i in range(1, len(p) + 1):
                    own.append(sum(self.piece(q.group())[-1] for q in _PIECE.finditer(p[:i])))
            else:
                own = self.piece(p)
            out += [base + c for c in own] if base else own
            base = out[-1]
        return out

    def chunk(self, text: str) -> bytes | np.ndarray:
        """Prefix counts (one per code point) of a text without white space or special strings, as it stands in a
        document; one byte each for a short one."""
        got = self.words.get(text)
        if got is None:
            if text.isascii():
                counts = self.plain(text.lower())
            else:
                low = "".join([c.lower() for c in text])
                if len(low) == len(text) and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low):
                    counts = self.plain(low)
                else:  # characters combine or grow: each prefix is normalised as the library would
                    counts = self.combining(text)
            if len(text) > CACHED:
                return np.array(counts, np.int32)
            got = self.keep("words", text, bytes(counts))
        return got

    def combining(self, text: str) -> list[int]:
        """Prefix counts of a text without white space whose code points combine.

        Only what follows the last code point that starts a cluster can still change, so the state before it is kept and
        each prefix goes on from there. Linear in the text; a cluster whose marks change places costs the square of its own length.
        """
        grown = _Growing(self)
        out: list[int] = []
        mark, first, before = grown.mark(), 0, ""
        for i, ch in enumerate(text):
            if i > first and _starts(ch):
                mark, first, before = grown.mark(), i, ""
            now = unicodedata.normalize("NFC", text[first : i + 1])
            if not now.startswith(before):
                grown.back(mark)
                before = ""
            for c in now[len(before) :]:
                for low in c.lower():
                    grown.add(low)
            before = now
            out.append(grown.total())
        return out

    def text(self, text: str) -> np.ndarray:
        """Token count of each prefix of a document, one number per code point."""
        out, base = [], 0
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:  # a special string is one token once complete; until then it is ordinary text
                own = [self.text_plain(part[: i + 1]) for i in range(len(part) - 1)] + [1]
                out.append(base + np.array(own, np.int32))
                base += 1
            elif part:
                counts, base = self._run(part, base)
                out.append(counts)
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def text_plain(self, text: str) -> int:
        return int(self._run(text, 0)[0][-1])

    def counts(self, text: str) -> np.ndarray:
        got = self.chunk(text)
        return np.frombuffer(got, np.uint8).astype(np.int32) if isinstance(got, bytes) else got

    def _run(self, text: str, base: int) -> tuple[np.ndarray, int]:
        out, at = [], 0
        for m in _GAP.finditer(text):
            if m.start() > at:
                own = self.counts(text[at : m.start()]) + base
                out.append(own)
                base = int(own[-1])
            out.append(np.full(m.end() - m.start(), base, np.int32))
            at = m.end()
        if at < len(text):
            own = self.counts(text[at:]) + base
            out.append(own)
            base = int(own[-1])
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), base


class _Growing:
    """The dynamic programme over a text that grows by single code points and can be set back."""

    def __init__(self, counter: PrefixCounter) -> None:
        self.counter = counter
        self.base = 0  # tokens of finished pieces
        self.kind = ""  # of the open piece: letters L, other signs O, an apostrophe that began a piece A; none where empty
        self.short: tuple[int, str] | None = None  # tokens before, and text, of what may become a contraction of three
        self.piece: tuple[list[str], list[str], list[int], list[int]] = ([], [""], [0], [])

    def total(self) -> int:
        return self.base + (self.piece[3][-1] if self.kind else 0)

    def mark(self) -> tuple:
        return self.base, self.kind, self.short, self.piece, len(self.piece[0])

    def back(self, mark: tuple) -> None:
        self.base, self.kind, self.short, self.piece, n = mark
        word, last, count, ends = self.piece
        del word[n:], last[n + 1 :], count[n + 1 :], ends[n:]

    def close(self) -> None:
        self.base, self.kind, self.short = self.total(), "", None

    def whole(self, base: int, text: str) -> None:
        """A piece that ends here, after ``base`` tokens."""
        self.base, self.kind, self.short = base + self.counter.piece(text)[-1], "", None

    def add(self, ch: str) -> None:
        if _LETTER.match(ch):
            if self.kind == "A" and ch in "stmd":
                return self.whole(self.base, "'" + ch)
            if self.short and self.short[1] + ch in ("'re", "'ve", "'ll"):
                return self.whole(self.short[0], self.short[1] + ch)
            short = (self.base, "'" + ch) if self.kind == "A" and ch in "rvl" else None
            if self.kind != "L":
                self.open("L")
            self.short = short
        elif _DIGIT.match(ch):
            self.close()
            return self.whole(self.base, ch)
        elif self.kind in ("O", "A"):
            self.kind = "O"
        else:
            self.open("A" if ch == "'" else "O")
        for b in ch.encode():
            self.letter(self.counter.letter[b])
        return None

    def open(self, kind: str) -> None:
        self.close()
        self.kind, self.piece = kind, ([], [""], [0], [])

    def letter(self, letter: str) -> None:
        c = self.counter
        word, last, count, ends = self.piece
        word.append(letter)
        i = len(word)
        tail = "".join(word[-3:]) if i > 2 else ""
        for lengths, end in ((c.inner, ""), (c.final, c.end)):
            for n in lengths.get(tail, (2, 1)):
                if n > i:
                    continue
                t = "".join(word[i - n : i]) + end
                if t in c.vocab:
                    ok = c.stable.get((last[i - n], t))
                    if ok if ok is not None else c.compatible(last[i - n], t):
                        if lengths is c.inner:
                            last.append(t)
                            count.append(count[i - n] + 1)
                        else:
                            ends.append(count[i - n] + 1)
                        break


@lru_cache(2)
def _counter(path: str) -> PrefixCounter:
    """A worker's counter: what it has solved serves its later tasks."""
    return PrefixCounter(path)


def _simple(counter: PrefixCounter, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Prefix counts of all texts of an array: (offsets, counts). Distinct words are solved once for the array.

    ASCII white space parts the words here; a word that holds other white space or a special string, or is very
    long, sends its text to :meth:`PrefixCounter.text`.
    """
    n = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(n)])
    parts = pc.split_pattern_regex(texts, r"[ \t\n\x0b\x0c\r]")
    flat = parts.flatten()
    of = np.diff(parts.offsets.to_numpy())
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False)
    odd = pc.or_(pc.match_substring_regex(coded.dictionary, counter.odd), pc.greater(pc.utf8_length(coded.dictionary), CACHED)).to_numpy(zero_copy_only=False)
    known = counter.words
    solved = [bytes(len(w)) if o else known.get(w) or counter.chunk(w) for w, o in zip(words, odd.tolist(), strict=True)]
    size = np.array([len(s) for s in solved], np.int64)
    pool = np.frombuffer(b"".join(solved), np.uint8).astype(np.int32)
    stop = np.cumsum(size)
    first = stop - size
    ends = np.where(size > 0, pool[np.maximum(stop - 1, 0)], 0) if len(pool) else np.zeros(len(size), np.int64)
    text_of = np.repeat(np.arange(len(texts)), of)
    total = np.cumsum(ends[code])
    before = np.concatenate([[0], total])[:-1] if len(code) else total
    start_word = np.concatenate([[0], np.cumsum(of)])[:-1]
    before = before - (before[np.minimum(start_word, max(len(code) - 1, 0))] if len(code) else before)[text_of]
    # each word gives its characters, then the separator that follows it (none after a text's last word)
    last = np.zeros(len(code), bool)
    last[np.cumsum(of)[of > 0] - 1] = True
    length = size[code]
    lay = length + ~last
    out = np.empty(int(lay.sum()), np.int32)
    at = np.concatenate([[0], np.cumsum(lay)])[:-1]
    inner = np.arange(int(length.sum())) - np.repeat(np.concatenate([[0], np.cumsum(length)])[:-1], length)
    out[np.repeat(at, length) + inner] = pool[np.repeat(first[code], length) + inner] + np.repeat(before, length).astype(np.int32)
    out[(at + length)[~last]] = (before + ends[code])[~last]
    for i in np.unique(text_of[odd[code]]).tolist() if odd.any() else []:
        out[offsets[i] : offsets[i + 1]] = counter.text(texts[i].as_py())
    return offsets, out


def prefix_token_counts(df: DataFrame, tokenizer: str, text: str = "text", out: str = "prefix_tokens") -> DataFrame:
    """``df`` with ``out``: array<int>, the exact token count of every prefix of ``text``, one per code point.

    The count at code point ``i`` is that of the library for ``text[:i]``, without begin or end tokens; special
    strings count as the library's default takes them. A null or empty text has an empty array. ``tokenizer`` is the
    path of a byte-level BPE .json file with lower-casing and word ends, readable on every executor. Any extra
    columns are kept; a column named ``out`` is replaced. Rows are independent: no shuffle, memory bounded by a few
    megabytes of text at a time (one row at least).
    """
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for b in slices(batches, text, 1 << 20):
            texts = pc.fill_null(b.column(text), "")
            offsets, counts = _simple(counter, texts.cast(pa.string()))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(counts))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], lists], [*keep, out])

    return df.select(*keep).mapInArrow(run, schema)


def total(prefix: Column) -> Column:
    """Tokens of the whole text."""
    return F.coalesce(F.try_element_at(prefix, F.lit(-1)), F.lit(0)).cast("long")


def count_at(prefix: Column, length: Column) -> Column:
    """Tokens of the first ``length`` code points."""
    return F.when(length <= 0, F.lit(0)).otherwise(F.coalesce(F.try_element_at(prefix, F.least(length, F.size(prefix)).cast("int")), F.lit(0))).cast("long")


def fits(prefix: Column, budget: Column) -> Column:
    """The largest number of code points whose prefix has at most ``budget`` tokens (counts may fall as a word grows)."""
    ok = F.filter(F.sequence(F.lit(0), F.size(prefix)), lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(prefix, i - 1)) <= budget)
    return F.array_max(ok)
