"""Token counts by prefix dynamic programming.

For each text a table holds the exact token count of every prefix, from no code point to all. It answers "how many tokens
are in the first n characters" and "which is the longest prefix within a budget" by looking up; nothing is encoded again.

The tables of a group of texts are made at once. No token crosses the border of two pieces, so the count of a prefix is that of the pieces
before plus that of a prefix of its last piece, and each distinct piece is looked into once:

* byte-level BPE, pieces of Latin-1: white space and the words after it are taken apart; prefixes of short words are encoded many at a
  time, and long words go by recurrence: the last token t of a prefix is the one for which the last token of the prefix before t,
  followed by t, is how the two together are encoded, so count(n) = count(n - length of t) + 1.
* other pieces of that file are cut where its library cuts them and their parts treated alike; words of the file with word ends and texts for
  any other file are encoded for each prefix (in time quadratic in the length of the word, or of the text).

Defined cases: null counts as empty; an empty text has 0 tokens, 0 bytes and isn't over any limit; a prefix that ends inside
the string of an added token holds ordinary text; repeated rows give repeated results; an empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, prepared, text_groups
from .tokens import GROUP_CHARS, RARE_SPACE, Pieces, gathered, loaded

#: Longer words go by recurrence.
SHORT = 40
GAPS = " \n\t\r"
#: Pieces that aren't a gap and a word of Latin-1.
ODD = re.compile(RARE_SPACE.pattern + r"|[^ \n\t\r][ \n\t\r]|[^\x00-\xff]")


def recurrence(word: bytes, pieces: Pieces) -> np.ndarray:
    """Tokens of each prefix of a word, in bytes."""
    ids, encode, fits = pieces.bytes.ids, pieces.bytes.engine._encode_single_piece, pieces.bytes.fits
    counts, last = [0], [b""]
    for n in range(1, len(word) + 1):
        for size in range(min(n, pieces.bytes.longest), 0, -1):
            token = word[n - size : n]
            if token not in ids:
                continue
            before = last[n - size]
            if before:
                good = fits.get((before, token))
                if good is None:
                    if len(fits) > 500_000:
                        fits.clear()
                    good = fits[before, token] = encode(before + token) == [ids[before], ids[token]]
                if not good:
                    continue
            counts.append(counts[n - size] + 1)
            last.append(token)
            break
    return np.array(counts[1:], np.int32)


def by_characters(word: str, counts: np.ndarray) -> np.ndarray:
    """Counts at the ends of bytes as counts at the ends of characters."""
    return counts[np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in word]) - 1]


def counts_of(texts: list[str], pieces: Pieces) -> list[int]:
    return [len(x) for x in pieces.many(texts)] if texts else []


def word_prefixes(words: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each prefix of Latin-1 words (at most one blank, which leads) by the byte-level engine: all in a row, and where each word's begin."""
    starts, flat, size = np.zeros(len(words), np.int64), [], 0
    short = sorted((i for i, w in enumerate(words) if 0 < len(w) <= SHORT), key=words.__getitem__)
    if short:
        # in sorted order a word shares its first letters, and their counts, with the one before; places past a word's end hold no letter
        own = [words[i] for i in short]
        lens = np.fromiter(map(len, own), np.int64, len(own))
        held = np.arange(int(lens.max())) < lens[:, None]
        letters = np.zeros(held.shape, np.uint8)
        letters[held] = np.frombuffer("".join(own).encode("latin-1"), np.uint8)
        same = np.zeros(len(short), np.int64)
        same[1:] = np.argmin(np.hstack([(letters[1:] == letters[:-1]) & held[1:] & held[:-1], np.zeros((len(short) - 1, 1), bool)]), axis=1)
        new = held & (np.arange(held.shape[1]) >= same[:, None])
        counts = np.zeros(held.shape, np.int32)
        counts[new] = pieces.bytes.counts([w[:k] for w, a, n in zip(own, same.tolist(), lens.tolist(), strict=True) for k in range(a + 1, n + 1)])
        rows = np.maximum.accumulate(np.where(new, np.arange(len(short), dtype=np.int32)[:, None], 0), axis=0)
        flat.append(np.take_along_axis(counts, rows, axis=0)[held])
        starts[short], size = np.cumsum(lens) - lens, int(lens.sum())
    for i, w in enumerate(words):
        if len(w) > SHORT:
            counts, before = np.zeros(len(w), np.int32), 0
            for m in pieces.bytes.cut.finditer(w):  # no part depends on what follows it
                part = m.group()
                counts[m.start() : m.end()] = before + (word_prefixes([part], pieces)[0] if len(part) <= SHORT else by_characters(part, recurrence(part.encode(), pieces)))
                before = int(counts[m.end() - 1])
            flat.append(counts)
            starts[i], size = size, size + len(w)
    return np.concatenate(flat) if flat else np.zeros(0, np.int32), starts


def odd_prefixes(piece: str, pieces: Pieces) -> np.ndarray:
    """Tokens of each prefix of any piece of the byte-level file, by the parts that the library cuts."""
    out, before, begin, base, gap = np.zeros(len(piece), np.int32), 0, 0, 0, []
    for _, (a, z) in pieces.parts(piece):
        if a == 0 or not piece[a - 1].isspace():  # a gap's cut depends on what follows it: begin at the gap's start
            begin, base, gap = a, before, []
        own = piece[a:z]
        if z - a > SHORT and not any(c.isspace() for c in own[1:]):
            ahead = base + sum(counts_of(gap, pieces))
            out[a:z] = ahead + by_characters(own, recurrence(own.encode("utf-8", "surrogatepass"), pieces))
            if own[0].isspace():
                out[a] = base + counts_of([piece[begin : a + 1]], pieces)[0]
        else:
            out[a:z] = [base + n for n in counts_of([piece[begin:n] for n in range(a + 1, z + 1)], pieces)]
        gap.append(own)
        before = int(out[z - 1])
    return out


def piece_prefixes(own: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each prefix of each piece: all in a row, and where each piece's begin."""
    starts = np.zeros(len(own), np.int64)
    if pieces.kind == "gaps":
        found = counts_of([p[:k] for p in own for k in range(1, len(p) + 1)], pieces)
        lens = np.fromiter(map(len, own), np.int64, len(own))
        return np.array(found, np.int32), np.cumsum(lens) - lens
    words: dict[str, int] = {}
    quick, place, made, late = [], [], [], []
    for i, p in enumerate(own):
        if pieces.bytes is None or ODD.search(p):
            made.append((i, odd_prefixes(p, pieces) if pieces.bytes else np.array(counts_of([p[:k] for k in range(1, len(p) + 1)], pieces), np.int32)))
            continue
        if p[0] == " " and len(p) > 1 and p[1] not in GAPS or p[0] not in GAPS:
            quick.append(i)
            place.append(words.setdefault(p, len(words)))
            continue
        body = p.lstrip(GAPS)
        gap = p[: len(p) - len(body)]
        lead = gap[-1] == " " and body != ""
        late.append((i, gap, lead, words.setdefault(" " * lead + body, len(words)) if body else -1))
    flat, begins = word_prefixes(list(words), pieces)
    starts[quick] = begins[place]
    gaps: dict[str, np.ndarray] = {}
    alone = lambda gap: gaps[gap] if gap in gaps else gaps.setdefault(gap, word_gaps(gap, pieces))
    names = list(words)
    for i, gap, lead, w in late:
        counts = alone(gap)
        if w >= 0:  # before a word the last sign of a gap leaves the gap
            ahead = (int(alone(gap[:-1])[-1]) if len(gap) > 1 else 0) + (0 if lead else int(alone(gap[-1])[-1]))
            counts = np.concatenate([counts, ahead + flat[begins[w] + lead : begins[w] + len(names[w])]])
        made.append((i, counts))
    size = len(flat)
    for i, counts in made:
        starts[i], size = size, size + len(counts)
    return np.concatenate([flat, *(c for _, c in made)]), starts


def word_gaps(gap: str, pieces: Pieces) -> np.ndarray:
    """Tokens of each prefix of a gap that ends a text."""
    return by_characters(gap, recurrence(gap.encode(), pieces)) if gap else np.zeros(0, np.int32)


def tables(texts: list[str], pieces: Pieces) -> list[np.ndarray]:
    """For each text the token count of each of its prefixes; those of shorter than all its pieces share the work."""
    if pieces.kind == "whole":
        return [np.array([0, *counts_of([t[:k] for k in range(1, len(t) + 1)], pieces)], np.int32) for t in texts]
    cut, cuts, starts = [], [0], []
    for text in texts:  # an added token is one token; what follows it begins anew, and its own proper prefixes are ordinary text
        for part in parted(text, pieces.added):
            cut += pieces.pieces(part)
            cuts.append(len(cut))
        starts.append(len(cuts) - 1)
    coded = pa.array(cut, pa.large_string()).dictionary_encode()
    own = coded.dictionary.to_pylist()
    flat, begins = piece_prefixes(own, pieces)
    lens = np.fromiter(map(len, own), np.int64, len(own))
    totals = np.where(lens > 0, flat[np.minimum(np.maximum(begins + lens - 1, 0), max(len(flat) - 1, 0))], 0) if len(flat) else np.zeros(len(own), np.int64)
    places = coded.indices.to_numpy()
    before = np.cumsum(np.concatenate([[0], totals[places]]))
    counts = gathered(flat, begins[places], lens[places]) + np.repeat(before[:-1], lens[places])
    ends = np.concatenate([[0], np.cumsum(lens[places])])
    out, at = [], 0
    for text, stop in zip(texts, starts, strict=True):
        parts, made, base = parted(text, pieces.added), [np.zeros(1, np.int64)], 0
        for n, part in enumerate(parts):
            a, z = cuts[at + n], cuts[at + n + 1]
            if pieces.kind == "gaps":
                own_counts = spaced(part, pieces, counts[ends[a] : ends[z]] - before[a])
            else:
                own_counts = counts[ends[a] : ends[z]] - before[a]
            if n + 1 < len(parts):  # this part ends with the string of an added token
                own_counts = own_counts.copy()
                size = next(len(t) for t in pieces.added if part.endswith(t))
                head = len(part) - size
                own_counts[-1] = (own_counts[head - 1] if head else 0) + 1
            made.append(base + own_counts)
            base += int(own_counts[-1]) if len(own_counts) else 0
        out.append(np.concatenate(made))
        at = stop
    return out


def parted(text: str, added: list[str]) -> list[str]:
    """The text cut after each added token."""
    out, at = [], 0
    if any(t in text for t in added):
        for m in re.finditer("|".join(map(re.escape, sorted(added, key=len, reverse=True))), text):
            out.append(text[at : m.end()])
            at = m.end()
    return [*out, text[at:]]


def spaced(text: str, pieces: Pieces, counts: np.ndarray) -> np.ndarray:
    """Counts of a text whose pieces leave out the gaps between them: a gap adds none."""
    out, at, place, last = np.zeros(len(text), np.int64), 0, 0, 0
    for p in pieces.pieces(text):
        out[at : at + len(p)] = counts[place : place + len(p)]
        last = int(counts[place + len(p) - 1]) if p else last
        at, place = at + len(p), place + len(p)
        if at < len(text):
            out[at] = last
        at += 1
    return out


class PrefixTable:
    """Exact counts of one text: ``counts[n]`` tokens in the first n code points."""

    def __init__(self, text: str, tokenizer: Pieces, counts: np.ndarray | None = None):
        self.text = text
        self.counts = tables([text], tokenizer)[0] if counts is None else counts

    @property
    def total(self) -> int:
        return int(self.counts[-1])

    def count(self, n: int) -> int:
        """Tokens of the first ``n`` code points."""
        return int(self.counts[n])

    def fitting(self, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens."""
        if self.total <= budget:
            return len(self.text)
        return int(np.flatnonzero(self.counts <= budget)[-1])


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """Bytes and tokens of every whole text, if it's over the limit, and how many characters fit the limit."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())

    def run(batches):
        own = loaded(tokenizer)
        for keys, texts in text_groups(batches, GROUP_CHARS):
            found = [PrefixTable(text, own, counts) for text, counts in zip(texts, tables(texts, own), strict=True)]
            columns = [keys, [len(t.encode("utf-8", "surrogatepass")) for t in texts], [t.total for t in found], [t.total > limit for t in found], [t.fitting(limit) for t in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fitting_chars"])

    bounded_batches(docs.sparkSession)
    return prepared(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fitting_chars bigint")
