"""Tokenizers kept by each Python worker; many texts are encoded at once by their distinct pieces.

Splitting a text where a blank follows a non-blank is exact for the two BPE files described below:
their pre-tokenizers never build a piece across such a place. In texts with rare kinds of white space only a
printable ASCII sign counts as a non-blank; texts for other tokenizer files are encoded whole.

``flat`` encodes each distinct piece of a group of texts once and gathers the ids of all its places. For the file with
word ends, words of Latin-1 letters, digits and ASCII signs are encoded many at a time by a second BPE engine over the same
merges; every other word, and every text outside Latin-1 or with an added token, goes to the file's own library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space on which the libraries and Python might disagree, or which isn't a plain gap.
RARE_SPACE = re.compile("[\x0b-\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
PIECE = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
SURE = re.compile(r"(?<=[!-~])(?=[ \n\t\r])")
#: What splitting at ASCII white space takes for a letter or a gap and the pre-tokenizer may not.
ODD_GAPS = [b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\x85", b"\xa0"]
#: Latin-1 in lower case.
LOWER = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
LETTERS = [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]
SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
#: How many characters are encoded in one go.
GROUP_CHARS = 8_000_000
_LOADED: dict[str, "Pieces"] = {}


def tokenizer_path(path: str) -> str:
    """A full path as it is; a bare file name is looked up among the public tokenizers of the machine that runs this."""
    if os.path.isabs(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and that byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class WordEnds:
    """A BPE file with word ends as an engine over marked text.

    The last letter of a piece is marked by its upper case (texts are lower-cased, so that is free), a sign inside a run of signs by
    a control character; digits are pieces of their own. Merges then look the same with and without the mark, and
    one call encodes words of any number.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, alphabet = model["vocab"], byte_alphabet()
        inner = dict(zip(SIGNS, [*range(32), 127], strict=False))
        last = {c: c - 32 for c in LETTERS} | {0xDF: 0xD7, 0xFF: 0xF7}

        def unit(b: int, end: bool) -> int | None:
            """A byte of UTF-8 text as a byte of marked text."""
            if 97 <= b <= 122:
                return b - 32 * end
            if 48 <= b <= 57:
                return b if end else None
            if b in inner:
                return b if end else inner[b]
            if b == 0xC3:
                return None if end else b
            if 0x9F <= b <= 0xBF and b != 0xB7:  # second byte of the letters from U+00DF
                return last[b + 0x40] - 0x40 if end else b
            return None

        def marked(token: str) -> bytes | None:
            end = len(token) > 4 and token.endswith("</w>")
            body = token[:-4] if end else token
            units = [unit(alphabet[c], end and i == len(body) - 1) for i, c in enumerate(body)]
            return None if None in units else bytes(units)

        pairs = ((m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
        order = [a + b for a, b in pairs] + [t for t in vocab if (k := marked(t)) is not None and len(k) == 1]
        ranks: dict[bytes, int] = {}
        ids: list[int] = []
        for token in order:
            if (k := marked(token)) is not None and k not in ranks:
                ranks[k] = len(ids)
                ids.append(vocab[token])
        for b in range(256):
            if bytes([b]) not in ranks:  # never met
                ranks[bytes([b])] = len(ids)
                ids.append(0)
        self.ids = np.array(ids, np.uint32)
        inside = "a-z\xdf-\xf6\xf8-\xff\x00-\x1f\x7f"
        self.engine = tiktoken.Encoding("words", pat_str=f"[{inside}]*[^{inside} ]", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kind = np.full(256, 4, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 sign, 4 not for this engine
        self.kind[32], self.kind[LETTERS], self.kind[48:58], self.kind[SIGNS], self.kind[ord("'")] = 0, 1, 2, 3, 4
        self.inner, self.last = np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
        self.inner[list(inner)], self.last[LETTERS] = list(inner.values()), [last[c] for c in LETTERS]

    def encode(self, words: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of ``n`` Latin-1 words, each followed by one blank; start and number of ids per word; the words to leave to the library."""
        raw = np.frombuffer(words, np.uint8)
        kind = self.kind[raw]
        blank = kind == 0
        word = np.cumsum(blank) - blank
        rest = np.zeros(n, bool)
        rest[word[kind == 4]] = True
        end = np.zeros(len(raw), bool)
        end[:-1] = (kind[1:] != kind[:-1]) | (kind[:-1] == 2)
        end[blank] = False
        text = np.where(end, self.last[raw], self.inner[raw])
        if rest.any():
            gone = rest[word]
            text[gone], end[gone] = 32, False
        text[blank] = 32
        ids = self.ids[self.engine.encode_to_numpy(text.tobytes().decode("latin-1"))]
        cuts = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        pieces = np.bincount(word[end], minlength=n)
        if len(cuts) - 1 != pieces.sum():
            return None
        stop = cuts[np.cumsum(pieces)]
        start = np.concatenate([[0], stop[:-1]])[:n]
        return ids, start, stop - start, np.flatnonzero(rest)


class ByteLevel:
    """A byte-level BPE file as an engine over words of Latin-1 with at most a leading blank."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        pairs = ((m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
        raw = lambda t: bytes(alphabet[c] for c in t)
        self.ids = {bytes([b]): b for b in range(256)}  # by order of merging, not the file's numbers
        for a, b in pairs:
            self.ids.setdefault(raw(a + b), len(self.ids))
        self.longest = max(map(len, self.ids))
        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
        self.engine = tiktoken.Encoding("bytes", pat_str=words + "|\n| ", mergeable_ranks=self.ids, special_tokens={})
        self.cut = regex.compile(words)
        self.fits: dict[tuple[bytes, bytes], bool] = {}

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word."""
        ends = np.flatnonzero(self.engine.encode_to_numpy("\n".join(words) + "\n") == 10) if words else np.zeros(0, np.int64)
        return np.diff(ends, prepend=-1).astype(np.int32) - 1


class Pieces:
    """``many(texts)`` as the library gives their ids, ``pieces(text)`` that can be encoded one by one (None if not), and ``flat(texts)``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = full = tokenizer_path(path)
        self.words = self.bytes = None
        self.kind, self.added = "whole", []
        if full.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=full)
            self.many = lambda texts: model.encode(texts, num_threads=1)
            self.size = model.get_piece_size()
            return
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(full)
        model.no_truncation()
        model.no_padding()
        self.many = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        self.size = model.get_vocab_size()
        tokens = model.get_added_tokens_decoder().values()
        self.added = [t.content for t in tokens]
        self.added_bytes = [t.content.lower().encode("latin-1", "replace") for t in tokens]
        unsafe = any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in tokens)
        before, normal = str(model.pre_tokenizer), str(model.normalizer)
        if not unsafe and before == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)" and normal == "None":
            self.kind = "leading"
            self.parts = model.pre_tokenizer.pre_tokenize_str
            self.bytes = ByteLevel(full)
            own = sorted(w for t in model.get_vocab() if t.isascii() and (w := t.removeprefix("\u0120")).isalnum())
            if self.bytes.counts(own).tolist() != [len(x) for x in self.many(own)]:  # both engines must agree on the file's own words
                self.bytes = None
        elif not unsafe and before.startswith("Sequence(pretokenizers=[Split(") and "behavior=Removed, invert=True" in before and normal == 'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\\s+"), content=" "), Lowercase()])':
            self.kind = "gaps"
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            if pattern in before and "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)" in before and 'end_of_word_suffix="</w>"' in str(model.model):
                self.words = WordEnds(full)
                own = sorted(t.removesuffix("</w>") for t in model.get_vocab() if t.isascii() and (w := t.removesuffix("</w>")).isalpha() and w.islower())
                got = self.words.encode((" ".join(own) + " ").encode(), len(own))  # both engines must agree on the file's own words
                if got is None or [got[0][a : a + n].tolist() for a, n in zip(got[1], got[2], strict=True)] != self.many(own):
                    self.words = None

    def pieces(self, text: str) -> list[str] | None:
        if self.kind == "whole":
            return None
        if self.kind == "gaps":
            return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")  # empty pieces have no ids
        return [p for p in SURE.split(text) if p] if RARE_SPACE.search(text) else PIECE.findall(text)

    def lowered(self, text: str) -> str | None:
        """The text in lower case if it is Latin-1 (nothing composes there) without odd gaps or added tokens."""
        try:
            low = text.encode("latin-1").translate(LOWER)
        except UnicodeEncodeError:
            return None
        return None if any(c in low for c in ODD_GAPS) or any(t in low for t in self.added_bytes) else low.decode("latin-1")

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and their number per text."""
        if self.kind == "whole" or not texts:
            return joined_ids(self.many(texts))
        plain = [self.lowered(t) if self.words else None for t in texts]
        quick = [i for i, p in enumerate(plain) if p is not None]
        slow = [i for i, p in enumerate(plain) if p is None]
        parts = []
        if quick:
            parts.append((quick, self._by_words([plain[i] for i in quick])))
        if slow:
            parts.append((slow, self._by_pieces([texts[i] for i in slow])))
        if len(parts) == 1:
            return parts[0][1]
        counts = np.zeros(len(texts), np.int64)
        starts = np.zeros(len(texts), np.int64)
        base = 0
        for at, (ids, n) in parts:
            counts[at], starts[at] = n, base + np.cumsum(n) - n
            base += len(ids)
        return gathered(np.concatenate([ids for _, (ids, _) in parts]), starts, counts), counts

    def _by_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = words.values.dictionary_encode()
        own, n = coded.dictionary, len(coded.dictionary)
        line = pc.binary_join(pa.ListArray.from_arrays([0, n], own), pa.scalar(" ", own.type))[0].as_py() + " "
        found = self.words.encode(line.encode("latin-1"), n)
        if found is None:
            ids, lens = joined_ids(self.many(own.to_pylist()))
            starts = np.cumsum(lens) - lens
        else:
            ids, starts, lens, rest = found
            if len(rest):
                more, n_more = joined_ids(self.many(own.take(pa.array(rest)).to_pylist()))
                starts[rest], lens[rest] = len(ids) + np.cumsum(n_more) - n_more, n_more
                ids = np.concatenate([ids, more])
        return at_places(ids, starts, lens, coded.indices.to_numpy(), words.offsets.to_numpy())

    def _by_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        numbers: dict[str, int] = {}
        places, offsets = [], [0]
        for text in texts:
            places += [numbers.setdefault(p, len(numbers)) for p in self.pieces(text)]
            offsets.append(len(places))
        ids, lens = joined_ids(self.many(list(numbers)))
        return at_places(ids, np.cumsum(lens) - lens, lens, np.array(places, np.int64), np.array(offsets))

    def encoded(self, texts: list[str], make) -> list[list]:
        """One made value per text."""
        ids, counts = self.flat(texts)
        ends = np.cumsum(counts).tolist()
        return [[make(ids[e - n : e].tolist())] for e, n in zip(ends, counts.tolist(), strict=True)]


def joined_ids(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for own in lists for i in own), np.uint32, int(lens.sum())), lens


def gathered(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The slices of ``values`` in a row."""
    stop = np.cumsum(lens)
    return values[np.repeat(starts - (stop - lens), lens) + np.arange(stop[-1] if len(stop) else 0)]


def at_places(values: np.ndarray, starts: np.ndarray, lens: np.ndarray, places: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of numbered pieces at all their places, and how many each text has (its places lie between ``offsets``)."""
    own = lens[places]
    sums = np.concatenate([[0], np.cumsum(own)])
    return gathered(values, starts[places], own), sums[offsets[1:]] - sums[offsets[:-1]]


def loaded(path: str) -> Pieces:
    """The worker's own tokenizer."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]
