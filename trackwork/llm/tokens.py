"""Token ids and counts of whole texts, each distinct word encoded once per Python worker.

A lower-casing word tokenizer drops white space and never joins across it, so a text is the
sequence of its words and equal words have equal ids. Words outside a range of letters for which
Python's and the library's normal forms, lower case and letter classes agree go to the library as
they are. Other tokenizers get whole texts, long ones cut where no token can span.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Printable ASCII and the precomposed letters of Latin-1.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: Letters of plain words, and what often follows them.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
#: Pieces of a lower-cased plain word, as the tokenizer's own pattern cuts it.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
BLANKS = str.maketrans("\t\n\r", "   ")
CACHED_WORDS = 150_000
LONGEST_CACHED = 64
#: Words of a batch whose ids are put together at a time.
JOINED_WORDS = 1 << 18
BATCH_BYTES = 1 << 20
#: A single blank between visible text and a letter: the next token starts with it.
SAFE_CUT = re.compile(r"(?<=\S) (?=[^\W\d_])")

_OPEN: dict = {}


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Cache(dict):
    """Word -> what ``of`` makes of it; filled as words are met, emptied when it holds more than ``most``."""

    def __init__(self, of, most: int):
        self.of, self.most = of, most

    def __missing__(self, word):
        value = self.of(word)
        if len(word) <= LONGEST_CACHED:
            self[word] = value
        return value

    def trim(self):
        if len(self) > self.most:
            self.clear()


class WordTokenizer:
    """Ids of a tokenizer that lower-cases words and drops the white space between them."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.tokenize = self.whole.model.tokenize
        self.letters = _byte_letters()
        # Fewer than the words: one for "Word", "word," and "(word)".
        self.pieces = Cache(self._piece, cached_words)
        self.packed = Cache(self._word, cached_words)
        self.lengths = Cache(lambda word: len(self._word(word)) // 4, cached_words)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """Ids as ``ids`` gives them."""
        stem = word.rstrip(MARKS)
        if LETTERS.fullmatch(stem):  # most words: letters, then marks
            own = self.pieces[stem.lower()]
            return own + self.pieces[word[len(stem) :]] if len(stem) < len(word) else own
        if "<|" in word or not PLAIN.fullmatch(word):
            ids = self.whole.encode(word, add_special_tokens=False).ids if word else []
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(word.lower())))

    def _trim(self):
        for cache in (self.pieces, self.packed, self.lengths):
            cache.trim()

    @staticmethod
    def words(text: str | None) -> list[str]:
        return (text or "").translate(BLANKS).split(" ") if text and ("\t" in text or "\r" in text) else (text or "").replace("\n", " ").split(" ")

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        out = b"".join(map(self.packed.__getitem__, self.words(text)))
        self._trim()
        return out

    def ids_of_each(self, texts: pa.Array) -> list[bytes]:
        """``ids`` of each text; a word is looked up once, however often these texts have it."""
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(texts)
        bounds = lists.offsets.to_numpy()
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        words = list(map(self.packed.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) // 4
        flat, starts = np.frombuffer(b"".join(words), "<u4"), np.cumsum(sizes) - sizes
        self._trim()
        met, joined = coded.indices.to_numpy(), [np.empty(0, "<u4")]
        for first in range(0, len(met), JOINED_WORDS):
            own = met[first : first + JOINED_WORDS]
            ends = np.cumsum(sizes[own])
            joined.append(flat[np.repeat(starts[own] - ends + sizes[own], sizes[own]) + np.arange(ends[-1])])
        ids = np.concatenate(joined)
        ends = np.concatenate([[0], np.cumsum(sizes[met])])[bounds - bounds[0]]
        return [ids[low:high].tobytes() for low, high in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def counts(self, texts: list[str | None]) -> list[int]:
        at = self.lengths.__getitem__
        out = [sum(map(at, self.words(text))) for text in texts]
        self._trim()
        return out


class TextTokenizer:
    """Counts of any other tokenizer: whole texts, long ones cut at safe places."""

    def __init__(self, path: str):
        self.blank_goes = path.endswith(".model")
        if self.blank_goes:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            # A piece with a blank inside could span a cut; then texts stay whole.
            pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
            self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
            self.encode = lambda batch: [len(x) for x in model.encode(batch, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.cuts = _cuts_before_blanks(path)
            self.encode = lambda batch: [len(x) for x in model.encode_batch_fast(batch, add_special_tokens=False)]

    def parts(self, text: str) -> Iterator[str]:
        start = 0
        while self.cuts and len(text) - start > BATCH_BYTES // 4:
            cut = SAFE_CUT.search(text, start + BATCH_BYTES // 8)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.end() if self.blank_goes else cut.start()
        yield text[start:]

    def counts(self, texts: list[str | None]) -> list[int]:
        out, owners, batch, size = [0] * len(texts), [], [], 0

        def flush():
            for owner, n in zip(owners, self.encode(batch)):
                out[owner] += n
            owners.clear()
            batch.clear()

        for i, text in enumerate(texts):
            for part in self.parts(text or ""):
                owners.append(i)
                batch.append(part)
                size += len(part)
                if size >= BATCH_BYTES:
                    flush()
                    size = 0
        flush()
        return out


def _definition(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def _steps(definition: dict, name: str) -> list[dict]:
    """The normalizers or pre-tokenizers of a tokenizer, in order."""
    step = definition.get(name) or {}
    return step.get("normalizers") or step.get("pretokenizers") or ([step] if step else [])


def _drops_blanks(path: str) -> bool:
    """Whether a .json tokenizer is the kind that ``WordTokenizer`` serves."""
    if not path.endswith(".json"):
        return False
    made = _definition(path)
    normal = [s["type"] for s in _steps(made, "normalizer")]
    cutting = _steps(made, "pre_tokenizer")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return (
        made["model"]["type"] == "BPE"
        and normal == ["NFC", "Replace", "Lowercase"]
        and [s["type"] for s in cutting] == ["Split", "ByteLevel"]
        and cutting[0]["pattern"].get("Regex") == pattern
        and cutting[0]["behavior"] == "Removed"
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or "<|" not in t["content"] for t in made["added_tokens"])
    )


def _cuts_before_blanks(path: str) -> bool:
    """Whether a byte-level tokenizer starts a new token at a single blank before a letter."""
    made = _definition(path)
    cutting = _steps(made, "pre_tokenizer")
    plain = [s["type"] for s in cutting] == ["ByteLevel"] and not cutting[0].get("add_prefix_space", True)
    return plain and cutting[0].get("use_regex", True) and not made.get("normalizer")


def tokenizer(path: str, cached_words: int = CACHED_WORDS) -> WordTokenizer | TextTokenizer:
    """The tokenizer of a file, opened once per Python worker; one of words keeps the ids of so many and of as many pieces, at about 0.15 kB each."""
    key = path, cached_words
    if key not in _OPEN:
        _OPEN[key] = WordTokenizer(path, cached_words) if _drops_blanks(path) else TextTokenizer(path)
    return _OPEN[key]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch, rows: int = 256):
    """Parts of an Arrow batch that are small enough to become Python objects."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
