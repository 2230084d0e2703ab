"""Token ids by a public tokenizer file, as the tokenizers library gives them, with a bounded memory of chunks."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

OTHER_SPACE = re.compile("[\0\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _needs_whole(text: str) -> bool:
    """True for white space at which chunks could differ from the whole text."""
    return "  " in text or text[:1] == " " or text[-1:] == " " or OTHER_SPACE.search(text) is not None


PIECE = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[0-9]+|[!-&(-/:-@\\[-`{-~]+|\n")
"""Runs of letters, digits, marks (but for apostrophes) and line feeds, between which both tokenizers break."""


LOW_LETTERS = re.compile("[a-z\u00e0-\u00f6\u00f8-\u00ff]+")
LETTERS_BEHIND_BLANK = re.compile(" [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")

ALONE = re.compile(r"([.,]) (?<=[^\W_][.,] )")
"""A full stop or comma behind a letter or digit of any script; behind all else it may belong to a longer token."""


def _spread(text: str, keeps_blanks: bool) -> str | None:
    """The text with single full stops and commas (and line feeds) as chunks of their own; None if it can't be had so.

    Both tokenizers break between a letter or digit and a mark, but a run of all else (quotes, currency and degree signs,
    emoji, combining signs) is one token, so only what ALONE finds is put apart. Where blanks count, a zero marks chunks
    that have none before them; else the text is lower-cased, but for the letter that lower-cases by its place and for
    what composing (NFC, which the tokenizer does first) would change before or after that.
    """
    if not keeps_blanks:
        low = text.lower()
        if "\u03a3" in text or not (text.isascii() or is_normalized("NFC", text) and is_normalized("NFC", low)):
            return None
        return ALONE.sub(r" \1 ", low.replace("\n", " "))
    if " ." in text or " ," in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] == "\n" or text[-1:] == "\n":
        return None
    return "\0" + ALONE.sub(" \0\\1 ", text).replace("\n", " \0\n \0")


class _Codes(dict):
    """Numbers chunks in the order of their first use."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = code = len(self)
        self.new.append(chunk)
        return code


class ChunkEncoder:
    """Ids of whole texts. Both public files break tokens at a single blank, so chunks between blanks are encoded once.

    A new chunk is put together from its pieces (see PIECE), if it is made of these alone. Pieces of letters are encoded
    many at a time, as one text, and told apart by the tokens that begin or end a word. ``keeps_blanks``: the tokenizer
    joins a blank to the word behind it (byte_bpe), else white space is dropped and letters are lower-cased (word_bpe).
    Texts that hold a special token's string go to the tokenizer whole. ``remember`` bounds the chunks that are kept, and
    so the memory; an encoder lives as long as its task.
    """

    def __init__(self, path: str, keeps_blanks: bool, remember: int = 500_000) -> None:
        self.tokenizer = _tokenizer(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.edge = _edges(path, keeps_blanks)
        self.keeps_blanks = keeps_blanks
        self.remember = remember
        self._clear()

    def _clear(self) -> None:
        self.codes = _Codes()
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, chunk: str) -> list[str]:
        first = chunk[:1] == "\0"
        chunk = chunk[1:] if first else chunk
        blank = " " if self.keeps_blanks and not first else ""
        found = PIECE.findall(chunk)
        if sum(map(len, found)) != len(chunk) or "\n" in (chunk[:1], chunk[-1:]) or "\n\n" in chunk:
            return [blank + chunk] if chunk else []
        if not self.keeps_blanks:
            return [f.lower() for f in found if f != "\n"]
        if found:
            found[0] = blank + found[0]
        return found

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of distinct pieces, and where each one's begin and how many they are."""
        plain = LETTERS_BEHIND_BLANK if self.keeps_blanks else LOW_LETTERS
        joined = [n for n, p in enumerate(pieces) if plain.fullmatch(p)]
        mark = "" if self.keeps_blanks else " "
        texts = [mark.join([pieces[n] for n in joined[a:a + 500]]) for a in range(0, len(joined), 500)]
        ids = np.fromiter(chain.from_iterable(self._ids(texts)), np.uint32)
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(joined):  # a file with other rules than the two known ones
            joined, ids, at = [], ids[:0], at[:0]
        start, length = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        begin = at if self.keeps_blanks else np.append(0, at[:-1] + 1)[:len(at)]
        start[joined], length[joined] = begin, np.diff(np.append(begin, len(ids)))
        known = set(joined)
        others = [n for n in range(len(pieces)) if n not in known]
        found = self._ids([pieces[n] for n in others])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        start[others], length[others] = len(ids) + np.cumsum(sizes) - sizes, sizes
        return np.append(ids, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))), start, length

    def _learn(self) -> None:
        blank = " " if self.keeps_blanks else ""
        made = [[blank + c] if LOW_LETTERS.fullmatch(c) else self._pieces(c) for c in self.codes.new]
        flat = list(chain.from_iterable(made))
        number = {p: n for n, p in enumerate(dict.fromkeys(flat))}
        ids, start, length = self._encoded(list(number))
        own = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        lengths = length[own]
        ends = np.cumsum(lengths)
        new = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[own] - ends + lengths, lengths)]
        bounds = np.append(0, ends)[np.append(0, np.cumsum([len(m) for m in made]))]
        self.bounds = np.append(self.bounds, (len(self.ids) + bounds[1:]).astype(np.int32))
        self.ids = np.concatenate([self.ids, new])
        self.codes.new = []

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, ``end`` behind each one, and the number of ids of each (with ``end``)."""
        if len(self.codes) > self.remember:
            self._clear()
        plain, whole = [], {}
        for n, text in enumerate(texts):
            text = text or ""
            if _needs_whole(text) or any(t in text for t in self.special):
                whole[n] = np.array(self._ids([text])[0], np.uint32)
                plain.append(None)
                continue
            spread = _spread(text, self.keeps_blanks)
            if spread is None:
                spread = "\0" + text if self.keeps_blanks else text  # the first chunk has no blank before it
            plain.append(spread)
        chunks = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        coded = chunks.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        if self.codes.new:
            self._learn()
        found = pa.ListArray.from_arrays(pa.array(self.bounds), pa.array(self.ids)).take(pa.array(known).take(coded.indices))
        ids = found.flatten().to_numpy(zero_copy_only=False)
        ends = found.offsets.to_numpy()
        bounds = ends[np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(chunks), 0).to_numpy(zero_copy_only=False)))]
        pieces, counts = [], np.zeros(len(texts), np.int64)
        stop = np.array([end], np.uint32)
        for n in range(len(texts)):
            own = whole[n] if n in whole else ids[bounds[n]:bounds[n + 1]]
            pieces += [own, stop]
            counts[n] = len(own) + 1
        return (np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)), counts


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    """Read once by each Python worker."""
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _edges(path: str, begins: bool) -> np.ndarray:
    """Which ids begin with a blank (byte_bpe) or end a word (word_bpe)."""
    names = _tokenizer(path).get_vocab(with_added_tokens=False)
    edge = np.zeros(max(names.values(), default=0) + 1, bool)
    edge[[i for t, i in names.items() if (t[:1] == "\u0120" if begins else t.endswith("</w>"))]] = True
    return edge


def in_groups(texts: list[str | None], chars: int = 2_000_000):
    """Slices (from, to) of a batch with about ``chars`` characters each; a text is never cut."""
    at, size = 0, 0
    for n, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield at, n + 1
            at, size = n + 1, 0
    if at < len(texts):
        yield at, len(texts)
