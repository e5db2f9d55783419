"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once.

Both vocabularies break a text into pre-tokens that never reach over a space that stands between
two visible characters, nor from a Latin letter over a mark of punctuation that follows it. A text is
therefore cut at such places, every distinct piece is encoded once by the library, and the pieces'
ids are joined; the result equals encoding the whole text. Words are found, counted and looked up in
Arrow; only words that the memo doesn't hold pass through Python, many in one string. The memo takes words that occur twice in a chunk, ``memo`` of them at most; beyond that the
half that was used longest ago goes.

Strings of the tokenizer's special tokens in a text give their ids, as the library's defaults say;
with ``special_text`` they are ordinary text.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Any white space that isn't one space or one line feed between visible characters.
_ODD = re.compile(r"\s\s|^\s|\s$|[^\S \n]")
#: The same, and NUL, for the regular expressions of Arrow.
_ODD_RE2 = r"[ \n][ \n]|^[ \n]|[ \n]$|[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_GAP = re.compile(r"\s")
#: Letters whose lower case is one letter (U+0130 has two), and marks that never belong to the pre-token of a letter before them.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]", "[.,;:!?]"
_CUT, _TAIL = r"(?<=\S)(?= \S)", f"(?<={_LETTERS})(?={_MARKS})"
_TAIL_RE2 = f"({_LETTERS})({_MARKS})"
#: A space or none and letters: one pre-token.
_PLAIN_RE2 = f"^ ?{_LETTERS}+$"


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(others)}


#: The alphabet as code points. Between words NUL is a space that parts them and a line feed the mark.
_ALPHABET = np.array([ord(_byte_chars().get(b, chr(b))) for b in range(256)], "<u4")
_ALPHABET[0] = 32


def _rows(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``begin`` and have ``size`` numbers, one after the other."""
    take = np.arange(int(size.sum()), dtype=np.int64)
    take += np.repeat(begin - (np.cumsum(size) - size), size)
    return flat[take]


class WordEncoder:
    """Little-endian unsigned 32-bit ids of texts (null: none) and the end id after each."""

    def __init__(self, path: str, drops_spaces: bool, end: int | None = 0, memo: int = 100_000, special_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_text
        self.special = () if special_text else tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.drops, self.most = drops_spaces, memo
        # A mark between pieces that is a token of its own wherever it stands.
        self.mark, self.join = ("\x01", " \x01 ") if drops_spaces else ("\n", "\n")
        self.mark_id = self.tok.encode(self.mark, add_special_tokens=False).ids[0]
        self.end = np.array([] if end is None else [end], "<u4")
        # The same model without normalisation, for words in the alphabet of bytes that a space parts.
        self.model = Tokenizer(self.tok.model)
        self.model.pre_tokenizer = CharDelimiterSplit(" ")
        self.line_id = self.model.encode(chr(_ALPHABET[10]), add_special_tokens=False).ids[0]
        self.tails = not any(re.search(_TAIL, s) for s in self.special)
        self.cut = re.compile(f"{_CUT}|{_TAIL}" if self.tails else _CUT)
        # The memo: words, where each one's ids lie in ``flat``, and the chunk that used it last.
        self.words, self.flat, self.chunk = pa.array([""], pa.string()), np.zeros(0, "<u4"), 0
        self.begin, self.size, self.used = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _library(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces by the library: those that can't touch a neighbour many at a time with a mark between them, else each alone."""
        out: dict[str, list[int]] = {}
        apart = [p for p in pieces if not p.strip() or _GAP.search(p, 1) or self.mark in p or any(s in p for s in self.special)]
        for k in range(0, len(apart), 1_000):
            part = apart[k : k + 1_000]
            out.update(zip(part, (e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        rest = [p for p in pieces if p not in out]
        rows = [rest[k : k + 100] for k in range(0, len(rest), 100)]
        for k in range(0, len(rows), 10):
            for part, e in zip(rows[k : k + 10], self.tok.encode_batch_fast([self.join.join(r) for r in rows[k : k + 10]], add_special_tokens=False), strict=True):
                ids = e.ids
                cuts = [i for i, x in enumerate(ids) if x == self.mark_id]
                if len(cuts) != len(part) - 1:
                    raise ValueError("the mark isn't one token")
                out.update((p, ids[a + 1 : z]) for p, a, z in zip(part, [-1, *cuts], [*cuts, len(ids)], strict=True))
        return [out[p] for p in pieces]

    def _words(self, words: pa.Array, many: int = 1_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are one pre-token and that normalisation leaves as they are, one after the other, and how many each has."""
        flat, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        edges = np.append(np.arange(0, len(words), many), len(words)).astype(np.int32)
        for k, row in enumerate(pc.binary_join(pa.ListArray.from_arrays(edges, words), "\0\n\0")):
            row = _ALPHABET[np.frombuffer(row.as_buffer(), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.model.encode_batch_fast([row], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.line_id)
            if len(cuts) != edges[k + 1] - edges[k] - 1:
                raise ValueError("the line feed isn't one token")
            flat.append(np.delete(ids, cuts))
            sizes.append(np.diff(cuts, prepend=-1, append=len(ids)) - 1)
        return np.concatenate(flat), np.concatenate(sizes)

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, and how many each has."""
        plain = pc.match_substring_regex(pieces, _PLAIN_RE2)
        words = pieces.filter(plain)
        flat, n_word = self._words(pc.utf8_lower(words) if self.drops else words)
        got = self._library(pieces.filter(pc.invert(plain)).to_pylist())
        n_other = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.concatenate([flat, np.fromiter((i for ids in got for i in ids), "<u4", int(n_other.sum()))])
        sizes = np.concatenate([n_word, n_other])
        begins = np.cumsum(sizes) - sizes
        plain = plain.to_numpy(zero_copy_only=False)
        order = np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]))
        return _rows(flat, begins[order], sizes[order]), sizes[order]

    def _look(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table of ids, and where in it the ids of each of the distinct words begin and how many they are."""
        self.chunk += 1
        at = pc.index_in(words, value_set=self.words)
        new = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy()
        self.used[at[~new]] = self.chunk
        unknown = words.filter(pa.array(new))
        ids, sizes = self._learn(unknown)
        begins = len(self.flat) + np.cumsum(sizes) - sizes
        begin, size = self.begin[at], self.size[at]
        begin[new], size[new] = begins, sizes
        table = np.concatenate([self.flat, ids])
        often = counts[new] > 1
        if often.any():
            self.words = pa.concat_arrays([self.words, unknown.filter(pa.array(often))])
            self.flat = np.concatenate([self.flat, ids[np.repeat(often, sizes)]])
            self.size = np.concatenate([self.size, sizes[often]])
            self.begin = np.cumsum(self.size) - self.size
            self.used = np.concatenate([self.used, np.full(int(often.sum()), self.chunk)])
        if len(self.words) > self.most:
            stay = np.zeros(len(self.used), bool)
            stay[np.argsort(-self.used, kind="stable")[: self.most // 2]] = True
            self.words = self.words.filter(pa.array(stay))
            self.flat = self.flat[np.repeat(stay, self.size)]
            self.size, self.used = self.size[stay], self.used[stay]
            self.begin = np.cumsum(self.size) - self.size
        return table, begin, size

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """The pieces of each text (no null among them)."""
        if self.drops:
            texts = pc.replace_substring(texts, "\n", " ")
            return pc.split_pattern(pc.replace_substring_regex(texts, _TAIL_RE2, r"\1 \2") if self.tails else texts, " ")
        odd = pc.match_substring_regex(texts, _ODD_RE2)
        # One space between visible characters goes with the word that follows it; one line feed stands alone.
        marked = pc.replace_substring(pc.replace_substring(pc.if_else(odd, "", texts), " ", "\x00 "), "\n", "\x00\n\x00")
        if self.tails:
            marked = pc.replace_substring_regex(marked, _TAIL_RE2, "\\1\x00\\2")
        cut = pc.split_pattern(marked, "\x00")
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(rows):
            lists = [self.cut.split(t) for t in texts.take(pa.array(rows)).to_pylist()]
            both = pa.concat_arrays([cut, pa.array(lists, cut.type)])
            where = np.arange(len(texts))
            where[rows] = len(texts) + np.arange(len(rows))
            cut = both.take(pa.array(where))
        return cut

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of texts, one after the other with the end id after each, and where each text's ids begin (and the end)."""
        cut = self._cut(pc.fill_null(texts.cast(pa.string()), ""))
        coded = cut.flatten().dictionary_encode()
        word = coded.indices.to_numpy()
        table, begin, size = self._look(coded.dictionary, np.bincount(word, minlength=len(coded.dictionary)))
        begin, size = begin[word], size[word]
        upto = np.concatenate([[0], np.cumsum(size)])
        offsets = cut.offsets.to_numpy()
        offsets = offsets - offsets[0]
        tail = len(self.end)
        starts = upto[offsets] + tail * np.arange(len(offsets))
        ids = _rows(table, begin, size)
        if not tail:
            return ids, starts
        out = np.full(int(starts[-1]), self.end[0], "<u4")
        own = np.ones(len(out), bool)
        own[starts[1:] - 1] = False
        out[own] = ids
        return out, starts

    def ids(self, texts: list[str | None]) -> list[bytes]:
        flat, starts = self.column(pa.array(texts, pa.string()))
        return [flat[a:z].tobytes() for a, z in zip(starts[:-1], starts[1:], strict=True)]


_cache: dict[tuple, WordEncoder] = {}


def chunks(texts: pa.Array, most: int = 2_000_000):
    """Ranges of rows of about ``most`` bytes of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        base = size[a - 1] if a else 0
        z = max(a + 1, int(np.searchsorted(size, base + most, "right")))
        yield a, z
        a = z


def encoder(path: str, drops_spaces: bool, special_text: bool = False) -> WordEncoder:
    """One encoder for each worker process and file."""
    key = (path, drops_spaces, special_text)
    if key not in _cache:
        _cache[key] = WordEncoder(path, drops_spaces, special_text=special_text)
    return _cache[key]
