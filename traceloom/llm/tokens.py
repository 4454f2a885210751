"""Exact token ids of whole texts: each pre-token of a group of texts is looked up once, in a cache bounded by bytes."""
from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose pre-tokens are told apart together; bytes of one of the two generations of pre-tokens that a Python
#: worker keeps, and of an entry beside its key and its value.
GROUP, KEPT_BYTES, ENTRY = 1 << 22, 32 << 20, 200
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Texts of which Python's character classes and the tokenizers' agree, those whose words are parted by one space or line feed
#: each, and the start of every special token.
_PLAIN, _EVEN, _SPECIAL = rf"\A[ \n!-~{_LETTER}]*\z", rf"\A[!-~{_LETTER}]+(?:[ \n][!-~{_LETTER}]+)*\z", "<|"
#: A space that no pre-token of any of the known kinds reaches over from its left, and that no normaliser changes.
_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
#: Ends a word among joined ones; no plain text has it.
_MARK = "\x01"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_PARTS = re.compile(rf" ?[{_LETTER}]+|{_MARK}| ?[0-9]+|{_SHORT}| ?[^\s{_MARK}{_LETTER}0-9]+|\s+(?!\S)|\s+")
_WORD_PARTS = re.compile(rf"[{_LETTER}]+|{_MARK}|[0-9]|{_SHORT}|[^\s{_MARK}{_LETTER}0-9]+")


def _strings(array_: pa.Array) -> list[str]:
    return array_.to_numpy(zero_copy_only=False).tolist()


def _laid_out(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ids (of these sizes, one after another) in the order of which, and the end of each."""
    first, size = (np.cumsum(sizes) - sizes).astype(np.int32), sizes.astype(np.int32)[which]
    ends = np.cumsum(size, dtype=np.int32)
    return ids[np.repeat(first[which] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)], ends


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Known:
    """Ids of pre-tokens, forgotten by bytes: a full generation becomes the old one, and what is used again comes back from there."""

    def __init__(self, find: Callable[[str], bytes], most: int = KEPT_BYTES):
        self.find, self.most, self.room, self.new, self.old = find, most, most, {}, {}

    def of(self, keys: list[str]) -> list[bytes]:
        out: list = [*map(self.new.get, keys)]
        find = self.find
        for i in [i for i, x in enumerate(out) if x is None]:
            key = keys[i]
            value = self.old.get(key)
            if value is None:
                value = find(key)
            out[i] = self.new[key] = value
            self.room -= ENTRY + len(key) + len(value)
            if self.room < 0:
                self.old, self.new, self.room = self.new, {}, self.most
        return out


def _pieces(text: str) -> Iterator[str]:
    """A text of more than GROUP characters in pieces of about as many, parted before spaces where the ids are those of the whole."""
    at = 0
    while len(text) - at > GROUP and (cut := _CUT.search(text, at + GROUP)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Encoder:
    """raw(texts) gives the ids of tokenizer.encode(text, add_special_tokens=False) of every text.

    Texts are parted as the file's pre-tokeniser does; each different part of a group of texts is looked up once, and unknown
    ones go to the file's model. Where characters are unusual, or the file is of another kind, the library encodes the text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        kinds = json.load(open(path, encoding="utf-8"))
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.parts = Known(self._part)
        pre, norm = kinds.get("pre_tokenizer") or {}, json.dumps(kinds.get("normalizer"))
        split = (pre.get("pretokenizers") or [{}])[0]
        self.kind = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm == "null":
            self.kind = "byte"
        elif split.get("behavior") == "Removed" and split.get("pattern", {}).get("Regex", "").startswith("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|") and "Lowercase" in norm and "NFC" in norm:
            self.kind = "word"
        self.letters = dict(enumerate(_byte_letters()))
        self.space, self.tokenize = self.letters[32], self.tokenizer.model.tokenize

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _part(self, part: str) -> bytes:
        if part == _MARK:
            return b""
        # as the vocabulary writes bytes; printable ASCII stands for itself
        shown = part.replace(" ", self.space) if part.isascii() and "\n" not in part else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def _looked_up(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the parts of a text, and how many there are before each mark."""
        coded = pa.array(_WORD_PARTS.findall(text.lower()) if self.kind == "word" else _BYTE_PARTS.findall(text), pa.large_string()).dictionary_encode()
        which, different = coded.indices.to_numpy(), _strings(coded.dictionary)
        found = self.parts.of(different)
        ids, ends = _laid_out(np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) >> 2, which)
        return ids, ends[which == different.index(_MARK)] if _MARK in different else ends[:0]

    def _group(self, texts: pa.Array) -> list[np.ndarray]:
        """Words between spaces are told apart first, then the parts of different words, then ids are laid out in the texts' order."""
        out: list = [None] * len(texts)
        apart = ~pc.match_substring_regex(texts, _PLAIN if self.kind == "word" else _EVEN).to_numpy(zero_copy_only=False)
        special = pc.match_substring(texts, _SPECIAL).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(apart | special).tolist():
            one = texts.slice(i, 1)
            plain = not special[i] and pc.match_substring_regex(one, _PLAIN)[0].as_py()
            out[i] = self._looked_up(one[0].as_py())[0] if plain else self._library(one[0].as_py())
        same = np.flatnonzero(~apart & ~special)
        if not len(same):
            return out
        split = pc.split_pattern(texts.take(pa.array(same)), " ")
        values = split.flatten()
        coded = values.dictionary_encode()
        stops, which, words = split.offsets.to_numpy() - split.offsets[0].as_py(), coded.indices.to_numpy(), _strings(coded.dictionary)
        if self.kind == "byte":  # a text's first word has no space before it
            firsts = _strings(values.take(pa.array(stops[:-1])))
            joined = " " + f"{_MARK} ".join(words) + _MARK + _MARK.join(firsts) + _MARK
            which = which.copy()
            which[stops[:-1]] = len(words) + np.arange(len(firsts))
        else:
            joined = _MARK.join(words) + _MARK
        ids, ends = self._looked_up(joined)
        ids, ends = _laid_out(ids, np.diff(ends, prepend=0), which)
        cuts = np.concatenate([[0], ends])[stops]
        for i, a, b in zip(same.tolist(), cuts[:-1], cuts[1:], strict=True):
            out[i] = ids[a:b]
        return out

    def ids(self, text: str) -> np.ndarray:
        return next(self.raw(pa.array([text])))

    def raw(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column, as little-endian unsigned 32-bit integers; a null is an empty text."""
        texts = texts.fill_null("").cast(pa.large_string())
        if self.kind == "whole":
            yield from (self._library(x) for x in texts.to_pylist())
            return
        total, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
        while at < len(texts):
            before = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, before + GROUP, "right")))
            if total[at] - before > GROUP:
                yield np.concatenate([self._group(pa.array([x], pa.large_string()))[0] for x in _pieces(texts[at].as_py())])
            else:
                yield from self._group(texts.slice(at, stop - at))
            at = stop


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker; the vocabulary file must lie at the same place on every executor."""
    return Encoder(path)
