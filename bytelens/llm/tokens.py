"""Encoding whole texts with a public tokenizer at the cost of their distinct words.

A byte-pair encoder first cuts a text where white space begins; nothing it does crosses such a cut. So the texts
of a batch are cut there, each distinct piece is encoded by the tokenizers library once, and the ids are
put together again. The ids equal those of encoding each text as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space in any of the senses that the tokenizers know, as a character class.
_SPACE = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = f" {_SPACE}|{_SPACE} "
_BLUR = f"^$|^{_SPACE}|{_SPACE}$| |\0"
_CUT = re.compile(r"(?<=\S) (?=\S)")


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` in sum; a longer row stands alone."""
    a, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(lengths):
        yield a, len(lengths)


class _Table:
    """Pieces and their ids, one after another; how many batches have asked for each."""

    def __init__(self) -> None:
        self.pieces = pa.array([], pa.string())
        self.flat, self.start, self.asked = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    @property
    def nbytes(self) -> int:
        return self.pieces.nbytes + self.flat.nbytes + self.start.nbytes + self.asked.nbytes

    def find(self, pieces: pa.Array) -> np.ndarray:
        """The place of each piece, -1 for one that isn't there."""
        if not len(self.pieces):
            return np.full(len(pieces), -1, np.int64)
        return pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy().astype(np.int64)

    def add(self, pieces: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.flat = np.concatenate([self.flat, ids])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])
        self.asked = np.concatenate([self.asked, np.ones(len(pieces), np.int32)])

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces at these places, and how many each has."""
        lens = self.start[at + 1] - self.start[at]
        ends = np.cumsum(lens)
        return self.flat[np.repeat(self.start[at] - (ends - lens), lens) + np.arange(int(lens.sum()))], lens

    def thin(self) -> None:
        """Forget what one batch alone has asked for, or all if that is most of it."""
        keep = np.flatnonzero(self.asked > 1)
        if len(keep) > 0.7 * len(self.asked):
            keep = keep[:0]
        pieces, (ids, counts) = self.pieces.take(pa.array(keep)), self.take(keep)
        self.__init__()
        self.add(pieces, ids, counts)


class Encoder:
    """encode(texts) -> (ids, offsets) of whole texts, null as empty.

    The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``, so a text that holds the string of a
    special token gets its id there; such a text is encoded whole. Encoded pieces stay in memory up to about
    ``keep_bytes``. A piece that begins a text and one that stands inside are kept apart, so what was seen before never
    changes an id.
    """

    def __init__(self, path: str, *, drops_space: bool, keep_bytes: int = 20_000_000, batch_bytes: int = 3_000_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        suffix, vocabulary = self.tok.model.end_of_word_suffix or "", self.tok.get_vocab(with_added_tokens=False)
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():  # a byte-level vocabulary has a character for each byte
            self.token_bytes[k] = len(token.removesuffix(suffix))
        self.drops_space, self.keep_bytes, self.batch_bytes = drops_space, keep_bytes, batch_bytes
        self.inner, self.heads = _Table(), _Table()  # pieces after a space, and at the beginning of a text
        self.marks = {m: np.uint32(self.tok.encode(m, add_special_tokens=False).ids[0]) for m in ".,"}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        out, ends = [], [np.zeros(1, np.int64)]
        lengths = np.maximum(pc.binary_length(texts).to_numpy(zero_copy_only=False), 1)
        for a, b in slices(lengths, self.batch_bytes):
            ids, n = self._some(texts.slice(a, b - a))
            out.append(ids)
            ends.append(n)
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), np.cumsum(np.concatenate(ends))

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s, ignore_case=True).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._cut(texts)
        ids, lens = self._cut(pc.if_else(pa.array(whole), "", texts))
        own = np.split(ids, np.cumsum(lens)[:-1])
        for k in np.flatnonzero(whole).tolist():
            own[k] = np.array(self.tok.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(own), np.array([len(x) for x in own], np.int64)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.string())
        if self.drops_space:
            texts = pc.ascii_lower(pc.replace_substring_regex(texts, "[\n\t\r]", " "))
            odd = np.zeros(len(texts), bool)
        else:
            odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        if odd.any():  # a space beside other white space is not a cut
            cut = pa.array([_CUT.split(t) if o else t.split(" ") for t, o in zip(texts.to_pylist(), odd, strict=True)], pa.list_(pa.string()))
        else:
            cut = pc.split_pattern(texts, " ")
        flat = cut.flatten()
        first = np.asarray(cut.offsets)[:-1] - cut.offsets[0].as_py()
        if self.drops_space:
            ids, lens = self._ids(self.inner, flat)
        else:  # the first piece of a text has no space before it
            follows = np.ones(len(flat), bool)
            follows[first] = False
            lens = np.zeros(len(flat), np.int64)
            inner, lens[follows] = self._ids(self.inner, flat.filter(pa.array(follows)))
            heads, lens[first] = self._ids(self.heads, flat.take(pa.array(first)))
            ids = np.empty(len(inner) + len(heads), np.uint32)
            from_head = np.repeat(~follows, lens)
            ids[~from_head], ids[from_head] = inner, heads
        return ids, (np.add.reduceat(lens, first) if len(first) else np.zeros(0, np.int64))

    def _ids(self, table: _Table, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after another, and how many each has."""
        words = pieces.dictionary_encode()
        names, codes = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
        at = table.find(names)
        unknown = np.flatnonzero(at < 0)
        table.asked[at[at >= 0]] += 1
        if len(unknown):
            new = names.take(pa.array(unknown))
            at[unknown] = len(table.pieces) + np.arange(len(unknown))
            table.add(new, *(self._alone(new.to_pylist()) if table is self.heads else self._inner(new)))
        out = table.take(at[codes])
        if table.nbytes > self.keep_bytes:
            table.thin()
        return out

    def _inner(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new inner pieces and how many each has, by the cheapest way for each kind."""
        parts = []
        # A letter's piece and one full stop or comma, which is a token of its own.
        ended = np.flatnonzero(pc.match_substring_regex(new, "[A-Za-z][.,]$").to_numpy(zero_copy_only=False))
        base = self.inner.find(pc.utf8_slice_codeunits(new.take(pa.array(ended)), 0, -1))
        ended, base = ended[base >= 0], base[base >= 0]
        ids, lens = self.inner.take(base)
        dot = pc.ends_with(new.take(pa.array(ended)), ".").to_numpy(zero_copy_only=False)
        parts.append((ended, np.insert(ids, np.cumsum(lens), np.where(dot, self.marks["."], self.marks[","])), lens + 1))
        # White space at the ends, and what a normalizer changes, can't be told apart in a joined text.
        blur = pc.match_substring_regex(new, _BLUR).to_numpy(zero_copy_only=False).copy()
        if self.drops_space:
            for i in np.flatnonzero(~pc.string_is_ascii(new).to_numpy(zero_copy_only=False)).tolist():
                x = new[i].as_py()
                blur[i] |= x != normalize("NFC", x.lower())
        blur[ended] = False
        odd = np.flatnonzero(blur)
        said = ["" if self.drops_space and not x else " " + x for x in new.take(pa.array(odd)).to_pylist()]
        parts.append((odd, *self._alone(said)))
        plain = np.ones(len(new), bool)
        plain[ended] = plain[odd] = False
        plain = np.flatnonzero(plain)
        for a in range(0, len(plain), 20_000):
            own = plain[a : a + 20_000]
            parts.append((own, *self._joined(new.take(pa.array(own)))))
        counts = np.zeros(len(new), np.int64)
        for at, _, n in parts:
            counts[at] = n
        start = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        for at, ids, n in parts:
            out[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, counts

    def _alone(self, said: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.tok.encode_batch_fast(said, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def _joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Encode inner pieces in one call: joined by spaces, which is how each follows another in a text.

        Every token stands for so many bytes, so running sums say which piece each belongs to.
        """
        words = pieces.to_pylist()
        ids = np.array(self.tok.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64) + (0 if self.drops_space else 1))
        stop = np.cumsum(self.token_bytes[ids])
        if len(ids) and stop[-1] != ends[-1]:  # a normalizer has changed the bytes
            return self._alone([" " + x for x in words])
        return ids, np.bincount(np.searchsorted(ends, stop - self.token_bytes[ids], "right"), minlength=len(words))


_held: dict[tuple, Encoder] = {}


def encoder(path: str, *, drops_space: bool) -> Encoder:
    """One for each worker process, so that later tasks find the pieces of earlier ones."""
    key = (path, drops_space)
    if key not in _held:
        _held[key] = Encoder(path, drops_space=drops_space)
    return _held[key]

