"""Token ids of many texts with a public tokenizer, each distinct piece of text encoded once for a worker.

The tokenizers library does the merging. Two facts make most of its work unnecessary:

* Both vocabularies' splitting rules always cut before a single space that stands between
  characters which aren't white space, so a text's ids are those of its pieces between such
  spaces, one after the other. Pieces repeat: their ids are kept in a table by 64-bit hash,
  in which a whole slice of texts is looked up at once.
* In a piece of plain letters, digits, punctuation and line feeds the splitting rule can be
  applied here, and only the merging is left to the library's model. Any other piece goes
  through the whole tokenizer, and so does one that holds an added token's string
  (``<|endoftext|>``): the library gives that token's id. These strings have no space, so no
  cut falls inside one.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain

import numpy as np

from ringfold.llm.text import ranges, word_hashes

#: Pieces whose ids a worker keeps, about 80 bytes each; when more come, it starts anew.
KEPT_PIECES = 1_000_000
#: Parts of pieces whose merged ids are kept meanwhile, about 250 bytes each.
KEPT_PARTS = 60_000
#: Bytes of text that are encoded at once.
AT_ONCE = 1 << 20

# Letters that are surely letters to any version of Unicode, and the splitting rules over them.
_LETTER, _DIGIT = "A-Za-zÀ-ÖØ-öø-ÿ", "0-9"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPLITS = {
    "byte_bpe_50k.json": re.compile(rf"{_ENDINGS}| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^ \n{_LETTER}{_DIGIT}]+|[ \n]+(?![^ \n])|[ \n]+"),
    "word_bpe_49k.json": re.compile(rf"{_ENDINGS}|[{_LETTER}]+|[{_DIGIT}]|[^ \n{_LETTER}{_DIGIT}]+"),
}
_PLAIN = re.compile(r"[\n -~À-ÿ]*").fullmatch

# Bytes beside which a space may be cut: visible ASCII, and letters U+00C0 to U+07FF in two bytes; none of them is white space.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in these vocabularies: visible Latin-1 characters for themselves, the rest from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def pieces(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pieces of all texts, and how many each text has. Pieces leave nothing out."""
    cut = np.zeros(len(buf) + 1, bool)
    if len(buf) > 2:
        before = _VISIBLE[buf[:-1]]
        before[1:] |= _LEAD[buf[:-2]] & (buf[1:-1] >> 6 == 2)
        after = _VISIBLE[buf] | _LEAD[buf]
        cut[1:-2] = (buf[1:-1] == 32) & before[:-1] & after[2:]
    cut[off] = True
    cut[-1] = False
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], len(buf)), np.diff(np.searchsorted(start, off))


class Encoder:
    """Ids of texts, as one flat array and a length for each text.

    With ``added``, as the operators have it, ids are those of the library's default call with
    add_special_tokens=False; without, an added token's string is text like any other.
    """

    def __init__(self, name: str, kept: int = KEPT_PIECES, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(name))
        self.whole.encode_special_tokens = not added
        self.added = tuple(t.content for t in self.whole.get_added_tokens_decoder().values()) if added else ()
        # merged parts are kept here, so the library keeps none
        self.model = self.whole.model
        self.model._resize_cache(0)
        self.lower = name.startswith("word")
        self.split, self.kept, self.letters = _SPLITS[name].findall, kept, _byte_letters()
        self.slots = 1 << max(10, (2 * kept - 1).bit_length())
        self._reset()

    def _reset(self) -> None:
        self.merged: dict[str, array[int]] = {}
        self.known, self.place = np.zeros(self.slots, np.uint64), np.full(self.slots, -1, np.int32)
        self.flat, self.used, self.n = np.zeros(1 << 20, np.uint32), 0, 0
        self.starts, self.counts = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32)

    def _ids(self, piece: str) -> list[int]:
        if not _PLAIN(piece) or any(t in piece for t in self.added):
            return self.whole.encode(piece, add_special_tokens=False).ids
        ids: list[int] = []
        for part in self.split(piece.lower() if self.lower else piece):
            known = self.merged.get(part)
            if known is None:
                spelled = part.encode().decode("latin-1").translate(self.letters)
                known = array("I", [t.id for t in self.model.tokenize(spelled)])
                if len(self.merged) >= KEPT_PARTS:
                    self.merged.clear()
                self.merged[part] = known
            ids += known
        return ids

    def _add(self, found: list[list[int]]) -> np.ndarray:
        """Keeps the ids of new pieces; their places."""
        counts = np.fromiter(map(len, found), np.int32, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
        n, used = self.n + len(found), self.used + len(ids)
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n > len(self.starts):
            self.starts, self.counts = np.concatenate([self.starts, self.starts * 0]), np.concatenate([self.counts, self.counts * 0])
        self.flat[self.used : used] = ids
        self.counts[self.n : n] = counts
        self.starts[self.n : n] = self.used + np.cumsum(counts, dtype=np.int64) - counts
        places = np.arange(self.n, n, dtype=np.int32)
        self.n, self.used = n, used
        return places

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each piece, -1 if unknown. Each hash has two slots."""
        found = np.full(len(hashes), -1, np.int32)
        for slot in self._slots(hashes):
            found = np.where(self.known[slot] == hashes, self.place[slot], found)
        return found

    def _slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.uint64(self.slots - 1)
        return (hashes & low).astype(np.int64), (hashes >> np.uint64(32) & low).astype(np.int64)

    def encode_all(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same as ``encode``, about ``AT_ONCE`` bytes of text (one text at least) after the other."""
        ids, counts, at = [], [], 0
        while at < len(off) - 1:
            to = max(at + 1, int(np.searchsorted(off, off[at] + AT_ONCE, "right")) - 1)
            mine, n = self.encode(buf[off[at] : off[to]], off[at : to + 1] - off[at])
            ids.append(mine)
            counts.append(n)
            at = to
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids as uint32, and how many belong to each text; the texts are UTF-8 between the offsets."""
        start, end, per_text = pieces(buf, off)
        hashes = word_hashes(buf, start, end)
        at = self._find(hashes)
        if (new := np.flatnonzero(at < 0)).size:
            fresh, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            if self.n + len(fresh) > self.kept and self.n:
                self._reset()
                return self.encode(buf, off)
            raw, at_new = buf.tobytes(), new[first]
            places = self._add([self._ids(raw[a:b].decode("utf-8", "replace")) for a, b in zip(start[at_new].tolist(), end[at_new].tolist(), strict=True)])
            at[new] = places[back]
            one, two = self._slots(fresh)
            slot = np.where((self.place[one] < 0) | (self.place[two] >= 0), one, two)
            self.known[slot], self.place[slot] = fresh, places
        counts = self.counts[at].astype(np.int64)
        ids = self.flat[ranges(self.starts[at], counts)]
        upto, ends = np.concatenate([[0], np.cumsum(counts)]), np.cumsum(per_text)
        return ids, upto[ends] - upto[ends - per_text]


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The worker's encoder of that vocabulary, made once."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name, added=True)
    return _ENCODERS[name]
