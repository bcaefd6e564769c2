"""Token ids of many texts with one of the public tokenizers.

A tokenizer splits a text before it merges anything, and no split of the two
supported kinds crosses a lone space between two non-spaces.  So a text is cut
there, each distinct piece is encoded once, and its ids are kept in a bounded
table per Python worker; ids of a text are the ids of its pieces in order.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept per worker (some 350 MB); past this only the shorter half stays, as short words recur.
MAX_PIECES = 1_600_000
#: Texts that are encoded whole: empty, or with white space beside a space or at an end, or a seldom kind of it.
_WHOLE = "^$|^\\s|\\s$| \\s|\\s |[\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Stands between new pieces while they are encoded together.
_MARK = "\x01"


def strings(column: pa.Array) -> list[str]:
    """The strings of a column without nulls; by way of NumPy this takes an eighth of the time of ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Encodes texts; ``ids(texts)`` gives one uint32 array a text."""

    def __init__(self, path: str, most_pieces: int):
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        #: Literals of added tokens are single ids, as the library reads them by default.  Texts that hold
        #: how all of them begin (in any case, as a letter may count in both) are encoded whole.
        added = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        self._added = re.match(r"[^\w\s]*", os.path.commonprefix(added)).group()
        if added and not self._added:
            raise ValueError(f"added tokens {added} do not begin with one sign")
        one = lambda t: self._whole([t])[0]
        #: Whether case does not matter; pieces are kept in lower case then.
        self._any_case = one("Ab CD") == one("ab cd")
        self._mark = one(" " + _MARK)
        self._ends = {c: np.asarray(one(c), dtype="<u4").tobytes() for c in ".,;:!?" if one("ab" + c) == one("ab") + one(c)}
        self._kept: dict[str, bytes] = {}
        self._most = most_pieces
        self.size = self._tok.get_vocab_size()

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces together, a mark after each, and cut the ids at the marks."""
        kept, together, first, ended = self._kept, [], [], []
        for p in pieces:
            if p[0] == _MARK:
                first.append(p)
                continue
            if p[-1] in self._ends and p[-2:-1].isalpha():  # a letter, then one mark: two splits
                ended.append(p)
                p = p[:-1]
                if p in kept:
                    continue
            together.append(p)
        together = list(dict.fromkeys(together))
        for p, ids in zip(first, self._whole([p[1:] for p in first]) if first else ()):
            kept[p] = np.asarray(ids, dtype="<u4").tobytes()
        width, glue = len(self._mark), f" {_MARK} "
        for i in range(0, len(together), 1000):
            part = together[i : i + 1000]
            text = glue + glue.join(part) + glue  # each piece has its space before it
            ids = np.asarray(self._whole([text.rstrip(" ")])[0], dtype="<u4")
            ends = np.flatnonzero(ids == self._mark[-1]) + 1
            if len(ends) != len(part) + 1:
                raise ValueError("this tokenizer merges across spaces")
            raw, start = ids.tobytes(), int(ends[0])
            for p, end in zip(part, ends[1:].tolist()):
                kept[p] = raw[4 * start : 4 * (end - width)]
                start = end
        for p in ended:
            kept[p] = kept[p[:-1]] + self._ends[p[-1]]

    def _ids_of_pieces(self, pieces: list[str]) -> list[bytes]:
        kept = self._kept
        if len(kept) > self._most:
            longest = int(np.median([len(p) for p in kept]))
            short = {p: ids for p, ids in kept.items() if len(p) < longest}
            kept.clear()
            kept.update(short)
        found = list(map(kept.get, pieces))
        if new := [p for p, ids in zip(pieces, found) if ids is None]:
            self._learn(new)
            found = list(map(kept.__getitem__, pieces))
        return found

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null is the empty text.

        Splitting and finding the distinct pieces are done on the Arrow column;
        the ids of all texts are one gather from the ids of distinct pieces.
        """
        texts = pc.fill_null(texts, "")
        whole = pc.or_(pc.match_substring_regex(texts, _WHOLE), pc.match_substring(texts, _MARK))
        if self._added:
            whole = pc.or_(whole, pc.match_substring(texts, self._added))
        if self._any_case:  # a mark could join a lower-case letter that it does not join in upper case
            whole = pc.or_(whole, pc.match_substring_regex(texts, "[\\x{300}-\\x{36f}]"))
        out: list = [None] * len(texts)
        for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
            out[k] = np.asarray(self._whole([texts[int(k)].as_py()])[0], dtype="<u4")
        at = np.flatnonzero(~whole.to_numpy(zero_copy_only=False))
        if not len(at):
            return out
        # a piece stands for itself after a space; the first, which has none, is marked
        plain = texts.filter(pc.invert(whole))
        split = pc.split_pattern(pc.binary_join_element_wise(_MARK, pc.ascii_lower(plain) if self._any_case else plain, ""), " ")
        coded = split.flatten().dictionary_encode()
        pieces = self._ids_of_pieces(strings(coded.dictionary))
        sizes = np.fromiter(map(len, pieces), dtype=np.int32, count=len(pieces)) // 4
        index = coded.indices.to_numpy()
        each = sizes[index]
        ends = np.cumsum(each, dtype=np.int32)
        where = np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[index] - (ends - each), each)
        where += np.arange(len(where), dtype=np.int32)
        flat = np.frombuffer(b"".join(pieces), dtype="<u4")[where]
        cuts = ends[np.cumsum(pc.list_value_length(split).to_numpy()) - 1]
        for k, start, end in zip(at, np.concatenate([[0], cuts[:-1]]), cuts):
            out[k] = flat[start:end]
        return out


@lru_cache(maxsize=2)
def encoder(path: str, most_pieces: int = MAX_PIECES) -> Encoder:
    """The worker's own encoder for a vocabulary file, loaded once."""
    return Encoder(path, most_pieces)


def batches(texts: pa.Array, size: int = 4_000_000):
    """Index ranges of about so many bytes, so that memory stays bounded."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield start, end
        start = end
