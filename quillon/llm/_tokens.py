"""Token ids of many texts by the tokenizers library, with its work shared between equal chunks.

A text is cut at single spaces and newlines between other characters. No
pre-token of the supported vocabularies reaches across such a place, so a text's
ids are those of its chunks in a row. Each distinct chunk is encoded by the
library once per worker (the memory held is bounded) and many chunks go in one
call, kept apart by a control character whose id never merges with others. A text
that holds the string of an added token (an end mark, say) is encoded whole, as
the library finds such strings before anything else.
"""

from __future__ import annotations

import os

import numpy as np

_MARK = "\x01"
_HELD = 1_200_000
_SHARED: dict[tuple[str, bool], "ChunkEncoder"] = {}


def vocabulary_size(path: str) -> int:
    return _tokenizer(path).get_vocab_size(with_added_tokens=True)


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    ``spaced``: the vocabulary joins a space to the word after it (byte-level
    BPE); otherwise white space is dropped.
    """

    def __init__(self, path: str, spaced: bool):
        self.tokenizer, self.spaced = _tokenizer(path), spaced
        self.known: dict[str, bytes] = {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if not t.normalized]
        self.folded = [t.content.lower() for t in added if t.normalized]  # these are found in normalized texts
        mark = self._plain(f"a {_MARK}" if spaced else f"a {_MARK} a")
        self.lead = 2 if spaced else 1  # ids of the mark, with the space before it
        one = self._plain("a")
        self.mark = int(mark[-1] if spaced else mark[len(one)])

    @classmethod
    def shared(cls, path: str, spaced: bool) -> ChunkEncoder:
        """One per Python worker."""
        if (path, spaced) not in _SHARED:
            _SHARED[path, spaced] = cls(path, spaced)
        return _SHARED[path, spaced]

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, keys: list[str]) -> None:
        """Adds the ids of chunks, which hold no mark, by calls of the library on many at once."""
        between = f" {_MARK}" if self.spaced else f" {_MARK} "
        as_text = (lambda k: k[1:] if k[0] == "\x00" else k if k[0] == "\n" else " " + k) if self.spaced else (lambda k: k)
        groups = [keys[at : at + 48] for at in range(0, len(keys), 48)]
        for at in range(0, len(groups), 64):
            some = groups[at : at + 64]
            coded = self.tokenizer.encode_batch_fast([between.join([*map(as_text, g), ""]) for g in some], add_special_tokens=False)
            for group, one in zip(some, coded):
                ids = np.array(one.ids, "<u4")
                ends = np.flatnonzero(ids == self.mark).tolist()
                if len(ends) != len(group):
                    raise ValueError("the vocabulary merges the mark between chunks")
                raw, start = ids.tobytes(), 0
                for key, end in zip(group, ends):
                    self.known[key] = raw[4 * start : 4 * (end - self.lead + 1)]
                    start = end + 1

    def _chunks(self, text: str) -> list[str] | None:
        """A text's chunks as keys of ``known``, or None if it must be encoded whole."""
        if _MARK in text or any(a in text for a in self.added) or (self.folded and any(a in text.lower() for a in self.folded)):
            return None
        if not self.spaced:
            return text.replace("\n", " ").split(" ")  # empty ones have no ids
        chunks = text.replace("\n", " \n").split(" ")
        if "" in chunks or "\n" in chunks or "\x00" in text:
            return None  # white space in a row or at an end
        chunks[0] = "\x00" + chunks[0]
        return chunks

    def _edge(self, key: str) -> bool:
        """Whether a chunk begins or ends with other white space, which may join the space beside it."""
        return self.spaced and (key[-1].isspace() or key[key[0] in "\x00\n"].isspace())

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > _HELD:
            self.known.clear()
        known = self.known
        known[""] = b""
        split = [self._chunks(text) for text in texts]
        fresh = {c for chunks in split if chunks is not None for c in chunks if c not in known}
        if fresh:
            self._learn([c for c in fresh if not self._edge(c)])
        out = []
        for text, chunks in zip(texts, split):
            try:
                out.append(self._plain(text).tobytes() if chunks is None else b"".join(map(known.__getitem__, chunks)))
            except KeyError:  # an edge chunk
                out.append(self._plain(text).tobytes())
        return out
