"""Whole-text token ids from the public tokenizer files, at corpus speed.

The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``.  Both tokenizer families split a text
into pre-tokens and merge only inside them, and a white-space boundary always ends a pre-token.  So a text can be
cut there, the ids of a repeated piece looked up, and only unseen pieces handed to the library, many at a time.

``ByteLevelIds`` cuts before a single space that precedes a non-space (elsewhere the whole text goes to the
library).  ``WordIds`` cuts at white space.  Each holds a cache of bounded size: when it is full, new pieces are
still encoded, only no longer kept.
"""

from __future__ import annotations

import os
import re
import numpy as np

CACHE_PIECES = 700_000
BLOCK_PIECES = 2_000


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; a path with a slash is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task a core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _PieceIds:
    """Ids of texts as bytes of ``dtype``; subclasses cut texts and encode unseen pieces."""

    def __init__(self, path: str, dtype=np.uint16):
        self.tokenizer = load(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if self.size > np.iinfo(dtype).max + 1:
            raise ValueError(f"{self.size} ids don't fit in {np.dtype(dtype)}")
        self.dtype = np.dtype(dtype)
        #: pieces that are kept
        self.limit = CACHE_PIECES
        self.cache: dict[str, bytes] = {}

    def forget(self) -> None:
        self.cache = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Straight from the library."""
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _resolve(self, lists: list[list[str]]) -> list[bytes]:
        """Joined ids of each list of pieces."""
        found = [list(map(self.cache.get, pieces)) for pieces in lists]
        unseen = [[p for p, g in zip(pieces, got) if g is None] if None in got else () for pieces, got in zip(lists, found)]
        new = list(set().union(*unseen))
        fresh = dict(zip(new, self._encode(new))) if new else {}
        out = []
        for got, pieces in zip(found, unseen):
            if pieces:
                more = map(fresh.__getitem__, pieces)
                got = [next(more) if g is None else g for g in got]
            out.append(b"".join(got))
        if len(self.cache) < self.limit:
            self.cache.update(fresh)
        return out


class ByteLevelIds(_PieceIds):
    """For byte-level vocabularies whose pattern lets a space lead the following pre-token."""

    _ODD = re.compile(r" (?!\S)")

    def __init__(self, path: str, dtype=np.uint16):
        super().__init__(path, dtype)
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        #: bytes of text that an id stands for: byte-level tokens have a character for each byte
        self.lengths = np.array([len(added[i].encode()) if i in added else len(self.tokenizer.id_to_token(i) or "") for i in range(self.size)], np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [bool(self._ODD.search(t)) for t in texts]
        rest, firsts, lists = [], [], []
        for t, o in zip(texts, odd):
            if o:
                rest.append(t)
            else:
                pieces = t.split(" ")
                firsts.append(pieces[0])
                lists.append(pieces[1:])
        plain = map(bytes.__add__, self._whole(firsts), self._resolve(lists))
        whole = iter(self._whole(rest))
        return [next(whole) if o else next(plain) for o in odd]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(pieces), BLOCK_PIECES):
            block = pieces[i : i + BLOCK_PIECES]
            raw = self._whole([" " + " ".join(block)])[0]
            ends = np.cumsum(self.lengths[np.frombuffer(raw, self.dtype)])
            want = np.cumsum([len(p.encode()) + 1 for p in block])
            at = np.searchsorted(ends, want) + 1
            if len(ends) == 0 or not np.array_equal(ends[np.minimum(at, len(ends)) - 1], want):
                out += self._whole([" " + p for p in block])
                continue
            cuts = [0, *(at * self.dtype.itemsize).tolist()]
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return out


class WordIds(_PieceIds):
    """For vocabularies with word ends that drop white space."""

    _ODD = re.compile("[\x1c-\x1f]")
    _SIMPLE = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-^`{-~]*)")  # letters, then ASCII punctuation but ' and _

    def __init__(self, path: str, dtype=np.uint16):
        super().__init__(path, dtype)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.size)])
        self.tails: dict[str, bytes] = {"": b""}

    def forget(self) -> None:
        super().forget()
        self.tails = {"": b""}

    def encode(self, texts: list[str]) -> list[bytes]:
        # the tokenizer lowers letters after it has looked for its special tokens, so A to Z can be lowered before
        texts = [t if "<|" in t else t.encode().lower().decode() for t in texts]
        # U+001C to U+001F part words for Python only
        odd = [bool(self._ODD.search(t)) for t in texts]
        plain = iter(self._resolve([t.split() for t, o in zip(texts, odd) if not o]))
        whole = iter(self._whole([t for t, o in zip(texts, odd) if o]))
        return [next(whole) if o else next(plain) for o in odd]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        split: list[tuple[str, str] | None] = []
        for p in pieces:
            core, tail = (p[:-1], p[-1]) if p[-1] in ".," else (p, "")
            if not core.isalpha():
                m = self._SIMPLE.fullmatch(p)
                core, tail = m.groups() if m else ("", "")
            # up to U+024F, but for one, letters stay single letters under NFC and lower-casing
            plain = core.isascii() and core.isalpha() or core.isalpha() and max(core) < "\u0250" and "\u0130" not in core
            split.append((core, tail) if plain else None)
        cores = list({s[0] for s in split if s and s[0] not in self.cache})
        known: dict[str, bytes] = {}
        for i in range(0, len(cores), BLOCK_PIECES):
            block = cores[i : i + BLOCK_PIECES]
            raw = self._whole([" ".join(block)])[0]
            at = np.flatnonzero(self.ends[np.frombuffer(raw, self.dtype)]) + 1
            if len(at) != len(block):
                known |= zip(block, self._whole(block))
                continue
            cuts = [0, *(at * self.dtype.itemsize).tolist()]
            known |= zip(block, (raw[a:b] for a, b in zip(cuts, cuts[1:])))
        if unseen := list({s[1] for s in split if s} - self.tails.keys()):
            if len(self.tails) > CACHE_PIECES:
                self.tails = {"": b""}
                unseen = list({s[1] for s in split if s} - self.tails.keys())
            self.tails |= zip(unseen, self._whole(unseen))
        odd = iter(self._whole([p for p, s in zip(pieces, split) if not s]))
        return [(known.get(s[0]) or self.cache[s[0]]) + self.tails[s[1]] if s else next(odd) for s in split]


_ENCODERS: dict[tuple, _PieceIds] = {}


def encoder(kind: str, path: str, dtype="uint16", pieces: int = CACHE_PIECES) -> _PieceIds:
    """One of each per Python worker; kind: byte or word; pieces: how many it keeps, which changes time and memory only."""
    key = (kind, path, str(dtype))
    if key not in _ENCODERS:
        _ENCODERS[key] = {"byte": ByteLevelIds, "word": WordIds}[kind](path, np.dtype(dtype))
    _ENCODERS[key].limit = pieces
    return _ENCODERS[key]


def forget() -> None:
    """Drops the pieces that this worker's encoders have kept; the encoders stay."""
    for e in _ENCODERS.values():
        e.forget()
