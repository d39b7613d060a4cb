"""Whole-text encoding with the tokenizers library, one library call for each distinct piece of text.

A text is cut where both pre-tokenizers used here always end a pre-token without looking at what stands
before: at the start of white space, after Latin letters that an ASCII sign or digit follows, and after
ASCII signs other than the apostrophe (it begins contractions) that a Latin letter follows. So a text's ids
are those of its pieces, joined. Pieces keep the white space before them where the pre-tokenizer does.
Pieces repeat, so their ids are kept in a dict, of which the pieces that came last, the rarer ones, are dropped
when it is full. Texts with a marker of an added token, and files of any other kind of pre-tokenizer, go to the library
whole. Strings of special tokens that a text spells are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from itertools import chain, islice

import numpy as np

from .shared import own

#: Unicode's White_Space property; Latin letters of every version of Unicode that stay letters in lower case; ASCII signs and digits, then those without the apostrophe (fixed values).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LATIN = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u012f\\u0131-\\u024f"
SIGNS, PLAIN_SIGNS = "!-@\\[-`{-~", "!-&(-@\\[-`{-~"
WORDS = f"(?:[{LATIN}]+(?=[{SIGNS}{WHITE}]|\\Z)|[{PLAIN_SIGNS}]+(?=[{LATIN}{WHITE}]|\\Z)|[^{WHITE}]+)"
PIECES = {"kept": re.compile(f"[{WHITE}]*{WORDS}|[{WHITE}]+"), "dropped": re.compile(WORDS)}
#: White space to some versions of Unicode only.
ODD = "\u180e"
#: Of a full dict, the share of pieces that came first, and so are the more frequent ones, stays.
EARLY = 0.85


def white_space_of(spec: dict) -> str | None:
    """'kept' or 'dropped' if texts of this tokenizer file can be cut into pieces; else None."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "kept"
    parts = pre.get("pretokenizers", [])
    kinds = [x.get("type") for x in (norm or {}).get("normalizers", [])]
    if [x.get("type") for x in parts] == ["Split", "ByteLevel"] and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space") and set(kinds) <= {"NFC", "Replace", "Lowercase"}:
        return "dropped"
    return None


class _Known(dict):
    """Piece to ids. A piece that is asked for in vain gets an empty bytearray, filled when its ids are known."""

    def __init__(self):
        super().__init__()
        self.missing: dict[str, bytearray] = {}

    def __missing__(self, piece: str) -> bytearray:
        return self.missing.setdefault(piece, bytearray())


class Encoder:
    """encode() gives each text's ids as little-endian unsigned 32-bit integers; a null is an empty text."""

    def __init__(self, path: str, most: int = 700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pieces = PIECES.get(white_space_of(spec))
        self.markers = [x["content"] for x in spec.get("added_tokens", [])] + [ODD]
        self.most, self.known = most, _Known()

    def whole(self, text: str) -> bytes:
        """The ids of a text by one call of the library."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self) -> None:
        waiting = self.known.missing
        new = list(waiting)
        if len(self.known) + len(new) > self.most:
            early = dict(islice(self.known.items(), int(self.most * EARLY)))
            self.known.clear()
            self.known.update(early)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            made = self.library.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(made.ids, "<u4").tobytes()
            ends = (4 * np.searchsorted(np.array(made.word_ids, np.int64), np.arange(len(part)), "right")).tolist()
            for piece, a, b in zip(part, chain([0], ends), ends, strict=False):
                self.known[piece] = own = ids[a:b]
                waiting[piece].extend(own)
        waiting.clear()

    def encode(self, texts: Sequence[str | None], at_once: int = 64) -> list[bytes]:
        out: list[bytes] = []
        find, get = self.pieces and self.pieces.findall, self.known.__getitem__
        for i in range(0, len(texts), at_once):
            cut = [[] if not x else [self.whole(x)] if find is None or any(m in x for m in self.markers) else list(map(get, find(x))) for x in texts[i : i + at_once]]
            if self.known.missing:
                self._learn()
            out.extend(map(b"".join, cut))
        return out


_open: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This Python worker's encoder of a tokenizer file; its dict of pieces outlives the task."""
    own("encoding", _open.clear)
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]
