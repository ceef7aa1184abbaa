"""Exact, cached sub-word encoding shared by the token writer and the packer.

The vocabulary's own rule cuts a lower-cased text into pieces that are encoded
each by itself, and white space is dropped.  So a text may be cut by that rule
in bulk, and the ids of a piece, which the tokenizer's model gives, may be remembered.
That holds for the characters in ``_PLAIN`` (white space there is white space
for the tokenizer too, nothing there is re-composed, and letters, digits and signs are
the same for both); any other text, any text that could hold a special token, and
every text under a vocabulary file with other rules is encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Remembered pieces per worker; when full, the memory starts anew (speed only).
MEMORY_PIECES = 400_000
#: Texts of so many characters together are cut at once.
AT_ONCE = 3_000_000
END_ID = 1
_PLAIN = "\\t\\n\\r\\x20-\\x7e\\xa0-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\x{12f}\\x{131}-\\x{24f}\\x{2010}-\\x{2027}\\x{2030}-\\x{205e}\\x{20ac}"
#: The steps before the model that the fast way stands for, and their rule for pieces (white space is that of ``_PLAIN``).
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\xa0\p{L}\p{N}]+"


def default_path() -> str:
    """The public 49k vocabulary file; the path is a parameter of every operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_signs() -> dict[int, str]:
    """The public sign of each byte in byte-level vocabularies: itself if it prints, else the next one from 256 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(256 + k) for k, b in enumerate(others)}


def _cut_by_rule(path: str) -> bool:
    """Whether the file's normalizer, pre-tokenizer and model are those that the fast way stands for."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal, pre, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec["model"]
    steps = normal.get("normalizers", [])
    cuts = pre.get("pretokenizers", [])
    return (
        [s["type"] for s in steps] == _NORMALIZERS
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [s["type"] for s in cuts] == ["Split", "ByteLevel"]
        and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == ({"Regex": _RULE}, "Removed", True)
        and not cuts[1]["add_prefix_space"]
        and not cuts[1].get("use_regex", True)
        and model.get("type", "BPE") == "BPE"
        and not model.get("dropout")
        and spec.get("post_processor") is None
        and spec.get("truncation") is None
        and all("<|" in t["content"] for t in spec.get("added_tokens", []))
    )


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, ``END_ID`` appended."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([END_ID], "<u4").tobytes()
        self.by_rule = _cut_by_rule(path)
        self.signs = _byte_signs()
        self._forget()

    def _forget(self) -> None:
        """Piece 0 is the end id, piece 1 the empty piece beside white space."""
        self.places = {"": 1}
        self.ids, self.starts = np.array([END_ID], "<u4"), np.array([0, 1, 1])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + self.end

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text (null: of none) and the end id, as bytes."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """:meth:`encode` of each text, in order."""
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size > AT_ONCE:
                yield from self._some(held)
                held, size = [], 0
        yield from self._some(held)
        pa.default_memory_pool().release_unused()

    def _some(self, texts: list[str]) -> Iterator[bytes]:
        if not self.by_rule:
            yield from map(self._whole, texts)
            return
        column = pa.array(texts, pa.large_string())
        whole = pc.or_(pc.match_substring(column, "<|"), pc.match_substring_regex(column, f"[^{_PLAIN}]"))
        cut = iter(self._by_rule(column.filter(pc.invert(whole))))
        for text, alone in zip(texts, whole.to_pylist(), strict=True):
            yield self._whole(text) if alone else next(cut)

    def _by_rule(self, column: pa.Array) -> Iterator[bytes]:
        lists = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(column), _CUT, r"\0 "))
        pieces = lists.flatten().dictionary_encode()
        place = self._learn(pieces.dictionary)[pieces.indices.to_numpy()]
        ends = lists.offsets.to_numpy()[1:] - lists.offsets.to_numpy()[0]
        ends = ends + np.arange(1, len(ends) + 1)
        whole = np.zeros(len(place) + len(ends), np.int32)
        own = np.ones(len(whole), bool)
        own[ends - 1] = False
        whole[own] = place
        ids = pa.LargeListArray.from_arrays(self.starts, self.ids).take(pa.array(whole))
        out = memoryview(ids.values.to_numpy()).cast("B")
        at = 0
        for k in (ids.offsets.to_numpy()[ends] * 4).tolist():
            yield bytes(out[at:k])
            at = k

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """The place of each piece's ids in the memory."""
        if len(self.places) > MEMORY_PIECES:
            self._forget()
        places, model, signs = self.places, self.tokenizer.model, self.signs
        words = pieces.to_numpy(zero_copy_only=False).tolist()
        found = list(map(places.get, words))
        new = [w for w, k in zip(words, found, strict=True) if k is None]
        if new:
            ids = [[t.id for t in model.tokenize(p if p.isascii() else "".join([signs[b] for b in p.encode()]))] for p in new]
            first = len(places) + 1
            places.update(zip(new, range(first, first + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in ids])])
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in ids for i in x), "<u4", self.starts[-1] - len(self.ids))])
            fresh = iter(range(first, first + len(new)))
            found = [next(fresh) if k is None else k for k in found]
        return np.array(found, np.int32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and path."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
