"""Ids of whole texts by a `tokenizers` file, with a bounded cache of space-separated chunks."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from itertools import accumulate, chain, compress, repeat
from operator import is_

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from .common import make_room

#: Chunks that one worker keeps; beyond it only those in use stay, which changes no id.
CACHE_ENTRIES = 100_000
_UNEVEN_SPACE = re.compile(r"\s\s")
#: Chunks of ASCII and Latin-1 letters, on which the word file's normalizer only lowers case, and their pieces by its pattern.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_ODD = re.compile("[^ !-~À-ÖØ-öø-ÿ]")
_PIECES = re.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_END = "\x01"
#: Latin-1 in lower case, and what each byte of that is to the pattern: white space that divides chunks, a letter, a digit, other signs; 4 is left to the file itself.
_LOWER = np.frombuffer(bytes(range(256)).decode("latin-1").lower().encode("latin-1"), dtype=np.uint8)
_KINDS = np.array([0 if c in " \n" else 1 if re.match("[a-zß-öø-ÿ]", c) else 2 if "0" <= c <= "9" else 3 if "!" <= c <= "~" else 4 for c in map(chr, range(256))], dtype=np.uint8)


class ChunkedEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes.

    The ids equal ``Tokenizer.encode(text, add_special_tokens=False)``.  Latin-1 texts at a
    file that drops white space are divided into its pieces as bytes, all at once.  Both byte-level BPE
    without a normalizer and pre-tokenizers that drop white space never join what a single
    space divides, so a chunk's ids can be kept and used again.  Texts for which this does
    not hold (runs of white space at a byte-level file, other kinds of file) are encoded whole.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            shape = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = self._drops_space(shape)
        self.keeps_space = shape.get("normalizer") is None and (shape.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and shape["pre_tokenizer"].get("use_regex") and not shape["pre_tokenizer"].get("add_prefix_space")
        self.cache: dict[str, bytes] = {}
        self.specials = [t["content"] for t in shape.get("added_tokens", [])]
        self.merger = self._byte_merger(shape) if self.keeps_space else None
        self.words = self._word_merger(shape) if self.drops_space else None

    @staticmethod
    def _byte_of() -> dict[str, int]:
        """The byte that each letter of a byte-level vocabulary stands for."""
        letters = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        return {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}

    def _word_merger(self, shape: dict) -> tiktoken.Encoding | None:
        """The vocabulary of a file that marks a word's last letter, in the faster merger: the mark is a byte after the word.

        Its ids become places in merge order: bytes, bytes with the mark, then merges.
        """
        model, byte_of = shape["model"], self._byte_of()
        splits = shape["pre_tokenizer"]["pretokenizers"]
        steps = [n["type"] for n in shape["normalizer"]["normalizers"]]
        if model.get("end_of_word_suffix") != "</w>" or any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix")) or splits[0]["pattern"].get("Regex") != _WORD_PATTERN or [s["type"] for s in splits] != ["Split", "ByteLevel"] or steps != ["NFC", "Replace", "Lowercase"]:
            return None
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        names = [*byte_of, *(c + "</w>" for c in byte_of), *merged]

        def spelled(name: str) -> bytes:
            body, mark = (name[:-4], _END.encode()) if name.endswith("</w>") else (name, b"")
            return bytes(byte_of[c] for c in body) + mark

        ranks = {spelled(name): n for n, name in enumerate(names)}
        if len(ranks) != len(names) or any(name not in model["vocab"] for name in names):
            return None
        self.id_of = np.array([model["vocab"][name] for name in names], dtype="<u4")
        self.space = ranks[(" " + _END).encode()]
        # the last id of a word holds its mark
        self.closes = np.array([name.endswith("</w>") for name in names])
        return tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})

    def _worded(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks: plain ones by the merger, all at once and divided at the spaces between them; others by the file itself."""
        joined = " ".join(chunks)
        if _ODD.search(joined) or "  " in joined or joined[:1] in ("", " ") or joined[-1] == " " or any(s in joined for s in self.specials):
            plain = [_PLAIN.fullmatch(c) is not None and not any(s in c for s in self.specials) for c in chunks]
            joined = " ".join(compress(chunks, plain))
        else:
            plain = [True] * len(chunks)
        # spaces are pieces of their own, by which the ids are divided
        got = self.words.encode_to_numpy(_END.join((*_PIECES.findall(joined.lower()), "")))
        data = self.id_of[got[got != self.space]].tobytes()
        cuts = np.flatnonzero(got == self.space)
        ends = [*(4 * (cuts - np.arange(len(cuts)))).tolist(), len(data)]
        found = map(data.__getitem__, map(slice, [0, *ends], ends))
        rest = iter(self._whole([c for c, p in zip(chunks, plain, strict=True) if not p]))
        return [next(found) if p else next(rest) for p in plain]

    def _pieced(self, texts: list[bytes]) -> tuple[list[bytes], list[int]]:
        """Ids of Latin-1 texts, whose pieces are runs of one kind of bytes, each distinct one merged once; and the texts for which this does not hold."""
        raw = _LOWER.take(np.frombuffer(b"\n".join(texts), dtype=np.uint8))
        kinds = _KINDS.take(raw)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begins = np.cumsum(lengths + 1) - lengths - 1
        # an apostrophe before a letter may be a piece with it
        odd = np.flatnonzero(kinds == 4)
        odd = np.concatenate([odd, np.flatnonzero((raw[:-1] == ord("'")) & (kinds[1:] == 1))])
        others = set((np.searchsorted(begins, odd, side="right") - 1).tolist())
        others.update(n for n, t in enumerate(texts) if any(s.encode() in t for s in self.specials))
        solid = (kinds != 0) & (kinds != 4)
        starts = solid.copy()
        starts[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2)
        starts = np.flatnonzero(starts)
        letters = raw[solid]
        cuts = np.append(np.cumsum(solid, dtype=np.int32)[starts] - 1, len(letters)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(letters)]).dictionary_encode()
        distinct, which = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        got = self.words.encode_to_numpy(b"\x01".join([*distinct, b""]).decode("latin-1"))
        ends = np.flatnonzero(self.closes[got]).astype(np.int32) + np.int32(1)
        counts = np.diff(ends, prepend=np.int32(0))
        many = counts[which]
        upto = np.cumsum(many, dtype=np.int64)
        place = np.repeat((ends[which] - upto).astype(np.int32), many)
        place += np.arange(len(place), dtype=np.int32)
        data = self.id_of[got][place].tobytes()
        cut = (4 * np.append(0, upto)[np.searchsorted(starts, begins)]).tolist()
        return [data[a:b] for a, b in zip(cut, [*cut[1:], len(data)], strict=True)], sorted(others)

    def _byte_merger(self, shape: dict) -> tiktoken.Encoding | None:
        """The same vocabulary in the faster merger, where merge order and ids agree; it serves chunks not seen before."""
        byte_of = self._byte_of()
        vocabulary = {token: n for token, n in shape["model"]["vocab"].items() if token not in self.specials}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in shape["model"]["merges"]]
        numbers = [vocabulary.get(m, -1) for m in merged]
        if numbers != sorted(set(numbers)) or len(merged) + 256 != len(vocabulary) or not all(c in byte_of for token in vocabulary for c in token):
            return None
        ranks = {bytes(byte_of[c] for c in token): n for token, n in vocabulary.items()}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        if self.merger is None:
            return self._whole(chunks)
        encode = self.merger.encode_ordinary
        return [array("I", encode(c)).tobytes() for c in chunks]

    @staticmethod
    def _drops_space(shape: dict) -> bool:
        steps = (shape.get("normalizer") or {}).get("normalizers", [])
        splits = (shape.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        joins = any(step.get("type") == "Replace" and step["pattern"].get("Regex") == r"\s+" and step["content"] == " " for step in steps)
        return joins and splits[0].get("type") == "Split" and splits[0].get("behavior") == "Removed" and bool(splits[0].get("invert"))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.words is None:
            return self._by_chunks(texts)
        out: list = [None] * len(texts)
        plain, left = {}, []
        for n, text in enumerate(texts):
            try:
                plain[n] = text.encode("latin-1")
            except UnicodeEncodeError:
                left.append(n)
        if plain:
            found, others = self._pieced(list(plain.values()))
            at = list(plain)
            for n, ids in zip(at, found, strict=True):
                out[n] = ids
            left += [at[k] for k in others]
        for n, ids in zip(left, self._by_chunks([texts[n] for n in left]), strict=True):
            out[n] = ids
        return out

    def _by_chunks(self, texts: list[str]) -> list[bytes]:
        if self.drops_space:
            parts = [t.replace("\n", " ").split(" ") for t in texts]
        elif self.keeps_space:
            # every chunk but a text's first is looked up with the space before it
            parts = [None if _UNEVEN_SPACE.search(t) or t[-1:].isspace() or t[:1].isspace() or any(s in t for s in self.specials) else t.split(" ") for t in texts]
            return self._encode_spaced(texts, parts)
        else:
            return self._whole(texts)
        cache = self.cache
        flat = list(chain.from_iterable(parts))
        found = list(map(cache.get, flat))
        if missing := set(compress(flat, map(is_, found, repeat(None)))):
            make_room(cache, (), len(missing), CACHE_ENTRIES)
            order = list(missing)
            cache.update(zip(order, self._whole(order) if self.words is None else self._worded(order), strict=True))
            at = -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                found[at] = cache[flat[at]]
        ends = list(accumulate(map(len, parts)))
        return [b"".join(found[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def _encode_spaced(self, texts: list[str], parts: list[list[str] | None]) -> list[bytes]:
        cache = self.cache
        bodies = [[] if p is None else p[1:] for p in parts]
        needed = set().union(*bodies) if bodies else set()
        if missing := needed - cache.keys():
            make_room(cache, needed, len(missing), CACHE_ENTRIES)
            order = list(missing)
            cache.update(zip(order, self._chunks([" " + w for w in order]), strict=True))
        firsts = iter(self._chunks([p[0] for p in parts if p is not None]))
        wholes = iter(self._whole([t for t, p in zip(texts, parts, strict=True) if p is None]))
        return [next(wholes) if p is None else next(firsts) + b"".join(map(cache.__getitem__, b)) for p, b in zip(parts, bodies, strict=True)]


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkedEncoder:
    """One encoder for each file and worker."""
    return ChunkedEncoder(path)
