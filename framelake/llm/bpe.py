"""BPE vocabularies: exact ids of the ``tokenizers`` library, at rank-file speed.

A ``Codec`` reads a ``tokenizers`` JSON file.  Where the file is one of the two plain
byte-level kinds below, the same merges also run in ``tiktoken``, several times faster;
texts with characters whose class or case could differ between the two libraries, or
with a special token's opening, go to ``tokenizers`` itself.  So ids never depend on the path.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np

SPLIT_GPT2 = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLIT_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin, Greek, Cyrillic, general punctuation, kana and unified ideographs: classes that
#: have not changed since Unicode 6.
SAFE_BYTES = re.compile("[^\x00-ɏΑ-ΡΣ-ϿЀ-ҁҊ-ԓ‐-‧ぁ-ゖァ-ヺ一-龥]")
#: For lower-casing vocabularies narrower still: no character whose lower case or NFC form
#: has another length or depends on its neighbours, and no control that only one library takes for white space.
SAFE_WORDS = r"\A[\x01-\x1b\x20-\x7f¡-įı-ɏА-я]*+\z"
#: SPLIT_WORDS for Java's matcher: alternatives that can't begin alike in the order of their frequency, and runs that never go back.
JAVA_WORDS = r"\p{L}++|\p{N}|'(?:s|t|re|ve|m|ll|d)|[^\s\p{L}\p{N}]++"
WORD_END = "\x00"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself if visible in Latin-1, else the next from U+0100."""
    seen = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the library's release."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


class Codec:
    """kind is ``bytes`` (byte-level, GPT-2 split), ``words`` (lower case, word ends) or ``other``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self._hf = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.kind, self.fast = "other", None
        model, alphabet = spec["model"], byte_alphabet()
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
        vocab = model.get("vocab", {})
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            return
        suffix = model.get("end_of_word_suffix") or ""
        pre = spec["pre_tokenizer"]
        if not suffix and not spec["normalizer"] and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            kind, base, pattern = "bytes", 256, SPLIT_GPT2
        elif suffix == "</w>" and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and pre["type"] == "Sequence" and pre["pretokenizers"][0].get("pattern") == {"Regex": SPLIT_WORDS} and pre["pretokenizers"][0]["invert"]:
            kind, base, pattern = "words", 512, rf"[^\s\x00]+\x00"
        else:
            return
        if any(vocab[m] != base + i for i, m in enumerate(merges)) or len(vocab) - len([s for s in self.specials if s in vocab]) != base + len(merges):
            return
        import tiktoken

        ranks = {}
        for token, i in vocab.items():
            if token not in self.specials:
                end = bool(suffix) and token.endswith(suffix)
                ranks[bytes(alphabet[c] for c in (token[: -len(suffix)] if end else token)) + WORD_END.encode() * end] = i
        self.kind = kind
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.specials if kind == "bytes" else {})

    @property
    def hf(self):  # noqa: ANN201
        """The library's own tokenizer, loaded where a text first needs it."""
        if self._hf is None:
            from tokenizers import Tokenizer

            self._hf = Tokenizer.from_file(self.path)
            self._hf.no_truncation()
            self._hf.no_padding()
        return self._hf

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens' strings."""
        if self.kind == "bytes" and not SAFE_BYTES.search(text):
            return self.fast.encode_ordinary(text)
        return self.hf.encode(text, add_special_tokens=False).ids

    def spell(self, ids: list[int]) -> bytes:
        return self.fast.decode_bytes(ids)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a raw text."""
        if self.kind == "bytes" and not SAFE_BYTES.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.hf.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode_marked(self, text: str) -> np.ndarray:
        """Ids of a lower-cased text whose words each end with WORD_END (see ``packing.marked_words``)."""
        return self.fast.encode_to_numpy(text)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of decode(ids, skip_special_tokens=False)."""
        if self.kind == "bytes":
            return self.fast.decode_bytes(ids.tolist()).decode("utf-8", errors="replace").encode()
        return self.hf.decode(ids.tolist(), skip_special_tokens=False).encode()


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One per worker process and vocabulary."""
    return Codec(path)
