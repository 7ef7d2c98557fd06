"""Byte-level BPE tokenizers of the ``tokenizers`` file format.

The file is read once on the driver; a worker builds the encoder from the broadcast vocabulary. Ids equal those of the
``tokenizers`` library: the merges of these files come in the order of their ids, which is checked, so the ranks of the
``tiktoken`` library, the faster of the two, say the same.
"""

from __future__ import annotations

import json

import numpy as np

#: Fixed values of the format: bytes that stand for themselves in the vocabulary, the others follow from U+0100 on.
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Fixed value of the format: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[str, object] = {}


class ByteBpe:
    """Vocabulary of a byte-level BPE file."""

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int]):
        self.ranks, self.special = ranks, special
        self.key = f"{hash(frozenset(ranks.items())):x}-{hash(frozenset(special.items())):x}"

    @classmethod
    def read(cls, path: str) -> ByteBpe:
        """The plain form of these files only: no normaliser, no prefix space, one pattern."""
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        pre, model = data.get("pre_tokenizer") or {}, data["model"]
        if (data.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
                or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                                                           "end_of_word_suffix", "byte_fallback", "ignore_merges"))):
            raise ValueError("not a plain byte-level BPE file")
        if any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in data["added_tokens"]):
            raise ValueError("added tokens that strip or match words are not supported")
        byte_of = {chr(b): b for b in PLAIN}
        byte_of |= {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(PLAIN))}
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, w)): i for w, i in model["vocab"].items() if w not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"]["".join(m)] for m in pairs]
        if ids != sorted(ids) or len(ids) + 256 != len(ranks):
            raise ValueError("the merges do not come in the order of their ids")
        return cls(ranks, special)

    def encoder(self):
        """The encoder of this worker process."""
        if self.key not in _ENCODERS:
            import tiktoken

            _ENCODERS.clear()
            _ENCODERS[self.key] = tiktoken.Encoding(self.key, pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)
        return _ENCODERS[self.key]

    def encode(self, text: str, special: bool = False) -> np.ndarray:
        """Ids of a text; strings of special tokens are those tokens if ``special``, else plain text."""
        return self.encoder().encode_to_numpy(text, allowed_special="all" if special else set(), disallowed_special=())

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id."""
        out = [b""] * (1 + max([*self.ranks.values(), *self.special.values()]))
        for w, i in self.ranks.items():
            out[i] = w
        for w, i in self.special.items():
            out[i] = w.encode()
        return out
