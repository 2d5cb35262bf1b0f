"""Byte-level BPE tokenizer files: ids of texts, bytes of ids, exact joins of two encodings.

A file is checked when it is loaded: what it asks for beyond the plain form (a normalizer, another split pattern, merges
out of the order of their ids, marks inside words) is refused, as ids would differ silently.
"""

from __future__ import annotations

import json
import re

import numpy as np

# The split pattern of byte-level files that ask for none of their own.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    # Fixed rule of byte-level BPE: printable bytes stand for themselves, the others for characters from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


def check_plain(file: dict) -> None:
    """Raise ValueError unless a tokenizer file is byte-level BPE without anything beside it."""
    model, split = file["model"], file.get("pre_tokenizer") or {}
    wrong = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += ["type"] * (model.get("type", "BPE") != "BPE") + ["normalizer"] * bool(file.get("normalizer"))
    wrong += ["pre_tokenizer"] * ((split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) != ("ByteLevel", False, True))
    wrong += ["added_tokens"] * any(t.get(k) for t in file.get("added_tokens", ()) for k in ("lstrip", "rstrip", "single_word", "normalized"))
    vocab, added = model["vocab"], {t["content"] for t in file.get("added_tokens", ())}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [vocab[m] for m in merged]
    wrong += ["merges"] * (order != sorted(set(order)) or len(vocab.keys() - set(merged) - set(byte_characters()) - added) > 0)
    if wrong:
        raise ValueError(f"not a plain byte-level BPE file: {', '.join(wrong)}")


class ByteBpe:
    """Ids of a byte-level BPE tokenizer file, as little-endian unsigned 32-bit bytes, and texts of ids.

    Whole texts are encoded, as words repeat too seldom for a cache to be the faster way. Added tokens' strings in a text
    count as those tokens, as the file says.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        check_plain(file)
        of_char = byte_characters()
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(of_char[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in self.special}
        self._bpe = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        # the longest first, as the first alternative that fits is taken
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        table = ranks | {s.encode(): i for s, i in self.special.items()}
        of_id = [b""] * (1 + max(table.values(), default=-1))
        for token, i in table.items():
            of_id[i] = token
        self.sizes = np.array([len(t) for t in of_id], np.int64)
        self._starts, self._pool = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(of_id), np.uint8)

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self.plain(p) for p in self._split.split(text))
        return self.plain(text)

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """Whether it is an added token, and the string, of each part of a text in order."""
        if not any(s in text for s in self.special):
            return [(False, text)] if text else []
        return [(p in self.special, p) for p in self._split.split(text) if p]

    def plain(self, text: str) -> bytes:
        """Ids of a text in which added tokens' strings are ordinary text."""
        return self.whole(text).tobytes()

    def whole(self, text: str) -> np.ndarray:
        """The same as an array."""
        return self._bpe.encode_to_numpy(text, disallowed_special=())

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """What ids stand for, one after the other."""
        sizes = self.sizes[ids]
        total = int(sizes.sum())
        if not total:
            return b""
        ends = np.cumsum(sizes)
        return self._pool[np.arange(total) + np.repeat(self._starts[ids] - (ends - sizes), sizes)].tobytes()

    def join(self, left: np.ndarray, right: np.ndarray, window: int = 8) -> np.ndarray:
        """Ids of two neighbouring texts together, from the ids of each; no added token's string stands in them.

        The tokens around the join are encoded again, ``window`` to each side, and twice as many until both sides agree
        exactly: the first token of the new ids is the left's at that place and the last one the right's, or a side is
        used up. Why that is enough: ids of one stretch are right if each neighbouring two of them are what BPE makes of
        those two alone, and all neighbouring two now stand in one of three encodings; and windows begin and end after
        a character that is no white space, from where the split pattern reads on as it did before.
        """
        if not len(left) or not len(right):
            return left if len(left) else right
        while True:
            a, b = self._open(left, len(left) - window, -1), self._open(right, window, 1)
            again = self.whole((self.bytes_of(left[a:]) + self.bytes_of(right[:b])).decode())
            if (a == 0 or again[0] == left[a]) and (b == len(right) or again[-1] == right[b - 1]):
                return np.concatenate([left[:a], again, right[b:]])
            window *= 2

    def _open(self, ids: np.ndarray, at: int, step: int) -> int:
        """A place from at on, by growing steps, where a window may begin or end: an end of ids, or after a whole character that is no white space."""
        while 0 < at < len(ids):
            before = self.bytes_of(ids[max(0, at - 4) : at])[-4:]
            after = self.bytes_of(ids[at : at + 1])
            start = next((i for i in range(1, len(before) + 1) if before[-i] & 0xC0 != 0x80), 0)
            if after[0] & 0xC0 != 0x80 and start and not before[-start:].decode("utf-8", "replace").isspace():
                return at
            at, step = at + step, 2 * step
        return min(max(at, 0), len(ids))
