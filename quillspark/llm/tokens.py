"""Subword ids of many texts from a byte-level BPE vocabulary (a tokenizers file, or ranks).

Where no space has white space beside it, the pre-tokenizer always cuts before a space, so the
chunks between spaces (each with its space) have ids of their own. The distinct chunks of a slice, far fewer
than its chunks, are encoded as one string, and told apart again by the bytes of each id. Other texts
are encoded whole."""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        data = f.read()
    if not path.endswith(".json"):
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    model = json.loads(data)["model"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if any(model["vocab"][a + b] != 256 + k for k, (a, b) in enumerate(pairs)):
        raise ValueError(f"ids of {path} aren't in order of its merges")
    alphabet = byte_alphabet()
    return {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(pairs)}


class Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ranks = ranks_of(path)
        self.path, self.whole_texts = path, None
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1  # no id of a token
        self.sizes = np.zeros(self.end, np.int32)
        self.opens = np.zeros(self.end + 1, bool)  # of tokens with a space in front, and the end
        self.opens[self.end] = True
        for token, i in ranks.items():
            self.sizes[i] = len(token)
            self.opens[i] = token[:1] == b" "

    def whole(self, text: str) -> np.ndarray:
        if not self.path.endswith(".json"):
            return np.array(self.encoding.encode_ordinary(text), np.int32)
        if self.whole_texts is None:
            from tokenizers import Tokenizer

            self.whole_texts = Tokenizer.from_file(self.path)
            self.whole_texts.encode_special_tokens = True  # their strings in a text are ordinary text
        return np.array(self.whole_texts.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def spaced(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks, each with a space before it: all ids, and how many each has."""
        odd = pc.match_substring_regex(chunks, f"^{WHITE}|{WHITE}$|^$").to_numpy(zero_copy_only=False)
        plain = chunks if not odd.any() else chunks.filter(pa.array(~odd))
        ids = np.empty(0, np.int32)
        if len(plain):
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), " ")[0].as_py()
            ids = self.encoding.encode_to_numpy(" " + joined, disallowed_special=()).astype(np.int32)
        bytes_until = np.cumsum(pc.binary_length(plain).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        ends = np.searchsorted(np.cumsum(self.sizes[ids], dtype=np.int64), bytes_until) + 1
        if not odd.any():
            return ids, np.diff(ends, prepend=0)
        out: list = [None] * len(chunks)
        for k, x in zip(np.flatnonzero(~odd).tolist(), np.split(ids, ends[:-1])):
            out[k] = x
        for k in np.flatnonzero(odd).tolist():
            out[k] = np.array(self.encoding.encode_ordinary(" " + chunks[k].as_py()), np.int32)
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        column = pa.array(texts, pa.binary()).cast(pa.string())
        whole = pc.match_substring_regex(column, f"{WHITE} | {WHITE}").to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for i in np.flatnonzero(whole).tolist():
            out[i] = self.whole(texts[i].decode())
        even = np.flatnonzero(~whole)
        if not len(even):
            return out
        lists = pc.split_pattern(column.take(pa.array(even)), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat, offsets = lists.flatten(), offsets - offsets[0]
        firsts = offsets[:-1]  # a text's first chunk has no space before it
        heads = [np.array(self.encoding.encode_ordinary(x), np.int32) for x in flat.take(pa.array(firsts)).to_pylist()]
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        ids, lengths = self.spaced(coded.dictionary)
        codes[firsts] = len(lengths) + np.arange(len(firsts))
        lengths = np.concatenate((lengths, [len(x) for x in heads]))
        store = np.concatenate((ids, *heads))
        tokens, ends = gathered(store, lengths, codes)
        bounds = np.concatenate(([0], ends))[offsets]
        for k, i in enumerate(even.tolist()):
            out[i] = tokens[bounds[k] : bounds[k + 1]]
        return out


def gathered(store: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a store, by number, end to end; and where each ends."""
    begins = np.cumsum(lengths) - lengths
    n = lengths[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    shift = (begins[codes] - (ends - n)).astype(np.int32)
    return store[np.arange(total, dtype=np.int32) + np.repeat(shift, n)], ends


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
