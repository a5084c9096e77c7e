"""Word-end BPE ids for whole text columns, with one library call per distinct word part.

The tokenizer lower-cases, applies NFC and drops white space, and none of its
steps crosses ASCII white space. So a text's ids are those of its words one
after the other. Arrow cuts the words and makes them distinct, the tokenizers
library encodes the parts that a worker has not met yet, and numpy lays out
the ids.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from citeloom.llm.arrow import compact_text

#: Words, and parts of words, that a worker remembers before it starts afresh.
REMEMBERED = 500_000
#: Words of these characters need no Unicode normalisation beyond str.lower().
PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]*")
#: The vocabulary's own pattern over such characters.
PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: The normaliser and the pre-tokeniser for which words stand for texts, as the vocabulary file has them.
NORMALISER = [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A full stop or comma after a letter or digit and before white space stands alone in any case.
STOP = r"([a-z0-9ß-öø-ÿ])([.,])(\s|$)"


def _visible(part: str) -> str:
    """The byte-level alphabet's spelling of a part."""
    return part if part.isascii() else part.encode().decode("latin-1").translate(_ALPHABET)


_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _KEPT)}


def splits_at_spaces(settings: dict) -> bool:
    """Whether a tokenizer's settings are those for which a text's ids are its words' ids, as the shortcuts here assume."""
    steps = [(n["type"], n.get("pattern", {}).get("Regex"), n.get("content")) for n in (settings.get("normalizer") or {}).get("normalizers", [])]
    cuts = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = [c for c in cuts if c["type"] == "Split" and c["pattern"] == {"Regex": SPLIT} and c["behavior"] == "Removed" and c["invert"]]
    level = [c for c in cuts if c["type"] == "ByteLevel" and not c["add_prefix_space"] and not c["use_regex"]]
    model = settings["model"]
    return steps == NORMALISER and len(cuts) == 2 and len(split) == len(level) == 1 and model["type"] == "BPE" and not model.get("dropout") and not settings.get("post_processor")


class WordTokenizer:
    """Encodes Arrow string columns; keeps the ids of words it has seen.

    A vocabulary with other settings is encoded text by text by the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.by_words = splits_at_spaces(json.loads(self.library.to_str()))
        self.most = max(self.library.get_vocab(with_added_tokens=True).values())
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = self.parts[part] = array("I", [t.id for t in self.model.tokenize(_visible(part))]).tobytes()
        return ids

    def _word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word) and "<|" not in word:
            return self._part(word.lower()) if word.isalpha() else b"".join(map(self._part, PART.findall(word.lower())))
        return np.array(self.library.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column (uint32) and the number of ids of each row; null is an empty text."""
        column = compact_text(column)  # the string kernels misread slices
        if not self.by_words:
            each = [np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) for t in column.to_pylist()]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.fromiter(map(len, each), np.int64, len(each))
        if not pc.any(pc.match_substring(column, "<|")).as_py():  # else a special token might appear or vanish
            column = pc.replace_substring_regex(pc.ascii_lower(column), STOP, r"\1 \2\3")
        lists = pc.ascii_split_whitespace(column)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.words) > REMEMBERED:
            self.words = {}
        if len(self.parts) > REMEMBERED:
            self.parts = {}
        known, each = self.words, []
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self._word(word)
            each.append(ids)
        flat = np.frombuffer(b"".join(each), np.uint32)
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        at = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        n = sizes[codes]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(at[codes] - (ends - n), n) + np.arange(total)] if total else np.zeros(0, np.uint32)
        upto = np.concatenate([[0], ends])
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        return ids, np.diff(upto[bounds])


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def forget() -> None:
    """Drop the words that this worker remembers; the loaded library stays."""
    for own in _TOKENIZERS.values():
        own.words, own.parts = {}, {}
