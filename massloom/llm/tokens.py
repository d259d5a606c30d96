"""Token ids by a public tokenizer file, word by word, with a bounded cache."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from itertools import chain
from types import ModuleType

import numpy as np

WORD_BPE = "word_bpe_49k.json"
#: Words in the cache of one worker process unless said otherwise, and characters of the longest that stays in it.
CACHE_WORDS, CACHE_CHARS = 1 << 19, 48
#: Words that are given to the tokenizer as one text.
JOINED = 256
#: A word whose ids are those of its letters in lower case and of its closing marks.
SIMPLE = re.compile(r"([A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+)([.,;:!?]*)")


def tokenizer_path(name_or_path: str) -> str:
    """A name of public_tokenizers' own, or a path that the workers can open."""
    if os.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer file must split at white space and drop it, as word_bpe_49k does; a text's
    ids are then those of its space-separated parts in order. Texts that hold one of the
    tokenizer's special strings go through it whole.
    """

    def __init__(self, name_or_path: str = WORD_BPE, limit: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name_or_path))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # which ids end a word, if the model marks them
        mark = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends = None
        if mark:
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for token, i in vocab.items() if token.endswith(mark)]] = True
        self.cache: dict[str, bytes] = {"": b""}
        self.limit = limit

    @classmethod
    def of_worker(cls, name_or_path: str = WORD_BPE, limit: int = CACHE_WORDS) -> WordEncoder:
        """This process's encoder: a worker that runs further tasks keeps its cache."""
        kept = sys.modules.setdefault("_massloom_worker", ModuleType("_massloom_worker")).__dict__
        if name_or_path not in kept:
            kept[name_or_path] = cls(name_or_path)
        kept[name_or_path].limit = limit
        return kept[name_or_path]

    def _ids(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _ids_of_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, many at a time: each word is one piece, whose last id marks its end."""
        if self.ends is None:
            return self._ids(words)
        out: list[bytes] = []
        for lo in range(0, len(words), JOINED):
            part = words[lo : lo + JOINED]
            found = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]
            ids = np.array(found.ids, np.uint32)
            cuts = np.nonzero(self.ends[ids])[0] + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):
                # the file's rule doesn't take each word as one piece
                out += self._ids(part)
                continue
            flat, cuts = ids.tobytes(), (4 * cuts).tolist()
            out += [flat[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        return out

    def _learn(self, words: set[str]) -> None:
        """Puts these words into the cache."""
        cache, split, whole, letters = self.cache, [], set(), set()
        for w in words:
            if len(w) <= CACHE_CHARS and (m := SIMPLE.fullmatch(w)):
                base, marks = m[1].lower(), m[2]
                if marks or base != w:
                    split.append((w, base, marks))
                    whole.add(marks)
                letters.add(base)
            else:
                whole.add(w)
        for found, ids_of in ((whole, self._ids), (letters, self._ids_of_letters)):
            new = [w for w in found if w not in cache]
            cache.update(zip(new, ids_of(new), strict=True))
        for w, base, marks in split:
            cache[w] = cache[base] + cache[marks]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > self.limit:
            self.cache.clear()
            self.cache[""] = b""
        out: list[bytes] = [b""] * len(texts)
        split: dict[int, list[str]] = {}
        for k, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[k] = self._ids([text])[0]
            else:
                split[k] = text.replace("\n", " ").split(" ")
        cache = self.cache
        new = set(chain.from_iterable(split.values())).difference(cache)
        self._learn(new)
        for k, parts in split.items():
            out[k] = b"".join([cache[p] for p in parts])
        for w in new:
            if len(w) > CACHE_CHARS:
                del cache[w]
        return out
