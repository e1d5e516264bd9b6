"""Subword ids by a byte-level BPE tokenizer, with a cache of words.

The tokenizer first cuts a text into pieces that never run over a single white-space
character between two others: a piece takes a leading space only, and a lone line
feed stands alone. So a text may be cut before each lone space or line feed, each cut
encoded on its own, and the ids joined; words met before come from the cache.
"""

from __future__ import annotations

import os
import re
import sys
import types

import numpy as np

#: Words a Python worker remembers; beyond that they are encoded anew.
CACHE_WORDS = 700_000
_OTHER_WHITE = re.compile(r"[^\S \n]")
_CUT = re.compile(r"(?<=\S)(?= \S)")


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    @staticmethod
    def cuts(text: str) -> list[str]:
        """The text cut before lone spaces (which go) and lone line feeds (which stay); the first is marked by a space before it."""
        if (
            "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace() or _OTHER_WHITE.search(text)
        ):
            first, *rest = _CUT.split(text)
            return [" " + first, *(x[1:] for x in rest)]
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = " " + parts[0]
        return parts

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known = self.words
        get = known.get
        out, open_ = [], []
        for k, t in enumerate(texts):
            ws = self.cuts(t) if t else []
            found = list(map(get, ws))
            if None in found:
                open_.append((k, ws))
            out.append(b"".join(found) if not open_ or open_[-1][0] != k else found)
        missing = list({w for k, ws in open_ for w, x in zip(ws, out[k]) if x is None})
        if missing:
            spelled = [w[1:] if w[:1] == " " else w if w[:1] == "\n" else " " + w for w in missing]
            new = dict(zip(missing, self._encode(spelled), strict=True))
            for k, ws in open_:
                out[k] = b"".join([new[w] if x is None else x for w, x in zip(ws, out[k])])
            if len(known) + len(new) <= CACHE_WORDS:
                known.update(new)
        return out


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python process; it outlives tasks, and so does its cache."""
    kept = sys.modules.setdefault("_millrace_kept", types.ModuleType("_millrace_kept"))
    table = kept.__dict__.setdefault("tokenizers", {})
    if path not in table:
        table[path] = WordTokenizer(path)
    return table[path]
