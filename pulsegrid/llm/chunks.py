"""Texts as runs between single spaces, the unit that both tokenizers encode independently.

A tokenizer's result for a text is the concatenation of its results for such chunks, so a
chunk is encoded once and looked up afterwards. Texts for which this does not hold are
recognised and encoded whole.
"""

from __future__ import annotations

import base64
import re

from pulsegrid.llm.common import tokenizer_path

CACHE_ENTRIES = 400_000  # per worker; a full cache starts anew


class ByteBpe:
    """Ids of a byte-level BPE file as ``tokenizers`` gives them, as little-endian bytes.

    A chunk is a run of non-space characters with the space before it. Pre-tokens never cross
    a space between two non-white characters, so chunks are independent; texts with a space
    between two white-space characters, or with a special token's string, go to the library
    whole. Chunks outside the cache are encoded by the rank file of the same vocabulary, which
    has the same merges; those with letters beyond Latin go to the library too.
    """

    _odd = re.compile(r"\s \s")
    _far = re.compile("[^\x00-ɏ]")

    def __init__(self, name: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken"):
        import numpy as np
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.np = np
        self.library = Tokenizer.from_file(tokenizer_path(name))
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        pairs = (line.split() for line in open(tokenizer_path(ranks), "rb"))
        table = {base64.b64decode(a): int(b) for a, b in pairs}
        self.ranks = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )
        self.cache: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return self.np.array(ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if self._far.search(chunk):
            return self._whole(chunk)
        return self.np.array(self.ranks.encode_ordinary(chunk), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self._odd.search(text) or any(s in text for s in self.specials):
            return self._whole(text)
        first, *rest = text.split(" ")
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        got = list(map(cache.get, rest))
        if None in got:
            for i, v in enumerate(got):
                if v is None:
                    w = rest[i]
                    v = cache.get(w)
                    if v is None:
                        v = cache[w] = self._chunk(" " + w)
                    got[i] = v
        return (self._chunk(first) if first else b"") + b"".join(got)


class PieceCounter:
    """Token counts of a sentencepiece model.

    The library puts a word mark before the text and turns spaces into marks; no piece has a
    mark after another character, so no merge crosses from a word into the next mark. The
    chunk key is what follows the first mark; the key "" is a lone mark, one token.
    """

    _runs = re.compile(" +[^ ]*")

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces that span words: chunks are not independent")

    @classmethod
    def split(cls, text: str) -> list[str]:
        """Chunk keys of a text without word marks."""
        keys = text.split(" ")
        if "" in keys and text:
            keys = [run[1:] for run in cls._runs.findall(" " + text)]
        return keys if text else []

    def lengths(self, keys: list[str]) -> list[int]:
        return [len(x) if k else 1 for k, x in zip(keys, self.model.encode(keys, num_threads=1))]

    def whole(self, text: str) -> int:
        return len(self.model.encode(text))
