"""A vocabulary's ids by the faster of two ways, for operators that need ids and do not say how."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

from reviewlens.llm import bpe

# What is left to the vocabulary itself: characters beyond U+024F, and words of over 1,000 characters.
_ODD = re.compile(r"[^\x00-\u024f]|[^ \n]{1000}").search


class Encoder:
    """The ids a `bpe.Vocabulary` gives.

    Where every token's id follows from the rank of the merge that makes it, tiktoken finds those of texts on
    whose letters and numbers all libraries agree, those up to U+024F, if no word of them is very long and
    they hold no special token; the vocabulary finds the others.
    """

    def __init__(self, vocabulary: bpe.Vocabulary):
        self.vocabulary = vocabulary
        self._prepare()

    def _prepare(self) -> None:
        import tiktoken

        known = self.vocabulary
        merged = [i for _, i in sorted(known.merges.values())]
        n = 256 + len(merged)
        by_rank = merged == list(range(256, n)) and sorted(known.base) == list(range(256))
        ranks = {known.bytes_of[i]: i for i in range(n)} if by_rank else {}
        self._fast = None
        if ranks and len(ranks) == n:
            self._fast = tiktoken.Encoding("bytes", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens={})
        specials = "|".join(map(re.escape, known.special))
        self._special = re.compile(specials).search if specials else lambda text: None

    def __getstate__(self):
        return {"vocabulary": self.vocabulary}

    def __setstate__(self, state):
        self.vocabulary = state["vocabulary"]
        self._prepare()

    def encode_arrays(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text."""
        odd = [i for i, text in enumerate(texts) if self._fast is None or _ODD(text) or self._special(text)]
        found = dict(zip(odd, self.vocabulary.encode_arrays([texts[i] for i in odd])))
        return [found[i] if i in found else np.array(self._fast.encode_ordinary(t), np.int32) for i, t in enumerate(texts)]
