"""Ids of whole texts by a vocabulary of words (the file word_bpe_49k.json), a batch of texts at a time.

The vocabulary drops white space, so the words of a text are independent: a batch is cut at white space, its distinct
words are looked up once, new ones are merged, and the ids are put together by numpy. The strings of special tokens
are these tokens wherever they stand, as in the library's own call.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that are cut into words at once.
SLICE = 4_000_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Recent:
    """Two generations of a memo: when the young one is full it becomes the old one, whose entries come back on use."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}
        self.young = young = _Young()
        young.fill = self.fill

    def fill(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self.young) >= self.most:
            self.old = dict(self.young)
            self.young.clear()
        self.young[key] = value
        return value


class _Young(dict):
    def __missing__(self, key):
        return self.fill(key)


def byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # those written as themselves
    other = iter(range(256, 512))
    return {chr(b) if b in plain else chr(next(other)): b for b in range(256)}


def latin(text: str) -> bool:
    """Whether all characters are below U+0100, where no sign composes with another."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: Letters, then signs or none: the vocabulary keeps both apart, and the normaliser leaves them as they are.
_LETTERS, _SIGNS = "a-z\u00df-\u00f6\u00f8-\u00ff", "!-/:-@\\[-`{-~"
_FIRST = "!-&(-/:-@\\[-`{-~"  # an apostrophe may begin a piece with letters


class WordIds:
    """Ids of white-space words.

    Words of letters, with signs after them or not, go straight to the merges, all of a batch in one string, where the
    byte 1 stands for the end of a part; their merges run in a byte-level encoder with the same ranks. Others are
    encoded one by one and remembered.
    """

    def __init__(self, path: str, most: int = 100_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.specials = {t: array("I", [i]).tobytes() for t, i in added.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")" if added else "((?!))")
        self.tokenizer.encode_special_tokens = True  # they are cut out before
        byte, ranks = byte_chars(), {}
        for token, rank in self.tokenizer.get_vocab(with_added_tokens=False).items():
            stem = token.removesuffix("</w>")
            if token not in added and all(c in byte for c in stem):
                ranks[bytes([byte[c] for c in stem]) + (b"\1" if stem != token else b"")] = rank
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[rank for part, rank in ranks.items() if part[-1] == 1]] = True
        self.merges = tiktoken.Encoding("parts", pat_str="[^\1]+\1", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = Recent(self._word, most).young

    def _word(self, word: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4")

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words together, and of each word where its ids begin and how many they are."""
        simple = pc.match_substring_regex(words, f"^[{_LETTERS}]+(?:[{_FIRST}][{_SIGNS}]*)?$")
        own = words.filter(simple)
        signs = pc.match_substring_regex(own, f"[{_SIGNS}]$").to_numpy(zero_copy_only=False)
        cut = pc.replace_substring_regex(pc.replace_substring_regex(own, f"([{_LETTERS}]+)", "\\1\1"), f"([{_SIGNS}]+)", "\\1\1")
        first = np.array(self.merges("".join(cut.to_pylist())), "<u4")
        last = np.flatnonzero(self.ends[first])[np.cumsum(1 + signs) - 1] if len(own) else np.empty(0, np.int64)
        others = [self.words[w] for w in words.filter(pc.invert(simple)).to_pylist()]
        is_simple = simple.to_numpy(zero_copy_only=False)
        size, at = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        size[is_simple] = np.diff(last, prepend=-1)
        at[is_simple] = last + 1 - size[is_simple]
        size[~is_simple] = n = np.fromiter(map(len, others), np.int64, len(others))
        at[~is_simple] = len(first) + np.cumsum(n) - n
        return np.concatenate([first, *others]), at, size

    def ordinary(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, in which the strings of special tokens are ordinary, and where each text's begin, with the end."""
        split = pc.ascii_split_whitespace(pa.array([x.lower() if latin(x) else x for x in texts], pa.large_string()))
        offsets = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        flat, at, size = self.distinct(coded.dictionary)
        words = coded.indices.to_numpy()
        n = size[words]
        ends = np.concatenate(([0], np.cumsum(n)))
        return flat[np.arange(ends[-1]) + np.repeat(at[words] - ends[:-1], n)], ends[offsets]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ordinary(), with special tokens for their strings."""
        if not any("<|" in x for x in texts):
            return self.ordinary(texts)
        parts = [self.special.split(x) if "<|" in x else [x] for x in texts]
        plain, starts = self.ordinary([x for p in parts for x in p[::2]])
        out, lengths, k = [], [], 0
        for p in parts:
            pieces = []
            for j, x in enumerate(p):
                if j % 2:
                    pieces.append(np.frombuffer(self.specials[x], "<u4"))
                else:
                    pieces.append(plain[starts[k] : starts[k + 1]])
                    k += 1
            out += pieces
            lengths.append(sum(map(len, pieces)))
        return np.concatenate(out), np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)


@lru_cache(2)
def encoder(path: str) -> WordIds:
    return WordIds(path)


def batch_ids(texts: Iterable[str | None], path: str, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids (unsigned 32-bit) of consecutive texts, some at a time, and where each text's begin, with the end; a null text has none.

    Texts are taken until they have `most` characters (SLICE where it isn't given) together.
    """
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= (most or SLICE):
            yield encoder(path).ids(held)
            held, size = [], 0
    if held:
        yield encoder(path).ids(held)
