"""Token ids of whole texts, with memos in front of the tokenizer."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

#: Distinct pieces that a memo of one worker holds; it starts anew beyond that.
MEMO = 250_000
#: Characters of a text that are split at a time, about.
PART = 1 << 18
_SPACE = re.compile("[\t\n\x0b\x0c\r ]")

#: Letters of texts that are split here: a-z and those of Latin-1 and Latin Extended-A whose lower case is one letter.
_LETTERS = "a-z\xdf-\xf6\xf8-\xffāă-įı-ž"
_PLAIN = re.compile(f"[^\t\n\x0b\x0c\r\x20-\x7e{_LETTERS}]")
#: The tokenizer's own splitting, for such texts in lower case.
_SPLIT = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t\n\x0b\x0c\r 0-9{_LETTERS}]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others for letters from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _parts(text: str) -> Iterator[str]:
    """A text in parts of bounded length, cut behind white space; a longer word is not cut."""
    at = 0
    while len(text) - at > PART:
        space = _SPACE.search(text, at + PART)
        if space is None:
            break
        yield text[at : space.end()]
        at = space.end()
    yield text[at:]


class _Memo(dict):
    """The ids of each piece of text as bytes of uint32. A piece that is not known yet is learnt when it is looked up."""

    def __init__(self, learn: Callable[[str], list[int]]) -> None:
        self.learn = learn

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = array("I", self.learn(piece)).tobytes()
        return ids

    def ids(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, pieces))


class WordTokenizer:
    """Ids of texts by word_bpe_49k, or a tokenizer with the same normalizer and splitting.

    It lower-cases, drops white space and merges only within runs of letters, single digits and
    runs of other characters. A text of ASCII and common Latin letters is split here by the same
    rule, and each distinct run goes through the tokenizer's model once. Any other text, and one
    that spells a special token, goes through the whole tokenizer word by word, split at ASCII white
    space, across which nothing is merged either. Both give the ids of the text as a whole.
    """

    def __init__(self, path: str | None = None) -> None:
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.runs, self.words = _Memo(self._run), _Memo(self._word)

    def _split(self, text: str) -> list[str] | None:
        """Runs of a text that can be split here."""
        low = text.lower()
        if not low.isascii() and _PLAIN.search(low) or low.isascii() and not low.isprintable() and _PLAIN.search(low):
            return None
        if "<|" in text and any(s in text for s in self.special):
            return None
        if not text.isascii() and len(low) != len(text):
            return None
        return _SPLIT.findall(low)

    def _run(self, run: str) -> list[int]:
        known = run if run.isascii() else "".join([self.letters[b] for b in run.encode()])
        return [t.id for t in self.tokenizer.model.tokenize(known)]

    def _word(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _ids(self, text: str) -> bytes:
        """The ids of a text of bounded length."""
        if len(self.runs) > MEMO:
            self.runs = _Memo(self._run)
        if len(self.words) > MEMO:
            self.words = _Memo(self._word)
        found = self._split(text)
        if found is not None:
            return self.runs.ids(found)
        return self.words.ids([w.decode() for w in text.encode("utf-8", "replace").split()])

    def ids(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each text as uint32; a null text is empty."""
        return [np.frombuffer(b"".join(map(self._ids, _parts(text or ""))), np.uint32) for text in texts]


@lru_cache(1)
def tokenizer(path: str | None = None) -> WordTokenizer:
    """One tokenizer for all tasks of a worker, so that its memos last."""
    return WordTokenizer(path)
