"""Token ids of whole texts from a public tokenizer, encoding each different word once a while."""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from itertools import chain

import numpy as np

from tallyscope.llm.batches import Recent

_PUNCTUATION = string.punctuation.replace("'", "").encode()
_LATIN = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
#: Punctuation between a letter or digit and the next one, or white space: a word of its own.
_APART = re.compile(
    rb"([%s](?:(?<=[a-z0-9].)|(?<=%s.))[%s]*)(?=[\sa-z0-9]|%s|\Z)"
    % (re.escape(_PUNCTUATION), _LATIN, re.escape(_PUNCTUATION), _LATIN)
)
#: Words of lower-case ASCII and Latin-1 letters: no normalisation changes them.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
RECENT = 100_000
#: Words of letters that are encoded as one text.
TOGETHER = 2000


class WordTokenizer:
    """A tokenizer that drops white space and marks the ends of words with ``</w>``.

    Its tokens never cross white space, nor the border between letters and punctuation, so a text's
    ids are the ids of its words in turn. Words met lately are kept with their ids, in two generations
    of RECENT words that live as long as this object. New words of plain letters are encoded many at a
    time as one text, without the normalisation that leaves them as they are; other new words as a
    batch. A text that holds the string of a special token is encoded whole.
    """

    def __init__(self, path: str, recent: int = RECENT):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        added = [token.content.encode().lower() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.recent = Recent(recent)

    def _new(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words, as 32-bit numbers."""
        letters, others, out = [], [], {}
        for word in words:
            (letters if word.isalpha() or _PLAIN.fullmatch(word) else others).append(word)
        for at in range(0, len(letters), TOGETHER):
            some = letters[at : at + TOGETHER]
            (found,) = self.plain.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(some):
                others += some
                continue
            raw = ids.tobytes()
            out.update((word, raw[a:b]) for word, a, b in zip(some, [0, *stops[:-1]], stops, strict=True))
        for at in range(0, len(others), TOGETHER):
            some = others[at : at + TOGETHER]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            out.update((word, np.array(x.ids, np.uint32).tobytes()) for word, x in zip(some, found, strict=True))
        return out

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit arrays."""
        raw = [(text or "").encode().lower() for text in texts]
        whole = [self.special is not None and self.special.search(own) is not None for own in raw]
        words = [
            [] if special else _APART.sub(rb" \1 ", own).split() for own, special in zip(raw, whole, strict=True)
        ]
        ids = self.recent.of(set(chain.from_iterable(words)), self._new)
        return [
            np.array(self._whole(text), np.uint32)
            if special
            else np.frombuffer(b"".join(map(ids.__getitem__, own)), np.uint32)
            for text, own, special in zip(texts, words, whole, strict=True)
        ]
