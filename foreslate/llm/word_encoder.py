"""Token ids of whole texts by a tokenizer of the tokenizers library, each distinct word asked once.

Only for tokenizers that drop white space before they look at anything else, so
that the ids of a text are those of its words, one after the other.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .chunk_ids import HELD_BYTES, Generations, byte_letters, encode_lists, with_others

#: Arrow splits at these, the library does not.
UNEVEN = "[\\x1c-\\x1f]"
#: A word and the marks after it: the tokenizer's pattern cuts between the two, and no mark joins a letter.
WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
#: Letters below this are composed, and lower-cased one by one, alike everywhere; but for a sigma.
PLAIN, ODD = "Ͱ", "İ"


class WordEncoder:
    """``encode(texts)`` gives all ids of an Arrow array of texts, and where each text's ids begin.

    The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``: texts that hold the
    string of an added token, or a control character that Arrow takes for white space, go to the
    library whole; words of letters go to its model, once each; all other words to the library, once each.
    Null and empty texts have no ids.
    """

    def __init__(self, tokenizer_json: str, held_bytes: int = HELD_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        told = json.loads(tokenizer_json)
        added = [re.escape(t["content"]) for t in told.get("added_tokens", ())]
        self.whole = "|".join([UNEVEN, *added])
        self.letters = byte_letters()
        self.split = self._library(" a\n b\t") == self._library("a") + self._library("b") and not self._library("")
        self.lower = self._library("A") == self._library("a")
        self.words = Generations(held_bytes, self._letters)
        self.others = Generations(held_bytes, self._library)

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _ids(self, chunk: str) -> bytes:
        """The ids of one stretch without white space."""
        marks = ""
        if not chunk.isalpha():
            cut = WORD_AND_MARKS.fullmatch(chunk)
            if not cut or not cut[1].isalpha():
                return self.others[chunk]
            chunk, marks = cut.groups()
        if not chunk.isascii() and (max(chunk) >= PLAIN or ODD in chunk):
            return self.others[chunk + marks]
        word = self.words[chunk.lower() if self.lower else chunk]
        return word + self.others[marks] if marks else word

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        if not self.split:
            whole[:] = True
        ids, starts = encode_lists(
            pc.utf8_split_whitespace(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts), self._ids)
        return with_others(ids, starts, {
            i: np.frombuffer(self._library(texts[i].as_py()), "<u4") for i in np.flatnonzero(whole).tolist()})
