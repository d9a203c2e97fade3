"""Words of texts, told apart by Arrow, and what tokenizers make of them."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import hf_tokenizer


def told_apart(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of ``texts`` (large strings without nulls), the place of each
    text's words among them, and how many each text has.  A word is what stands between
    ASCII white space."""
    split = pc.ascii_split_whitespace(texts)
    counts = np.diff(split.offsets.to_numpy())
    told = split.flatten().dictionary_encode()
    at = told.indices.to_numpy().astype(np.int64)
    full = pc.binary_length(told.dictionary).to_numpy() > 0
    if not full.all():  # white space at an end of a text gives an empty word
        keep = full[at]
        counts = np.diff(np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(counts)])])
        at = at[keep]
    return told.dictionary.to_pylist(), at, counts


class WordIds:
    """Ids of words, of which a worker remembers ``most`` and then keeps those that it met
    more than once since, unless they are more than half."""

    def __init__(self, tokenizer: str, most: int):
        self.tokenizer, self.most = hf_tokenizer(tokenizer), most
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.ends, self.met = array("I"), array("q", [0]), array("I")

    def keep(self) -> None:
        """Forgets the words that were met once."""
        place, ids, ends, met = self.place, self.ids, self.ends, self.met
        kept = [(w, i) for w, i in place.items() if met[i] > 1]
        self.clear()
        for word, i in kept if len(kept) <= self.most // 2 else ():
            self.place[word] = len(self.met)
            self.ids.extend(ids[ends[i] : ends[i + 1]])
            self.ends.append(len(self.ids))
            self.met.append(1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words of ``texts`` in one array, where each word's end, and
        how many words each text has."""
        if len(self.place) > self.most:
            self.keep()
        words, at, counts = told_apart(texts)
        found = list(map(self.place.get, words))
        missing = [w for w, x in zip(words, found, strict=True) if x is None]
        if missing:
            for word, x in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False), strict=True):
                self.place[word] = len(self.ends) - 1
                self.ids.extend(x.ids)
                self.ends.append(len(self.ids))
                self.met.append(0)
            found = list(map(self.place.get, words))
        if words:
            np.frombuffer(self.met, np.uint32)[found] += 1
        ends = np.frombuffer(self.ends, np.int64)
        at = np.array(found, np.int64)[at]
        n = ends[at + 1] - ends[at]
        stop = np.cumsum(n)
        flat = np.frombuffer(self.ids, np.uint32) if len(self.ids) else np.zeros(0, np.uint32)
        return flat[np.repeat(ends[at] - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)], stop, counts
