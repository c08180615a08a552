"""Token ids of many texts at once, for byte-level BPE files with word ends.

Texts of common characters are cut into words by arrays of character classes,
each distinct word is encoded once by the tokenizers library and remembered, and
the ids of all words are gathered by position.  Other texts, and texts that hold
a special token, go to the library whole.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from calorix.llm.bpe import PLAIN, byte_symbols

#: Words that a worker remembers, and ids of them; then it starts anew.
KNOWN_WORDS, KNOWN_IDS = 600_000, 8_000_000
SPACE, LETTER, NUMBER, OTHER = range(4)
#: The split pattern that the word cutting stands for; files with another one are encoded by the library alone.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


@functools.cache
def classes() -> np.ndarray:
    """Class of every character below U+2100."""
    kind = {"L": LETTER, "N": NUMBER}
    return np.array([SPACE if chr(c).isspace() else kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x2100)], np.int8)


def word_starts(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each character is in a word, and whether it starts one, by PATTERN."""
    kind = classes()[chars]
    first = kind != SPACE
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    at = np.flatnonzero(first & (chars == ord("'")))
    at = at[at + 1 < len(chars)]
    if len(at):
        one, two = chars[at + 1], chars[np.minimum(at + 2, len(chars) - 1)]
        is_ = lambda a, c: a == ord(c)
        short = is_(one, "s") | is_(one, "t") | is_(one, "m") | is_(one, "d")
        long = (at + 2 < len(chars)) & ((is_(one, "r") | is_(one, "v")) & is_(two, "e") | is_(one, "l") & is_(two, "l"))
        for where, n in ((at[short], 2), (at[long], 3)):
            first[where + 1] = False
            after = where + n
            after = after[after < len(chars)]
            first[after] |= kind[after] == LETTER
    return kind != SPACE, first


class BulkEncoder:
    """Ids of texts as the tokenizers library gives them for a file, without special tokens added."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        splits = [p["pattern"]["Regex"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.fits = splits == [PATTERN] and bool(self.suffix)
        if self.fits:
            self.special = [t["content"] for t in spec["added_tokens"]]
            self.shown = str.maketrans({chr(b): s for b, s in byte_symbols().items()})
            # The file's own model on words in byte symbols, parted by spaces.
            self.words = Tokenizer(self.library.model)
            self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            ends = {i for t, i in spec["model"]["vocab"].items() if t.endswith(self.suffix)}
            self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.ends[list(ends)] = True
        self.clear()

    def clear(self) -> None:
        """Forget all words: ``known`` has each one's number, ``at`` where its ids start in ``ids``."""
        self.known: dict[str, int] = {}
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def plain(self, text: str) -> bool:
        return self.fits and PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def learn(self, words: list[str]) -> None:
        """Encode words, which hold no space, and remember them."""
        text = " ".join(words)
        if not text.isascii():
            text = " ".join(w if w.isascii() else w.encode().decode("latin-1").translate(self.shown) for w in words)
        ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.at = np.append(self.at, np.flatnonzero(self.ends[ids]) + 1 + self.at[-1])
        self.ids = np.append(self.ids, ids)

    def gathered(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each has."""
        encoded = words.dictionary_encode()
        listed = pa.ListArray.from_arrays([0, len(encoded.dictionary)], encoded.dictionary)
        distinct = pc.binary_join(listed, " ")[0].as_py().split(" ")
        if len(self.known) > KNOWN_WORDS or len(self.ids) > KNOWN_IDS:
            self.clear()
        found = list(map(self.known.get, distinct))
        if new := [w for w, k in zip(distinct, found) if k is None]:
            self.learn(new)
            found = list(map(self.known.get, distinct))
        number = np.array(found, np.int64)[encoded.indices.to_numpy()]
        n = self.at[number + 1] - self.at[number]
        return self.ids[np.repeat(self.at[number] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and self.plain(t)]
        here = set(plain)
        rest = [i for i, t in enumerate(texts) if t and i not in here]
        for i, e in zip(rest, self.library.encode_batch([texts[i] for i in rest], add_special_tokens=False)) if rest else ():
            out[i] = np.array(e.ids, np.int32)
        if plain:
            lower = [texts[i].lower() for i in plain]
            joined = "\n".join(lower)
            chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            data = np.frombuffer(joined.encode(), np.uint8)
            inside, first = word_starts(chars)
            width = 1 + (chars >= 0x80) + (chars >= 0x800) if len(data) > len(chars) else None
            starts = np.flatnonzero(first)
            kept = data[np.repeat(inside, width)] if width is not None else data[inside]
            size = np.cumsum(inside * width if width is not None else inside, dtype=np.int64)
            if len(starts):
                offsets = np.append(size[starts] - (width[starts] if width is not None else 1), len(kept)).astype(np.int32)
                words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept))
                ids, n = self.gathered(words)
                ends = np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)) + 1)  # of texts in characters, with the line end
                last = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, ends)]
                for i, part in zip(plain, np.split(ids, last[:-1])):
                    out[i] = part
        return out


@functools.lru_cache(maxsize=2)
def bulk_encoder(path: str) -> BulkEncoder:
    """The worker's encoder for a file."""
    return BulkEncoder(path)
