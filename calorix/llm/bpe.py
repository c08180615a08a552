"""BPE encoding and decoding by forced-boundary splitting.

Symbols that never stand side by side inside any vocabulary token can never be
merged across, so such pairs mark certain cuts.  Every word of a text is cut
there, the fragments are encoded independently (and remembered per worker), and
the ids are concatenated.  The result equals the whole-text encoding of the
tokenizer file, which is a parameter and is read where tasks run.

Defined results: null and empty texts have no ids and decode to the empty
string; strings of special tokens become their ids, as in the library; texts of
any length are encoded whole; extra columns pass through.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from calorix.llm.shared import cut, strings, trimmed

#: Words and fragments that a worker remembers, of at most so many characters; then it starts anew.
CACHE_WORDS, CACHE_CHARS = 100_000, 64
#: Characters of the texts encoded at once, so that the ids of few texts are in memory.
CHARS_AT_ONCE = 1 << 20
#: Texts of these characters alone need no library call to be normalised: all of them are NFC and have one-to-one lower case.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-įı-ǃ‐-‧€]*")


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ForcedBoundaryEncoder:
    """Encoder and decoder of one byte-level BPE tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # Fragments with the word's end go to the file's own model, others to one that knows no end.
        self.final = self.library.model
        self.inner = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0) if self.suffix else self.final
        self.adjacent = set()
        for token in model["vocab"]:
            symbols = self.symbols(token.removesuffix(self.suffix), token.endswith(self.suffix)) if self.suffix else [*token]
            self.adjacent.update(map("\0".join, zip(symbols, symbols[1:])))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split)
        self.bytes = byte_symbols()
        self.tokens = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.known: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[tuple[str, bool], tuple[int, ...]] = {}

    def symbols(self, word: str, ends: bool) -> list[str]:
        """One symbol per byte; the last one of a word carries the word end."""
        symbols = [*word]
        if ends and symbols:
            symbols[-1] += self.suffix
        return symbols

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-split word in byte symbols."""
        symbols = self.symbols(word, True)
        cuts = [0, *(i for i in range(1, len(symbols)) if f"{symbols[i - 1]}\0{symbols[i]}" not in self.adjacent), len(symbols)]
        ids: list[int] = []
        for a, b in zip(cuts, cuts[1:]):
            fragment = word[a:b], b == len(word)
            found = self.fragments.get(fragment)
            if found is None:
                if len(self.fragments) >= CACHE_WORDS:
                    self.fragments.clear()
                model = self.final if fragment[1] else self.inner
                found = tuple(t.id for t in model.tokenize(fragment[0]))
                if b - a <= CACHE_CHARS:
                    self.fragments[fragment] = found
            ids += found
        return tuple(ids)

    def words(self, text: str) -> tuple[list[str], bool]:
        """Words of a text without special tokens; whether they are in byte symbols already."""
        if PLAIN.fullmatch(text):
            return self.pieces.findall(text.lower()), False
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))], True

    def encode_plain(self, text: str) -> list[tuple[int, ...]]:
        words, in_bytes = self.words(text)
        out, known = [], self.known
        for w in words:
            ids = known.get(w) if not in_bytes else None
            if ids is None:
                symbols = w if in_bytes or w.isascii() else "".join(self.bytes[b] for b in w.encode())
                ids = self.encode_word(symbols)
                if not in_bytes and len(w) <= CACHE_CHARS:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[w] = ids
            out.append(ids)
        return out

    def encode(self, text: str) -> list[tuple[int, ...]]:
        """The ids of a text, in one tuple per word."""
        if self.at_special is None or not (hits := list(self.at_special.finditer(text))):
            return self.encode_plain(text)
        out, at = [], 0
        for m in hits:
            out += [*self.encode_plain(text[at : m.start()]), (self.special[m[0]],)]
            at = m.end()
        return out + self.encode_plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; files without a decoder join tokens by spaces."""
        if self.library.decoder is not None:
            return self.library.decode(ids, skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryEncoder:
    """The worker's encoder for a file."""
    return ForcedBoundaryEncoder(path)


def default_path() -> str:
    """The public word-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_texts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ``ids`` (array of int) and ``decoded`` (string)."""
    spare = [c for c in docs.columns if c not in ("ids", "decoded")]

    @trimmed
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for rows in cut(batch, text, CHARS_AT_ONCE):
                flat, ends, decoded = [], [0], []
                for t in strings(rows.column(text)):
                    ids = list(chain.from_iterable(own.encode(t)))
                    decoded.append(own.decode(ids))
                    flat.append(np.array(ids, np.int32))
                    ends.append(ends[-1] + len(ids))
                arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in spare), arrays, pa.array(decoded, pa.string())], [*spare, "ids", "decoded"])

    narrow = docs.select(*spare)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema)
    return narrow.mapInArrow(encode, f"{schema}ids array<int>, decoded string")


def token_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: encoding and decoding of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_digests(encode_texts(docs, default_path()))
