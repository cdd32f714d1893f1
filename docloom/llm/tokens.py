"""Token counts with a whole-token shortcut.

Byte-level BPE works on pre-tokens. Offline (once for each vocabulary file, on the driver, before any text is read) every vocabulary string is
put through the library on its own; those that come back as one token are proven whole, and their table is shipped to the workers. Counting a
text is then a lookup for each pre-token; only pre-tokens that aren't proven are merged, by the library's own model, and remembered.

Strings of special tokens inside a text are one token each, as the library counts them by default, so texts are cut there
first. The pre-token pattern is vouched for on common Latin, punctuation and the characters of ``SAFE``. A text with any other
character is cut before blanks that follow a visible ASCII character, where a pre-token ends in any case; the pieces that hold such a
character are counted by the library, the others as above.

Defined results: null and empty texts have no tokens; repeated rows are counted each; an empty table gives no rows; other columns are ignored,
so that their names cannot clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Merged pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 400_000
#: The pre-token pattern of byte-level BPE (a fixed value of the format).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Text for which the pattern here and in the library agree (the tests hold every such character against the library).
SAFE = regex.compile(r"[\x00-\x1b\x20-\x84\x86-ǿ‐-‧‰-‾₠-₿]*")


#: Where a pre-token ends whatever the other characters are.
_CUTS = regex.compile(r"(?<=[\x21-\x7e])(?=\x20)", regex.V1)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Counter:
    """Counts the tokens of texts by one vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str, whole: list[str] | None = None):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only plain byte-level BPE files are supported")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only plain added tokens are supported")
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.whole = dict.fromkeys(self._prove(spec["model"]["vocab"]) if whole is None else whole, 1)
        self.known = _Known(self)

    def _prove(self, vocab: dict[str, int]) -> list[str]:
        """Vocabulary strings that are a whole pre-token and come back from the library as exactly their own id."""
        shown = {c: i for i, c in enumerate(_byte_letters())}
        texts, ids = [], []
        for letters, i in vocab.items():
            raw = bytes(shown[c] for c in letters if c in shown)
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if text and letters not in self.special and (m := PATTERN.fullmatch(text)) and m.end() == len(text):
                texts.append(text)
                ids.append(i)
        found = self.library.encode_batch(texts, add_special_tokens=False)
        return [t for t, i, e in zip(texts, ids, found, strict=True) if e.ids == [i]]

    def merge(self, pre_token: str) -> int:
        return len(self.library.encode(pre_token, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if self.split is None or not self.split.search(text):
            return self._plain(text)
        pieces = self.split.split(text)
        return len(pieces) - 1 + sum(map(self._plain, pieces))

    def _plain(self, text: str) -> int:
        """Tokens of a text without special tokens."""
        if SAFE.fullmatch(text):
            return sum(map(self.known.__getitem__, PATTERN.findall(text)))
        return sum(sum(map(self.known.__getitem__, PATTERN.findall(p))) if SAFE.fullmatch(p) else self.known[p] for p in _CUTS.split(text) if p)


class _Known(dict):
    def __init__(self, counter: Counter):
        super().__init__(counter.whole)
        self.counter = counter

    def __missing__(self, pre_token: str) -> int:
        n = self.counter.merge(pre_token)
        if len(self) > len(self.counter.whole) + REMEMBERED:
            self.clear()
            self.update(self.counter.whole)
        if len(pre_token) <= 64:
            self[pre_token] = n
        return n


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level files: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str, whole: list[str] | None = None) -> Counter:
    """The counter for ``path``, made once in each process; with the proven strings it is given, if any."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, whole)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, *, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document."""
    whole = list(counter(vocabulary_path(vocabulary)).whole)  # proven here; no larger than the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary_path(vocabulary), whole)
        for b in batches:
            texts = b.column(1).to_pylist()
            tokens = pa.array([c.count(t) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), tokens], names=["doc_id", "n_bytes", "n_tokens"])

    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    rows = spread(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "text", size.alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
