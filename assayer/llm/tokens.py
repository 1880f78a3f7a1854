"""Token counts of byte-level BPE by a whole-token shortcut.

Pre-tokens that are, alone, one token need no merging. Which vocabulary strings
those are is proved once on the driver by encoding each of them with the
library's own model; a string passes only if the result is the single token with
its id. Executors get that table, split texts into pre-tokens and look each of
them up; only the others are merged, by the same model.

The split is done with the tokenizer's own pattern. Characters whose class could
differ between Unicode versions of the two pattern libraries send the whole text
through the tokenizer itself, so counts never depend on the shortcut.

Defined results: null counts as empty; empty texts have 0 tokens; special strings
inside a text are tokens of their own, the library's default; a file with another
split, a normaliser, a prefix space or other settings than plain byte-level BPE is
counted by the library alone, and truncation or padding in it are switched off;
very long texts are counted whole; repeated rows are rows; an empty table gives an
empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayer.llm.common import worker_cache

#: Fixed value: the published split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that long-standing Unicode blocks hold; others take the library's own split.
SETTLED = r"[^\x00-\u024f\u0391-\u03a9\u03b1-\u03c9\u0410-\u044f\u2010-\u2027\u2030-\u203a\u20ac\u2122\u4e00-\u9fa5\u3041-\u3093\u30a1-\u30f6\uac00-\ud7a3]"
#: Merged pre-tokens that a worker remembers at most.
REMEMBERED = 200_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def whole_tokens(tokenizer: Tokenizer) -> list[str]:
    """The vocabulary strings, as text, that encode alone as one token.

    Proof by running: the pre-token is encoded and has to give exactly its own
    id. Strings that aren't valid UTF-8 can't be pre-tokens' whole text.
    """
    back = {c: b for b, c in byte_alphabet().items()}
    split, out = regex.compile(PATTERN), []
    for piece, number in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(back[c] for c in piece).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if split.findall(text) == [text] and [t.id for t in tokenizer.model.tokenize(piece)] == [number]:
            out.append(text)
    return out


def loaded(spec: str) -> Tokenizer:
    """The tokenizer, without the truncation and padding that its file may ask for."""
    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def is_plain(spec: str) -> bool:
    """Whether a tokenizer's file is byte-level BPE of the published split, with nothing that changes texts or merges."""
    s = json.loads(spec)
    split, model = s.get("pre_tokenizer") or {}, s.get("model") or {}
    return (
        not s.get("normalizer")
        and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        and model.get("type", "BPE") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    )


class _Counts(dict):
    """Tokens of each pre-token: proven ones, and those merged so far."""

    def __init__(self, whole, model):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.model = len(self), model
        self.alphabet = byte_alphabet()

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize("".join([self.alphabet[b] for b in piece.encode()])))
        if len(self) < self.whole + REMEMBERED and len(piece) < 64:
            self[piece] = n
        return n


class Counter:
    """Counts the tokens of texts in one process."""

    def __init__(self, spec: str, whole: list[str]):
        self.tokenizer = loaded(spec)
        self.counts = _Counts(whole, self.tokenizer.model)
        self.split = regex.compile(PATTERN).findall
        self.odd = regex.compile(SETTLED).search
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = is_plain(spec) and all(t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.special = special if plain else None
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))).split if special and plain else None

    def tokens(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or (not text.isascii() and self.odd(text)):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.cut and any(s in text for s in self.special):
            parts = self.cut(text)
            return len(parts) - 1 + sum(sum(map(self.counts.__getitem__, self.split(p))) for p in parts if p)
        return sum(map(self.counts.__getitem__, self.split(text)))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of `docs`.

    path: a byte-level BPE tokenizer's .json, read on the driver alone; its text
    and the proven table (both of the vocabulary's size, which is checked) are
    broadcast. limit: n_tokens above it are over_limit.
    """
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    tokenizer = loaded(spec)
    if len(spec) > 64 << 20:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast((spec, whole_tokens(tokenizer) if is_plain(spec) else []))

    def run(batches):
        key, cache = ("tokens", path, len(spec)), worker_cache()
        if key not in cache:
            cache[key] = Counter(*shared.value)
        count = cache[key].tokens
        for b in batches:
            texts = b.column(1)
            n = [count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
