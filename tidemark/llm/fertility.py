"""Quality rules from tokeniser fertility.

Two public vocabularies, a byte-fallback piece BPE and a byte-level BPE, cut every word of a document. Natural text of a language has
so many characters per token, few tokens that are bare bytes, and a spread-out distribution of tokens; junk
(symbols, shouted or repeated words, markup, key material) falls outside these bands. Each worker
keeps the tokens of the words it has met; a word of natural text is cut once for thousands of uses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kit import chunked, owners, trim, trimmed, word_codes, words

TOKENIZERS = "/opt/tokenizers"
#: Least and most characters per piece token, least and most per byte-level token, most byte-fallback share, and the least entropy as a
#: part of what the number of tokens allows. Upper bounds leave room for plain prose, of which the vocabularies hold whole words; the
#: lower ones for prose of rare words. Languages that aren't listed take the band of their script.
BANDS = {
    "en": (1.90, 6.5, 2.07, 6.5, 0.05, 0.8),
    "de": (1.90, 6.5, 1.84, 6.5, 0.05, 0.8),
    "fr": (1.75, 6.5, 1.68, 6.5, 0.05, 0.8),
    "es": (1.70, 6.5, 1.60, 6.5, 0.05, 0.8),
}
SCRIPT_BANDS = {"latin": (1.4, 7.0, 1.3, 7.0, 0.1, 0.7), "other": (0.2, 7.0, 0.2, 7.0, 1.0, 0.5)}
#: Bits from which on a text's entropy isn't asked to grow with its tokens.
MOST_BITS = 7.5
#: Words whose tokens a worker remembers at most; then it starts anew. Bounds its memory only.
_REMEMBERED = 200_000
#: Text measured at a time; bounds a worker's memory only.
_SLICE = 1 << 20

RESULT = "doc_id long, band string, n_tokens long, chars_per_token double, byte_chars_per_token double, byte_share double, entropy double, reason string"


class Vocabularies:
    """Both vocabularies, with the tokens of words already met."""

    def __init__(self, folder: str):
        import base64

        import sentencepiece
        import tiktoken

        self.piece = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.bytes = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.array([self.piece.is_byte(i) for i in range(self.piece.get_piece_size())])
        self._forget()

    def _forget(self) -> None:
        self.met: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int64)
        self.used = 0
        self.begin, self.size, self.chars, self.coarse, self.fallback = (np.zeros(_REMEMBERED, np.int64) for _ in range(5))

    def of(self, distinct: list[str]) -> np.ndarray:
        """Numbers under which the words' tokens are kept; new words are cut, each by itself."""
        new = [w for w in distinct if w not in self.met]
        if len(self.met) + len(new) > len(self.begin):
            self._forget()
            new = distinct
            if len(new) > len(self.begin):  # one very long text: the arrays grow to hold it
                self.begin, self.size, self.chars, self.coarse, self.fallback = (np.zeros(len(new), np.int64) for _ in range(5))
        if new:
            pieces = self.piece.encode(new, num_threads=1)
            sizes = np.fromiter(map(len, pieces), np.int64, len(new))
            tokens = np.fromiter((i for p in pieces for i in p), np.int64, int(sizes.sum()))
            first, end = len(self.met), len(self.met) + len(new)
            if self.used + len(tokens) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(tokens), len(self.flat)), np.int64)])
            self.flat[self.used : self.used + len(tokens)] = tokens
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            self.begin[first:end] = self.used + starts
            self.used += len(tokens)
            self.size[first:end] = sizes
            self.fallback[first:end] = np.bincount(np.repeat(np.arange(len(new)), sizes), weights=self.is_byte[tokens], minlength=len(new))
            self.chars[first:end] = np.fromiter(map(len, new), np.int64, len(new))
            cut = self.bytes.encode_ordinary
            self.coarse[first:end] = np.fromiter((len(cut(" " + w)) for w in new), np.int64, len(new))
            self.met.update(zip(new, range(first, end)))
        return np.fromiter(map(self.met.__getitem__, distinct), np.int64, len(distinct))


def measures(texts: pa.Array, vocabularies: Vocabularies) -> dict[str, np.ndarray]:
    """Tokens, characters per token of either vocabulary, byte-fallback share and token entropy of each text."""
    v = vocabularies
    offsets, values = words(texts)
    codes, distinct = word_codes(values)
    numbers = v.of(distinct)[codes]
    count = len(offsets) - 1
    text = owners(offsets)
    total = lambda x: np.bincount(text, weights=x[numbers], minlength=count)
    n, n_chars, n_coarse, n_bytes = total(v.size), total(v.chars), total(v.coarse), total(v.fallback)
    each = v.size[numbers]
    at = np.repeat(v.begin[numbers] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    keys = (np.repeat(text, each) << 17) | v.flat[at]
    keys.sort()
    entropy = np.zeros(count)
    if len(keys):
        heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        times = np.diff(np.r_[heads, len(keys)]).astype(float)
        owner = keys[heads] >> 17
        share = times / n[owner]
        entropy = np.bincount(owner, weights=-share * np.log2(share), minlength=count)
    with np.errstate(divide="ignore", invalid="ignore"):
        return {
            "n_tokens": n.astype(np.int64),
            "chars_per_token": np.where(n > 0, n_chars / n, 0.0),
            "byte_chars_per_token": np.where(n_coarse > 0, n_chars / n_coarse, 0.0),
            "byte_share": np.where(n > 0, n_bytes / n, 0.0),
            "entropy": np.abs(entropy),
        }


def _latin(texts: pa.Array) -> np.ndarray:
    """Whether most of a text's characters are of one or two bytes."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    length = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    return size <= 1.6 * length


def verdicts(bands: list[str], found: dict[str, np.ndarray], table: dict[str, tuple]) -> list[str | None]:
    """The first rule that each text breaks, None for a text that stays.

    The fewer tokens n a text has, the wider its bands: by 2 / sqrt(n) of each bound, and entropy is held against log2(n), up to MOST_BITS.
    """
    low, high, least, most, share, entropy = (np.array([table[b][i] for b in bands], float) for i in range(6))
    n = np.maximum(found["n_tokens"], 1).astype(float)
    slack = 2 / np.sqrt(n)
    room = np.maximum(0.0, 1 - slack)
    told = entropy * np.minimum(np.log2(n), MOST_BITS) * np.maximum(0.0, 1 - slack / 4)
    rules = [
        ("empty", found["n_tokens"] == 0),
        ("few characters per piece token", found["chars_per_token"] < low * room),
        ("many characters per piece token", found["chars_per_token"] > high * (1 + slack)),
        ("few characters per byte-level token", found["byte_chars_per_token"] < least * room),
        ("many characters per byte-level token", found["byte_chars_per_token"] > most * (1 + slack)),
        ("byte fallback", found["byte_share"] > share + slack),
        ("low token entropy", found["entropy"] < told - 1e-9),
    ]
    out = np.full(len(bands), None, object)
    for name, broken in reversed(rules):
        out[broken] = name
    return out.tolist()


def _measured(vocabularies: Vocabularies, batch: pa.RecordBatch, bands: dict[str, tuple], table: dict[str, tuple]) -> Iterator[pa.RecordBatch]:
    for piece in chunked(batch, "text", _SLICE):
        texts = piece.column("text")
        found = measures(texts, vocabularies)
        latin = _latin(texts)
        band = [x if x in bands else f"script:{'latin' if y else 'other'}" for x, y in zip(piece.column("lang").to_pylist(), latin)]
        yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "band": band, **found, "reason": pa.array(verdicts(band, found, table), pa.string())}, schema=_SCHEMA)


def _measure(folder: str, bands: dict[str, tuple], scripts: dict[str, tuple]):
    table = {**bands, **{f"script:{k}": v for k, v in scripts.items()}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = Vocabularies(folder)
        for batch in batches:
            yield from _measured(vocabularies, batch, bands, table)

    return trimmed(run)


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("band", pa.string()), ("n_tokens", pa.int64())]
    + [(c, pa.float64()) for c in ("chars_per_token", "byte_chars_per_token", "byte_share", "entropy")]
    + [("reason", pa.string())]
)


def fertility(docs: DataFrame, tokenizers: str = TOKENIZERS, bands: dict[str, tuple] | None = None, scripts: dict[str, tuple] | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The measures of every document and the rule it breaks: one row each, reason NULL for documents that stay.

    Words (split at white space) are cut one by one. chars_per_token, byte_share and entropy (bits) are of the piece
    vocabulary, byte_chars_per_token of the byte-level one. tokenizers: the folder of the public vocabularies, the
    same on every machine. bands: by language; scripts: for other languages and NULL, by whether most characters take
    at most two bytes.

    Short texts are judged too, by wider bands (see verdicts). NULL, empty and blank texts: no tokens, rejected as "empty". NULL doc_id: measured like any other. Repeated
    rows: one result row each. Very long texts are measured whole. Empty tables: no rows. Other columns
    are ignored, whatever their names.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return rows.mapInArrow(_measure(tokenizers, BANDS if bands is None else bands, SCRIPT_BANDS if scripts is None else scripts), RESULT)


def keep_natural(docs: DataFrame, tokenizers: str = TOKENIZERS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that break no rule of fertility, with all their columns and in place: nothing is shuffled."""
    verdict = _judge(tokenizers, BANDS, SCRIPT_BANDS)(F.col(text), F.col(lang).cast("string"))
    return docs.filter(verdict.isNull())


def _judge(folder: str, bands: dict[str, tuple], scripts: dict[str, tuple]):
    table = {**bands, **{f"script:{k}": v for k, v in scripts.items()}}

    @F.arrow_udf("string")
    def judge(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        vocabularies = Vocabularies(folder)
        for text, lang in batches:
            rows = pa.RecordBatch.from_arrays([pa.nulls(len(text), pa.int64()), text, lang], names=["doc_id", "text", "lang"])
            yield pa.concat_arrays([b.column("reason") for b in _measured(vocabularies, rows, bands, table)] or [pa.array([], pa.string())])
        del vocabularies
        trim()

    return judge
