"""BPE encoding and decoding of whole tables through a minimal acyclic transducer lexicon.

`build_lexicon` counts the words of all documents and compiles the most frequent into one automaton file;
`encode` sends it to the workers as a broadcast of bounded size, where it is memory-mapped and looked up word by word,
unseen words being merged exactly; `decode` turns ids back into text.

Defined cases: a null text counts as an empty one and gives no ids; white space alone is text like any other; strings
of special tokens inside a text become those tokens' ids; repeated rows each give their own row; an empty table gives
an empty result; a null key stays null, repeated keys give a row each; a very long text is cut into words in pieces, at
places where a word ends in any case, and is a batch of its own. Columns other than the key are not returned by
`encode`; `decode` keeps all columns and replaces `decoded`. A worker's memo knows words by 128 bits of hashes.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window as W, functions as F

from coursemill.llm.bpe import Encoder, Lexicon, Vocabulary, chunked_words
from coursemill.llm.common import binary_column, kind, small_batches, staged
from coursemill.llm.spans import row_chunks, text_buffer

#: Bytes of text in one batch of results.
OUT_BYTES = 1_000_000
#: Words of the lexicon and the longest of them in bytes: a bound on what is broadcast (about 3 MB).
LEXICON_WORDS, LEXICON_BYTES = 65_536, 48


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def encoder(path: str, lexicon_path: str | None = None) -> Encoder:
    """A worker's encoder; it lives as long as the worker, with its memo of words."""
    return Encoder(vocabulary(path), Lexicon.open(lexicon_path) if lexicon_path else None)


def word_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """Distinct pre-tokens (`word` binary) of all documents with their counts (`n`)."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            raw, off = text_buffer(batch.column(0))
            words, n = chunked_words(raw, off, enc)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n)], ["word", "n"])

    return docs.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", words: int = LEXICON_WORDS) -> np.ndarray:
    """The compiled lexicon of the most frequent words of all documents, at most `words` of LEXICON_BYTES bytes each.

    It holds all words that are at least so frequent that there are no more than `words` of them, so the driver gets no
    more than that, from however many tasks.
    """
    counts = staged(word_counts(docs, tokenizer, text_col).filter((F.length("word") <= LEXICON_BYTES) & (F.col("n") > 1)), "words")
    levels = counts.groupBy("n").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(W.orderBy(F.desc("n"))))  # one row a count
    least = levels.filter(F.col("upto") <= words).agg(F.min("n")).first()[0]
    top = counts.filter(F.col("n") >= least) if least is not None else counts.limit(0)
    return Lexicon.compile([bytes(r.word) for r in top.select("word").collect()], vocabulary(tokenizer))


#: Lexicon files of this worker alone, by digest.
_OWN: dict[str, str] = {}


def _mapped(sent) -> str:
    """The lexicon file of this machine, written from the broadcast by the first worker that needs it.

    Both names of the rename lie in the folder as Spark names it, so they are on one mount whatever other names lead
    there. Where the rename fails all the same, the worker keeps a file of its own. A short file is written anew.
    """
    data, digest = sent.value
    folder = SparkFiles.getRootDirectory()
    path = os.path.join(folder, f"lexicon-{digest}.npy")
    for known in (path, _OWN.get(digest, path)):
        if _whole(known, len(data)):
            return known
    part = os.path.join(folder, f"lexicon-{digest}-{uuid.uuid4().hex}.npy")
    with open(part, "wb") as f:
        np.save(f, np.frombuffer(data, dtype=np.int32))
    try:
        os.replace(part, path)
    except OSError:
        path = _OWN[digest] = part
    return path


def _whole(path: str, size: int) -> bool:
    """Whether a lexicon file is there with all of its `size` bytes behind the header."""
    try:
        return os.path.getsize(path) > size
    except OSError:
        return False


Batches = Iterator[pa.RecordBatch]


def _encoding(tokenizer: str, sent, id_col: str) -> Callable[[Batches], Batches]:
    """Batches of (key, text) to batches of (key, n_tokens, ids)."""

    def run(batches: Batches) -> Batches:
        enc = encoder(tokenizer, _mapped(sent))
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            for a, b in row_chunks(off, OUT_BYTES):
                ids, upto = enc.texts(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(upto)), binary_column(ids.astype("<u4").tobytes(), upto * 4)], [id_col, "n_tokens", "ids"])

    return run


def _decoding(tokenizer: str, at: int, names: list[str]) -> Callable[[Batches], Batches]:
    """Batches with ids in column `at` to the same with `decoded`."""

    def run(batches: Batches) -> Batches:
        vocab = vocabulary(tokenizer)
        for batch in batches:
            column = batch.column(at).cast(pa.large_binary()).fill_null(b"")
            off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
            data = column.buffers()[2]
            flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
            for a, b in row_chunks(off, OUT_BYTES):
                ids = flat[off[a] : off[b]].view("<u4").astype(np.int64)
                upto = np.r_[0, np.cumsum(vocab.token_len[ids])][(off[a : b + 1] - off[a]) // 4]
                text = vocab.bytes_of(ids).tobytes()
                try:
                    text.decode("utf-8")
                    out = binary_column(text, upto).cast(pa.string())
                except UnicodeDecodeError:
                    out = pa.array([text[i:j].decode("utf-8", "replace") for i, j in zip(upto[:-1], upto[1:], strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(names))), out], [*names, "decoded"])

    return run


def _sent(docs: DataFrame, tokenizer: str, lexicon: np.ndarray | None, text_col: str):
    """The broadcast lexicon, built from the documents where none is given."""
    small_batches(docs.sparkSession)
    data = (build_lexicon(docs, tokenizer, text_col) if lexicon is None else lexicon).astype("<i4").tobytes()
    return docs.sparkSession.sparkContext.broadcast((data, hashlib.sha256(data).hexdigest()[:16]))


def encode(docs: DataFrame, tokenizer: str, lexicon: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the key, `n_tokens` and `ids` (little-endian unsigned 32-bit ids as binary).

    `lexicon` comes from `build_lexicon`; without one, it is built from the documents themselves.
    """
    run = _encoding(tokenizer, _sent(docs, tokenizer, lexicon, text_col), id_col)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind(docs, id_col)}, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """The frame with `decoded`, the text of the ids; ids that end inside a character give U+FFFD there."""
    small_batches(encoded.sparkSession)
    rest = [c for c in encoded.columns if c != "decoded"]
    schema = ", ".join(f"`{c}` {kind(encoded, c)}" for c in rest)
    return encoded.select(*rest).mapInArrow(_decoding(tokenizer, rest.index(ids_col), rest), f"{schema}, decoded string")


def round_trip(docs: DataFrame, tokenizer: str, lexicon: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`encode` and then `decode`, in one Python worker a task."""
    there, names = _encoding(tokenizer, _sent(docs, tokenizer, lexicon, text_col), id_col), [id_col, "n_tokens", "ids"]
    back = _decoding(tokenizer, 2, names)
    return docs.select(id_col, text_col).mapInArrow(lambda batches: back(there(batches)), f"`{id_col}` {kind(docs, id_col)}, n_tokens long, ids binary, decoded string")
