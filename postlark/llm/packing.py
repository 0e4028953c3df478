"""Packing by power-of-two decomposition.

A document's ids (its tokens, then one end id) are split into pieces whose lengths are powers of two: as many pieces of
the longest length as fit, then the binary digits of the rest, largest first. Pieces of equal length go to one bucket;
a batch is drawn from one bucket. So every sequence is one piece of one document, no sequence crosses documents, and
nothing is padded. Pieces need no neighbours: the job is one pass without a shuffle.

Words are encoded once and remembered in the worker (up to ``REMEMBERED`` words, then afresh): the tokenizer splits at
white space before it merges, so a text's ids are the ids of its words (between ASCII white space) in order. Words whose characters are all below U+0180
are split as the tokenizer's own pattern does and their parts go straight to its merge model; any other word goes through
the whole tokenizer.

Cases: a null or empty text has the end id alone; very long texts are encoded word by word; repeated rows give repeated
pieces under their own sequence ids; a null id stays null; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postlark.shipping import ship

LONGEST = 2048
END = 1
REMEMBERED = 500_000
PIECES = "id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
# The tokenizer's own split for letters below U+0180 (fixed values of its file).
_LETTER = "a-zªµºß-öø-ſ"
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9²³¹¼-¾]|[^ \t-\r\x85\xa0{_LETTER}0-9²³¹¼-¾]+")
_SIMPLE = re.compile(r"[\x00-ĩı-ſ]+")


def _byte_letters() -> list[str]:
    """How a byte-level vocabulary spells each byte: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of words, remembered as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spelled = str.maketrans({chr(b): c for b, c in enumerate(_byte_letters())})
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            spelled = part.encode().decode("latin-1").translate(self.spelled)
            ids = _packed([t.id for t in self.model.tokenize(spelled)])
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def word(self, raw: bytes) -> bytes:
        word = raw.decode()
        if _SIMPLE.fullmatch(word) and not ("<|" in word and any(s in word for s in self.special)):
            parts = _PARTS.findall(word.lower())
            ids = self.part(parts[0]) if len(parts) == 1 else b"".join(map(self.part, parts))
        else:
            ids = _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        self.words[raw] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text, equal to the tokenizer's own."""
        get, miss = self.words.get, self.word
        return np.frombuffer(b"".join([get(w) or miss(w) for w in text.encode().split()]), "<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of n ids: whole sequences, then the binary digits of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def piece_rows(batches: Iterator[pa.RecordBatch], path: str, longest: int, end: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    known = encoder(path)
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        for half in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
            out: dict[str, list] = {f.split()[0]: [] for f in PIECES.split(", ")}
            values, cuts = [], [0]
            for key, text in zip(half.column("id").to_pylist(), half.column("text").to_pylist()):
                ids = np.append(known.ids(text or ""), np.uint32(end))
                raw, at = ids.tobytes(), 0
                for length in piece_lengths(len(ids), longest):
                    out["id"].append(key)
                    out["start"].append(at)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(raw[4 * at : 4 * (at + length)]))
                    out["doc_tokens"].append(len(ids))
                    out["sequence_id"].append(number)
                    number, at = number + 1, at + length
                    if with_ids:
                        cuts.append(cuts[-1] + length)
                if with_ids:
                    values.append(ids)
            out["offset"] = [0] * len(out["id"])
            if with_ids:
                ids_column = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(values).astype(np.int32)))
            else:
                ids_column = pa.nulls(len(out["id"]), pa.list_(pa.int32()))
            arrays = [ids_column if n == "ids" else pa.array(v, pa.int64()) for n, v in out.items()]
            yield pa.RecordBatch.from_arrays(arrays, list(out))


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    longest: int = LONGEST, end: int = END, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: its ids (null without ``with_ids``), place in the document, and sequence.

    ``longest`` must be a power of two. The tokenizer's file must be at the same path on every worker.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: piece_rows(batches, tokenizer_path, longest, end, with_ids), PIECES)


def write_buckets(pieces: DataFrame, folder: str) -> None:
    """Write sequences in one folder per length, ready to be batched."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(folder)
