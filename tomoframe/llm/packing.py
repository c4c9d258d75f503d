"""Bounded-space online packing of token sequences.

Each task reads its documents once and keeps a fixed number of open windows.
Whole multiples of the window size leave at once; the rest of a document goes
to the open window that it fills best.  If it fits none, a new window opens
while there is room for one, else the fullest is emitted, topped up with the
head of the document, as documents may be cut freely.  The windows left open
at the end of a task carry their ids and are merged in bounded groups of
tasks.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.llm import arrow_text, shared

WINDOW, OPEN, END_ID = 2048, 32, 1
#: Tasks whose leftovers one task merges: at most this many times OPEN windows.
MERGE_TASKS = 32

#: The vocabulary's word pattern for texts of ASCII and Latin letters only, where Python's classes agree with Unicode's.
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ſ]+|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile(r"[^\t-\r -~À-ÖØ-öø-ſ]")


def _little(ids: array) -> bytes:
    if sys.byteorder != "little":
        ids.byteswap()
    return ids.tobytes()


class ByteEncoder:
    """Ids by the tokenizers library, as little-endian unsigned 32-bit bytes.

    Words of the vocabulary's pattern encode on their own, so plain texts are
    looked up word by word in a bounded cache; any other text goes to the
    library whole.
    """

    def __init__(self, path: str, cache_words: int = 600_000) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self.most = cache_words
        # byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.alphabet = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(rest)}
        trial = [" the", "Straße", "\n\n", "12", " don", "'t", "naïve", "...", " \x01"]
        if self._words(trial) != self._library(trial):
            self._words = self._library  # not a byte-level vocabulary

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of single words by the library's merge model alone, which skips splitting them again."""
        model, alphabet = self.library.model, self.alphabet
        return [_little(array("I", [t.id for t in model.tokenize(w.encode().decode("latin-1").translate(alphabet))])) for w in words]

    def _library(self, texts: list[str]) -> list[bytes]:
        batch = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [_little(array("I", e.ids)) for e in batch(texts, add_special_tokens=False)]

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; new words of all texts go to the library in one call."""
        cut = [None if _NOT_PLAIN.search(t) or any(s in t for s in self.special) else _PLAIN_WORDS.findall(t) for t in texts]
        cache = self.cache
        if len(cache) > self.most:
            cache.clear()
        new = list(set().union(*filter(None, cut)).difference(cache))
        cache.update(zip(new, self._words(new), strict=True))
        get = cache.__getitem__
        for t, words in zip(texts, cut, strict=True):
            yield self._library([t])[0] if words is None else b"".join(map(get, words))

    def __call__(self, text: str) -> bytes:
        return next(self.batch([text]))


class Packer:
    """Open windows of one task.  Pieces are (doc_id, start, length, crc32, doc_tokens, sequence_id, offset, ids or None)."""

    def __init__(self, first_id: int, window: int = WINDOW, room: int = OPEN) -> None:
        self.next_id, self.window, self.room = first_id, window, room
        self.open: list[list] = []  # [tokens, pieces]
        self.out: list[tuple] = []

    def _emit(self, pieces: list[tuple], keep_ids: bool = False) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.next_id, offset, ids if keep_ids else None))
            offset += n
        self.next_id += 1

    def add(self, doc: int | None, ids: bytes, total: int, start: int = 0) -> None:
        window = self.window
        left = len(ids) // 4
        at = 0
        while left >= window:
            self._emit([(doc, start + at, ids[4 * at : 4 * (at + window)], total)])
            at, left = at + window, left - window
        while left:
            best = None
            for w in self.open:
                if w[0] + left <= window and (best is None or w[0] > best[0]):
                    best = w
            if best is None and len(self.open) < self.room:
                best = [0, []]
                self.open.append(best)
            if best is not None:
                best[0] += left
                best[1].append((doc, start + at, ids[4 * at :], total))
                if best[0] == window:
                    self.open.remove(best)
                    self._emit(best[1])
                return
            full = max(self.open, key=lambda w: w[0])
            self.open.remove(full)
            head = window - full[0]
            full[1].append((doc, start + at, ids[4 * at : 4 * (at + head)], total))
            self._emit(full[1])
            at, left = at + head, left - head

    def leave(self) -> None:
        """Ends the task: open windows go out with their ids."""
        for w in self.open:
            self._emit(w[1], True)
        self.open = []

    def batch(self) -> dict:
        cols = list(zip(*self.out, strict=True)) or [()] * 8
        self.out = []
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
        return {k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in zip(names, cols, strict=True)}


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pack_tasks(docs: DataFrame, path: str, window: int, room: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = ByteEncoder(path)
        packer = Packer(TaskContext.get().partitionId() << 36, window, room)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for part in arrow_text.slices(batch, 1):
                for doc, found in zip(part.column(0).to_pylist(), encode.batch(part.column(1).to_pylist()), strict=True):
                    ids = found + end
                    packer.add(doc, ids, len(ids) // 4)
                yield pa.RecordBatch.from_pydict(packer.batch())
        packer.leave()
        yield pa.RecordBatch.from_pydict(packer.batch())

    return docs.mapInArrow(run, SCHEMA)


def _merge_leftovers(left: DataFrame, window: int, room: int) -> DataFrame:
    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(1 << 62 | int(key[0]) << 36, window, 1)
        for r in rows.sort_values(["sequence_id", "offset"]).itertuples():
            doc = None if pd.isna(r.doc_id) else int(r.doc_id)
            packer.add(doc, r.ids, r.doc_tokens, r.start)
        packer.leave()
        return pd.DataFrame({k: v.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get) for k, v in packer.batch().items()}).drop(columns="ids")

    group = F.shiftright("sequence_id", 36) / MERGE_TASKS
    return left.groupBy(group.cast("long").alias("g")).applyInPandas(merge, SCHEMA.replace(", ids binary", ""))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, room: int = OPEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids and then id 1; every id lies in one piece, pieces
    of a sequence are laid without gaps from 0, and only the last sequence of
    each merge group can be short.  Null texts are empty: one piece of length
    1.  Repeated rows are packed one by one, an empty table gives an empty
    result, other columns are ignored.
    """
    pieces = shared.stage_table(_pack_tasks(arrow_text.id_and_text(docs, id_col, text_col), tokenizer_path, window, room), "pieces")
    done = pieces.where("ids IS NULL").drop("ids")
    merged = _merge_leftovers(pieces.where("ids IS NOT NULL"), window, room)
    return done.unionByName(merged)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file lies on this machine; every executor has the same package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(shared.read(spark, sf_dir, "documents"), tokenizer_path())
