"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is escaped (space to U+2581, one before the text) and cut at places
that no piece of the vocabulary spans; each chunk is merged by an agenda of
adjacent symbol pairs, best score first and leftmost among equals.  Symbols
outside the vocabulary fall back to byte pieces.  Chunks are cached within a
bound; every chunk is checked against the sentencepiece library, both ways,
when an Arrow batch brings it for the first time.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re

from pyspark.sql import DataFrame, SparkSession

from tomoframe.llm import arrow_text, shared

SPACE = "▁"


class Vocabulary:
    """Pieces, scores and byte pieces, read from a model file through the library."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte: dict[int, int] = {}
        self.decoded: dict[int, bytes] = {}
        special = 0
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.decoded[i] = bytes([int(piece[3:5], 16)])
            elif sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i):
                special += 1
            else:
                self.id[piece] = i
                self.score[piece] = sp.get_score(i)
                self.decoded[i] = piece.replace(SPACE, " ").encode()
        if len(self.byte) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        self._pairs()
        used = {c for p in self.id for c in p}
        #: Characters of no piece: nothing merges across them, so each is a chunk.
        self.alone = "".join(c for c in "\n\t\r" if c not in used)
        self.chunks = next(c for c in map(re.compile, self._cuts()) if all(c.findall(p) == [p] for p in self.id))

    def _cuts(self) -> list[str]:
        """Ways to cut a text, finest first; one serves if it leaves every piece whole, as its cuts depend on neighbouring characters only."""
        stop = re.escape(self.alone)
        first = f"[{stop}]|" if stop else ""
        letters, others = r"[^\W\d_²³¹¼½¾]+", rf"(?:[^\w{SPACE}{stop}]|[_²³¹¼½¾])+"
        return [
            rf"{first}{SPACE}*{letters}|{SPACE}*\d|{SPACE}*{others}|{SPACE}+",
            rf"{first}{SPACE}*{letters}|{SPACE}*(?:[^\w{SPACE}{stop}]|[\d_²³¹¼½¾])+|{SPACE}+",
            rf"{first}{SPACE}*[^{SPACE}{stop}]+|{SPACE}+",
            r"(?s).+",
        ]

    def _pairs(self) -> None:
        """Numbers all symbols, and lists for each pair that makes a piece its negative score and the piece's number."""
        self.symbol: dict[str, int] = {}
        number = lambda x: self.symbol.setdefault(x, len(self.symbol))
        for c in sorted({c for p in self.id for c in p}):
            number(c)
        self.pair: dict[int, tuple[float, int]] = {}
        for p, score in self.score.items():
            for k in range(1, len(p)):
                if (k == 1 or p[:k] in self.id) and (k == len(p) - 1 or p[k:] in self.id):
                    self.pair[number(p[:k]) << 20 | number(p[k:])] = -score, number(p)
        self.piece_of = {n: self.id.get(x) for x, n in self.symbol.items()}

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk by the agenda of adjacent pairs: best score first, leftmost among equals."""
        number, pair = self.symbol, self.pair.get
        symbols = [number.get(c, -1) for c in chunk]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(t[0], i, i + 1, symbols[i], symbols[i + 1], t[1]) for i in range(n - 1) if (t := pair(symbols[i] << 20 | symbols[i + 1]))]
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, j, left, right, new = pop(agenda)
            if symbols[i] != left or symbols[j] != right or after[i] != j:
                continue
            symbols[i], symbols[j] = new, -2
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if t := pair(new << 20 | symbols[k]):
                    push(agenda, (t[0], i, k, new, symbols[k], t[1]))
            h = before[i]
            if h >= 0 and (t := pair(symbols[h] << 20 | new)):
                push(agenda, (t[0], h, i, symbols[h], new, t[1]))
        out: list[int] = []
        at = 0
        while at < n:
            s = symbols[at]
            if s >= 0 and (whole := self.piece_of[s]) is not None:
                out.append(whole)
            else:
                out += [self.byte[b] for b in chunk[at].encode()]
            at = after[at]
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.decoded[i] for i in ids])


class Encoder:
    """Texts to (number of ids, ids joined by commas, decoded text)."""

    def __init__(self, path: str, check: bool = True, cache_chunks: int = 600_000) -> None:
        self.words = Vocabulary(path)
        self.names = [str(i) for i in range(self.words.library.get_piece_size())]
        self.ids: dict[str, str] = {}
        self.texts: dict[str, bytes] = {}
        self.check, self.most = check, cache_chunks

    def _learn(self, new: list[str]) -> None:
        words, names = self.words, self.names
        gc.disable()  # millions of short tuples and no cycles
        ids = [words.merge(c) for c in new]
        gc.enable()
        if self.check:
            # a chunk without the leading space follows a character that merges with nothing
            lead = words.alone[:1]
            plain = [c[1:] if c[0] == SPACE else lead + c for c in new]
            skip = [0 if c[0] == SPACE else 2 for c in new]
            plain = [p.replace(SPACE, " ") for p in plain]
            theirs = words.library.encode(plain, num_threads=1)
            for c, p, k, mine, want in zip(new, plain, skip, ids, theirs, strict=True):
                if p and mine != want[k:]:
                    raise RuntimeError(f"chunk {c!r}: {mine} but the library gives {want[k:]}")
            flat = [i for mine in ids for i in mine]
            ours = words.decode_bytes(flat)
            if (ours[1:] if ours[:1] == b" " else ours).decode("utf-8", "replace") != words.library.decode(flat):
                raise RuntimeError("the library decodes the ids of a batch's new chunks to another text")
        for c, mine in zip(new, ids, strict=True):
            self.ids[c] = ",".join([names[i] for i in mine])
            self.texts[c] = words.decode_bytes(mine)

    def batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        cut = [self.words.chunks.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.ids) > self.most:
            self.ids, self.texts = {}, {}
        if new := [c for c in set().union(*cut) if c not in self.ids]:
            self._learn(new)
        ids, back = self.ids.__getitem__, self.texts.__getitem__
        out = []
        for chunks in cut:
            joined = ",".join(map(ids, chunks))
            # the first space is the one that encoding put there
            text = b"".join(map(back, chunks))[1:].decode("utf-8", "replace")
            out.append((joined.count(",") + 1 if joined else 0, joined, text))
        return out


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, check: bool = True) -> DataFrame:
    """One row per input row: doc_id, ids (array of int), decoded; with digests n_tokens, ids_sha256, decoded_sha256 instead.

    Null and empty texts have no ids and decode to the empty text.  Repeated
    rows are encoded one by one, an empty table gives an empty result, other
    columns are ignored.
    """

    def make():  # noqa: ANN202
        encoder = Encoder(model_path, check)

        def work(texts: list[str]) -> dict:
            import pyarrow as pa

            done = encoder.batch(texts)
            if digests:
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                return {"n_tokens": pa.array([x[0] for x in done], pa.int64()), "ids_sha256": pa.array([sha(x[1]) for x in done], pa.string()), "decoded_sha256": pa.array([sha(x[2]) for x in done], pa.string())}
            ids = [[int(i) for i in x[1].split(",")] if x[1] else [] for x in done]
            return {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([x[2] for x in done], pa.string())}

        return work

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return arrow_text.map_texts(docs, make, schema, id_col, text_col)


def op9_sentencepiece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tomoframe.llm.packing import tokenizer_path

    return encode_pieces(shared.read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), digests=True)
