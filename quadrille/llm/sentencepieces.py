"""SentencePiece BPE by a table of each prefix's last token.

In byte-pair encoding the last token of every prefix of a text is unique: of the pieces that
end there (found by an automaton over all pieces), it is the one that is compatible with the
last token of the prefix before it, which is to say that merging the two tokens' characters
leaves just these two. The table holds that token for each prefix, and the encoding is read
from it backwards. No merge queue runs over the text.

Pieces here never hold a space mark after another character, so that a text falls into
chunks that no piece crosses; a chunk's encoding is kept for its next occurrence.

Defined results: null counts as empty; an empty text is the end id alone. Rows, ids and ties
need no care: each row is encoded by itself. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quadrille.llm.shared import holding, modest, table

MARK = "▁"
#: Entries a worker keeps of chunk encodings (in each of two generations) and of pair tests.
CHUNKS, PAIRS = 100_000, 250_000


class PrefixTable:
    """Encoder and decoder of one BPE model."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
        self.ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not special(i)}
        if any(sp.is_unused(i) for i in self.ids.values()):
            raise ValueError("pieces marked unused are not supported")
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.by_byte = sp.is_byte(self.bytes[0])
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        self.text = [str(i) for i in range(sp.get_piece_size())]
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        #: Two characters that stand side by side in no piece: no token crosses that place.
        self.inside = {a + b for p in self.ids for a, b in zip(p, p[1:])}
        self.chunk = re.compile(self._chunks())
        self.traces: dict[str, list | None] = {}
        self.compatible: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _chunks(self) -> str:
        """A pattern of chunks that no piece crosses: a run of letters before a space mark or a character
        that follows a letter in no piece, or else whatever stands before the next space mark or line end."""
        if any(x[1] == MARK and x[0] != MARK for x in self.inside):
            return "(?s).+"
        if any("\n" in x for x in self.inside):
            return f"{MARK}*[^{MARK}]+|{MARK}+"
        after = [c for c in string.punctuation if not any(x[1] == c and x[0].isalpha() for x in self.inside)]
        odd = {x[0] for x in self.inside if x[1] in after and re.match(r"[^\W\d_]", x[0])}
        letter, stop = rf"[^\W\d_{''.join(odd)}]", "".join(map(re.escape, after))
        return rf"{MARK}*+{letter}++(?![^{MARK}\n{stop}])|{MARK}*[^{MARK}\n]+|{MARK}+|\n+"

    def trace(self, token: str) -> list[tuple[float, str, str]] | None:
        """The merges that make a token of its characters, in order: rank, left and right edge after it. None: it is never made."""
        if token not in self.traces:
            parts, steps = list(token), []
            while len(parts) > 1:
                best = min(((self.rank[p + q], i) for i, (p, q) in enumerate(zip(parts, parts[1:])) if p + q in self.rank), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
                steps.append((best[0], parts[0], parts[-1]))
            self.traces[token] = steps if len(parts) == 1 else None
        return self.traces[token]

    def pair(self, left: str, right: str) -> bool:
        """Whether merging the characters of left + right ends with just these two tokens."""
        key = (left, right)
        if (said := self.compatible.get(key)) is None:
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            said = self.compatible[key] = self._pair(left, right)
        return said

    def _pair(self, left: str, right: str) -> bool:
        a, b = self.trace(left), self.trace(right)
        if a is None or b is None:
            return False
        i = j = 0
        none = float("inf")
        p, q = left[0] if len(left) == 1 else left[-1], right[0]
        while True:
            across = self.rank.get(p + q, none)
            next_a, next_b = a[i][0] if i < len(a) else none, b[j][0] if j < len(b) else none
            # Of equal ranks the leftmost merges first: left's own, then the one across, then right's own.
            if across < next_a and across <= next_b:
                return False
            if next_a == none and next_b == none:
                return True
            if next_a <= next_b:
                p, i = a[i][2], i + 1
            else:
                q, j = b[j][1], j + 1

    def tokens(self, chunk: str) -> list[str]:
        """The tokens of a chunk; a character without a piece is a token of its own."""
        n, tested = len(chunk), self.compatible
        last: list[str | None] = [None] * (n + 1)
        for at, (piece, length) in self.automaton.iter(chunk):  # by end, so that the table is full before it
            if last[at + 1] is not None:
                continue
            if start := at + 1 - length:
                if (left := last[start]) is None:
                    left = last[start] = chunk[start - 1]
                if (fits := tested.get((left, piece))) is None:
                    fits = self.pair(left, piece)
            else:
                fits = self.trace(piece) is not None
            if fits:
                last[at + 1] = piece
        out = []
        while n:
            out.append(last[n] or chunk[n - 1])
            n -= len(out[-1])
        return out[::-1]

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        """The ids of a chunk that isn't among the known ones."""
        if (found := self.older.get(chunk)) is None:
            cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in self.inside]
            if cuts:
                parts = [chunk[a:b] for a, b in zip([0, *cuts], [*cuts, len(chunk)])]
                found = tuple(i for p in parts for i in (self.known.get(p) or self.chunk_ids(p)))
            else:
                ids: list[int] = []
                for token in self.tokens(chunk):
                    if token in self.ids:
                        ids.append(self.ids[token])
                    else:
                        ids += [self.bytes[b] for b in token.encode()] if self.by_byte else [self.unknown]
                found = tuple(ids)
        if len(chunk) < 100:
            if len(self.known) >= CHUNKS:
                self.known, self.older = {}, self.known
            self.known[chunk] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text with the end id."""
        ids: list[int] = []
        for chunk in self.chunk.findall(self.library.normalize(text)) if text else ():
            ids += self.known.get(chunk) or self.chunk_ids(chunk)
        ids.append(self.end)
        return ids

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)

    def forget(self) -> None:
        """Drops what was remembered of texts."""
        for cache in (self.known, self.older, self.compatible, self.traces):
            cache.clear()
        pa.default_memory_pool().release_unused()


@lru_cache(maxsize=2)
def prefix_table(model: bytes) -> PrefixTable:
    return PrefixTable(model)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each row's text, the end id last."""
    model = Path(model_path).read_bytes()  # half a megabyte: it goes along with the task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_table(model)
        holding("sentencepiece", encoder.forget)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pa.array([encoder.encode(t.as_py()) for t in part.column(1)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return modest(docs).select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of each row's ids; null ids count as none."""
    model = Path(model_path).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_table(model)
        for batch in batches:
            texts = pa.array([encoder.decode(x.as_py() or []) for x in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode each text, keep digests of both."""
    model = Path(model_path).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_table(model)
        holding("sentencepiece", encoder.forget)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            counts, digest, decoded = [], [], []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py())
                counts.append(len(ids))
                digest.append(sha(" ".join([encoder.text[i] for i in ids])))
                decoded.append(sha(encoder.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return modest(docs).select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
