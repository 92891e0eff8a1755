"""Token counts of whole texts as the tokenizer's library gives them.

A text above CHUNK characters is encoded in overlapping chunks with offsets, and the count is the sum of
the tokens that each chunk's own encoding has between two splice points. Two chunks are spliced at a
position in their overlap where both encodings have a token boundary and which is *proven stable*: no
piece of the vocabulary can straddle it, so that no merge crosses it whatever stands around. An overlap
without such a position is widened, and then the chunk, up to the whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Characters of a chunk and of the overlap at first.
CHUNK, OVERLAP = 1 << 12, 1 << 7
SPACE = "▁"


class PieceCounter:
    """Counts tokens with a sentencepiece model.

    The library writes a space as SPACE and puts one before the text. If no piece holds a SPACE
    after another character, then the place between a non-space and a space is stable.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        stable = not any(re.search(f"[^{SPACE}]{SPACE}", x) for x in pieces)
        # The normalizer must leave every character alone but for spaces, and keep all of those.
        plain = self.model.normalize(" a  \u00a0\ufb01\u00c5\n\t b ") == f"{SPACE}{SPACE}a{SPACE}{SPACE}\u00a0\ufb01\u00c5\n\t{SPACE}b{SPACE}"
        self.provable = stable and plain
        # Characters of each piece; of a character in bytes the first has it.
        byte = [int(x[3:5], 16) if self.model.is_byte(i) else -1 for i, x in enumerate(pieces)]
        self.inner = np.array([0x80 <= b < 0xC0 for b in byte])
        self.width = np.array([len(x) if b < 0 else int(not 0x80 <= b < 0xC0) for x, b in zip(pieces, byte)])
        self.unknown = self.model.unk_id()

    def starts(self, text: str, at: int, end: int) -> np.ndarray:
        """Where in ``text`` the tokens of text[at:end], encoded on its own, begin."""
        ids = np.array(self.model.encode(text[at:end]), np.int64)
        if (ids == self.unknown).any():  # as wide as what it stands for
            return at + np.array([p.begin for p in self.model.encode(text[at:end], return_type="proto").pieces], np.int64)
        width = self.width[ids]
        begin = np.cumsum(width) - width - 1 - self.inner[ids]  # 1: the SPACE before the text
        return at + np.maximum(begin, 0)

    @staticmethod
    def is_stable(text: str, at: int) -> bool:
        return text[at] in (" ", SPACE) and text[at - 1] not in (" ", SPACE)

    def splice(self, text: str, left: np.ndarray, right: np.ndarray, low: int, high: int) -> int | None:
        """The last proven stable position in low < x < high at which tokens of both encodings begin."""
        shared = np.intersect1d(left[(left > low) & (left < high)], right[(right > low) & (right < high)])
        return next((x for x in shared[::-1].tolist() if self.is_stable(text, x)), None)

    def count(self, text: str) -> int:
        if not self.provable or len(text) <= CHUNK:
            return len(self.model.encode(text)) if text else 0
        total, splice, at, end, overlap = 0, 0, 0, CHUNK, OVERLAP
        left = self.starts(text, at, end)
        while end < len(text):
            start = max(at, end - overlap)
            to = min(len(text), start + max(CHUNK, 2 * overlap))
            right = self.starts(text, start, to)
            cut = self.splice(text, left, right, max(start, splice), end)
            if cut is not None:
                total += int(((left >= splice) & (left < cut)).sum())
                splice, at, end, left, overlap = cut, start, to, right, OVERLAP
            elif start > at:
                overlap *= 2
            else:  # no stable position in all of the chunk: a wider one
                end = min(len(text), at + 2 * (end - at))
                left = self.starts(text, at, end)
        return total + int((left >= splice).sum())


_COUNTERS: dict[str, PieceCounter] = {}


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``model`` is the path of a sentencepiece model that every executor can open. No begin, end or
    added special tokens. Null or empty text: 0 bytes, 0 tokens. Rows are taken one by one, so that
    repeated rows and null ids come out as they went in; other columns are not carried.
    """

    def run(batches):
        counter = _COUNTERS.get(model) or _COUNTERS.setdefault(model, PieceCounter(model))
        for batch in batches:
            n = [counter.count(x) if x else 0 for x in (v.as_py() for v in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
