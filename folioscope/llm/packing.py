"""Order-preserving packing by dynamic programming.

A block of documents, in the order of the input, is one line of token ids. Cut candidates are document ends, sentence
ends, and every FORCED-th id of a sentence that is longer. A window is what lies between two chosen cuts, at most
`window` ids. Its cost is its padding (window - length; none at a power of two) plus a truncation penalty if its last
cut is inside a document: less at a sentence end than inside a sentence.

best(j) = penalty(j) + min over cuts i with p(j) - p(i) <= window of best(i) + window - p(j) + p(i). The term
best(i) + p(i) does not depend on j, so the minimum over the sliding range comes from a monotone queue in O(1); windows of
a power of two are looked up by their start. A block costs O(cuts), and the choice is optimal for the block.

Blocks follow the input's partitions and end after BLOCK ids, so nothing is shuffled and a task that runs again gives
the same rows; a block's last window is all that a block can lose. sequence_id is the partition number times 2^33 plus
the number of the window within the partition.

Tokens: the tokenizer splits at white space before anything else, so a word's ids do not depend on its neighbours;
words are looked up, and only new ones are encoded.

Defined cases: a null text is empty, its document is the end id alone; null and repeated ids are documents like others;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import os
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, END, BLOCK, FORCED = 2048, 1, 1_000_000, 256
#: What a cut inside a document costs, in ids of padding: after a sentence, within one.
AFTER_SENTENCE, IN_SENTENCE = 2, 12
VOCABULARY = "word_bpe_49k.json"
REMEMBER = 1_500_000


def cuts_of(position: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Indexes of the chosen cuts, the last included. position: the candidates' places, ascending and above 0."""
    places, costs = [0, *position.tolist()], [0, *penalty.tolist()]
    n = len(places)
    best, came = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (best + place, index), rising
    index = {0: 0}
    powers = [1 << k for k in range(window.bit_length() - 1) if 1 << k < window]
    for j in range(1, n):
        p = places[j]
        low = p - window
        while queue and places[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        value += window - p
        for d in powers:
            k = index.get(p - d)
            if k is not None and best[k] < value:
                value, i = best[k], k
        value += costs[j]
        best[j], came[j] = value, i
        key = value + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
        index[p] = j
    out, j = [], n - 1
    while j:
        out.append(j - 1)
        j = came[j]
    return out[::-1]


def candidates(lengths: np.ndarray, sentence_end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and penalties of cuts in a line of documents; sentence_end flags ids after which a sentence ends."""
    total = int(lengths.sum())
    cost = np.full(total + 1, -1, dtype=np.int32)
    cost[np.flatnonzero(sentence_end) + 1] = AFTER_SENTENCE
    cost[np.cumsum(lengths)] = 0
    fixed = np.flatnonzero(cost >= 0)
    starts = np.concatenate(([0], fixed[:-1])) if len(fixed) else fixed
    forced = min(FORCED, window)
    for a, b in zip(starts[(far := fixed - starts > forced)].tolist(), fixed[far].tolist(), strict=True):
        cost[np.arange(a + forced, b, forced)] = IN_SENTENCE
    place = np.flatnonzero(cost >= 0)
    place = place[place > 0]
    return place, cost[place]


class Words:
    """ids of texts by a tokenizer that splits at white space; remembers the first REMEMBER words, as bytes of uint32."""

    of: dict[str, Words] = {}

    def __init__(self, path: str):
        # a task has one core; threads of the library's own would only wake each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        ends = [i for s, i in self.tokenizer.get_vocab().items() if s.removesuffix("</w>")[-1:] in (".", "!", "?", "…") and s.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        self.ends[ends] = True

    @classmethod
    def shared(cls, path: str) -> Words:
        """One for each Python worker, kept from task to task."""
        if path not in cls.of:
            cls.of[path] = cls(path)
        return cls.of[path]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; words that are new to all of them are encoded in one call.

        The tokenizer takes no notice of case, so words are looked up in lower case, unless the text may hold a special
        token's name.
        """
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        found = [list(map(self.known.get, words)) for words in split]
        open_ = [k for k, ids in enumerate(found) if None in ids]
        new = list({w for k in open_ for w, ids in zip(split[k], found[k], strict=True) if ids is None})
        if new:
            own = {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(new, self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True)}
            if len(self.known) + len(own) <= REMEMBER:
                self.known.update(own)
            for k in open_:
                found[k] = [own[w] if ids is None else ids for w, ids in zip(split[k], found[k], strict=True)]
        return [b"".join(ids) for ids in found]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, sequence_length long"
NAMES = [x.split()[0].strip("`") for x in SCHEMA.split(", ")]


def pack_block(doc_ids: list, tokens: list[np.ndarray], ends: np.ndarray, window: int, first: int) -> list[tuple]:
    """Rows of SCHEMA for a block of documents; windows are numbered from first."""
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    line = np.concatenate(tokens)
    place, cost = candidates(lengths, ends[line], window)
    bounds = [0, *place[cuts_of(place, cost, window)].tolist()]
    starts = np.concatenate(([0], np.cumsum(lengths))).tolist()
    rows, d = [], 0
    for w, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        at = a
        while at < b:
            while starts[d + 1] <= at:
                d += 1
            to = min(b, starts[d + 1])
            rows.append((doc_ids[d], at - starts[d], to - at, zlib.crc32(line[at:to].tobytes()), int(lengths[d]), first + w, at - a, b - a))
            at = to
    return rows


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row for each piece of a document in a window. path: the tokenizer's file, the same on all machines."""

    def packed(batches):
        words, first = Words.shared(path), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        doc_ids, tokens, total, end = [], [], 0, END.to_bytes(4, "little")

        def flush():
            nonlocal first
            rows = pack_block(doc_ids, tokens, words.ends, window, first)
            first = rows[-1][5] + 1
            types = [pa.int64()] * len(NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=NAMES)

        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.ids(texts), strict=True):
                doc_ids.append(doc_id)
                tokens.append(np.frombuffer(ids + end, dtype="<u4"))
                total += len(tokens[-1])
                if total >= block:
                    yield flush()
                    doc_ids, tokens, total = [], [], 0
        if tokens:
            yield flush()

    return docs.select(F.col(id_col).cast("long"), F.col(text).cast("string")).mapInArrow(packed, SCHEMA)
