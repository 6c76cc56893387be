"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a stretch of texts are put in sorted order, which is the preorder of
their trie; the state of the current path - the best score and the number of tokens of every
prefix - is kept on a stack, so a prefix that several pre-tokens share is scored once.  The
count at the end of each pre-token is stored and reused for every later occurrence.

Nothing is shuffled: a task needs only the vocabulary, which is read from a file by the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import others

MARK = "▁"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Stored pre-tokens in a task; beyond it the store starts anew, which changes no result.
STORE = 400_000
#: Extra cost of a byte that no piece covers.
BYTE_COST = 10.0


def load_vocabulary(path: str = PIECES) -> dict[str, float]:
    """Pieces of a sentencepiece file with Zipf log-probabilities by their rank in it; control and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    total = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r) - total for r, p in enumerate(pieces, 1)}


class Counter:
    """Counts tokens of pre-tokens; ``vocabulary`` maps pieces to log-probabilities."""

    def __init__(self, vocabulary: dict[str, float]):
        # the pieces' own trie, by their characters from the last to the first; "" holds a piece's score
        self.endings: dict = {}
        for piece, s in vocabulary.items():
            node = self.endings
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = s
        self.byte = min(vocabulary.values(), default=0.0) - BYTE_COST
        self.stored: dict[bytes, tuple[int, float]] = {}

    def insert(self, words: set[bytes]) -> None:
        """Store the token count and best score of each word, walking their trie in preorder."""
        if len(self.stored) + len(words) > STORE:
            self.stored.clear()
        endings, byte = self.endings, self.byte
        path, score, count = "", [0.0], [0]
        for word, raw in sorted((MARK + w.decode("utf-8", "surrogateescape"), w) for w in words):
            shared = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                shared += 1
            del score[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                n = len(word[end - 1].encode("utf-8", "surrogateescape"))
                best, tokens = score[end - 1] + n * byte, count[end - 1] + n
                node = endings
                for start in range(end - 1, -1, -1):
                    node = node.get(word[start])
                    if node is None:
                        break
                    s = node.get("")
                    if s is not None and score[start] + s >= best:  # the longer last piece wins a tie
                        best, tokens = score[start] + s, count[start] + 1
                score.append(best)
                count.append(tokens)
            path = word
            self.stored[raw] = (count[-1], score[-1])


def _count(vocabulary: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            rows, column = batch.column(0), batch.column(1)
            for at in range(0, len(rows), 512):
                texts = [(t.as_py() or b"").split() for t in column.slice(at, 512)]
                new = set().union(*texts) - counter.stored.keys()
                if len(counter.stored) + len(new) > STORE:  # the store will be emptied
                    new = set().union(*texts)
                counter.insert(new)
                found = counter.stored
                sums = [list(map(found.__getitem__, words)) for words in texts]
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": rows.slice(at, 512),
                        "n_pretokens": pa.array([len(s) for s in sums], pa.int64()),
                        "n_tokens": pa.array([sum(map(itemgetter(0), s)) for s in sums], pa.int64()),
                        "log_prob": pa.array([math.fsum(map(itemgetter(1), s)) for s in sums], pa.float64()),
                    }
                )

    return run


def count_tokens(docs: DataFrame, text_col: str = "text", vocabulary: dict[str, float] | None = None) -> DataFrame:
    """struct ``row`` (``docs``' columns but the text), n_pretokens, n_tokens and log_prob of the best segmentation.

    Pre-tokens are runs of anything but space and 0x09-0x0D, each after a word mark.  Null and
    empty texts have no tokens; characters that no piece covers count one token a byte; repeated
    rows count alike; an empty table gives no rows.
    """
    d = docs.select(others(docs, text_col).alias("row"), F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType([*d.select("row").schema, T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType())])
    return d.mapInArrow(_count(load_vocabulary() if vocabulary is None else vocabulary), schema)
