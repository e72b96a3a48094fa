"""Token counts by a linear longest-match automaton.

The count of greedy longest-match word pieces of a text, without building the pieces. The vocabulary is
a trie whose nodes carry a failure link and a *popped-token count*: when no edge takes the next
byte, the pieces that are settled so far number ``popped[node]`` and matching goes on at ``link[node]``. Each
byte is taken once and links only shorten what is held, so a word of n bytes takes O(n) steps.

A word is a start mark and its UTF-8 bytes. Pieces that start a word begin with the mark; the others
continue one. The vocabulary comes from a public SentencePiece model, whose pieces begin with U+2581 at the start of a word and
which has every single byte, so every word has a segmentation. No tokenizer is trained here.

Text is split on space and U+0009 to U+000D. Counts of distinct words are remembered in each worker, up to a
bound in bytes that only decides what is counted again.

Defined cases. Null and blank texts have zero words and tokens. Repeated rows each return their row. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The symbol that starts a word; bytes are 0 to 255.
START = 256
MARK = "▁"
#: Bytes of a worker's memory of counted words, with ``ENTRY_BYTES`` for each; it is emptied when full.
MEMORY = 96 << 20
ENTRY_BYTES = 160


def load_pieces(path: str) -> list[tuple[int, ...]]:
    """The pieces of a SentencePiece model as symbols, with every single byte; control pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {(b,) for b in range(256)} | {(START,)}
    for k in range(sp.get_piece_size()):
        if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k)):
            piece = sp.id_to_piece(k)
            if MARK not in piece[1:]:
                out.add(((START,) if piece[:1] == MARK else ()) + tuple(piece.removeprefix(MARK).encode()))
    return sorted(out)


class Automaton:
    """Trie with failure links; edges are keyed by node * 512 + symbol."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        edges: dict[int, int] = {}
        last, parent, final = [-1], [0], [False]
        for piece in pieces:
            node = 0
            for s in piece:
                key = node << 9 | s
                nxt = edges.get(key)
                if nxt is None:
                    nxt = edges[key] = len(last)
                    last.append(s)
                    parent.append(node)
                    final.append(False)
                node = nxt
            final[node] = True
        depth = [0] * len(last)
        for v in range(1, len(last)):
            depth[v] = depth[parent[v]] + 1
        link, popped = [-1] * len(last), [0] * len(last)
        for v in sorted(range(1, len(last)), key=depth.__getitem__):
            if final[v]:
                link[v], popped[v] = 0, 1
                continue
            u = parent[v]
            n, z = popped[u], link[u]
            while z >= 0 and (z << 9 | last[v]) not in edges:
                n += popped[z]
                z = link[z]
            if z >= 0:
                link[v], popped[v] = edges[z << 9 | last[v]], n
        self.edges, self.link, self.popped = edges, link, popped

    def count(self, word: bytes) -> int:
        """Pieces of a word by greedy longest match; a word that the vocabulary cannot spell is one unknown token."""
        edges, link, popped = self.edges, self.link, self.popped
        node, n = edges.get(START, -1), 0
        if node < 0:
            return 1
        for s in word:
            nxt = edges.get(node << 9 | s)
            while nxt is None:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return 1
                nxt = edges.get(node << 9 | s)
            node = nxt
        while node:
            n += popped[node]
            node = link[node]
            if node < 0:
                return 1
        return n


def token_counts(docs: DataFrame, vocabulary: str, memory: int = MEMORY) -> DataFrame:
    """(doc_id, n_bytes, n_words, n_tokens) for every row of ``docs``; ``vocabulary`` is the path of a model on the driver."""
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(load_pieces(vocabulary)))

    def run(batches):
        count, known, size = automaton.value.count, {}, 0
        for b in batches:
            n_bytes, n_words, n_tokens = [], [], []
            for t in b.column(1):
                text = t.as_py() or b""
                words = text.split()
                total = 0
                for w, k in Counter(words).items():
                    c = known.get(w)
                    if c is None:
                        size += len(w) + ENTRY_BYTES
                        if size > memory:
                            known.clear()
                            size = len(w) + ENTRY_BYTES
                        c = known[w] = count(w)
                    total += c * k
                n_bytes.append(len(text))
                n_words.append(len(words))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_bytes", "n_words", "n_tokens"])

    src = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_bytes long, n_words long, n_tokens long")
